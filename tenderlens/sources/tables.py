"""Contract tables in Parquet, budget files, download manifests and exports."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderlens import schema
from tenderlens.operators.radar import by_risk
from tenderlens.operators.rankings import buyer_supplier_relations, top_suppliers
from tenderlens.refdata import LIMIT_INGEST
from tenderlens.session import shuffles_dropped
from tenderlens.sources import parts
from tenderlens.sources.feed import FEED_FILES, feed_contracts, feed_entries, read_feed_pages


#: Part of the cache key: to be raised with every change of what the parser makes of a page.
PARSER_VERSION = 2


def write_contracts(contracts: DataFrame, path: str, mode: str = "overwrite", part: str | None = None) -> None:
    """Contracts as Parquet by fiscal year. Rebalancing evens out file sizes and splits a hot year.

    ``overwrite`` replaces the table, ``append`` adds a part to it. A named part is replaced alone and as a whole: writing
    it again, as a stream does with a batch that failed, leaves exactly the rows written last, whatever years they have.
    """
    fields = [F.col(f.name).cast(f.dataType) for f in schema.CONTRACTS]
    if mode not in ("overwrite", "append"):
        raise ValueError("mode is overwrite or append")
    parts.write_version(contracts.select(*fields).hint("rebalance", F.col("fiscal_year")), path,
                        part or f"{mode}-{uuid.uuid4().hex}", "fiscal_year", whole=mode == "overwrite" and part is None)


def load_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Contracts with the declared schema, of the newest version of each part; conditions on the year read only its folders."""
    return parts.read_current(spark, path, schema.CONTRACTS)


def folder_signature(spark: SparkSession, folder: str, pattern: str = FEED_FILES) -> str:
    """Number and fingerprint of the feed files. Only names, sizes and times are read, not contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    n, total = files.select(mark.alias("m")).agg(F.count("*"), F.sum("m")).first()
    return f"{n}-{total or 0}"


def ingest_or_reuse(
    spark: SparkSession,
    folder: str,
    cache_root: str,
    force: bool = False,
    max_year: int | None = None,
    pattern: str = FEED_FILES,
    min_year: int = 2010,
    limit: float | None = LIMIT_INGEST,
) -> DataFrame:
    """Contracts of a feed folder, parsed once per state of the folder, set of arguments and version of the parser."""
    last = max_year or date.today().year + 1
    made_by = f"v{PARSER_VERSION}-{min_year}-{last}-{'any' if limit is None else limit}"
    path = f"{cache_root.rstrip('/')}/contracts-{made_by}-{folder_signature(spark, folder, pattern)}"
    if not force and parts.is_committed(spark, path):
        return load_contracts(spark, path)
    entries = feed_entries(read_feed_pages(spark, folder, pattern))
    write_contracts(feed_contracts(entries, min_year, last, limit=limit), path)
    return load_contracts(spark, path)


def read_budget(spark: SparkSession, lines_csv: str, entities_csv: str) -> tuple[DataFrame, DataFrame]:
    """Budget lines and entities from CSV files with header; columns are matched by name, codes stay text.

    Quoted fields may hold separators, line breaks and doubled quotes.
    """
    def read(path: str, wanted) -> DataFrame:
        # Without inference every column is text, whatever their number and order.
        return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).select(*[F.col(f.name).cast(f.dataType) for f in wanted])

    return read(lines_csv, schema.BUDGET_LINES), read(entities_csv, schema.BUDGET_ENTITIES)


def register_budget_views(lines: DataFrame, entities: DataFrame) -> None:
    lines.createOrReplaceTempView("econ")
    entities.createOrReplaceTempView("inv")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Download manifests, one JSON document per file."""
    return spark.read.schema(schema.MANIFEST).option("multiLine", True).json(path)


def manifest_source(manifests: DataFrame) -> DataFrame:
    """One row per visited address; a run that visited none keeps a row without address."""
    return manifests.select(
        F.col("fecha_utc").alias("fetched_at"), F.col("fuente").alias("source"),
        F.posexplode_outer("urls_visitadas").alias("visit", "url"),
        (F.col("url") == F.col("ultimo_url")).alias("is_last"),
        F.size("errores").alias("n_errors"),
    )


DISPLAY_COLUMNS = (
    "award_date", "region", "province", "municipality", "buyer_type", "buyer", "fiscal_year", "contract_type", "cpv",
    "subject", "supplier", "amount", "file_url",
)


def export_filtered_contracts(contracts: DataFrame) -> DataFrame:
    """The columns shown to readers, in their order."""
    return contracts.select(*DISPLAY_COLUMNS)


def export_tables(radar: DataFrame, contracts: DataFrame) -> dict[str, DataFrame]:
    """The five audit tables by file name."""
    return {
        "01_alertas": radar.where("is_alert").orderBy(*by_risk()),
        "02_radar_completo": radar.orderBy(*by_risk()),
        "03_top_adjudicatarios": top_suppliers(contracts, top=None),
        "04_relaciones_organo_adjudicatario": buyer_supplier_relations(contracts, top=None),
        "05_contratos_filtrados": contracts,
    }


def write_csv(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite", compression: str | None = None) -> None:
    """Each table as a folder of CSV files with header, packed if a compression is named."""
    for name, table in tables.items():
        with shuffles_dropped(table.sparkSession):
            table.write.mode(mode).option("header", True).option("escape", '"').csv(f"{folder.rstrip('/')}/{name}", compression=compression)
