"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderlens import functions as fn
from tenderlens.operators import budget, facets, filters, forensic, graph, name_index, radar, rankings
from tenderlens.plans import testmap
from tenderlens.session import scratch_dir, shuffles_dropped
from tenderlens.sources import chain, feed, large_pages, revisions, tables
from tenderlens.sources.parts import delete_folder, drop_superseded
from tenderlens.streaming import stream_contracts, stream_radar

Query = Callable[[SparkSession, str], DataFrame]
MAX_YEAR = 2030
QUERIES: dict[str, Query] = {}

SELECTION = filters.ContractFilter(
    regions=("Galicia", "Andalucía", "Cataluña", "Castilla y León"),
    contract_types=("Servicios", "Suministros"),
    years=(2021, 2022, 2023, 2024),
    supplier_contains="SUPPLIER#0000000",
    subject_contains="De ",
    buyer_contains=("hospital", "ayuntamiento", " "),
    amount_min=500,
    amount_max=9000,
)
LIKE_SELECTION = filters.ContractFilter(supplier_contains="supplier%1_", buyer_contains=("universidad de %a",), like=True)
ON_SCREEN = filters.ContractFilter(
    buyers=("Hospital de Cádiz", "Universidad de León", "Gobierno de Andalucía"),
    years=(2022, 2023),
    contract_types=("Obras", "Servicios"),
    supplier_contains="supplier#",
    amount_min=0,
    amount_max=40_000,
)


def query(func: Query) -> Query:
    """Register a query under its name; a trailing underscore keeps clear of imported names."""
    QUERIES[func.__name__.rstrip("_")] = func
    return func


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    return testmap.contracts(spark, sf)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return radar.radar(contracts(spark, sf), ordered=False)


# Sources and sinks


@query
def feed_entries(spark: SparkSession, sf: str) -> DataFrame:
    entries = feed.feed_entries(testmap.feed_pages(spark, sf))
    return entries.groupBy("source_file").agg(
        F.count("*").alias("n_entries"), F.min("entry_ord").alias("first_ord"), F.max("entry_ord").alias("last_ord"),
        F.count_if(F.col("entry_xml").rlike("(?s)^<entry>.*</entry>$")).alias("n_whole"),
    )


@query
def feed_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return feed.feed_contracts(feed.feed_entries(testmap.feed_pages(spark, sf)), max_year=MAX_YEAR)


@query
def contracts_parquet_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "contracts")
    tables.write_contracts(contracts(spark, sf), path)
    return tables.load_contracts(spark, path)


def _feed_folder(spark: SparkSession, sf: str, pages: DataFrame | None = None) -> str:
    """The feed as files, one page each; packed, as text they take many times the room of the tables."""
    folder = scratch_dir(spark, "feed")
    (testmap.feed_pages(spark, sf) if pages is None else pages).select("value").write.option("maxRecordsPerFile", 1).text(folder, compression="gzip")
    return folder


@query
def contracts_load(spark: SparkSession, sf: str) -> DataFrame:
    folder, cache = _feed_folder(spark, sf), scratch_dir(spark, "cache")
    def load(year: int) -> DataFrame:
        tables.ingest_or_reuse(spark, folder, cache, max_year=year, pattern="*.txt.gz")
        again = tables.ingest_or_reuse(spark, folder, cache, max_year=year, pattern="*.txt.gz")
        return again.groupBy(F.lit(year).alias("max_year"), "fiscal_year", "region").agg(
            F.count("*").alias("n_contracts"), fn.exact_sum(F.col("amount")).cast("double").alias("total")
        )

    # Two questions to one cache.
    both = load(2024).unionByName(load(MAX_YEAR))
    delete_folder(spark, folder)
    return both


@query
def feed_contracts_split(spark: SparkSession, sf: str) -> DataFrame:
    """The whole feed as one long file, which is cut at entries instead of files."""
    folder = scratch_dir(spark, "feed")
    # The pages are made by many tasks and stored; one task then only copies them into the file.
    pages = scratch_dir(spark, "pages")
    testmap.feed_pages(spark, sf).select("value").write.parquet(pages)
    spark.read.schema("value string").parquet(pages).coalesce(1).write.text(folder)
    delete_folder(spark, pages)
    entries = large_pages.write_large_entries(spark, folder, scratch_dir(spark, "entries"), "*.txt")
    delete_folder(spark, folder)
    return feed.feed_contracts(entries, max_year=MAX_YEAR)


@query
def feed_rejects(spark: SparkSession, sf: str) -> DataFrame:
    rejects = feed.feed_rejects(feed.feed_entries(testmap.feed_pages(spark, sf)))
    return rejects.groupBy("source_file", "reason").agg(F.count("*").alias("n"))


@query
def feed_contracts_any_amount(spark: SparkSession, sf: str) -> DataFrame:
    return feed.feed_contracts(feed.feed_entries(testmap.feed_pages(spark, sf)), max_year=MAX_YEAR, limit=None)


@query
def feed_latest_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Entries published again: a third of the pages corrected, corrections first, the first editions late and twice."""
    page = F.regexp_extract("source_file", r"page-(\d+)", 1).cast("bigint")
    named = F.regexp_replace("value", r'(?s)<id>urn:x</id>(.*?)<link href="([^"]*)"/>', r'<id>$2</id>$1<link href="$2"/>')
    # Three upserts read these pages: they are written once.
    first = _stored(spark, testmap.feed_pages(spark, sf).select("source_file", named.alias("value")), "pages")
    corrected = first.where(page % 3 == 1).select("source_file", F.replace(F.replace(
        "value", F.lit("<updated>1999"), F.lit("<updated>2001")), F.lit("<title><![CDATA["), F.lit("<title><![CDATA[Rectificado: ")).alias("value"))
    path = scratch_dir(spark, "revisions")

    def read(pages: DataFrame) -> DataFrame:
        return feed.feed_contracts(feed.feed_entries(pages), max_year=MAX_YEAR, revisions=True)

    for pages in (corrected, first, first):
        revisions.upsert_revisions(read(pages), path, buckets=8)
    _drop(first)
    return tables.load_contracts(spark, path)


@query
def budget_source(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_dir(spark, "budget")
    tables.write_csv({
        "tb_economica": testmap.budget_lines(spark, sf), "tb_inventario": testmap.budget_entities(spark, sf),
    }, folder)
    lines, entities = tables.read_budget(spark, f"{folder}/tb_economica", f"{folder}/tb_inventario")
    return budget.budget_ranking(lines, entities, chapter=2, provinces=None)


@query
def manifest_source(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_dir(spark, "manifests")
    testmap.manifests(spark, sf).write.option("maxRecordsPerFile", 1).text(folder)
    return tables.manifest_source(tables.read_manifests(spark, folder))


def _gappy_feed(spark: SparkSession, sf: str) -> DataFrame:
    page = F.regexp_extract("source_file", r"page-(\d+)", 1).cast("bigint")
    return testmap.feed_pages(spark, sf).where(page % 7 != 3)


@query
def feed_page_chain(spark: SparkSession, sf: str) -> DataFrame:
    return feed.feed_page_chain(_gappy_feed(spark, sf))


@query
def feed_page_chain_whole(spark: SparkSession, sf: str) -> DataFrame:
    return feed.feed_page_chain(testmap.feed_pages(spark, sf))


@query
def feed_missing_pages(spark: SparkSession, sf: str) -> DataFrame:
    return feed.missing_pages(_gappy_feed(spark, sf))


def _tangled_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of which some name an earlier page, the one after next, or none; some are not there."""
    page = F.regexp_extract("source_file", r"page-(\d+)", 1).cast("bigint")
    to = F.when(page % 50 == 20, page - 5).when(page % 50 == 30, page + 2).otherwise(page + 1)
    link = F.when(page % 50 == 49, "").otherwise(F.concat(F.lit('<link rel="next" href="page-'), to.cast("string"), F.lit('.atom"/>')))
    named = F.regexp_replace("value", F.lit('<link rel="next" href="page-[0-9]+.atom"/>'), link)
    return testmap.feed_pages(spark, sf).where(page % 50 != 40).select("source_file", named.alias("value"))


@query
def feed_chain_rank(spark: SparkSession, sf: str) -> DataFrame:
    return chain.feed_chain_rank(_tangled_feed(spark, sf))


@query
def feed_chain_rank_whole(spark: SparkSession, sf: str) -> DataFrame:
    return chain.feed_chain_rank(testmap.feed_pages(spark, sf))


@query
def feed_chains(spark: SparkSession, sf: str) -> DataFrame:
    return chain.feed_chains(chain.feed_chain_rank(_tangled_feed(spark, sf)))


@query
def export_tables(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_dir(spark, "export")
    # Contracts and radar go into several tables: each is made once, and the files, which are mostly contracts as text, are packed.
    rows = _stored(spark, contracts(spark, sf), "contracts")
    kept = _stored(spark, radar.radar(rows, ordered=False), "radar")
    audit = tables.export_tables(kept, rows)
    tables.write_csv(audit, folder, compression="gzip")
    for stored in (rows, kept):
        _drop(stored)
    keys = {
        "01_alertas": (*radar.GROUP_KEYS, "risk_index", "priority", "signals", "first_date", "total_text"),
        "03_top_adjudicatarios": ("supplier",), "04_relaciones_organo_adjudicatario": ("buyer", "supplier"),
        "05_contratos_filtrados": ("file_url", "buyer", "subject", "award_date", "cpv"),
    }
    keys["02_radar_completo"] = keys["01_alertas"]
    out = None
    for name in sorted(audit):
        back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{folder}/{name}")
        value = F.col("amount" if "amount" in back.columns else "total").cast("double")
        rows = back.select(F.lit(name).alias("table_name"), F.concat_ws("|", *keys[name]).alias("content"), value.alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def export_filtered_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.export_filtered_contracts(filters.query_contracts(contracts(spark, sf), ON_SCREEN))


# Filters, search and facets


@query
def query_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return filters.query_contracts(contracts(spark, sf), SELECTION)


@query
def query_contracts_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same filter over the written table: years prune its folders, the rest reaches the scan."""
    path = scratch_dir(spark, "contracts")
    tables.write_contracts(contracts(spark, sf), path)
    return filters.query_contracts(tables.load_contracts(spark, path), SELECTION)


@query
def query_contracts_like(spark: SparkSession, sf: str) -> DataFrame:
    return filters.query_contracts(contracts(spark, sf), LIKE_SELECTION)


@query
def ui_filter_semantics(spark: SparkSession, sf: str) -> DataFrame:
    return filters.query_contracts(contracts(spark, sf), ON_SCREEN)


@query
def facet_values(spark: SparkSession, sf: str) -> DataFrame:
    return facets.facet_values(contracts(spark, sf), "buyer", {"region": ["Galicia", "Aragón", "Castilla y León"]})


@query
def facet_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return facets.facet_cascade(contracts(spark, sf), ["Andalucía", "Castilla y León"], ["Granada", "León", "Cádiz"])


@query
def dataset_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return facets.dataset_metadata(contracts(spark, sf))


@query
def search_buyers(spark: SparkSession, sf: str) -> DataFrame:
    return filters.search_buyers(contracts(spark, sf), ["Hospital León", "diputacion provincial de cadiz"])


@query
def search_buyer_or_place(spark: SparkSession, sf: str) -> DataFrame:
    return filters.search_buyer_or_place(contracts(spark, sf), "1 villa ávila; CORUÑA universidad")


def _name_index(rows: DataFrame, columns: list[str], normal: name_index.Normal = fn.fold_text) -> str:
    """An index made by two updates, the second with all names."""
    path = scratch_dir(rows.sparkSession, "names")
    for some in (rows.where("fiscal_year <= 2020"), rows):
        name_index.update_name_index(some, path, columns, normal)
    return path


@query
def search_buyers_indexed(spark: SparkSession, sf: str) -> DataFrame:
    rows = contracts(spark, sf)
    return name_index.search_names(rows, _name_index(rows, ["buyer"]), ["Hospital León", "diputacion provincial de cadiz"])


@query
def search_buyer_or_place_indexed(spark: SparkSession, sf: str) -> DataFrame:
    rows, columns = contracts(spark, sf), ["buyer", "municipality"]
    return name_index.search_names(rows, _name_index(rows, columns), "1 villa ávila; CORUÑA universidad", columns)


@query
def query_contracts_indexed(spark: SparkSession, sf: str) -> DataFrame:
    rows = contracts(spark, sf)
    return name_index.query_contracts_indexed(rows, SELECTION, _name_index(rows, ["supplier"], F.lower))


@query
def municipal_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return facets.municipal_coverage(contracts(spark, sf), "Villa 1")


@query
def municipal_coverage_rows(spark: SparkSession, sf: str) -> DataFrame:
    return facets.municipal_coverage_rows(contracts(spark, sf), "villa 1")


@query
def reviewable_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return filters.reviewable_contracts(contracts(spark, sf))


@query
def case_detail(spark: SparkSession, sf: str) -> DataFrame:
    return radar.case_detail(contracts(spark, sf), scored(spark, sf).where("is_alert"))


# Scalar functions


def price_cents() -> Column:
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return testmap.table(spark, sf, "lineitem")


KEYS = ("l_orderkey", "l_linenumber")


def by_line(*variants: Column) -> Column:
    """One variant per line number, the last for all others."""
    out = F
    for number, variant in enumerate(variants[:-1], 1):
        out = out.when(F.col("l_linenumber") == number, variant)
    return out.otherwise(variants[-1])


@query
def parse_money(spark: SparkSession, sf: str) -> DataFrame:
    price = price_cents() / 100.0
    euros = F.floor(price).cast("bigint")
    text = by_line(
        fn.format_euros(price), F.format_number(price, 2), euros.cast("string"),
        F.concat(F.floor(euros / 1000).cast("string"), F.lit("."), F.lpad((euros % 1000).cast("string"), 3, "0")),
        F.concat(F.lit(" -"), price.cast("string")), F.concat(F.format_number(euros, 0), F.lit(" EUR")), F.lit("0,00"),
    )
    return lines(spark, sf).select(*KEYS, fn.parse_money(text).alias("amount"))


@query
def format_euros(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("l_linenumber") != 7, price_cents() * 37 / 100.0)
    return lines(spark, sf).select(*KEYS, fn.format_euros(value).alias("text"))


@query
def format_pct(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("l_linenumber") != 7, price_cents() / 1000.0)
    return lines(spark, sf).select(*KEYS, fn.format_pct(value).alias("text"))


@query
def fold_text(spark: SparkSession, sf: str) -> DataFrame:
    return testmap.table(spark, sf, "documents").select("doc_id", F.md5(fn.fold_text(F.col("text"))).alias("folded_md5"))


@query
def title_place(spark: SparkSession, sf: str) -> DataFrame:
    text = F.upper(F.concat(F.lit("  la "), "buyer", F.lit(" de  los ríos")))
    return contracts(spark, sf).select("buyer").distinct().select("buyer", fn.title_place(text).alias("titled"))


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Buyers with the place names that describe them."""
    return testmap.keyed_contracts(spark, sf).select(
        "buyer", "province", "region", "municipality", "nation_code"
    ).distinct()


@query
def normalize_province(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit(" ."), F.upper("province"), F.lit("; "))
    coruna = F.when(F.col("province") == "A Coruña", "CORUÑA (A)").otherwise(text)
    return places(spark, sf).select("province", fn.normalize_province(coruna).alias("normal")).distinct()


@query
def province_from_postcode(spark: SparkSession, sf: str) -> DataFrame:
    code = F.lpad((F.col("l_partkey") % 60).cast("string"), 2, "0")
    text = F.concat(F.lit("CP "), code, F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit(" España"))
    return lines(spark, sf).select(*KEYS, fn.province_from_postcode(text).alias("province"))


@query
def province_in_text(spark: SparkSession, sf: str) -> DataFrame:
    return contracts(spark, sf).select("buyer").distinct().select(
        "buyer", fn.province_in_text(F.upper("buyer")).alias("province")
    )


@query
def normalize_municipality(spark: SparkSession, sf: str) -> DataFrame:
    text = F.upper(F.concat("municipality", F.lit(" de los montes / "), "province"))
    return places(spark, sf).select("municipality", "province", fn.normalize_municipality(text).alias("normal")).distinct()


@query
def region_from_province(spark: SparkSession, sf: str) -> DataFrame:
    return places(spark, sf).select("province", fn.region_from_province(F.upper("province")).alias("region")).distinct()


@query
def contract_territory(spark: SparkSession, sf: str) -> DataFrame:
    city = F.concat(F.upper("municipality"), F.lit(" ("), F.upper("province"), F.lit(")"))
    postcode = F.when(F.col("municipality").isNull(), F.concat("nation_code", F.lit("001")))
    def tag(name: str, *content: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), *[F.coalesce(c, F.lit("")) for c in content], F.lit(f"</{name}>"))

    address = F.concat(tag("CityName", city), tag("PostalZone", postcode))
    other = F.lit("<CityName>SEVILLA</CityName><CountrySubentity>Sevilla</CountrySubentity>")
    by_party = tag("LocatedContractingParty", tag("AgentParty", tag("Party", other)), tag("Party", address))
    by_location = F.concat(tag("LocatedContractingParty", tag("Party", tag("CityName", F.lit(" ")))),
                           tag("RealizedLocation", tag("Address", address)), tag("RealizedLocation", tag("Address", other)))
    xml = tag("entry", F.when(F.crc32("buyer") % 2 == 0, by_party).otherwise(by_location))
    found = places(spark, sf).select("buyer", "nation_code", feed.contract_territory(xml).alias("p"))
    return found.select("buyer", "nation_code", "p.*")


@query
def normalize_award_date(spark: SparkSession, sf: str) -> DataFrame:
    date = F.add_months(F.col("l_shipdate").cast("date"), testmap.YEARS_SHIFT)
    day, year = date.cast("string"), F.year(date).cast("string")
    text = by_line(
        day, F.concat(F.lit(" "), day, F.lit("T10:00:00+02:00")), F.concat(F.lit("00"), F.substring(day, 3, 8)),
        F.col("l_shipdate").cast("date").cast("string"), F.concat(year, F.lit("-02-30")),
        F.concat(F.lit("2099"), F.substring(day, 5, 6)), F.lit("n/d"),
    )
    return lines(spark, sf).select(*KEYS, fn.normalize_award_date(text, max_year=MAX_YEAR).alias("award_date"))


@query
def parse_mixed_dates(spark: SparkSession, sf: str) -> DataFrame:
    date = F.col("l_shipdate").cast("date")
    text = by_line(
        date.cast("string"), *[F.date_format(date, f) for f in ("dd/MM/yyyy", "d-M-yyyy", "dd.MM.yyyy", "d/M/yy")],
        F.concat(date.cast("string"), F.lit(" 10:00")), F.lit("n/d"),
    )
    return lines(spark, sf).select(*KEYS, fn.parse_mixed_dates(text).alias("day"))


@query
def contract_type_label(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("l_linenumber") <= 5, (F.col("l_partkey") % 55).cast("string"))
    label = fn.contract_type_label(code, F.col("l_linenumber") == 6)
    return lines(spark, sf).select(*KEYS, label.alias("contract_type"))


@query
def extract_buyer_amount_from_summary(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(
        F.when(F.col("l_orderkey") % 2 == 0, "Órgano de Contratación: ").otherwise("Id: 1; Órgano Contratante:"),
        "buyer", F.lit(" ; Importe: "), F.translate(F.format_number("amount", 2), ",.", ".,"), F.lit(" EUR"),
    )
    rows = testmap.keyed_contracts(spark, sf)
    return rows.select(*KEYS, fn.extract_summary(text).alias("s")).select(*KEYS, "s.buyer", "s.amount")


@query
def infer_municipality(spark: SparkSession, sf: str) -> DataFrame:
    return places(spark, sf).select("buyer").distinct().select("buyer", fn.infer_municipality(F.col("buyer")).alias("town"))


@query
def infer_geography(spark: SparkSession, sf: str) -> DataFrame:
    return contracts(spark, sf).select("buyer").distinct().select(
        "buyer", fn.infer_geography(F.col("buyer")).alias("g")
    ).select("buyer", "g.province", "g.region")


@query
def infer_buyer_type(spark: SparkSession, sf: str) -> DataFrame:
    return contracts(spark, sf).select("buyer").distinct().select(
        "buyer", fn.infer_buyer_type(F.upper("buyer")).alias("buyer_type")
    )


@query
def legal_limit(spark: SparkSession, sf: str) -> DataFrame:
    return contracts(spark, sf).select("contract_type", fn.legal_limit(F.col("contract_type")).alias("limit_amount")).distinct()


@query
def amount_flag(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") == 7, "Fechas").otherwise("Importes (€)")
    text = fn.format_euros(price_cents() / 100.0)
    return lines(spark, sf).select(*KEYS, fn.amount_flag(kind, text).alias("flag"))


# Radar


@query
def radar_groups(spark: SparkSession, sf: str) -> DataFrame:
    return radar.radar_groups(contracts(spark, sf))


@query
def radar_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return radar.radar_amounts(contracts(spark, sf))


@query
def radar_alerts(spark: SparkSession, sf: str) -> DataFrame:
    alerts = radar.with_alerts(radar.radar_groups(contracts(spark, sf)), min_contracts=3, strict_works=True)
    return alerts.select(*radar.GROUP_KEYS, "total", "n_contracts", "is_alert", "limit_amount", "pct_limit", "risk_level")


@query
def radar_(spark: SparkSession, sf: str) -> DataFrame:
    return radar.radar(contracts(spark, sf))


@query
def radar_summary(spark: SparkSession, sf: str) -> DataFrame:
    return radar.radar_summary(scored(spark, sf))


@query
def priority_case(spark: SparkSession, sf: str) -> DataFrame:
    return radar.priority_case(scored(spark, sf), radar.radar_amounts(contracts(spark, sf)))


@query
def priority_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return radar.priority_alerts(scored(spark, sf), amounts=radar.radar_amounts(contracts(spark, sf)))


@query
def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    return radar.report_summary(contracts(spark, sf), scored(spark, sf))


@query
def report_alert_table(spark: SparkSession, sf: str) -> DataFrame:
    # The contracts are read twice: only the columns of the radar are stored for that.
    rows = _stored(spark, contracts(spark, sf).select("supplier_key", "buyer", "contract_type", "fiscal_year", "amount", "award_date"), "contracts")
    return radar.report_alert_table(radar.radar(rows, ordered=False), radar.radar_amounts(rows))


@query
def report_alert_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return radar.report_alert_amounts(scored(spark, sf), radar.radar_amounts(contracts(spark, sf)))


@query
def report_alert_table_short(spark: SparkSession, sf: str) -> DataFrame:
    return radar.report_alert_table_short(scored(spark, sf))


@query
def treemap_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return radar.treemap_suppliers(scored(spark, sf))


@query
def risk_scatter(spark: SparkSession, sf: str) -> DataFrame:
    return radar.risk_scatter(scored(spark, sf))


# Rankings and charts


@query
def top_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.top_suppliers(contracts(spark, sf))


@query
def buyer_supplier_relations(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.buyer_supplier_relations(contracts(spark, sf))


@query
def main_relations(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.buyer_supplier_relations(contracts(spark, sf), top=18, known_only=True)


@query
def spend_by_year_type(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.spend_by_year_type(contracts(spark, sf))


@query
def spend_by_territory(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.spend_by_territory(contracts(spark, sf), "province")


@query
def spend_by_territory_count(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.spend_by_territory(contracts(spark, sf), "municipality", metric="count")


@query
def territory_all_levels(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.territory_all_levels(contracts(spark, sf))


@query
def first_territory(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.first_territory(contracts(spark, sf))


@query
def first_territory_province(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.first_territory(contracts(spark, sf).withColumn("region", F.lit(None).cast("string")))


@query
def territory_map(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.territory_map(contracts(spark, sf), "province")


@query
def territory_map_regions(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.territory_map(contracts(spark, sf), "region", metric="count")


@query
def monthly_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.monthly_heatmap(contracts(spark, sf))


@query
def amount_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.amount_histogram(contracts(spark, sf))


@query
def top_supplier_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.top_supplier_contracts(contracts(spark, sf), top=10).select("supplier", "file_url", "amount")


@query
def supplier_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.supplier_timeline(contracts(spark, sf))


@query
def spend_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return rankings.spend_concentration(contracts(spark, sf))


# Graph


def _stored(spark: SparkSession, rows: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder, for what reads them more than once."""
    path = scratch_dir(spark, purpose)
    with shuffles_dropped(spark):
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _drop(stored: DataFrame) -> None:
    for folder in {file.rsplit("/", 1)[0] for file in stored.inputFiles()}:
        delete_folder(stored.sparkSession, folder)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges_of_folds(_stored(spark, graph.graph_folds(contracts(spark, sf)), "graph-folds"))


@query
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)


@query
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_nodes(_edges(spark, sf))


@query
def graph_filter(spark: SparkSession, sf: str) -> DataFrame:
    edges = _stored(spark, _edges(spark, sf), "graph-edges")
    return graph.graph_filter(edges, graph.graph_nodes(edges), depth=2, hidden_groups=["mun"])


@query
def bipartite_layout_data(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bipartite_layout_data(contracts(spark, sf))


@query
def bipartite_links(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bipartite_links(contracts(spark, sf))


# Budget


def settlement(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return testmap.budget_lines(spark, sf), testmap.budget_entities(spark, sf)


@query
def budget_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return budget.budget_ranking(*settlement(spark, sf), chapter=2, provinces=("15", "08", "01"))


@query
def budget_ranking_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return budget.budget_ranking(*settlement(spark, sf), chapter=4, provinces=None, top=100, by_id=True)


@query
def budget_ranking_total(spark: SparkSession, sf: str) -> DataFrame:
    ranking = budget.budget_ranking(*settlement(spark, sf), chapter=1, provinces=None)
    return budget.budget_ranking_total(ranking, top=100)


@query
def budget_entity_detail(spark: SparkSession, sf: str) -> DataFrame:
    return budget.budget_entity_detail(*settlement(spark, sf), "ENTIDAD 1_", chapter=2)


# Forensic text


@query
def scan_text(spark: SparkSession, sf: str) -> DataFrame:
    return forensic.scan_text(testmap.text_pages(spark, sf))


@query
def flag_findings(spark: SparkSession, sf: str) -> DataFrame:
    found = forensic.flag_findings(forensic.scan_text(testmap.text_pages(spark, sf)))
    return found.groupBy("kind", "flag").agg(F.count("*").alias("n"))


# Streams


@query
def stream_contracts_(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the feed written by a batch job, the other half read as a stream into the same table."""
    # Each half would make all pages.
    pages, table = _stored(spark, testmap.feed_pages(spark, sf), "pages"), scratch_dir(spark, "stream-contracts")
    second = F.crc32("source_file") % 2 == 1
    tables.write_contracts(feed.feed_contracts(feed.feed_entries(pages.where(~second)), max_year=MAX_YEAR), table)
    folder = _feed_folder(spark, sf, pages.where(second))
    _drop(pages)
    stream_contracts(spark, folder, table, scratch_dir(spark, "mark"), MAX_YEAR, pattern="*.txt.gz").awaitTermination()
    delete_folder(spark, folder)
    return tables.load_contracts(spark, table)


@query
def stream_radar_(spark: SparkSession, sf: str) -> DataFrame:
    """Radar kept up to date by a stream over the contract table."""
    table, out = scratch_dir(spark, "contracts"), scratch_dir(spark, "stream-radar")
    tables.write_contracts(contracts(spark, sf), table)
    stream_radar(spark, table, out, scratch_dir(spark, "mark")).awaitTermination()
    year = F.col("fiscal_year").cast("int").alias("fiscal_year")
    return spark.read.parquet(out).withColumn("fiscal_year", year).select(*radar.COLUMNS)


@query
def stream_radar_replayed(spark: SparkSession, sf: str) -> DataFrame:
    """The streamed radar after parts and the whole table were written again between its batches."""
    table, out, mark = (scratch_dir(spark, name) for name in ("contracts", "stream-radar", "mark"))
    # Five writes take these rows: they are made once.
    rows = _stored(spark, contracts(spark, sf), "rows")
    second = F.col("file_url").rlike("[13579]$")

    def follow() -> None:
        stream_radar(spark, table, out, mark).awaitTermination()

    tables.write_contracts(rows, table, "append", part="a")
    follow()
    # The part loses half of its rows and a year, then the whole table is replaced and a part of it written twice.
    tables.write_contracts(rows.where(~second & (F.col("fiscal_year") != 2025)), table, "append", part="a")
    tables.write_contracts(rows.where(second), table)
    for _ in range(2):
        tables.write_contracts(rows.where(~second), table, "append", part="b")
    _drop(rows)
    # Nobody else is at this table: what the writes have superseded need not stay.
    drop_superseded(spark, table, older_than_hours=0)
    follow()
    year = F.col("fiscal_year").cast("int").alias("fiscal_year")
    return spark.read.parquet(out).withColumn("fiscal_year", year).select(*radar.COLUMNS)


@query
def contracts_part_rewritten(spark: SparkSession, sf: str) -> DataFrame:
    """A part written again without one of its years, beside a part that stays."""
    path, rows = scratch_dir(spark, "contracts"), contracts(spark, sf)
    second = F.col("file_url").rlike("[13579]$")
    tables.write_contracts(rows.where(~second), path)
    tables.write_contracts(rows.where(second), path, "append", part="late")
    tables.write_contracts(rows.where(second & F.col("fiscal_year").isin(2024, 2026, 2027)), path, "append", part="late")
    tables.write_contracts(rows.where(~second), path, "append", part="again")
    tables.write_contracts(rows.limit(0), path, "append", part="again")
    found = tables.load_contracts(spark, path)
    return found.groupBy("fiscal_year", F.col("file_url").rlike("[13579]$").cast("int").alias("half")).agg(
        F.count("*").alias("n_contracts"), F.countDistinct("file_url").alias("n_urls"), fn.exact_sum(F.col("amount")).cast("double").alias("total"))
