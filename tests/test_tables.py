import json
import os
import re

from pyspark.sql import functions as F

from tenderlens import schema
from tenderlens.operators import radar
from tenderlens.operators.filters import ContractFilter, query_contracts
from tenderlens.plans import testmap
from tenderlens.session import CLEANUP
from tenderlens.sources import tables
from tenderlens.streaming import stream_contracts, stream_radar
from tests.test_feed import GIJON, SIMPLE, page

SF = "/root/testdata/sf0.001"


def write_page(folder, name, *entries):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(page(*entries), encoding="utf-8")


def test_parquet_round_trip_prunes_years(spark, tmp_path):
    rows = testmap.contracts(spark, SF)
    tables.write_contracts(rows, str(tmp_path / "t"))
    back = tables.load_contracts(spark, str(tmp_path / "t"))
    assert back.columns == schema.CONTRACTS.fieldNames()
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    plan = back.where("fiscal_year = 2024")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fiscal_year" in plan
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    chosen = query_contracts(back, ContractFilter(years=(2021, 2022), contract_types=("Obras",), amount_min=500))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[fiscal_year#\d+ IN \(2021,2022\)", plan)
    assert "EqualTo(contract_type,Obras)" in plan or "In(contract_type, [Obras])" in plan
    assert "GreaterThanOrEqual(amount,500.0)" in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_two_questions_to_one_cache(spark, tmp_path):
    write_page(tmp_path / "feed", "1.atom", SIMPLE, GIJON)
    ask = lambda **kw: sorted(r.fiscal_year or 0 for r in tables.ingest_or_reuse(spark, str(tmp_path / "feed"), str(tmp_path / "c"), **kw).collect())
    assert ask(max_year=2024) == [0, 2022] and ask(max_year=2027) == [2022, 2025] and ask(max_year=2024) == [0, 2022]
    assert ask(max_year=2027, limit=3000) == [2025] and ask(max_year=2027, min_year=2023) == [0, 2025]


def test_batch_and_stream_fill_one_table(spark, tmp_path):
    table = str(tmp_path / "table")
    rows = testmap.contracts(spark, SF).limit(7)
    tables.write_contracts(rows, table)
    tables.write_contracts(rows, table, "append")
    write_page(tmp_path / "feed", "1.atom", SIMPLE)
    stream = lambda mark: stream_contracts(spark, str(tmp_path / "feed"), table, str(tmp_path / mark), max_year=2027).awaitTermination()
    stream("m1")
    assert tables.load_contracts(spark, table).count() == 15
    stream("m1")
    assert tables.load_contracts(spark, table).count() == 15
    # A batch that is written again replaces itself.
    for _ in range(2):
        tables.write_contracts(rows, table, "append", part="stream-x-0")
    assert tables.load_contracts(spark, table).count() == 22
    tables.write_contracts(rows, table)
    assert tables.load_contracts(spark, table).count() == 7


def test_ingest_is_reused_until_the_folder_changes(spark, tmp_path):
    folder, cache = tmp_path / "feed", str(tmp_path / "cache")
    write_page(folder, "1.atom", SIMPLE)
    assert tables.ingest_or_reuse(spark, str(folder), cache).count() == 1
    before = tables.folder_signature(spark, str(folder))
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "cache").rglob("*.parquet")}
    assert tables.ingest_or_reuse(spark, str(folder), cache).count() == 1
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "cache").rglob("*.parquet")} == files
    write_page(folder, "2.xml", GIJON, SIMPLE)
    assert tables.folder_signature(spark, str(folder)) != before
    assert tables.ingest_or_reuse(spark, str(folder), cache).count() == 3
    assert tables.ingest_or_reuse(spark, str(folder), cache, force=True).count() == 3


def test_budget_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("cdcta,idente,tipreig,importer,imported,importel,more\n0221,1,G,120000,130000,118000,z\n")
    (tmp_path / "i.csv").write_text("idente,nombreente,codbdgel\n1,Concello,01059\n")
    lines, entities = tables.read_budget(spark, str(tmp_path / "e.csv"), str(tmp_path / "i.csv"))
    assert tuple(lines.first()) == ("1", "G", "0221", "120000", "130000", "118000")
    assert entities.first().codbdgel == "01059"
    tables.register_budget_views(lines, entities)
    (tmp_path / "q.csv").write_text('idente,nombreente,codbdgel\n1,"Consorcio ""Sur"", zona 1",15001\n2,"Dos\nlíneas",27001\n')
    quoted = tables.read_budget(spark, str(tmp_path / "e.csv"), str(tmp_path / "q.csv"))[1]
    assert sorted(map(tuple, quoted.collect())) == [("1", 'Consorcio "Sur", zona 1', "15001"), ("2", "Dos\nlíneas", "27001")]
    assert spark.sql("SELECT count(*) FROM econ JOIN inv USING (idente)").first()[0] == 1


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({
        "fecha_utc": "t", "fuente": "f", "destino": "d", "urls_visitadas": ["a", "b"], "ultimo_url": "b",
        "descargados": [], "omitidos": [], "extraidos": [], "errores": ["e"]}, indent=2))
    (tmp_path / "failed.json").write_text(json.dumps({"fecha_utc": "u", "fuente": "f", "urls_visitadas": [], "errores": ["e", "g"]}))
    failed = tables.manifest_source(tables.read_manifests(spark, f"{tmp_path}/failed.json")).collect()
    assert [(r.fetched_at, r.visit, r.url, r.n_errors) for r in failed] == [("u", None, None, 2)]
    rows = tables.manifest_source(tables.read_manifests(spark, f"{tmp_path}/m.json")).orderBy("visit").collect()
    assert [(r.visit, r.url, r.is_last, r.n_errors) for r in rows] == [(0, "a", False, 1), (1, "b", True, 1)]


def test_exports(spark, tmp_path):
    rows = testmap.contracts(spark, SF)
    audit = tables.export_tables(radar.radar(rows, ordered=False), rows)
    assert list(audit) == ["01_alertas", "02_radar_completo", "03_top_adjudicatarios", "04_relaciones_organo_adjudicatario",
                           "05_contratos_filtrados"]
    tables.write_csv(audit, str(tmp_path))
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/05_contratos_filtrados")
    assert back.count() == rows.count() and back.columns == rows.columns


def test_streams_equal_batch(spark, tmp_path):
    folder, table, out = tmp_path / "feed", str(tmp_path / "table"), str(tmp_path / "radar")

    def run():
        stream_contracts(spark, str(folder), table, str(tmp_path / "m1"), max_year=2027).awaitTermination()
        stream_radar(spark, table, out, str(tmp_path / "m2")).awaitTermination()
        return spark.read.parquet(out).select(*radar.COLUMNS)

    write_page(folder, "1.atom", SIMPLE, GIJON)
    assert [(r.supplier, r.n_contracts) for r in run().collect()] == [("NORTE & SUR SA", 1)]
    write_page(folder, "2.atom", SIMPLE, SIMPLE.replace("2022-03-05", "2021-01-10"))
    got = run()
    batch = radar.radar(tables.load_contracts(spark, table))
    key = F.struct(*radar.COLUMNS).cast("string").alias("k")
    assert sorted(r.k for r in got.select(key).collect()) == sorted(r.k for r in batch.select(key).collect())
    assert {(r.fiscal_year, r.n_contracts) for r in got.collect()} == {(2022, 2), (2021, 1)}


def test_a_batch_rewrites_only_what_it_touches(spark, tmp_path):
    table, out = str(tmp_path / "table"), str(tmp_path / "radar")

    def run():
        stream_radar(spark, table, out, str(tmp_path / "m")).awaitTermination()
        return {f: f.stat().st_mtime_ns for f in (tmp_path / "radar").rglob("*.parquet")}

    rows = testmap.contracts(spark, SF).where("supplier_key IS NOT NULL AND contract_type IS NOT NULL AND fiscal_year IS NOT NULL")
    tables.write_contracts(rows, table)
    before = run()
    news = rows.orderBy("file_url").limit(1)
    tables.write_contracts(news, table, "append")
    after = run()
    gone = set(before) - set(after)
    assert len(gone) == 1 and {f.parent for f in set(after) - set(before)} == {f.parent for f in gone}
    key = F.struct(*radar.COLUMNS).cast("string").alias("k")
    whole = radar.radar(tables.load_contracts(spark, table), ordered=False).select(key)
    assert sorted(r.k for r in spark.read.parquet(out).select(key).collect()) == sorted(r.k for r in whole.collect())


def test_a_write_leaves_nothing_of_its_shuffles(spark, tmp_path):
    folders = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString())

    def shuffled():
        return {os.path.join(at, f) for d in folders for at, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}

    rows = contracts_of(spark, 2000)
    before, setting = shuffled(), spark.conf.get(CLEANUP, None)
    tables.write_contracts(rows.repartition(3), str(tmp_path / "t"))
    tables.write_csv({"a": rows.repartition(3)}, str(tmp_path / "csv"), compression="gzip")
    assert shuffled() <= before
    assert spark.conf.get(CLEANUP, None) == setting and tables.load_contracts(spark, str(tmp_path / "t")).count() == 2000
    names = [f for f in os.listdir(tmp_path / "csv/a") if f.startswith("part-")]
    assert names and all(f.endswith(".csv.gz") for f in names)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv/a"))
    assert back.count() == 2000 and back.columns == rows.columns


def contracts_of(spark, n):
    made = spark.range(n)
    values = {"amount": F.col("id") / 7, "fiscal_year": (2020 + F.col("id") % 3).cast("int"), "buyer": F.concat(F.lit('B "'), F.col("id").cast("string"))}
    return made.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.CONTRACTS])
