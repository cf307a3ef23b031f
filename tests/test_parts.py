"""Parts that are replaced as a whole, and the radar that follows them."""

import os

import pytest
from pyspark.sql import functions as F

from tenderlens.operators import radar
from tenderlens.plans import testmap
from tenderlens.sources import parts, tables
from tenderlens.streaming import stream_contracts, stream_radar
from tests.test_feed import GIJON, SIMPLE
from tests.test_tables import write_page

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    """Some groups of three years, with repeated amounts."""
    found = testmap.contracts(spark, SF).where(
        "supplier_key IS NOT NULL AND contract_type IS NOT NULL AND fiscal_year IN (2024, 2025, 2026)").orderBy(F.xxhash64("file_url")).limit(60)
    return spark.createDataFrame(found.collect(), found.schema).cache()


def texts(df):
    return sorted(str(r) for r in df.collect())


def test_a_part_is_replaced_in_all_its_years(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    other = rows.where("fiscal_year = 2024").limit(3)
    tables.write_contracts(other, table)
    tables.write_contracts(rows, table, "append", part="p/0 é")
    fewer = rows.where("fiscal_year <> 2025")
    assert 0 < fewer.count() < rows.count()
    tables.write_contracts(fewer, table, "append", part="p/0 é")
    assert texts(tables.load_contracts(spark, table)) == texts(fewer.unionByName(other))
    tables.write_contracts(rows.limit(0), table, "append", part="p/0 é")
    assert texts(tables.load_contracts(spark, table)) == texts(other)
    tables.write_contracts(fewer, table)
    assert texts(tables.load_contracts(spark, table)) == texts(fewer)


def test_a_reader_sees_old_or_new(spark, rows, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    tables.write_contracts(rows, table, "append", part="p")
    before = tables.load_contracts(spark, table)
    fewer = rows.where("fiscal_year = 2026")
    seen, commit = [], parts.commit

    def watched(*args):
        # All files are written, the row that makes them count is not.
        seen.append(texts(tables.load_contracts(spark, table)))
        commit(*args)

    monkeypatch.setattr(parts, "commit", watched)
    tables.write_contracts(fewer, table, "append", part="p")
    assert seen == [texts(rows)]
    assert texts(before) == texts(rows)  # a frame made before the write keeps what it saw
    assert texts(tables.load_contracts(spark, table)) == texts(fewer)


def test_a_failed_write_leaves_nothing(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    tables.write_contracts(rows, table, "append", part="p")
    broken = rows.withColumn("subject", F.when(F.col("fiscal_year") == 2026, F.raise_error(F.lit("lost"))).otherwise(F.col("subject")))
    with pytest.raises(Exception, match="lost"):
        tables.write_contracts(broken, table, "append", part="p")
    assert texts(tables.load_contracts(spark, table)) == texts(rows)


def test_superseded_versions_go_after_a_while(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    for keep in (rows, rows.where("fiscal_year = 2024"), rows.where("fiscal_year = 2025")):
        tables.write_contracts(keep, table, "append", part="p")
    versions = lambda: len(os.listdir(f"{table}/part=p"))
    assert parts.drop_superseded(spark, table) == [] and versions() == 3
    assert len(parts.drop_superseded(spark, table, older_than_hours=0)) == 2 and versions() == 1
    assert texts(tables.load_contracts(spark, table)) == texts(rows.where("fiscal_year = 2025"))


def test_folders_without_registry(spark, rows, tmp_path):
    rows.write.partitionBy("fiscal_year").parquet(str(tmp_path / "old"))
    assert texts(tables.load_contracts(spark, str(tmp_path / "old"))) == texts(rows)


def test_a_stream_batch_with_fewer_years(spark, tmp_path):
    """The same batch, done again with another range of years, leaves no rows of the first time."""
    write_page(tmp_path / "feed", "1.atom", SIMPLE, GIJON)
    for year, mark in ((2027, "m1"), (2024, "m1")):
        stream_contracts(spark, str(tmp_path / "feed"), str(tmp_path / "t"), str(tmp_path / mark), max_year=year).awaitTermination()
        found = sorted(r.fiscal_year or 0 for r in tables.load_contracts(spark, str(tmp_path / "t")).collect())
        assert found == ([2022, 2025] if year == 2027 else [0, 2022])
        # As after a failure between the batch and its mark.
        for name in os.listdir(tmp_path / mark / "commits"):
            os.remove(tmp_path / mark / "commits" / name)


class Followed:
    def __init__(self, spark, place):
        self.spark, self.place, self.table, self.out = spark, place, str(place / "t"), str(place / "radar")

    def matches(self):
        """The streamed radar after a run equals the batch radar of the table."""
        stream_radar(self.spark, self.table, self.out, str(self.place / "m")).awaitTermination()
        got = texts(self.spark.read.parquet(self.out).withColumn("fiscal_year", F.col("fiscal_year").cast("int")).select(*radar.COLUMNS))
        return got == texts(radar.radar(tables.load_contracts(self.spark, self.table), ordered=False).select(*radar.COLUMNS)) and bool(got)


def test_the_radar_follows_rewritten_parts(spark, rows, tmp_path):
    at = Followed(spark, tmp_path)
    tables.write_contracts(rows, at.table, "append", part="p")
    assert at.matches()
    tables.write_contracts(rows, at.table, "append", part="p")  # the same rows again: nothing is counted twice
    assert at.matches()
    tables.write_contracts(rows.where("fiscal_year <> 2025 AND amount > 500"), at.table, "append", part="p")  # a year goes
    assert at.matches()
    assert not any(name.endswith(".parquet") for _, _, names in os.walk(f"{at.out}/fiscal_year=2025") for name in names)


def test_the_radar_follows_a_rewritten_table(spark, rows, tmp_path):
    at = Followed(spark, tmp_path)
    tables.write_contracts(rows, at.table)
    tables.write_contracts(rows.where("fiscal_year = 2024"), at.table, "append", part="p")
    assert at.matches()
    # Several commits within one batch, of which only the last two count; what they superseded is deleted before it is read.
    tables.write_contracts(rows.where("fiscal_year = 2026"), at.table, "append", part="p")
    tables.write_contracts(rows.where("fiscal_year <> 2026"), at.table)
    tables.write_contracts(rows.where("fiscal_year = 2026").limit(2), at.table, "append", part="p")
    parts.drop_superseded(spark, at.table, older_than_hours=0)
    assert at.matches()


def test_a_broken_off_batch_is_done_again(spark, rows, tmp_path, monkeypatch):
    at = Followed(spark, tmp_path)
    tables.write_contracts(rows, at.table, "append", part="p")
    assert at.matches()
    tables.write_contracts(rows.where("amount > 700"), at.table, "append", part="p")
    with monkeypatch.context() as m:
        # Increments and radar are written; recording them fails.
        m.setattr("tenderlens.streaming.jobs.TAKEN", "version int")
        with pytest.raises(Exception):
            at.matches()
    tables.write_contracts(rows.where("amount > 900"), at.table, "append", part="p")
    assert at.matches()


def test_runs_of_increments_are_merged(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr("tenderlens.streaming.jobs.MERGED", 2)
    at = Followed(spark, tmp_path)
    runs = lambda: {d for _, dirs, _ in os.walk(f"{at.out}-amounts") for d in dirs if d.startswith("run=")}
    for k in range(5):
        tables.write_contracts(rows.where(F.pmod(F.hash("subject", "amount"), F.lit(5)) == k), at.table, "append", part=f"p{k}")
        assert at.matches() and len(runs()) <= 2
    # A version within a merged run is superseded, a part is emptied, and a new one comes.
    tables.write_contracts(rows.where("amount > 700").limit(3), at.table, "append", part="p1")
    assert at.matches()
    tables.write_contracts(rows.limit(0), at.table, "append", part="p0")
    tables.write_contracts(rows.where("fiscal_year = 2024"), at.table, "append", part="p9")
    assert at.matches() and len(runs()) <= 3
    tables.write_contracts(rows.where("fiscal_year = 2026"), at.table)  # nothing of the old runs stays
    assert at.matches() and len(runs()) == 1


def test_a_merge_that_breaks_off_counts_nothing_twice(spark, rows, tmp_path, monkeypatch):
    from tenderlens.streaming import jobs

    monkeypatch.setattr(jobs, "MERGED", 2)
    at = Followed(spark, tmp_path)
    tables.write_contracts(rows, at.table, "append", part="p")
    assert at.matches()
    tables.write_contracts(rows.where("amount > 700"), at.table, "append", part="q")
    record, calls = jobs._record, []

    def fail_second(*args):
        calls.append(args)
        if len(calls) == 2:  # the merged run is written, but not recorded
            raise RuntimeError("lost")
        record(*args)

    with monkeypatch.context() as m:
        m.setattr(jobs, "_record", fail_second)
        with pytest.raises(Exception, match="lost"):
            at.matches()
    tables.write_contracts(rows.where("amount > 900"), at.table, "append", part="r")
    assert at.matches()
