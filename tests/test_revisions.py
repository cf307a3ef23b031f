"""Newest revisions, whatever the order in which they come."""

import random
from datetime import datetime

from tenderlens.operators import radar
from tenderlens.sources import parts, tables
from tenderlens.sources.revisions import REVISIONS, latest_revisions, load_revisions, upsert_revisions
from tenderlens.streaming import stream_contracts, stream_radar
from tests.test_feed import SIMPLE
from tests.test_tables import write_page

DAY = [None, *(datetime(2024, 1, d) for d in range(1, 6))]


def revision(entry, updated, amount, subject="s", year=2024):
    return ("b", "t", "p", "r", "m", "Servicios", subject, None, "x", "x", None, year, float(amount), None, entry, updated)


def plain(rows):
    best = {}
    for r in rows:
        key = (r[14], None if r[14] is not None else r)
        rank = (r[15] is not None, r[15] or datetime.min, r[6], r[11], r[12])  # the columns that differ here, in their order
        if key not in best or rank > best[key][0]:
            best[key] = (rank, r)
    return sorted((r for _, r in best.values()), key=str)


def held(spark, table):
    return sorted((tuple(r) for r in load_revisions(spark, table).collect()), key=str)


def test_any_order_gives_one_table(spark, tmp_path):
    rng = random.Random(7)
    rows = [revision(rng.choice(["a", "b", "c", "d", None]), rng.choice(DAY), rng.randrange(3), rng.choice("st"), rng.choice([2023, 2024]))
            for _ in range(40)]
    assert sorted((tuple(r) for r in latest_revisions(spark.createDataFrame(rows, REVISIONS)).collect()), key=str) == plain(rows)
    for k in range(2):
        table = str(tmp_path / f"t{k}")
        rng.shuffle(rows)
        for i in range(0, 40, 20):
            upsert_revisions(spark.createDataFrame(rows[i:i + 20], REVISIONS), table)
        assert held(spark, table) == plain(rows)
        # Replays and late revisions change nothing, not even a file.
        assert upsert_revisions(spark.createDataFrame(rows[:15], REVISIONS), table) == []
        assert upsert_revisions(spark.createDataFrame([], REVISIONS), table) == []
    newer = revision("a", datetime(2025, 1, 1), 9)
    assert len(upsert_revisions(spark.createDataFrame([newer], REVISIONS), table)) == 1
    assert held(spark, table) == plain([*rows, newer])
    parts.drop_superseded(spark, table, older_than_hours=0)
    assert held(spark, table) == plain([*rows, newer]) and tables.load_contracts(spark, table).count() == len(plain([*rows, newer]))


def test_streamed_corrections_reach_the_radar(spark, tmp_path):
    """A correction takes its first edition's place in the table and in the streamed radar; by default both count."""
    named = SIMPLE.replace("<title>", "<id>urn:e1</id><updated>2022-03-06T00:00:00Z</updated><title>", 1)
    assert "urn:e1" in named
    later = named.replace("2022-03-06T", "2022-04-06T").replace("2022-03-05", "2021-02-01")
    feed, table, out = tmp_path / "feed", str(tmp_path / "t"), str(tmp_path / "radar")

    def run():
        stream_contracts(spark, str(feed), table, str(tmp_path / "m1"), max_year=2027, revisions=True).awaitTermination()
        stream_radar(spark, table, out, str(tmp_path / "m2")).awaitTermination()
        got = spark.read.parquet(out)
        assert got.count() == radar.radar(tables.load_contracts(spark, table), ordered=False).count()
        return [(r.fiscal_year, r.n_contracts) for r in got.collect()]

    write_page(feed, "1.atom", named)
    assert run() == [(2022, 1)]
    write_page(feed, "2.atom", later)
    assert run() == [(2021, 1)]
    write_page(feed, "0-late.atom", named)
    assert run() == [(2021, 1)]
    stream_contracts(spark, str(feed), str(tmp_path / "all"), str(tmp_path / "m3"), max_year=2027).awaitTermination()
    assert tables.load_contracts(spark, str(tmp_path / "all")).count() == 3
