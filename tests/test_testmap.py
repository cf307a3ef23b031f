"""How the audit tables are read from the test tables."""

import re

from tenderlens.plans import catalog, testmap
from tests.test_queries import SF


def test_names_of_buyers_go_through_no_shuffle_of_the_lines(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = testmap.contracts(spark, SF)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert len(shuffled) >= 6
    assert not [s for s in shuffled if re.search(r"\b(buyer|buyer_type|province|region|municipality)#", s)]


def test_the_feed_files_are_packed_and_gone_after_the_load(spark, tmp_path, monkeypatch):
    made = []

    def folder(session, purpose):
        made.append((purpose, tmp_path / f"{purpose}-{len(made)}"))
        return str(made[-1][1])

    monkeypatch.setattr(catalog, "scratch_dir", folder)
    path = catalog._feed_folder(spark, SF)
    names = [p.name for p in (tmp_path / "feed-0").iterdir() if p.name.startswith("part")]
    assert path.endswith("feed-0") and names and all(n.endswith(".txt.gz") for n in names)
    assert catalog.contracts_load(spark, SF).count() > 0
    assert [p.exists() for purpose, p in made[1:] if purpose == "feed"] == [False]


def _plan(spark, rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_lines_that_meet_large_tables_are_not_sorted(spark, monkeypatch):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(testmap, "HASHED_BYTES", 0)
    try:
        rows = testmap.contracts(spark, SF)
        plan, hashed = _plan(spark, rows), sorted(map(str, rows.collect()))
        monkeypatch.undo()
        assert sorted(map(str, testmap.contracts(spark, SF).collect())) == hashed
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("ShuffledHashJoin") == 4 and "Sort" not in plan.replace("SortMergeJoin", "") and "SortMergeJoin" not in plan


def test_text_is_dealt_to_more_tasks_as_tables_grow_and_written_after_the_shuffle(spark, monkeypatch):
    few = testmap.text_pages(spark, SF).rdd.getNumPartitions()
    monkeypatch.setattr(testmap, "TASK_BYTES", 1024)
    assert testmap.dealt(spark, SF, "lineitem", 3) > 40
    assert testmap.text_pages(spark, SF).rdd.getNumPartitions() > few + 40
    plan = _plan(spark, testmap.feed_pages(spark, SF))
    assert plan.index("<entry>") < plan.index("REPARTITION_BY_NUM")
