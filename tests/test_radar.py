from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import Row, functions as F

from tenderlens.operators import radar as rd

SCHEMA = ("supplier string, supplier_key string, buyer string, contract_type string, fiscal_year int, amount double, "
          "award_date date, subject string")


def contracts(spark, rows):
    base = {"supplier": "ACME SL", "supplier_key": "ACME SL", "buyer": "Concello X", "contract_type": "Servicios",
            "fiscal_year": 2024, "award_date": None, "subject": "s"}
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], SCHEMA)


def one(df) -> Row:
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_services_accumulate(spark):
    rows = contracts(spark, [{"amount": 7000.0}, {"amount": 7000.0}])
    r = one(rd.priority_case(rd.radar(rows, ordered=False), rd.radar_amounts(rows)))
    assert (r.is_alert, r.n_contracts, r.total, r.pct_limit, r.risk_index, r.priority) == (True, 2, 14000.0, 93.3, 56, "Media")
    assert "90 %" in r.signals and "repetidos" in r.signals
    assert (r.individual_amounts, r.days_between) == ("7.000,00 € | 7.000,00 €", None)
    assert (r.total_text, r.limit_text, r.pct_text) == ("14.000,00 €", "15.000,00 €", "93,3 %")


def test_below_minimum(spark):
    r = one(rd.radar(contracts(spark, [{"amount": 14000.0}])))
    assert (r.is_alert, r.risk_level, r.risk_index) == (False, "✅ Sin alerta", 53)


def test_unknown_supplier_buyer_or_type_is_left_out(spark):
    rows = [{"amount": 14000.0, "supplier_key": None}, {"amount": 1.0, "buyer": None}, {"amount": 1.0, "contract_type": None},
            {"amount": 1.0, "fiscal_year": None}, {"amount": None}]
    assert rd.radar(contracts(spark, rows)).count() == 0


def test_works_have_their_own_threshold(spark):
    r = one(rd.radar(contracts(spark, [{"amount": 20000.0, "contract_type": "Obras"}] * 2)))
    assert (r.is_alert, r.risk_level, r.pct_limit, r.risk_index) == (True, "🚨 Acumulado > límite legal", 100.0, 68)


def test_burst_near_the_threshold(spark):
    rows = [{"amount": 14900.0, "award_date": date(2024, 1, 10)}, {"amount": 14500.0, "award_date": date(2024, 1, 28)},]
    r = one(rd.radar(contracts(spark, rows)))
    assert (r.days_between, r.pct_limit, r.risk_index, r.priority) == (18, 196.0, 91, "Alta")
    assert "pegado al umbral" in r.signals and "concentrados en 18 días" in r.signals


def test_concessions_keep_the_low_threshold_unless_strict(spark):
    rows = contracts(spark, [{"amount": 7000.0, "contract_type": "Concesión de obras"}] * 2)
    r = one(rd.radar(rows))
    assert (r.is_alert, r.limit_amount, r.risk_level) == (True, 40000.0, "🟠 Cerca del límite (>90%)")
    assert one(rd.radar(rows, strict_works=True)).is_alert is False


def test_rounded_and_raw_share(spark):
    r = one(rd.radar(contracts(spark, [{"amount": 7497.0}, {"amount": 7497.01}])))
    assert r.pct_limit == 100.0 and r.risk_level.startswith("🔴") and "superior" in r.signals


def test_one_missing_date_and_recurrent_supplier(spark):
    rows = [{"amount": 1.0 + i, "award_date": date(2024, 1, 1 + i)} for i in range(4)] + [{"amount": 9.0}]
    r = one(rd.radar(contracts(spark, rows)))
    assert r.days_between == 3 and "proveedor recurrente (5 contratos)" in r.signals


def test_amounts_have_one_notation_at_any_size(spark):
    for n in (30, 12_000):
        rows = contracts(spark, [{"amount": 20.0}]).union(contracts(spark, [{"amount": 10.0}]).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("r"))
        amounts = rd.radar_amounts(rows)
        assert sorted((r.amount, r.n) for r in amounts.collect()) == [(10.0, n), (20.0, 1)]
        shown = one(rd.with_amount_text(rd.radar(rows, ordered=False), amounts))
        assert shown.n_contracts == n + 1 and shown.individual_amounts == " | ".join(["20,00 €"] + ["10,00 €"] * n)


def test_no_list_per_group_in_the_radar(spark):
    rows = random_contracts(spark, 50)
    table = rd.radar(rows, ordered=False)
    for frame in (table, rd.priority_case(table), rd.priority_alerts(table), rd.report_alert_table_short(table), rd.radar_summary(table)):
        assert "collect_list" not in frame._jdf.queryExecution().toString()


def test_impossible_amounts_do_not_stop_the_radar(spark):
    rows = contracts(spark, [{"amount": 7000.0}, {"amount": 1e25}, {"amount": float("nan")}, {"amount": float("inf")}])
    r = one(rd.radar(rows))
    assert (r.n_contracts, r.total) == (3, 7000.0)  # NaN is no amount; the others count, but no total can hold them


def test_a_hot_case_is_split(spark):
    rows = random_contracts(spark, 200_000).withColumn("subject", F.sha2(F.col("amount").cast("string"), 512))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
                                           "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keep, ("1m", "512k", "-1", "1.5", "16")):
            spark.conf.set(k, v)
        detail = rd.case_detail(rows, rd.radar(rows, ordered=False).where("supplier IS NOT NULL"))
        assert detail.count() == 200_000
        joined = detail.agg(F.sum(F.length("subject")))
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_text_dates_are_read(spark):
    rows = contracts(spark, [{"amount": 1.0}, {"amount": 2.0}]).drop("award_date").withColumn(
        "award_date", F.when(F.col("amount") == 1, "2024-01-28").otherwise("30/01/2024"))
    assert one(rd.radar(rows)).days_between == 2
    assert one(rd.radar(rows.drop("award_date"))).days_between is None


def random_contracts(spark, n=3000):
    kind = F.element_at(F.array(F.lit("Obras"), F.lit("Servicios"), F.lit("Concesión de obras")), (F.col("id") % 3 + 1).cast("int"))
    hot = F.col("id") % 3 == 0  # one group holds a third of the rows
    return spark.range(n).select(
        F.when(hot, "HOT").otherwise(F.concat(F.lit("S"), F.col("id") % 50)).alias("supplier_key"),
        F.when(hot, "B").otherwise(F.concat(F.lit("B"), F.col("id") % 7)).alias("buyer"),
        F.when(hot, "Servicios").otherwise(kind).alias("contract_type"),
        F.when(hot, 2024).otherwise((2020 + F.col("id") % 4).cast("int")).cast("int").alias("fiscal_year"),
        (F.col("id") * 7919 % 4000000 / 100).alias("amount"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")).alias("award_date"),
        F.lit("s").alias("subject"), F.lit("s").alias("supplier"),
    )


def test_radar_matches_brute_force_and_does_not_depend_on_partitions(spark):
    rows = random_contracts(spark)
    groups = defaultdict(list)
    for r in rows.collect():
        groups[(r.supplier_key, r.buyer, r.contract_type, r.fiscal_year)].append(r)
    first = rd.radar(rows).collect()
    assert first == rd.radar(rows.repartition(17)).collect()
    assert len(first) == len(groups)
    shown = rd.with_amount_text(rd.radar(rows, ordered=False), rd.radar_amounts(rows))
    texts = {(r.supplier, r.buyer, r.contract_type, r.fiscal_year): r.individual_amounts for r in shown.collect()}
    for g in first:
        members = groups[(g.supplier, g.buyer, g.contract_type, g.fiscal_year)]
        amounts = [m.amount for m in members]
        assert g.n_contracts == len(members)
        assert g.total == pytest.approx(sum(amounts))
        assert texts[g.supplier, g.buyer, g.contract_type, g.fiscal_year].count("€") == len(members)
        assert ("repetidos" in g.signals) == (len(set(amounts)) < len(amounts))
        low, high = (39000, 40000) if g.contract_type == "Obras" else (14000, 15000)
        assert ("pegado" in g.signals) == any(low <= a <= high for a in amounts)
    assert [r.risk_index for r in first] == sorted((r.risk_index for r in first), reverse=True)


def test_priority_and_reports(spark):
    rows = random_contracts(spark)
    table = rd.radar(rows, ordered=False)
    alerts = [r for r in rd.radar(rows).collect() if r.is_alert]
    assert one(rd.priority_case(table)) == alerts[0]
    assert [r.supplier for r in rd.priority_alerts(table, 5).collect()] == [r.supplier for r in alerts[:5]]
    quiet = rd.radar(rows, min_contracts=10_000, ordered=False)
    assert rd.priority_alerts(quiet, 5).count() == 5 and rd.priority_case(quiet).count() == 0
    summary = one(rd.report_summary(rows, table))
    assert (summary.n_contracts, summary.n_groups, summary.n_alerts) == (3000, table.count(), len(alerts))
    assert one(rd.radar_summary(table)).n_groups == table.count()
    assert rd.report_alert_table(table, rd.radar_amounts(rows)).count() == len(alerts)


def test_treemap_bounds_the_share(spark):
    table = spark.createDataFrame(
        [("a", "b", "c", 2024, 10.0, 1, "x", "t", "p", float("inf")), ("d", "b", "c", 2024, 30.0, 1, "x", "t", "p", -5.0),
         ("e", "b", "c", 2024, 60.0, 1, "x", "t", "p", 300.0)],
        "supplier string, buyer string, contract_type string, fiscal_year int, total double, n_contracts long, "
        "risk_level string, total_text string, pct_text string, pct_limit double")
    got = {r.supplier: (r.pct, r.pct_clipped, r.share) for r in rd.treemap_suppliers(table).collect()}
    assert got == {"a": (0.0, 0.0, 0.1), "d": (-5.0, 0.0, 0.3), "e": (300.0, 120.0, 0.6)}


def test_case_detail_orders_by_date(spark):
    rows = contracts(spark, [
        {"amount": 7000.0, "award_date": date(2024, 3, 1)}, {"amount": 7500.0, "award_date": date(2024, 1, 1)},
        {"amount": 7600.0}, {"amount": 1.0, "buyer": "Other"}])
    detail = rd.case_detail(rows, rd.radar(rows).where("is_alert")).collect()
    assert [r.amount for r in detail] == [7500.0, 7000.0, 7600.0]


def test_alert_amounts_as_rows(spark):
    rows = random_contracts(spark)
    table, amounts = rd.radar(rows, ordered=False), rd.radar_amounts(rows)
    got = rd.report_alert_amounts(table, amounts)
    found = [tuple(r) for r in got.collect()]
    text = {}
    for r in found:
        text.setdefault(r[:4], []).extend([r[7]] * r[8])
    want = {(r.supplier, r.buyer, r.contract_type, r.fiscal_year): r.individual_amounts for r in rd.report_alert_table(table, amounts).collect()}
    assert {k: len(v) for k, v in text.items()} == {k: len(v.split(" | ")) for k, v in want.items()}
    order = [(r.supplier, r.buyer, r.contract_type, r.fiscal_year) for r in rd.report_alert_table(table, amounts).collect()]
    assert list(text) == order and all(v == sorted(v, reverse=True) for v in text.values())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


def test_a_hot_alert_is_split(spark):
    """Amounts of one group that are most rows are joined by many tasks, as both sides are plain shuffles."""
    rows = random_contracts(spark, 200_000).withColumn("amount", F.col("amount") + F.rand(1) * 1000)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
                                           "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keep, ("256k", "128k", "-1", "1.5", "16")):
            spark.conf.set(k, v)
        got = rd.report_alert_amounts(rd.radar(rows, ordered=False), rd.radar_amounts(rows)).drop("risk_level")
        assert sum(r.supplier == "HOT" for r in got.collect()) > 1000
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
