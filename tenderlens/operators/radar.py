"""The contract-splitting radar: group awards, score the groups, say why.

A group is (supplier, buyer, contract type, fiscal year). One group may hold a large share of all rows, so
rows are first folded by group and amount; repeats, near-limit amounts and totals then come from the folded
rows, again by sums, counts and flags that fold before their shuffle. The amounts themselves are a table of
their own, ``radar_amounts``; as text they are put together for the groups that are shown, and for no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderlens.functions import exact_sum, format_euros, format_pct, legal_limit, parse_mixed_dates
from tenderlens.refdata import (
    ALERT_SERVICES,
    ALERT_SHARE,
    ALERT_WORKS,
    RISK_GRAZES,
    RISK_NEAR,
    RISK_NONE,
    RISK_OVER,
    WORKS,
)
from tenderlens.schema import GROUP_KEYS

COLUMNS = (
    *GROUP_KEYS, "total", "n_contracts", "first_date", "last_date", "is_alert", "limit_amount", "pct_limit",
    "risk_level", "days_between", "signals", "risk_index", "priority", "pct_text", "total_text",
    "limit_text",
)


def folded_amounts(contracts: DataFrame, *also: str) -> DataFrame:
    """One row per group and amount (and value of the columns in ``also``): how often, their exact total, first and last date."""
    date = F.col("award_date") if "award_date" in contracts.columns else F.lit(None).cast("date")
    if dict(contracts.dtypes).get("award_date") == "string":
        date = parse_mixed_dates(date)
    rows = contracts.select(
        F.col("supplier_key").alias("supplier"), "buyer", "contract_type", "fiscal_year",
        F.col("amount").cast("double").alias("amount"), date.alias("award_date"), *also,
    ).dropna(subset=[*GROUP_KEYS, "amount"])
    return rows.groupBy(*GROUP_KEYS, "amount", *also).agg(
        F.count("*").alias("n"),
        exact_sum(F.col("amount")).alias("total"),
        F.min("award_date").alias("first_date"),
        F.max("award_date").alias("last_date"),
    )


def radar_amounts(contracts: DataFrame) -> DataFrame:
    """The amounts of every group with their number of contracts, as a table."""
    return folded_amounts(contracts).select(*GROUP_KEYS, "amount", "n")


def refold(increments: DataFrame) -> DataFrame:
    """Rows of several ``folded_amounts`` as one."""
    return increments.groupBy(*GROUP_KEYS, "amount").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )


def groups_of(folded: DataFrame) -> DataFrame:
    """Totals, dates and flags per group, from ``folded_amounts``."""
    near = F.when(F.col("contract_type") == WORKS, F.col("amount").between(39_000, 40_000)).otherwise(
        F.col("amount").between(14_000, 15_000)
    )
    return folded.groupBy(*GROUP_KEYS).agg(
        F.sum("total").cast("double").alias("total"),
        F.sum("n").alias("n_contracts"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.bool_or(near).alias("has_near_limit"),
        (F.max("n") > 1).alias("has_repeats"),
    )


def radar_groups(contracts: DataFrame) -> DataFrame:
    """Totals, dates and flags per group."""
    return groups_of(folded_amounts(contracts))


def with_amount_text(shown: DataFrame, amounts: DataFrame) -> DataFrame:
    """The groups that are shown with all their amounts as text, largest first, from ``radar_amounts``.

    Only their amounts are gathered; the text of a group is as long as its contracts are many.
    """
    keys = shown.select(*GROUP_KEYS).hint("rebalance")
    each = F.flatten(F.transform("a", lambda a: F.array_repeat(format_euros(a["amount"]), a["n"].cast("int"))))
    texts = (
        amounts.join(keys, list(GROUP_KEYS), "left_semi").groupBy(*GROUP_KEYS)
        .agg(F.sort_array(F.collect_list(F.struct("amount", "n")), asc=False).alias("a"))
        .select(*GROUP_KEYS, F.array_join(each, " | ").alias("individual_amounts"))
    )
    return shown.join(texts, list(GROUP_KEYS), "left")


def with_alerts(groups: DataFrame, min_contracts: int = 2, strict_works: bool = False) -> DataFrame:
    """Alert, limit, share of the limit and risk level.

    The alert threshold of works holds for the type "Obras" alone, while the limit holds for every type that
    names works; ``strict_works`` makes the threshold follow the limit.
    """
    limit = legal_limit(F.col("contract_type"))
    own = F.when(F.col("contract_type") == WORKS, ALERT_WORKS).otherwise(ALERT_SERVICES)
    threshold = limit * ALERT_SHARE if strict_works else own
    ratio = F.col("total") / F.col("limit_amount")
    level = (
        F.when(~F.col("is_alert"), RISK_NONE)
        .when(ratio >= 1.0, RISK_OVER)
        .when(ratio >= 0.95, RISK_GRAZES)
        .otherwise(RISK_NEAR)
    )
    return groups.withColumns({
        "is_alert": (F.col("n_contracts") >= min_contracts) & (F.col("total") >= threshold),
        "limit_amount": limit,
    }).withColumns({
        "pct_limit": F.rint(F.col("total") / F.col("limit_amount") * 100 * 10) / 10,
        "risk_level": level,
    })


def _signals() -> Column:
    pct, n, days = F.col("pct_limit"), F.col("n_contracts"), F.col("days_between")
    share = (
        F.when(pct >= 100, "acumulado superior al límite legal")
        .when(pct >= 95, "acumulado por encima del 95 % del límite")
        .when(pct >= 90, "acumulado por encima del 90 % del límite")
    )
    recurrent = F.when(n >= 4, F.concat(F.lit("proveedor recurrente ("), n, F.lit(" contratos)"))).when(
        n >= 2, "varios contratos al mismo proveedor"
    )
    near = F.when(F.col("has_near_limit"), "importe individual pegado al umbral")
    repeats = F.when(F.col("has_repeats"), "importes repetidos exactamente")
    burst = F.when(F.col("is_burst"), F.concat(F.lit("contratos concentrados en "), days, F.lit(" días")))
    text = F.concat_ws(" · ", share, recurrent, near, repeats, burst)
    return F.when(text == "", "Sin señales adicionales").otherwise(text)


def _index() -> Column:
    p, n = F.col("pct_limit") / 100, F.col("n_contracts")
    points = F.least(F.lit(45.0), p * 35)
    points += F.when(p >= 1.0, 20).when(p >= 0.95, 15).when(p >= 0.90, 10).otherwise(0)
    points += F.least(F.lit(20), F.greatest(F.lit(0), n - 1) * 8)
    for flag, score in (("has_near_limit", 10), ("is_burst", 8), ("has_repeats", 5)):
        points += F.when(F.col(flag), score).otherwise(0)
    return F.rint(F.least(F.lit(100.0), points)).cast("int")


def radar(
    contracts: DataFrame,
    min_contracts: int = 2,
    strict_works: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Scored groups. ``ordered=False`` leaves the final sort out when another operator reads the result."""
    scored = score(radar_groups(contracts), min_contracts, strict_works)
    return scored.orderBy(*by_risk()) if ordered else scored


def score(groups: DataFrame, min_contracts: int = 2, strict_works: bool = False) -> DataFrame:
    """Alerts, signals, index and texts of groups."""
    days = F.datediff("last_date", "first_date")
    index = F.col("risk_index")
    return (
        with_alerts(groups, min_contracts, strict_works)
        .withColumn("days_between", days)
        .withColumn("is_burst", F.coalesce((F.col("n_contracts") >= 2) & (F.col("days_between") <= 45), F.lit(False)))
        .withColumns({"signals": _signals(), "risk_index": _index()})
        .withColumns({
            "priority": F.when(index >= 75, "Alta").when(index >= 50, "Media").when(index >= 25, "Baja")
            .otherwise("Informativa"),
            "pct_text": format_pct(F.col("pct_limit")),
            "total_text": format_euros(F.col("total")),
            "limit_text": format_euros(F.col("limit_amount")),
        })
        .select(*COLUMNS)
    )


def by_risk() -> list[Column]:
    """Highest index first, then highest total; the group keys settle ties."""
    return [F.desc("risk_index"), F.desc("total"), *[F.asc(k) for k in GROUP_KEYS]]


def radar_summary(radar_table: DataFrame) -> DataFrame:
    """Number of groups per risk level, in one row."""
    return radar_table.agg(
        F.count_if(F.col("risk_level") == RISK_OVER).alias("over_limit"),
        F.count_if(F.col("risk_level") == RISK_GRAZES).alias("over_95"),
        F.count_if(F.col("risk_level") == RISK_NEAR).alias("over_90"),
        F.count("*").alias("n_groups"),
    )


def _shown(rows: DataFrame, amounts: DataFrame | None) -> DataFrame:
    return rows if amounts is None else with_amount_text(rows, amounts).orderBy(*by_risk())


def priority_case(radar_table: DataFrame, amounts: DataFrame | None = None) -> DataFrame:
    """The alert with the highest index and total; ``amounts`` adds its amounts as text."""
    return _shown(radar_table.where("is_alert").orderBy(*by_risk()).limit(1), amounts)


def priority_alerts(radar_table: DataFrame, top: int = 18, amounts: DataFrame | None = None) -> DataFrame:
    """Top groups by risk; groups without alert only if there is no alert at all. ``amounts`` adds amounts as text."""
    head = radar_table.orderBy(F.desc("is_alert"), *by_risk()).limit(top)
    # At most ``top`` rows are left, so one task can compare them.
    any_alert = F.bool_or("is_alert").over(Window.partitionBy())
    return _shown(head.withColumn("any_alert", any_alert).where("is_alert OR NOT any_alert").drop("any_alert"), amounts)


REPORT_COLUMNS = (
    "supplier", "buyer", "contract_type", "fiscal_year", "n_contracts", "total_text", "limit_text", "pct_text",
    "risk_index", "priority", "risk_level", "signals", "days_between", "individual_amounts",
)
SHORT_REPORT_COLUMNS = (
    "supplier", "buyer", "contract_type", "fiscal_year", "n_contracts", "total_text", "pct_text", "risk_index",
)


def report_alert_table(radar_table: DataFrame, amounts: DataFrame) -> DataFrame:
    """All alerts with the columns of the full report, in order of risk."""
    alerts = radar_table.where("is_alert")
    return with_amount_text(alerts, amounts).orderBy(*by_risk()).select(*REPORT_COLUMNS)


def report_alert_amounts(radar_table: DataFrame, amounts: DataFrame) -> DataFrame:
    """The amounts of all alerts as rows, in order of risk, then amount: for groups of any size.

    A row per group and amount with its number of contracts, dealt out by ranges of that order; no group is put together,
    neither as a list nor in a cell. The alerts are rebalanced, so the join splits a hot group.
    """
    alerts = radar_table.where("is_alert").hint("rebalance")
    return amounts.join(alerts.drop("n_contracts"), list(GROUP_KEYS)).orderBy(*by_risk(), F.desc("amount")).select(
        *GROUP_KEYS, "risk_index", "risk_level", "total_text", "amount", "n")


def report_alert_table_short(radar_table: DataFrame, top: int = 40) -> DataFrame:
    """The first alerts with the columns of the printed report."""
    return radar_table.where("is_alert").orderBy(*by_risk()).limit(top).select(*SHORT_REPORT_COLUMNS)


def report_summary(contracts: DataFrame, radar_table: DataFrame) -> DataFrame:
    """Headline numbers of a report, in one row."""
    groups = radar_table.agg(F.struct(
        F.count("*").alias("n_groups"),
        F.count_if("is_alert").alias("n_alerts"),
        F.coalesce(F.sum(F.when(F.col("is_alert"), F.col("total").cast("decimal(28,2)"))).cast("double"), F.lit(0.0))
        .alias("alert_amount"),
    ).alias("g"))
    # Folded by the counted columns first, so the distinct counts multiply pairs and not contracts.
    pairs = contracts.groupBy("buyer", "supplier").agg(F.count("*").alias("n"), exact_sum(F.col("amount")).alias("amount"))
    totals = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_contracts"),
        F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias("total_amount"),
        F.count_distinct("buyer").alias("n_buyers"),
        F.count_distinct("supplier").alias("n_suppliers"),
    )
    return totals.withColumn("g", groups.scalar()).select(
        "n_contracts", "total_amount", "n_buyers", "n_suppliers", "g.n_groups", "g.n_alerts", "g.alert_amount"
    )


def treemap_suppliers(radar_table: DataFrame, top: int = 30) -> DataFrame:
    """Largest groups with a bounded share of the limit and their weight among the groups shown."""
    pct = F.col("pct_limit")
    finite = F.when(pct.isNull() | F.isnan(pct) | (F.abs(pct) == float("inf")), 0.0).otherwise(pct)
    visible = F.coalesce(F.nullif(exact_sum(F.col("total")).over(Window.partitionBy()).cast("double"), F.lit(0.0)),
                         F.lit(1.0))
    return (
        radar_table.orderBy(F.desc_nulls_last("total"), *GROUP_KEYS).limit(top)
        .withColumns({
            "pct": finite,
            "pct_clipped": F.least(F.lit(120.0), F.greatest(F.lit(0.0), finite)),
            # ``top`` rows are left: an unpartitioned window is one small task.
            "share": F.coalesce(F.col("total"), F.lit(0.0)) / visible,
        })
        .select(*GROUP_KEYS, "total", "n_contracts", "risk_level", "total_text", "pct_text", "pct", "pct_clipped",
                "share")
    )


def risk_scatter(radar_table: DataFrame) -> DataFrame:
    return radar_table.select(*GROUP_KEYS, "n_contracts", "total", "total_text", "risk_level")


def case_detail(contracts: DataFrame, cases: DataFrame) -> DataFrame:
    """Contracts behind the given radar groups, by date.

    The cases only decide which contracts stay, so a hot group makes the contract side large and never the
    other. Rebalancing the cases makes both sides plain shuffles; adaptive execution then splits a hot group,
    which it would not next to the partitions of an aggregate.
    """
    keys = cases.select(F.col("supplier").alias("supplier_key"), "buyer", "contract_type", "fiscal_year").hint("rebalance")
    columns = ["award_date", "buyer", "fiscal_year", "contract_type", "subject", "supplier", "amount"]
    return (
        contracts.join(keys, ["supplier_key", "buyer", "contract_type", "fiscal_year"], "left_semi")
        .select(*columns)
        .orderBy(F.asc_nulls_last("award_date"), *columns[1:])
    )
