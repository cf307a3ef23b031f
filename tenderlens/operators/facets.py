"""Facet values, dataset metadata and coverage diagnostics."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tenderlens.functions import exact_sum, fold_text
from tenderlens.functions.places import fold_literal
from tenderlens.refdata import MUNICIPAL_BUYER


def _selected(column: str, values: Iterable | None) -> Column:
    values = [v for v in values or () if v]
    return F.col(column).isin(values) if values else F.lit(True)


def facet_values(
    contracts: DataFrame, column: str, where: Mapping[str, Iterable] | None = None, limit: int | None = None
) -> DataFrame:
    """Sorted distinct values of a column under the given selections: the entries of a drop-down list."""
    rows = contracts.where(F.col(column).isNotNull())
    for name, values in (where or {}).items():
        rows = rows.where(_selected(name, values))
    values = rows.select(F.col(column).alias("value")).distinct().orderBy("value")
    return values if limit is None else values.limit(limit)


def facet_cascade(
    contracts: DataFrame, regions: Iterable[str] = (), provinces: Iterable[str] = ()
) -> DataFrame:
    """Values and counts of region, province, municipality and buyer type in one pass.

    Each list respects the selections above it. One row goes out as four facet entries, which are counted
    before the shuffle.
    """
    in_region = _selected("region", regions)
    in_province = in_region & _selected("province", provinces)

    def entry(name: str, condition: Column) -> Column:
        return F.struct(F.lit(name).alias("facet"), F.when(condition, F.col(name)).alias("value"))

    entries = F.array(
        entry("region", F.lit(True)), entry("province", in_region), entry("municipality", in_province),
        entry("buyer_type", F.lit(True)),
    )
    return (
        contracts.select(F.inline(entries)).where(F.col("value").isNotNull())
        .groupBy("facet", "value").agg(F.count("*").alias("n"))
    )


def dataset_metadata(contracts: DataFrame) -> DataFrame:
    """Size, variety, total and date range of the contracts, in one row."""
    # Folded by the counted columns first, so the distinct counts multiply few rows.
    folded = contracts.groupBy("buyer", "supplier", "region").agg(
        F.count("*").alias("n"), exact_sum(F.col("amount")).alias("amount"),
        F.min("award_date").alias("first_date"), F.max("award_date").alias("last_date"),
    )
    return folded.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_contracts"),
        F.count_distinct("buyer").alias("n_buyers"),
        F.count_distinct("supplier").alias("n_suppliers"),
        F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias("total_amount"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.count_distinct("region").alias("n_regions"),
    )


def _with_matches(contracts: DataFrame, query: str) -> DataFrame:
    term = fold_literal(query, collapse=False).replace("ß", "ss") if query.strip() else None

    def folded(name: str) -> Column:
        return fold_text(F.coalesce(F.col(name), F.lit("")), collapse=False, casefold=True)

    def has(name: str) -> Column:
        return folded(name).contains(term) if term else F.lit(False)

    return contracts.withColumns({
        "is_municipal": folded("buyer").rlike(MUNICIPAL_BUYER), "is_located": has("municipality"), "is_named": has("buyer"),
    })


def municipal_coverage(contracts: DataFrame, query: str = "") -> DataFrame:
    """Does the data hold a town, as a buyer or only as a place? Counts in one row."""
    buyer = F.col("buyer")
    # One row per (buyer, town, flags) is enough for the distinct counts and is folded before the shuffle.
    folded = _with_matches(contracts, query).groupBy("buyer", "municipality", "is_municipal", "is_located", "is_named").agg(
        F.count("*").alias("n"), F.min("award_date").alias("first_date"), F.max("award_date").alias("last_date")
    )
    return folded.agg(
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.count_distinct("municipality").alias("n_municipalities"),
        F.count_distinct("buyer").alias("n_buyers"),
        F.count_distinct(F.when(F.col("is_municipal"), buyer)).alias("n_municipal_buyers"),
        F.coalesce(F.sum(F.when(F.col("is_located"), F.col("n"))), F.lit(0)).alias("contracts_located"),
        F.count_distinct(F.when(F.col("is_named"), buyer)).alias("buyers_named"),
        F.count_distinct(F.when(F.col("is_municipal") & F.col("is_located"), buyer)).alias("municipal_located"),
    )


def municipal_coverage_rows(contracts: DataFrame, query: str, top: int = 50) -> DataFrame:
    """First distinct rows of the buyers that match by name and of those located in the town."""
    columns = ["buyer", "municipality", "province", "region", "award_date"]
    rows = _with_matches(contracts, query)

    def first(flag: str, label: str) -> DataFrame:
        found = rows.where(flag).select(*columns).distinct().orderBy(*[F.asc_nulls_last(c) for c in columns]).limit(top)
        return found.select(F.lit(label).alias("match_set"), *columns)

    return first("is_named", "buyer_name").unionByName(first("is_located", "located"))
