"""Rankings and the aggregates behind charts.

Totals are folded per key before the shuffle, so one supplier with most of the rows costs no more than any
other; windows run only over rows that a top-k has already bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderlens.functions import exact_sum
from tenderlens.refdata import NO_SUPPLIER, PROVINCE_CENTROIDS, REGION_CENTROIDS

LEVELS = ("region", "province", "municipality")


def _total(name: str = "amount") -> Column:
    return F.coalesce(exact_sum(F.col(name)).cast("double"), F.lit(0.0))


def _ranked(contracts: DataFrame, keys: list[str], top: int | None) -> DataFrame:
    if top is not None and top < 1:
        raise ValueError("top is a positive number, or None for all where that is offered")
    out = (
        contracts.dropna(subset=[*keys, "amount"]).groupBy(*keys)
        .agg(_total().alias("total"), F.count("*").alias("n_contracts"))
        .orderBy(F.desc("total"), *keys)
    )
    return out if top is None else out.limit(top)


def known_suppliers(contracts: DataFrame, trim: bool = True) -> DataFrame:
    name = F.trim("supplier") if trim else F.col("supplier")
    return contracts.where(F.lower(name) != NO_SUPPLIER.lower())


def top_suppliers(contracts: DataFrame, top: int | None = 20) -> DataFrame:
    return _ranked(contracts, ["supplier"], top)


def buyer_supplier_relations(contracts: DataFrame, top: int | None = 20, known_only: bool = False) -> DataFrame:
    """Pairs of buyer and supplier by total; charts leave unknown suppliers out."""
    return _ranked(known_suppliers(contracts) if known_only else contracts, ["buyer", "supplier"], top)


def spend_by_year_type(contracts: DataFrame) -> DataFrame:
    return (
        contracts.dropna(subset=["fiscal_year", "amount"]).groupBy("fiscal_year", "contract_type")
        .agg(_total().alias("total")).orderBy("fiscal_year", "contract_type")
    )


def _metric(metric: str) -> Column:
    if metric not in ("amount", "count"):
        raise ValueError(f"metric must be 'amount' or 'count', not {metric!r}")
    return _total() if metric == "amount" else F.count("amount")


def spend_by_territory(contracts: DataFrame, level: str = "region", metric: str = "amount") -> DataFrame:
    """Total or number of contracts per place, smallest first."""
    return (
        contracts.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("place"))
        .agg(_metric(metric).alias("value")).orderBy("value", "place")
    )


def territory_all_levels(contracts: DataFrame) -> DataFrame:
    """Totals of every level in one pass over the contracts."""
    return (
        contracts.groupingSets([[level] for level in LEVELS], *LEVELS)
        .agg(_total().alias("total"), F.count("amount").alias("n_contracts"),
             F.array(*[F.grouping(c) for c in LEVELS]).alias("absent"))
        .select(
            F.coalesce(*[F.when(F.col("absent")[i] == 0, level) for i, level in enumerate(LEVELS)]).alias("level"),
            F.coalesce(*LEVELS).alias("place"), "total", "n_contracts",
        )
        .where(F.col("place").isNotNull())
    )


def first_territory(contracts: DataFrame) -> DataFrame:
    """Totals of the widest level that has data, as printed reports show it."""
    rank = F.coalesce(*[F.when(F.col("level") == level, i) for i, level in enumerate(LEVELS)])
    levels = territory_all_levels(contracts).withColumn("rank", rank)
    first = levels.agg(F.min("rank").alias("r"))
    return levels.where(F.col("rank") == first.scalar()).drop("rank")


def territory_map(contracts: DataFrame, level: str = "province", metric: str = "amount") -> DataFrame:
    """Totals with coordinates, for regions or provinces; places without coordinates are left out."""
    centroids = {"region": REGION_CENTROIDS, "province": PROVINCE_CENTROIDS}.get(level)
    if centroids is None:
        raise ValueError("the map knows regions and provinces")
    points = contracts.sparkSession.createDataFrame(
        [(name, lat, lon) for name, (lat, lon) in centroids.items()], "place string, lat double, lon double"
    )
    totals = spend_by_territory(contracts.where(F.col("amount").isNotNull()), level, metric)
    return totals.join(F.broadcast(points), "place").orderBy("value", "place")  # a fixed table of coordinates


def monthly_heatmap(contracts: DataFrame) -> DataFrame:
    """Totals per year and month, latest year first, empty months 0."""
    months = list(range(1, 13))
    cells = contracts.dropna(subset=["award_date", "amount"]).select(
        F.year("award_date").alias("year"), F.month("award_date").alias("month"),
        F.col("amount").cast("decimal(18,2)").alias("amount"),
    )
    wide = cells.groupBy("year").pivot("month", months).agg(F.sum("amount"))
    cents = [F.coalesce(F.col(str(m)).cast("double"), F.lit(0.0)).alias(f"m{m:02d}") for m in months]
    return wide.select("year", *cents).orderBy(F.desc("year"))


def amount_histogram(contracts: DataFrame) -> DataFrame:
    """Contracts per amount bin and type; equal bins between the smallest and the largest amount."""
    rows = contracts.where(F.col("amount") > 0).select("contract_type", "amount")
    n = F.count("*")
    shape = rows.agg(F.struct(
        F.min("amount").alias("low"),
        F.max("amount").alias("high"),
        F.least(F.lit(60), F.greatest(F.lit(10), F.floor(F.sqrt(n)))).cast("int").alias("bins"),
    ).alias("s"))
    width = (F.col("s.high") - F.col("s.low")) / F.col("s.bins")
    bin_ = F.when(width == 0, 1).otherwise(
        F.least(F.col("s.bins"), F.floor((F.col("amount") - F.col("s.low")) / F.nullif(width, F.lit(0.0))).cast("int") + 1)
    )
    return (
        rows.withColumn("s", shape.scalar())
        .select("contract_type", bin_.alias("bin"), (F.col("s.low") + (bin_ - 1) * width).alias("bin_start"))
        .groupBy("bin", "bin_start", "contract_type").agg(F.count("*").alias("n_contracts"))
        .orderBy("bin", "contract_type")
    )


def _top_supplier_totals(contracts: DataFrame, top: int) -> DataFrame:
    """Totals that are broadcast or windowed over, so ``top`` bounds them."""
    if top is None:
        raise ValueError("top bounds what is broadcast; it cannot be None here")
    return _ranked(contracts, ["supplier"], top)


def top_supplier_contracts(contracts: DataFrame, top: int = 18) -> DataFrame:
    """Contracts of the suppliers with the highest totals; ``top`` names are few enough to broadcast."""
    names = _top_supplier_totals(contracts, top).select("supplier")
    return contracts.join(F.broadcast(names), "supplier", "left_semi")


def supplier_timeline(contracts: DataFrame, top: int = 18) -> DataFrame:
    """Dated contracts of the top suppliers with the marker size of a timeline."""
    if top is None or top < 1:
        raise ValueError("top bounds what is broadcast; it is a positive number")
    rows = contracts.dropna(subset=["award_date", "amount", "supplier"])
    # One fold gives the ranking and each supplier's largest amount; the window over ``top`` rows gives the overall one.
    names = (
        rows.groupBy("supplier").agg(_total().alias("total"), F.max("amount").alias("most"))
        .orderBy(F.desc("total"), "supplier").limit(top)
        .select("supplier", F.max("most").over(Window.partitionBy()).alias("most"))
    )
    largest = F.coalesce(F.nullif("most", F.lit(0.0)), F.lit(1.0))
    size = 8 + 20 * F.sqrt(F.greatest(F.col("amount"), F.lit(0.0)) / largest)
    return (
        rows.join(F.broadcast(names), "supplier")
        .select("award_date", "supplier", "buyer", "contract_type", "subject", "fiscal_year", "amount",
                size.alias("marker_size"))
    )


def spend_concentration(contracts: DataFrame, top: int = 25) -> DataFrame:
    """Top suppliers with the running share of everything spent."""
    rows = contracts.dropna(subset=["supplier", "amount"])
    totals = _top_supplier_totals(rows, top)
    # The window sees at most ``top`` rows.
    running = Window.orderBy(F.desc("total"), "supplier").rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.sum(F.col("total").cast("decimal(28,2)")).over(running).cast("double")
    everything = rows.agg(exact_sum(F.col("amount")).cast("double"))
    share = F.coalesce(so_far / F.nullif(everything.scalar(), F.lit(0.0)) * 100, F.lit(0.0))
    return totals.select("supplier", "total", share.alias("running_pct"))
