"""Budget settlement: ranking of entities and their budget lines.

Lines are summed per entity code before they meet the entities, so an entity with most of the lines is one row
at the join. Entities are matched without a forced broadcast: Spark broadcasts them if it finds them small.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def _number(name: str) -> Column:
    return F.trim(name).try_cast("double")


def _in_chapter(chapter: int | str) -> Column:
    return F.trim("cdcta").startswith(str(chapter))


def budget_ranking(
    lines: DataFrame,
    entities: DataFrame,
    chapter: int = 2,
    provinces: Iterable[str] | None = None,
    top: int | None = None,
    by_id: bool = False,
) -> DataFrame:
    """Spending per entity in a chapter, of some provinces or all. Entities with one name merge, unless ``by_id``.

    Amounts that are no number, or have more than twenty digits before the point, count as lines and not in the total.
    """
    spending = (
        lines.where((F.col("tipreig") == "G") & _in_chapter(chapter))
        .groupBy("idente")
        .agg(F.sum(_number("importer").try_cast("decimal(24,4)")).alias("part"), F.count("*").alias("n"))
    )
    chosen = entities
    if provinces:
        chosen = entities.where(F.substring(F.trim("codbdgel"), 1, 2).isin(list(provinces)))
    keys = ["idente", "entity"] if by_id else ["entity"]
    out = (
        spending.join(chosen, "idente")
        .withColumn("entity", F.trim("nombreente"))
        .groupBy(*keys)
        .agg(F.sum("part").cast("double").alias("total"), F.sum("n").alias("n_lines"))
        .orderBy(F.desc_nulls_last("total"), *keys)
    )
    return out.limit(top) if top else out


def budget_ranking_total(ranking: DataFrame, top: int = 100) -> DataFrame:
    """Number of entities in the ranking, and the total of those shown."""
    shown = ranking.orderBy(F.desc_nulls_last("total"), "entity").limit(top)
    total = shown.agg(F.coalesce(F.sum(F.col("total").try_cast("decimal(28,4)")).cast("double"), F.lit(0.0)))
    return ranking.agg(F.count("*").alias("n_entities")).withColumn("shown_total", total.scalar())


def budget_entity_detail(
    lines: DataFrame, entities: DataFrame, pattern: str, chapter: int | None = None
) -> DataFrame:
    """Budget lines of the entities whose name fits an SQL pattern (``%`` and ``_``), in any case."""
    name = F.trim("nombreente")
    chosen = entities.where(F.lower(name).like(pattern.lower().replace("\\", "\\\\"))).select(
        "idente", name.alias("entity")
    )
    rows = lines if chapter is None else lines.where(_in_chapter(chapter))
    return rows.join(chosen, "idente").select(
        "entity",
        "tipreig",
        F.trim("cdcta").alias("account"),
        _number("imported").alias("planned"),
        _number("importer").alias("recognised"),
        _number("importel").alias("settled"),
    ).orderBy(F.desc_nulls_last("recognised"), "entity", "account")
