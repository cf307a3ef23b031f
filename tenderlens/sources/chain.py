"""Whether a download of linked feed pages is complete: every page's place in its chain.

Each page names at most one next page, so pages form chains that end at a page without a next one, at a page whose next one
is not there, or run into a cycle; where two pages name the same next one, chains join. Places are found by pointer doubling:
in each round every page still on its way takes over the pointer of the page it points to, which doubles the stretch it has
covered, so chains of n pages take log2(n) rounds instead of n. Pages that have reached an end take no part in later rounds.
Rounds are written to the scratch folder; each is one join, whose sides are rebalanced, so that it splits at a page that
very many others name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenderlens.session import scratch_dir
from tenderlens.sources.feed import page_links
from tenderlens.sources.parts import delete_folder

LAST, MISSING, CYCLE = "last", "missing", "cycle"


def rank_links(links: DataFrame) -> DataFrame:
    """(node, next) as node, steps to the end of its way, end (its last node; in a cycle the cycle's smallest), ends_in, on_cycle.

    ``next`` is null for none. A node given more than once keeps its smallest next. steps is null where the way runs into a
    cycle; ends_in is last, missing (the end names a node that is not there) or cycle.
    """
    spark, made = links.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        path = scratch_dir(spark, "chain")
        df.write.parquet(path)
        made.append(path)
        return spark.read.schema(df.schema).parquet(path)

    def forget(keep: int) -> None:
        while len(made) > keep:
            delete_folder(spark, made.pop(0))

    nodes = kept(links.groupBy(F.col("node")).agg(F.min("next").alias("next")))
    there = nodes.select(F.col("node").alias("next"), F.lit(True).alias("is_there"))
    step = nodes.hint("rebalance").join(there, "next", "left").select(
        "node", F.when(F.col("next").isNull(), LAST).when(F.col("is_there").isNull(), MISSING).alias("why"), "next")
    # to: the node reached; least: the smallest one passed on the way there, the start included.
    state = kept(step.select(
        "node", F.when(F.col("why").isNull(), F.col("next")).otherwise(F.col("node")).alias("to"), "why",
        F.when(F.col("why").isNull(), 1).otherwise(0).cast("bigint").alias("steps"), F.col("node").alias("least")))
    n, covered = state.count(), 1
    while True:
        moving = state.where("why IS NULL")
        # After n steps or more only cycles are left.
        if covered >= n or moving.isEmpty():
            break
        far = state.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("why").alias("why2"),
                           F.col("steps").alias("steps2"), F.col("least").alias("least2"))
        moved = moving.hint("rebalance").join(far, "to").select(
            "node", F.col("to2").alias("to"), F.col("why2").alias("why"), (F.col("steps") + F.col("steps2")).alias("steps"),
            F.least("least", "least2").alias("least"))
        state = kept(state.where("why IS NOT NULL").unionByName(moved))
        covered *= 2
        forget(1)
    # Whoever moves still is on a way into a cycle, and whatever it points to lies on it; that node has gone all around.
    moving = state.where("why IS NULL")
    on_cycle = moving.select(F.col("to").alias("node")).distinct().withColumn("on_cycle", F.lit(True))
    around = moving.select(F.col("node").alias("to"), F.col("least").alias("cycle"))
    turning = moving.hint("rebalance").join(around, "to").join(on_cycle, "node", "left").select(
        "node", F.lit(None).cast("bigint").alias("steps"), F.col("cycle").alias("end"), F.lit(CYCLE).alias("ends_in"),
        F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))
    done = state.where("why IS NOT NULL").select("node", "steps", F.col("to").alias("end"), F.col("why").alias("ends_in"),
                                                 F.lit(False).alias("on_cycle"))
    out = kept(done.unionByName(turning))
    forget(1)
    return out


def feed_chain_rank(pages: DataFrame, base_url: Column | None = None) -> DataFrame:
    """page, chain (address of its last page, or of the cycle's smallest), position (1 at the farthest beginning; null where
    the way runs into a cycle), pages_after, ends_in, on_cycle, n_named_by (0: a beginning, 2 or more: chains join here)."""
    links = page_links(pages, base_url).select(F.col("own_address").alias("node"), F.col("address").alias("next")).distinct()
    path = scratch_dir(pages.sparkSession, "page-links")
    links.write.parquet(path)  # pages are parsed once
    links = pages.sparkSession.read.schema(links.schema).parquet(path)
    ranked = rank_links(links)
    longest = ranked.groupBy("end").agg(F.max("steps").alias("longest"))
    named = links.where("next IS NOT NULL").groupBy(F.col("next").alias("node")).agg(F.count("*").alias("named_by"))
    return ranked.hint("rebalance").join(longest, "end").join(named, "node", "left").select(
        F.col("node").alias("page"), F.col("end").alias("chain"), (F.col("longest") - F.col("steps") + 1).alias("position"),
        F.col("steps").alias("pages_after"), "ends_in", "on_cycle", F.coalesce("named_by", F.lit(0)).cast("bigint").alias("n_named_by"))


def feed_chains(ranked: DataFrame) -> DataFrame:
    """A row per chain of ``feed_chain_rank``. A download is complete if it is one chain and that is complete."""
    return ranked.groupBy("chain").agg(
        F.max("ends_in").alias("ends_in"), F.count("*").alias("n_pages"), F.count_if(F.col("n_named_by") == 0).alias("n_beginnings"),
        F.count_if(F.col("n_named_by") > 1).alias("n_forks"), F.max("pages_after").alias("most_after"),
    ).withColumn("is_complete", (F.col("ends_in") == LAST) & (F.col("n_beginnings") == 1) & (F.col("n_forks") == 0))
