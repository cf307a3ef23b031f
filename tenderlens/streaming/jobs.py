"""The two streaming jobs."""

from __future__ import annotations

import hashlib
import math
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tenderlens import schema
from tenderlens.operators.radar import folded_amounts, groups_of, refold, score
from tenderlens.refdata import LIMIT_INGEST
from tenderlens.schema import GROUP_KEYS
from tenderlens.session import shuffles_dropped
from tenderlens.sources import parts
from tenderlens.sources.feed import FEED_FILES, feed_contracts, feed_entries
from tenderlens.sources.revisions import upsert_revisions
from tenderlens.sources.tables import write_contracts

#: Groups of a fiscal year are dealt over so many folders; a batch rewrites those in which its groups are.
BUCKETS = 64
#: So many runs of increments of about one size are merged into one.
MERGED = 8


def stream_contracts(
    spark: SparkSession,
    folder: str,
    table: str,
    checkpoint: str,
    max_year: int | None = None,
    max_files: int | None = None,
    pattern: str = FEED_FILES,
    limit: float | None = LIMIT_INGEST,
    revisions: bool = False,
) -> StreamingQuery:
    """Feed files that were not seen before, parsed and added to the contract table.

    With ``revisions`` the table holds the newest revision of each entry id instead of every entry.

    Each batch is a part of the table, written by the writer of batch jobs: a table may be filled by both, and a batch
    that runs twice, even with other rows than before, replaces its own part as a whole.
    """
    reader = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    pages = reader.load(folder).select(F.col("_metadata.file_path").alias("source_file"), "value")
    contracts = feed_contracts(feed_entries(pages), max_year=max_year, limit=limit, revisions=revisions)
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        if revisions:
            upsert_revisions(batch, table)
            return
        write_contracts(batch, table, "append", part=f"stream-{stream}-{number}")

    return (
        contracts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_radar(
    spark: SparkSession, table: str, radar_table: str, checkpoint: str, min_contracts: int = 2, amounts_table: str | None = None
) -> StreamingQuery:
    """Radar kept up to date with a contract table: the cost of a batch follows its news.

    The stream is the table's registry. Each batch compares the versions that the table holds now with those taken in
    before: new ones are folded by group and amount and kept as increments, a run of rows that name their version; rows of
    versions that a rewritten part or table has superseded count no more. The groups in the folders that either touches are
    scored anew from the increments of current versions alone, so totals, dates and flags are those of the table as it is;
    folders left without a group go. Where ``MERGED`` runs of a size have come together they become one of the next, so a
    folder has a number of files that grows with the logarithm of the batches. A run counts from the moment on that the log
    says which versions it holds: a batch that breaks off is done again from the start and gives the same tables.
    """
    amounts = (amounts_table or f"{radar_table.rstrip('/')}-amounts").rstrip("/")
    log = f"{amounts}/_taken"

    def refresh(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        now = parts.current(session, table)
        held = {v for _, v in now}
        taken, step = _taken(session, log)
        news, gone = [(p, v) for p, v in now if v not in taken], sorted(taken.keys() - held)
        if not news and not gone:
            return
        bucket = F.pmod(F.xxhash64(*GROUP_KEYS), F.lit(BUCKETS)).cast("int")
        before, run = set(taken.values()), uuid.uuid4().hex
        if news:
            rows = parts.read_versions(session, table, news, _VERSIONED)
            _write_run(folded_amounts(rows, "version").withColumn("bucket", bucket), amounts, run)
        changed = dict.fromkeys((v for _, v in news), run) | {v: taken[v] for v in gone}
        taken = {v: r for v, r in (taken | changed).items() if v in held}
        kept = session.read.schema(INCREMENTS).parquet(amounts)
        # Years span 2010 to next year, so these lists are short.
        met = kept.where(F.col("run").isin(sorted(set(changed.values()))) & F.col("version").isin(sorted(changed)))
        touched = {tuple(r) for r in met.select("fiscal_year", "bucket").distinct().collect()}
        if touched:
            by_year: dict[int, list[int]] = {}
            for year, b in touched:
                by_year.setdefault(year, []).append(b)
            here = reduce(or_, [(F.col("fiscal_year") == y) & F.col("bucket").isin(b) for y, b in by_year.items()])
            valid = kept.where(here & F.col("run").isin(sorted(set(taken.values()))) & F.col("version").isin(sorted(held)))
            with shuffles_dropped(session):
                (
                    score(groups_of(refold(valid)), min_contracts).withColumn("bucket", bucket)
                    .hint("rebalance", F.col("fiscal_year"), F.col("bucket"))
                    .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                    .partitionBy("fiscal_year", "bucket").parquet(radar_table)
                )
            full = {tuple(r) for r in valid.select("fiscal_year", "bucket").distinct().collect()}
            for year, b in touched - full:
                parts.delete_folder(session, f"{radar_table.rstrip('/')}/fiscal_year={year}/bucket={b}")
        _record(session, log, {v: taken.get(v) for v in changed}, step + 1)
        merged = _merge_runs(session, amounts, log, taken, step + 2)
        for old in before - set(merged.values()):
            parts.delete_folders(session, f"{amounts}/fiscal_year=*/bucket=*/run={old}")

    commits = spark.readStream.schema(parts.REGISTRY).parquet(parts.registry_path(table))
    return (
        commits.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _write_run(rows: DataFrame, amounts: str, run: str) -> None:
    with shuffles_dropped(rows.sparkSession):
        rows.withColumn("run", F.lit(run)).hint("rebalance", F.col("fiscal_year"), F.col("bucket")).write.mode("append").partitionBy(
            "fiscal_year", "bucket", "run").parquet(amounts)


def _merge_runs(spark: SparkSession, amounts: str, log: str, taken: dict[str, str], step: int) -> dict[str, str]:
    """Merge runs until fewer than MERGED hold about as many versions; the run of each version afterwards."""
    while True:
        sizes: dict[str, int] = {}
        for run in taken.values():
            sizes[run] = sizes.get(run, 0) + 1
        tiers: dict[int, list[str]] = {}
        for run, n in sizes.items():
            tiers.setdefault(int(math.log(n + 0.5, MERGED)), []).append(run)
        crowded = [runs for runs in tiers.values() if len(runs) >= MERGED]
        if not crowded:
            return taken
        run, runs = uuid.uuid4().hex, sorted(r for some in crowded for r in some)
        rows = spark.read.schema(INCREMENTS).parquet(amounts).where(F.col("run").isin(runs) & F.col("version").isin(sorted(taken)))
        _write_run(rows.drop("run"), amounts, run)
        moved = {v: run for v, r in taken.items() if r in runs}
        _record(spark, log, moved, step)
        taken, step = taken | moved, step + 1
        for old in runs:
            parts.delete_folders(spark, f"{amounts}/fiscal_year=*/bucket=*/run={old}")


def _record(spark: SparkSession, log: str, runs: dict[str, str | None], step: int) -> None:
    """Make it known which run holds each version from now on; none where it counts no more."""
    spark.createDataFrame([(v, r, step) for v, r in runs.items()], TAKEN).coalesce(1).write.mode("append").parquet(log)


def _taken(spark: SparkSession, log: str) -> tuple[dict[str, str], int]:
    """The run of each version whose rows are in the radar, and the last step recorded."""
    if not parts.exists(spark, log):
        return {}, 0
    rows = sorted((r.step, r.version, r.run) for r in spark.read.schema(TAKEN).parquet(log).collect())
    last = {version: run for _, version, run in rows}
    return {v: r for v, r in last.items() if r is not None}, rows[-1][0] if rows else 0


_VERSIONED = T.StructType([*schema.CONTRACTS.fields, T.StructField("version", T.StringType())])
INCREMENTS = (
    "supplier string, buyer string, contract_type string, amount double, n bigint, total decimal(28,2), first_date date, "
    "last_date date, version string, fiscal_year int, bucket int, run string"
)
TAKEN = "version string, run string, step bigint"
