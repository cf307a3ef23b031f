"""Near-duplicates by SimHash: 64-bit fingerprints of word shingles, linked by multi-index hashing.

Two fingerprints that differ in at most `radius` bits lie, in at least one of three segments, within that segment's
small ball: with radii r1, r2, r3 and (r1 + 1) + (r2 + 1) + (r3 + 1) > radius no other case is left. Each fingerprint is
entered into one table per segment; it then enumerates the ball around its own segment, fetches the entries found
there, and the whole distance is checked inside the join, so only true links leave it. In a bucket of more entries than
a ball of half the radius has points, that ball is cheaper than comparing: linked fingerprints have a common point half
way, so each point links all that reach it to the smallest of them, without pairs.

Defined cases: null and empty texts and texts without a word have fingerprint zero and are linked like any other; repeated
rows each get a row; a null id counts as larger than all ids; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tenderlens.llm.common import clearing, components, free_name, slices, written

SEED = 42
RADIUS = 4


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Majority bits of the XXH64 values of all shingles of `width` words, repeats included."""
    words = (text or b"").lower().split()  # on bytes both touch ASCII alone
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    values = np.array([digest(joined[i:j], SEED) for i, j in
                       zip(start[:n].tolist(), end[min(width, len(words)) - 1:].tolist())], np.dtype(">u8"))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(values[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, text_hash, fp (signed 64 bits) of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            fp = pa.array([fingerprint(t.as_py(), width) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp], ["doc_id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       text.cast("binary").alias("text")).mapInArrow(work, "doc_id bigint, text_hash bigint, fp bigint")


def segment_plan(n: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(lowest bit, bits, ball radius) of each segment for n fingerprints.

    Any plan finds every link. Segments of about log2(n) bits keep buckets small, so few million fingerprints take
    three segments and more take two wider ones with larger balls.
    """
    parts = 3 if n < 1 << 27 else 2
    small = [(radius - parts + 1 + i) // parts for i in range(parts)][::-1] if radius >= parts - 1 else [0] * parts
    while sum(r + 1 for r in small) <= radius:
        small[0] += 1
    bits = [64 // parts] * parts
    for i in range(64 - sum(bits)):
        bits[i] += 1
    low, plan = 64, []
    for width, r in zip(bits, small):
        low -= width
        plan.append((low, width, r))
    return plan


def ball(value: Column, bits: int, radius: int) -> Column:
    """All values that differ from it in up to `radius` of its lowest `bits` bits."""
    masks = "array(0L)"
    for _ in range(radius):
        masks = (f"array_distinct(concat({masks}, flatten(transform({masks}, m -> transform(sequence(0, {bits - 1}), "
                 "i -> m | shiftleft(1L, i))))))")
    return F.transform(F.expr(masks), lambda m: value.bitwiseXOR(m))


def _tagged(k: int):
    return lambda v: F.struct(F.lit(k).cast("tinyint").alias("s"), v.alias("k"))


def links(fps: DataFrame, radius: int = RADIUS, n: int | None = None, crowded_from: int | None = None) -> DataFrame:
    """(a, b) links between distinct fingerprints, complete up to connection: column fp must have no repeats.

    A bucket of more than `crowded_from` entries is linked through points half way instead of being compared; by default
    that many points are what each of its entries would cost.
    """
    n = fps.count() if n is None else n
    plan = segment_plan(n, radius)
    half = (radius + 1) // 2
    most = sum(math.comb(64, r) for r in range(half + 1)) if crowded_from is None else crowded_from
    segment = lambda low, bits: F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))
    entries = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).cast("tinyint").alias("s"), segment(low, bits).alias("k")) for k, (low, bits, _) in enumerate(plan)
    ])).alias("e")).select("fp", "e.s", "e.k")
    probes = fps.select("fp", F.explode(F.flatten(F.array(*[
        F.transform(ball(segment(low, bits), bits, r), _tagged(k)) for k, (low, bits, r) in enumerate(plan)
    ]))).alias("e")).select(F.col("fp").alias("q"), "e.s", "e.k")
    crowded = written(entries.groupBy("s", "k").agg(F.count("*").alias("n")).where(F.col("n") > most).select("s", "k"), "crowded")
    few = entries.join(crowded, ["s", "k"], "left_anti")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("q"))) <= radius
    pairs = probes.alias("p").join(few.alias("t"), (F.col("p.s") == F.col("t.s")) & (F.col("p.k") == F.col("t.k"))
                                   & (F.col("q") != F.col("fp")) & near).select(
        F.least("q", "fp").alias("a"), F.greatest("q", "fp").alias("b")).distinct()
    if crowded.isEmpty():
        return pairs
    # Whoever is in a crowded bucket or reaches it, once each.
    dense = probes.join(crowded, ["s", "k"], "left_semi").select(F.col("q").alias("fp")).distinct()
    reach = dense.select("fp", F.explode(ball(F.col("fp"), 64, half)).alias("point"))
    firsts = reach.groupBy("point").agg(F.min("fp").alias("a"))
    stars = reach.join(firsts, "point").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.union(stars) if radius % 2 == 0 else pairs.union(stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp, root (the smallest fingerprint reachable over links): a row for each row of docs."""
    rows = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    fps = written(rows.select("fp").distinct(), "distinct-fingerprints")
    roots = components(links(fps, radius)).select(F.col("node").alias("fp"), "root")
    return rows.join(roots, "fp", "left").select("doc_id", "text_hash", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                    radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id (smallest id reachable over links): a row for each row of docs."""
    with clearing() as keep:
        rows = keep(written(labelled(docs, id_col, text_col, width, radius), "labelled"))
    return component_ids(rows)


def component_ids(rows: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of labelled() rows; a group of any size is dealt over tasks."""
    # Rebalanced, the groups are a plain shuffle as the rows are: next to an aggregate a hot group would not be split.
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id")).hint("rebalance")
    return rows.join(least, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, of which one stays from each group: the smallest id, then the smallest text hash."""
    key = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    chosen = labelled(docs, id_col, text_col, width, radius).groupBy("root").agg(F.min(key).alias("k")).select(
        F.col("k.i").alias("chosen_id"), F.col("k.h").alias("chosen_hash"))
    i, h = free_name(docs, "_id"), free_name(docs, "_hash")
    keyed = docs.withColumns({i: F.col(id_col).cast("bigint"), h: F.xxhash64(F.col(text_col).cast("string"))})
    kept = keyed.join(chosen, keyed[i].eqNullSafe(chosen.chosen_id) & (keyed[h] == chosen.chosen_hash), "left_semi")
    return kept.dropDuplicates([i, h]).drop(i, h)
