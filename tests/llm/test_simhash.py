"""SimHash components against all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tenderlens.llm import simhash
from tenderlens.llm.common import written


def plain_fingerprint(text, width=4):
    words = []
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ") \
            .replace("\f", " ").replace("\r", " ").split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(nodes, radius):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


TEXTS = [None, "", " \t\n", "one", "One", "a b c", "A  b\tc", "x y z w v u t s", "É é", "é É", "word " * 60_000, "a b c", None]


def test_documents(spark):
    rng = random.Random(5)
    long = [" ".join(rng.choices("abcdefghij", k=300)) for _ in range(6)]
    near = [t.replace("a b", "a q", 1) for t in long for _ in range(2)]
    rows = [(i if i != 3 else None, t, "zz", i) for i, t in enumerate(TEXTS + long + near)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _id string, chosen_id int")
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_components(sorted(set(prints)), 4)
    least = {}
    for (i, *_), p in zip(rows, prints):
        if i is not None:
            least[roots[p]] = min(least.get(roots[p], i), i)
    want = sorted(((i if i is not None else -1), f"{p:016x}", least.get(roots[p], -1)) for (i, *_), p in zip(rows, prints))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id if r.component_id is not None else -1) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len({roots[p] for p in prints}) and set(least.values()) <= set(ids)
    assert simhash.near_duplicates(docs.where("false")).count() == 0 and simhash.keep_one(docs.where("false")).count() == 0


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "same text here now"), (1, "same text here now"), (1, "other words stand there today"), (2, "same text here now")],
                                 "doc_id bigint, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [(1, "other words stand there today"), (1, "same text here now")]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 6])
@pytest.mark.parametrize("n", [None, 1 << 30])
def test_links_connect_as_all_pairs(spark, radius, n):
    rng = random.Random(radius)
    nodes = set()
    for _ in range(12):
        a = rng.getrandbits(64)
        for _ in range(12):
            a ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            nodes.add(a)
    signed = [x - (1 << 64) if x >> 63 else x for x in nodes]
    fps = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(fps, radius, n).collect()}
    full = (1 << 64) - 1
    assert pairs == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & full).bit_count() <= radius}


def test_crowded_buckets_connect_without_pairs(spark):
    rng = random.Random(9)
    center = rng.getrandbits(62)
    nodes = sorted({center ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 3))) for _ in range(400)} | {center ^ (0b11111 << 50), 7})
    fps = spark.createDataFrame([(x,) for x in nodes], "fp bigint")
    from tenderlens.llm.common import components

    edges = simhash.links(fps, 4, crowded_from=50)
    assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() == 0
    got = {r.node: r.root for r in components(edges).collect()}
    want = plain_components(nodes, 4)
    assert {n: got.get(n, n) for n in nodes} == want


def test_components_of_chains_and_stars(spark):
    from tenderlens.llm.common import components

    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001), (5001, 5000), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {5000: 5000, 5001: 5000}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_a_hot_group_is_split(spark):
    rows = spark.range(0, 60_000, 1, 8).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("fp"), F.when(
        F.col("id") % 10 < 6, F.lit(7)).otherwise(F.xxhash64("id")).alias("root"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
                                           "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.shuffle.partitions",
                                           "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(keep, ("64k", "32k", "-1", "1.5", "16", "64k", "4k")):
            spark.conf.set(k, v)
        got = simhash.component_ids(written(rows, "labelled"))
        found = got.collect()
        assert len(found) == 60_000 and sum(r.component_id == 0 for r in found) == 36_000
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
