"""The trie of conversations against a plain one."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlens.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, steps int, digest string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_convs(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: tuple((r, t) for *_, r, t in sorted(v)) for c, v in convs.items()}


def plain_trie(convs):
    nodes = {}
    for c, path in convs.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        childless = lambda p: not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in nodes)
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                    sum(len(q) == len(path) + 1 and q[:len(path)] == path for q in nodes), sum(map(childless, below)),
                    sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def random_rows(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c * 3 - 20, t, rng.choice(["user", None]), rng.choice(["é", "b" * 7, "", None]) if rng.random() < 0.9 else str(c)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("block_turns", [1, 7, 40, 1 << 17])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_trie(spark, seed, block_turns):
    """Blocks of any size, hence spines shared over many blocks and tasks, give the same nodes."""
    rows = random_rows(seed)
    convs = prefix_trie.conversations(frame(spark, rows).repartition(3))
    assert got(prefix_trie.prefix_trie(convs, block_turns)) == plain_trie(plain_convs(rows))


def test_copies_over_many_blocks(spark):
    """The ids that end at one node are digested in order over all blocks that hold them."""
    rows = [(c, t, "user", "same") for c in range(300) for t in range(2)] + [(c, t, "user", "same") for c in range(300, 310) for t in range(4)]
    convs = prefix_trie.conversations(frame(spark, rows))
    assert got(prefix_trie.prefix_trie(convs, 16)) == plain_trie(plain_convs(rows))


def test_defined_cases(spark):
    rows = [(1, None, None, None), (1, None, "b", "x"), (1, 0, "a", "y"), (1, 0, "a", "y"), (2, 0, "", ""), (None, 0, "user", "lost"),
            (3, 5, "user", "ab"), (4, 5, "use", "rab"), (5, 1, "user", "z" * 300_000), (6, 1, "user", "z" * 300_000)]
    assert got(prefix_trie.prefix_trie(prefix_trie.conversations(frame(spark, rows)))) == plain_trie(plain_convs(rows))
    assert prefix_trie.prefix_trie(prefix_trie.conversations(frame(spark, []))).count() == 0
    only = prefix_trie.prefix_trie(prefix_trie.conversations(frame(spark, [(9, 0, "a", "b")])).withColumn("steps", F.slice("steps", 1, 0)))
    assert got(only) == plain_trie({9: ()})


@pytest.mark.parametrize("seed", range(4))
def test_findclose(seed):
    rng = random.Random(seed)
    opens, depth = [True], 1
    for _ in range(rng.choice([0, 10, 3000, 70_000])):
        up = depth == 1 or rng.random() < 0.5
        opens.append(up)
        depth += 1 if up else -1
    opens = np.array(opens + [False] * depth)
    stack, want = [], {}
    for i, up in enumerate(opens.tolist()):
        if up:
            stack.append(i)
        else:
            want[stack.pop()] = i
    tree = prefix_trie.Parentheses(opens)
    at = np.flatnonzero(opens)
    close = tree.findclose(at)
    assert close.tolist() == [want[i] for i in at.tolist()]
    leaf = [opens[i] and not opens[i + 1] for i in range(len(opens) - 1)]
    for i in rng.sample(range(len(at)), min(len(at), 50)):
        assert tree.leaf_pairs(at[i:i + 1], close[i:i + 1])[0] == sum(leaf[at[i]:close[i]])


def test_registered(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own, built = plain_convs(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, ())[:h] + turns[h:]
    df = queries.op12_conversation_prefix_trie(spark, SF)
    assert df.columns[:8] == COLUMNS and got(df) == plain_trie(built)
    assert all(t == "bigint" for c, t in df.dtypes if c != "ends_sha256")


def test_forks_without_a_head(spark):
    rows = [(7, t, "user", str(t)) for t in range(12)] + [(5, 0, "user", "five")] + [(13, 0, "user", "thirteen")]
    convs = prefix_trie.forked(prefix_trie.conversations(frame(spark, rows)), 5, F.lit(3))
    want = plain_convs(rows)
    want = {7: want[5] + want[7][3:], 5: want[5], 13: ()}
    assert got(prefix_trie.prefix_trie(convs)) == plain_trie(want)
