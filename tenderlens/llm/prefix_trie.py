r"""Trie of conversation prefixes as balanced parentheses, in shards.

Conversations are dealt out by ranges of their turn digests, which is the order of a walk through the trie, and tasks
write them down in blocks of bounded size. A block holds its part of the trie as a sequence of parentheses, one pair per node,
beside plain arrays of ids, lengths and bytes. Everything asked of a node is read off that sequence:

* findclose, over a tree of the least excess per stretch of parentheses, delimits the node's subtree;
* the rank of "()" pairs counts its leaves; the place of its end among the conversations gives its members;
* cumulative arrays give the bytes of the members' turns and of the subtree's distinct turns: their difference is what
  sharing saves, as the sum of (members - 1) x bytes over the subtree is the bytes of all members less those of all nodes.

Only nodes on the way to a block's first and last conversation can continue in the next block, up to the turns that both
sides of the cut have in common. Each block counts what opens in it, so these shared spines merge by adding up; the
digest of a node's ids is carried on through its blocks in order, id by id, with no list of them in memory.

A turn is its role and text; equal means equal SHA-256 digests (128 bits) of both. Defined cases: turns are ordered by
number (null first), then role, then digest; null roles and texts are empty ones; repeated rows are turns each; rows
without a conversation id belong to none; other columns are not read; without conversations there are no nodes.
A conversation's digests (16 bytes a turn) are one row and must fit in a task; its texts are never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderlens.llm.common import drop_written, written

#: Turns after which a block ends with the conversation in hand.
BLOCK_TURNS = 1 << 17
#: Hex figures of a turn's digest.
DIGEST = 32
STRETCH = 256


# --- conversations -------------------------------------------------------------------------------------------------

def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """conv_id, steps (array of digest, bytes in order) of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    steps = F.struct("turn", "role", F.substring(F.sha2(said, 256), 1, DIGEST).alias("digest"),
                     F.octet_length("text").cast("bigint").alias("bytes"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(steps)).alias("t")).select(
        "conv_id", F.transform("t", lambda s: F.struct(s["digest"].alias("digest"), s["bytes"].alias("bytes"))).alias("steps"))


def forked(convs: DataFrame, every: int, own_from: Column) -> DataFrame:
    """Every conversation c with its first `own_from` turns (a column over conv_id) replaced by those of c - c % every."""
    heads = convs.select(F.col("conv_id").alias("head"), F.col("steps").alias("head_steps"))
    c = convs.withColumn("head", F.col("conv_id") - F.col("conv_id") % every).withColumn("own_from", own_from.cast("int"))
    none = F.array().cast(convs.schema["steps"].dataType)
    return c.join(heads, "head", "left").select("conv_id", F.concat(
        F.slice(F.coalesce("head_steps", none), F.lit(1), F.col("own_from")),
        F.when(F.size("steps") > F.col("own_from"), F.slice("steps", F.col("own_from") + 1, F.size("steps"))).otherwise(none)).alias("steps"))


# --- parentheses ---------------------------------------------------------------------------------------------------

class Parentheses:
    """A balanced sequence with a tree of the least excess per stretch."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        n = max(1, -(-len(opens) // STRETCH))
        leaves = 1 << max(0, (n - 1).bit_length())
        padded = np.full(leaves * STRETCH, np.iinfo(np.int64).max, np.int64)
        padded[:len(opens)] = self.excess
        self.stretches = padded.reshape(-1, STRETCH)
        self.least = np.full(2 * leaves, np.iinfo(np.int64).max, np.int64)
        self.least[leaves:] = self.stretches.min(1)
        for level in range(leaves.bit_length() - 2, -1, -1):
            at = np.arange(1 << level, 2 << level)
            self.least[at] = np.minimum(self.least[2 * at], self.least[2 * at + 1])
        self.leaves = leaves
        pairs = np.zeros(len(opens) + 1, np.int64)
        if len(opens) > 1:
            pairs[1:-1] = opens[:-1] & ~opens[1:]
        self.pairs = np.cumsum(pairs)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the first place after it where the excess falls below its own."""
        want = self.excess[at] - 1
        out = np.empty(len(at), np.int64)
        for i in range(0, len(at), 1 << 14):
            part = slice(i, i + (1 << 14))
            out[part] = self._close(at[part], want[part])
        return out

    def _close(self, at: np.ndarray, want: np.ndarray) -> np.ndarray:
        stretch = at // STRETCH
        below = (self.stretches[stretch] <= want[:, None]) & (np.arange(STRETCH) > (at % STRETCH)[:, None])
        here = below.any(1)
        out = stretch * STRETCH + below.argmax(1)
        far = np.flatnonzero(~here)
        if len(far):
            node, w = stretch[far] + self.leaves, want[far]
            # Up to the first right neighbour that falls low enough, then down to its first stretch that does.
            climbing = np.ones(len(far), bool)
            while climbing.any():
                right = climbing & (node % 2 == 0)
                found = np.zeros(len(far), bool)
                found[right] = self.least[node[right] + 1] <= w[right]
                node = np.where(found, node + 1, np.where(climbing, node // 2, node))
                climbing &= ~found
            while True:
                down = node < self.leaves
                if not down.any():
                    break
                left = 2 * node
                go_left = np.zeros(len(far), bool)
                go_left[down] = self.least[left[down]] <= w[down]
                node = np.where(down, np.where(go_left, left, left + 1), node)
            s = node - self.leaves
            out[far] = s * STRETCH + (self.stretches[s] <= w[:, None]).argmax(1)
        return out

    def leaf_pairs(self, at: np.ndarray, close: np.ndarray) -> np.ndarray:
        """How many "()" stand from each opening parenthesis to its closing one."""
        return self.pairs[close] - self.pairs[at]


def common_turns(a: str, b: str) -> int:
    """Turns that two keys have in common from the first on."""
    if a == b:
        return len(a) // DIGEST
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    differ = np.frombuffer(a[:n].encode(), np.uint8) != np.frombuffer(b[:n].encode(), np.uint8)
    return int(differ.argmax()) // DIGEST


# --- blocks --------------------------------------------------------------------------------------------------------

_BLOCK = ("block bigint, parens binary, n_parens bigint, ids binary, lengths binary, shared binary, bytes binary, totals binary, "
          "first_key string, last_key string, at_start boolean, at_end boolean, before int, after int")


class _Builder:
    """Sorted conversations into blocks: parentheses, ids, lengths, turns shared with the one before, bytes."""

    def __init__(self, number: int, before: int | None):
        self.number, self.before = number, before
        self.opens: list[np.ndarray] = [np.ones(1, bool)]
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.shared: list[int] = []
        self.totals: list[int] = []
        self.bytes: list[np.ndarray] = []
        self.first = self.last = None
        self.turns = 0

    def add(self, conv: int, key: str, sizes: np.ndarray) -> None:
        length = len(key) // DIGEST
        same = 0 if self.last is None else common_turns(self.last, key)
        closing = 0 if self.last is None else len(self.last) // DIGEST - same
        self.opens += [np.zeros(closing, bool), np.ones(length - same, bool)]
        self.ids.append(conv)
        self.lengths.append(length)
        self.shared.append(same)
        self.totals.append(int(sizes.sum()))
        self.bytes.append(sizes[same:])
        self.first = key if self.first is None else self.first
        self.last = key
        self.turns += length + 1

    def row(self, after: int | None) -> tuple:
        opens = np.concatenate([*self.opens, np.zeros(len(self.last) // DIGEST + 1, bool)])
        whole = lambda v: np.array(v, np.int64).tobytes()
        return (self.number, np.packbits(opens).tobytes(), len(opens), whole(self.ids), whole(self.lengths), whole(self.shared),
                np.concatenate([np.zeros(1, np.int64), *self.bytes]).astype(np.int64).tobytes(), whole(self.totals),
                self.first, self.last, self.before is None, after is None, self.before, after)


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("parens", pa.binary()), ("n_parens", pa.int64())]
                         + [(n, pa.binary()) for n in ("ids", "lengths", "shared", "bytes", "totals")]
                         + [("first_key", pa.string()), ("last_key", pa.string()), ("at_start", pa.bool_()), ("at_end", pa.bool_()),
                            ("before", pa.int32()), ("after", pa.int32())])


def blocks(convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The trie in blocks, numbered in its order. before and after, the turns in common with the neighbouring blocks, are
    null at the ends of a task's range."""
    keyed = convs.select("conv_id", F.array_join("steps.digest", "").alias("key"), F.col("steps.bytes").alias("sizes"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, build = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            sizes = batch.column(2)
            values, ends = sizes.values.to_numpy(zero_copy_only=False), sizes.offsets.to_numpy()
            for i, (conv, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if build is None:
                    build = _Builder(base, None)
                elif build.turns >= block_turns:
                    same = common_turns(build.last, key)
                    yield _arrow([build.row(same)], _BLOCK_ARROW)
                    build = _Builder(build.number + 1, same)
                build.add(conv, key, values[ends[i]:ends[i + 1]])
        if build is not None:
            yield _arrow([build.row(None)], _BLOCK_ARROW)

    return keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(work, _BLOCK)


def _seams(stored: DataFrame) -> dict[int, tuple[int | None, int | None]]:
    """block: (before, after) for the blocks at the ends of the tasks' ranges: two numbers per task, -1 where nothing follows."""
    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, other, -1 if k is None else common_turns(k, f)) for n, other, k, f in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.int32())], ["block", "previous", "same"])

    # One row per end of a task's range: as many as tasks, whatever the number of blocks.
    order = Window.orderBy("block", "start")
    ends = stored.where("at_start").select("block", F.lit(0).alias("start"), F.col("first_key").alias("key")).union(
        stored.where("at_end").select("block", F.lit(1).alias("start"), F.col("last_key").alias("key")))
    pairs = ends.select("block", "start", F.lag("block").over(order).alias("previous"), F.lag("key").over(order).alias("last_key"),
                        F.col("key").alias("first_key")).where("start = 0").select("block", "previous", "last_key", "first_key")
    out: dict[int, list] = {}
    for r in pairs.mapInArrow(common, "block bigint, previous bigint, same int").collect():
        out.setdefault(r.block, [None, None])[0] = r.same
        if r.previous is not None:
            out.setdefault(r.previous, [None, None])[1] = r.same
    return {k: tuple(v) for k, v in out.items()}


class Block:
    """What a stored block says of its nodes, in the order in which they open; node 0 is the root."""

    def __init__(self, row: dict, seams: dict):
        ends = seams.get(row["block"], (None, None))
        self.number = row["block"]
        self.before = row["before"] if row["before"] is not None else ends[0]
        self.after = row["after"] if row["after"] is not None else (-1 if ends[1] is None else ends[1])
        read = lambda name: np.frombuffer(row[name], np.int64)
        self.ids, self.lengths, self.shared, totals = (read(n) for n in ("ids", "lengths", "shared", "totals"))
        self.first_key, self.last_key = row["first_key"], row["last_key"]
        opens = np.unpackbits(np.frombuffer(row["parens"], np.uint8), count=row["n_parens"]).astype(bool)
        tree = Parentheses(opens)
        at = np.flatnonzero(opens)
        close = tree.findclose(at)
        n, convs = len(at), len(self.ids)
        self.depth = tree.excess[at] - 1
        size = (close - at + 1) // 2
        # Conversations: how many nodes each opens tells which one opened a node, and where its parentheses begin.
        opened = self.lengths - self.shared
        opened[0] += 1
        self.opener = np.repeat(np.arange(convs), opened)
        closes = np.concatenate([[0], self.lengths[:-1] - self.shared[1:]])
        begin = np.cumsum(closes + opened) - (closes + opened)
        until = np.searchsorted(begin, close, "right")  # one past the last conversation that begins before the end
        # The end itself stands among the closing parentheses of the conversation that comes next.
        until = np.where(close >= begin[-1] + closes[-1] + opened[-1], convs, until - 1)
        self.n_convs = until - self.opener
        spans = np.stack([self.opener, until], 1).ravel()
        self.conv_id = np.minimum.reduceat(np.append(self.ids, np.iinfo(np.int64).max), spans)[::2]
        # What opened before this block is not counted here again.
        own = np.ones(n, bool)
        own[:self.before + 1] = False
        self.own = own
        by_depth = self.depth * (n + 1) + np.arange(n)
        order = np.argsort(by_depth)
        seek = (self.depth - 1) * (n + 1) + np.arange(n)
        self.parent = order[np.maximum(np.searchsorted(by_depth[order], seek) - 1, 0)]
        self.parent[0] = -1
        self.n_children = np.bincount(self.parent[1:][own[1:]], minlength=n)
        leaves = tree.leaf_pairs(at, close)
        # The last conversation's node is no leaf yet if the next block goes on with it or below it.
        last_path = self._path(convs - 1)
        if self.after >= self.lengths[-1]:
            leaves[last_path] -= (size[last_path[-1]] == 1)
        self.n_leaves = leaves
        sizes = read("bytes")
        above = np.zeros(n, np.int64)  # bytes of the turns above a node
        level = np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max()) + 2))
        for start, stop in zip(level[:-1].tolist(), level[1:].tolist()):
            here = order[start:stop]
            above[here] = above[self.parent[here]] + sizes[self.parent[here]]
        said, distinct = np.append(0, np.cumsum(totals)), np.append(0, np.cumsum(np.where(own, sizes, 0)))
        first = np.arange(n)
        self.saved = said[until] - said[self.opener] - self.n_convs * above - (distinct[first + size] - distinct[first])
        # Conversations that end at a node follow its opener without a turn of their own.
        ends_here = self.lengths[self.opener] == self.depth
        run_end = np.append(np.flatnonzero(opened[1:] > 0) + 1, convs)
        stop = run_end[np.searchsorted(run_end, self.opener, "right")]
        self.ends = np.where(ends_here, stop, self.opener)
        # Nodes that other blocks go on with.
        self.left = np.arange(self.before + 1)
        self.right = last_path[:self.after + 1]
        self.is_shared = np.zeros(n, bool)
        self.is_shared[self.left] = True
        self.is_shared[self.right] = True

    def _path(self, conv: int) -> np.ndarray:
        """The nodes from the root to the end of a conversation."""
        last = np.full(self.lengths[conv] + 1, -1, np.int64)
        upto = int(np.searchsorted(self.opener, conv, "right"))
        seen = self.depth[:upto]
        inside = seen <= self.lengths[conv]
        # The last node opened at each depth is the one on the path.
        last[seen[inside]] = np.flatnonzero(inside)
        return last

    def said_ids(self, node: int) -> str:
        return ",".join(map(str, self.ids[self.opener[node]:self.ends[node]].tolist()))


def _path_keys(key: str, depth: int) -> list[str]:
    """Names of the nodes on the way along a key: digests of its beginnings."""
    h, out = hashlib.sha256(), []
    for d in range(depth + 1):
        out.append(h.hexdigest()[:DIGEST])
        h.update(key[d * DIGEST:(d + 1) * DIGEST].encode())
    return out


_PART = pa.schema([("name", pa.string()), ("above", pa.string()), ("block", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()),
                   ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                   ("ends", pa.string())])
_PART_SQL = ("name string, above string, block bigint, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
             "saved_tokens bigint, ends string")
_MERGED = pa.schema([f for f in _PART if f.name not in ("block", "ends")] + [("ends_sha256", pa.string())])
_MERGED_SQL = ("name string, above string, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
               "saved_tokens bigint, ends_sha256 string")
_NODE = pa.schema([(n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
                  + [("ends_sha256", pa.string())])
NODE_SQL = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
            "ends_sha256 string")


def _parts(stored: DataFrame, seams) -> DataFrame:
    """What each block counts of the nodes it shares."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch.slice(i, 1).to_pylist()[0], seams.value)
                names = {}
                for nodes, key in ((b.left, b.first_key), (b.right, b.last_key)):
                    keys = _path_keys(key, len(nodes) - 1)
                    names |= {int(n): (k, keys[d - 1] if d else None) for d, (n, k) in enumerate(zip(nodes, keys))}
                yield _arrow([(name, above, b.number, int(b.depth[n]), int(b.conv_id[n]), int(b.n_convs[n]), int(b.n_children[n]),
                               int(b.n_leaves[n]), int(b.saved[n]), b.said_ids(n)) for n, (name, above) in names.items()], _PART)

    return stored.mapInArrow(work, _PART_SQL)


def _merged(parts: DataFrame) -> DataFrame:
    """Shared nodes, added up over their blocks in order; one node at a time is in hand."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def close() -> None:
            if now is not None:
                done.append((now["name"], now["above"], now["depth"], now["conv_id"], now["n_convs"], now["n_children"], now["n_leaves"],
                             now["saved_tokens"], now["h"].hexdigest()))

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or r["name"] != now["name"]:
                    close()
                    now = {**r, "h": hashlib.sha256(r["ends"].encode())}
                    continue
                now["conv_id"] = min(now["conv_id"], r["conv_id"])
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    now[c] += r[c]
                if r["ends"]:
                    now["h"].update(("," if now["ends"] else "").encode() + r["ends"].encode())
                    now["ends"] = now["ends"] or "some"
            if len(done) >= 4096:
                yield _arrow(done, _MERGED)
                done = []
        close()
        if done:
            yield _arrow(done, _MERGED)

    return parts.repartition("name").sortWithinPartitions("name", "block").mapInArrow(work, _MERGED_SQL)


def _own_nodes(stored: DataFrame, seams) -> DataFrame:
    """Nodes that lie in one block alone; `spine` has the ids of the block's shared nodes by (depth, on the right)."""
    empty = hashlib.sha256(b"").hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = Block(row, seams.value)
                ids = b.conv_id.copy()
                known = {s["name"]: s["conv_id"] for s in row["spine"]}
                for nodes, key in ((b.left, b.first_key), (b.right, b.last_key)):
                    for n, name in zip(nodes, _path_keys(key, len(nodes) - 1)):
                        ids[n] = known[name]
                keep = np.flatnonzero(~b.is_shared)
                with_ends = b.ends[keep] > b.opener[keep]
                sha = [hashlib.sha256(b.said_ids(n).encode()).hexdigest() if e else empty for n, e in zip(keep.tolist(), with_ends.tolist())]
                parent = [ids[p] if p >= 0 else None for p in b.parent[keep].tolist()]
                for at in range(0, len(keep), 1 << 14):
                    k = keep[at:at + (1 << 14)]
                    cols = [b.conv_id[k], b.depth[k], parent[at:at + len(k)], b.n_convs[k], b.n_children[k], b.n_leaves[k], b.saved[k]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(sha[at:at + len(k)])], schema=_NODE)

    return stored.mapInArrow(work, NODE_SQL)


def prefix_trie(convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs has conv_id and steps (array of digest, bytes), one row a conversation.
    """
    context = convs.sparkSession.sparkContext
    stored = written(blocks(convs, block_turns), "trie-blocks")
    seams = context.broadcast(_seams(stored))
    parts = written(_parts(stored, seams), "trie-parts")
    merged = written(_merged(parts), "trie-spines")
    # Each block is handed the ids of its own shared nodes, at most two ways through the trie.
    spines = parts.select("name", "block").join(merged.select("name", "conv_id"), "name").groupBy("block").agg(
        F.collect_list(F.struct("name", "conv_id")).alias("spine"))
    none = F.array().cast("array<struct<name:string,conv_id:bigint>>")
    inside = _own_nodes(stored.join(spines, "block", "left").withColumn("spine", F.coalesce("spine", none)), seams)
    above = merged.select(F.col("name").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    between = merged.join(above, "above", "left").select(*NODE_SQL_NAMES)
    out = written(inside.unionByName(between), "trie-nodes")
    for t in (stored, parts, merged):
        drop_written(t)
    return out


NODE_SQL_NAMES = _NODE.names
