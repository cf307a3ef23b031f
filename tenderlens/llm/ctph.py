"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last eight bytes cuts a text wherever its low bits are zero: i bits make pieces of 2**i bytes on
average, wherever in the text they stand, so an edit disturbs only the pieces it touches. Each piece gives 12 bits of a
hash of all its windows. The block size is the smallest power of two, 4 or more, that makes at most 64 pieces; the
fingerprint holds the block size and the signatures at it and at twice it:

    size:signature:signature at twice the size

Fingerprints are compared where they have a block size in common, by the edit distance (insertions and deletions) of the
signatures there: likeness is one less the distance over both lengths. Without a common size it is zero.

Defined cases: null and empty texts have an empty fingerprint, which is like itself alone; equal texts have equal
fingerprints, whole texts are read; repeated ids are ordered by their texts; null ids come first; a single document is
its own successor; other columns are not read; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tenderlens.llm.common import slices, written

PIECES = 64
LEAST_LEVEL = 2
WINDOW = 8

_GAP = b"\0" * WINDOW
_TABLE = np.random.default_rng(9).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[0] = 0  # before its first byte a text's window is empty
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_PAIRS = np.stack([_LETTERS[np.arange(4096) >> 6], _LETTERS[np.arange(4096) & 63]], 1)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


class Prints:
    """Fingerprints of some texts: level (log2 of the block size) and codes of both signatures."""

    def __init__(self, texts: list[bytes]):
        n = len(texts)
        size = np.fromiter(map(len, texts), np.int64, n)
        end = np.cumsum(size + WINDOW)
        start = end - size
        raw = np.frombuffer(_GAP + _GAP.join(texts), np.uint8)
        roll = _TABLE[raw]
        for step in (1, 2, 4):
            earlier = roll[:-step] if len(roll) > step else roll[:0]
            roll = roll.copy()
            roll[step:] ^= _turn(earlier, 7 * step)
        roll = (roll ^ roll >> np.uint64(31)) * _MULTIPLY
        trigger = roll >> np.uint64(24)
        cut = np.flatnonzero((trigger & np.uint64((1 << LEAST_LEVEL) - 1)) == 0)
        owner = np.searchsorted(end, cut, "right")
        inside = (owner < n) & (cut >= start[np.minimum(owner, n - 1)]) if n else np.zeros(0, bool)
        cut, owner = cut[inside], owner[inside]
        t = trigger[cut] | np.uint64(1 << 39)
        height = np.bitwise_count((t & (~t + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        counts = np.bincount(owner * 40 + height, minlength=40 * n).reshape(n, 40)[:, ::-1].cumsum(1)[:, ::-1]
        # A remainder after the last cut makes one piece more.
        self.level = np.maximum((counts >= PIECES).sum(1), LEAST_LEVEL)
        self.sums = np.zeros(len(roll) + 1, np.uint64)
        np.cumsum(roll * _MULTIPLY ^ roll, out=self.sums[1:])
        self.first = self._codes(start, end, cut, owner, height >= self.level[owner])
        self.second = self._codes(start, end, cut, owner, height > self.level[owner])
        del self.sums

    def _codes(self, start, end, cut, owner, chosen) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all texts in a row, where each text's begin)."""
        full = np.flatnonzero(end > start)
        stop = np.concatenate([cut[chosen] + 1, end[full]])
        whose = np.concatenate([owner[chosen], full])
        order = np.lexsort((stop, whose))
        stop, whose = stop[order], whose[order]
        again = np.zeros(len(stop), bool)
        again[1:] = (stop[1:] == stop[:-1]) & (whose[1:] == whose[:-1])  # a cut at the very end
        stop, whose = stop[~again], whose[~again]
        begin = np.where(np.concatenate([[True], whose[1:] != whose[:-1]]), start[whose], np.concatenate([[0], stop[:-1]])) if len(stop) else stop
        h = self.sums[stop] - self.sums[begin]
        h = (h ^ h >> np.uint64(29)) * _MULTIPLY
        return (h >> np.uint64(52)).astype(np.uint16), np.searchsorted(whose, np.arange(len(start) + 1))

    def strings(self) -> list[str]:
        one, two = (_PAIRS[codes].tobytes().decode() for codes, _ in (self.first, self.second))
        a, b = self.first[1].tolist(), self.second[1].tolist()
        return [f"{1 << v}:{one[2 * a[i]:2 * a[i + 1]]}:{two[2 * b[i]:2 * b[i + 1]]}" for i, v in enumerate(self.level.tolist())]

    def padded(self, which: int, rows: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray]:
        codes, at = (self.first, self.second)[which]
        size = at[rows + 1] - at[rows]
        out = np.full((len(rows), PIECES), fill, np.int32)
        column = np.arange(PIECES)
        there = column < size[:, None]
        out[there] = codes[(at[rows][:, None] + column)[there]]
        return out, size


def common_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each row of a with that of b, bit-parallel over rows; padding never matches."""
    v = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(b.shape[1]):
        match = np.packbits(a == b[:, j:j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
        u = v & match
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def likeness(a: Prints, rows_a: np.ndarray, b: Prints, rows_b: np.ndarray) -> np.ndarray:
    """Likeness of each pair of fingerprints, 0 to 1."""
    out = np.zeros(len(rows_a))
    gap = a.level[rows_a] - b.level[rows_b]
    for apart, uses in ((0, ((0, 0), (1, 1))), (1, ((0, 1),)), (-1, ((1, 0),))):
        at = np.flatnonzero(gap == apart)
        for i, j in uses:
            (x, m), (y, n) = a.padded(i, rows_a[at], -1), b.padded(j, rows_b[at], -2)
            both = m + n
            like = np.where(both > 0, 2 * common_length(x, y) / np.maximum(both, 1), 1.0)
            out[at] = np.maximum(out[at], like) if (i, j) != (1, 1) else np.where(both > 0, np.maximum(out[at], like), out[at])
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of every row; narrow."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 2 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(Prints(b.column(1).to_pylist()).strings(), pa.string())], [id_col, "fingerprint"])

    return rows.mapInArrow(work, f"`{id_col}` {kind}, fingerprint string")


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
           ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _study(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    edited = []
    for text, after in zip(texts, following):
        cut = len(text) // 4
        edited.append((text[:len(text) - cut] + after[:cut]).encode())
    own, changed = Prints([t.encode() for t in texts]), Prints(edited)
    # Each row's successor is the next row but for the last one's.
    last = Prints([following[-1].encode()])
    every, n = np.arange(len(texts)), len(texts)
    near_next = np.concatenate([likeness(own, every[:-1], own, every[1:]), likeness(own, every[-1:], last, np.zeros(1, np.int64))])
    values = [ids, [len(t) for t in texts], [hashlib.sha256(e).hexdigest() for e in edited], own.strings(), changed.strings(),
              likeness(own, every, changed, every), near_next]
    return [pa.array(v, kind) for v, (_, kind) in zip(values, _FIELDS)]


def edited_study(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter the next document's beginning replaces.

    Documents are dealt out by ranges of ids and sorted there, so a task passes over its range once with one text in
    hand. The first and last document of each range are written beside the results; one small join then gives each
    last document the first one of the following range, and the very last one the first of all.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [n for n, _ in _FIELDS]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        ends = lambda role, row: pa.RecordBatch.from_arrays(
            [pa.array([row[0]], pa.int64()), *(pa.nulls(1, kind) for _, kind in _FIELDS[1:]), pa.array([part], pa.int32()),
             pa.array([role], pa.int32()), pa.array([row[1]], pa.string())], [*names, "part", "role", "text"])
        for b in slices(batches, 1, 2 << 20):
            new = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            if held is None:
                yield ends(1, new[0])
            else:
                new = [held, *new]
            held = new.pop()
            if new:
                texts = [t for _, t in new]
                arrays = _study([i for i, _ in new], texts, [*texts[1:], held[1]])
                k = len(new)
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([part] * k, pa.int32()), pa.array([0] * k, pa.int32()),
                                                  pa.nulls(k, pa.string())], [*names, "part", "role", "text"])
        if held is not None:
            yield ends(2, held)

    swept = written(rows.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(
        sweep, _SCHEMA + ", part int, role int, text string"), "swept")
    parts = sorted(r.part for r in swept.where("role = 1").select("part").collect())
    done = swept.where("role = 0").select(*names)
    if not parts:
        return done
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]])), "part int, following int")
    heads = swept.where("role = 1").select(F.col("part").alias("following"), F.col("text").alias("after"))
    tails = swept.where("role = 2").select("doc_id", "text", "part").join(follows, "part").join(heads, "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text, after in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_arrays(_study([i], [text], [after]), names)

    return done.unionByName(tails.select("doc_id", "text", "after").mapInArrow(finish, _SCHEMA))
