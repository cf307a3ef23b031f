r"""Phrase collocations by Toivonen's mining: a sample proposes, one pass over everything counts, failures are followed up.

A sample of the documents (one in `share`) is mined level by level with a lowered threshold. What it finds frequent is the
set proposed; its negative border are the phrases outside it whose shorter parts all lie in it. One pass over all documents
then counts the proposed and the border exactly: at each place of a text a phrase is counted if both its parts, without
the last and without the first word, are proposed. Occurrences of a phrase are never more than those of its parts, so what
this pass leaves out can only be frequent if a border phrase is. Those border failures trigger a further pass, which counts
every phrase with a failure inside it whose other parts are proposed, and so on until a pass has no failures. What a pass
leaves uncounted holds a failure not yet followed up, so one such pass closes the search: its phrases need no border of
their own. The outcome never depends on the sample, which is itself mined level by level.

Tasks know the proposed set as a Bloom filter of fixed size, the only thing broadcast. A false positive counts as proposed
everywhere, in the counting and in the search for failures, so it costs counts and never changes one. Texts are cut into
words and counted per slice with numpy by (word, word, ...) numbers, without hashing; slices are summed by Spark's
aggregation. Words are runs of [^\x20\x09] within pieces between [.,;:!?\x0A-\x0D]; only A-Z are lower-cased.

Defined cases: null and empty texts have no words; a null group is `und`; repeated rows count each; texts of any length are
worked on in chunks, the words around a cut carried over; an empty table has no phrases; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderlens.llm.common import drop_written, slices, written

BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
CHUNK_BYTES = 4 << 20
#: Bits of the filter: beyond some ten million proposed phrases it lets more through, which costs counts only.
FILTER_BITS = 1 << 27
SEGMENT_BITS = 1 << 20
PROBES = 3
#: Buckets in which the best of a group are chosen before the group's best are.
BUCKETS = 64
NO_GROUP = "und"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _extend(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase that is one word longer."""
    h = (h ^ word) * _ODD
    h ^= h >> np.uint64(29)
    return h * _ODD + word


def _seed(group: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(group.encode(), 1))


def phrase_hashes(groups: list[str], phrases: list[str]) -> np.ndarray:
    out = np.empty(len(phrases), np.uint64)
    with np.errstate(over="ignore"):
        for i, (g, p) in enumerate(zip(groups, phrases)):
            h = _seed(g)
            for w in p.encode().split(b" "):
                h = _extend(h, np.uint64(_word_hash(w)))
            out[i] = h
    return out


def _slot(h: np.ndarray, r: int, bits: int) -> np.ndarray:
    return (h + np.uint64(r) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)


def holds(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through."""
    at = np.arange(len(h))
    for r in range(PROBES):  # each probe looks only at what the ones before let through
        s = _slot(h[at], r, len(filter_) * 8)
        at = at[(filter_[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(h), bool)
    out[at] = True
    return out


def chunks(texts: Iterator[bytes]) -> Iterator[tuple[bytes, int]]:
    """(bytes, words at the front that only lead in) of texts, short ones joined and long ones cut between words."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        if len(text) > CHUNK_BYTES:
            yield from _cut(text)
            continue
        if size + len(text) > CHUNK_BYTES and held:
            yield b"\n".join(held), 0
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield b"\n".join(held), 0


_GAP = re.compile(b"[" + re.escape(BREAKS + BLANKS) + b"]")
_BREAK = re.compile(b"[" + re.escape(BREAKS) + b"]")


def _cut(text: bytes, carried: int = 64) -> Iterator[tuple[bytes, int]]:
    at, lead = 0, []
    while at < len(text):
        gap = _GAP.search(text, min(at + CHUNK_BYTES, len(text)))
        end = gap.end() if gap else len(text)
        part = text[at:end]
        yield b" ".join([*lead, part]), len(lead)
        last = max((m.end() for m in _BREAK.finditer(part)), default=-1)
        tail = part[max(last, 0):].replace(b"\t", b" ").split()  # only blanks are left in it
        lead = tail[-carried:] if last >= 0 else (lead + tail)[-carried:]
        at = end


class Words:
    """The words of a chunk as numbers, and which of them follow one another within a piece."""

    def __init__(self, data: bytes):
        kind = _KIND[np.frombuffer(data, np.uint8)]
        word = kind == 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        self.n = len(start)
        offsets = np.zeros(self.n + 1, np.int64)
        np.cumsum(end - start, out=offsets[1:])
        compact = data.translate(_LOWER, BREAKS + BLANKS)
        coded = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(compact)]).dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary
        piece = np.searchsorted(np.flatnonzero(kind == 2), start)
        #: follows[i]: word i + 1 is in the piece of word i.
        self.follows = piece[1:] == piece[:-1] if self.n else np.zeros(0, bool)
        self.hashes = np.fromiter(map(_word_hash, self.words.to_pylist()), np.uint64, len(self.words))

    def eligible(self, proposed: np.ndarray, failures: np.ndarray | None, seed: np.uint64, most: int) -> list[np.ndarray]:
        """By length from 2 words on: at which places stands a phrase whose parts are all proposed.

        With failures, parts that are one or hold one count as proposed too, and only phrases with such a part are named:
        none of them can be eligible without the failures.
        """
        out = []

        def known(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            inside = holds(proposed, h)
            failed = np.zeros(len(h), bool)
            if failures is not None:
                rest = np.flatnonzero(~inside)
                failed[rest] = holds(failures, h[rest])
            return inside | failed, failed

        # A word's place in the filters is looked up once per distinct word.
        good, bad = (v[self.ids] for v in known(_extend(np.full(len(self.hashes), seed), self.hashes)))
        word = self.hashes[self.ids]
        h = _extend(np.full(self.n, seed), word)
        run = np.ones(self.n, bool)
        for k in range(2, most + 1):
            m = max(self.n - k + 1, 0)
            run = run[:m] & self.follows[k - 2:][:m]
            can = run & good[:m] & good[1:][:m]
            holding = can & (bad[:m] | bad[1:][:m])
            out.append(can if failures is None else holding)
            if k < most:
                h = _extend(h[:m], word[k - 1:][:m])
                at = np.flatnonzero(can)
                good, bad = np.zeros(m, bool), holding.copy()
                good[at], failed = known(h[at])
                bad[at] |= failed
                good |= holding
        return out

    def counted(self, at: np.ndarray, k: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
        """(a place of each distinct phrase of k words at the places given, its occurrences that end after the lead)."""
        at = at[at + k > lead]
        if not len(at):
            return at, at
        keys, room, size = [], 1 << 62, max(len(self.words), 1)
        for j in range(k):  # as many word numbers to a key as fit
            ids = self.ids[at + j]
            if room * size >= 1 << 62:
                keys.append(ids)
                room = size
            else:
                keys[-1] = keys[-1] * size + ids
                room *= size
        order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
        new = np.zeros(len(at), bool)
        new[0] = True
        for key in keys:
            key = key[order]
            new[1:] |= key[1:] != key[:-1]
        first = np.flatnonzero(new)
        return at[order[first]], np.diff(np.append(first, len(at)))

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        return pc.binary_join_element_wise(*[self.words.take(pa.array(self.ids[at + j])) for j in range(k)],
                                           pa.scalar(b" ", pa.large_binary())) if k > 1 else self.words.take(pa.array(self.ids[at]))


_ROWS = 1 << 16


def _rows(group: str, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Phrase and group as one string, as a phrase has no line end: a key of one column is cheaper to sum over."""
    keys = pc.binary_join_element_wise(phrases, pa.scalar(group.encode(), pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    for i in range(0, len(counts), _ROWS):
        key = keys.slice(i, _ROWS).cast(pa.large_string()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([key, pa.array(counts[i:i + _ROWS].astype(np.int64))], ["key", "f"])


def _count_chunk(group: str, data: bytes, lead: int, most: int, proposed: np.ndarray, failures: np.ndarray | None = None,
                 words_too: bool = True) -> Iterator[pa.RecordBatch]:
    w = Words(data)
    if w.n <= lead:
        return
    with np.errstate(over="ignore"):
        named = w.eligible(proposed, failures, _seed(group), most)
    if words_too:
        yield from _rows(group, pa.array([b""], pa.large_binary()), np.array([w.n - lead]))
        counts = np.bincount(w.ids[lead:], minlength=len(w.words))
        seen = np.flatnonzero(counts)
        yield from _rows(group, w.words.take(pa.array(seen)), counts[seen])
    for k, can in enumerate(named, 2):
        at, counts = w.counted(np.flatnonzero(can), k, lead)
        if len(at):
            yield from _rows(group, w.phrases(at, k), counts)


def counts(docs: DataFrame, least: int, most: int, proposed, failures=None, words_too: bool = True) -> DataFrame:
    """(grp, k, phrase, f) of every phrase that is eligible and occurs `least` times; proposed and failures are broadcasts.

    docs has grp and text (binary). With words_too, words (k = 1) and each group's number of words (k = 0, phrase empty, of
    whatever size) are counted as well.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = proposed.value, None if failures is None else failures.value
        for b in slices(batches, 1, CHUNK_BYTES):
            by: dict[str, list[bytes]] = {}
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    by.setdefault(g, []).append(t)
            for g, texts in by.items():
                for data, lead in chunks(iter(texts)):
                    yield from _count_chunk(g, data, lead, most, *filters, words_too)

    sums = docs.mapInArrow(work, "key string, f bigint").groupBy("key").agg(F.sum("f").alias("f")).where(
        (F.col("f") >= least) | F.col("key").startswith("\n"))
    phrase = F.substring_index("key", "\n", 1)
    return sums.select(F.expr("substring(key, instr(key, '\n') + 1)").alias("grp"), F.when(phrase == "", 0).otherwise(
        F.length(phrase) - F.length(F.translate(phrase, " ", "")) + 1).alias("k"), phrase.alias("phrase"), "f")


def _filter_of(phrases: DataFrame, bits: int, onto: np.ndarray | None = None) -> np.ndarray:
    """The filter of all phrases of (grp, phrase), and of those in `onto`; tasks fold one stretch of it each."""
    per = min(SEGMENT_BITS, bits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = phrase_hashes(b.column(0).to_pylist(), b.column(1).to_pylist())
            with np.errstate(over="ignore"):
                s = np.concatenate([_slot(h, r, bits) for r in range(PROBES)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((s // per).astype(np.int32)), pa.array((s % per).astype(np.int32))], ["segment", "bit"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            segment, bit = (c.to_numpy() for c in b.columns)
            for s in np.unique(segment).tolist():
                flags = parts.setdefault(s, np.zeros(per, bool))
                flags[bit[segment == s]] = True
        for s, flags in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()])],
                                             ["segment", "bits"])

    out = np.zeros(bits // 8, np.uint8) if onto is None else onto.copy()
    stretches = phrases.select("grp", "phrase").mapInArrow(place, "segment int, bit int").repartition("segment").mapInArrow(
        fold, "segment int, bits binary")
    for r in stretches.collect():  # together as long as the filter
        out[r.segment * per // 8:(r.segment + 1) * per // 8] |= np.frombuffer(r.bits, np.uint8)
    return out


def _outside(frequent: DataFrame, filter_, most: int) -> DataFrame:
    """The frequent phrases that the filter does not hold and that could grow: border failures."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with np.errstate(over="ignore"):
                out = ~holds(filter_.value, phrase_hashes(b.column(0).to_pylist(), b.column(1).to_pylist()))
            yield b.filter(pa.array(out))

    return frequent.where(F.col("k").between(1, most - 1)).select("grp", "phrase").mapInArrow(work, "grp string, phrase string")


def _level_by_level(docs: DataFrame, least: int, most: int, bits: int) -> np.ndarray:
    """The filter of all phrases of fewer than `most` words that occur `least` times."""
    context, found = docs.sparkSession.sparkContext, np.zeros(bits // 8, np.uint8)
    for k in range(1, most):
        filter_ = context.broadcast(found)
        # Phrases up to k - 1 words are in the filter already, so those of k words are all that is new.
        level = written(counts(docs, least, k, filter_, words_too=k == 1).where(F.col("k") == k), "phrase-level")
        found = _filter_of(level, bits, found)
        filter_.unpersist()
        drop_written(level)
    return found


def closed(docs: DataFrame, least: int, most: int, proposed: np.ndarray) -> tuple[list[DataFrame], int]:
    """(written tables of frequent phrases, passes over docs) from the proposed phrases on."""
    context = docs.sparkSession.sparkContext
    tables, passes, failures = [], 0, None
    filter_ = context.broadcast(proposed)
    while True:
        new = written(counts(docs, least, most, filter_, failures, words_too=passes == 0), "phrase-counts")
        tables.append(new)
        passes += 1
        if failures is not None:  # whatever holds a failure is counted now
            failures.unpersist()
            break
        failed = written(_outside(new, filter_, most), "border-failures")
        more = not failed.isEmpty()
        if more:
            failures = context.broadcast(_filter_of(failed, len(proposed) * 8))
        drop_written(failed)
        if not more:
            break
    filter_.unpersist()
    return tables, passes


def frequent_phrases(docs: DataFrame, least: int = 30, most: int = 4, share: int = 8, group_col: str = "lang", text_col: str = "text",
                     id_col: str = "doc_id", bits: int = FILTER_BITS) -> tuple[list[DataFrame], int]:
    """Written tables of (grp, k, phrase, f): all phrases of up to `most` words that occur `least` times in their group,
    and with k = 0 each group's number of words; and the passes over all documents that it took."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit(NO_GROUP)).alias("grp"), text.cast("binary").alias("text"),
                       F.pmod(F.xxhash64(F.col(id_col).cast("string"), text), F.lit(share)).alias("draw"))
    whole = rows.select("grp", "text")
    sample = written(rows.where("draw = 0").select("grp", "text"), "phrase-sample")
    lowered = max(2, -(-3 * least // (4 * share)))
    proposed = _level_by_level(sample, lowered, most, bits)
    drop_written(sample)
    return closed(whole, least, most, proposed)


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(frequent: DataFrame, top: int = 2000) -> DataFrame:
    """grp, rank, phrase, a, l, r, n, score: the `top` phrases of each group that hold together best at their weakest cut.

    A cut after the first words scores floor(2000000 a / (l + r)) with l and r the occurrences of both parts. A phrase goes
    if a longer one that holds it occurs at least 80 % as often; one word more is enough to look at, as longer ones are
    never more frequent.
    """
    phrases = frequent.where("k >= 1").select("grp", "phrase", "f")
    cand = frequent.where("k >= 2")
    cuts = cand.select("grp", "phrase", "f", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "grp", "phrase", "f", "cut", F.expr("substring_index(phrase, ' ', cut)").alias("head"),
        F.expr("substring_index(phrase, ' ', cut - k)").alias("rest"))
    heads = phrases.select("grp", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = phrases.select("grp", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(heads, ["grp", "head"]).join(rests, ["grp", "rest"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(f as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    weakest = both.groupBy("grp", "phrase").agg(F.max("f").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("w"))
    longer = cand.where("k >= 3").select("f", "grp", F.explode(F.array(
        F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase"))
    inside = longer.groupBy("grp", "phrase").agg(F.max("f").alias("held"))
    kept = weakest.join(inside, ["grp", "phrase"], "left").where(
        F.col("held").isNull() | (_wide(F.col("held")) * 5 < _wide(F.col("a")) * 4)).select(
        "grp", "phrase", "a", "w.l", "w.r", "w.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = Window.partitionBy("grp", "b").orderBy(*order)
    best = kept.withColumn("b", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).withColumn("at", F.row_number().over(bucket)).where(
        F.col("at") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("rank") <= top)
    words = frequent.where("k = 0").select("grp", F.col("f").alias("n"))
    return ranked.join(words, "grp").select("grp", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def top_collocations(docs: DataFrame, top: int = 2000, group_col: str = "lang", **mining) -> DataFrame:
    """collocations() of the frequent phrases of docs, written; what lies between is deleted."""
    tables, _ = frequent_phrases(docs, group_col=group_col, **mining)
    frequent = tables[0]
    for t in tables[1:]:
        frequent = frequent.unionByName(t)
    out = written(collocations(frequent, top), "collocations")
    for t in tables:
        drop_written(t)
    return out
