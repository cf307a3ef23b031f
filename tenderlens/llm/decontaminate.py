"""Benchmark passages in documents: CGK embedding, bit sampling over windows, exact edit verification.

Texts are sequences of words (letters and digits, ASCII case ignored). A CGK walk reads a sequence from a start on: at step j
it stands at a word, emits it, and moves on by one if bit j of that word's hash is set. Two sequences a few edits apart
soon walk in step again, so edit distance becomes Hamming distance between what they emit. A key is a few sampled
coordinates of a walk. Every suffix window of every item is entered under the keys of several walks; each document
word that begins such a window is walked the same way, and equal keys propose an alignment of the item. A window of the
item's size, and as many words more on either side as edits are allowed, is then aligned exactly.

With edits in a fifth of the words some stretch of a few words is untouched or back in step, and each word of an item
starts a window of its own; the recall this reaches is measured in tests/llm. Items of under ten words have too few windows
for that. At most one edit is allowed in them, so they are looked up whole or less one word, and none is missed. Items of
fewer than `min_words` words are not searched for, as common phrases would match them.

Items are handled in blocks of bounded size, each sent to the executors once; documents are never shuffled.

Defined cases: null and empty texts hold nothing; repeated documents or items give a row each; an item longer than the
document can match it only within the allowed edits; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderlens.llm.common import free_name, slices

SIMILARITY = 0.8
MIN_WORDS = 5
#: Walks, steps of each, keys sampled from each, words of a key beside its first.
WALKS, STEPS, KEYS, SAMPLED = 4, 14, 4, 4
#: Keys that have to agree on about one alignment before it is verified.
VOTES = 4
#: A key has to reach this far from its first word, else common pairs of words would match everywhere.
REACH = 3
#: Items of fewer words in which at most one edit is allowed are looked up by all their words but one.
SHORT = 10
#: Words of the items that are sent to the executors at once.
BLOCK_WORDS = 200_000

_BLANK = 32
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else _BLANK for b in range(256))
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15)]


def fold(text: bytes) -> bytes:
    """Letters and digits in lower case, everything else blank, byte for byte."""
    return text.translate(_FOLD)


def word_bounds(folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    inside = np.frombuffer(folded, np.uint8) != _BLANK
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def word_hashes(folded: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(folded, np.uint8)
    first = np.zeros(len(raw), np.int32)
    first[start] = start
    place = (np.arange(len(raw), dtype=np.int32) - np.maximum.accumulate(first)) & 63
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _PLACE[place], out=total[1:])
    return _scramble(total[end] - total[start] + (end - start).astype(np.uint64))


def _samples() -> list[tuple[int, list[int]]]:
    """(walk, sampled steps) of each key: near the start in some, further out in others."""
    rng = random.Random(7)
    return [(w, sorted(rng.sample(range(2, 7 + (STEPS - 7) * k // (KEYS - 1)), SAMPLED))) for w in range(WALKS) for k in range(KEYS)]


SAMPLES = _samples()


def window_keys(words: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each key: its values for windows that start at `at`, and where the walk stood at the last word it took."""
    steps = _scramble(words + _MIX[2])
    last = len(words) - 1
    for walk in range(WALKS):
        place, stood = at, {}
        for j in range(STEPS):
            stood[j] = place
            place = np.minimum(place + ((steps[place] >> np.uint64(walk * STEPS + j)) & np.uint64(1)).astype(np.int32), last)
        for number, (w, chosen) in enumerate(SAMPLES):
            if w == walk:
                key = words[at] + np.uint64(number)
                for j in chosen:
                    key = (key ^ (key >> np.uint64(31))) * _MIX[2] + words[stood[j]]
                yield _scramble(key), stood[chosen[-1]]


def _joined(words: np.ndarray, size: int, gap: int | None = None) -> np.ndarray:
    """A hash of the `size` words from each word on, without the one at `gap`."""
    n = max(0, len(words) - size + 1)
    key = np.full(n, _MIX[2])
    for j in range(size):
        if j != gap:
            key = (key ^ (key >> np.uint64(31))) * _MIX[0] + words[j:j + n]
    return _scramble(key)


class Index:
    """Keys of all windows of a block of items; of short items, the hashes of their words."""

    def __init__(self, items: list[tuple[int | None, str | None]], similarity: float, min_words: int):
        by_words: dict[tuple[bytes, ...], list] = {}
        for item, text in items:
            words = tuple(fold((text or "").encode()).split())
            if len(words) >= min_words:
                by_words.setdefault(words, []).append(item)
        self.words, self.ids = list(by_words), list(by_words.values())
        self.allowed = [int((1 - similarity) * len(w) + 1e-9) for w in self.words]
        self.slack = np.array(self.allowed, np.int64)
        keys, owners, offsets, firsts = [], [], [], []
        #: of short items, by (words of the stretch of text, the one of them left out): (hash, item)
        short: dict[tuple[int, int | None], list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            text = b" ".join(words)
            h = word_hashes(text, *word_bounds(text))
            firsts.append(h)
            if len(h) < SHORT and self.allowed[k] <= 1:
                _enter_short(short, k, h, self.allowed[k])
                continue
            at = np.arange(len(h), dtype=np.int32)
            padded = np.concatenate([h, np.zeros(1, np.uint64)])  # where the item ends, no key goes on
            for key, stood in window_keys(padded, at):
                good = (stood < len(h)) & (stood - at >= REACH)
                keys.append(key[good])
                owners.append(np.full(good.sum(), k, np.int32))
                offsets.append(at[good])
        none = np.zeros(0, np.uint64)
        key = np.concatenate([none, *keys])
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.owner = np.concatenate([np.zeros(0, np.int32), *owners])[order]
        self.offset = np.concatenate([np.zeros(0, np.int32), *offsets])[order]
        self.first = _bits(np.concatenate([none, *firsts]))
        self.maybe = _bits(self.key)
        self.short = {}
        for form, entries in short.items():
            entries.sort()
            self.short[form] = np.array([h for h, _ in entries], np.uint64), np.array([k for _, k in entries], np.int64)
        self.maybe_short = _bits(np.concatenate([none, *(hashes for hashes, _ in self.short.values())]))

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Rows (item, word of the text at which it would begin), unique and in order: those of short and of other items."""
        found = [self._voted(words)]
        for (size, gap), (hashes, owners) in self.short.items():
            key = _joined(words, size, gap)
            hit = np.flatnonzero(self.maybe_short[key >> np.uint64(42)])
            left = np.searchsorted(hashes, key[hit], "left")
            n = np.searchsorted(hashes, key[hit], "right") - left
            entry = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(np.stack([owners[entry], np.repeat(hit, n)], 1))
        return np.unique(np.concatenate(found), axis=0) if self.short else found[0]

    def _voted(self, words: np.ndarray) -> np.ndarray:
        """Rows that enough keys agree on within the edits."""
        at = np.flatnonzero(self.first[words >> np.uint64(42)]).astype(np.int32)
        found = []
        if len(at) and len(self.key):
            for key, stood in window_keys(words, at):
                hit = np.flatnonzero(self.maybe[key >> np.uint64(42)] & (stood - at >= REACH))
                left = np.searchsorted(self.key, key[hit], "left")
                n = np.searchsorted(self.key, key[hit], "right") - left
                hit, left, n = hit[n > 0], left[n > 0], n[n > 0]
                entry = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
                found.append(np.stack([self.owner[entry], np.repeat(at[hit], n) - self.offset[entry]], 1))
        if not found:
            return np.zeros((0, 2), np.int64)
        owner, place = np.concatenate(found).astype(np.int64).T
        spot, n = np.unique(owner << 40 | place + (1 << 32), return_counts=True)
        owner = spot >> 40
        slack = self.slack[owner]
        upto = np.cumsum(np.concatenate([[0], n]))
        votes = upto[np.searchsorted(spot, spot + slack, "right")] - upto[np.searchsorted(spot, spot - slack)]
        kept = votes >= VOTES
        return np.stack([owner[kept], (spot[kept] & ((1 << 40) - 1)) - (1 << 32)], 1)


def _enter_short(short: dict, k: int, words: np.ndarray, allowed: int) -> None:
    """Every form of text that is the item but for the allowed edit: its hash under the size and gap that show it."""
    m = len(words)

    def enter(size: int, gap: int | None, kept: np.ndarray) -> None:
        short.setdefault((size, gap), []).append((int(_joined(kept, len(kept))[0]), k))

    if not allowed or m == 1:
        enter(m, None, words)
        return
    for i in range(m):
        rest = np.delete(words, i)
        enter(m - 1, None, rest)  # a word lacks; with i at either end also the whole item, or another word there
        if 0 < i < m - 1:
            enter(m, i, rest)  # another word
        if i:
            enter(m + 1, i, words)  # a word more


def _bits(values: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 22, bool)
    table[values >> np.uint64(42)] = True
    return table


def align(item: tuple[bytes, ...], text: list[bytes]) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of the text nearest to the whole item: the first, then the longest of the best."""
    edits, end = _ends(item, text, free=True)
    back, size = _ends(item[::-1], text[:end][::-1], free=False)
    return edits, end - size, end


def _ends(item: tuple[bytes, ...], text: list[bytes], free: bool) -> tuple[int, int]:
    """Least edits between the item and text[:end], or any stretch that ends there if free; the first such end."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[bytes, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    up, down, score = full, 0, m
    best = (m, 0)
    for j, w in enumerate(text, 1):
        eq = where.get(w, 0)
        x = eq | down
        d = ((((x & up) + up) ^ up) | x) & full
        plus = (down | ~(d | up)) & full
        minus = up & d
        score += bool(plus & top) - bool(minus & top)
        plus = (plus << 1 | (not free)) & full
        minus = minus << 1 & full
        up = (minus | ~(d | plus)) & full
        down = plus & d
        if score < best[0]:
            best = (score, j)
    return best


def leaks_in(index: Index, texts: list[bytes | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item number, edits, start, end in bytes) of every stretch that is an item but for the allowed edits."""
    texts = [t or b"" for t in texts]
    folded = fold(b"\n".join(texts))
    start, end = word_bounds(folded)
    if not len(start):
        return
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first_word = np.searchsorted(start, begins)  # of each text; the last is the number of words
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    tried: dict[tuple[int, int], int] = {}
    for k, at in index.candidates(word_hashes(folded, start, end)).tolist():
        slack, size = index.allowed[k], len(index.words[k])
        inside = min(max(at + size // 2, 0), len(start) - 1)
        for probe in {min(max(at, 0), len(start) - 1), inside, min(max(at + size - 1, 0), len(start) - 1)}:
            doc = int(np.searchsorted(first_word, probe, "right")) - 1
            # A start before the first word of all texts is negative.
            if (doc, k) in tried and tried[doc, k] >= at:
                continue
            low, high = max(at - slack, int(first_word[doc])), min(at + size + 2 * slack, int(first_word[doc + 1]))
            if high <= low:
                continue
            tried[doc, k] = at + slack  # alignments that near are covered by this stretch
            words = [folded[a:b] for a, b in zip(start[low:high].tolist(), end[low:high].tolist())]
            edits, s, e = align(index.words[k], words)
            if edits <= slack:
                found.setdefault((doc, k), []).append((edits, low + s, low + e))
    for (doc, k), spans in found.items():
        taken: list[tuple[int, int]] = []
        for edits, s, e in sorted(spans):
            if all(e <= a or s >= b for a, b in taken):
                taken.append((s, e))
                yield doc, k, edits, int(start[s] - begins[doc]), int(end[e - 1] - begins[doc])


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS,
               block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, edits, n_words (of the item), similarity, start, end (code points) of each leaked passage."""
    return _passages(docs, items, id_col, text_col, item_col, item_text_col, similarity, min_words, block_words).drop("text_hash")


def _passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS,
              block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of find_leaks with text_hash, that of the whole document."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    total = asked.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    blocks = 1 + total // block_words
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_hash"))
    schema = "doc_id bigint, text_hash bigint, item_id bigint, edits int, n_words int, similarity double, start int, end int"

    def search(block: int) -> DataFrame:
        rows = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in rows], similarity, min_words))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 1, 2 << 20):
                ids, raw, hashes, out = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), []
                for doc, k, edits, s, e in leaks_in(index.value, raw):
                    size = len(index.value.words[k])
                    chars = len(raw[doc][:s].decode())
                    out += [(ids[doc], hashes[doc], item, edits, size, 1 - edits / size, chars, chars + len(raw[doc][s:e].decode()))
                            for item in index.value.ids[k]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 8, (
                    pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()))],
                    ["doc_id", "text_hash", "item_id", "edits", "n_words", "similarity", "start", "end"])

        return texts.mapInArrow(work, schema)

    return reduce(DataFrame.unionAll, [search(b) for b in range(blocks)])


def unsearched(items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """item_id, n_words of the items that find_leaks does not search for: those under min_words, null texts and texts without words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(fold(t or b"").split()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32())], ["item_id", "n_words"])

    asked = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).cast("string").cast("binary").alias("text"))
    return asked.mapInArrow(count, "item_id bigint, n_words int").where((F.col("n_words") < min_words) | (F.col("n_words") == 0))


def drop_leaking(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of docs, all columns, whose own text holds no item: ids may be null or repeat."""
    leak, leak_hash = free_name(docs, "_leak"), free_name(docs, "_leak_hash")
    found = _passages(docs, items, id_col, text_col, **options).select(
        F.col("doc_id").alias(leak), F.col("text_hash").alias(leak_hash)).distinct()
    return docs.join(found, F.col(id_col).cast("bigint").eqNullSafe(F.col(leak))
                     & (F.xxhash64(F.col(text_col).cast("string")) == F.col(leak_hash)), "left_anti")
