"""Language identification with n-gram filters that answer for all languages at once.

A Bloom filter per language would be asked once per language. Here the filters are bit-sliced: position p of the table
holds one bit per language, so the AND of an n-gram's k positions is the set of all languages that contain it. A text's
n-grams are looked up together, the set bits are counted per language, and each count is corrected for the share of
strangers that its slice lets through (its fill to the power of k). The language with the largest corrected share wins;
that share is the score.

N-grams are 3 to 5 bytes of lower-cased words with a blank on either side. A language learns those that at least
`MIN_RATE` of its sampled documents hold, unless another language holds them `DOMINANCE` times as often. At most
1 / MIN_RATE times the n-grams of a mean document can reach that rate, so the table's size is bounded. The sample is bounded
too: about PER_LANGUAGE documents of each language, chosen by a hash of their id.

Defined cases: null texts and texts without a letter are `und` with score 0; texts without any known n-gram get the most
frequent language with score 0; if nothing can be learned all is `und`; whole texts are read, whatever their length;
repeated rows are rows each; null ids are not learned from and not held out; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from tenderlens.llm.common import slices

ORDERS = (3, 4, 5)
PER_LANGUAGE = 4_000
MIN_RATE = 0.02
DOMINANCE = 4
HASHES = 3
#: Table positions for each entered n-gram.
ROOM = 8
UNKNOWN = "und"
#: Bytes of text looked up at once: their n-grams take about a hundred times as many.
SLICE = 1 << 19

_LETTER = regex.compile(r"\p{L}").search
_BLANK_ASCII = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, number of its text) of all n-grams, repeats included."""
    parts = [b" ".join(t.lower().encode().translate(_BLANK_ASCII).split()) for t in texts]
    raw = np.frombuffer(b" " + b" \0 ".join(parts) + b" ", np.uint8)
    begins = np.cumsum([0, *(len(p) + 3 for p in parts)])[:-1]
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), np.diff([*begins, len(raw)]))
    wide, solid = raw.astype(np.uint64), (raw != 32) & (raw != 0)
    found, whose = [], []
    for n in ORDERS:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        inner = solid[1:m + 1].copy()
        for i in range(2, n - 1):
            inner &= solid[i:m + i]
        at = np.flatnonzero(inner)
        value = np.full(len(at), n, np.uint64)
        for i in range(n):
            value = value << np.uint64(8) | wide[at + i]
        found.append(value)
        whose.append(owner[at])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *found]), np.concatenate([np.zeros(0, np.int32), *whose])


class Model:
    """Bit-sliced filters of the learned languages."""

    def __init__(self, languages: list[str], entries: list[tuple[int, list[str]]]):
        """languages: from the most frequent on; entries: an n-gram and the languages that hold it."""
        self.languages = languages
        total = sum(len(has) for _, has in entries)
        self.size = 1 << max(10, (ROOM * total - 1).bit_length()) if total else 1 << 10
        number = {x: i for i, x in enumerate(languages)}
        self.planes = np.zeros(((len(languages) + 7) // 8, self.size), np.uint8)
        for k, language in enumerate(languages):
            mine = np.array([g for g, has in entries if language in has], np.uint64)
            plane = self.planes[number[language] // 8]
            for p in self.positions(mine):
                plane[p] |= np.uint8(1 << k % 8)
        fill = np.array([(self.planes[k // 8] >> (k % 8) & 1).mean() for k in range(len(languages))])
        self.strangers = fill ** HASHES

    def positions(self, values: np.ndarray) -> Iterator[np.ndarray]:
        h = (values ^ (values >> np.uint64(23))) * _MIX[0]
        h = (h ^ (h >> np.uint64(29))) * _MIX[1]
        step = (h * _MIX[2]) >> np.uint64(32) | np.uint64(1)
        for i in range(HASHES):
            yield ((h >> np.uint64(20)) + np.uint64(i) * step) & np.uint64(self.size - 1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [i for i, t in enumerate(texts) if t and _LETTER(t)]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not known or not self.languages:
            return out
        values, owner = grams([texts[i] for i in known])
        total = np.maximum(np.bincount(owner, minlength=len(known)), 1)
        places = list(self.positions(values))
        counts = np.zeros((len(known), 8 * len(self.planes)))
        for k, plane in enumerate(self.planes):
            has = plane[places[0]]
            for p in places[1:]:
                has = has & plane[p]
            sets = np.bincount(owner.astype(np.int64) << 8 | has, minlength=len(known) << 8).reshape(len(known), 256)
            counts[:, 8 * k:8 * k + 8] = sets @ (np.arange(256)[:, None] >> np.arange(8) & 1)
        share = counts[:, :len(self.languages)] / total[:, None]
        share = np.clip((share - self.strangers) / (1 - self.strangers), 0, 1)
        for row, i in enumerate(known):
            best = int(share[row].argmax())
            out[i] = (self.languages[best], float(share[row, best]))
        return out


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model:
    """A model of the documents that are not held out and whose language is given."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"),
                       held_out(id_col).alias("out")).where("not out and id is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], [])
    scale = 1 << 30
    shares = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(scale, scale * per_language // n))])
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(5), F.col("id")), F.lit(scale)) < shares[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)

        def folded(lang: str) -> tuple[np.ndarray, np.ndarray]:
            values, n = (np.concatenate(x) for x in zip(*held[lang]))
            unique, back = np.unique(values, return_inverse=True)
            return unique, np.bincount(back, n, len(unique)).astype(np.int64)

        for b in slices(batches, 1, SLICE):
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in set(langs):
                mine = [t or "" for x, t in zip(langs, texts) if x == lang]
                values, owner = grams(mine)
                # Once per document.
                order = np.lexsort((values, owner))
                values, owner = values[order], owner[order]
                first = np.ones(len(values), bool)
                first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
                held[lang].append(np.unique(values[first], return_counts=True))
                if len(held[lang]) >= 16:
                    held[lang] = [folded(lang)]
        for lang in held:
            values, n = folded(lang)
            values = values.astype(np.int64)
            for at in range(0, len(values), 1 << 16):
                v = values[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v)), pa.array(v), pa.array(n[at:at + (1 << 16)])],
                                                 ["lang", "gram", "n"])

    counted = chosen.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    docs_of = {r.lang: r.n for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not docs_of:
        return Model([], [])
    of = F.create_map(*[F.lit(v) for kv in docs_of.items() for v in kv])
    rates = counted.select("gram", "lang", (F.col("n") / of[F.col("lang")]).alias("rate")).where(
        F.col("rate") >= MIN_RATE / DOMINANCE)
    entries = rates.groupBy("gram").agg(F.collect_list(F.struct("lang", "rate")).alias("r"), F.max("rate").alias("top")).where(
        F.col("top") >= MIN_RATE).select("gram", F.transform(F.filter("r", lambda r: (r["rate"] >= MIN_RATE) & (
            r["rate"] * DOMINANCE > F.col("top"))), lambda r: r["lang"]).alias("langs"))
    found = sorted((r.gram, r.langs) for r in entries.toLocalIterator())
    return Model(sorted(docs_of, key=lambda x: (-sizes[x], x)), found)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, lang_pred, score of every row; narrow."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    # A kept text goes to the tasks once.
    once = text_col in keep and docs.schema[text_col].dataType.simpleString() == "string"
    rows = docs.select(F.col(id_col), *keep, *([] if once else [F.col(text_col).cast("string").alias("_text")]))
    n = 1 + len(keep)
    at = rows.columns.index(text_col) if once else n
    names = [*rows.columns[:n], "lang_pred", "score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, SLICE):
            langs, scores = zip(*sent.value.predict(b.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return rows.mapInArrow(work, f"{schema}, lang_pred string, score double")
