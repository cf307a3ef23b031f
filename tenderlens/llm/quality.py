r"""Quality scores by attention-based multiple-instance learning.

A text is a bag of passages of `PASSAGE` bytes. Every passage is encoded by what its bytes and words are like: shares of
signs, letters and cases, steps from one kind of sign to the next, lengths and repetition of words; a learned layer turns
that into a vector. Gated attention (a softmax over w . (tanh(V h) * sigmoid(U h))) weighs the passages, and a logistic
layer scores the weighted sum. Only whole documents have labels; which passages matter is learned from them.

Learning takes a bounded sample of labelled documents: at most `MOST_BAGS`, chosen by a hash of the id, with at most
`MOST_PASSAGES` passages each, evenly spaced. Features are computed where the texts lie; one task then fits the model, a
few thousand numbers, by gradient steps with a fixed seed. Scoring is narrow and reads every passage of every text.

Defined cases: null and empty texts are one passage without signs and get the score the model gives it; a very long text is
encoded stretch by stretch; repeated rows each get a score; without any usable label every score is 0.5; labels other
than 0 and 1 are not used and of several labels for one id the least holds; a null id is never learned from; other
columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tenderlens.llm.common import drop_written, slices, written

#: Bytes of a passage.
PASSAGE = 512
STRETCH = PASSAGE << 12
MOST_BAGS = 4096
MOST_PASSAGES = 64
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 40, 64, 4e-3, 1e-4

# Kinds of bytes: blank, line end, lower case, upper case, figure, each ASCII sign, first and other bytes of longer characters.
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_KIND = np.full(256, 5, np.uint8)
_KIND[[9, 32]] = 0
_KIND[[10, 11, 12, 13]] = 1
_KIND[97:123] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
_KIND[128:192] = 6
_KIND[192:] = 7
_KIND[list(_SIGNS)] = np.arange(8, 8 + len(_SIGNS))
KINDS = 8 + len(_SIGNS)
_COARSE = np.full(256, 5, np.uint8)
_COARSE[[9, 10, 11, 12, 13, 32]] = 0
_COARSE[97:123] = 1
_COARSE[65:91] = 2
_COARSE[48:58] = 3
_COARSE[128:] = 1
_COARSE[list(b".,;:!?'\"()-")] = 4
STEPS = 6
WORDS = 8
FEATURES = KINDS + STEPS * STEPS + WORDS


def _word_features(data: np.ndarray, blank: np.ndarray, n: int) -> np.ndarray:
    """Per passage: words, lengths, and how much they repeat."""
    inside = ~blank
    # A word ends with its passage too, so every passage is described by its own bytes.
    cut = np.zeros(len(data) + 1, bool)
    cut[::PASSAGE] = True
    before = np.append(False, inside[:-1])
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.append(inside[1:], False)
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    out = np.zeros((n, WORDS), np.float32)
    if not len(start):
        return out
    where, length = start // PASSAGE, end - start
    # A word's number: its bytes as a polynomial, from prefix sums; equal words have equal numbers.
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(PASSAGE, 0x9E3779B97F4A7C15 | 1, np.uint64))
        term = (data.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(data)) % PASSAGE]
        total = np.append(np.uint64(0), np.cumsum(term))
        value = (total[end] - total[start]) * power[(PASSAGE - 1 - start % PASSAGE)]
    value ^= length.astype(np.uint64) << np.uint64(52)
    order = np.lexsort((value, where))
    first = np.ones(len(order), bool)
    first[1:] = (value[order][1:] != value[order][:-1]) | (where[order][1:] != where[order][:-1])
    runs = np.diff(np.append(np.flatnonzero(first), len(order)))
    count = np.bincount(where, minlength=n).astype(np.float32)
    most = np.zeros(n, np.float32)
    np.maximum.at(most, where[order][first], runs)
    again = np.zeros(len(start), bool)
    again[1:] = (value[1:] == value[:-1]) & (where[1:] == where[:-1])
    safe = np.maximum(count, 1)
    out[:, 0] = np.log1p(count) / 5
    out[:, 1] = np.bincount(where, length, n) / safe / 10
    out[:, 2] = np.sqrt(np.bincount(where, length.astype(np.float64) ** 2, n) / safe) / 12
    out[:, 3] = np.bincount(where[order], first, n) / safe
    out[:, 4] = most / safe
    out[:, 5] = np.bincount(where, again, n) / safe
    out[:, 6] = np.bincount(where, length == 1, n) / safe
    out[:, 7] = np.bincount(where, length > 24, n) / safe
    return out


def _encode_stretch(data: bytes) -> np.ndarray:
    n = max(1, -(-len(data) // PASSAGE))
    out = np.zeros((n, FEATURES), np.float32)
    if not data:
        return out
    signs = np.frombuffer(data, np.uint8)
    where = np.arange(len(signs)) // PASSAGE
    size = np.minimum(PASSAGE, len(signs) - np.arange(n) * PASSAGE).astype(np.float32)[:, None]
    out[:, :KINDS] = np.sqrt(np.bincount(where * KINDS + _KIND[signs], minlength=n * KINDS).reshape(n, KINDS) / size)
    coarse = _COARSE[signs].astype(np.int64)
    step = where[1:] * (STEPS * STEPS) + coarse[:-1] * STEPS + coarse[1:]
    out[:, KINDS:KINDS + STEPS * STEPS] = np.sqrt(np.bincount(step, minlength=n * STEPS * STEPS).reshape(n, -1) / size)
    out[:, KINDS + STEPS * STEPS:] = _word_features(signs, coarse == 0, n)
    return out


def encode(text: bytes | None) -> np.ndarray:
    """Features of every passage of a text, one row each."""
    text = text or b""
    return np.concatenate([_encode_stretch(text[i:i + STRETCH]) for i in range(0, max(len(text), 1), STRETCH)])


# --- the model -----------------------------------------------------------------------------------------------------

_SHAPES = {"W": (FEATURES, HIDDEN), "c": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "o": (HIDDEN,), "b": (1,)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(m: dict, x: np.ndarray, starts: np.ndarray) -> dict:
    """Scores of bags that begin at `starts` in x, and all that the way back needs."""
    bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    x = (x - m["mean"]) * m["scale"]
    h = np.tanh(x @ m["W"] + m["c"])
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    a = (t * g) @ m["w"]
    e = np.exp(a - np.maximum.reduceat(a, starts)[bag])
    weight = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(weight[:, None] * h, starts)
    return {"x": x, "h": h, "t": t, "g": g, "weight": weight, "bag": bag, "z": z, "score": _sigmoid(z @ m["o"] + m["b"])}


def _gradient(m: dict, f: dict, y: np.ndarray, starts: np.ndarray) -> dict:
    d = (f["score"] - y) / len(y)
    dz = d[:, None] * m["o"]
    of_bag = dz[f["bag"]]
    dweight = (of_bag * f["h"]).sum(1)
    da = f["weight"] * (dweight - np.add.reduceat(f["weight"] * dweight, starts)[f["bag"]])
    dtg = da[:, None] * m["w"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["weight"][:, None] * of_bag + dt @ m["V"].T + dg @ m["U"].T) * (1 - f["h"] ** 2)
    return {"W": f["x"].T @ dh, "c": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ da,
            "o": f["z"].T @ d, "b": d.sum(keepdims=True)}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 13) -> dict:
    """The model of labelled bags, by Adam; the same bags in the same order give the same model."""
    rng = np.random.default_rng(seed)
    m = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in _SHAPES.items()}
    m["c"], m["b"] = np.zeros(HIDDEN), np.zeros(1)
    every = np.concatenate(bags)
    m["mean"] = every.mean(0).astype(np.float64)
    m["scale"] = 1 / (every.std(0).astype(np.float64) + 0.02)
    first, second = ({k: np.zeros(s) for k, s in _SHAPES.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for i in range(0, len(order), BATCH):
            part = order[i:i + BATCH]
            starts = np.cumsum([0] + [len(bags[j]) for j in part[:-1]])
            f = forward(m, np.concatenate([bags[j] for j in part]), starts)
            step += 1
            for k, grad in _gradient(m, f, labels[part], starts).items():
                grad = grad + DECAY * m[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad ** 2
                m[k] = m[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return m


def packed(m: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **m)
    return out.getvalue()


def unpacked(data: bytes) -> dict:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


# --- over tables ---------------------------------------------------------------------------------------------------

def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 after division by 3; a null id counts as held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 3 == 1, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          most_bags: int = MOST_BAGS, most_passages: int = MOST_PASSAGES) -> bytes | None:
    """The packed model, learned from labelled documents that are not held out; None without any."""
    by = F.xxhash64(F.col("id").cast("string"))
    # Never more than the bound is broadcast; of documents that share an id, those of the least hash.
    chosen = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")).where(
        ~held_out("id") & F.col("label").isin(0, 1)).groupBy("id").agg(F.min("label").alias("label")).orderBy(by, "id").limit(most_bags)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("draw")).join(
        F.broadcast(chosen), "id")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            kept = []
            for t in b.column(1).to_pylist():
                x = encode(t)
                at = np.unique(np.linspace(0, len(x) - 1, min(len(x), most_passages)).astype(int))
                kept.append(x[at].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(kept, pa.binary())], ["id", "draw", "label", "bag"])

    bags = written(rows.select("id", "text", "draw", "label").mapInArrow(bag, "id bigint, draw bigint, label int, bag binary"), "quality-bags")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(r["id"], r["draw"], r["label"], r["bag"]) for b in batches for r in b.to_pylist()]
        if found:
            found.sort(key=lambda r: r[:2])
            x = [np.frombuffer(r[3], np.float16).reshape(-1, FEATURES).astype(np.float32) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array([packed(fit(x, np.array([r[2] for r in found], float)))])], ["model"])

    model = bags.orderBy(by, "draw").limit(most_bags).coalesce(1).mapInArrow(train, "model binary").first()
    drop_written(bags)
    return None if model is None else model.model


def score(docs: DataFrame, model: bytes | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on), n_passages, top_passage (the one of greatest weight, from 0) of
    every row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    if model is None:
        size = F.coalesce(F.octet_length("text"), F.lit(0))
        return rows.select("doc_id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"),
                           F.greatest(F.lit(1), F.ceil(size / PASSAGE)).cast("bigint").alias("n_passages"),
                           F.lit(0).cast("bigint").alias("top_passage"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpacked(model)
        for b in slices(batches, 1, 2 << 20):
            bags = [encode(t) for t in b.column(1).to_pylist()]
            size = np.array([len(x) for x in bags])
            starts = np.cumsum(size) - size
            f = forward(m, np.concatenate(bags), starts)
            # The first passage of the greatest weight of its bag.
            top = np.full(len(bags), np.iinfo(np.int64).max)
            best = f["weight"] == np.maximum.reduceat(f["weight"], starts)[f["bag"]]
            np.minimum.at(top, f["bag"][best], np.flatnonzero(best))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(f["score"], pa.float64()), pa.array((f["score"] >= 0.5).astype(np.int32)),
                 pa.array(size.astype(np.int64)), pa.array((top - starts).astype(np.int64))],
                ["doc_id", "score", "predicted", "n_passages", "top_passage"])

    return rows.mapInArrow(work, "doc_id bigint, score double, predicted int, n_passages bigint, top_passage bigint")
