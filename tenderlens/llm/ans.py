"""Token ids in files coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over the whole corpus, serves all files. Documents are written in ascending order of id: Spark
deals them out by ranges, each task codes its range as frames of whole documents, and a frame's ids are cut into blocks of
BLOCK ids. A block is coded on its own by LANES interleaved states that share one stream of 32-bit words; at every
CHECKPOINT the states and the place in the stream are kept, so a block can be decoded from several places at once, and a
checksum per block tells damage. All lanes of all blocks of a frame, and when reading all stretches between checkpoints,
advance together in arrays.

    out/frames   part, frame, first (ids of the part before it), n_tokens, doc_ids, lengths, stream, begins (of each
                 block in the stream), states and places at the checkpoints, checksums
    out/index    part, base (ids of all parts before it)
    out/table    id, n, frequency (of 2 ** bits)

A frame is a row of a Parquet file, so writing is atomic, retried tasks leave nothing behind, and readers split by rows.

Defined cases: null and empty texts have the end id alone; repeated ids are ordered by what they hold; null ids come first; a
document of any length is in one frame; other columns are not read; an empty table writes no frame.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderlens.llm.common import clearing, cut_up, shared_path, slices, strung, written

BLOCK, LANES, CHECKPOINT = 1 << 14, 32, 1 << 12
FRAME = 1 << 20
#: Words a task remembers beside the library's own memory.
REMEMBERED = 400_000
#: Bytes of the longest word that is remembered.
LONGEST = 256
END = 2

_STEPS, _MARK = BLOCK // LANES, CHECKPOINT // LANES
_LOW, _WORD, _WORD_MASK = 31, np.uint64(32), np.uint64(0xFFFFFFFF)


class WordEncoder:
    """Ids of a lower-casing word vocabulary by the tokenizers library, which sees each word between blanks once.

    Such a vocabulary drops white space, so words between ASCII blanks are encoded independently, and its pattern parts
    letters, figures and punctuation, so words are cut there as well. Pieces that the pattern cannot part further are given
    to the library as one text, whose ids are cut where a word ends. Pieces that normalization leaves as they are go through
    the library without it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.normal = Tokenizer(self.library.model)
        self.normal.pre_tokenizer = self.library.pre_tokenizer
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.marks = re.compile(rb"[^a-zA-Z0-9'\s\x80-\xff]+").fullmatch
        ends = [t.endswith("</w>") for t, _ in sorted(self.library.get_vocab().items(), key=lambda x: x[1])]
        self.ends = np.array(ends, bool)

    def _ids(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(piece, its ids); ASCII pieces are in lower case."""
        plain, letters, lower, other = [], [], [], []
        for p in pieces:
            if p.isascii():  # normalization leaves it as it is
                (plain if p.isalpha() or self.marks(p) else lower).append(p)
            else:
                text = p.decode()
                whole = text.isalpha() and unicodedata.is_normalized("NFC", text)
                (other if not whole else plain if text.lower() == text else letters).append(p)
        for library, group in ((self.normal, plain), (self.library, letters)):
            for at in range(0, len(group), 1024):
                some = group[at:at + 1024]
                found, = library.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)
                ids = np.array(found.ids, self.kind)
                stop = np.flatnonzero(self.ends[ids]) + 1
                if len(stop) != len(some):  # a piece became several; asked one by one
                    other += some
                    continue
                raw, stop = ids.tobytes(), (stop * self.kind.itemsize).tolist()
                yield from zip(some, (raw[a:b] for a, b in zip([0, *stop], stop)))
        yield from zip(lower, self._library(lower, self.normal))
        yield from zip(other, self._library(other, self.library))

    def _library(self, texts: list[bytes], library) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 4096):  # what the library returns is many times the size of a word
            found = library.encode_batch_fast([t.decode() for t in texts[at:at + 4096]], add_special_tokens=False)
            out += [np.array(e.ids, self.kind).tobytes() for e in found]
        return out

    def encode_all(self, texts: list[bytes | None], last: bytes = b"") -> tuple[pa.Buffer, np.ndarray]:
        """The ids of all texts in a row, each with `last` after it, and the bytes at which each text's begin and all end."""
        known = self.known
        if len(known) > REMEMBERED:  # the words met first are mostly the frequent ones
            for word in list(islice(reversed(known), len(known) - REMEMBERED // 3)):
                del known[word]
        texts = [t or b"" for t in texts]
        marked = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        words, of, firsts = cut_up(texts, _places, marked)
        words = [w.strip() for w in words]
        new = {w for w in words if w not in known}
        if marked:
            whole = [w for w in new if any(s in w for s in self.special)]
            known.update(zip(whole, self._library(whole, self.library)))
        lower = {w: w.lower() if w.isascii() else w for w in new if w not in known}
        met = {p for p in lower.values() if p not in known}
        known.update(self._ids(list(met)))
        known.update((w, known[p]) for w, p in lower.items() if w != p)
        values = [*map(known.__getitem__, words), last]
        for word in new | met:
            if len(word) > LONGEST:
                del known[word]
        return strung(values, np.insert(of, firsts[1:], len(words)), firsts + np.arange(len(firsts)))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        data, at = self.encode_all(texts)
        return [data[a:b].to_pybytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


# What the vocabulary's pattern tells apart, of ASCII and of the characters of two and three bytes.
_OTHER, _LETTER, _FIGURE, _SIGN, _QUOTE, _BLANK = range(6)
_ASCII = np.array([_BLANK if chr(c) in " \t\n\v\f\r" else _LETTER if chr(c).isalpha() else _FIGURE if chr(c).isdigit() else _QUOTE
                   if chr(c) == "'" else _SIGN if 32 < c < 127 else _OTHER for c in range(128)] + [_OTHER] * 128, np.uint8)
_LETTERS = np.array([chr(c).isalpha() for c in range(1 << 16)])
# Whether a cut lies between two of them: wherever they differ, but for an apostrophe and what may belong to it.
_CUTS = ~np.eye(6, dtype=bool)
_CUTS[_OTHER], _CUTS[_BLANK], _CUTS[_QUOTE, [_SIGN, _LETTER]], _CUTS[_SIGN, _QUOTE] = False, False, False, False
_CUTS[:, _OTHER], _CUTS[_OTHER, _BLANK] = False, True
_CUTS = _CUTS.reshape(-1)


def _places(raw: np.ndarray) -> np.ndarray:
    """Where runs of ASCII blanks begin, which stay before the word, and where letters, figures and punctuation meet."""
    kinds = _ASCII[raw]
    for low, high, size in ((0xC2, 0xE0, 2), (0xE0, 0xF0, 3)):
        at = np.flatnonzero((raw >= low) & (raw < high))
        at = at[at <= len(raw) - size]
        code = raw[at] & (0xFF >> size + 1)
        for k in range(1, size):
            code = code.astype(np.int64) << 6 | raw[at + k] & 0x3F
        at = at[_LETTERS[code]]
        for k in range(size):
            kinds[at + k] = _LETTER
    return np.flatnonzero(_CUTS[kinds[:-1] * np.uint8(6) + kinds[1:]]) + 1


_encoders: dict[str, WordEncoder] = {}


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """doc_id, ids (little-endian 16-bit, or 32-bit for a vocabulary that needs it; the end id is appended); narrow."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _encoders.get(vocabulary) or _encoders.setdefault(vocabulary, WordEncoder(vocabulary))
        last = np.array([end], code.kind).tobytes()
        for b in slices(batches, 1, 4 << 20):
            data, at = code.encode_all(b.column(1).to_pylist(), last)
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(at), data])
            yield pa.RecordBatch.from_arrays([b.column(0), ids.cast(pa.binary())], ["doc_id", "ids"])

    text = F.col(text_col).cast("string").cast("binary")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).mapInArrow(work, "doc_id bigint, ids binary")


def counts(ids: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all documents: each task folds its own before the shuffle."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in slices(batches, 0):
            n = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=len(total))
            n[:len(total)] += total
            total = n
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64)), pa.array(total[there])], ["id", "n"])

    return ids.select("ids").mapInArrow(work, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


class Table:
    """Frequencies that add up to 2 ** bits; every id that occurs has one at least."""

    def __init__(self, ids: np.ndarray, n: np.ndarray):
        self.ids = ids
        self.bits = min(28, max(12, len(ids).bit_length() + 4))
        room = 1 << self.bits
        f = np.maximum(1, (n / max(1, n.sum()) * room).astype(np.int64)) if len(ids) else n
        order = np.argsort(-f, kind="stable")
        rest = room - int(f.sum()) if len(ids) else 0
        if rest > 0:
            f[order[0]] += rest
        while rest < 0:  # taken from the most frequent, a fair share each
            take = np.minimum(f[order] - 1, np.maximum(1, (f[order] * -rest) // room + 1))
            take = np.minimum(take, np.maximum(0, -rest - (np.cumsum(take) - take)))
            f[order] -= take
            rest += int(take.sum())
        self._set(f)

    def _set(self, f: np.ndarray) -> None:
        self.f = f
        size = int(self.ids.max()) + 1 if len(self.ids) else 0
        self.freq, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[self.ids] = f
        self.start[self.ids] = np.cumsum(f) - f

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each number below 2 ** bits: its id, the id's frequency, and its distance from the id's first number."""
        if not hasattr(self, "_slots"):
            ids = np.repeat(self.ids, self.f)
            self._slots = ids.astype(np.uint32), self.freq[ids], np.arange(len(ids), dtype=np.uint64) - self.start[ids]
        return self._slots

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "bits": self.bits, "f": self.f}

    def __setstate__(self, state: dict) -> None:
        self.ids, self.bits = state["ids"], state["bits"]
        self._set(state["f"])


def pack(ids: np.ndarray, table: Table) -> dict:
    """Code a frame: stream, begins, states and places at checkpoints, checksums. The most frequent id fills its last step."""
    n = len(ids)
    blocks = max(1, -(-n // BLOCK))
    grid = np.full(blocks * BLOCK, table.ids[table.f.argmax()], np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(blocks, _STEPS, LANES).transpose(1, 0, 2))
    freq, start = table.freq[grid], table.start[grid]
    bits, room = np.uint64(table.bits), np.uint64(32 + _LOW - table.bits)
    x = np.full((blocks, LANES), np.uint64(1 << _LOW))
    words = np.empty((_STEPS, blocks, LANES), np.uint32)
    out = np.zeros((_STEPS, blocks, LANES), bool)
    states = np.zeros((blocks, BLOCK // CHECKPOINT, LANES), np.uint64)
    for step in range(_STEPS - 1, -1, -1):
        k = blocks if (blocks - 1) * BLOCK + step * LANES < n else blocks - 1  # the last block begins when its ids do
        f, y = freq[step, :k], x[:k]
        full = (y >> room) >= f
        words[step, :k], out[step, :k] = y & _WORD_MASK, full
        y = np.where(full, y >> _WORD, y)
        q = y // f
        x[:k] = (q << bits) + (y - q * f) + start[step, :k]
        if step % _MARK == 0:
            states[:, step // _MARK] = x
    stream = [words[:, b][out[:, b]] for b in range(blocks)]
    begins = np.cumsum([0, *map(len, stream)])
    places = np.concatenate([np.zeros((1, blocks), np.int64), out.sum(2).cumsum(0)])[0:_STEPS:_MARK].T
    raw = [s.astype("<u4").tobytes() for s in stream]
    return {"stream": b"".join(raw), "begins": begins.astype("<u4").tobytes(), "states": states.astype("<u8").tobytes(),
            "places": places.astype("<u4").tobytes(), "checksums": np.array([zlib.crc32(r) for r in raw], "<u4").tobytes()}


def unpack(frame: dict, n: int, table: Table, blocks: range | None = None) -> np.ndarray:
    """The ids of a frame, or of some of its blocks, decoded from all checkpoints at once."""
    total = max(1, -(-n // BLOCK))
    chosen = np.arange(total)[blocks.start:blocks.stop] if blocks else np.arange(total)
    marks = BLOCK // CHECKPOINT
    begins, checks = np.frombuffer(frame["begins"], "<u4").astype(np.int64), np.frombuffer(frame["checksums"], "<u4")
    for b in chosen:
        if zlib.crc32(frame["stream"][4 * begins[b]:4 * begins[b + 1]]) != checks[b]:
            raise ValueError(f"block {b} of a frame is damaged")
    # Behind the last id a row goes on over zeros; what it finds there is cut off.
    stream = np.append(np.frombuffer(frame["stream"], "<u4").astype(np.uint64), np.zeros(CHECKPOINT + 1, np.uint64))
    rows = np.repeat(chosen, marks)
    x = np.frombuffer(frame["states"], "<u8").reshape(total, marks, LANES)[chosen].reshape(-1, LANES)
    at = begins[rows] + np.frombuffer(frame["places"], "<u4").astype(np.int64).reshape(total, marks)[chosen].reshape(-1) - 1
    (slots, freq, base), bits = table.slots(), np.uint64(table.bits)
    mask, least = np.uint64((1 << table.bits) - 1), np.uint64(1 << _LOW)
    got = np.empty((_MARK, len(rows), LANES), np.uint32)
    for step in range(_MARK):
        slot = x & mask
        got[step] = slots[slot]
        x = freq[slot] * (x >> bits) + base[slot]
        low = x < least
        take = np.cumsum(low, 1) + at[:, None]
        x = np.where(low, x << _WORD | stream[np.where(low, take, -1)], x)
        at = take[:, -1]
    flat = got.transpose(1, 0, 2).reshape(-1)
    held = np.minimum(BLOCK, n - BLOCK * chosen)
    if (held == BLOCK).all():
        return flat
    return np.concatenate([flat[i * BLOCK:i * BLOCK + k] for i, k in enumerate(held)])


_FRAME = ("part int, frame int, first bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, stream binary, "
          "begins binary, states binary, places binary, checksums binary")


def write(ids: DataFrame, vocabulary: str, out: str) -> None:
    """Write a table of encoded() as files below `out`, in ascending order of doc_id."""
    spark = ids.sparkSession
    kind = WordEncoder(vocabulary).kind.str
    rows = counts(ids, kind).orderBy("id").collect()  # at most the vocabulary
    table = Table(np.array([r.id for r in rows], np.int64), np.array([r.n for r in rows], np.int64))
    sent = spark.sparkContext.broadcast(table)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first = TaskContext.get().partitionId(), 0, 0
        docs, raw, size = [], [], 0

        def frame() -> pa.RecordBatch:
            nonlocal number, first, docs, raw, size
            flat = np.frombuffer(b"".join(raw), kind)
            made = pack(flat, sent.value)
            values = [part, number, first, len(flat), docs, [len(r) // np.dtype(kind).itemsize for r in raw], *made.values()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 5]
            number, first, docs, raw, size = number + 1, first + len(flat), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for b in slices(batches, 1):
            for doc, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs.append(doc)
                raw.append(x)
                size += len(x)
                if size >= FRAME * np.dtype(kind).itemsize:
                    yield frame()
        if docs:
            yield frame()

    names = [f.split(" ")[0] for f in _FRAME.split(", ")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(code, _FRAME).write.parquet(f"{out}/frames")
    sizes = spark.read.parquet(f"{out}/frames").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    bases = np.cumsum([0, *(r.n for r in sizes)]).tolist()
    spark.createDataFrame([(r.part, b) for r, b in zip(sizes, bases)], "part int, base bigint").write.parquet(f"{out}/index")
    spark.createDataFrame([(r.id, r.n, int(f)) for r, f in zip(rows, table.f)], "id bigint, n bigint, frequency bigint").write.parquet(f"{out}/table")


def read(spark: SparkSession, out: str, packed: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids of every document in the files; narrow.

    The ids are an array, or packed as little-endian 32-bit integers in a binary, which Spark moves at less cost.
    """
    table = Table.__new__(Table)
    rows = spark.read.parquet(f"{out}/table").orderBy("id").collect()
    f = np.array([r.frequency for r in rows], np.int64)
    table.__setstate__({"ids": np.array([r.id for r in rows], np.int64), "bits": int(f.sum()).bit_length() - 1 if len(f) else 12, "f": f})
    bases = {r.part: r.base for r in spark.read.parquet(f"{out}/index").collect()}
    sent = spark.sparkContext.broadcast((table, bases))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bases = sent.value
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(k)[i].as_py() for k, c in enumerate(b.schema.names)}
                ids = unpack(r, r["n_tokens"], table).view(np.int32)
                ends = np.cumsum([0, *r["lengths"]])
                if packed:
                    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [
                        None, pa.py_buffer(4 * ends), pa.py_buffer(ids.astype("<i4"))]).cast(pa.binary())
                else:
                    raw = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["doc_ids"], pa.int64()), pa.array(bases[r["part"]] + r["first"] + ends[:-1]), raw], ["doc_id", "start", "ids"])

    kind = "binary" if packed else "array<int>"
    return spark.read.parquet(f"{out}/frames").mapInArrow(decode, f"doc_id bigint, start bigint, ids {kind}")


def checksummed(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) of read()'s rows; narrow."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            if pa.types.is_binary(ids.type):
                crc = [zlib.crc32(x.as_buffer()) for x in ids]
                n = pc.binary_length(ids).to_numpy() // 4
            else:
                raw, at = ids.values.to_numpy().astype("<i4"), ids.offsets.to_numpy()
                crc, n = [zlib.crc32(raw[s:e]) for s, e in zip(at[:-1], at[1:])], np.diff(at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def store(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", out: str | None = None) -> str:
    """Encode all texts once, write them, and name the folder."""
    out = out or shared_path(docs.sparkSession, "token-files")
    with clearing():
        write(written(encoded(docs, vocabulary, id_col, text_col), "token-ids"), vocabulary, out)
    return out
