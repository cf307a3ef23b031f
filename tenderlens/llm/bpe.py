"""Byte-level BPE with a minimal acyclic transducer as lexicon.

The corpus' most frequent words are merged once and compiled, with their ids as output, into an automaton whose words
share prefixes and suffixes. Arcs carry increments whose sum along a word is the word's row in a table of ids, so equal
suffixes can share states although their outputs differ. The file lies in the shared folder, Spark hands it to every
executor, and each task maps it into memory. Words that are not in it are merged by rank, exactly.

A word is what stands between lone spaces, with the space before it: the pattern that splits text before the merges
never joins what a lone space parts. Other white space stays in the word and is split by the pattern itself. A batch of
texts is cut in arrays, and each distinct word of it is looked up once.

Defined cases: a null text is an empty one and has no ids; a text of any length is one row of work; repeated rows are
encoded each on their own; an empty corpus gives an empty lexicon. Strings of special tokens in a text become their id,
as the tokenizers library does by default.
"""

from __future__ import annotations

import heapq
import json
import mmap
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderlens.llm.common import cut_up, shared_path, slices, strung, written

#: Words in the lexicon and bytes in one of them: what the driver holds is bounded by their product.
LEXICON_WORDS = 1 << 16
WORD_BYTES = 48
#: Words a task remembers beside the lexicon.
REMEMBERED = 300_000
#: Bytes of the longest word that is remembered.
LONGEST = 256
#: Bytes of text that are encoded at once.
SLICE = 4 << 20

# White space as Unicode defines it, and the public pattern that splits text before the merges.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NEVER, _NONE = 1 << 60, (1 << 31) - 1
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_WIDE_BLANKS = [int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merger:
    """Merges of one vocabulary file; the same ids as the tokenizers library for any text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        byte_of = {c: bytes([b]) for b, c in enumerate(alphabet)}
        raw = lambda s: b"".join(byte_of[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in vocab.items():
            self.token[i] = raw(s)
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.single = [vocab[c] for c in alphabet]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: (left id, right id) as one number -> rank; rank -> id of both joined
        self.bits = len(self.token).bit_length()
        self.rank = {vocab[a] << self.bits | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.joined = [vocab[a + b] for a, b in pairs]
        first = self.single
        self.byte_rank = [[self.rank.get(a << self.bits | b, _NEVER) for b in first] for a in first]
        # The same tables for many pieces at once; the last key is above all pairs.
        keys = sorted(self.rank)
        self.keys = np.array([*keys, 1 << 62], np.int64)
        self.key_rank = np.array([*map(self.rank.__getitem__, keys), _NONE], np.int32)
        self.byte_ranks = np.minimum(np.array(self.byte_rank, np.int64), _NONE).astype(np.int32)
        self.first, self.becomes = np.array(first, np.int32), np.array(self.joined, np.int32)
        self.split = regex.compile(PATTERN).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def merge(self, word: bytes) -> list[int]:
        ids = [self.single[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        get, bits, joined, table = self.rank.get, self.bits, self.joined, self.byte_rank
        ranks = [table[a][b] for a, b in zip(word, word[1:])]
        while ranks and (r := min(ranks)) != _NEVER:
            i = ranks.index(r)
            ids[i] = joined[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << bits | ids[i], _NEVER)
            if i < len(ranks):
                ranks[i] = get(ids[i] << bits | ids[i + 1], _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over neighbours: n log n for a word of any length."""
        n, get, bits = len(ids), self.rank.get, self.bits
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << bits | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or get(ids[i] << bits | ids[j]) != r:
                continue
            ids[i], ids[j] = self.joined[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(ids[i] << bits | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(ids[h] << bits | ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [i for i in ids if i >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << self.bits | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.key_rank[at], _NONE)

    def _merge_alike(self, words: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(position, ids as 32-bit numbers) of words of one length: each step makes the next merge of every word left."""
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        rows, ids, ranks = np.arange(len(words)), self.first[raw], self.byte_ranks[raw[:, :-1], raw[:, 1:]]
        while len(rows):
            width = ids.shape[1]
            least = ranks.min(axis=1) if width > 1 else np.full(len(rows), _NONE, np.int32)
            done = least == _NONE
            if done.any():
                out = ids[done].astype(np.uint32).tobytes()
                yield from zip(rows[done].tolist(), (out[k:k + 4 * width] for k in range(0, len(out), 4 * width)))
                rows, ids, ranks, least = rows[~done], ids[~done], ranks[~done], least[~done]
                if not len(rows):
                    return
            every, at = np.arange(len(rows)), ranks.argmin(axis=1)  # the first of equal ones
            stay = np.ones(ids.shape, bool)
            stay[every, at + 1] = False
            ids[every, at] = self.becomes[least]
            ids = ids[stay].reshape(len(rows), width - 1)
            stay = np.ones(ranks.shape, bool)
            stay[every, at] = False
            ranks = ranks[stay].reshape(len(rows), width - 2)
            for some, pair in ((at > 0, at - 1), (at < width - 2, at)):
                some = np.flatnonzero(some)
                pair = pair[some]
                ranks[some, pair] = self._ranks(ids[some, pair], ids[some, pair + 1])

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """merge() of many words, as 32-bit numbers."""
        out, by_length = [b""] * len(words), {}
        for k, word in enumerate(words):
            by_length.setdefault(len(word), []).append(k)
        for length, group in by_length.items():
            if length > 48 or length < 2 or len(group) < 32:  # too few or too long to pay
                for k in group:
                    out[k] = np.array(self.merge(words[k]), np.uint32).tobytes()
                continue
            for at in range(0, len(group), 1 << 14):
                some = group[at:at + (1 << 14)]
                for k, ids in self._merge_alike([words[k] for k in some]):
                    out[some[k]] = ids
        return out

    def split_all(self, words: list[str]) -> Iterator[list[str]]:
        """split() of many words. Those between lone spaces go through the pattern as one text."""
        for at in range(0, len(words), 4096):
            some = words[at:at + 4096]
            lone = [w for w in some if w[0] == " " and not (w[1:2] or " ").isspace() and not w[-1].isspace()]
            pieces = self.split("".join(lone))
            stop = np.searchsorted(np.cumsum([*map(len, pieces)]), np.cumsum([*map(len, lone)])) + 1
            stop = stop.tolist()
            found = (pieces[a:b] for a, b in zip([0, *stop], stop))
            fits = dict(zip(lone, found))
            for w in some:
                yield fits[w] if w in fits else self.split(w)

    def word_ids(self, word: str, memory: dict[str, list[int]] | None = None) -> list[int]:
        """Ids of a word; pieces that words have in common are merged once as long as memory holds them."""
        memory = {} if memory is None else memory
        out = []
        for piece in self.split(word):
            if piece not in memory:
                memory[piece] = self.merge(piece.encode())
            out += memory[piece]
        return out


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """A file with the minimal automaton of the words, sorted and without repeats, and their ids."""
    entries = sorted(entries)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}

    def settle(path: list[tuple[int, int]], down_to: int) -> None:
        while len(path) > down_to:
            parent, label = path.pop()
            child = arcs[parent][label]
            shape = (final[child], tuple(arcs[child].items()))
            arcs[parent][label] = known.setdefault(shape, child)

    path: list[tuple[int, int]] = []
    previous = b""
    for word, _ in entries:
        common = next((i for i, (a, b) in enumerate(zip(word, previous)) if a != b), min(len(word), len(previous)))
        settle(path, common)
        state = 0 if not path else arcs[path[-1][0]][path[-1][1]]
        for label in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[state][label] = len(arcs) - 1
            path.append((state, label))
            state = len(arcs) - 1
        final[state] = True
        previous = word
    settle(path, 0)
    # States in the order of a walk from the start; words below each state from the last one back.
    order, number = [0], {0: 0}
    for s in order:
        for t in arcs[s].values():
            if t not in number:
                number[t] = len(order)
                order.append(t)
    below: dict[int, int] = {}
    stack = [(0, False)]
    while stack:
        s, done = stack.pop()
        if done:
            below[s] = final[s] + sum(below[t] for t in arcs[s].values())
        elif s not in below:
            stack.append((s, True))
            stack += [(t, False) for t in arcs[s].values() if t not in below]
    keys, targets, skips = [], [], []
    for s in order:
        passed = int(final[s])
        for label in sorted(arcs[s]):
            t = arcs[s][label]
            keys.append(number[s] << 8 | label)
            targets.append(number[t])
            skips.append(passed)
            passed += below[t]
    lengths = [len(ids) for _, ids in entries]
    tables = {
        "keys": np.array(keys, np.uint32), "targets": np.array(targets, np.uint32), "skips": np.array(skips, np.uint32),
        "final": np.array([final[s] for s in order], np.uint32), "starts": np.cumsum([0, *lengths]).astype(np.uint32),
        "ids": np.array([i for _, ids in entries for i in ids], np.uint32),
    }
    head = json.dumps({k: len(v) for k, v in tables.items()}).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(v.tobytes() for v in tables.values())


class Lexicon:
    """A file of compile_lexicon() mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at = data.find(b"\n") + 1
        for name, n in json.loads(data[:at]).items():
            setattr(self, name, np.frombuffer(data, np.uint32, n, at))
            at += 4 * n

    def find(self, words: list[bytes]) -> np.ndarray:
        """The row of each word, or -1: all words walk the automaton together, one byte a step."""
        rows = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return rows
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        at = np.nonzero((size > 0) & (size <= WORD_BYTES))[0]
        state, row = np.zeros(len(at), np.uint32), np.zeros(len(at), np.int64)
        for step in range(WORD_BYTES + 1):
            over = size[at] == step
            if over.any():
                hit = over & (self.final[state] == 1)
                rows[at[hit]] = row[hit]
                at, state, row = at[~over], state[~over], row[~over]
            if not len(at):
                break
            key = state << np.uint32(8) | text[start[at] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[arc] == key
            at, arc = at[there], arc[there]
            state, row = self.targets[arc], row[there] + self.skips[arc]
        return rows


def _lone_spaces(raw: np.ndarray) -> np.ndarray:
    """Where spaces stand that have no other white space, of any kind, beside them."""
    at = np.flatnonzero(raw == 32)
    at = at[(at > 0) & (at < len(raw) - 1)]
    near = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int32)
    after, before = near[at + 1], near[at - 1]
    lone = ~_BLANK[after] & ~_BLANK[before]
    wide = np.flatnonzero(lone & ((before >> 6 == 2) | (after >> 6 == 3)))  # characters of several bytes
    p = at[wide]
    two, three = near[p - 2] << 8 | near[p - 1], near[p - 3] << 16 | near[p - 2] << 8 | near[p - 1]
    next_two, next_three = near[p + 1] << 8 | near[p + 2], near[p + 1] << 16 | near[p + 2] << 8 | near[p + 3]
    lone[wide] = ~np.isin([two, three, next_two, next_three], _WIDE_BLANKS).any(axis=0)
    return at[lone]


class Encoder:
    """Ids of texts from the lexicon, what was merged before, and merges."""

    def __init__(self, merger: Merger, lexicon: Lexicon):
        self.merger, self.lexicon = merger, lexicon
        #: ids of words, most with a space before them; ids of pieces and special tokens, none of which is a piece
        self.words: dict[bytes, bytes] = {}
        self.pieces = {s: np.array([i], np.uint32).tobytes() for s, i in merger.special.items()}
        self.special = [s.encode() for s in merger.special]
        self.spaced = [s for s in self.special if b" " in s]
        self.token = pa.array(merger.token, pa.large_binary())

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and all end."""
        m, words, pieces = self.merger, self.words, self.pieces
        for memory in (words, pieces):
            if len(memory) > REMEMBERED:  # what was met first is mostly frequent
                for word in list(islice(reversed(memory), len(memory) - REMEMBERED // 3)):
                    del memory[word]
        texts = [(t or "").encode() for t in texts]
        uncut = [i for i, t in enumerate(texts) if any(s in t for s in self.spaced)] if self.spaced else []
        met, of, firsts = cut_up(texts, _lone_spaces, uncut)
        new = [w for w in met if w not in words]
        starts, ids = self.lexicon.starts.tolist(), self.lexicon.ids.tobytes()
        alone, rest, marked = [], [], {}
        special = any(s in t for t in texts for s in self.special)
        for w, row in zip(new, self.lexicon.find(new).tolist()):
            if row >= 0:
                words[w] = ids[4 * starts[row]:4 * starts[row + 1]]
            elif w.isascii() and w[w[:1] == b" ":].isalpha():  # one piece
                alone.append(w)
            elif special and any(s in w for s in self.special):
                marked[w] = [p for k, part in enumerate(m.parts(w.decode())) for p in ([part] if k % 2 else m.split(part))]
            else:
                rest.append(w)
        words.update(zip(alone, m.merge_all(alone)))
        parted = dict(zip(rest, m.split_all([w.decode() for w in rest]))) | marked
        unseen = list({p for parts in parted.values() for p in parts if p not in pieces})
        pieces.update(zip(unseen, m.merge_all([p.encode() for p in unseen])))
        for w, parts in parted.items():
            words[w] = b"".join(map(pieces.__getitem__, parts))
        data, at = strung([*map(words.__getitem__, met)], of, firsts)
        for memory, some in ((words, new), (pieces, unseen)):
            for word in some:
                if len(word) > LONGEST:
                    del memory[word]
        return np.frombuffer(data, np.uint32), at // 4

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, at = self.encode_all(texts)
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of ids that stand in a row."""
        data, at = strung(self.token, ids, at)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), data])
        try:
            return texts.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all(ids, np.array([0, len(ids)]))[0].as_py()


def frequent_words(docs: DataFrame, text_col: str = "text", words: int = LEXICON_WORDS) -> list[str]:
    """The words that occur most in all texts, counted over the whole corpus: at most `words`, rarely much fewer.

    Counts are folded in every task before their shuffle. A histogram of their logarithms, at most some thousand rows,
    gives the count from which on the words fit, so no task sorts them all.
    """
    pieces = docs.select(F.explode(F.split(F.col(text_col).cast("string"), " ")).alias("w"))
    counted = pieces.where(F.octet_length("w").between(1, WORD_BYTES - 1)).groupBy("w").agg(F.count("*").alias("n"))
    level = F.floor(F.log2("n") * 16).cast("int").alias("level")
    held = written(counted.where("n > 1").select("w", level), "word-counts")
    left, least = words, None
    for r in sorted(held.groupBy("level").count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r.level
    return [] if least is None else [r.w for r in held.where(F.col("level") >= least).select("w").collect()]


def build_lexicon(docs: DataFrame, vocabulary: str, text_col: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compile the corpus' frequent words; the name under which tasks find the file."""
    merger = Merger(vocabulary)
    chosen = {" " + w for w in frequent_words(docs, text_col, words)}
    chosen = {w for w in chosen if not any(s in w for s in merger.special)}
    data = compile_lexicon((w.encode(), merger.word_ids(w)) for w in chosen)
    return share_file(docs.sparkSession, data, "lexicon")


def share_file(spark: SparkSession, data: bytes, purpose: str) -> str:
    """Write a file of bounded size to the shared folder and have Spark bring it to every executor."""
    place = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, purpose))
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    for at in range(0, len(data), 1 << 20):
        out.write(bytearray(data[at:at + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(place.toString())
    return place.getName()


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str, lexicon: str) -> Encoder:
    """The task's encoder; workers that go on to further tasks keep it."""
    key = (vocabulary, lexicon)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Merger(vocabulary), Lexicon(SparkFiles.get(lexicon)))
    return _encoders[key]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                  keep: tuple[str, ...] = (), lexicon: str | None = None, decode: bool = True) -> DataFrame:
    """id, kept columns, ids (array of int) and, on demand, decoded (text) of every row; narrow after the lexicon."""
    lexicon = lexicon or build_lexicon(docs, vocabulary, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary, lexicon)
        for b in slices(batches, b_text, SLICE):
            ids, at = code.encode_all(b.column(b_text).to_pylist())
            out = [*b.columns[:b_text], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))]
            if decode:
                out.append(code.decode_all(ids, at))
            yield pa.RecordBatch.from_arrays(out, names)

    b_text = 1 + len(keep)
    rows = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("_text"))
    names = [id_col, *keep, "ids", *(["decoded"] if decode else [])]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:b_text])
    return rows.mapInArrow(work, f"{schema}, ids array<int>" + ", decoded string" * decode)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 of encode_decode()'s rows."""
    return encoded.select(
        id_col, F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
