"""Piecewise hashing against a plain version, text by text and pair by pair."""

import hashlib
import random

import numpy as np

from tenderlens.llm import ctph


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def parse(fp):
    size, one, two = fp.split(":")
    cut = lambda s: [s[i:i + 2] for i in range(0, len(s), 2)]
    return int(size), cut(one), cut(two)


def plain_likeness(a, b):
    (s, a1, a2), (t, b1, b2) = parse(a), parse(b)
    pairs = [(a1, b1), (a2, b2)] if s == t else [(a1, b2)] if s == 2 * t else [(a2, b1)] if t == 2 * s else []
    if a == b:
        return 1.0
    return max([2 * plain_lcs(x, y) / (len(x) + len(y)) for x, y in pairs if x or y], default=0.0)


def plain_print(text):
    """One text, byte by byte, by the definition."""
    mask = (1 << 64) - 1
    table = [int(x) for x in ctph._TABLE]
    turn = lambda x, by: (x << by % 64 | x >> 64 - by % 64) & mask if by % 64 else x
    mixed = []
    for i in range(len(text)):
        r = 0
        for k in range(8):
            if i - k >= 0:
                r ^= turn(table[text[i - k]], 7 * k)
        mixed.append(((r ^ r >> 31) * int(ctph._MULTIPLY)) & mask)
    cut_at = lambda level: [i + 1 for i, m in enumerate(mixed) if (m >> 24) % (1 << level) == 0]
    level = 2
    while len(cut_at(level)) >= 64:
        level += 1

    def signature(v):
        out, begin = "", 0
        for stop in sorted({*cut_at(v), len(text)}):
            if stop > begin:
                h = sum((m * int(ctph._MULTIPLY) & mask) ^ m for m in mixed[begin:stop]) & mask
                h = (h ^ h >> 29) * int(ctph._MULTIPLY) & mask
                out += bytes(ctph._PAIRS[h >> 52]).decode()
                begin = stop
        return out

    return f"{1 << level}:{signature(level)}:{signature(level + 1)}"


def some_texts():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeéß ", k=rng.randint(1, 9))) for _ in range(400)]
    texts = ["", "a", "\0", "ab" * 3000, "x" * 700, "é"] + [" ".join(rng.choices(words, k=k)) for k in (1, 3, 20, 100, 900)]
    return texts + [t[:len(t) // 2] + "edit" + t[len(t) // 2:] for t in texts[-3:]]


def test_fingerprints_by_definition():
    texts = [t.encode() for t in some_texts()]
    assert ctph.Prints(texts).strings() == [plain_print(t) for t in texts]


def test_likeness_by_definition():
    texts = [t.encode() for t in some_texts()]
    p = ctph.Prints(texts)
    s = p.strings()
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(texts)) for j in range(len(texts))]))
    got = ctph.likeness(p, a, p, b)
    for i, j, v in zip(a, b, got):
        assert abs(v - plain_likeness(s[i], s[j])) < 1e-12, (i, j)


def test_study(spark):
    texts = some_texts()
    rows = [(None, "null id", 1)] + [(10 * i, t or None, 1) for i, t in enumerate(texts)] + [(20, "again", 1), (20, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part int")
    ordered = sorted(((i is not None, i or 0, t or "", i) for i, t, _ in rows))
    want = []
    for k, (_, _, text, i) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][2]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        a, b, c = (plain_print(t.encode()) for t in (text, edited, after))
        want.append((-1 if i is None else i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b,
                     round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint,
            round(r.near_edited, 9), round(r.near_next, 9)) for r in ctph.edited_study(docs).collect()]
    assert sorted(got) == sorted(want)
    assert ctph.edited_study(docs.where("false")).count() == 0
    alone = ctph.edited_study(docs.where("text = 'null id'")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
