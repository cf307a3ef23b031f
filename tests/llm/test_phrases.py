"""Phrase mining against plain counting over all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlens.llm import phrases, queries

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_counts(rows, most=4):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    return n, f


def plain(rows, least=30, top=2000):
    n, f = plain_counts(rows)
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        kept = []
        for p, a in cand.items():
            cuts = [(2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(b) > len(p) and 100 * fb >= 80 * a and any(b[i:i + len(p)] == p for i in range(len(b) - len(p) + 1))
                         for b, fb in cand.items())
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("grp", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed=3, docs=120):
    rng = random.Random(seed)
    words = ["The", "the", "of", "É", "é", "x\x1cy", "a b", "pad", "end", "zz"]
    rows = [(rng.choice(["en", "de", None]), "".join(
        rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", " \r ", "\x0b"]) for _ in range(rng.randrange(0, 120))))
        for _ in range(docs)]
    return rows + [("en", "one two three four five " * 200), ("fr", "only " * 29), ("und", "the of the of"), ("en", None), ("en", ""),
                   (None, None), ("en", " \t.,"), ("fr", "x")] + [("en", "copied passage of words here")] * 40


def frame(spark, rows):
    return spark.createDataFrame([(i % 50 or None, t, g, "x", 1) for i, (g, t) in enumerate(rows)],
                                 "doc_id bigint, text string, lang string, phrase string, k int").repartition(3)


@pytest.mark.parametrize("share", [1, 8, 10_000])
def test_against_plain_counting(spark, share):
    """Whatever the sample proposes (all, some, nothing), the outcome is the same."""
    rows = corpus()
    assert found(phrases.top_collocations(frame(spark, rows), share=share, bits=1 << 20)) == plain(rows)


def test_full_filter(spark):
    """A filter far too small lets nearly everything through; counts stay exact."""
    rows = corpus(4)
    assert found(phrases.top_collocations(frame(spark, rows), bits=1 << 10)) == plain(rows)


def test_border_failures_take_more_passes(spark):
    rows = [("en", "a b c d")] * 30
    docs = frame(spark, rows)
    tables, passes = phrases.frequent_phrases(docs, share=1_000_000, bits=1 << 16)
    assert passes == 2 and {r.phrase for t in tables for r in t.where("k = 4").collect()} == {"a b c d"}
    _, passes = phrases.frequent_phrases(docs, share=1, bits=1 << 16)
    assert passes == 1


@pytest.mark.parametrize("drop", [0.1, 0.5, 0.9])
def test_one_expansion_closes(spark, drop):
    """Whatever is taken out of the proposed set, no frequent phrase is lost and none is counted twice."""
    rng, rows = random.Random(drop), corpus(9) * 2
    docs = frame(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("grp"), F.col("text").cast("binary").alias("text"))
    _, f = plain_counts(rows)
    want = {(g, " ".join(p)): c for g, count in f.items() for p, c in count.items() if c >= 30}
    some = [(g, p) for g, p in sorted(want) if rng.random() > drop] or [("en", "the")]
    proposed = phrases._filter_of(spark.createDataFrame(some, "grp string, phrase string"), 1 << 16)
    tables, _ = phrases.closed(docs, 30, 4, proposed)
    got = [(r.grp, r.phrase, r.f) for t in tables for r in t.where("k > 0").collect()]
    assert sorted(got) == sorted((g, p, c) for (g, p), c in want.items())


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 40)
    rng = random.Random(1)
    text = "".join(rng.choice(["aa", "b", "the", "longer", "É"]) + rng.choice([" ", "\t", "  ", ". "]) for _ in range(900))
    none = np.full(1 << 10, 255, np.uint8)  # everything is proposed
    got = defaultdict(Counter)
    for data, lead in phrases.chunks(iter([text.encode(), b"aa b", text[:500].encode()])):
        for batch in phrases._count_chunk("g", data, lead, 4, none):
            for r in batch.to_pylist():
                phrase, group = r["key"].split("\n")
                assert group == "g"
                got[len(phrase.split(" ")) if phrase else 0][phrase] += r["f"]
    n, f = plain_counts([("g", text), ("g", "aa b"), ("g", text[:500])])
    assert got[0][""] == n["g"]
    for k in range(1, 5):
        assert got[k] == Counter({" ".join(p): c for p, c in f["g"].items() if len(p) == k})


def test_ties_and_first_ranks(spark):
    rows = [("en", " . ".join(["b c", "a b", "é f"] * 30))]
    got = found(phrases.top_collocations(frame(spark, rows), top=2, bits=1 << 16))
    assert [(r[1], r[2]) for r in got] == [(1, "é f"), (2, "a b")] and got == plain(rows, top=2)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, Text_ int")
    assert phrases.top_collocations(empty, bits=1 << 16).count() == 0


def test_registered(spark):
    got = queries.op11_phrase_collocations(spark, SF)
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert found(got.withColumnRenamed("lang", "grp")) == plain(rows)
    assert all(t == "bigint" for c, t in got.dtypes if c not in ("lang", "phrase"))
    assert got.where(F.col("rank") > 2000).count() == 0
