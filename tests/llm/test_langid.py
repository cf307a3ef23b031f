"""Language ID: filters against plain sets, held-out accuracy, defined cases."""

import random
import zlib

import numpy as np
import pytest

from tenderlens.llm import langid

DOCS = "/root/testdata/sf0.01/documents.parquet"


def plain_grams(text):
    out = []
    words = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower()).encode().split()
    for n in langid.ORDERS:
        for w in words:
            w = b" " + w + b" "
            for i in range(len(w) - n + 1):
                piece = w[i:i + n]
                if b" " not in piece[1:-1]:
                    out.append(int.from_bytes(bytes([n]) + piece, "big"))
    return sorted(out)


def test_grams_by_definition():
    texts = ["", "a", "Hello, wörld!", "x" * 50, "one two  three\nfour 12 five", "é ß"]
    values, owner = langid.grams(texts)
    for i, t in enumerate(texts):
        assert sorted(values[owner == i].tolist()) == plain_grams(t)


def test_filters_hold_all_languages_of_a_gram():
    rng = random.Random(2)
    languages = [f"l{i}" for i in range(11)]
    entries = [(rng.getrandbits(40), rng.sample(languages, rng.randint(1, 11))) for _ in range(2000)]
    model = langid.Model(languages, entries)
    values = np.array([g for g, _ in entries], np.uint64)
    for k, language in enumerate(languages):
        has = np.ones(len(values), bool)
        for p in model.positions(values):
            has &= (model.planes[k // 8][p] >> (k % 8) & 1).astype(bool)
        inside = np.array([language in h for _, h in entries])
        assert has[inside].all() and has[~inside].mean() < 4 * model.strangers[k] + 0.02


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    rows = langid.identify(docs.withColumn("out", langid.held_out("doc_id")), langid.learn(docs), keep=("lang", "out")).collect()
    held = [r for r in rows if r.out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def small(spark):
    words = {"xx": "alpha beta gamma delta", "yy": "uno dos tres cuatro"}
    rows = [(i, words["xx" if i % 2 else "yy"], "xx" if i % 2 else "yy", 0.5) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")


def test_defined_cases(spark, small):
    model = langid.learn(small)
    assert sorted(model.languages) == ["xx", "yy"]
    rows = [(1, None), (2, ""), (3, "12 !? ²"), (4, "beta gamma"), (5, "dos tres " * 30_000), (None, "alpha"), (7, "qqqq zzzz"), (4, "beta gamma"),
            (8, "a"), (9, "日本語")]
    docs = spark.createDataFrame([(*r, "zz") for r in rows], "doc_id bigint, text string, lang_pred string")
    got = langid.identify(docs, model).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == len(rows) and by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[4][0] == "xx" and by[5][0] == "yy" and by[None][0] == "xx" and by[4][1] > 0.9
    assert by[7] == (model.languages[0], 0.0) and by[9] == (model.languages[0], 0.0)
    nothing = langid.learn(small.where("lang is null"))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.where("false"), model).count() == 0


def test_learns_only_from_rows_it_may(spark, small):
    from pyspark.sql import functions as F

    spoiled = small.withColumn("lang", F.when(langid.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    assert langid.learn(spoiled).languages == langid.learn(small.where(~langid.held_out("doc_id"))).languages


def test_bounded_sample_still_tells(spark, small):
    model = langid.learn(small, per_language=8)
    rows = langid.identify(small, model, keep=("lang",)).collect()
    assert all(r.lang == r.lang_pred for r in rows)
