"""Quality scores: held-out labels, gradients against differences, whole texts, defined cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tenderlens.llm import quality, queries

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, score int, label int"
GOOD = "A plain sentence of several words, with a comma. Then another one follows it. "
BAD = "BUY!!! NOW### $$$ BUY!!! NOW### $$$ "


def test_gradient():
    rng = np.random.default_rng(1)
    m = {k: rng.normal(0, 0.5, s) for k, s in quality._SHAPES.items()} | {"mean": np.zeros(quality.FEATURES), "scale": np.ones(quality.FEATURES)}
    x, starts, y = rng.normal(size=(9, quality.FEATURES)), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = quality.forward(m, x, starts)["score"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    got = quality._gradient(m, quality.forward(m, x, starts), y, starts)
    for k in quality._SHAPES:
        at = tuple(int(i) for i in np.array(m[k].shape) // 2)
        kept = m[k][at]
        m[k][at] = kept + 1e-5
        up = loss()
        m[k][at] = kept - 1e-5
        down = loss()
        m[k][at] = kept
        assert abs(got[k][at] - (up - down) / 2e-5) < 1e-6, k


def test_attention_is_a_softmax_per_bag():
    rng = np.random.default_rng(2)
    m = quality.fit([rng.normal(size=(n, quality.FEATURES)).astype(np.float32) for n in (1, 3, 2, 4)], np.array([0, 1, 0, 1.0]), epochs=2)
    f = quality.forward(m, rng.normal(size=(6, quality.FEATURES)), np.array([0, 1]))
    assert np.allclose(np.add.reduceat(f["weight"], [0, 1]), 1) and f["weight"][0] == 1


def test_word_features_against_plain():
    text = ("the cat the cat cat sat. " * 40 + "É " + "x" * 600 + " y").encode()
    x = quality.encode(text)
    assert len(x) == -(-len(text) // quality.PASSAGE)
    for i, row in enumerate(x):
        words = text[i * quality.PASSAGE:(i + 1) * quality.PASSAGE].split()
        w = row[-quality.WORDS:]
        assert abs(w[0] - np.log1p(len(words)) / 5) < 1e-5
        assert abs(w[1] * 10 - np.mean([len(a) for a in words])) < 1e-4
        assert abs(w[3] - len(set(words)) / len(words)) < 1e-6
        assert abs(w[4] - max(words.count(a) for a in words) / len(words)) < 1e-6
        assert abs(w[5] - sum(a == b for a, b in zip(words, words[1:])) / len(words)) < 1e-6


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op13_quality_classifier(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
               for r in rows)
    kept = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(kept) > 80 and np.mean([(s >= 0.5) == y for s, y in kept]) >= 0.97
    good, bad = [s for s, y in kept if y], [s for s, y in kept if not y]
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good]) >= 0.97


def small(spark):
    rows = [(i, (GOOD if i % 2 else BAD) * (i % 5 + 1), "en", 1, 1) for i in range(60)]
    odd = [(None, GOOD, None, 1, 1), (100, None, "en", 1, 1), (101, "", "en", 1, 1), (102, " \n\t", "en", 1, 1), (3, GOOD, "en", 1, 1),
           (3, GOOD, "en", 1, 1), (103, "x" * 3_000_000, "en", 1, 1), (104, GOOD * 40_000 + BAD, "en", 1, 1)]
    labels = [(i, i % 2) for i in range(60)] + [(None, 1), (7, None), (9, 5), (11, 1), (11, 1), (999, 0)]
    return (spark.createDataFrame(rows + odd, SCHEMA),
            spark.createDataFrame([(*r, "x") for r in labels], "doc_id bigint, quality int, text string"))


def test_defined_cases(spark):
    docs, labels = small(spark)
    model = quality.learn(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 68
    by = {r.doc_id: r for r in rows}
    assert all((r.predicted == 1) == (r.doc_id % 2 == 1) for r in rows if r.doc_id is not None and r.doc_id < 60)
    assert by[100].score == by[101].score and 0 <= by[100].score <= 1 and by[100].n_passages == 1
    assert by[104].n_passages == -(-len((GOOD * 40_000 + BAD).encode()) // quality.PASSAGE)
    assert len({r.score for r in rows if r.doc_id == 3}) == 2  # three rows, two texts
    # Other columns and languages never matter, nor does the order of rows.
    moved = docs.select("doc_id", "text", F.lit("zz").alias("lang")).repartition(5)
    assert quality.learn(moved, labels.repartition(4)) == model


def test_learning_leaves_out_held_out_labels(spark):
    docs, labels = small(spark)
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.learn(docs, labels) == quality.learn(docs, turned)


def test_bounds_and_nothing_to_learn(spark):
    docs, labels = small(spark)
    assert quality.learn(docs, labels, most_bags=10, most_passages=1) is not None
    none = quality.learn(docs, labels.limit(0))
    assert none is None and {r.score for r in quality.score(docs, none).collect()} == {0.5}
    empty = docs.limit(0)
    assert quality.learn(empty, labels) is None and quality.score(empty, quality.learn(docs, labels)).count() == 0
    sizes = {r.doc_id: r.n_passages for r in quality.score(docs, None).collect()}
    assert sizes == {r.doc_id: r.n_passages for r in quality.score(docs, quality.learn(docs, labels)).collect()}
