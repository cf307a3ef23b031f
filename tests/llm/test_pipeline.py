"""The pipeline against its stages done plainly, one after the other."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tenderlens.llm import decontaminate, langid, queries
from tenderlens.llm.common import shared_path
from tests.llm import test_decontaminate, test_pii, test_simhash


def fixture(spark, docs, items):
    folder = shared_path(spark, "fixture")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline(spark, monkeypatch):
    monkeypatch.setattr(test_pii, "KEY", queries.PII_KEY)
    rng = random.Random(3)
    words = {"aa": ["".join(rng.choices("abcdefg", k=rng.randint(2, 7))) for _ in range(300)],
             "zz": ["".join(rng.choices("tuvwxyz", k=rng.randint(2, 7))) for _ in range(300)]}
    say = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    items = [(i, say("aa", 30)) for i in range(5)] + [(9, None)]
    docs = [(i, say(lang := "aa" if i % 2 else "zz", rng.randint(60, 200)), lang, "s", 0) for i in range(60)]
    for k, (i, text, *rest) in enumerate(docs[:12]):
        docs.append((100 + k, text if k % 2 else text.replace(" ", "  ", 3), *rest))  # copies, and copies but for white space
    docs += [(200, say("aa", 80) + " " + items[0][1].upper() + " " + say("aa", 50), "aa", "s", 0), (201, items[1][1], "aa", "s", 0)]
    docs += [(300, None, "aa", "s", 0), (301, "", None, "s", 0), (302, "12345 !!", "aa", "s", 0), (303, "12345 !!", "zz", "s", 0)]
    docs += [(400, say("zz", 70) + " mail me@home.example.com or 4111111111111111 " + say("zz", 40), "zz", None, 0), (None, say("aa", 90), None, None, None)]
    docs += [docs[5], docs[5]]
    folder = fixture(spark, docs, items)
    out = corpus_pipeline.run(spark, folder).collect()

    model = langid.learn(spark.read.parquet(f"{folder}/documents.parquet"))
    kept = [d for d, (lang, score) in zip(docs, model.predict([d[1] for d in docs])) if lang != "und" and score >= corpus_pipeline.LEAST_SCORE]
    assert {d[0] for d in docs} - {d[0] for d in kept} == {300, 301, 302, 303}
    prints = [test_simhash.plain_fingerprint(d[1]) for d in kept]
    roots = test_simhash.plain_components(sorted(set(prints)), 4)
    first = {}
    for d, p in zip(kept, prints):
        if roots[p] not in first or (d[0] is None, d[0] or 0) < (first[roots[p]][0] is None, first[roots[p]][0] or 0):
            first[roots[p]] = d
    clean = []
    for d in first.values():
        text = decontaminate.fold(d[1].encode()).split()
        if not any(t and test_decontaminate.plain_distance(w := decontaminate.fold(t.encode()).split(), text) <= 0.2 * len(w) for _, t in items):
            clean.append(d)
    assert {200, 201}.isdisjoint(d[0] for d in clean)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text, lang, source, _ in clean:
        text = test_pii.plain_text(text)[0]
        ids = library.encode(text, add_special_tokens=False).ids
        want.append((i, lang, source, len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert not any("4111111111111111" in library.decode(r.ids) for r in out)


def test_stages_keep_the_columns(spark):
    docs = [(1, "some words of a text", "aa", "s", 20), (2, None, None, None, None)]
    folder = fixture(spark, docs, [])
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for some in (rows, rows.where("false")):
            assert stage(spark, some, folder).columns == rows.columns
    assert corpus_pipeline.run(spark, fixture(spark, [], [])).count() == 0


def test_registered():
    names = entry.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == [] and "pipeline" in names
