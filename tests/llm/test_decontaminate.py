"""Leaks against exact alignment of every item with every document."""

import random

import pytest

from tenderlens.llm import decontaminate as d


def plain_distance(item, text):
    """Least edits between the item and any stretch of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (x != w)))
        row = new
        best = min(best, row[-1])
    return best


def edited(rng, words, vocabulary, n):
    out = list(words)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[i:i + 1] = [[rng.choice(vocabulary)], [], [out[i], rng.choice(vocabulary)]][kind]
    return out


def test_align_by_definition():
    rng = random.Random(1)
    for _ in range(400):
        item = tuple(rng.choices([b"a", b"b", b"c"], k=rng.randint(1, 9)))
        text = rng.choices([b"a", b"b", b"c", b"d"], k=rng.randint(0, 15))
        edits, s, e = d.align(item, text)
        assert edits == plain_distance(item, text)
        assert 0 <= s <= e <= len(text) and plain_distance(item, text[s:e]) == edits


@pytest.mark.parametrize("share", [0, 0.05, 0.1, 0.15, 0.2])
def test_recall(share):
    rng = random.Random(int(100 * share))
    vocabulary = [("".join(rng.choices("abcdeinorst", k=rng.randint(2, 7)))) for _ in range(3000)] + ["the", "of", "and"] * 300
    items = [rng.choices(vocabulary, k=rng.randint(8, 60)) for _ in range(150)]
    index = d.Index([(i, " ".join(w)) for i, w in enumerate(items)], 0.8, 5)
    found = 0
    for i, words in enumerate(items):
        around = rng.choices(vocabulary, k=400)
        at = rng.randrange(401)
        text = around[:at] + edited(rng, words, vocabulary, int(share * len(words) + 1e-9)) + around[at:]
        found += i in {index.ids[k][0] for _, k, *_ in d.leaks_in(index, [", ".join(text).upper().encode()])}
    assert found >= 0.95 * len(items)


@pytest.mark.parametrize("size", range(1, 10))
def test_short_items_are_all_found(size):
    rng = random.Random(size)
    vocabulary = ["".join(rng.choices("abcdeinorst", k=rng.randint(2, 7))) for _ in range(3000)] + ["the", "of", "and"] * 300
    for n in {0, size // 5}:
        items = [rng.choices(vocabulary, k=size) for _ in range(100)]
        index = d.Index([(i, " ".join(w)) for i, w in enumerate(items)], 0.8, 1)
        for i, words in enumerate(items):
            around = rng.choices(vocabulary, k=60)
            at = rng.choice([0, 60, rng.randrange(61)])
            text = [w.encode() for w in around[:at] + edited(rng, words, vocabulary, n) + around[at:]]
            want = {k for k, w in enumerate(items) if plain_distance([x.encode() for x in w], text) <= size // 5}
            assert i in want and want == {j for _, k, *_ in d.leaks_in(index, [b"x y", b" ".join(text), b"z"]) for j in index.ids[k]}


def test_clean_documents_have_no_leaks():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdeinorst", k=rng.randint(2, 6))) for _ in range(800)]
    index = d.Index([(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(50)], 0.8, 5)
    assert list(d.leaks_in(index, [" ".join(rng.choices(vocabulary, k=3000)).encode() for _ in range(20)])) == []


def test_item_without_its_first_words_at_the_very_beginning():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeinorst", k=rng.randint(2, 7))) for _ in range(3000)]
    for lost in (1, 2):
        item, after = rng.choices(vocabulary, k=20), rng.choices(vocabulary, k=50)
        index = d.Index([(1, " ".join(item))], 0.8, 5)
        text = " ".join(item[lost:] + after).encode()
        assert [(e, s) for _, _, e, s, _ in d.leaks_in(index, [text])] == [(lost, 0)]


def test_tables(spark):
    item = "The quick brown fox, it seems, jumps over the very lazy dog again."
    other = "Naïve élan vital und größere Straßen führen nach Süden oder Osten"
    rows = [(1, f"before {item} after"), (2, item.upper().replace(",", " ;")), (3, "nothing of it"), (4, None), (5, ""), (6, f"{item}\n{item}"),
            (7, "é 🎉 " + other), (8, item.replace("fox", "cat").replace("lazy", "tired")), (9, "word " * 50_000 + item), (1, f"before {item} after"),
            (None, item), (10, "The quick brown fox, it seems"), (11, "the dog")]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id bigint, text string, item_id int, _leak string")
    items = spark.createDataFrame([(1, item, 0), (2, other, 0), (3, item, 0), (4, None, 0), (5, "", 0), (6, "the dog", 0)],
                                  "item_id bigint, text string, doc_id int")
    got = d.find_leaks(docs, items).collect()
    for r in got:
        text = dict(rows)[r.doc_id]
        words = tuple(d.fold({1: item, 2: other, 3: item}[r.item_id].encode()).split())
        assert plain_distance(words, d.fold(text[r.start:r.end].encode()).split()) == r.edits <= 0.2 * r.n_words
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == sorted(
        [(i, k) for i in (1, 1, 2, 6, 6, 8, 9, 0) for k in (1, 3)] + [(7, 2)])
    assert {r.start for r in got if r.doc_id == 7} == {4}
    assert [r.doc_id for r in d.drop_leaking(docs, items).orderBy("doc_id").collect()] == [3, 4, 5, 10, 11]
    blocks = d.find_leaks(docs, items, block_words=10)
    assert sorted(map(tuple, blocks.collect()), key=str) == sorted(map(tuple, got), key=str)
    assert d.find_leaks(docs.where("false"), items).count() == 0 and d.find_leaks(docs, items.where("false")).count() == 0


def test_clean_rows_stay_where_ids_are_null_or_repeat(spark):
    item = "The quick brown fox, it seems, jumps over the very lazy dog again."
    rows = [(None, item), (None, "a clean text"), (None, None), (1, "before " + item), (1, "also clean"), (2, "clean")]
    docs = spark.createDataFrame(rows, "doc_id bigint, body string")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = d.drop_leaking(docs, items, text_col="body").collect()
    assert sorted(map(tuple, got), key=str) == sorted([r for r in rows if item not in (r[1] or "")], key=str)


def test_unsearched_items_are_listed(spark):
    rows = [(1, "one two three four five"), (2, "one, two; three four"), (3, None), (4, "  !!"), (2, "x"), (None, "a")]
    items = spark.createDataFrame(rows, "item_id bigint, text string")
    names = lambda df: sorted(((r.item_id, r.n_words) for r in df.collect()), key=str)
    assert names(d.unsearched(items)) == sorted([(2, 4), (3, 0), (4, 0), (2, 1), (None, 1)], key=str)
    assert names(d.unsearched(items, min_words=1)) == [(3, 0), (4, 0)]
    assert d.unsearched(items.where("false")).count() == 0
