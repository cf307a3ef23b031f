"""What jobs leave in the shared folder: their results and no more."""

import os

import public_tokenizers
import pytest

import corpus_pipeline
from tenderlens.llm import ans, html_extract, simhash
from tenderlens.llm.common import clearing, shared_path, written
from tests.llm.test_pipeline import fixture

DOCS = [(i, f"{'some words of a text about number ' * 9}{i % 7} end", "aa", "s", 20) for i in range(30)] + [(None, None, None, None, None)]


@pytest.fixture
def left_over(spark):
    """Purposes of the tables that have come into the shared folder since the test began."""
    def held():
        folder = os.path.dirname(shared_path(spark, "x")).removeprefix("file:")
        return {n for n in (os.listdir(folder) if os.path.isdir(folder) else []) if not n.startswith(".")}

    before = held()
    return lambda: sorted(n.rsplit("-", 1)[0] for n in held() - before)


def test_only_results_are_left(spark, left_over):
    folder = fixture(spark, DOCS, [(1, "nothing that any of them has in it at all")])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert simhash.near_duplicates(docs).count() == 31
    assert left_over() == ["fixture", "labelled"]
    assert len(ans.checksummed(ans.read(spark, ans.store(docs, public_tokenizers.path("word_bpe_49k.json")))).collect()) == 31
    # The lexicon stays: executors that come later fetch it.
    assert set(left_over()) - {"lexicon"} == {"fixture", "labelled", "token-files"}
    pages = spark.createDataFrame([(1, "http://h/a", "<p>one</p>")], "page_id int, url string, html string")
    assert html_extract.extract(pages).count() == 1
    assert set(left_over()) - {"lexicon"} == {"fixture", "labelled", "low-parts", "token-files"}


def test_the_pipeline_leaves_its_last_stage(spark, left_over):
    folder = fixture(spark, DOCS, [(1, "nothing that any of them has in it at all")])
    corpus_pipeline.run(spark, folder).collect()
    assert [n for n in left_over() if "lexicon" not in n] == ["fixture", "stage-BPE-encoding"]


def test_what_fails_is_cleared_and_scopes_nest(spark, left_over):
    rows = spark.range(3)
    with pytest.raises(RuntimeError), clearing():
        written(rows, "lost")
        raise RuntimeError
    with clearing() as outer:
        with clearing() as inner:
            written(rows, "one")
            two = inner(written(rows, "two"))
        assert left_over() == ["two"] and two.count() == 3
        three = outer(written(rows, "three"))
    assert left_over() == ["three"] and three.count() == 3
