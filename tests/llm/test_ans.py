"""rANS files: exact round trips, damage is told, ids as the tokenizers library gives them."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tenderlens.llm import ans
from tenderlens.llm.common import shared_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def table_of(ids):
    values, n = np.unique(ids, return_counts=True)
    return ans.Table(values.astype(np.int64), n.astype(np.int64))


@pytest.mark.parametrize("n", [1, 15, 16, 17, 4095, 4096, 4097, 16383, 16384, 16385, 100_000])
@pytest.mark.parametrize("skew", [0, 1])
def test_round_trip(n, skew):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 49_000, n) if not skew else np.minimum(rng.geometric(0.4, n), 60_000)
    table = table_of(ids)
    assert table.f.sum() == 1 << table.bits and table.f.min() >= 1
    frame = ans.pack(ids, table)
    assert (ans.unpack(frame, n, table) == ids).all()
    if n > ans.BLOCK:
        assert (ans.unpack(frame, n, table, range(1, 2)) == ids[ans.BLOCK:2 * ans.BLOCK]).all()
    if skew and n == 100_000:
        entropy = -(np.bincount(ids)[np.unique(ids)] / n * np.log2(np.bincount(ids)[np.unique(ids)] / n)).sum() * n / 8
        assert len(frame["stream"]) < 1.05 * entropy


def test_damage_is_told():
    ids = np.arange(5000) % 97
    table = table_of(ids)
    frame = ans.pack(ids, table)
    frame["stream"] = b"\1" + frame["stream"][1:] if frame["stream"][:1] != b"\1" else b"\2" + frame["stream"][1:]
    with pytest.raises(ValueError):
        ans.unpack(frame, 5000, table)


@pytest.fixture(scope="module")
def both():
    return ans.WordEncoder(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'<|>sSJ\x85 Aé.̌̇̈ΣıİK1"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=30), max_size=4))
def test_any_text(both, texts):
    ours, library = both
    got = [np.frombuffer(x, ours.kind).tolist() for x in ours.encode([t.encode() for t in texts])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_words(both):
    """Words are cut where letters, figures and punctuation meet, and each distinct piece meets the library once."""
    ours, library = both
    hard = ["it's 'S 'sam' ,'s a'b'll x''re", "a1b22.c-3 1's '2", "été, «être».Übung;ÜBUNG! straße(ß)", "naïve,é e\u0301, \u0301x", "ΟΔΟΣ. λόγος,ς",
            "слово, ДОМ-дом", "中文,字 한국어.", "a\x00b \x1cc\x1f,d \xa0e\u2003f", "🎉,🎉a ٣,३a", "", " \n", "x" * 300 + ", y", "<|endoftext|>,a b"]
    for texts in (hard, ["\n" + t + "\t" for t in hard], hard[::-1] * 3):
        got = [np.frombuffer(x, ours.kind).tolist() for x in ours.encode([t.encode() for t in texts])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    coder, met = ans.WordEncoder(PATH), []
    ids, coder._ids = coder._ids, lambda pieces: met.extend(pieces) or ids(pieces)
    coder.encode([" ".join(f"{w}{mark}" for w in ("Uno", "dos", "été") for mark in ("", ",", ".", "!")).encode()] * 3)
    coder.encode(["Dos, uno. (Été!)".encode()])
    assert sorted(p.decode() for p in met) == sorted(["uno", "dos", "été", ",", ".", "!", "(", "Été", "!)"])
    assert not any(len(w) > ans.LONGEST for w in ours.known)


def test_files(spark):
    library = Tokenizer.from_file(PATH)
    texts = ["The cat, sat.", "", None, "<|endoftext|> a<|ENDOFTEXT|>", "J̌ it's 12,5", "word " * 30_000, "twice", "twice", "x" * 3000]
    rows = [(7 * i % 10, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (4, "again", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = ans.checksummed(ans.read(spark, ans.store(docs, PATH))).collect()
    ids = {(i, t): [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows}
    want, start = [], 0
    raw = lambda x: np.array(x, "<u2").tobytes()
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, raw(ids[r[:2]]))):
        x = ids[i, t]
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    out = shared_path(spark, "none")
    ans.store(docs.where("false"), PATH, out=out)
    assert ans.read(spark, out).count() == 0


def test_packed_ids_give_the_same_sums(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b, c", None, "", "word " * 9000])], "doc_id bigint, text string")
    out = ans.store(docs, PATH)
    packed, arrays = ans.read(spark, out, packed=True), ans.read(spark, out)
    assert sorted(ans.checksummed(packed).collect()) == sorted(ans.checksummed(arrays).collect())
    assert {r.doc_id: np.frombuffer(r.ids, "<i4").tolist() for r in packed.collect()} == {r.doc_id: r.ids for r in arrays.collect()}
