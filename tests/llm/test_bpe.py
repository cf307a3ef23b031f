"""BPE against the tokenizers library, the automaton against a dictionary."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tenderlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "  ", "a", " a", "a  b", "a\n\n b", "\n\n", "x \n", "it's we'll 'S ' s", "<|endoftext|>", "a <|endoftext|> b",
        "<|endoftext|><|endoftext|>", "²½Ⅷ٣ 12", "a\x1cb\x1f c", " x　 y", "été naïve 中文字 🎉🎉", "é" * 300, "ab" * 4000,
        "a" * 5000, "\x00\x01", "don't\tstop", "   z", "_a_1 _", "ſ's"]


@pytest.fixture(scope="module")
def both(tmp_path_factory):
    words = [" the", "the", " then", "ab", " ab\nthe", "été", "x" * 48, "y" * 49]
    merger = bpe.Merger(PATH)
    file = tmp_path_factory.mktemp("lexicon") / "words"
    file.write_bytes(bpe.compile_lexicon((w.encode(), merger.word_ids(w)) for w in words if len(w) <= bpe.WORD_BYTES))
    return bpe.Encoder(merger, bpe.Lexicon(str(file))), Tokenizer.from_file(PATH)


def check(both, texts):
    ours, theirs = both
    for text, ids in zip(texts, ours.encode(texts)):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text[:80])
        assert ours.decode(ids) == theirs.decode(want, skip_special_tokens=False)


def test_hard_texts(both):
    check(both, HARD)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'<|>s\x85 aA9é."), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40))
def test_any_text(both, text):
    check(both, [text])


def test_many_words_merge_like_each_alone(both):
    rng = random.Random(2)
    merger, library = both[0].merger, both[1]
    words = ["".join(rng.choices("etaoin shrdl'é中0\n"[:k], k=rng.randint(1, 12))).encode() for k in (3, 9, 17) for _ in range(4000)]
    words += [b"", b"a", b"x" * 49, b"ab" * 300] * 40
    got = [np.frombuffer(x, np.uint32).tolist() for x in merger.merge_all(words)]
    assert got == [merger.merge(w) for w in words] and merger.merge_all([]) == []
    text = " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice(["", "ing", "ción", ".\nThe", "’s", "'ll"]) for _ in range(20_000))
    assert both[0].encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_forgets_late_words_first(both, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 300)
    coder = bpe.Encoder(both[0].merger, both[0].lexicon)
    texts = [" ".join(f"w{i}x{k}" for k in range(200)) + "<|endoftext|>" for i in range(6)]
    first = None
    for text in texts * 2:
        assert coder.encode([text])[0].tolist() == both[1].encode(text, add_special_tokens=False).ids
        first = first or list(coder.words)[:100]
        assert len(coder.words) <= 500 and coder.words.keys() >= set(first) and "<|endoftext|>" in coder.pieces


def test_lone_spaces_cut_and_each_distinct_word_is_split_once(both):
    blanks = ["  ", "\n", " \n", "\n ", "\t ", "\xa0", " \xa0", "\x85 ", "\u1680 ", " \u2003", "\u2028 ", " \u3000", "\x1c ", " \x1f", " "]
    texts = [f"{a}{blank}{b}" for blank in blanks for a in ("a", "é", "", ".", "中", "’", "🎉") for b in ("b", "à", "", "!", "字", "…", "🎉")]
    check(both, [*texts, " ".join(texts), "".join(texts), "<|endoftext|>".join(texts), " <|endoftext|> ".join(texts)])
    coder, seen = bpe.Encoder(bpe.Merger(PATH), both[0].lexicon), []
    split = coder.merger.split
    coder.merger.split = lambda text: seen.append(text) or split(text)
    text = "the x,y ab  c. é! " * 500 + "the"
    assert coder.encode([text, text])[1].tolist() == both[1].encode(text, add_special_tokens=False).ids
    assert sum(map(len, seen)) < 40


def test_decoded_texts_that_are_not_utf8(both):
    ids = both[0].encode(["é 🎉", "plain"])
    cut = np.concatenate([ids[0][:1], ids[0][-1:], ids[1]])
    at = np.array([0, 1, 2, len(cut)])
    want = [both[1].decode(cut[a:b].tolist(), skip_special_tokens=False) for a, b in zip(at, at[1:])]
    assert both[0].decode_all(cut, at).to_pylist() == want and both[0].decode_all(cut[:0], np.array([0, 0])).to_pylist() == [""]


def test_automaton_is_minimal_and_exact(tmp_path):
    rng = random.Random(1)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randint(1, 6))) for _ in range(300)})
    entries = [(w, [i, i + 1]) for i, w in enumerate(words)]
    file = tmp_path / "words"
    file.write_bytes(bpe.compile_lexicon(entries))
    lexicon = bpe.Lexicon(str(file))
    probes = words + [b"", b"zz", b"abcabca", words[0] + b"q", b"a" * 100]
    rows = lexicon.find(probes)
    for probe, row in zip(probes, rows.tolist()):
        if probe in words:
            assert lexicon.ids[lexicon.starts[row]:lexicon.starts[row + 1]].tolist() == [words.index(probe), words.index(probe) + 1]
        else:
            assert row == -1
    # As many states as there are different sets of endings.
    endings = {frozenset(w[k:] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}
               for k in [len(p)]}
    assert len(lexicon.final) == len(endings)


def test_empty_lexicon(tmp_path):
    file = tmp_path / "none"
    file.write_bytes(bpe.compile_lexicon([]))
    assert bpe.Lexicon(str(file)).find([b"a", b""]).tolist() == [-1, -1]


def test_table(spark):
    texts = [*HARD, None, "the the the", "the the the"]
    rows = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = bpe.digests(bpe.encode_decode(rows, PATH)).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.digests(bpe.encode_decode(empty, PATH)).count() == 0
