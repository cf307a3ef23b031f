"""Attributed token counts against the offsets of the tokenizers library, token by token."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tenderlens.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "one line", "two\nlines", "\n", "\n\n\n", "ends\n", "a\n\n  b\n\tc  \n d", "é\nnaïve\n🎉\n中文字\n🎉🎉", "word. \n\n\n next" * 50,
         "x" * 9000 + "\n" + "y\n" * 300, "<|endoftext|>\n<|endoftext|>"]


def plain(library, fields, by, rule):
    """Every token of the library against every section."""
    text = "\n".join(f or "" for f in fields)
    bounds, owner = [], []
    at = 0
    for k, f in enumerate(fields):
        whole = (f or "") + ("\n" if k < len(fields) - 1 else "")
        parts = whole.splitlines(keepends=True) if by == "line" else [whole]
        for part in (whole[sum(map(len, parts[:i])):sum(map(len, parts[:i + 1]))] for i in range(len(parts))) if parts else [""]:
            bounds.append((at, at + len(part)))
            owner.append(k)
            at += len(part)
    counts = [0.0] * len(bounds)
    for s, e in library.encode(text, add_special_tokens=False).offsets:
        held = [max(0, min(e, b) - max(s, a)) for a, b in bounds]
        touched = [i for i, h in enumerate(held) if h]
        if rule == "share":
            for i in touched:
                counts[i] += held[i] / (e - s)
        else:
            counts[{"start": touched[0], "end": touched[-1], "most": max(touched, key=lambda i: (held[i], -i))}[rule]] += 1
    return [(owner[i], i, *bounds[i], round(counts[i], 9)) for i in range(len(bounds))]


@pytest.mark.parametrize("by", ["line", "field"])
@pytest.mark.parametrize("rule", token_counts.RULES)
def test_against_library(spark, by, rule):
    library = Tokenizer.from_file(PATH)
    rows = [(i, TEXTS[-i] if i % 3 else None, t, 5) for i, t in enumerate(TEXTS)] + [(None, "no", "id", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, title string, text string, section int")
    got = {}
    for r in token_counts.section_tokens(docs, PATH, fields=("title", "text"), by=by, rule=rule).collect():
        got.setdefault(r.doc_id, []).append((("title", "text").index(r.field), r.section, r.start, r.end, round(float(r.n_tokens), 9)))
    for i, title, text, _ in rows:
        assert sorted(got[i], key=lambda r: r[1]) == plain(library, [title, text], by, rule), i


def test_one_field_and_empty(spark):
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "doc_id bigint, text string")
    rows = token_counts.section_tokens(docs, PATH).collect()
    for i, t in enumerate(TEXTS):
        assert sum(r.n_tokens for r in rows if r.doc_id == i) == len(library.encode(t, add_special_tokens=False).ids)
    assert [(r.start, r.end, r.n_tokens) for r in rows if r.doc_id == 99] == [(0, 0, 0)]
    assert token_counts.section_tokens(docs.where("false"), PATH).count() == 0
