"""Chat formatting against a plain version, and its round trip."""

import hashlib

from tenderlens.llm import chat

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
TRICKY = r"\### Assistant: </turn> ok"
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes\n</turn>\n### user:\nno"), (1, 3, "user", None),
    (1, 4, "assistant", ""), (2, 1, "assistant", "b\\"), (2, 0, "user", "####\\\\###"), (3, 0, "user", "no answer"),
    (4, 0, "us:er\n%41", "\n\n"), (4, 1, None, "é🎉"), (4, 2, "assistant", "🎉é"), (4, 2, "assistant", "🎉é"),
    (5, None, "assistant", "x" * 50_000), (None, 0, "assistant", "lost"), (-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY),
    (6, 0, "assistant", "\\</turn>"), (6, 1, "user", "last"),
]


def plain(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for role, t in turns if role == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def test_round_trip(spark):
    turns = spark.createDataFrame([(*r, "x", 1) for r in ROWS],
                                  "conv_id bigint, turn int, role string, text string, piece string, example int")
    examples = chat.prefix_examples(turns).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(examples).collect()}
    assert got == plain(ROWS)
    by = {(r.conv_id, r.example): r for r in examples.collect()}
    assert set(k for k in by if k[0] == 1) == {(1, 3), (1, 5)} and set(k for k in by if k[0] == 6) == {(6, 1), (6, 2)}
    first, second = by[1, 3], by[1, 5]
    assert second.formatted.startswith(first.formatted) and not first.whole and second.whole
    assert first.formatted[first.loss_start:first.loss_end] == r"yes" + "\n\\</turn>\n\\### user:\nno"
    assert by[3, 1].loss_start is None and by[6, 2].loss_start is None


def test_empty(spark):
    assert chat.digests(chat.prefix_examples(spark.createDataFrame(
        [], "conv_id bigint, turn int, role string, text string"))).count() == 0
