"""Token counts of fields and sections, attributed through offsets.

Counting a section by encoding it alone gives other numbers than it has in its document, as merges cross its bounds. Here
every document is encoded once, as a whole; each token's span of characters, known from the lengths of the tokens, is joined
with the spans of the sections, both in order, so the join is one pass within the row. A token that crosses a bound is
allocated by a stated rule:

    start  the section that holds its first character
    end    the section that holds its last character
    most   the section that holds most of its characters, the first of equals
    share  every section that it touches, in parts by characters (n_tokens is then no whole number)

With any rule the counts of a document's sections add up to the tokens of the document. A token that is a part of a
character has that character as its span.

Sections are the document's fields, or the lines of its fields, a line with the break that ends it; fields are joined by
a line break that counts to the earlier one.

Defined cases: null and empty fields are empty sections with no tokens but for their break; an empty last line is none; a
text of any length is one row of work; repeated rows are counted each; columns not named are not read; an empty table has
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderlens.llm import bpe
from tenderlens.llm.common import slices

RULES = ("start", "end", "most", "share")


def token_spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of each token."""
    stop = np.cumsum(sizes[ids])
    start = stop - sizes[ids]
    if len(stop) and stop[-1] > len(text):  # characters of several bytes: the one that each byte is in
        raw = np.frombuffer(text.encode(), np.uint8)
        of = np.cumsum((raw & 0xC0) != 0x80) - 1
        return of[start], of[stop - 1] + 1
    return start, stop


def allocate(start: np.ndarray, stop: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; section k reaches from bounds[k] to bounds[k + 1], and sections may be empty."""
    n = len(bounds) - 1
    first = np.searchsorted(bounds, start, "right") - 1
    last = np.searchsorted(bounds, stop - 1, "right") - 1
    if rule in ("start", "end"):
        return np.bincount(first if rule == "start" else last, minlength=n).astype(np.float64)
    out = np.bincount(first[first == last], minlength=n).astype(np.float64)
    for t in np.flatnonzero(first != last):
        held = np.minimum(bounds[first[t] + 1:last[t] + 2], stop[t]) - np.maximum(bounds[first[t]:last[t] + 1], start[t])
        if rule == "most":
            out[first[t] + int(held.argmax())] += 1
        else:
            out[first[t]:last[t] + 1] += held / held.sum()
    return out


def sections(fields: list[str | None], by: str) -> tuple[str, list[int], list[int]]:
    """The document, the bounds of its sections, and the field of each."""
    texts = [f or "" for f in fields]
    text, bounds, owner = "\n".join(texts), [0], []
    at = 0
    for k, field in enumerate(texts):
        end = at + len(field) + (k < len(texts) - 1)
        if by == "line":
            while (cut := text.find("\n", at, end - 1)) >= 0:
                at = cut + 1
                bounds.append(at)
                owner.append(k)
        bounds.append(end)
        owner.append(k)
        at = end
    return text, bounds, owner


def section_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), by: str = "line",
                   rule: str = "start", lexicon: str | None = None) -> DataFrame:
    """id, field, section (number within the document), start, end (code points), n_tokens; narrow after the lexicon."""
    if rule not in RULES or by not in ("line", "field"):
        raise ValueError(f"rule is one of {', '.join(RULES)}, by is line or field")
    lexicon = lexicon or bpe.build_lexicon(docs, vocabulary, fields[-1])
    rows = docs.select(F.col(id_col), *(F.col(f).cast("string").alias(f"_f{k}") for k, f in enumerate(fields)))
    longest = F.concat_ws("\n", *(f"_f{k}" for k in range(len(fields)))).alias("_all")
    rows = rows.select("*", longest) if len(fields) > 1 else rows
    kind = rows.schema[0].dataType.simpleString()
    names = [id_col, "field", "section", "start", "end", "n_tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = bpe.encoder(vocabulary, lexicon)
        sizes = np.fromiter(map(len, code.merger.token), np.int64)
        for b in slices(batches, b_text, bpe.SLICE):
            cut = [sections(list(f), by) for f in zip(*(b.column(1 + k).to_pylist() for k in range(len(fields))))]
            counts = []
            for (text, bounds, _), ids in zip(cut, code.encode([c[0] for c in cut])):
                start, stop = token_spans(text, ids, sizes)
                counts.append(allocate(start, stop, np.array(bounds), rule))
            n = [len(c[2]) for c in cut]
            tokens = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))),
                pa.array([fields[k] for c in cut for k in c[2]], pa.string()),
                pa.array(np.concatenate([np.arange(k) for k in n]).astype(np.int32)),
                pa.array([v for c in cut for v in c[1][:-1]], pa.int64()), pa.array([v for c in cut for v in c[1][1:]], pa.int64()),
                pa.array(tokens if rule == "share" else tokens.astype(np.int64))], names)

    b_text = 1 + len(fields) if len(fields) > 1 else 1
    return rows.mapInArrow(work, f"`{id_col}` {kind}, field string, section int, start bigint, end bigint, n_tokens "
                           + ("double" if rule == "share" else "bigint"))
