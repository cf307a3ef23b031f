"""Forensic text scan: every match of the patterns, with its surroundings.

Each page is read where it lies: no shuffle, no Python. One pass of a pattern cuts the page into pieces, text and
matches in turn; the surroundings of a match are put together from its neighbours. Every match has at least one
character, so ``SCAN_CONTEXT`` matches on either side always cover the surroundings, and of each neighbour only the
nearest ``SCAN_CONTEXT`` characters are copied; where the text between matches is at least as long, the piece beside a match
is enough. The work grows linearly with the text. Matches are numbered within page and pattern, so their order can be
restored.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from tenderlens.functions import amount_flag, let
from tenderlens.refdata import AMOUNTS, SCAN_CONTEXT, SCAN_PATTERNS


MARK = "\uffff"  # not a character: it does not occur in text, and a page that has it all the same goes the long way
# A page without any of these cannot match.
NEEDED = {"Emails": ("@",), AMOUNTS: ("€", "euros", "EUR")}
# What the matcher can tell of a place before it tries the pattern there; no match is lost. A boundary of words is dear to
# test, so a look at the next character goes first. A match that could begin within a run of its own characters begins at
# the run's start or where the last match ended, so a long run is not tried from each of its characters.
BEGINS = {
    "Emails": r"(?:(?<![a-zA-Z0-9._%+-])|\G)",
    "DNI/NIF": r"(?=\d)",
    "IBAN": r"(?=[A-Z])",
    "Teléfonos": r"(?=[+0679])",
    "Fechas": r"(?=\d)",
    AMOUNTS: r"(?=[0-9.,])(?:(?<![0-9.,])|\G)",
}


def _pieces(text: str, kind: str) -> Column:
    """Text before the first match, first match, text after it, and so on."""
    regex = f"(?U){BEGINS.get(kind, '')}(?:{SCAN_PATTERNS[kind]})"  # word boundaries, digits and spaces as in Unicode
    marked = F.split(F.regexp_replace(text, regex, f"{MARK}$0{MARK}"), MARK, -1)
    matches = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    two_passes = F.flatten(F.zip_with(F.split(text, regex, -1), matches, lambda gap, hit: F.array(gap, hit)))
    return F.when(F.col(text).contains(MARK), two_passes).otherwise(marked)


def _hits(text: str, kind: str) -> Column:
    """Array of (value, context, ordinal) for one pattern, null if there is no match."""
    reach = 2 * SCAN_CONTEXT + 1

    def with_context(parts: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            first = F.greatest(i - reach, F.lit(0))
            before = F.right(F.array_join(F.slice(parts["ends"], first + 1, i - first), ""), F.lit(SCAN_CONTEXT))
            after = F.left(F.array_join(F.slice(parts["starts"], i + 2, reach), ""), F.lit(SCAN_CONTEXT))
            context = F.replace(F.concat(before, piece, after), F.lit("\n"), F.lit(" "))
            hit = F.struct(piece.alias("value"), F.concat(F.lit("..."), context, F.lit("...")).alias("context"),
                           F.shiftright(i, 1).alias("ordinal"))
            return F.when((i % 2 == 1) & piece.isNotNull(), hit)

        return F.filter(F.transform(parts["pieces"], one), lambda hit: hit.isNotNull())

    def beside(pieces: Column) -> Column:
        """The hits of a page where the pieces beside a match cover its surroundings."""
        def one(piece: Column, i: Column) -> Column:
            before, after = F.right(F.get(pieces, i - 1), F.lit(SCAN_CONTEXT)), F.left(F.get(pieces, i + 1), F.lit(SCAN_CONTEXT))
            context = F.replace(F.concat(before, piece, after), F.lit("\n"), F.lit(" "))
            return F.when(i % 2 == 1, F.struct(
                piece.alias("value"), F.concat(F.lit("..."), context, F.lit("...")).alias("context"), F.shiftright(i, 1).alias("ordinal")))

        return F.filter(F.transform(pieces, one), lambda hit: hit.isNotNull())

    def cut(pieces: Column) -> Column:
        size = F.size(pieces)
        short = F.filter(pieces, lambda p, i: (i % 2 == 0) & (i > 0) & (i < size - 1) & (F.length(p) < SCAN_CONTEXT))
        near = F.struct(
            pieces.alias("pieces"), F.transform(pieces, lambda p: F.right(p, F.lit(SCAN_CONTEXT))).alias("ends"),
            F.transform(pieces, lambda p: F.left(p, F.lit(SCAN_CONTEXT))).alias("starts"),
        )
        covered = (size % 2 == 1) & ((size == 3) | (F.size(short) == 0))
        return F.when(size <= 1, None).when(covered, beside(pieces)).otherwise(let(near, with_context))

    hits = let(_pieces(text, kind), cut)
    if kind in NEEDED:
        return F.when(reduce(or_, [F.col(text).contains(word) for word in NEEDED[kind]]), hits)
    return hits


def scan_text(pages: DataFrame, patterns: Iterable[str] | None = None) -> DataFrame:
    """Matches of the chosen patterns (all by default) on each page."""
    chosen = [name for name in SCAN_PATTERNS if patterns is None or name in set(patterns)]
    kinds = F.array(*[
        F.struct(F.lit(name).alias("kind"), _hits("text", name).alias("hits")) for name in chosen
    ])
    return (
        pages.where(F.col("text") != "")
        .select("doc_id", "page", F.inline(kinds))
        .select("doc_id", "page", F.concat(F.lit("Pág. "), "page").alias("location"), "kind", F.inline("hits"))
    )


def flag_findings(findings: DataFrame) -> DataFrame:
    """Findings with the flag of suspicious amounts."""
    return findings.withColumn("flag", amount_flag(F.col("kind"), F.col("value")))
