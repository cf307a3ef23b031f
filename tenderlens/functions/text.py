"""Text folding and place-name casing."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Mapping
from functools import cache

from pyspark.sql import Column, functions as F

from tenderlens.refdata import PLACE_STOP_WORDS

UNIT = "\u001f"  # separates the items of constant lists
HANGUL = range(0xAC00, 0xD7A4)  # composed syllables: they fold the same on both sides of a comparison


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def not_empty(c: Column) -> Column:
    """Empty text as null; ``c`` is evaluated once."""
    return let(c, lambda t: F.when(t != "", t))


def strings(values: Iterable[str]) -> Column:
    """Constant array of strings. One literal that Spark folds at planning time, however long the list."""
    return F.split(F.lit(UNIT.join(values)), UNIT)


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of ``key`` in a small fixed table, null if absent."""
    return F.try_element_at(F.map_from_arrays(strings(table), strings(table.values())), key)


def first_found(text: Column, words: Mapping[str, str]) -> Column:
    """Label of the first word of the table that occurs in the text."""
    def label(t: Column) -> Column:
        return lookup(F.get(F.filter(strings(words), lambda w: t.contains(w)), F.lit(0)), words)

    return let(text, label)


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_marks(c: Column) -> Column:
    """Drop white space and loose punctuation around a name; an empty rest is null."""
    return not_empty(F.regexp_replace(squeeze(c), r"^[ .:;,_]+|[ .:;,_]+$", ""))


@cache
def _foldings() -> tuple[str, str, str, dict[str, str]]:
    """Characters that fold to one other, what they fold to, and those that fold to several."""
    single, several = {}, {}
    for point in range(0x80, 0x10000):
        if 0xD800 <= point <= 0xDFFF or point in HANGUL:
            continue
        ch = chr(point)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if base != ch and base:
            (single if len(base) == 1 else several)[ch] = base
    return "".join(single), "".join(single.values()), "".join(several), several


@cache
def _anything_but(chars: str) -> str:
    """Pattern for runs of other characters, in as few ranges as possible."""
    points = sorted(map(ord, chars))
    starts = [p for i, p in enumerate(points) if i == 0 or p > points[i - 1] + 1]
    ends = [p for i, p in enumerate(points) if i == len(points) - 1 or points[i + 1] > p + 1]
    return "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True)) + "]+"


def _without_accents(c: Column) -> Column:
    source, target, wide, spelling = _foldings()

    def spell_out(text: Column) -> Column:
        """Replace the few distinct ligatures and the like, one after the other."""
        found = F.array_distinct(F.split(F.regexp_replace(text, _anything_but(wide), ""), ""))
        return F.aggregate(found, text, lambda t, ch: F.replace(t, ch, F.coalesce(lookup(ch, spelling), ch)))

    plain = F.regexp_replace(F.translate(c, source, target), r"\p{Mn}+", "")
    # Deleting characters is a hash lookup each, so texts without ligatures are passed on quickly.
    has_wide = F.length(F.translate(c, wide, "")) < F.length(c)
    return F.when(has_wide, let(plain, spell_out)).otherwise(plain)


def fold_text(c: Column, collapse: bool = True, casefold: bool = False) -> Column:
    """Lower case without accents, for comparing names. ASCII text skips the accent tables."""
    folded = let(c, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), _without_accents(x)).otherwise(x))
    folded = F.lower(folded)
    if casefold:
        folded = F.replace(folded, F.lit("ß"), F.lit("ss"))
    return squeeze(folded) if collapse else folded


def title_place(c: Column) -> Column:
    """Title case for place names; small words stay in lower case unless they come first."""
    def word(w: Column, i: Column) -> Column:
        small = (i > 0) & w.isin(*PLACE_STOP_WORDS)
        return F.when(small, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))

    return F.array_join(F.transform(F.split(squeeze(F.lower(c)), " "), word), " ")
