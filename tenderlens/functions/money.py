"""Amounts: parsing, formatting, exact sums and the flags of the forensic scan."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tenderlens.functions.text import let
from tenderlens.refdata import AMOUNT_FLAGS, AMOUNTS, FLAG_OK

DASH = "—"
# Three digits after the last separator and at most three characters before it: a thousands mark.
COMMA_THOUSANDS = r"^[0-9,]{0,3},[0-9]{3}$"
DOT_THOUSANDS = r"^[0-9.]{0,3}\.[0-9]{3}$|\..*\."


def parse_money(c: Column) -> Column:
    """Amount in European, US or plain notation as double; unreadable or non-positive text is null."""
    def read(t: Column) -> Column:
        no_dots = F.replace(t, F.lit("."), F.lit(""))
        no_commas = F.replace(t, F.lit(","), F.lit(""))
        comma, dot = t.contains(","), t.contains(".")
        return (
            F.when(comma & dot & t.rlike(r",[^.]*$"), F.replace(no_dots, F.lit(","), F.lit(".")))
            .when(comma & dot, no_commas)
            .when(comma & t.rlike(COMMA_THOUSANDS), no_commas)
            .when(comma, F.replace(t, F.lit(","), F.lit(".")))
            .when(dot & t.rlike(DOT_THOUSANDS), no_dots)
            .otherwise(t)
        )

    def amount(text: Column) -> Column:
        negative = text.contains("-") & text.rlike(r"(?U)^\s*-")
        digits = F.regexp_replace(text, r"[^0-9.,]", "")
        return F.when(~negative, let(let(digits, read).try_cast("double"), lambda n: F.when(n > 0, n)))

    return let(c.cast("string"), amount)


def format_euros(c: Column) -> Column:
    """``1.234,56 €``; null becomes a dash."""
    text = F.concat(F.translate(F.format_number(c, 2), ",.", ".,"), F.lit(" €"))
    return F.when(c.isNull() | F.isnan(c), DASH).otherwise(text)


def format_pct(c: Column) -> Column:
    """``93,3 %`` without thousands marks; null becomes a dash."""
    text = F.concat(F.translate(F.format_number(c, 1), ".,", ","), F.lit(" %"))
    return F.when(c.isNull() | F.isnan(c), DASH).otherwise(text)


def exact_sum(c: Column) -> Column:
    """Sum to the cent, the same in any order of rows, so that thresholds never flip between runs.

    What is no amount of money, NaN, infinity and numbers of 10**16 and more, is left out of the sum.
    """
    return F.sum(c.try_cast("decimal(18,2)"))


def amount_flag(kind: Column, value: Column) -> Column:
    """Flag of one finding; only amounts can carry one."""
    def flag(n: Column) -> Column:
        out = F
        for low, high, text in AMOUNT_FLAGS:
            out = out.when(n.between(low, high), F.lit(text))
        return out.otherwise(FLAG_OK)

    return F.when(kind == AMOUNTS, let(parse_money(value), flag)).otherwise(FLAG_OK)
