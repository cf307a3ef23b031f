"""Award dates and dates in mixed notations. Every row is read on its own."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tenderlens.functions.text import let

ISO = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T\s]|$)"
YEAR_FIRST = r"^\s*(\d{4})([/.]?)(\d{1,2})\2(\d{1,2})(?:\D|$)"
COMPACT = r"^\s*\d{8}(?:\D|$)"
DAY_FIRST = r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})(?:\D|$)"
AWARD = r"^(\d{1,4})-(\d{1,2})-(\d{1,2})"


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month, day).try_cast("date")


def parse_mixed_dates(c: Column) -> Column:
    """Dates with the year first as they are (1999-12-31, 1999/12/31, 1999.12.31, 19991231), other notations day first.

    What cannot be read is null.
    """
    def iso(i: int) -> Column:
        return F.regexp_extract(c, ISO, i)

    def local(i: int) -> Column:
        return F.regexp_extract(c, DAY_FIRST, i)

    # Two-digit years follow the POSIX pivot.
    short = local(3).try_cast("int")
    year = F.when(F.length(local(3)) == 4, short).when(short >= 69, short + 1900).otherwise(short + 2000)
    day_first = F.coalesce(_date(year, local(2), local(1)), _date(year, local(1), local(2)))
    def leading(i: int) -> Column:
        return F.regexp_extract(c, YEAR_FIRST, i)

    # Without separators only eight digits are a date.
    year_first = c.rlike(YEAR_FIRST) & ((leading(2) != "") | c.rlike(COMPACT))
    return (
        F.when(c.rlike(ISO), _date(iso(1), iso(2), iso(3)))
        .when(year_first, _date(leading(1), leading(3), leading(4)))
        .when(c.rlike(DAY_FIRST), day_first)
    )


def normalize_award_date(c: Column, min_year: int = 2010, max_year: int | None = None) -> Column:
    """Date at the start of the text; years like 0023 are repaired, implausible years are null.

    ``max_year`` is the year after the current one unless given.
    """
    last = F.lit(max_year) if max_year else F.year(F.current_date()) + 1

    def year(written: Column) -> Column:
        repaired = (F.length(written) == 4) & written.startswith("00")
        return F.when(repaired, F.substring(written, 3, 2).try_cast("int") + 2000).otherwise(written.try_cast("int"))

    def made(parts: Column) -> Column:
        return let(year(parts[0]), lambda y: F.when(y.between(F.lit(min_year), last), _date(y, F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))))

    # One search: it gives year, month and day, or nothing, of which no year can be read.
    return let(F.split(F.regexp_extract(F.trim(c), AWARD, 0), "-"), made)
