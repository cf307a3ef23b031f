"""Place names: provinces, regions and municipalities."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from tenderlens.functions.entities import first_keyword
from tenderlens.functions.text import first_found, fold_text, let, lookup, squeeze, strip_marks, title_place
from tenderlens.refdata import (
    AUTONOMOUS_CITIES,
    CORUNA_SPELLINGS,
    INE_PROVINCES,
    MUNICIPALITY_ARTICLE,
    MUNICIPALITY_PATTERNS,
    MUNICIPALITY_PREFIX,
    MUNICIPALITY_SUFFIX,
    PROVINCE_REGION,
    PROVINCES_LONGEST_FIRST,
    REGION_KEYWORDS,
    VALENCIA_SPELLINGS,
)


def fold_literal(text: str, collapse: bool = True) -> str:
    """The folding of ``fold_text`` for a search term or a reference name."""
    plain = "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x)).lower()
    return " ".join(plain.split()) if collapse else plain


def _first_by_fold(names: tuple[str, ...]) -> dict[str, str]:
    table: dict[str, str] = {}
    for name in names:
        table.setdefault(fold_literal(name), name)
    return table


FOLDED_PROVINCES = _first_by_fold(PROVINCES_LONGEST_FIRST)
FOLDED_REGIONS = {fold: PROVINCE_REGION[name] for fold, name in _first_by_fold(tuple(PROVINCE_REGION)).items()}


def _place_key(folded: Column) -> Column:
    return squeeze(F.translate(folded, ",()", "   "))


def normalize_province(c: Column) -> Column:
    def name(text: Column) -> Column:
        return let(_place_key(fold_text(text)), lambda key: F.coalesce(
            F.when(key.isin(*CORUNA_SPELLINGS), "A Coruña"),
            lookup(key, FOLDED_PROVINCES),
            title_place(text),
        ))

    return let(strip_marks(c), name)


def province_from_postcode(c: Column) -> Column:
    code = F.regexp_extract(c, r"(?U)\b(\d{2})\d{3}\b", 1)
    return lookup(code, INE_PROVINCES)


def province_in_text(c: Column) -> Column:
    """Longest province name that occurs in the folded text."""
    return first_found(fold_text(c), FOLDED_PROVINCES)


def region_from_province(c: Column) -> Column:
    return F.coalesce(lookup(c, PROVINCE_REGION), lookup(fold_text(c), FOLDED_REGIONS))


def normalize_municipality(c: Column) -> Column:
    """Title-cased municipality without a trailing province."""
    def without_province(text: Column, folded: Column) -> Column:
        def cut(province: Column) -> Column:
            bare = F.trim(F.regexp_replace(text, r"(?U)\s*\([^)]*\)\s*$", ""))
            tail = F.concat(F.lit(r"(?iU)\s*[-,/]\s*\Q"), province, F.lit(r"\E\s*$"))
            # Most names have no mark before a province; for those the pattern, another for each province, is not built.
            return (
                F.when(province.isNull(), text).when(bare.rlike("[-,/]"), F.trim(F.regexp_replace(bare, tail, F.lit(""))))
                .otherwise(F.trim(bare))
            )

        return let(first_found(folded, FOLDED_PROVINCES), cut)

    def name(text: Column) -> Column:
        return let(fold_text(text), lambda folded: let(_place_key(folded), lambda key: (
            F.when(key.isin(*CORUNA_SPELLINGS), "A Coruña")
            .when(key.isin(*VALENCIA_SPELLINGS), "Valencia")
            .otherwise(title_place(without_province(text, folded)))
        )))

    return let(strip_marks(c), name)


def infer_municipality(buyer: Column) -> Column:
    """Municipality that a local buyer states in its name."""
    def clean(found: Column) -> Column:
        name = F.regexp_replace(found, r"^[ .:;,_]+|[ .:;,_]+$", "")
        for pattern in (MUNICIPALITY_ARTICLE, MUNICIPALITY_PREFIX, MUNICIPALITY_SUFFIX):
            name = F.trim(F.regexp_replace(name, f"(?iU){pattern}", ""))
        return name

    def accept(pattern: str, text: Column) -> Column:
        found = clean(F.trim(F.regexp_extract(text, f"(?iU){pattern}", 1)))
        return let(found, lambda name: F.when(F.length(name).between(2, 80), name))

    def name(text: Column) -> Column:
        cities = [F.when(F.lower(text).contains(key), city) for key, city in AUTONOMOUS_CITIES]
        return F.coalesce(*cities, *[accept(p, text) for p in MUNICIPALITY_PATTERNS])

    return let(squeeze(buyer), name)


def infer_geography(buyer: Column) -> Column:
    """Struct of province and region named by the buyer: a region's own government first, then a province.

    A pure expression: on wide tables it costs less than a distinct and a join back, and knows no skew.
    """
    def place(found: Column) -> Column:
        by_name = found["by_name"]
        return F.struct(
            F.when(found["government"].isNull(), by_name).alias("province"),
            F.coalesce(found["government"], lookup(by_name, PROVINCE_REGION)).alias("region"),
        )

    found = F.struct(
        first_keyword(buyer, REGION_KEYWORDS).alias("government"),
        first_found(F.lower(buyer), {p.lower(): p for p in PROVINCES_LONGEST_FIRST}).alias("by_name"),
    )
    return let(found, place)
