"""Contract types, legal limits, buyer types and the entry summary."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tenderlens.functions.money import parse_money
from tenderlens.functions.text import first_found, let, lookup, not_empty
from tenderlens.refdata import (
    BUYER_TYPE_KEYWORDS,
    CONTRACT_TYPES,
    LIMIT_SERVICES,
    LIMIT_WORKS,
    OTHER_TYPE,
    SUMMARY_AMOUNT,
    SUMMARY_BUYER,
    WORKS,
)


def legal_limit(contract_type: Column) -> Column:
    is_works = F.coalesce(F.lower(contract_type).contains("obra"), F.lit(False))
    return F.when(is_works, LIMIT_WORKS).otherwise(LIMIT_SERVICES)


def contract_type_label(code: Column, is_works: Column) -> Column:
    """Label of a type code; without a code, works if another code says so."""
    named = let(not_empty(F.trim(code)), lambda clean: F.coalesce(lookup(clean, CONTRACT_TYPES), F.concat(F.lit("Tipo "), clean)))
    return F.coalesce(named, F.when(is_works, WORKS), F.lit(OTHER_TYPE))


def first_keyword(text: Column, keywords: tuple[tuple[str, str], ...]) -> Column:
    """Label of the first keyword that occurs in the text, in any case."""
    table: dict[str, str] = {}
    for word, label in keywords:
        table.setdefault(word.lower(), label)
    return first_found(F.lower(text), table)


def infer_buyer_type(buyer: Column) -> Column:
    return first_keyword(buyer, BUYER_TYPE_KEYWORDS)


def extract_summary(summary: Column) -> Column:
    """Buyer and amount named in the summary line, as a struct."""
    def read(text: Column) -> Column:
        buyer = not_empty(F.trim(F.regexp_extract(text, SUMMARY_BUYER, 1)))
        amount = parse_money(not_empty(F.regexp_extract(text, SUMMARY_AMOUNT, 1)))
        return F.struct(buyer.alias("buyer"), amount.alias("amount"))

    return let(summary, read)
