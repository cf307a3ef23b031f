"""Scalar functions. Each takes and returns Columns and stays inside the JVM."""

from tenderlens.functions.dates import normalize_award_date, parse_mixed_dates
from tenderlens.functions.entities import contract_type_label, extract_summary, infer_buyer_type, legal_limit
from tenderlens.functions.money import amount_flag, exact_sum, format_euros, format_pct, parse_money
from tenderlens.functions.places import (
    infer_geography,
    infer_municipality,
    normalize_municipality,
    normalize_province,
    province_from_postcode,
    province_in_text,
    region_from_province,
)
from tenderlens.functions.text import fold_text, let, squeeze, strip_marks, title_place

__all__ = [
    "amount_flag", "contract_type_label", "exact_sum", "extract_summary", "fold_text", "format_euros",
    "format_pct", "infer_buyer_type", "infer_geography", "infer_municipality", "legal_limit", "let",
    "normalize_award_date", "normalize_municipality", "normalize_province", "parse_mixed_dates", "parse_money",
    "province_from_postcode", "province_in_text", "region_from_province", "squeeze", "strip_marks", "title_place",
]
