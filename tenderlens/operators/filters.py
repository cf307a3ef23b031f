"""Filters and tolerant search."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from tenderlens.functions import fold_text, let
from tenderlens.functions.places import fold_literal


@dataclass(frozen=True)
class ContractFilter:
    """Conditions that all must hold; an empty one is no condition.

    Text conditions find literal text in any case. ``like=True`` lets ``%`` and ``_`` act as wildcards.
    """

    regions: Iterable[str] = ()
    provinces: Iterable[str] = ()
    municipalities: Iterable[str] = ()
    buyer_types: Iterable[str] = ()
    buyers: Iterable[str] = ()
    years: Iterable[int] = ()
    contract_types: Iterable[str] = ()
    supplier_contains: str | None = None
    subject_contains: str | None = None
    buyer_contains: Iterable[str] = ()
    amount_min: float | None = None
    amount_max: float | None = None
    like: bool = False

    def _in_lists(self) -> dict[str, list]:
        lists = {
            "region": self.regions, "province": self.provinces, "municipality": self.municipalities,
            "buyer_type": self.buyer_types, "buyer": self.buyers, "fiscal_year": self.years,
            "contract_type": self.contract_types,
        }
        return {name: list(values) for name, values in lists.items() if values}

    def _has(self, name: str, text: str) -> Column:
        column, text = F.lower(name), text.lower()
        if self.like:
            return column.like("%" + text.replace("\\", "\\\\") + "%")
        return column.contains(text)

    def condition(self) -> Column | None:
        parts = [F.col(name).isin(values) for name, values in self._in_lists().items()]
        if self.supplier_contains:
            parts.append(self._has("supplier", self.supplier_contains))
        if self.subject_contains:
            parts.append(self._has("subject", self.subject_contains))
        words = [w.strip() for w in self.buyer_contains or () if w and w.strip()]
        if words:
            parts.append(reduce(or_, [self._has("buyer", w) for w in words]))
        if self.amount_min is not None:
            parts.append(F.col("amount") >= float(self.amount_min))
        if self.amount_max is not None:
            parts.append(F.col("amount") <= float(self.amount_max))
        return reduce(and_, parts) if parts else None


def query_contracts(contracts: DataFrame, spec: ContractFilter, limit: int | None = None) -> DataFrame:
    """Contracts that meet the filter. List and range conditions reach the Parquet scan."""
    condition = spec.condition()
    out = contracts if condition is None else contracts.where(condition)
    return out.limit(limit) if limit else out


def search_terms(text: str | Iterable[str]) -> list[str]:
    parts = re.split(r"[,;\n]+", text) if isinstance(text, str) else text
    return [fold_literal(p) for p in parts if p and p.strip()]


def tolerant_match(text: Column, terms: list[str]) -> Column:
    """Any term occurs in the folded text, whole or with all its words."""
    def found(folded: Column) -> Column:
        # All words occur wherever the whole term does, so the words alone decide.
        return reduce(or_, [reduce(and_, [folded.contains(w) for w in term.split()], F.lit(True)) for term in terms])

    return let(fold_text(F.coalesce(text, F.lit(""))), found)


def search_buyers(contracts: DataFrame, terms: str | Iterable[str]) -> DataFrame:
    """Contracts whose buyer matches a term; no term keeps everything."""
    folded = search_terms(terms)
    return contracts.where(tolerant_match(F.col("buyer"), folded)) if folded else contracts


def search_buyer_or_place(contracts: DataFrame, text: str) -> DataFrame:
    """Like ``search_buyers``, over buyer and municipality together."""
    folded = search_terms(text)
    if not folded:
        return contracts
    columns = [c for c in ("buyer", "municipality") if c in contracts.columns]
    if not columns:
        return contracts.where(F.lit(False))
    both = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    return contracts.where(tolerant_match(both, folded))


def reviewable_contracts(contracts: DataFrame, top: int = 40) -> DataFrame:
    """The contracts with the highest amounts."""
    columns = ["award_date", "supplier", "buyer", "contract_type", "amount", "subject"]
    ties = [F.asc(c) for c in columns if c != "amount"]
    return contracts.select(*columns).orderBy(F.desc_nulls_last("amount"), *ties).limit(top)
