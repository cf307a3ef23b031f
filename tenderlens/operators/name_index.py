"""Substring search over names by an index of their trigrams.

Contracts are many, their names few: the index holds each distinct name once and, for each of its trigrams, a row
(gram, id). A search reads the rows of the searched trigrams, keeps the names that have all of them, checks these exactly
and takes the contracts with a semi join, so no contract is searched for text. Gram rows lie in folders by a hash
of the gram, sorted by gram, so only the folders and row groups of the searched grams are read. A frequent trigram is many
rows, never one long list. A search whose words are all shorter than three characters checks all names, still not all contracts.

An update adds the names that are not there yet, as a version of its own that counts once it is in the registry; one that
fails leaves nothing to be found. Two updates at once may both add a name, which changes no result. Names that no contract
has any more do no harm. A search finds contracts whose names were in the table at the last update.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderlens.functions import fold_text
from tenderlens.operators.filters import ContractFilter, query_contracts, search_terms
from tenderlens.sources import parts

GRAM = 3
BUCKETS = 64

Normal = Callable[[Column], Column]


def _text(columns: Iterable[str], normal: Normal) -> Column:
    return normal(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def _same(names: DataFrame, columns: Iterable[str]) -> Column:
    """Equal names, where a missing one equals a missing one."""
    return reduce(and_, [F.col(f"c.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns])


def _bucket(gram: Column) -> Column:
    return F.pmod(F.hash(gram), F.lit(BUCKETS))


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """Rows of all updates that came to their end."""
    if not parts.is_committed(spark, path):
        return None
    versions = [version for _, version in parts.current(spark, path)]
    return spark.read.parquet(f"{path.rstrip('/')}/{kind}").where(F.col("version").isin(versions))


def update_name_index(contracts: DataFrame, path: str, columns: Iterable[str] = ("buyer",), normal: Normal = fold_text) -> None:
    """Add the names of contracts that the index lacks. An index holds one set of columns, taken together as one text."""
    spark, columns, version = contracts.sparkSession, list(columns), parts.new_version()
    names = contracts.select(*columns).distinct()
    known = _read(spark, path, "names")
    if known is not None:
        names = names.alias("c").join(known.select(*columns).alias("n"), _same(known, columns), "left_anti")
    place = f"{path.rstrip('/')}/names/version={version}"
    # Ids are given in the stored rows, so grams and names agree whatever is computed twice.
    names.select(*columns, _text(columns, normal).alias("text"), F.monotonically_increasing_id().alias("id")).write.parquet(place)
    stored = spark.read.parquet(place)
    last = F.length("text") - (GRAM - 1)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr("text", i, F.lit(GRAM))))
    rows = stored.where(last > 0).select("id", F.explode(grams).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    (
        rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "gram")
        .write.partitionBy("bucket").parquet(f"{path.rstrip('/')}/grams/version={version}")
    )
    parts.commit(spark, path, [(version, version)])


def matching_names(spark: SparkSession, path: str, terms: list[list[str]]) -> DataFrame | None:
    """Names that hold all words of any term; None for an index without a finished update."""
    names = _read(spark, path, "names")
    if names is None:
        return None
    searched = [sorted({w[i:i + GRAM] for w in words for i in range(len(w) - GRAM + 1)}) for words in terms]
    exact = reduce(or_, [reduce(and_, [F.contains("text", F.lit(w)) for w in words], F.lit(True)) for words in terms])
    if all(searched):
        every = sorted({g for grams in searched for g in grams})
        # Constants that Spark folds while planning, so that only the folders of these buckets are listed.
        wanted = F.col("bucket").isin([_bucket(F.lit(g)) for g in every]) & F.col("gram").isin(every)
        all_of = [F.count_if(F.col("gram").isin(grams)) == len(grams) for grams in searched]
        found = _read(spark, path, "grams").where(wanted).groupBy("version", "id").agg(reduce(or_, all_of).alias("all_grams"))
        names = names.join(found.where("all_grams").select("version", "id"), ["version", "id"], "left_semi")
    return names.where(exact)


def _with_names(contracts: DataFrame, path: str, columns: list[str], terms: list[list[str]]) -> DataFrame:
    names = matching_names(contracts.sparkSession, path, terms)
    if names is None:
        raise ValueError(f"no name index at {path}")
    # Rebalanced, so that adaptive execution can split the contracts of a hot name.
    found = names.select(*columns).hint("rebalance").alias("n")
    return contracts.alias("c").join(found, _same(found, columns), "left_semi")


def search_names(contracts: DataFrame, path: str, terms: str | Iterable[str], columns: Iterable[str] = ("buyer",)) -> DataFrame:
    """``search_buyers``, or with buyer and municipality ``search_buyer_or_place``, by an index of folded names."""
    words = [term.split() for term in search_terms(terms)]
    return _with_names(contracts, path, list(columns), words) if words else contracts


def query_contracts_indexed(contracts: DataFrame, spec: ContractFilter, path: str) -> DataFrame:
    """``query_contracts``, where the text in the supplier is found by an index of suppliers (``normal=F.lower``)."""
    if not spec.supplier_contains or spec.like:
        return query_contracts(contracts, spec)
    rest = query_contracts(contracts, replace(spec, supplier_contains=None))
    return _with_names(rest, path, ["supplier"], [[spec.supplier_contains.lower()]])
