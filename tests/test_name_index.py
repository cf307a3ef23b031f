"""Search by trigrams against the scan of all contracts."""

import random

import pytest
from pyspark.sql import functions as F

from tenderlens.operators import filters, name_index
from tenderlens.operators.filters import ContractFilter

PAIR = ["buyer", "municipality"]
ROWS = [
    (1, "Concello de Santiago de Compostela", "Santiago de Compostela", "ACME 50% S.L."), (2, "Ayuntamiento de València", None, "acme_b"),
    (3, "Diputación de A Coruña", "A Coruña", "Über Œuvre"), (4, None, "Vigo", "B"), (5, None, None, None), (6, "", "", ""),
    (7, "UTE", "aa", "aaaa"), (8, "ﬁrma Straße", "Ávila", "Acme"), (9, "Concello de Santiago de Compostela", None, "ACME 50% S.L."),
    (10, "aab", "baa", "  x   y "),
]


def contracts(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id int, buyer string, municipality string, supplier string")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """Two indexes, each made by two updates that overlap."""
    root = tmp_path_factory.mktemp("names")
    for name, columns in (("one", ["buyer"]), ("pair", PAIR)):
        for rows in (ROWS[:6], ROWS[3:], ROWS[:1]):
            name_index.update_name_index(contracts(spark, rows), str(root / name), columns)
    return root


def test_equals_the_scan(spark, indexed):
    rng, texts = random.Random(3), [" ".join(x or "" for x in r[1:3]) for r in ROWS]
    some = [t[i:i + rng.randrange(1, 9)] for t in texts if t.strip() for i in rng.sample(range(len(t)), 1)]
    table = contracts(spark)
    for term in [*some, "Santiago Compostela", "valencia", "coruna, vigo", "strasse", "straße", "aa", "a b", "baa aab", "absent", "%", "UT; aab"]:
        assert ids(name_index.search_names(table, str(indexed / "one"), term)) == ids(filters.search_buyers(table, term)), term
        found = name_index.search_names(table, str(indexed / "pair"), term, PAIR)
        assert ids(found) == ids(filters.search_buyer_or_place(table, term)), term
    assert ids(name_index.search_names(table, str(indexed / "one"), " , ")) == list(range(1, 11))


def test_each_name_is_held_once(spark, indexed):
    names = spark.read.parquet(str(indexed / "one" / "names"))
    assert names.count() == names.select("buyer").distinct().count() == 8


def test_supplier_text_of_a_filter(spark, tmp_path):
    table, path = contracts(spark), str(tmp_path / "s")
    name_index.update_name_index(table, path, ["supplier"], F.lower)
    for text in ("ACME", "50%", "acme_", "über", "œu", " x ", "b", "none of them"):
        spec = ContractFilter(supplier_contains=text, buyers=(*[r[1] for r in ROWS if r[1]],))
        assert ids(name_index.query_contracts_indexed(table, spec, path)) == ids(filters.query_contracts(table, spec)), text
    like = ContractFilter(supplier_contains="a%e", like=True)
    assert ids(name_index.query_contracts_indexed(table, like, path)) == ids(filters.query_contracts(table, like))


def test_only_folders_of_searched_grams_are_read(spark, indexed):
    names = name_index.matching_names(spark, str(indexed / "one"), [["vale"]])
    plan = names._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "gram#" in line]
    assert scans and all("bucket#" in s.split("PartitionFilters")[1].split("PushedFilters")[0] for s in scans)
    assert all("In(gram" in s for s in scans)
    read = name_index._read(spark, str(indexed / "one"), "grams")
    wanted = read.where(F.col("bucket").isin([name_index._bucket(F.lit(g)) for g in ("val", "ale")]))
    assert 0 < len(wanted.inputFiles()) and wanted.select("bucket").distinct().count() <= 2


def test_an_update_that_fails_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "n")
    with pytest.raises(ValueError):
        name_index.search_names(contracts(spark), path, "vigo")
    name_index.update_name_index(contracts(spark, ROWS[:2]), path)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(name_index.parts, "commit", broken)
        with pytest.raises(RuntimeError):
            name_index.update_name_index(contracts(spark), path)
    assert name_index.matching_names(spark, path, [["coruna"]]).count() == 0
    name_index.update_name_index(contracts(spark), path)
    assert [r.buyer for r in name_index.matching_names(spark, path, [["coruna"]]).collect()] == ["Diputación de A Coruña"]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "n")
    name_index.update_name_index(contracts(spark, []), path)
    assert name_index.search_names(contracts(spark), path, "ab").count() == 0
    name_index.update_name_index(contracts(spark), path)
    assert ids(name_index.search_names(contracts(spark), path, "vale")) == [2]
