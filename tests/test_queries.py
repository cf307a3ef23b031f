"""Registered queries against their SQL counterparts on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tenderlens.plans import catalog, oracle
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
HEADLINES = (
    "radar", "report_summary", "priority_alerts", "graph_edges", "graph_nodes", "scan_text", "feed_contracts", "facet_cascade",
    "budget_ranking", "budget_entity_detail", "spend_concentration", "amount_histogram", "territory_all_levels", "fold_text",
    "contract_territory", "query_contracts", "radar_amounts", "priority_case",
    "feed_rejects", "feed_page_chain_whole",
    "contracts_parquet_sink", "query_contracts_table", "budget_source", "manifest_source", "flag_findings",
    "first_territory", "supplier_timeline", "stream_contracts", "stream_radar", "dataset_metadata",
    "graph_filter", "parse_mixed_dates", "province_in_text",
    "report_alert_table", "report_alert_amounts", "feed_chain_rank", "contracts_part_rewritten",
    "feed_contracts_split", "search_buyers_indexed", "search_buyer_or_place_indexed", "query_contracts_indexed",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.sql())
    assert set(entry.queries()) >= set(catalog.QUERIES) and set(entry.oracle_sql()) >= set(oracle.sql())


@pytest.mark.parametrize("name", HEADLINES)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
