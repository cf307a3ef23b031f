import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from tenderlens.operators import budget, facets, filters, forensic, graph, rankings
from tenderlens.refdata import SCAN_CONTEXT, SCAN_PATTERNS


@pytest.fixture(scope="module")
def buyers(spark):
    return spark.createDataFrame([
        ("Alcaldía del Concello de Santiago de Compostela", None),
        ("Alcaldía del Ayuntamiento de Santiago del Teide", "Santiago del Teide"),
        ("Presidencia de la Diputación Provincial de Valencia", None),
        ("Junta de Gobierno Local", "Santiago de Compostela"),
        ("Alcaldía del Concello de A Coruña", "A Coruña"),
    ], "buyer string, municipality string")


def found(df, column="buyer"):
    return sorted(r[column] for r in df.collect())


def test_search_buyers(buyers):
    compostela = ["Alcaldía del Concello de Santiago de Compostela"]
    assert found(filters.search_buyers(buyers, ["Santiago de Compostela"])) == compostela
    assert found(filters.search_buyers(buyers, ["Santiago Compostela"])) == compostela
    assert found(filters.search_buyers(buyers, ["València"])) == ["Presidencia de la Diputación Provincial de Valencia"]
    assert filters.search_buyers(buyers, ["", " "]).count() == 5


def test_search_buyer_or_place(buyers):
    assert len(found(filters.search_buyer_or_place(buyers, "Compostela"))) == 2
    assert found(filters.search_buyer_or_place(buyers, "coruna")) == ["Alcaldía del Concello de A Coruña"]
    assert len(found(filters.search_buyer_or_place(buyers, "teide; valencia\ncoruña"))) == 3


def test_filters_take_text_literally_unless_like(spark):
    rows = spark.createDataFrame([("A%B", "s", 10.0), ("AxB", "s", 20.0), ("A\\B", None, 30.0)],
                                 "supplier string, subject string, amount double")

    def pick(**spec):
        return [r.supplier for r in filters.query_contracts(rows, filters.ContractFilter(**spec)).orderBy("amount").collect()]

    assert pick(supplier_contains="a%b") == ["A%B"]
    assert pick(supplier_contains="a_b", like=True) == ["A%B", "AxB", "A\\B"]
    assert pick(supplier_contains="a\\b", like=True) == ["A\\B"]
    assert pick(amount_min=10, amount_max=20) == ["A%B", "AxB"]
    assert pick(subject_contains="S") == ["A%B", "AxB"]
    assert len(pick()) == 3
    assert filters.query_contracts(rows, filters.ContractFilter(), limit=2).count() == 2


def test_list_and_range_conditions_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([("Galicia", 2024, 5.0, "x")], "region string, fiscal_year int, amount double, buyer string").write.parquet(path)
    picked = filters.query_contracts(spark.read.parquet(path), filters.ContractFilter(regions=["Galicia"], amount_min=1)).select("buyer")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "In(region" in plan or "EqualTo(region" in plan
    assert "GreaterThanOrEqual(amount,1.0)" in plan and "fiscal_year" not in plan.split("ReadSchema")[1]


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame([
        ("ACME", 14900.0, "2024-01-10", "Servicios", "Concello X", "s1", 2024, "Galicia", "Lugo", "Rois", "45000000"),
        ("ACME", 14500.0, "2024-01-28", "Servicios", "Concello X", "s2", 2024, "Galicia", "Lugo", "Rois", None),
        ("BETA", 1200.0, "2023-05-02", "Obras", "Concello Y", "s3", 2023, "Aragón", None, None, "None"),
        ("No consta", 99.0, None, "Obras", "Concello Y", "s4", 2023, None, None, None, None),
    ], "supplier string, amount double, award_date string, contract_type string, buyer string, subject string, "
       "fiscal_year int, region string, province string, municipality string, cpv string"
    ).withColumn("award_date", F.col("award_date").cast("date"))


def test_rankings(few):
    assert [(r.supplier, r.total, r.n_contracts) for r in rankings.top_suppliers(few, 2).collect()] == [
        ("ACME", 29400.0, 2), ("BETA", 1200.0, 1)]
    assert rankings.buyer_supplier_relations(few, None, known_only=True).count() == 2
    shares = [round(r.running_pct, 4) for r in rankings.spend_concentration(few).collect()]
    assert shares == [round(29400 / 30699 * 100, 4), round(30600 / 30699 * 100, 4), 100.0]
    sizes = {r.amount: r.marker_size for r in rankings.supplier_timeline(few).collect()}
    assert sizes[14900.0] == 28.0 and len(sizes) == 3
    heat = rankings.monthly_heatmap(few).collect()
    assert [(r.year, r.m01, r.m05, r.m12) for r in heat] == [(2024, 29400.0, 0.0, 0.0), (2023, 0.0, 1200.0, 0.0)]


def test_territory(few):
    assert [(r.place, r.value) for r in rankings.spend_by_territory(few).collect()] == [("Aragón", 1200.0), ("Galicia", 29400.0)]
    assert {r.level for r in rankings.first_territory(few).collect()} == {"region"}
    assert {r.level for r in rankings.first_territory(few.withColumn("region", F.lit(None).cast("string"))).collect()} == {"province"}
    assert [(r.place, r.lat) for r in rankings.territory_map(few).collect()] == [("Lugo", 43.01)]
    with pytest.raises(ValueError):
        rankings.territory_map(few, "municipality")


def test_histogram_of_equal_amounts_is_one_bin(spark):
    rows = spark.createDataFrame([("a", 5.0)] * 3 + [("a", -1.0)], "contract_type string, amount double")
    assert [(r.bin, r.bin_start, r.n_contracts) for r in rankings.amount_histogram(rows).collect()] == [(1, 5.0, 3)]


def test_facets(few):
    assert [r.value for r in facets.facet_values(few, "region").collect()] == ["Aragón", "Galicia"]
    assert [r.value for r in facets.facet_values(few, "supplier", {"region": ["Aragón"]}).collect()] == ["BETA"]
    cascade = facets.facet_cascade(few.withColumn("buyer_type", F.lit("x")), regions=["Aragón"])
    assert {(r.facet, r.value, r.n) for r in cascade.collect()} == {
        ("region", "Aragón", 1), ("region", "Galicia", 2), ("buyer_type", "x", 4)}
    cover = facets.municipal_coverage(few, "rois").first()
    assert (cover.n_buyers, cover.n_municipal_buyers, cover.contracts_located, cover.municipal_located) == (2, 2, 2, 1)
    assert facets.municipal_coverage(few).first().contracts_located == 0
    assert facets.dataset_metadata(few.limit(0)).first().total_amount == 0.0


def test_graph_reads_contracts_once(spark, few, tmp_path):
    few.write.parquet(f"{tmp_path}/contracts")
    folds = graph.graph_folds(spark.read.parquet(f"{tmp_path}/contracts"))
    assert folds._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert folds.groupBy("supplier", "prefix", "value").count().where("count > 1").isEmpty()
    folds.write.parquet(f"{tmp_path}/folds")
    stored = graph.edges_of_folds(spark.read.parquet(f"{tmp_path}/folds"))
    assert sorted(stored.collect()) == sorted(graph.graph_edges(few).collect())
    assert "/contracts" not in stored._jdf.queryExecution().executedPlan().toString()
    assert graph.graph_edges(few.limit(0)).isEmpty() and graph.graph_edges(few, top=1).where("depth = 1").count() == 1
    with pytest.raises(ValueError):
        graph.graph_edges(few, top=0)


def test_graph(few):
    edges = graph.graph_edges(few)
    nodes = {r.node: r for r in graph.graph_nodes(edges).collect()}
    assert nodes["adj::ACME"].total == 29400.0  # pairs only
    assert nodes["tipo::Servicios"].total == 29400.0
    assert "cpv::None" not in nodes and nodes["cpv::45000000"].level == 3
    assert max(n.size for n in nodes.values()) == 43.0
    shown = {r.node: r.degree for r in graph.graph_filter(edges, graph.graph_nodes(edges), 1).collect()}
    assert shown == {"org::Concello X": 1, "adj::ACME": 1, "org::Concello Y": 1, "adj::BETA": 1}
    hidden = graph.graph_filter(edges, graph.graph_nodes(edges), 3, ["organo", "tipo"]).collect()
    assert {r.node for r in hidden} == {"adj::ACME", "mun::Rois", "prov::Lugo", "cpv::45000000"}
    sides = {(r.side, r.name): r.position for r in graph.bipartite_layout_data(few).collect()}
    assert sides[("buyer", "Concello X")] == 1.0 and sides[("supplier", "BETA")] == 0.0
    lonely = graph.bipartite_layout_data(few.where("supplier = 'ACME'")).collect()
    assert {r.position for r in lonely} == {0.5}


def test_budget(spark):
    lines = spark.createDataFrame([
        ("1", "G", "221", "64000", "71000", "60500"), ("1", "G", " 226", "31000", "35000", "n/d"),
        ("2", "G", "221", "17000", "18000", "16000"), ("3", "I", "100", "77777", "77777", "77777"),
        ("4", "G", "220", "n/d", "1", "1"), ("4", "G", "220", "1e25", "1", "1"), ("4", "G", "220", "NaN", "1", "Infinity"),
    ], "idente string, tipreig string, cdcta string, importer string, imported string, importel string")
    entities = spark.createDataFrame([
        ("1", " Concello de Betanzos ", "15009"), ("2", "Concello de Cee", "15023"), ("3", "Entidad Ingreso", "15000"),
        ("4", "Otra", "01059"),
    ], "idente string, nombreente string, codbdgel string")
    ranking = budget.budget_ranking(lines, entities, provinces=None)
    assert [(r.entity, r.total, r.n_lines) for r in ranking.collect()] == [
        ("Concello de Betanzos", 95000.0, 2), ("Concello de Cee", 17000.0, 1), ("Otra", None, 3)]
    assert budget.budget_ranking(lines, entities).count() == 3
    assert budget.budget_ranking(lines, entities, provinces=["15"]).count() == 2
    assert [r.entity for r in budget.budget_ranking(lines, entities, provinces=["01"]).collect()] == ["Otra"]
    total = budget.budget_ranking_total(ranking, top=1).first()
    assert (total.n_entities, total.shown_total) == (3, 95000.0)
    detail = budget.budget_entity_detail(lines, entities, "%BETANZOS%", chapter=2).collect()
    assert [(r.account, r.recognised, r.settled) for r in detail] == [("221", 64000.0, 60500.0), ("226", 31000.0, None)]


def brute_force(doc, page, text):
    for kind, pattern in SCAN_PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            around = text[max(0, m.start() - SCAN_CONTEXT):m.end() + SCAN_CONTEXT].replace("\n", " ")
            yield doc, page, kind, m.group(), f"...{around}..."


def test_scan_matches_brute_force(spark):
    pages = [
        (1, 1, "a@b.es x 14.500 € y\nz 12/01/2024, 12345678Z " + "q" * 60 + " 18.000 €"), (1, 2, ""), (2, 1, None), (3, 1, "nada"),
        (4, 1, "1€2€3€4€" * 40), (5, 1, "😀 ñ 12345678-Z 😀\n" * 20 + "ES12 3456 7890 1234 5678 90 tel 612 345 678 +34 612.345.678"),
        (6, 1, "x@y.org" + " " * 44 + "x@y.org" + " " * 46 + "x@y.org"), (7, 1, "ñ12/01/2024 12/01/24é 1/2/34 0,5 euros 7EUR"),
        (8, 1, "\uffff a@b.es 1/2/34 \uffff 5/6/78"),
    ]
    got = forensic.scan_text(spark.createDataFrame(pages, "doc_id long, page int, text string"))
    want = [hit for page in pages for hit in brute_force(*page)]
    assert sorted((r.doc_id, r.page, r.kind, r.value, r.context) for r in got.collect()) == sorted(want)
    assert {r.location for r in got.collect()} == {"Pág. 1"}
    chosen = forensic.scan_text(spark.createDataFrame(pages, "doc_id long, page int, text string"), ["Fechas"])
    assert {r.kind for r in chosen.collect()} == {"Fechas"}


def test_scan_finds_matches_that_touch_and_those_between_long_and_short_gaps(spark):
    gap = " z" * 40 + " "
    pages = [
        (1, 1, "a@b.com1@c.org x.y@z.es@w.es +34612345678 0034612345678 1€2€,3€ 4.€€5euros6 €"), (2, 1, f"1/2/34{gap}5/6/78{gap}9/1/23"),
        (3, 1, f"1/2/34{gap}5/6/78 9/1/23{gap}"), (4, 1, f"{gap}AB12 3456 7890 1234 5678{gap}ABC12 3456 7890 1234 5678 12345678A"),
    ]
    got = forensic.scan_text(spark.createDataFrame(pages, "doc_id long, page int, text string")).collect()
    assert sorted((r.doc_id, r.page, r.kind, r.value, r.context) for r in got) == sorted(hit for page in pages for hit in brute_force(*page))
    assert [r.ordinal for r in got if r.doc_id == 2] == [0, 1, 2]


def test_scan_of_long_runs_takes_no_square_of_their_length(spark):
    pages = [(1, 1, "a" * 600_000 + " @"), (2, 1, "1" * 600_000 + "x €")]
    start = time.monotonic()
    assert forensic.scan_text(spark.createDataFrame(pages, "doc_id long, page int, text string")).collect() == []
    assert time.monotonic() - start < 20


def test_flags(spark):
    rows = spark.createDataFrame([
        ("Importes (€)", "18.000 €"), ("Importes (€)", "1.000 €"), ("Importes (€)", "14.500 €"), ("Importes (€)", "39.500 €"),
        ("Importes (€)", "48.000 €"), ("Importes (€)", "16.400 €"), ("Importes (€)", ","), ("Fechas", "14.500 €"),
    ], "kind string, value string")
    flags = [r.flag for r in forensic.flag_findings(rows).collect()]
    assert [f[:1] for f in flags] == ["🚨", "O", "🚩", "🚩", "🚨", "🚨", "O", "O"]


def test_fold_agrees_with_unicode_tables(apply):
    from tenderlens.functions import fold_text

    sample = ["".join(chr(c) for c in range(a, a + 64)) for a in (0xA0, 0xC0, 0x100, 0x1E00, 0x2100, 0xFB00, 0xFF00)]
    want = ["".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x)).lower() for s in sample]
    assert apply(fold_text, sample) == [re.sub(r"\s+", " ", w).strip() for w in want]
