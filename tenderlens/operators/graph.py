"""The buyer-supplier graph as node and edge tables.

One fold sums the contracts of every supplier by buyer, type, CPV code, town and province; pairs and links are both cut
from it, so contracts are read once where the fold is stored. Only the top pairs and the top attribute links enter the
graph, so every frame after the top-k is bounded by its ``top`` parameter: at most ``top`` pairs and 2 x ``top`` links for
each of four attributes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderlens.functions import exact_sum
from tenderlens.operators.rankings import buyer_supplier_relations, known_suppliers

# Attribute column, node prefix, edge label and depth.
ATTRIBUTES = (
    ("contract_type", "tipo", "Tipo", 2),
    ("cpv", "cpv", "CPV", 3),
    ("municipality", "mun", "Municipio", 2),
    ("province", "prov", "Provincia", 3),
)
GROUPS = {"org": "organo", "adj": "adjudicatario", "tipo": "tipo", "cpv": "cpv", "mun": "mun", "prov": "prov"}
LEVELS = {"org": 1, "adj": 2, "tipo": 3, "cpv": 3, "mun": 3, "prov": 3}


def _node(prefix: str | Column, value: str) -> Column:
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.lit("::"), F.col(value))


def graph_folds(contracts: DataFrame) -> DataFrame:
    """supplier, prefix, value, total, n_contracts: each supplier's contracts by buyer and by each attribute, in one pass."""
    rows = known_suppliers(contracts.dropna(subset=["buyer", "supplier", "amount"]))
    parts = F.array(*[
        F.struct(F.lit(p).alias("prefix"), F.col(c).alias("value")) for c, p in (("buyer", "org"), *(a[:2] for a in ATTRIBUTES))
    ])
    return (
        rows.select("supplier", "amount", F.inline(parts)).where(F.col("value").isNotNull())
        .groupBy("supplier", "prefix", "value").agg(exact_sum(F.col("amount")).cast("double").alias("total"), F.count("*").alias("n_contracts"))
    )


def graph_edges(contracts: DataFrame, top: int = 80) -> DataFrame:
    """Top buyer-supplier pairs, and the top links of their suppliers to type, CPV code, town and province."""
    return edges_of_folds(graph_folds(contracts), top)


def edges_of_folds(folds: DataFrame, top: int = 80) -> DataFrame:
    """graph_edges() from the rows of graph_folds(), which it reads more than once: store them first if contracts are many."""
    if top < 1:
        raise ValueError("top is a positive number")
    pairs = (
        folds.where("prefix = 'org'").select("supplier", F.col("value").alias("buyer"), F.coalesce("total", F.lit(0.0)).alias("total"), "n_contracts")
        .orderBy(F.desc("total"), "buyer", "supplier").limit(top)
    )
    euros = F.concat(F.format_number("total", 0), F.lit(" €"))
    primary = pairs.select(
        _node("org", "buyer").alias("source"), _node("adj", "supplier").alias("target"), euros.alias("label"),
        "total", "n_contracts", F.lit(1).alias("depth"),
    )

    of = lambda k: F.coalesce(*[F.when(F.col("prefix") == a[1], F.lit(a[k])) for a in ATTRIBUTES])
    links = (
        folds.where("prefix <> 'org'").join(F.broadcast(pairs.select("supplier").distinct()), "supplier", "left_semi")
        .withColumns({"label": of(2), "depth": of(3)})
    )
    # Spark keeps the best rows of each attribute in every task before the shuffle, so this window stays small.
    order = Window.partitionBy("prefix").orderBy(F.desc("total"), "supplier", "value")
    secondary = (
        links.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2 * top)
        .where(~F.trim("value").isin("", "None", "nan"))
        .select(_node("adj", "supplier").alias("source"), _node(F.col("prefix"), "value").alias("target"), "label",
                "total", "n_contracts", "depth")
    )
    edges = primary.unionByName(secondary)
    widest = F.max("total").over(Window.partitionBy())
    return edges.withColumn("width", 0.9 + 5.5 * (F.col("total") / widest))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Nodes of the edges. Pairs count for both ends, attribute links for the attribute alone."""
    ends = F.when(F.col("depth") == 1, F.array("source", "target")).otherwise(F.array("target"))
    prefix = F.substring_index("node", "::", 1)
    group = F.coalesce(*[F.when(prefix == p, g) for p, g in GROUPS.items()])
    level = F.coalesce(*[F.when(prefix == p, n) for p, n in LEVELS.items()])
    largest = F.max("total").over(Window.partitionBy())
    return (
        edges.select(F.explode(ends).alias("node"), F.col("total").cast("decimal(28,2)").alias("part"))
        .groupBy("node").agg(F.sum("part").cast("double").alias("total"))
        .select(
            "node", F.expr("substring(node, instr(node, '::') + 2)").alias("label"), group.alias("node_group"),
            level.alias("level"), "total",
            F.greatest(F.lit(9.0), 9 + 34 * (F.col("total") / largest)).alias("size"),
        )
    )


def visible_edges(edges: DataFrame, depth: int = 2, hidden_groups: Iterable[str] = ()) -> DataFrame:
    hidden = [p for p, g in GROUPS.items() if g in set(hidden_groups)]
    shown = edges.where(F.col("depth") <= depth)
    if hidden:
        for end in ("source", "target"):
            shown = shown.where(~F.substring_index(end, "::", 1).isin(hidden))
    return shown


def graph_filter(edges: DataFrame, nodes: DataFrame, depth: int = 2, hidden_groups: Iterable[str] = ()) -> DataFrame:
    """Nodes that a visible edge touches, with the number of their neighbours."""
    shown = visible_edges(edges, depth, hidden_groups)
    ends = shown.select(F.inline(F.array(
        F.struct(F.col("source").alias("node"), F.col("target").alias("neighbour")),
        F.struct(F.col("target").alias("node"), F.col("source").alias("neighbour")),
    )))
    degree = ends.groupBy("node").agg(F.count_distinct("neighbour").alias("degree"))
    return nodes.join(degree, "node")


def bipartite_links(contracts: DataFrame, top: int = 35) -> DataFrame:
    """Top pairs of the two-column picture with their line width."""
    rows = known_suppliers(contracts.dropna(subset=["buyer", "supplier", "amount"]), trim=False)
    widest = F.max("total").over(Window.partitionBy())
    return buyer_supplier_relations(rows, top).withColumn("width", 0.8 + 5.2 * (F.col("total") / widest))


def bipartite_layout_data(contracts: DataFrame, top: int = 35) -> DataFrame:
    """Nodes of the two-column picture: total per side, place from top (1) to bottom (0), marker size."""
    sides = F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(side).alias("name")) for side in ("buyer", "supplier")
    ])
    totals = (
        bipartite_links(contracts, top)
        .select(F.col("total").cast("decimal(28,2)").alias("part"), F.inline(sides))
        .groupBy("side", "name").agg(F.sum("part").cast("double").alias("total"))
    )
    one_side = Window.partitionBy("side")
    place = F.row_number().over(one_side.orderBy(F.desc("total"), "name")) - 1
    count = F.count("*").over(one_side)
    return totals.select(
        "side", "name", "total",
        F.when(count == 1, 0.5).otherwise(1 - place / F.nullif(count - 1, F.lit(0))).alias("position"),
        (14 + 28 * (F.col("total") / F.max("total").over(one_side))).alias("marker_size"),
    )
