"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetgauge.llm.tables import NO_ID, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (long columns ``a``, ``b``); root is the component's smallest node.

    Each round hangs all larger neighbours of a node, then all smaller ones,
    on the smallest of its neighbourhood, until nothing changes; rounds grow
    with the logarithm of a component's length.  A node with many neighbours
    meets its minimum in a join, which Spark splits where it is hot.
    """
    current = stored(_oriented(edges.where("a <> b").select("a", "b")).distinct(), "edges")
    state = _fingerprint(current)
    while True:
        current = stored(_small_star(_large_star(current)).distinct(), "edges")
        before, state = state, _fingerprint(current)
        if state == before:
            break
    # All edges now lead to a root.
    hung = current.selectExpr("a AS node", "b AS root")
    return hung.union(hung.selectExpr("root AS node", "root").distinct())


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each component the first row of ``docs`` by ``(doc_id, text)``, with all columns.

    ``found`` has ``doc_id, text_hash, root`` for every document.
    Rows that repeat the id and text of one that stays go as well.
    """
    keep = (
        found
        .groupBy("root")
        .agg(F.expr("min(struct(doc_id IS NULL AS no_id, doc_id, text_hash)) AS row"))
        .selectExpr(f"coalesce(row.doc_id, {NO_ID}) AS id", "row.no_id", "row.text_hash")
    )
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(
        F.expr(f"coalesce(CAST(doc_id AS BIGINT), {NO_ID})").alias("id"),
        F.expr("doc_id IS NULL").alias("no_id"),
        F.expr("xxhash64(coalesce(text, ''))").alias("text_hash"),
        row,
    )
    key = ["id", "no_id", "text_hash"]
    # One of the rows that agree in id and text; found where the join has put them.
    return rows.join(keep, key, "left_semi").dropDuplicates(key).select("row.*")


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b")


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.selectExpr("count(*)", "sum(CAST(xxhash64(a, b) AS DECIMAL(38, 0)))").first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is hung on the smallest of the node's neighbourhood."""
    both = edges.union(edges.selectExpr("b AS a", "a AS b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
    return both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung on the smallest of them."""
    edges = _oriented(edges).where("a <> b")
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").where("b <> m").selectExpr("b AS a", "m AS b")
    return hung.union(least.selectExpr("a", "m AS b"))
