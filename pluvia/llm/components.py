"""Connected components by alternating large-star and small-star rounds.

Every round is two passes: each node's least neighbour (a minimum that combines on the
map side), then a join that hangs the node's neighbours on it. No neighbourhood is ever
collected, and both sides of a join are written tables, so that Spark can split a node
with very many edges. The rounds end when an alternation changes nothing; then every
edge leads from a node to the least node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.session import materialise


def _hung(edges: DataFrame, node: str, mins: DataFrame) -> DataFrame:
    return edges.join(mins.withColumnRenamed("node", "at"), F.col(node) == F.col("at")).drop("at")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least of the node and its neighbours."""
    least = materialise(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("near"))
        .unionByName(edges.select(F.col("hi").alias("node"), F.col("lo").alias("near")))
        .groupBy("node").agg(F.min("near").alias("least")), "star-least")
    return materialise(_hung(edges, "lo", least).select("hi", F.col("least").alias("lo")).distinct(), "star-large")


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every smaller neighbour of a node, and the node, on the least of them."""
    least = materialise(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least")), "star-least")
    others = _hung(edges, "hi", least).select(F.col("lo").alias("hi"), F.col("least").alias("lo")).where("hi <> lo")
    own = least.select(F.col("node").alias("hi"), F.col("least").alias("lo"))
    return materialise(others.unionByName(own).distinct(), "star-small")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return int(row["n"]), int(row["h"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, from edges (a, b); root is the least node.

    Loops and repeated edges are harmless; an edge with a null end is left out.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        now = _small_star(_large_star(now))
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return materialise(roots.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()),
                       "components")
