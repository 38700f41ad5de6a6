"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (a, b): the root is the smallest node reached.

    Every round hooks each node to its smallest smaller neighbour, follows the hooks two jumps
    and contracts the graph; it ends when no edge is left. Rounds are written to the shared folder.
    """
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    graph = materialize(ordered.distinct(), "graph")
    labels = materialize(graph.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while not graph.isEmpty():
        hooks = graph.groupBy("b").agg(F.min("a").alias("to"))
        for _ in range(2):
            ahead = hooks.select(F.col("b").alias("to"), F.col("to").alias("next"))
            hooks = hooks.join(ahead, "to", "left").select("b", F.coalesce("next", "to").alias("to"))
        hooks = materialize(hooks, "hooks")
        labels = materialize(_up(labels, hooks, "root"), "labels")
        moved = _up(_up(graph, hooks, "a"), hooks, "b").where("a <> b")
        graph = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph")
    return labels


def _up(df: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by what it hooks to."""
    return df.join(hooks.withColumnRenamed("b", column), column, "left").withColumn(column, F.coalesce("to", column)).drop("to")
