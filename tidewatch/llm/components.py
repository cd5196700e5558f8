"""Connected components of a graph given by its edges, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``: the smallest node it is connected to.

    A round points every node to its smallest neighbour, follows the pointers to their ends, doubling the
    distance each time, and contracts the edges to those ends; at least half of the nodes go, and of a dense
    group one edge or none is left. What each round and doubling yields is written to the shared folder, which
    cuts the lineage; a hub's rows meet in partial minima and in joins whose other side has one row per
    node. Null ends and loops are no edges.
    """
    left = materialize(contracted(edges.select("a", "b")), "edges")
    found = None
    while found is None or not left.isEmpty():
        both = left.union(left.select("b", "a"))
        ends = both.groupBy("a").agg(F.min("b").alias("least"))
        ends = ends.select(F.col("a").alias("node"), F.least("a", "least").alias("component"))
        ends = roots(materialize(ends, "pointers"))
        names = [ends.select(F.col("node").alias(c), F.col("component").alias(f"{c}_end")) for c in "ab"]
        left = left.join(names[0], "a").join(names[1], "b").select(F.col("a_end").alias("a"), F.col("b_end").alias("b"))
        left = materialize(contracted(left), "edges")
        if found is not None:
            further = ends.select(F.col("node").alias("component"), F.col("component").alias("end"))
            ends = found.join(further, "component", "left").select("node", F.coalesce("end", "component").alias("component"))
        found = materialize(ends, "labels")
    return found


def contracted(edges: DataFrame) -> DataFrame:
    real = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    return real.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(pointers: DataFrame) -> DataFrame:
    """Every node's last pointer; none leads upwards."""
    while True:
        up = pointers.select(F.col("node").alias("component"), F.col("component").alias("next"))
        further = pointers.join(up, "component").select("node", "component", "next")
        further = materialize(further, "pointers")
        pointers = further.select("node", F.col("next").alias("component"))
        if further.where("component != next").isEmpty():
            return pointers
