"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.operators.common import stored


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least of u and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` lead from the larger to the smaller end."""
    linked = _with_least(edges)
    to_least = linked.select(F.col("v").alias("u"), F.col("least").alias("v"))
    return to_least.unionByName(linked.select("u", F.col("least").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge; ``root`` is the least node of its component.

    ``edges`` has two columns of one sortable type. Each round replaces every node's partners by its least one, seen
    from both sides, until nothing changes; rounds grow with the logarithm of the longest path. Every round is a table
    in the shared folder, so no plan grows and nothing is collected. Loops and repeated edges are ignored.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, before = stored(edges, "edges"), None
    while True:
        edges = stored(_small_star(_large_star(edges)), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
