"""Greedy selection in an order, without a sequential pass.

Nodes are taken in order; each one that no neighbour taken before it has
claimed is a lead and claims its own neighbours (clumping, peak picking with a
minimum distance, non-maximum suppression).  A round makes all those nodes leads
that no open neighbour precedes, and closes what they claim; the result is that of
the sequential pass, whatever the partitions.  Rounds are few where the order is
not aligned with the neighbourhood (about the logarithm of the nodes).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.session import checkpoint_dir


def greedy_leads(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], node: str, order: Column,
                 edge_keys: Sequence[str] = ()) -> DataFrame:
    """The rows of ``nodes`` (unique per keys and node) that lead, by ascending ``order``
    (unique per key).  ``edges`` (left, right, and ``edge_keys``) joins neighbours in either
    order; without some of the keys an edge holds for all their values."""
    checkpoint_dir(nodes.sparkSession)
    rest = [k for k in keys if k not in edge_keys]
    ends = nodes.select(*keys, F.col(node).alias("n"), order.alias("o"))
    a = ends.withColumnsRenamed({"n": "left", "o": "ol"})
    b = ends.withColumnsRenamed({"n": "right", "o": "or"})
    both = edges.select(*edge_keys, "left", "right").filter("left <> right").join(a, [*edge_keys, "left"]).join(
        b, [*edge_keys, *rest, "right"])
    first = F.col("ol") < F.col("or")
    waits = both.select(*keys, F.when(first, F.col("right")).otherwise(F.col("left")).alias("late"),
                        F.when(first, F.col("left")).otherwise(F.col("right")).alias("early")).distinct().checkpoint()
    claimed = None  # all others lead
    while not waits.isEmpty():
        leads = waits.select(*keys, "early").distinct().join(
            waits.select(*keys, F.col("late").alias("early")), [*keys, "early"], "left_anti")
        hit = waits.join(leads, [*keys, "early"], "left_semi").select(*keys, "late").distinct().checkpoint()
        claimed = hit if claimed is None else claimed.unionByName(hit)
        waits = waits.join(hit, [*keys, "late"], "left_anti").join(
            hit.withColumnRenamed("late", "early"), [*keys, "early"], "left_anti").checkpoint()
    if claimed is None:
        return nodes
    return nodes.join(claimed.withColumnRenamed("late", node), [*keys, node], "left_anti")
