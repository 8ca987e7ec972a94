"""Connected components of an edge list by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraced.session import pin


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of all nodes of ``edges`` (``a``, ``b``).

    Every round each node points to its smallest neighbour if that is smaller,
    pointers are followed to their ends, and edges are redrawn between the ends.
    At least half of the nodes that still have edges vanish in a round, so the
    rounds grow with the logarithm of the nodes. Every step is a join or a partial
    minimum; only emptiness and counts reach the driver. Nodes without edges and
    edges from a node to itself give no rows. Null ends are ignored.
    """
    left = pin(_plain(edges), "edges")
    mapping = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        points = _followed(pin(nearest.select("node", F.least("node", "near").alias("root")), "pointers"))
        if mapping is None:
            mapping = points
        else:
            later = points.select(F.col("node").alias("root"), F.col("root").alias("_later"))
            mapping = mapping.join(later, "root", "left").select("node", F.coalesce("_later", "root").alias("root"))
            mapping = pin(mapping, "mapping")
        to_a = points.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        to_b = points.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        redrawn = left.join(to_a, "a").join(to_b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        left = pin(_plain(redrawn), "edges")
    if mapping is None:
        mapping = left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping


def _plain(edges: DataFrame) -> DataFrame:
    apart = edges.filter(F.col("a") != F.col("b"))
    return apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _followed(points: DataFrame) -> DataFrame:
    """Pointers replaced by the ends of their chains, doubling the distance each time."""
    while True:
        ends = points.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        stepped = points.join(ends, "root").select("node", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved"))
        stepped = pin(stepped, "pointers")
        if stepped.filter("_moved").isEmpty():
            return points
        points = stepped.drop("_moved")
