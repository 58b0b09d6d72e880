"""Connected components of a graph by alternating star rounds, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.session import discard, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each node that has an edge, with the smallest node it reaches: columns ``node`` and ``component``.

    Edges have no direction; nulls and loops are ignored, repeats do no harm. A round hangs the larger neighbours of a node
    onto its smallest neighbour, then the smaller ones, until only stars around the smallest nodes are left (a number of
    rounds that grows with the logarithm of the graph). Nodes meet their minimum in a join whose other side has one
    row per node, so a hub's edges can be split over tasks; minima are combined before they are shuffled. Every round is
    written to the shared folder, which cuts the lineage.
    """
    pairs = edges.select(
        F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")
    ).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct()
    table, before = written(pairs, "edges"), None
    while (now := _state(table)) != before and now[0]:
        after = written(_small_star(_large_star(table)), "edges")
        discard(table)
        table, before = after, now
    roots = table.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return table.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def _state(table: DataFrame) -> tuple:
    """Number and hash of the edges: equal before and after a round once only stars are left."""
    return tuple(table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("lo").agg(F.lit(1).alias("_")).select(F.col("lo").alias("u"), F.col("lo").alias("m")).union(
        pairs.groupBy("hi").agg(F.min("lo")).toDF("u", "m")
    ).groupBy("u").agg(F.min("m").alias("m"))
    return pairs.join(least, pairs.lo == least.u).select("hi", F.col("m").alias("lo")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("hi").agg(F.min("lo").alias("m"))
    met = pairs.join(least, "hi")
    moved = met.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()
