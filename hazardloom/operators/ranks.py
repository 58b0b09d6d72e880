"""Ranks and running sums over a whole table without a task that sees all of it.

Both work on two levels: rows are cut into ranges, a table with one row per range gives each range its offset, and only what lies
inside one range meets in a window.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.session import written

_PLACE_BITS = 33  # of monotonically_increasing_id, below the partition


def positions(df: DataFrame, order: list[str], output: str = "_index") -> DataFrame:
    """``df`` with the exact 0-based position of every row in the given order.

    The range partitions follow the whole order, so equal leading values spread. Rows are sorted and written once with their place inside
    the partition, which a repeated task can't change any more; the offsets come from a table with one row per partition.
    """
    spot = F.monotonically_increasing_id()
    placed = written(
        df.orderBy(*order).withColumn("_part", F.shiftright(spot, _PLACE_BITS))
        .withColumn("_spot", spot.bitwiseAND((1 << _PLACE_BITS) - 1)),
        "ordered",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    joined = placed.join(F.broadcast(offsets), "_part")
    out = joined.select(*df.columns, (F.col("_before") + F.col("_spot")).alias(output))
    out._scratch = placed._scratch
    return out


def dense_ranks(df: DataFrame, column: str, output: str = "rank") -> tuple[DataFrame, int]:
    """Every distinct value of a column that is not null with its 0-based rank, and how many there are."""
    ranked = positions(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], output)
    return ranked, ranked.count()


def sums_above(df: DataFrame, groups: list[str], position: str, value: str, size: int, output: str = "above") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same group whose ``position`` is larger.

    Positions are whole numbers below ``size``, one row for each and group. They are cut into about sqrt(size) ranges, so the window
    over the ranges and the one inside a range both see that many rows of a group at most.
    """
    width = max(1, math.isqrt(size))
    cut = df.withColumn("_range", F.floor(F.col(position) / F.lit(width)))
    keys = [*groups, "_range"]
    whole = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    later = cut.groupBy(*keys).agg(F.sum(value).alias("_sum")).select(*keys, F.coalesce(F.sum("_sum").over(whole), F.lit(0)).alias("_later"))
    inside = Window.partitionBy(*keys).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(later, keys).select(*df.columns, (F.col("_own") + F.col("_later")).alias(output))
