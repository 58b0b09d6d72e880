"""Joins between panel rows and per-key tables that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.columns import PANEL, PanelColumns

ROWS_PER_SLOT = 500_000


def hot_keys(rows: DataFrame, key: str, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Keys with more than ``rows_per_slot`` rows and the number of slots to spread each over.

    At most rows / rows_per_slot keys qualify, which bounds the broadcast. Counting is combined before its shuffle.
    """
    return (
        rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows_per_slot)
        .select(key, F.ceil(F.col("_n") / F.lit(rows_per_slot)).cast("int").alias("_slots"))
    )


def join_per_key(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "left",
    cols: PanelColumns = PANEL,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """Join rows with a table of at most one row per key; hot keys are salted.

    Rows of a hot key spread over as many slots as their number asks for, and only that key's table row is repeated per
    slot. The slot comes from the row key or, without one, from the row's values and its input partition (so that equal
    copies spread too): a task that runs again puts each row where it was before.
    """
    identity = [F.col(cols.row_key)] if cols.row_key in rows.columns else [*map(F.col, rows.columns), F.spark_partition_id()]
    hot = F.broadcast(hot_keys(rows, key, rows_per_slot))
    left = rows.join(hot, key, "left").withColumn(
        "_slot",
        F.pmod(
            F.xxhash64(*identity),
            # a missing key matches nothing, so its rows may go anywhere
            F.when(F.col(key).isNull(), F.lit(100_003)).otherwise(F.coalesce(F.col("_slots"), F.lit(1))).cast("bigint"),
        ).cast("int"),
    ).drop("_slots")
    right = table.join(hot, key, "left").withColumn(
        "_slot", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slots"), F.lit(1)) - 1))
    ).drop("_slots")
    return left.join(right, [key, "_slot"], how).drop("_slot")


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join with a per-key table.

    The table is an aggregate, so its size is known once its shuffle is done: adaptive execution then sends it to all or,
    beyond the broadcast limit, splits the partitions of hot keys. Nothing runs while the plan is built. ``join_per_key``
    is the way with explicit salts.
    """
    return rows.join(table, key, how)
