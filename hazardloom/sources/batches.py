"""Batched storage: rows in date order, at most n per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.columns import PANEL, ROWS_PER_BATCH, PanelColumns
from hazardloom.operators.ranks import positions
from hazardloom.session import discard

MAX_TASKS = 20_000
TASKS, ROWS_PER_TASK = 256, 200_000  # small batches share tasks: as many tasks as the rows ask for, and so many in any case


def batch_order(df: DataFrame, cols: PanelColumns = PANEL) -> list[str]:
    first = [c for c in (cols.date, cols.id, cols.row_key) if c in df.columns]
    return first if cols.row_key in first else first + [c for c in df.columns if c not in first]


def rebatch(df: DataFrame, rows_per_batch: int = ROWS_PER_BATCH, cols: PanelColumns = PANEL) -> DataFrame:
    """Add ``batchnum``: consecutive groups of ``rows_per_batch`` rows in date order."""
    numbered = positions(df, batch_order(df, cols))
    out = numbered.select(*df.columns, F.floor(F.col("_index") / F.lit(rows_per_batch)).cast("bigint").alias("batchnum"))
    out._scratch = numbered._scratch  # for ``discard``
    return out


def arranged(df: DataFrame, rows_per_batch: int = ROWS_PER_BATCH, cols: PanelColumns = PANEL) -> DataFrame:
    """Rows with ``batchnum``, one sorted run per batch inside one task, ready for ``partitionBy("batchnum")``.

    Batches are dealt to tasks by their number itself, so no two meet by hash: each has a task of its own, unless there are more than TASKS
    batches of less than ROWS_PER_TASK rows, or more than MAX_TASKS; then equally many share one. ``discard`` deletes the ordered copy
    behind it, once the rows are written.
    """
    batched = rebatch(df, rows_per_batch, cols)
    n = batched.count()
    tasks = max(1, min(MAX_TASKS, -(-n // rows_per_batch), max(TASKS, -(-n // ROWS_PER_TASK))))
    placed = batched.repartitionById(tasks, F.pmod("batchnum", F.lit(tasks)).cast("int"))
    out = placed.sortWithinPartitions("batchnum", *batch_order(df, cols))
    out._scratch = batched._scratch
    return out


def write_batches(df: DataFrame, path: str, rows_per_batch: int = ROWS_PER_BATCH, cols: PanelColumns = PANEL) -> DataFrame:
    """Write one folder per batch below ``path`` (which must be new) and return the stored rows.

    Tasks move their own files into place: with many batches the driver alone would take longer for that than all else. Nobody reads a new
    folder before the write has ended.
    """
    rows = arranged(df, rows_per_batch, cols)
    rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("batchnum").parquet(path)
    discard(rows)
    return read_batches(df.sparkSession, path)


def read_batches(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("batchnum", F.col("batchnum").cast("bigint"))


def manifest(batched: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """(batchnum, n_rows, min_date, max_date)."""
    return batched.groupBy("batchnum").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(cols.date).alias("min_date"), F.max(cols.date).alias("max_date")
    )
