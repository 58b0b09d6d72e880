"""State carried from batch to batch: the split assignment and the known lifetimes.

Each state is a folder of numbered versions; an update reads the newest version and writes the next one.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.columns import PANEL, PanelColumns
from hazardloom.operators.prep import FittedPrep, daily_rows
from hazardloom.operators.split import initial_split, split_rows, update_split
from hazardloom.sources.prepared import write_split


def lifetimes(prepared: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """(device, max_lifetime) of prepared or timed rows."""
    return prepared.where(F.col(cols.id).isNotNull()).groupBy(cols.id).agg(F.max(cols.time).alias(cols.lifetime))


def update_lifetimes(state: DataFrame, new: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Largest known lifetime of every device of either table."""
    return state.unionByName(new).groupBy(cols.id).agg(F.max(cols.lifetime).alias(cols.lifetime))


class StateFolder:
    """Numbered versions of one table. A version counts once it is written completely."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        try:
            done = self.spark.read.parquet(os.path.join(self.path, "done"))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted(r[0] for r in done.select("version").distinct().collect())

    def folder(self, version: int) -> str:
        return os.path.join(self.path, f"version={version}")

    def read(self) -> DataFrame | None:
        known = self.versions()
        return self.spark.read.parquet(self.folder(known[-1])) if known else None

    def write(self, df: DataFrame, *partition_by: str) -> int:
        version = (self.versions() or [-1])[-1] + 1
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.folder(version))
        self.spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(os.path.join(self.path, "done"))
        return version


def advance_split(new: DataFrame, state: StateFolder, cols: PanelColumns = PANEL, **settings) -> DataFrame:
    """First or next version of the assignment table for the new rows."""
    known = state.read()
    state.write(initial_split(new, cols=cols, **settings) if known is None else update_split(new, known, cols=cols, **settings))
    return state.read()


def advance_lifetimes(new: DataFrame, state: StateFolder, cols: PanelColumns = PANEL) -> DataFrame:
    known, found = state.read(), lifetimes(new, cols)
    state.write(found if known is None else update_lifetimes(known, found, cols))
    return state.read()


def with_known_lifetimes(rows: DataFrame, known: DataFrame | None, cols: PanelColumns = PANEL) -> DataFrame:
    """Prepared rows whose lifetime is the larger one of the batch and of what is known of the device."""
    if known is None:
        return rows
    older = known.select(cols.id, F.col(cols.lifetime).alias("_known"))
    longest = F.greatest(F.col(cols.lifetime), F.col("_known")).cast(rows.schema[cols.lifetime].dataType)
    return rows.join(older, cols.id, "left").withColumn(cols.lifetime, longest).select(*rows.columns)


def update_prepared(
    new: DataFrame, prep: FittedPrep, assignment: DataFrame, path: str, batch: str, cols: PanelColumns = PANEL,
    known: DataFrame | None = None,
) -> DataFrame:
    """Prepare a new batch with the fitted state and store it at ``path`` beside the earlier batches.

    ``known`` are the lifetimes so far; ``time`` counts from the device's first day in the batch.
    """
    live = assignment.where("NOT truncated")
    train = prep.transform(split_rows(new, live.where("split = 'train'"), cols), train=True)
    test = prep.transform(split_rows(new, live.where("split = 'test'"), cols))
    return write_split(with_known_lifetimes(train, known, cols), with_known_lifetimes(test, known, cols), path, batch, cols=cols)


def follow(spark: SparkSession, source: str, schema, split: StateFolder, lifetime: StateFolder, checkpoint: str, cols: PanelColumns = PANEL):
    """Advance both states with every file batch that arrives in ``source``; stops when all present files are read."""

    def advance(batch: DataFrame, _: int) -> None:
        advance_split(batch, split, cols)
        advance_lifetimes(daily_rows(batch, cols), lifetime, cols)

    return (
        spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(advance)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
