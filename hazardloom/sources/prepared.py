"""Prepared rows and predictions on disk."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardloom.columns import PANEL, ROWS_PER_BATCH, PanelColumns
from hazardloom.operators.hazard import inference_rows, scoring_rows, training_rows, wide
from hazardloom.session import delete, exists


COMMITS = "number bigint, batch string, folder string, kind string, replaces_all boolean"


def write_split(
    train: DataFrame, test: DataFrame, path: str, batch: str = "initial", rows_per_file: int = ROWS_PER_BATCH,
    cols: PanelColumns = PANEL, replace_all: bool = False,
) -> DataFrame:
    """Store both parts below ``path`` as batch ``batch``, in (device, time) order, at most ``rows_per_file`` rows per file.

    The rows go to a new folder, and one commit file then names it: readers see the batch as it was until then and as it is from then
    on, also if a write fails, and rows that come from the same store may be written to it. A batch stored before is
    replaced, also where a part has no rows now; the others stay, unless ``replace_all``, so a repeated update changes
    nothing. The range covers the time too, so no device can fill a partition alone. Folders that no commit names any more go with
    ``vacuum``.
    """
    spark = train.sparkSession
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    order = ["split", cols.id, cols.time]
    stored = both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("batch", F.lit(batch))
    folder = f"data/version={uuid.uuid4().hex}"
    stored.write.option("maxRecordsPerFile", rows_per_file).partitionBy("split").parquet(f"{path}/{folder}")
    kind = stored.select(*[c for c in both.columns if c != "split"], "batch", F.lit("").alias("version"), "split").schema.json()
    number = max((r.number for r in _commits(spark, path)), default=-1) + 1
    commit = spark.createDataFrame([(number, batch, folder, kind, replace_all)], COMMITS).coalesce(1)
    commit.write.parquet(f"{path}/commits/{number:012d}-{folder.removeprefix('data/version=')}")
    return read_split(spark, path)


def _commits(spark: SparkSession, path: str) -> list:
    """All commits in order, one for each write; of equal numbers (writers at the same time) the larger folder name counts as later."""
    if not exists(spark, f"{path}/commits"):
        return []
    return spark.read.schema(COMMITS).option("recursiveFileLookup", True).parquet(f"{path}/commits").orderBy("number", "folder").collect()


def _live(commits: list) -> dict:
    """The last commit of each batch."""
    live: dict = {}
    for c in commits:
        live = {c.batch: c} if c.replaces_all else live | {c.batch: c}
    return live


def read_split(spark: SparkSession, path: str, part: str | None = None) -> DataFrame:
    """The stored rows, with ``split`` and ``batch`` as last columns; only those of a part, and without these columns, if one is named."""
    live = _live(_commits(spark, path))
    if not live:
        raise FileNotFoundError(f"nothing is stored at {path}")
    by_kind: dict[str, list[str]] = {}
    for c in live.values():
        by_kind.setdefault(c.kind, []).append(f"{path}/{c.folder}")
    read = spark.read.option("basePath", f"{path}/data")
    frames = [read.schema(T.StructType.fromJson(json.loads(k))).parquet(*folders) for k, folders in by_kind.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    rows = rows.select(*[c for c in rows.columns if c not in ("version", "split", "batch")], "split", "batch")
    return rows if part is None else rows.where(F.col("split") == part).drop("split", "batch")


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders of commits that later ones replaced; the number of them. Not while somebody still reads them."""
    commits = _commits(spark, path)
    live = {c.folder for c in _live(commits).values()}
    old = [c.folder for c in commits if c.folder not in live]
    for folder in old:
        delete(spark, f"{path}/{folder}")
    return len(old)


def read_examples(rows: DataFrame, mode: str, cols: PanelColumns = PANEL) -> DataFrame:
    """Rows as a model reads them: mode ``train``, ``score`` or ``infer``."""
    makers = {"train": training_rows, "score": scoring_rows, "infer": inference_rows}
    if mode not in makers:
        raise ValueError(f"mode must be one of {sorted(makers)}")
    return makers[mode](rows, cols)


def write_predictions(predictions: DataFrame, path: str, times, fmt: str = "parquet", cols: PanelColumns = PANEL) -> None:
    """Wide predictions as Parquet or CSV with a header."""
    writer = wide(predictions, times, cols).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)
