"""Daily CSV files: scan, union by column name, ingest."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardloom.columns import PANEL, ROWS_PER_BATCH, PanelColumns, raw_type
from hazardloom.functions import month_name, nan_to_null
from hazardloom.session import scratch_path
from hazardloom.sources.batches import write_batches


def list_csv(spark: SparkSession, paths: list[str]) -> list[str]:
    """All ``*.csv`` files directly in the given folders (or the file itself), sorted."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(list(paths)).select("path").distinct()
    )
    return sorted(r.path for r in files.collect())


def first_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, header): the first line of every ``*.csv`` file of the folders, from one job, written.

    In a session of its own every file is one task's, which stops after its first line. Files without a line are left out.
    """
    probe = spark.newSession()
    for setting, value in (("files.openCostInBytes", 1 << 40), ("files.maxPartitionBytes", 1 << 40), ("execution.arrow.maxRecordsPerBatch", 1)):
        probe.conf.set(f"spark.sql.{setting}", str(value))

    def first(batches):
        for b in batches:
            if b.num_rows:
                yield b.slice(0, 1)
                return

    lines = probe.read.option("pathGlobFilter", "*.csv").text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("header"))
    path = scratch_path(spark, "headers")
    lines.mapInArrow(first, "file string, header string").write.parquet(path)
    table = spark.read.schema("file string, header string").parquet(path)
    table._scratch = path
    return table


def header_names(header: str) -> list[str]:
    """Column names of a header line; unnamed and repeated ones get their place in the line."""
    names = next(csv.reader([header.removeprefix("\ufeff")], skipinitialspace=False), [])
    return [f"_c{i}" if not n else f"{n}{i}" if names.count(n) > 1 else n for i, n in enumerate(names)]


def read_csv(spark: SparkSession, paths: list[str], cols: PanelColumns = PANEL, typed: bool = True) -> DataFrame:
    """All ``*.csv`` files directly in the folders, aligned by column name; a column a file lacks is NULL there.

    One job reads the first line of every file; only the distinct ones come to the driver. One scan then reads all lines, joins
    each with the number of its file's header and takes every column from its place under that header. Lines equal to
    their file's header and blank lines are no rows; a quoted value can't hold a line end. NaN and empty values become NULL, other text in a
    measure 0 (the coercion rule of the preparation, which could not tell it from a missing value later); a date may carry
    a time, which is cut off.
    """
    firsts = first_lines(spark, paths)
    headers = sorted(r.header for r in firsts.select("header").distinct().collect())
    if not headers:
        raise FileNotFoundError(f"no CSV files with a header in {paths}")
    layouts = [header_names(h) for h in headers]
    names = list(dict.fromkeys(n for layout in layouts for n in layout))
    numbers = spark.createDataFrame(list(enumerate(headers)), "_layout int, header string")
    files = firsts.join(F.broadcast(numbers), "header").select(F.col("file").alias("_file"), "_layout", F.col("header").alias("_header"))

    lines = spark.read.option("pathGlobFilter", "*.csv").text(list(paths)).select(F.col("_metadata.file_path").alias("_file"), "value")
    lines = lines.where(F.trim("value") != "").join(files, "_file").where("value != _header")
    fields = [f"_c{i}" for i in range(max(map(len, layouts)))]
    parsed = F.from_csv("value", ", ".join(f"{f} string" for f in fields), {"mode": "PERMISSIVE"})
    values = lines.select("_layout", parsed.alias("v")).select("_layout", F.array(*[F.col(f"v.{f}") for f in fields]).alias("_values"))

    def column(name: str):
        place = F.get(F.array(*[F.lit(layout.index(name) if name in layout else None).cast("int") for layout in layouts]), F.col("_layout"))
        text, kind = F.get("_values", place), raw_type(name, cols) if typed else T.StringType()
        if isinstance(kind, T.DoubleType):
            number = F.coalesce(F.trim(text).try_cast("double"), F.when(F.trim(text) != "", F.lit(0.0)))
            return nan_to_null(number).alias(name)
        return (text if isinstance(kind, T.StringType) else text.try_cast(kind)).alias(name)

    return values.select(*[column(n) for n in names])


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def add_season(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    return df.withColumn(cols.season, month_name(cols.date))


def with_row_key(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Add a unique row identity in file order. Call it on a scan and write the result, which fixes the values."""
    return df if cols.row_key in df.columns else df.withColumn(cols.row_key, F.monotonically_increasing_id())


def collect(
    spark: SparkSession, paths: list[str], storage_path: str, rows_per_batch: int = ROWS_PER_BATCH, cols: PanelColumns = PANEL
) -> DataFrame:
    """Ingest CSV folders into batched storage: parse, add the season, order by date, write."""
    if storage_path.rstrip("/") in {p.rstrip("/") for p in paths}:
        raise ValueError("the storage path must not be one of the sources")
    rows = with_row_key(add_season(read_csv(spark, paths, cols), cols), cols)
    return write_batches(rows, storage_path, rows_per_batch, cols)
