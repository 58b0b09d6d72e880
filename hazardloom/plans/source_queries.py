"""Scans, ingest, batches and the prepared store."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from hazardloom.operators.prep import PanelPrep
from hazardloom.plans.base import big, r, sql, tidy
from hazardloom.plans.panel import read_panel
from hazardloom.plans.prep_queries import FEATURES, PREP_COLUMNS, PREP_CTES, train_test
from hazardloom.session import scratch_path
from hazardloom.sources import batches as B
from hazardloom.sources import csv_files as V
from hazardloom.sources import prepared as W

ROWS = 500  # rows per batch in these queries


def _csv_folder(spark, df, name: str) -> str:
    path = os.path.join(scratch_path(spark, "csv"), name)
    df.write.option("header", True).csv(path)
    return path


def _csv_scan(spark, sf):
    return tidy(V.read_csv(spark, [_csv_folder(spark, read_panel(spark, sf), "all")]))


def _two_layouts(spark, sf) -> list[str]:
    """The panel as two folders whose files differ in column order, and one lacks a column."""
    panel = read_panel(spark, sf)
    early = panel.where("date < DATE '1998-01-01'").select("date", "serial_number", "model", "row_key", "failure", "smart_1_raw")
    late = panel.where("date >= DATE '1998-01-01'").select(
        "date", "smart_9_raw", "row_key", "model", "smart_1_raw", "failure", "serial_number"
    )
    return [_csv_folder(spark, early, "early"), _csv_folder(spark, late, "late")]


def _union_by_name(spark, sf):
    rows = V.read_csv(spark, _two_layouts(spark, sf))
    return tidy(rows.select("serial_number", "date", "row_key", "model", "failure", "smart_1_raw", "smart_9_raw"))


def _csv_many_files(spark, sf):
    """A file for every month and third of the devices; columns change their order from month to month, and each third has others."""
    panel = read_panel(spark, sf).withColumn("_third", F.pmod("row_key", F.lit(3))).withColumn("_month", F.date_format("date", "yyyyMM"))
    root, base = scratch_path(spark, "csv"), ["date", "serial_number", "model", "row_key", "failure"]
    folders = []
    for third, extra in enumerate((["smart_1_raw"], ["smart_9_raw", "smart_1_raw"], [])):
        for odd in (0, 1):
            part = panel.where((F.col("_third") == third) & (F.col("_month").cast("int") % 2 == odd))
            columns = [*base, *extra] if odd else [*reversed(extra), *reversed(base)]
            part = part.repartition("_month").sortWithinPartitions("_month").select("_month", *columns)
            path = os.path.join(root, f"{third}-{odd}")
            part.write.partitionBy("_month").option("header", True).csv(path)
            folders.append(path)
    rows = V.read_csv(spark, [f"{f}/*" for f in folders])
    return tidy(rows.select("serial_number", "date", "row_key", "model", "failure", "smart_1_raw", "smart_9_raw"))


def _ingest(spark, sf):
    stored = V.collect(spark, _two_layouts(spark, sf), scratch_path(spark, "storage"), ROWS)
    return tidy(stored.select("serial_number", "date", "row_key", "season", "smart_1_raw"))


def _rebatch(spark, sf):
    return tidy(B.rebatch(read_panel(spark, sf), ROWS).select("serial_number", "date", "row_key", "batchnum"))


def _manifest(spark, sf):
    return tidy(B.manifest(B.write_batches(read_panel(spark, sf), scratch_path(spark, "storage"), ROWS)))


def store(spark, sf):
    """The prepared train and test rows, written and read back."""
    train, test = train_test(read_panel(spark, sf))
    fitted, ready = PanelPrep().fit_transform(train)
    return W.write_split(ready, fitted.transform(test), scratch_path(spark, "prepared"), rows_per_file=ROWS)


def _write_split(spark, sf):
    return tidy(store(spark, sf).drop("batch"))


def _write_split_again(spark, sf):
    """A batch that is stored a second time, without test rows: only its train rows are left."""
    train, test = train_test(read_panel(spark, sf))
    fitted, ready = PanelPrep().fit_transform(train)
    test, path = fitted.transform(test), scratch_path(spark, "prepared")
    W.write_split(ready, test, path, rows_per_file=ROWS)
    return tidy(W.write_split(ready, test.limit(0), path, rows_per_file=ROWS).drop("batch"))


def _reader(part: str, mode: str):
    def run(spark, sf):
        rows = store(spark, sf)
        rows = rows.where(F.col("split") == part).drop("split", "batch")
        return tidy(W.read_examples(rows, mode))
    return run


_Z = ", ".join(f"{r(c)} AS {c}" for c in FEATURES)
_BATCHED = f"(SELECT *, CAST(floor((row_number() OVER (ORDER BY date, serial_number, row_key) - 1) / {ROWS}) AS BIGINT) AS batchnum FROM panel)"

QUERIES = {
    "csv_scan": (
        _csv_scan,
        sql(f"""SELECT serial_number, date, row_key, model, {r('smart_1_raw')} AS smart_1_raw, {r('smart_2_raw')} AS smart_2_raw,
                {r('smart_9_raw')} AS smart_9_raw, {big('failure')} AS failure FROM panel"""),
    ),
    "union_by_name": (
        _union_by_name,
        sql(f"""SELECT serial_number, date, row_key, model, {big('failure')} AS failure, {r('smart_1_raw')} AS smart_1_raw,
                {r("CASE WHEN date >= DATE '1998-01-01' THEN smart_9_raw END")} AS smart_9_raw FROM panel"""),
    ),
    "csv_many_files": (
        _csv_many_files,
        sql(f"""SELECT serial_number, date, row_key, model, {big('failure')} AS failure,
                {r("CASE WHEN row_key % 3 < 2 THEN smart_1_raw END")} AS smart_1_raw,
                {r("CASE WHEN row_key % 3 = 1 THEN smart_9_raw END")} AS smart_9_raw FROM panel"""),
    ),
    "ingest_season": (
        _ingest, sql(f"SELECT serial_number, date, row_key, monthname(date) AS season, {r('smart_1_raw')} AS smart_1_raw FROM panel")
    ),
    "rebatch": (_rebatch, sql(f"SELECT serial_number, date, row_key, batchnum FROM {_BATCHED}")),
    "batch_manifest": (
        _manifest,
        sql(f"SELECT batchnum, count(*) AS n_rows, min(date) AS min_date, max(date) AS max_date FROM {_BATCHED} GROUP BY batchnum"),
    ),
    "write_split": (
        _write_split,
        sql(f"SELECT {PREP_COLUMNS}, 'train' AS split FROM train_out UNION ALL SELECT {PREP_COLUMNS}, 'test' FROM test_out", *PREP_CTES),
    ),
    "write_split_again": (_write_split_again, sql(f"SELECT {PREP_COLUMNS}, 'train' AS split FROM train_out", *PREP_CTES)),
    "reader_train": (
        _reader("train", "train"),
        sql(f"SELECT {PREP_COLUMNS}, {big('max_lifetime - time')} AS time_to_event FROM train_out WHERE time <> max_lifetime", *PREP_CTES),
    ),
    "reader_score": (
        _reader("test", "score"),
        sql(f"""SELECT serial_number, {big('time')} AS time, failure = 1 AS failure, {_Z}, {big('max_lifetime')} AS max_lifetime,
                {big('max_lifetime - time')} AS duration FROM test_out WHERE time <> max_lifetime""", *PREP_CTES),
    ),
    "reader_infer": (
        _reader("test", "infer"), sql(f"SELECT serial_number, {big('time')} AS time, {_Z} FROM test_out", *PREP_CTES)
    ),
}
