"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


_FOLDERS: set[str] = set()


def local_session(cpus: int = 8, name: str = "hazardloom") -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder of this application that all executors see; its files go when the Python process ends.

    It lies in ``spark.checkpoint.dir``, or where that is unset in ``spark.sql.warehouse.dir``; a local path there is an error on a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and root.startswith(("/", "file:")):
            raise ValueError(f"executors may not share {root}: name a shared folder in spark.checkpoint.dir")
    folder = os.path.join(root, f"hazardloom-{spark.sparkContext.applicationId}")
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def _delete(jvm, conf, path: str) -> None:
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Py4JError:  # the JVM ended first; the folder's name tells whose it was
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Later passes then prune columns at the Parquet scan, and a lost executor costs one task, not the whole plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOCK, _INSIDE = threading.Lock(), {}  # by session: how many threads are inside, and what it had before the first


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside pass at most ``rows`` rows in an Arrow batch, for columns that are many values wide.

    The session's own setting holds where it is smaller, and comes back when the last thread leaves.
    """
    session = spark._jsparkSession.sessionUUID()
    with _LOCK:
        threads, own = _INSIDE.get(session) or (0, spark.conf.get(_ROWS, None))
        _INSIDE[session] = threads + 1, own
        if own is None or not 0 < int(own) <= rows:
            spark.conf.set(_ROWS, rows)
    try:
        yield
    finally:
        with _LOCK:
            threads, own = _INSIDE.pop(session)
            if threads > 1:
                _INSIDE[session] = threads - 1, own
            elif own is None:
                spark.conf.unset(_ROWS)
            else:
                spark.conf.set(_ROWS, own)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in any file system Spark knows; one that isn't there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def discard(table: DataFrame) -> None:
    """Delete the files behind a frame that ``written`` returned."""
    path = getattr(table, "_scratch", None)
    if path:
        delete(table.sparkSession, path)
