"""Model versions: an append-only table of scores, the stored models, and the training histories.

Every write is a folder of its own, which readers see once Spark has committed it, so writers at the same time don't meet.
"""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardloom.operators.hazard import HazardModel

VERSIONS = "id string, model_name string, timestamp timestamp, ci double, ibs double, parent string"
METRICS = "version string, metric string, step int, value double"


def append_version(spark: SparkSession, root: str, model_name: str, ci: float, ibs: float, version: str | None = None,
                   parent: str | None = None) -> str:
    """Add a version; ``parent`` is the version that it continues."""
    version = version or uuid.uuid4().hex
    _append(spark, os.path.join(root, "versions"), [(version, model_name, datetime.now(timezone.utc), ci, ibs, parent)], VERSIONS)
    return version


def _append(spark: SparkSession, folder: str, rows: list[tuple], schema: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(folder, f"commit-{uuid.uuid4().hex}"))


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, os.path.join(root, "versions"), VERSIONS)


def best(versions: DataFrame, metric: str) -> DataFrame:
    """The version with the largest ci or the smallest ibs; the older, then the smaller id wins a tie."""
    if metric not in ("ci", "ibs"):
        raise ValueError("metric must be 'ci' or 'ibs'")
    order = F.col(metric).desc() if metric == "ci" else F.col(metric).asc()
    return versions.where(F.col(metric).isNotNull()).orderBy(order, "timestamp", "id").limit(1)


def save_version(spark: SparkSession, root: str, model: HazardModel, name: str, scores: DataFrame) -> str:
    """Store the model, its scores on test rows and its history. ``scores`` is one row (ci, ibs). The model then knows its version, and
    what continues it is stored with this version as its parent."""
    row = scores.first()
    version = uuid.uuid4().hex
    model.version = version
    model.save(os.path.join(root, "models", version))
    history = [(version, "CI_test", 0, row["ci"]), (version, "IBS_test", 0, row["ibs"])]
    history += [(version, "loss", i, v) for i, v in enumerate(model.loss)]
    seconds = getattr(model.fitted, "epoch_seconds", None) or [model.fit_seconds]
    history += [(version, "fit_time", i, v) for i, v in enumerate(seconds)]
    _append(spark, os.path.join(root, "metrics"), history, METRICS)
    return append_version(spark, root, name, row["ci"], row["ibs"], version, model.parent)


def model_stats(spark: SparkSession, root: str) -> DataFrame:
    """(version, metric, step, value) with metrics CI_test, IBS_test, loss and fit_time; steps are numbered within each version."""
    return _read(spark, os.path.join(root, "metrics"), METRICS)


def history(spark: SparkSession, root: str, version: str, most: int = 10_000) -> DataFrame:
    """The same of one version and all that it continues, (metric, step, value, version): steps run on from each version to the next.

    The chain of parents is followed by a recursive query, up to ``most`` versions; one more is an error.
    """
    chain = spark.sql(
        f"""WITH RECURSIVE chain(version, parent, age) MAX RECURSION LEVEL {int(most)} AS (
              SELECT id, parent, 0 FROM {{versions}} WHERE id = :version
              UNION ALL SELECT v.id, v.parent, c.age + 1 FROM {{versions}} v JOIN chain c ON v.id = c.parent)
            SELECT version, age FROM chain""",
        args={"version": version}, versions=read_versions(spark, root),
    )
    along = Window.partitionBy("metric").orderBy(F.desc("age"), "step")  # one row per epoch or version of a single model
    steps = model_stats(spark, root).join(chain, "version")
    return steps.select("metric", (F.row_number().over(along) - 1).alias("step"), "value", "version")


def save_best(spark: SparkSession, root: str, metric: str) -> str:
    """Make the best version the default one and return its id."""
    chosen = best(read_versions(spark, root), metric).select("id")
    version = chosen.first()[0]
    spark.createDataFrame([(version,)], "id string").coalesce(1).write.mode("overwrite").parquet(os.path.join(root, "default"))
    return version


def load_version(spark: SparkSession, root: str, version: str | None = None) -> HazardModel:
    """A stored model; the default one where no version is given."""
    if version is None:
        version = spark.read.parquet(os.path.join(root, "default")).first()[0]
    model = HazardModel.load(spark, os.path.join(root, "models", version))
    model.version = version
    return model
