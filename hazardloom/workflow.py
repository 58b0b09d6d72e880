"""The whole workflow over one folder: collect, describe, prepare, fit, update, predict, score, choose."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from hazardloom.columns import DYNAMIC_STATS, PANEL, ROWS_PER_BATCH, STATIC_STATS, TIMES, PanelColumns
from hazardloom.operators import hazard as H
from hazardloom.operators import scoring as C
from hazardloom.operators.dynamics import dynamic_stats
from hazardloom.operators.prep import FittedPrep, PanelPrep
from hazardloom.operators.split import split_rows
from hazardloom.operators.stats import static_stats
from hazardloom.session import discard, written
from hazardloom.sources import batches as B
from hazardloom.sources import csv_files as V
from hazardloom.sources import prepared as W
from hazardloom.sources import registry as R
from hazardloom.streaming import incremental as I


class Workspace:
    """Storage, prepared rows, state and model versions below ``root``. Every step reads what an earlier one wrote."""

    def __init__(self, spark: SparkSession, root: str, cols: PanelColumns = PANEL):
        self.spark, self.root, self.cols = spark, root, cols
        self.storage = I.StateFolder(spark, os.path.join(root, "storage"))
        self.split = I.StateFolder(spark, os.path.join(root, "split"))
        self.lifetimes = I.StateFolder(spark, os.path.join(root, "lifetimes"))
        self.prepared = os.path.join(root, "prepared")
        self.prep_path = os.path.join(root, "prep")
        self.vault = os.path.join(root, "vault")
        self.model: H.HazardModel | None = None

    # data

    def collect_data(self, paths: list[str], rows_per_batch: int = ROWS_PER_BATCH) -> DataFrame:
        """Ingest CSV folders into batched storage."""
        if self.root.rstrip("/") in {p.rstrip("/") for p in paths}:
            raise ValueError("the storage path must not be one of the sources")
        rows = V.with_row_key(V.add_season(V.read_csv(self.spark, paths, self.cols), self.cols), self.cols)
        self._store(rows, rows_per_batch)
        return self.storage.read()

    def _store(self, rows: DataFrame, rows_per_batch: int) -> None:
        arranged = B.arranged(rows, rows_per_batch, self.cols)
        self.storage.write(arranged, "batchnum")
        discard(arranged)

    def rebatch(self, rows_per_batch: int) -> DataFrame:
        """Rewrite the storage with another batch size, as a new version of it."""
        self._store(self.stored().drop("batchnum"), rows_per_batch)
        return self.storage.read()

    def stored(self) -> DataFrame:
        rows = self.storage.read()
        if rows is None:
            raise ValueError("collect data first")
        return rows

    def data_stats(self, static=STATIC_STATS, dynamic=DYNAMIC_STATS, freq: str = "daily") -> tuple[DataFrame, DataFrame]:
        rows = self.stored().drop("batchnum")
        return static_stats(rows, static, self.cols), dynamic_stats(rows, dynamic, freq, self.cols)

    # preparation

    def preprocess(self, settings: PanelPrep | None = None) -> DataFrame:
        """Split the devices, fit the preparation on the train part, store both prepared parts and nothing of earlier fits."""
        rows = self.stored().drop("batchnum")
        live = I.advance_split(rows, self.split, self.cols).where("NOT truncated")
        fitted, train = (settings or PanelPrep(cols=self.cols)).fit_transform(split_rows(rows, live.where("split = 'train'"), self.cols))
        test = fitted.transform(split_rows(rows, live.where("split = 'test'"), self.cols))
        fitted.save(self.prep_path)
        stored = W.write_split(train, test, self.prepared, cols=self.cols, replace_all=True)
        I.advance_lifetimes(stored, self.lifetimes, self.cols)
        return stored

    def update_preprocessed(self, paths: list[str], batch: str) -> DataFrame:
        """Prepare new CSV folders with the fitted state and store them as batch ``batch``."""
        # written once: five passes follow, and the row keys must not change between them
        rows = written(V.with_row_key(V.add_season(V.read_csv(self.spark, paths, self.cols), self.cols), self.cols), "update")
        assignment = I.advance_split(rows, self.split, self.cols)
        stored = I.update_prepared(rows, self.prep(), assignment, self.prepared, batch, self.cols, self.lifetimes.read())
        I.advance_lifetimes(stored.where(stored.batch == batch), self.lifetimes, self.cols)
        discard(rows)
        return stored

    def prep(self) -> FittedPrep:
        return FittedPrep.load(self.spark, self.prep_path)

    # models

    def fit(self, model_name: str = "logistic_regression", **params) -> str:
        """Fit on the prepared train rows, score on the test rows, store the version and return its id."""
        return self._keep(H.fit(W.read_split(self.spark, self.prepared, "train"), model_name, cols=self.cols, **params), model_name)

    def fine_tune(self, **params) -> str:
        """Continue the current model on the prepared train rows."""
        train = W.read_split(self.spark, self.prepared, "train")
        return self._keep(H.fine_tune(self._current(), train, cols=self.cols, **params), "fine_tuned")

    def predict(self, rows: DataFrame, path: str | None = None, times=TIMES, fmt: str = "csv") -> DataFrame:
        """Survival curves of prepared rows; written wide where a path is given."""
        curves = H.predict(self._current(), rows, times, "infer", self.cols)
        if path:
            W.write_predictions(curves, path, times, fmt, self.cols)
        return curves

    def score_model(self, rows: DataFrame | None = None, times=TIMES) -> DataFrame:
        """(ci, ibs) on the given prepared rows, else on the test part."""
        rows = W.read_split(self.spark, self.prepared, "test") if rows is None else rows
        return C.score(self._current(), rows, times, self.cols)

    def save_best_model(self, metric: str) -> str:
        return R.save_best(self.spark, self.vault, metric)

    def load_model(self, version: str | None = None) -> H.HazardModel:
        self.model = R.load_version(self.spark, self.vault, version)
        return self.model

    def make_report(self) -> DataFrame:
        """Scores, losses and fit times of all versions."""
        return R.model_stats(self.spark, self.vault)

    def model_history(self, version: str | None = None) -> DataFrame:
        """The same of a version (the current model's by default) and those that it continues, as one history."""
        return R.history(self.spark, self.vault, version or self._current().version)

    def _current(self) -> H.HazardModel:
        if self.model is None:
            raise ValueError("fit or load a model first")
        return self.model

    def _keep(self, model: H.HazardModel, name: str) -> str:
        self.model = model
        return R.save_version(self.spark, self.vault, model, name, self.score_model())
