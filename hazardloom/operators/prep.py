"""The fitted preparation of a panel: fit on train rows, then transform train, test or new rows."""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardloom.columns import NAN_FRACTION, PANEL, TRAIN_SAMPLES, UNUSED_FEATURES, PanelColumns
from hazardloom.operators import encoders as E
from hazardloom.operators import steps as S
from hazardloom.session import discard, written


def daily_rows(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """One row per device and day, without devices that failed twice, with ``time``.

    Devices are counted as failing twice on all their rows. One aggregate per device and day keeps the first row (smallest row key, or
    smallest values) and adds up the failures, copies being combined before the shuffle; the raw rows are read once. Then no
    device is larger than the observation period, and the sum over its days, the clock and the later steps share one shuffle by
    device. Rows without a device stay.
    """
    keys = [cols.id, cols.date]
    rest = [c for c in df.columns if c not in keys]
    rest = sorted(rest, key=lambda c: c != cols.row_key)
    fails = [F.sum(cols.label).alias("_fails")] if cols.label in rest else []
    if not rest:
        return S.relative_time(df.distinct(), cols, one_row_per_day=True)
    first = F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_first")
    days = df.groupBy(*keys).agg(first, *fails)
    if fails:
        device = Window.partitionBy(cols.id).orderBy(F.col(cols.date).desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        often = F.sum("_fails").over(device)
        days = days.withColumn("_fails", often).where(F.col(cols.id).isNull() | (F.coalesce("_fails", F.lit(0)) <= 1))
    rows = days.select(*[F.col(c) if c in keys else F.col(f"_first.`{c}`").alias(c) for c in df.columns])
    return S.relative_time(rows, cols, one_row_per_day=True)


@dataclass
class PanelPrep:
    """Settings of the preparation. ``season_vector`` encodes the season as one sparse vector, for any number of categories, instead of
    one column for each of at most ``most_seasons``."""

    n_samples: int = TRAIN_SAMPLES
    nan_fraction: float = NAN_FRACTION
    unused: list[str] = field(default_factory=lambda: list(UNUSED_FEATURES))
    fill: object = 0
    method: str = "bfill"
    seed: int = 42
    cols: PanelColumns = PANEL
    most_seasons: int = E.MAX_ONE_HOT
    season_vector: bool = False

    def fit(self, df: DataFrame) -> "FittedPrep":
        """Learn dropped columns, encodings and scaling from train rows."""
        fitted, rows = self._fit(df)
        discard(rows)
        return fitted

    def fit_transform(self, df: DataFrame) -> tuple["FittedPrep", DataFrame]:
        """The fitted preparation and the prepared train rows, which reuse the rows cleaned for the fit."""
        fitted, rows = self._fit(df)
        return fitted, fitted.encode(rows, train=True)

    def _fit(self, df: DataFrame) -> tuple["FittedPrep", DataFrame]:
        """The panel is cleaned and filled in one job and written once; marks keep the null counts from before the fill.

        One pass over it gives null counts, moments and the label's mean; two more read the season and the category
        only. The moments of the encoded columns follow from those counts. Single rows and season names reach the driver.
        """
        cols = self.cols
        rows = daily_rows(S.feature_filter(df, self.unused), cols)
        values = [c for c in rows.columns if c not in (cols.id, cols.date, cols.time, cols.row_key)]
        rows = written(S.impute(S.mark_nulls(rows, values), self.fill, self.method, cols), "imputed")

        candidates = [c for c in values if c not in cols.not_features() | {cols.category, cols.season}]
        facts = rows.agg(
            F.count(F.lit(1)).alias("_rows"), F.avg(cols.label).alias("_mean"), F.var_pop(cols.label).alias("_var"),
            *S.marked_null_counts(values), *E.moment_columns(candidates),
        ).first()
        dropped = set(S.over_limit(facts, values, self.nan_fraction, self.unused))
        measures = [c for c in candidates if c not in dropped]
        vector = E.category_table(rows, cols.season) if self.season_vector else None
        seasons = {} if self.season_vector else E.category_counts(rows, cols.season, self.most_seasons)
        table, global_mean = E.target_encoding(rows, cols, (facts["_mean"], facts["_var"]))
        table = written(table, "categories")

        mean = {c: facts[f"mean_{c}"] for c in measures}
        std = {c: facts[f"std_{c}"] for c in measures}
        mean["model_encoded"], std["model_encoded"] = E.encoded_moments(table, facts["_rows"])
        for name, n in seasons.items():
            share = n / facts["_rows"]
            mean[f"{cols.season}_{name}"], std[f"{cols.season}_{name}"] = share, math.sqrt(share * (1 - share))
        features = [*mean, *([f"{cols.season}_vector"] if self.season_vector else [])]
        return FittedPrep(self, measures, list(seasons), features, table, global_mean, mean, std, vector), rows


@dataclass
class FittedPrep:
    settings: PanelPrep
    measures: list[str]
    seasons: list[str]
    features: list[str]
    categories: DataFrame
    global_mean: float
    mean: dict[str, float]
    std: dict[str, float]
    places: DataFrame | None = None

    def transform(self, df: DataFrame, train: bool = False) -> DataFrame:
        """Prepared rows: device, time, label, scaled features, max_lifetime. Without a label the label steps are skipped.

        ``train`` adds the sampling of rows per device. A fitted column the rows lack counts as missing.
        """
        cols = self.settings.cols
        keep = [c for c in (cols.id, cols.date, cols.label, cols.category, cols.season, cols.row_key) if c in df.columns]
        have = set(df.columns)
        rows = df.select(*keep, *[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in self.measures])
        return self.encode(S.impute(daily_rows(rows, cols), self.settings.fill, self.settings.method, cols), train)

    def encode(self, rows: DataFrame, train: bool = False) -> DataFrame:
        """The steps after cleaning and filling."""
        cols = self.settings.cols
        label = [cols.label] if cols.label in rows.columns else []
        rows = rows.select(cols.id, cols.date, cols.time, *label, cols.category, cols.season, *self.measures)
        rows = E.target_encode(rows, self.categories, self.global_mean, cols)
        rows = E.scale(E.one_hot(rows, cols.season, self.seasons), self.mean, self.std)
        if train:
            rows = S.panel_sample(rows, self.settings.n_samples, self.settings.seed, cols)
        if self.places is not None:
            rows = E.one_hot_vector(rows, cols.season, self.places, f"{cols.season}_vector")
        out = [cols.id, cols.time, *label, *self.features]
        if not label:
            return rows.select(*out)
        return S.lifetime_label(S.label_shift(rows, cols), cols).select(*out, cols.lifetime)

    def save(self, path: str) -> None:
        """Small facts as one JSON line, the category table as Parquet."""
        spark = self.categories.sparkSession
        s = self.settings
        facts = {
            "n_samples": s.n_samples, "nan_fraction": s.nan_fraction, "unused": s.unused, "fill": s.fill, "method": s.method,
            "seed": s.seed, "cols": vars(s.cols), "most_seasons": s.most_seasons,
            "season_vector": s.season_vector, "measures": self.measures, "seasons": self.seasons, "features": self.features,
            "global_mean": self.global_mean, "mean": self.mean, "std": self.std,
        }
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "facts"))
        self.categories.write.mode("overwrite").parquet(os.path.join(path, "categories"))
        if self.places is not None:
            self.places.write.mode("overwrite").parquet(os.path.join(path, "places"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedPrep":
        f = json.loads(spark.read.text(os.path.join(path, "facts")).first()[0])
        settings = PanelPrep(
            f["n_samples"], f["nan_fraction"], f["unused"], f["fill"], f["method"], f["seed"], PanelColumns(**f["cols"]),
            f.get("most_seasons", E.MAX_ONE_HOT), f.get("season_vector", False),
        )
        table = spark.read.parquet(os.path.join(path, "categories"))
        places = spark.read.parquet(os.path.join(path, "places")) if settings.season_vector else None
        return FittedPrep(settings, f["measures"], f["seasons"], f["features"], table, f["global_mean"], f["mean"], f["std"], places)
