"""Category encodings and scaling: fitted tables and the expressions that apply them."""

from __future__ import annotations

import math

from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.columns import PANEL, PanelColumns
from hazardloom.operators.keyed import lookup
from hazardloom.operators.ranks import positions
from hazardloom.session import discard, written

UNKNOWN = "UNKNOWN"
MAX_ONE_HOT = 500  # columns; a vector has no such limit


def target_encoding(df: DataFrame, cols: PanelColumns = PANEL, whole: tuple[float, float] | None = None) -> tuple[DataFrame, float]:
    """(category, n, model_encoded) and the global mean: label means shrunk towards the global mean by their variance.

    ``whole`` is the label's (mean, population variance) where it is known already.
    """
    mean, var = whole or df.agg(F.avg(cols.label), F.var_pop(cols.label)).first()
    stats = df.groupBy(cols.category).agg(
        F.count(F.lit(1)).alias("n"), F.avg(cols.label).alias("_mean"), F.var_pop(cols.label).alias("_var")
    )
    spread = F.lit(var) * F.col("n")
    weight = spread / F.nullif(spread + F.col("_var"), F.lit(0.0))
    shrunk = weight * F.col("_mean") + (1 - weight) * F.lit(mean)
    return stats.select(cols.category, "n", F.coalesce(shrunk, F.lit(mean)).alias("model_encoded")), mean


def target_encode(df: DataFrame, table: DataFrame, global_mean: float, cols: PanelColumns = PANEL) -> DataFrame:
    """Add ``model_encoded``; unseen categories get the global mean."""
    joined = lookup(df, table.select(cols.category, "model_encoded"), cols.category, "left")
    return joined.select(*df.columns, F.coalesce("model_encoded", F.lit(global_mean)).alias("model_encoded"))


def known_category(df: DataFrame, categories: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Replace categories that were not there at fit time by UNKNOWN."""
    seen = categories.select(cols.category).distinct().withColumn("_seen", F.lit(True))
    joined = lookup(df, seen, cols.category, "left")
    return joined.select(*[
        F.when(F.col("_seen"), F.col(c)).otherwise(F.lit(UNKNOWN)).alias(c) if c == cols.category else F.col(c)
        for c in df.columns
    ])


def category_counts(df: DataFrame, column: str, most: int = MAX_ONE_HOT) -> dict[str, int]:
    """Rows per category, sorted by category. Each becomes a column, so more than ``most`` are an error."""
    found = df.groupBy(column).count().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} categories")
    return dict(sorted((r[0], r[1]) for r in found if r[0] is not None))


def one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """One 0/1 column per category; unseen values are all 0."""
    return df.withColumns({f"{column}_{c}": F.col(column).eqNullSafe(F.lit(c)).cast("double") for c in categories})


def category_table(df: DataFrame, column: str) -> DataFrame:
    """(category, ``place``, ``n``) of every category in order, any number of them; written, with 0-based places."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    placed = positions(counts, [column], "place")
    table = written(placed.select(column, "place", "n"), "places")
    discard(placed)
    return table


def one_hot_vector(df: DataFrame, column: str, table: DataFrame, output: str, deviations: bool = True) -> DataFrame:
    """Add a sparse vector with one entry per category of ``table``; unseen and missing values are all 0.

    An entry is 1, or, with ``deviations``, 1 / the category's standard deviation over the rows that the table was made from. It is not
    centred, which would fill the vector; a linear model's constant takes that up. The entries' sizes come to the driver, which
    a model over them needs as well.
    """
    sizes = [r.n for r in table.orderBy("place").select("n").collect()]
    rows = sum(sizes)
    joined = lookup(df, table.select(column, "place"), column, "left")
    placed = joined.select(*df.columns, F.coalesce("place", F.lit(len(sizes))).cast("double").alias("_place"))
    encoder = OneHotEncoder(inputCols=["_place"], outputCols=[output], dropLast=True, handleInvalid="keep")
    hot = encoder.fit(table.select(F.col("place").cast("double").alias("_place"))).transform(placed).drop("_place")
    if not deviations:
        return hot
    inverse = [1 / (math.sqrt(n / rows * (1 - n / rows)) or 1.0) for n in sizes]
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(inverse), inputCol=output, outputCol="_scaled").transform(hot)
    return scaled.drop(output).withColumnRenamed("_scaled", output)


def moment_columns(columns: list[str]) -> list[Column]:
    return [agg for c in columns for agg in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))]


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean_<c> and std_<c> (population) of every column."""
    return df.agg(*moment_columns(columns))


def encoded_moments(table: DataFrame, n_rows: int) -> tuple[float, float]:
    """Mean and population deviation of ``model_encoded`` over the rows the category table was made from."""
    weighted = F.col("n") * F.col("model_encoded") / F.lit(n_rows)
    low, high, mean = table.agg(F.min("model_encoded"), F.max("model_encoded"), F.sum(weighted)).first()
    if low == high:
        return low, 0.0
    off = F.col("model_encoded") - F.lit(mean)
    return mean, math.sqrt(table.agg(F.sum(F.col("n") * off * off / F.lit(n_rows))).first()[0])


def scale(df: DataFrame, mean: dict[str, float], std: dict[str, float]) -> DataFrame:
    """(x - mean) / std, with std 0 taken as 1."""
    return df.select(*[
        ((F.col(c) - F.lit(mean[c])) / F.lit(std[c] or 1.0)).alias(c) if c in mean else F.col(c) for c in df.columns
    ])
