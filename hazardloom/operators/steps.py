"""Steps of panel preparation, each a DataFrame -> DataFrame function.

After ``drop_duplicates`` a device has at most one row per day, so a window over one device is bounded by the days of
the observation period. The ordered steps below rely on that and share one partitioning by device and one sort order
(newest first). Steps that accept the raw panel reduce per device before they shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardloom.columns import NAN_FRACTION, PANEL, TRAIN_SAMPLES, UNUSED_FEATURES, PanelColumns
from hazardloom.functions import hash_order, missing, nan_to_null, number_or_zero
from hazardloom.operators.keyed import lookup

_MASK_BITS = 60


def _clock(df: DataFrame, cols: PanelColumns) -> str:
    return cols.date if cols.date in df.columns else cols.time


def _newest_first(df: DataFrame, cols: PanelColumns) -> Window:
    return Window.partitionBy(cols.id).orderBy(F.col(_clock(df, cols)).desc())


def relative_time(df: DataFrame, cols: PanelColumns = PANEL, one_row_per_day: bool = False) -> DataFrame:
    """Add ``time``: days since the device's first row.

    On a frame with one row per device and day this is a window that shares the partitioning of the other steps; on raw
    rows the first dates are aggregated and looked up.
    """
    if one_row_per_day:
        spec = _newest_first(df, cols).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumn(cols.time, F.datediff(F.col(cols.date), F.min(cols.date).over(spec)))
    first = df.where(F.col(cols.id).isNotNull()).groupBy(cols.id).agg(F.min(cols.date).alias("_first"))
    joined = lookup(df, first, cols.id, "left")
    return joined.select(*df.columns, F.datediff(F.col(cols.date), F.col("_first")).alias(cols.time))


def multi_failure_ids(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    return df.groupBy(cols.id).agg(F.sum(cols.label).alias("_f")).where("_f > 1").select(cols.id)


def drop_multi_failure(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Drop devices with more than one failure row."""
    return lookup(df, multi_failure_ids(df, cols), cols.id, "left_anti")


def drop_duplicates(df: DataFrame, keys: list[str] | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """First row per (device, day); first means smallest row key, or smallest remaining values where there is none.

    Device and day are the same pairs as device and relative time, so this may run before or after ``relative_time``.
    Spark limits each group to one row before the shuffle, so any number of copies is harmless.
    """
    keys = keys or [cols.id, _clock(df, cols)]
    rest = [c for c in df.columns if c not in keys]
    order = [cols.row_key] if cols.row_key in rest else rest or keys
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_copy", first).where("_copy = 1").drop("_copy")


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(missing(df, c)).alias(c) for c in df.columns])


def over_limit(counts, columns, nan_fraction: float = NAN_FRACTION, unused=UNUSED_FEATURES) -> list[str]:
    """Columns that are listed or miss more than the given share of their values, from one row of null counts."""
    return [c for c in columns if c in set(unused) or counts[c] > counts["_rows"] * nan_fraction]


def columns_to_drop(df: DataFrame, nan_fraction: float = NAN_FRACTION, unused=UNUSED_FEATURES) -> list[str]:
    return over_limit(null_counts(df).first(), df.columns, nan_fraction, unused)


def mark_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Remember which of the columns are NULL as bits of ``_nulls_<i>``, so that filling them keeps the counts."""
    masks = {}
    for i in range(0, len(columns), _MASK_BITS):
        bits = [F.when(missing(df, c), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, c in enumerate(columns[i:i + _MASK_BITS])]
        masks[f"_nulls_{i // _MASK_BITS}"] = reduce(lambda a, b: a.bitwiseOR(b), bits)
    return df.withColumns(masks)


def marked_null_counts(columns: list[str]) -> list[Column]:
    """Aggregates that count the marks of ``mark_nulls``."""
    return [
        F.count_if(F.col(f"_nulls_{i // _MASK_BITS}").bitwiseAND(F.lit(1 << (i % _MASK_BITS)).cast("bigint")) != 0).alias(c)
        for i, c in enumerate(columns)
    ]


def feature_filter(df: DataFrame, dropped: list[str]) -> DataFrame:
    return df.drop(*[c for c in dropped if c in df.columns])


def impute(df: DataFrame, fill=0, method: str = "bfill", cols: PanelColumns = PANEL) -> DataFrame:
    """Missing values take the device's next known value (``ffill``: the last known one), the rest ``fill``.

    ``fill`` is one value or a dict by column. Measures that hold text which is no number become 0. Both directions use
    a frame that only grows, so a device of n rows costs O(n).
    """
    if method not in ("bfill", "ffill"):
        raise ValueError("method must be 'bfill' or 'ffill'")
    clock = F.col(_clock(df, cols))
    spec = Window.partitionBy(cols.id).orderBy(clock.desc() if method == "bfill" else clock.asc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    fixed = {cols.id, cols.date, cols.time, cols.row_key}
    out = []
    for field in df.schema.fields:
        name = field.name
        if name in fixed or name.startswith("_nulls_"):
            out.append(F.col(name))
            continue
        known = nan_to_null(F.col(name)) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else F.col(name)
        value = F.last(known, ignorenulls=True).over(spec)
        default = fill.get(name) if isinstance(fill, dict) else fill
        if default is not None:
            value = F.coalesce(value, F.lit(str(default) if isinstance(field.dataType, T.StringType) else default).cast(field.dataType))
        if name.startswith(cols.measure_prefix):
            value = number_or_zero(value)
        out.append(value.alias(name))
    return df.select(*out)


def coerce_measures(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Measures as doubles, 0 for whatever is not a number."""
    measures = set(cols.measures(df.columns))
    return df.select(*[number_or_zero(F.col(c)).alias(c) if c in measures else F.col(c) for c in df.columns])


def label_shift(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Each row takes the next row's label, the last row goes, and all rows take the device's largest shifted label."""
    shifted = df.withColumn(cols.label, F.lag(cols.label).over(_newest_first(df, cols))).where(F.col(cols.label).isNotNull())
    return shifted.withColumn(cols.label, F.max(cols.label).over(Window.partitionBy(cols.id)))


def lifetime_label(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Add ``max_lifetime``: the device's largest time among these rows."""
    return df.withColumn(cols.lifetime, F.max(cols.time).over(Window.partitionBy(cols.id)))


def panel_sample(df: DataFrame, n_samples: int = TRAIN_SAMPLES, seed: int = 42, cols: PanelColumns = PANEL) -> DataFrame:
    """First and last row of each device and up to n_samples - 1 rows between them, chosen by hash."""
    device = Window.partitionBy(cols.id)
    edge = (F.col(cols.time) == F.min(cols.time).over(device)) | (F.col(cols.time) == F.max(cols.time).over(device))
    drawn = F.row_number().over(Window.partitionBy(cols.id, "_edge").orderBy(hash_order(cols.id, cols.time, seed=seed), cols.time))
    return (
        df.withColumn("_edge", edge).withColumn("_drawn", drawn)
        .where(F.col("_edge") | (F.col("_drawn") <= n_samples - 1)).drop("_edge", "_drawn")
    )
