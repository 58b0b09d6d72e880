"""Static fleet statistics.

Per-device facts come from one combined aggregation (device -> device facts -> totals), so a device that owns a large
share of the rows is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.columns import PANEL, STATIC_STATS, PanelColumns
from hazardloom.functions import elapsed_days, missing


def _devices(df: DataFrame, cols: PanelColumns) -> DataFrame:
    return df.where(F.col(cols.id).isNotNull()).groupBy(cols.id)


def _open_flag(cols: PanelColumns) -> Column:
    return ~F.col(cols.label).eqNullSafe(F.lit(1))


def data_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def date_range(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    return df.agg(F.min(cols.date).alias("min_date"), F.max(cols.date).alias("max_date"))


def durations(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Days between first and last row of each device that has a failure row (rows after the failure count too)."""
    per_device = _devices(df, cols).agg(
        F.min(cols.date).alias("_first"), F.max(cols.date).alias("_last"),
        F.max(F.when(F.col(cols.label) == 1, 1).otherwise(0)).alias("_failed"),
    )
    return per_device.where("_failed = 1").select(cols.id, F.datediff("_last", "_first").cast("bigint").alias("duration"))


def lifetime(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    return durations(df, cols).agg(F.avg("duration").alias("mean_lifetime"), F.max("duration").alias("max_lifetime"))


def na_rates(df: DataFrame) -> DataFrame:
    """One row with the percentage of missing values of every column."""
    return df.agg(*[(F.avg(missing(df, c).cast("int")) * 100).alias(c) for c in df.columns])


def na_rate(df: DataFrame) -> DataFrame:
    """The same as (column, na_rate) rows."""
    return na_rates(df).unpivot([], list(df.columns), "column", "na_rate")


def truncated_rate(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    return static_stats(df, ["truncated_rate"], cols)


def survival(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    return static_stats(df, ["survival_rate", "failure_rate"], cols)


def double_failures(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    return static_stats(df, ["double_failures"], cols)


def mean_time_between_observ(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    return static_stats(df, ["mean_time_between_observ"], cols)


def mean_observ_per_day(df: DataFrame, cols: PanelColumns = PANEL, day: Column | None = None) -> DataFrame:
    """Rows per calendar day that has rows; ``day`` truncates an intraday time first."""
    day = F.col(cols.date) if day is None else day
    daily = df.where(day.isNotNull()).groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    return daily.agg(F.avg("_n").alias("mean_observ_per_day"))


def distinct_entities(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Rows per distinct device."""
    return _devices(df, cols).agg(F.count(F.lit(1)).alias("n_rows"))


# What each statistic needs from a device, from the totals over devices, and its final expression.
def _device_facts(cols: PanelColumns) -> dict[str, Column]:
    label, date = F.col(cols.label), F.col(cols.date)
    return {
        "_n": F.count(date),
        "_first": F.min(date),
        "_last": F.max(date),
        "_failures": F.sum(label),
        "_any": F.max(label),
        "_failed": F.max(F.when(label == 1, 1).otherwise(0)),
        # last date and whether a non-failure row lies on it, as one integer
        "_last_open": F.max(F.unix_date(date) * 2 + _open_flag(cols).cast("int")),
    }


BY_DEVICE = {"mean_lifetime", "max_lifetime", "truncated_rate", "survival_rate", "failure_rate", "double_failures", "mean_time_between_observ"}
BY_DAY = {"mean_observ_per_day"}


def static_stats(df: DataFrame, names=STATIC_STATS, cols: PanelColumns = PANEL) -> DataFrame:
    """The named statistics as one row, in the order asked for.

    ``data_size`` gives ``n_rows`` and ``n_columns``; ``na_rate`` gives ``na_rate_<column>`` for every column. The panel is read once:
    its rows go into one group for their device and one for their day, both combined before the shuffle. What is asked of
    the whole panel is summed up from the devices, and all ends in one row.
    """
    unknown = [n for n in names if n not in STATIC_STATS]
    if unknown:
        raise KeyError(f"unknown statistics: {unknown}")
    names = list(names)
    wanted = set(names)
    missing_cells = {f"_na_{i}": F.count_if(missing(df, c)) for i, c in enumerate(df.columns)} if "na_rate" in wanted else {}
    facts = _device_facts(cols) | {"_rows": F.count(F.lit(1))} | missing_cells
    sets = ([["_id"]] if wanted - BY_DAY else []) + ([["_on"]] if wanted & BY_DAY else [])
    keyed = df.withColumn("_id", F.col(cols.id)).withColumn("_on", F.col(cols.date))
    grouped = keyed.groupingSets(sets, "_id", "_on").agg(F.grouping_id().alias("_set"), *[v.alias(k) for k, v in facts.items()])

    by_id = F.col("_set") == 1  # of the two bits, the day's is set
    device, day = by_id & F.col("_id").isNotNull(), (F.col("_set") == 2) & F.col("_on").isNotNull()
    span = F.datediff("_last", "_first").cast("bigint")
    died = device & (F.col("_failed") == 1)
    sums = {
        "_devices": F.count_if(device), "_died": F.count_if(died), "_life": F.sum(F.when(died, span)),
        "_alive": F.count_if(device & (F.col("_any") == 0)), "_double": F.count_if(device & (F.col("_failures") > 1)),
        "_span": F.sum(F.when(device, span)), "_gaps": F.sum(F.when(device, F.greatest(F.col("_n") - 1, F.lit(0)))),
        "_total": F.sum(F.when(by_id, F.col("_rows"))), "_days": F.count_if(day), "_day_rows": F.sum(F.when(day, F.col("_rows"))),
        **{k: F.sum(F.when(by_id, F.col(k))) for k in missing_cells},
    }
    edges = {
        "_life_max": F.max(F.when(died, span)), "_min": F.min(F.when(by_id, F.col("_first"))), "_max": F.max(F.when(by_id, F.col("_last"))),
    }
    # totals per last day of a device (few rows), so that the day all devices are compared with needs no second pass
    per_last_day = grouped.groupBy(F.when(device, F.shiftright("_last_open", 1)).alias("_at")).agg(
        F.count_if(device & (F.col("_last_open") % 2 == 1)).alias("_open"), *[v.alias(k) for k, v in (sums | edges).items()]
    )
    least = {"_min"}
    totals = per_last_day.agg(
        F.max(F.when(F.col("_at").isNotNull(), F.struct("_at", "_open")))["_open"].alias("_open"),
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) if k in ("_devices", "_died", "_alive", "_double", "_total", "_days") else F.sum(k).alias(k) for k in sums],
        *[(F.min(k) if k in least else F.max(k)).alias(k) for k in edges],
    )
    alive = F.col("_alive") / F.nullif(F.col("_devices"), F.lit(0)) * 100
    finals = {
        "data_size": [F.col("_total").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns")],
        "min_date": [F.col("_min")],
        "max_date": [F.col("_max")],
        "mean_lifetime": [F.col("_life") / F.nullif(F.col("_died"), F.lit(0))],
        "max_lifetime": [F.col("_life_max")],
        "na_rate": [(F.col(f"_na_{i}") / F.nullif(F.col("_total"), F.lit(0)) * 100).alias(f"na_rate_{c}") for i, c in enumerate(df.columns)],
        "truncated_rate": [F.coalesce(F.col("_open"), F.lit(0)) / F.nullif(F.col("_devices"), F.lit(0)) * 100],
        "survival_rate": [alive],
        "failure_rate": [100 - alive],
        "double_failures": [F.col("_double")],
        "mean_time_between_observ": [F.col("_span") / F.nullif(F.col("_gaps"), F.lit(0))],
        "mean_observ_per_day": [F.col("_day_rows") / F.nullif(F.col("_days"), F.lit(0))],
    }
    return totals.select(*[c if n in ("data_size", "na_rate") else c.alias(n) for n in names for c in finals[n]])


def obs_gap(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """(device, date, n_rows, gap_days): day gap from the device's previous observed day, NULL on its first.

    Rows are combined per (device, day) first, so the ordered window sees at most one row per device and day; the second
    and later rows of a day have gap 0 by definition.
    """
    days = df.where(F.col(cols.id).isNotNull()).groupBy(cols.id, cols.date).agg(F.count(F.lit(1)).alias("n_rows"))
    before = F.lag(cols.date).over(Window.partitionBy(cols.id).orderBy(cols.date))
    return days.select(cols.id, cols.date, "n_rows", F.datediff(F.col(cols.date), before).cast("bigint").alias("gap_days"))


def mean_elapsed_gap(df: DataFrame, id_col: str, ts_col: str) -> DataFrame:
    """Mean gap, in whole 24-hour periods, between consecutive rows of a device with an intraday time.

    Gaps inside one calendar day are shorter than 24 hours and count 0, so first and last time per (device, day) are
    enough, and the ordered window sees one row per device and day. Rows without a time take no part.
    """
    days = df.where(F.col(id_col).isNotNull() & F.col(ts_col).isNotNull()).groupBy(id_col, F.to_date(ts_col).alias("_day")).agg(
        F.min(ts_col).alias("_first"), F.max(ts_col).alias("_last"), F.count(ts_col).alias("_n")
    )
    before = F.lag("_last").over(Window.partitionBy(id_col).orderBy("_day"))
    gaps = days.select(elapsed_days(F.col("_first"), before).alias("_gap"), "_n")
    pairs = F.sum("_n") - F.count_if(F.col("_gap").isNull())
    return gaps.agg((F.coalesce(F.sum("_gap"), F.lit(0)) / F.nullif(pairs, F.lit(0))).alias("mean_time_between_observ"))
