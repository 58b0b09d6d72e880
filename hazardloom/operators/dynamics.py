"""Fleet statistics per day or month."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.columns import DYNAMIC_STATS, PANEL, PanelColumns
from hazardloom.functions import missing

FREQUENCIES = ("daily", "monthly")


def period(freq: str, cols: PanelColumns = PANEL) -> Column:
    if freq not in FREQUENCIES:
        raise ValueError(f"freq must be one of {FREQUENCIES}")
    return F.to_date(cols.date) if freq == "daily" else F.trunc(cols.date, "month")


def lifetime_by_period(df: DataFrame, freq: str = "monthly", cols: PanelColumns = PANEL) -> DataFrame:
    """Mean and largest age of the devices seen in the period; age runs from the device's first row ever.

    The window sees one row per device and period, never the raw rows.
    """
    seen = df.where(F.col(cols.id).isNotNull()).groupBy(cols.id, period(freq, cols).alias("period")).agg(
        F.min(cols.date).alias("_first"), F.max(cols.date).alias("_last")
    )
    born = F.min("_first").over(Window.partitionBy(cols.id))
    ages = seen.select("period", F.datediff(F.col("_last"), born).cast("bigint").alias("_age"))
    return ages.groupBy("period").agg(F.avg("_age").alias("mean_lifetime"), F.max("_age").alias("max_lifetime"))


def na_rate_by_period(df: DataFrame, freq: str = "monthly", cols: PanelColumns = PANEL) -> DataFrame:
    """Missing cells among the measure columns, in percent."""
    measures = cols.measures(df.columns)
    nulls = reduce(lambda a, b: a + b, [missing(df, c).cast("int") for c in measures])
    return df.groupBy(period(freq, cols).alias("period")).agg(
        (F.sum(nulls) / (F.count(F.lit(1)) * len(measures)) * 100).alias("na_rate")
    )


def survival_by_period(df: DataFrame, freq: str = "monthly", cols: PanelColumns = PANEL) -> DataFrame:
    """Share of the devices seen so far that have not failed so far.

    The rows are read once, into one group for their device and one for their period. Devices give the period of their first row and of
    their first failure, periods the calendar; the running sums go over that calendar-sized table only.
    """
    keyed = df.select(F.col(cols.id).alias("_id"), period(freq, cols).alias("_period"), F.col(cols.label).alias("_label"))
    at = F.col("_period")
    grouped = keyed.withColumn("_at", at).groupingSets([["_id"], ["_at"]], "_id", "_at").agg(
        F.grouping_id().alias("_set"), F.min(at).alias("_seen"), F.min(F.when(F.col("_label") == 1, at)).alias("_failed")
    )

    def event(when: str, seen: int, failed: int) -> Column:
        return F.struct(F.col(when).alias("period"), F.lit(seen).alias("_s"), F.lit(failed).alias("_f"))

    events = F.when(F.col("_set") == 2, F.array(event("_at", 0, 0))).when(
        F.col("_id").isNotNull(), F.array(event("_seen", 1, 0), event("_failed", 0, 1))
    )
    listed = grouped.select(F.explode(events).alias("_e")).select("_e.*").where("period IS NOT NULL OR _s + _f = 0")
    calendar = listed.groupBy("period").agg(F.sum("_s").alias("_s"), F.sum("_f").alias("_f"))
    upto = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = calendar.select("period", F.sum("_s").over(upto).alias("_seen"), F.sum("_f").over(upto).alias("_failed"))
    rate = (F.col("_seen") - F.col("_failed")) / F.nullif(F.col("_seen"), F.lit(0)) * 100
    return running.select("period", rate.alias("survival_rate"), (100 - rate).alias("failure_rate"))


def observ_by_period(df: DataFrame, freq: str = "monthly", cols: PanelColumns = PANEL) -> DataFrame:
    """Mean rows per calendar day with rows."""
    daily = df.groupBy(period(freq, cols).alias("period"), cols.date).agg(F.count(F.lit(1)).alias("_n"))
    return daily.groupBy("period").agg(F.avg("_n").alias("mean_observ_per_day"))


def all_by_period(df: DataFrame, freq: str = "monthly", cols: PanelColumns = PANEL) -> DataFrame:
    """All statistics, one row for every period of any row; null ids and null dates included.

    The raw rows are read once, into one row per device and date with counts. Windows then see one device's dates, and the running
    sums the calendar-sized table only.
    """
    measures = cols.measures(df.columns)
    nulls = reduce(lambda a, b: a + b, [missing(df, c).cast("int") for c in measures], F.lit(0))
    days = df.groupBy(cols.id, cols.date, period(freq, cols).alias("period")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(nulls).alias("_nulls"), F.max(F.col(cols.label) == 1).alias("_fails")
    )
    device, date = Window.partitionBy(cols.id), F.col(cols.date)
    known = F.col(cols.id).isNotNull()
    born = F.min(date).over(device)
    failed = F.min(F.when(F.col("_fails"), date)).over(device)
    last = known & (date == F.max(date).over(Window.partitionBy(cols.id, "period")))
    marked = days.select(
        "period", date.alias("_date"), "_n", "_nulls",
        F.when(last, F.datediff(date, born).cast("bigint")).alias("_age"),
        (known & (date == born)).cast("int").alias("_s"), (known & (date == failed)).cast("int").alias("_f"),
    )
    table = marked.groupBy("period").agg(
        F.avg("_age").alias("mean_lifetime"), F.max("_age").alias("max_lifetime"),
        (F.sum("_nulls") / F.nullif(F.sum("_n") * len(measures), F.lit(0)) * 100).alias("na_rate"),
        (F.sum("_n") / F.greatest(F.countDistinct("_date"), F.lit(1))).alias("mean_observ_per_day"),
        F.coalesce(F.sum("_s"), F.lit(0)).alias("_s"), F.coalesce(F.sum("_f"), F.lit(0)).alias("_f"),
    )
    upto = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen, gone = F.sum("_s").over(upto), F.sum("_f").over(upto)
    rate = (seen - gone) / F.nullif(seen, F.lit(0)) * 100
    return table.withColumn("survival_rate", rate).withColumn("failure_rate", 100 - F.col("survival_rate")).drop("_s", "_f")


def dynamic_stats(df: DataFrame, names=DYNAMIC_STATS, freq: str = "daily", cols: PanelColumns = PANEL) -> DataFrame:
    """The named statistics, one row per period. ``mean_observ`` is accepted for ``mean_observ_per_day``."""
    names = ["mean_observ_per_day" if n == "mean_observ" else n for n in names]
    unknown = [n for n in names if n not in DYNAMIC_STATS]
    if unknown:
        raise KeyError(f"unknown statistics: {unknown}")
    return all_by_period(df, freq, cols).select("period", *names)
