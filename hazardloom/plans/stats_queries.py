"""Statistics of the panel, static and per period."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardloom.columns import PANEL
from hazardloom.operators import dynamics as D
from hazardloom.operators import stats as S
from hazardloom.plans.base import big, r, sql, tidy
from hazardloom.plans.panel import read_panel

PANEL_COLUMNS = ["serial_number", "date", "row_key", "model", "smart_1_raw", "smart_2_raw", "smart_9_raw", "failure"]

DEVICE_CTE = """
dev AS (
  SELECT serial_number, min(date) AS d0, max(date) AS d1, count(*) AS n, max(failure) AS any_f, sum(failure) AS n_f
  FROM panel GROUP BY serial_number)"""
TRUNCATED_CTE = """
trunc AS (
  SELECT DISTINCT serial_number FROM panel
  WHERE date = (SELECT max(date) FROM panel) AND failure IS DISTINCT FROM 1)"""

_LIFE = "date_diff('day', d0, d1)"
_ALIVE = "100.0 * count(*) FILTER (WHERE any_f = 0) / count(*)"
_GAP = f"1.0 * sum({_LIFE}) / sum(n - 1)"
_PER_DAY = "(SELECT 1.0 * count(date) / count(DISTINCT date) FROM panel)"
_TRUNC_RATE = "100.0 * (SELECT count(*) FROM trunc) / (SELECT count(*) FROM dev)"
_NA = {c: f"100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*)" for c in PANEL_COLUMNS}


def _stat(fn):
    return lambda spark, sf: tidy(fn(read_panel(spark, sf)))


def _period(fn, freq):
    return lambda spark, sf: tidy(fn(read_panel(spark, sf), freq))


def _events_per_day(spark, sf):
    return tidy(S.mean_observ_per_day(spark.read.parquet(f"{sf}/events.parquet"), day=F.to_date("ts")))


def _events_gap(spark, sf):
    return tidy(S.mean_elapsed_gap(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "ts"))


def _events_gap_nulls(spark, sf):
    """The same where every seventh event has lost its time."""
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    return tidy(S.mean_elapsed_gap(events, "user_id", "ts"))


def _dyn_sql(kind: str, unit: str) -> str:
    p = f"CAST(date_trunc('{unit}', date) AS DATE)"
    if kind == "lifetime":
        return sql(
            f"SELECT period, {r('avg(age)')} AS mean_lifetime, {big('max(age)')} AS max_lifetime FROM age GROUP BY period",
            f"""age AS (
              SELECT {p} AS period, serial_number,
                     date_diff('day', min(min(date)) OVER (PARTITION BY serial_number), max(date)) AS age
              FROM panel GROUP BY 1, 2)""",
        )
    if kind == "na_rate":
        nulls = " + ".join(f"count(*) FILTER (WHERE smart_{n}_raw IS NULL)" for n in (1, 2, 9))
        return sql(f"SELECT {p} AS period, {r(f'100.0 * ({nulls}) / (3 * count(*))')} AS na_rate FROM panel GROUP BY 1")
    if kind == "obs_per_day":
        return sql(
            f"SELECT {p} AS period, {r('1.0 * count(*) / count(DISTINCT date)')} AS mean_observ_per_day FROM panel GROUP BY 1"
        )
    return sql(
        f"""SELECT period, {r('100.0 * (s - f) / s')} AS survival_rate, {r('100.0 - 100.0 * (s - f) / s')} AS failure_rate
        FROM (SELECT c.period, count(*) FILTER (WHERE e.seen <= c.period) AS s,
                     count(*) FILTER (WHERE e.failed <= c.period) AS f
              FROM cal c CROSS JOIN ent e GROUP BY c.period)""",
        f"""cal AS (SELECT DISTINCT {p} AS period FROM panel),
        ent AS (SELECT serial_number, min({p}) AS seen, min({p}) FILTER (WHERE failure = 1) AS failed
                FROM panel GROUP BY 1)""",
    )


QUERIES = {
    "stat_data_size": (_stat(S.data_size), sql(f"SELECT count(*) AS n_rows, {big('8')} AS n_columns FROM panel")),
    "stat_date_range": (_stat(S.date_range), sql("SELECT min(date) AS min_date, max(date) AS max_date FROM panel")),
    "stat_durations": (
        _stat(S.durations),
        sql(f"SELECT serial_number, {big(_LIFE)} AS duration FROM dev WHERE any_f = 1", DEVICE_CTE),
    ),
    "stat_lifetime": (
        _stat(S.lifetime),
        sql(f"SELECT {r(f'avg({_LIFE})')} AS mean_lifetime, {big(f'max({_LIFE})')} AS max_lifetime FROM dev WHERE any_f = 1",
            DEVICE_CTE),
    ),
    "stat_na_rate": (
        _stat(S.na_rate),
        sql("\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", {r(e)} AS na_rate FROM panel" for c, e in _NA.items())),
    ),
    "stat_truncated_rate": (
        _stat(S.truncated_rate), sql(f"SELECT {r(_TRUNC_RATE)} AS truncated_rate", DEVICE_CTE, TRUNCATED_CTE)
    ),
    "stat_survival": (
        _stat(S.survival),
        sql(f"SELECT {r(_ALIVE)} AS survival_rate, {r(f'100.0 - {_ALIVE}')} AS failure_rate FROM dev", DEVICE_CTE),
    ),
    "stat_double_failures": (
        _stat(S.double_failures),
        sql(f"SELECT {big('count(*) FILTER (WHERE n_f > 1)')} AS double_failures FROM dev", DEVICE_CTE),
    ),
    "stat_obs_gap": (
        _stat(S.mean_time_between_observ),
        sql(
            f"SELECT {r('avg(gap)')} AS mean_time_between_observ FROM g",
            """g AS (SELECT date_diff('day', lag(date) OVER (PARTITION BY serial_number ORDER BY date, row_key), date) AS gap
                     FROM panel)""",
        ),
    ),
    "stat_obs_per_day": (_stat(S.mean_observ_per_day), sql(f"SELECT {r(_PER_DAY)} AS mean_observ_per_day")),
    "static_stats": (
        _stat(S.static_stats),
        sql(
            f"""SELECT (SELECT count(*) FROM panel) AS n_rows, {big('8')} AS n_columns,
              (SELECT min(date) FROM panel) AS min_date, (SELECT max(date) FROM panel) AS max_date,
              {r(f'avg({_LIFE}) FILTER (WHERE any_f = 1)')} AS mean_lifetime,
              {big(f'max({_LIFE}) FILTER (WHERE any_f = 1)')} AS max_lifetime,
              {", ".join(f"(SELECT {r(e)} FROM panel) AS na_rate_{c}" for c, e in _NA.items())},
              {r(_TRUNC_RATE)} AS truncated_rate, {r(_ALIVE)} AS survival_rate, {r(f'100.0 - {_ALIVE}')} AS failure_rate,
              {big('count(*) FILTER (WHERE n_f > 1)')} AS double_failures,
              {r(_GAP)} AS mean_time_between_observ, {r(_PER_DAY)} AS mean_observ_per_day
            FROM dev""",
            DEVICE_CTE, TRUNCATED_CTE,
        ),
    ),
    "distinct_entities": (
        _stat(S.distinct_entities), sql("SELECT serial_number, count(*) AS n_rows FROM panel GROUP BY serial_number")
    ),
    "obs_gap": (
        _stat(S.obs_gap),
        sql(
            """SELECT serial_number, date, n_rows,
              CAST(date_diff('day', lag(date) OVER (PARTITION BY serial_number ORDER BY date), date) AS BIGINT) AS gap_days
            FROM (SELECT serial_number, date, count(*) AS n_rows FROM panel GROUP BY 1, 2)"""
        ),
    ),
    "events_obs_per_day": (
        _events_per_day,
        f"SELECT {r('1.0 * count(*) / count(DISTINCT CAST(ts AS DATE))')} AS mean_observ_per_day FROM events",
    ),
    "events_obs_gap": (
        _events_gap,
        f"""SELECT {r('avg(gap)')} AS mean_time_between_observ FROM (
          SELECT floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 86400000000.0) AS gap
          FROM events)""",
    ),
    "events_obs_gap_nulls": (
        _events_gap_nulls,
        f"""SELECT {r('avg(gap)')} AS mean_time_between_observ FROM (
          SELECT floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 86400000000.0) AS gap
          FROM events WHERE event_id % 7 <> 0)""",
    ),
}
for _unit, _freq in (("month", "monthly"), ("day", "daily")):
    _parts = [f"({_dyn_sql(k, _unit)})" for k in ("lifetime", "na_rate", "survival", "obs_per_day")]
    QUERIES["dynamic_stats" + "_daily" * (_unit == "day")] = (
        _period(lambda df, freq: D.dynamic_stats(df, freq=freq), _freq),
        f"SELECT * FROM {_parts[0]} a JOIN {_parts[1]} b USING (period) JOIN {_parts[2]} c USING (period) JOIN {_parts[3]} d USING (period)",
    )
for _name, _fn, _kind in [
    ("dyn_lifetime", D.lifetime_by_period, "lifetime"), ("dyn_na_rate", D.na_rate_by_period, "na_rate"),
    ("dyn_survival", D.survival_by_period, "survival"), ("dyn_obs_per_day", D.observ_by_period, "obs_per_day"),
]:
    QUERIES[_name] = (_period(_fn, "monthly"), _dyn_sql(_kind, "month"))
    QUERIES[_name + "_daily"] = (_period(_fn, "daily"), _dyn_sql(_kind, "day"))
