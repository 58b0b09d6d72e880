"""Preparation steps, splits and the whole fitted preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.operators import encoders as E
from hazardloom.operators import split as P
from hazardloom.operators import steps as S
from hazardloom.operators.prep import PanelPrep, daily_rows
from hazardloom.plans.base import big, r, sql, tidy
from hazardloom.plans.panel import read_panel, with_season
from hazardloom.plans.stats_queries import TRUNCATED_CTE
from hazardloom.session import written
from hazardloom.streaming.incremental import lifetimes, update_lifetimes, with_known_lifetimes

# Month names in the order of the one-hot columns.
MONTHS = ["April", "August", "December", "February", "January", "July", "June", "March", "May", "November", "October",
          "September"]
MEASURES = ["smart_1_raw", "smart_9_raw"]
FEATURES = [*MEASURES, "model_encoded", *[f"season_{m}" for m in MONTHS]]
CUTOFF = "1996-06-01"

SEASON_CTE = "seasonal AS (SELECT *, monthname(date) AS season FROM panel)"
# one row per device and day, with the days since the first row
DAILY_CTE = """
daily AS (
  SELECT *, date_diff('day', min(date) OVER (PARTITION BY serial_number), date) AS time
  FROM (SELECT *, row_number() OVER (PARTITION BY serial_number, date ORDER BY row_key) AS copy FROM panel)
  WHERE copy = 1)"""


def assignment_ctes(rows: str = "panel", name: str = "asg", minus: str | None = None) -> str:
    known = f"WHERE serial_number NOT IN (SELECT serial_number FROM {minus})" if minus else ""
    return f"""
{name}_dev AS (
  SELECT serial_number, max(failure) AS label,
         bool_or(date = (SELECT max(date) FROM {rows}) AND failure IS DISTINCT FROM 1) AS truncated
  FROM {rows} GROUP BY serial_number),
{name} AS (
  SELECT serial_number, label, CASE WHEN rk <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split, truncated
  FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n,
               row_number() OVER (PARTITION BY label ORDER BY md5(concat(serial_number, '|42')), serial_number) AS rk
        FROM {name}_dev {known}))"""


def imputed_ctes(rows: str, name: str) -> str:
    """Clean and fill the rows of relation ``rows`` (with season)."""
    fills = ", ".join(
        f"coalesce(first_value({c} IGNORE NULLS) OVER (PARTITION BY serial_number ORDER BY date"
        f" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {c}" for c in MEASURES
    )
    return f"""
{name}_day AS (
  SELECT *, date_diff('day', min(date) OVER (PARTITION BY serial_number), date) AS time
  FROM (SELECT *, row_number() OVER (PARTITION BY serial_number, date ORDER BY row_key) AS copy FROM {rows})
  WHERE copy = 1
    AND serial_number NOT IN (SELECT serial_number FROM {rows} GROUP BY serial_number HAVING sum(failure) > 1)),
{name}_imp AS (SELECT serial_number, date, time, model, season, failure, {fills} FROM {name}_day)"""


def encoding_ctes(fit: str, name: str = "enc") -> str:
    """Encodings and scaling fitted on relation ``fit``."""
    return f"""
{name}_all AS (SELECT avg(failure) AS g, var_pop(failure) AS v FROM {fit}),
{name}_cat AS (
  SELECT model, coalesce(w * mu + (1 - w) * g, g) AS model_encoded
  FROM (SELECT model, mu, g, v * n / nullif(v * n + s2, 0) AS w
        FROM (SELECT model, count(*) AS n, avg(failure) AS mu, var_pop(failure) AS s2 FROM {fit} GROUP BY model), {name}_all))"""


def encoded_cte(rows: str, name: str, enc: str = "enc") -> str:
    hot = ", ".join(f"CASE WHEN season = '{m}' THEN 1.0 ELSE 0.0 END AS season_{m}" for m in MONTHS)
    return f"""
{name} AS (
  SELECT i.*, coalesce(c.model_encoded, (SELECT g FROM {enc}_all)) AS model_encoded, {hot}
  FROM {rows} i LEFT JOIN {enc}_cat c ON i.model = c.model)"""


def scaled_cte(rows: str, fit: str, name: str) -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES)
    z = ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in FEATURES)
    return f"""
{name}_mom AS (SELECT {stats} FROM {fit}),
{name} AS (SELECT serial_number, date, time, failure, {z} FROM {rows} CROSS JOIN {name}_mom)"""


def sampled_cte(rows: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT * EXCLUDE (edge, drawn) FROM (
    SELECT *, row_number() OVER (PARTITION BY serial_number, edge
                                 ORDER BY md5(concat(serial_number, '|', time, '|42')), time) AS drawn
    FROM (SELECT *, time = min(time) OVER (PARTITION BY serial_number)
                 OR time = max(time) OVER (PARTITION BY serial_number) AS edge FROM {rows}))
  WHERE edge OR drawn <= 9)"""


def labelled_cte(rows: str, name: str) -> str:
    return f"""
{name}_next AS (
  SELECT * REPLACE (lead(failure) OVER (PARTITION BY serial_number ORDER BY time) AS failure) FROM {rows}),
{name} AS (
  SELECT * REPLACE (max(failure) OVER (PARTITION BY serial_number) AS failure),
         max(time) OVER (PARTITION BY serial_number) AS max_lifetime
  FROM {name}_next WHERE failure IS NOT NULL)"""


def prepared_ctes(train: str = "train_rows", test: str = "test_rows", fit: bool = True) -> list[str]:
    """CTEs train_out and test_out: everything fitted on ``train`` and applied to both."""
    return [
        imputed_ctes(train, "tr"), encoding_ctes("tr_imp"), encoded_cte("tr_imp", "tr_enc"), scaled_cte("tr_enc", "tr_enc", "tr_z"),
        sampled_cte("tr_z", "tr_s"), labelled_cte("tr_s", "train_out"),
        imputed_ctes(test, "te"), encoded_cte("te_imp", "te_enc"), scaled_cte("te_enc", "tr_enc", "te_z"),
        labelled_cte("te_z", "test_out"),
    ]


PARTS_CTE = """
train_rows AS (SELECT * FROM seasonal WHERE serial_number IN (SELECT serial_number FROM asg WHERE split = 'train' AND NOT truncated)),
test_rows AS (SELECT * FROM seasonal WHERE serial_number IN (SELECT serial_number FROM asg WHERE split = 'test' AND NOT truncated))"""
PREP_CTES = [SEASON_CTE, assignment_ctes(), PARTS_CTE, *prepared_ctes()]
TUNED_COLUMNS = ", ".join(
    ["serial_number", f"{big('time')} AS time", f"{big('failure')} AS failure", *[f"{r(c)} AS {c}" for c in FEATURES],
     f"{big('greatest(max_lifetime, known)')} AS max_lifetime"]
)
PREP_COLUMNS = ", ".join(
    ["serial_number", f"{big('time')} AS time", f"{big('failure')} AS failure", *[f"{r(c)} AS {c}" for c in FEATURES],
     f"{big('max_lifetime')} AS max_lifetime"]
)


def train_test(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seasonal rows of the live train and test devices."""
    rows, live = with_season(panel), written(P.initial_split(panel), "assignment").where("NOT truncated")
    return P.split_rows(rows, live.where("split = 'train'")), P.split_rows(rows, live.where("split = 'test'"))


def _daily(spark, sf):
    return S.relative_time(S.drop_duplicates(read_panel(spark, sf)), one_row_per_day=True)


def _step(fn, source=read_panel):
    return lambda spark, sf: tidy(fn(source(spark, sf)))


def _prep(train: bool):
    def run(spark, sf):
        a, b = train_test(read_panel(spark, sf))
        if train:
            return tidy(PanelPrep().fit_transform(a)[1])
        return tidy(PanelPrep().fit(a).transform(b))
    return run


def _feature_filter(panel):
    rows = daily_rows(panel)
    return S.feature_filter(rows, S.columns_to_drop(rows)).drop("row_key")


def _feature_filter_fit(panel):
    rows = daily_rows(panel).drop("row_key")
    counts = S.null_counts(rows)
    names = [c for c in counts.columns if c != "_rows"]
    return counts.unpivot("_rows", names, "column", "n_null").select(
        "column", "n_null", (F.col("n_null") > F.col("_rows") * 0.5).alias("dropped")
    )


def _coerce(panel):
    text = F.when(F.col("row_key") % 7 == 0, "n/a").when(F.col("row_key") % 11 == 0, "NaN").otherwise(F.col("smart_9_raw").cast("string"))
    return S.coerce_measures(panel.select("row_key", "smart_1_raw", text.alias("smart_9_raw")))


def _impute(rows):
    return S.impute(rows).select("serial_number", "time", "model", "failure", "smart_1_raw", "smart_2_raw", "smart_9_raw")


def _early_late(panel):
    """The panel with month-end dates, cut into a first batch and a later one."""
    monthly = panel.withColumn("date", F.last_day("date"))
    return monthly.where(F.col("date") < CUTOFF), monthly.where(F.col("date") >= CUTOFF)


EARLY_LATE_CTE = f"""
early AS (SELECT * REPLACE (last_day(date) AS date) FROM panel WHERE last_day(date) < DATE '{CUTOFF}'),
late AS (SELECT * REPLACE (last_day(date) AS date) FROM panel WHERE last_day(date) >= DATE '{CUTOFF}')"""
UPDATE_CTES = [
    EARLY_LATE_CTE, assignment_ctes("early", "old"), assignment_ctes("late", "fresh", minus="old"),
    """
upd AS (
  SELECT o.serial_number, o.split, o.truncated AND coalesce(d.truncated, TRUE) AS truncated
  FROM old o LEFT JOIN fresh_dev d ON o.serial_number = d.serial_number
  UNION ALL SELECT serial_number, split, truncated FROM fresh)""",
]


def _target_encode(panel):
    table, mean = E.target_encoding(panel)
    return E.target_encode(panel, table, mean).select("serial_number", "row_key", "model", "model_encoded")


def _unknown_category(panel):
    early, late = _early_late(panel)
    seen = early.where("model < 'G'").select("model")  # some of the names are known, at every size, others not
    return E.known_category(late, seen).select("serial_number", "row_key", "model")


def _one_hot(panel):
    rows = with_season(panel)
    return E.one_hot(rows, "season", list(E.category_counts(rows, "season"))).select(
        "serial_number", "row_key", *[f"season_{m}" for m in MONTHS]
    )


SCALED = ["smart_1_raw", "smart_2_raw", "smart_9_raw"]


def _scale(panel):
    row = E.moments(panel, SCALED).first()
    return E.scale(panel, {c: row[f"mean_{c}"] for c in SCALED}, {c: row[f"std_{c}"] for c in SCALED}).select(
        "serial_number", "row_key", *SCALED
    )


def _split_update(panel):
    early, late = _early_late(panel)
    return P.update_split(late, P.initial_split(early))


def _untruncated(panel):
    early, late = _early_late(panel)
    return P.find_untruncated(late, P.initial_split(early))


def _new_entities(panel):
    early, late = _early_late(panel)
    return P.new_devices(late, P.initial_split(early))


def _lifetime_update(panel):
    early, late = (S.relative_time(S.drop_duplicates(p), one_row_per_day=True) for p in _early_late(panel))
    return update_lifetimes(lifetimes(early), lifetimes(late))


def _prep_tune(spark, sf):
    """Fit on the first batch, then prepare the later one with the fitted state and the lifetimes known from the first."""
    early, late = (with_season(p) for p in _early_late(read_panel(spark, sf)))
    state = written(P.initial_split(early), "assignment")
    fitted = PanelPrep().fit(P.split_rows(early, state.where("split = 'train' AND NOT truncated")))
    after = written(P.update_split(late, state), "assignment")
    known = lifetimes(S.relative_time(S.drop_duplicates(early), one_row_per_day=True))
    parts = []
    for part in ("train", "test"):
        rows = fitted.transform(P.split_rows(late, after.where(f"split = '{part}' AND NOT truncated")), train=part == "train")
        parts.append(with_known_lifetimes(rows, known).withColumn("split", F.lit(part)))
    return tidy(parts[0].unionByName(parts[1]))


_FILLS = ", ".join(
    r(f"coalesce(first_value({c} IGNORE NULLS) OVER (PARTITION BY serial_number ORDER BY time"
      " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)") + f" AS {c}" for c in SCALED
)
_KEPT = "serial_number, row_key, " + ", ".join(f"{r(c)} AS {c}" for c in SCALED)
_PANEL_ROW = f"serial_number, date, row_key, model, smart_1_raw, smart_2_raw, smart_9_raw, {big('failure')} AS failure"
_DAILY_ROW = f"serial_number, date, row_key, model, smart_1_raw, smart_2_raw, smart_9_raw, {big('failure')} AS failure, {big('time')} AS time"
_PLAIN = "serial_number, date, row_key, model, smart_1_raw, smart_2_raw, smart_9_raw"
_DAY_CTE = imputed_ctes("seasonal", "w")

QUERIES = {
    "relative_time": (
        _step(lambda p: S.relative_time(p).select("serial_number", "row_key", "time")),
        sql("""SELECT serial_number, row_key,
               CAST(date_diff('day', min(date) OVER (PARTITION BY serial_number), date) AS BIGINT) AS time FROM panel"""),
    ),
    "drop_doubles": (
        _step(S.drop_multi_failure),
        sql(f"""SELECT {_PANEL_ROW} FROM panel
            WHERE serial_number NOT IN (SELECT serial_number FROM panel GROUP BY 1 HAVING sum(failure) > 1)"""),
    ),
    "drop_duplicates": (_step(lambda d: d, _daily), sql(f"SELECT {_DAILY_ROW} FROM daily", DAILY_CTE)),
    "feature_filter_fit": (
        _step(_feature_filter_fit),
        sql("\nUNION ALL\n".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null,"
            f" count(*) FILTER (WHERE {c} IS NULL) > count(*) * 0.5 AS dropped FROM w_day"
            for c in ["serial_number", "date", "model", "smart_1_raw", "smart_2_raw", "smart_9_raw", "failure", "time"]),
            SEASON_CTE, _DAY_CTE),
    ),
    "feature_filter": (
        _step(_feature_filter),
        sql(f"SELECT serial_number, date, model, smart_1_raw, smart_9_raw, {big('failure')} AS failure, {big('time')} AS time FROM w_day",
            SEASON_CTE, _DAY_CTE),
    ),
    "coerce_numeric": (
        _step(_coerce),
        sql(f"""SELECT row_key, {r('coalesce(smart_1_raw, 0)')} AS smart_1_raw,
                CASE WHEN row_key % 7 = 0 OR row_key % 11 = 0 THEN 0.0 ELSE {r('smart_9_raw')} END AS smart_9_raw FROM panel"""),
    ),
    "impute_bfill": (
        _step(_impute, _daily),
        sql(f"SELECT serial_number, {big('time')} AS time, model, {big('failure')} AS failure, {_FILLS} FROM daily", DAILY_CTE),
    ),
    "label_shift": (
        _step(lambda d: S.label_shift(d).select("serial_number", "time", "failure"), _daily),
        sql(
            f"""SELECT serial_number, {big('time')} AS time, {big('max(nxt) OVER (PARTITION BY serial_number)')} AS failure
            FROM (SELECT *, lead(failure) OVER (PARTITION BY serial_number ORDER BY time) AS nxt FROM daily) WHERE nxt IS NOT NULL""",
            DAILY_CTE,
        ),
    ),
    "lifetime_label": (
        _step(lambda d: S.lifetime_label(d).select("serial_number", "time", "max_lifetime"), _daily),
        sql(f"SELECT serial_number, {big('time')} AS time, {big('max(time) OVER (PARTITION BY serial_number)')} AS max_lifetime FROM daily",
            DAILY_CTE),
    ),
    "panel_sample": (
        _step(lambda d: S.panel_sample(d, 4).select("serial_number", "time", "row_key"), _daily),
        sql(f"SELECT serial_number, {big('time')} AS time, row_key FROM s",
            DAILY_CTE, sampled_cte("daily", "s").replace("drawn <= 9", "drawn <= 3")),
    ),
    "target_encode": (
        _step(_target_encode),
        sql(f"SELECT p.serial_number, p.row_key, p.model, {r('c.model_encoded')} AS model_encoded FROM panel p JOIN enc_cat c ON p.model = c.model",
            encoding_ctes("panel")),
    ),
    "unknown_category": (
        _step(_unknown_category),
        sql(f"""SELECT serial_number, row_key, CASE WHEN model IN (
                 SELECT model FROM early WHERE model < 'G') THEN model ELSE 'UNKNOWN' END AS model
               FROM late""", EARLY_LATE_CTE),
    ),
    "one_hot_season": (
        _step(_one_hot),
        sql("SELECT serial_number, row_key, "
            + ", ".join(f"CAST(CASE WHEN season = '{m}' THEN 1 ELSE 0 END AS DOUBLE) AS season_{m}" for m in MONTHS)
            + " FROM seasonal", SEASON_CTE),
    ),
    "scaler_fit": (
        _step(lambda p: E.moments(p, SCALED)),
        sql("SELECT " + ", ".join(f"{r(f'avg({c})')} AS mean_{c}, {r(f'stddev_pop({c})')} AS std_{c}" for c in SCALED) + " FROM panel"),
    ),
    "standard_scale": (
        _step(_scale),
        sql("SELECT serial_number, row_key, " + ", ".join(
            f"{r(f'({c} - (SELECT avg({c}) FROM panel)) / (SELECT stddev_pop({c}) FROM panel)')} AS {c}" for c in SCALED) + " FROM panel"),
    ),
    "truncated_ids": (_step(P.truncated_ids), sql("SELECT serial_number FROM trunc", TRUNCATED_CTE)),
    "remove_truncated": (
        _step(lambda p: P.remove_truncated(p)[0]),
        sql(f"SELECT {_PANEL_ROW} FROM panel WHERE serial_number NOT IN (SELECT serial_number FROM trunc)", TRUNCATED_CTE),
    ),
    "semi_failed": (
        _step(lambda p: P.split_rows(p, p.where("failure = 1").select("serial_number").distinct())),
        sql(f"SELECT {_PANEL_ROW} FROM panel WHERE serial_number IN (SELECT serial_number FROM panel WHERE failure = 1)"),
    ),
    "stratified_split": (
        _step(P.stratified_split), sql(f"SELECT serial_number, {big('label')} AS label, split FROM asg", assignment_ctes())
    ),
    "split_assignment": (_step(P.initial_split), sql("SELECT serial_number, split, truncated FROM asg", assignment_ctes())),
    "untruncated_ids": (
        _step(_untruncated),
        sql("""SELECT o.serial_number FROM old o JOIN fresh_dev d ON o.serial_number = d.serial_number
               WHERE o.truncated AND NOT d.truncated""", *UPDATE_CTES),
    ),
    "new_entities": (
        _step(_new_entities),
        sql("SELECT DISTINCT serial_number FROM late WHERE serial_number NOT IN (SELECT serial_number FROM early)", EARLY_LATE_CTE),
    ),
    "split_update": (_step(_split_update), sql("SELECT serial_number, split, truncated FROM upd", *UPDATE_CTES)),
    "lifetime_update": (
        _step(_lifetime_update),
        sql(f"""SELECT serial_number, {big('max(life)')} AS max_lifetime FROM (
              SELECT serial_number, date_diff('day', min(date), max(date)) AS life FROM early GROUP BY 1
              UNION ALL SELECT serial_number, date_diff('day', min(date), max(date)) FROM late GROUP BY 1) GROUP BY 1""",
            EARLY_LATE_CTE),
    ),
    "prep_train": (_prep(True), sql(f"SELECT {PREP_COLUMNS} FROM train_out", *PREP_CTES)),
    "prep_test": (_prep(False), sql(f"SELECT {PREP_COLUMNS} FROM test_out", *PREP_CTES)),
    "prep_tune": (
        _prep_tune,
        sql(
            f"SELECT {TUNED_COLUMNS}, 'train' AS split FROM train_tuned LEFT JOIN known USING (serial_number) UNION ALL "
            f"SELECT {TUNED_COLUMNS}, 'test' FROM test_tuned LEFT JOIN known USING (serial_number)", *UPDATE_CTES,
            "known AS (SELECT serial_number, date_diff('day', min(date), max(date)) AS known FROM early GROUP BY 1)",
            """fit_rows AS (SELECT *, monthname(date) AS season FROM early
                 WHERE serial_number IN (SELECT serial_number FROM old WHERE split = 'train' AND NOT truncated)),
               tune_rows AS (SELECT *, monthname(date) AS season FROM late
                 WHERE serial_number IN (SELECT serial_number FROM upd WHERE split = 'train' AND NOT truncated)),
               eval_rows AS (SELECT *, monthname(date) AS season FROM late
                 WHERE serial_number IN (SELECT serial_number FROM upd WHERE split = 'test' AND NOT truncated))""",
            imputed_ctes("fit_rows", "tr"), encoding_ctes("tr_imp"), encoded_cte("tr_imp", "tr_enc"),
            imputed_ctes("tune_rows", "tu"), encoded_cte("tu_imp", "tu_enc"), scaled_cte("tu_enc", "tr_enc", "tu_z"),
            sampled_cte("tu_z", "tu_s"), labelled_cte("tu_s", "train_tuned"),
            imputed_ctes("eval_rows", "ev"), encoded_cte("ev_imp", "ev_enc"), scaled_cte("ev_enc", "tr_enc", "ev_z"),
            labelled_cte("ev_z", "test_tuned"),
        ),
    ),
}
