"""Hazard models, survival curves, scores and model versions."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.columns import TIMES
from hazardloom.functions import expected_time, linear_hazards, rounded_curve, sigmoid, survival_curve
from hazardloom.functions.curves import fillable, linear_fill
from hazardloom.operators import hazard as H
from hazardloom.operators import scoring as C
from hazardloom.operators import steps as S
from hazardloom.operators.prep import PanelPrep
from hazardloom.plans.base import big, r, sql, tidy
from hazardloom.plans.panel import read_panel
from hazardloom.plans.prep_queries import DAILY_CTE, FEATURES, PREP_CTES, train_test
from hazardloom.session import discard, scratch_path, written
from hazardloom.sources import registry as R

# Three hazard versions with given weights: name -> (smart_1_raw, smart_9_raw, time, intercept)
VERSIONS = {"v1": (4e-6, -2e-5, 0.002, -4.0), "v2": (-6e-6, 1e-4, -0.004, -3.0), "v3": (1e-6, -3e-4, 0.0, -5.0)}
_N = len(TIMES)


def score_sql(version: str) -> str:
    a, b, _, c = VERSIONS[version]
    return f"{c} + {a} * coalesce(smart_1_raw, 0) + {b} * smart_9_raw"


def timed(spark, sf) -> DataFrame:
    """One row per device and day with time, lifetime and the device's final label."""
    rows = S.lifetime_label(S.relative_time(S.drop_duplicates(read_panel(spark, sf)), one_row_per_day=True))
    return rows.withColumn("final", F.max("failure").over(Window.partitionBy("serial_number")))


TIMED_CTE = """
timed AS (
  SELECT *, max(time) OVER (PARTITION BY serial_number) AS max_lifetime,
         max(failure) OVER (PARTITION BY serial_number) AS final
  FROM daily)"""


def _scored(rows: DataFrame, version: str, output: str) -> DataFrame:
    a, b, _, c = VERSIONS[version]
    filled = rows.withColumn("smart_1_raw", F.coalesce("smart_1_raw", F.lit(0.0)))
    return filled.withColumn(output, H.linear_score({"smart_1_raw": a, "smart_9_raw": b}, c))


def with_hazards(rows: DataFrame, version: str = "v1") -> DataFrame:
    return _scored(rows, version, "hazards").withColumn("hazards", linear_hazards(F.col("hazards"), VERSIONS[version][2], TIMES))


def with_curve(rows: DataFrame, version: str = "v1") -> DataFrame:
    curves = with_hazards(rows, version).withColumn("surv", survival_curve(F.col("hazards"), _N))
    return fillable(curves, _scored(rows, version, "surv"), linear_fill(VERSIONS[version][2], TIMES))


def _tidy_curves(rows: DataFrame) -> DataFrame:
    """``tidy`` for curves: rounded on their array, before it is 159 columns."""
    return rows.withColumn("surv", rounded_curve(F.col("surv"), _N, 6))


def truth(rows: DataFrame) -> DataFrame:
    return rows.where("time <> max_lifetime").withColumn("duration", F.col("max_lifetime") - F.col("time")).withColumn(
        "failure", F.col("final") == 1
    )


def curve_ctes(rows: str, version: str = "v1", name: str = "curve", keys: str = "serial_number, time") -> str:
    """Long form of the survival curves of relation ``rows``."""
    t = VERSIONS[version][2]
    return f"""
{name}_grid AS (SELECT unnest(range(1, {_N + 1})) AS t),
{name}_h AS (
  SELECT x.*, CAST(t AS BIGINT) AS t, 1.0 / (1.0 + exp(-({score_sql(version)} + {t} * t))) AS h
  FROM {rows} x CROSS JOIN {name}_grid),
{name} AS (
  SELECT *, exp(-sum(h) OVER (PARTITION BY {keys} ORDER BY t)) AS s FROM {name}_h)"""


TRUTH_CTE = "obs AS (SELECT *, max_lifetime - time AS duration FROM timed WHERE time <> max_lifetime)"
AREA = "sum(s) - (max(s) FILTER (WHERE t = 1) + max(s) FILTER (WHERE t = 159)) / 2"


def pairs_ctes(rows: str, name: str, p: str) -> str:
    """Brute-force pairs of relation ``rows`` (duration, final, and the prediction ``p``)."""
    return f"""
{name} AS (
  SELECT count(*) AS pairs, count(*) FILTER (WHERE i.p < j.p) AS concordant, count(*) FILTER (WHERE i.p = j.p) AS tied
  FROM (SELECT duration, {p} AS p FROM {rows} WHERE final = 1) i
  JOIN (SELECT duration, final, {p} AS p FROM {rows}) j
    ON i.duration < j.duration OR (i.duration = j.duration AND j.final = 0))"""


def _by_model(column: str):
    def run(spark, sf):
        rows = with_curve(timed(spark, sf)) if column == "surv" else with_hazards(timed(spark, sf))
        points = rows.select("model", F.posexplode(column).alias("i", "v")).withColumn("t", F.col("i") + 1)
        return tidy(points.groupBy("model", "t").agg(
            F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high")
        ))
    return run


def _by_model_sql(value: str) -> str:
    return sql(
        f"SELECT model, t, count(*) AS n, {r(f'avg({value})')} AS mean, {r(f'min({value})')} AS low, {r(f'max({value})')} AS high FROM curve GROUP BY model, t",
        DAILY_CTE, TIMED_CTE, curve_ctes("timed"),
    )


def _predict_survival(spark, sf):
    rows = truth(_tidy_curves(with_curve(timed(spark, sf))))
    return tidy(rows.select("serial_number", "time", "duration", "failure", *[F.col("surv")[t - 1].alias(f"s{t}") for t in TIMES]), None)


def _expected_time(spark, sf):
    rows = with_curve(timed(spark, sf))
    return tidy(rows.select("serial_number", "time", expected_time(F.col("surv"), TIMES).alias("expected")))


def _predict_wide(spark, sf):
    return tidy(H.wide(_tidy_curves(with_curve(timed(spark, sf)))), None)


def _ground_truth(spark, sf):
    return tidy(truth(timed(spark, sf)).select("serial_number", "time", "duration", "failure"))


def _assemble(spark, sf):
    """Assembled vectors, shown one entry per column."""
    rows = timed(spark, sf).withColumn("smart_1_raw", F.coalesce("smart_1_raw", F.lit(0.0)))
    rows = H.training_rows(rows)
    inputs = ["smart_1_raw", "smart_9_raw", "time_to_event"]
    vectors = H.assemble(rows, inputs).withColumn("v", vector_to_array("features"))
    return tidy(vectors.select("serial_number", "time", *[F.col("v")[i].alias(f"f_{c}") for i, c in enumerate(inputs)]))


def _log_loss(spark, sf):
    a, b, _, c = VERSIONS["v1"]
    rows = read_panel(spark, sf).withColumn("smart_1_raw", F.coalesce("smart_1_raw", F.lit(0.0)))
    p = sigmoid(H.linear_score({"smart_1_raw": a, "smart_9_raw": b}, c))
    return tidy(rows.groupBy("model").agg(H.log_loss(F.col("failure") == 1, p).alias("log_loss")))


def _concordance(spark, sf):
    rows = truth(timed(spark, sf)).withColumn("predicted", F.round("smart_9_raw", 0))
    return tidy(C.concordance(rows))


def _concordance_buckets(spark, sf):
    """The same with few points per range, so that most pairs lie across ranges."""
    rows = truth(timed(spark, sf)).withColumn("predicted", F.round("smart_9_raw", 0))
    return tidy(C.concordance(rows, values_per_bucket=500))


def _concordance_fractional(spark, sf):
    """Durations that are nearly all different, so that there are about as many outcomes as rows."""
    rows = truth(timed(spark, sf)).withColumn("predicted", F.round("smart_9_raw", 0))
    return tidy(C.concordance(rows.withColumn("duration", F.col("duration") + F.coalesce("smart_1_raw", F.lit(0.5)) / 1000.0), values_per_bucket=500))


def _brier(spark, sf):
    return C.brier_curve(with_curve(truth(timed(spark, sf))))


def version_ctes(v: str) -> str:
    return f"""
{curve_ctes("obs", v, f"c{v}").strip()},
e{v} AS (SELECT serial_number, any_value(duration) AS duration, any_value(final) AS final, round({AREA}, 9) AS p FROM c{v} GROUP BY serial_number, time),
{pairs_ctes(f"e{v}", f"p{v}", "p").strip()},
b{v} AS (
  SELECT t, avg(pow(CASE WHEN duration > t THEN 1.0 ELSE 0.0 END - s, 2)) AS brier
  FROM c{v} WHERE duration > t OR final = 1 GROUP BY t),
m{v} AS (
  SELECT (concordant + tied / 2.0) / pairs AS ci,
         (SELECT (sum(brier) - (max(brier) FILTER (WHERE t = 1) + max(brier) FILTER (WHERE t = 159)) / 2) / 158 FROM b{v}) AS ibs
  FROM p{v})"""


def _scores(rows: DataFrame, version: str) -> DataFrame:
    """(ci, ibs) of a version; expected times are rounded to 9 digits so that equal devices tie on every engine."""
    return C.score_predictions(with_curve(rows, version), digits=9)


def _score_model(spark, sf):
    return tidy(_scores(truth(timed(spark, sf)), "v1"))


def _registry(spark, sf) -> str:
    """Score the three versions on all rows and append them to a new table."""
    rows, root = written(truth(timed(spark, sf)), "truth"), scratch_path(spark, "registry")
    for name in VERSIONS:
        row = _scores(rows, name).first()
        R.append_version(spark, root, name, row["ci"], row["ibs"])
    discard(rows)
    return root


def _registry_append(spark, sf):
    return tidy(R.read_versions(spark, _registry(spark, sf)).select("model_name", "ci", "ibs"))


def _best_model(spark, sf):
    versions = R.read_versions(spark, _registry(spark, sf))
    parts = [R.best(versions, m).select(F.lit(m).alias("metric"), "model_name", F.col(m).alias("value")) for m in ("ci", "ibs")]
    return tidy(parts[0].unionByName(parts[1]))


def _prepared(spark, sf):
    """(train, test) of the fitted preparation."""
    train, test = train_test(read_panel(spark, sf))
    fitted, ready = PanelPrep().fit_transform(train)
    return written(ready, "train"), written(fitted.transform(test), "test")


# Fits that SQL can follow: full gradient steps on the penalised log loss, time in units of the grid's end
STEPS = {"solver": "sgd", "lr": 0.05, "batches": 1, "regParam": 1e-4, "time_unit": float(_N)}


def _metrics(spark, train: DataFrame, test: DataFrame, model: H.HazardModel, losses: list[float]) -> DataFrame:
    """One row: rows learned from and scored, ci, ibs and the loss of every pass."""
    s = C.score_predictions(H.predict(model, test), digits=9).first()
    facts = {"ci": s["ci"], "ibs": s["ibs"], **{f"loss_{i}": v for i, v in enumerate(losses)}}
    counts = [F.count_if(F.col("part") == p).alias(f"n_{p}") for p in ("train", "test")]
    rows = H.training_rows(train).select(F.lit("train").alias("part")).union(H.scoring_rows(test).select(F.lit("test")))
    return tidy(rows.agg(*counts).select("*", *[F.lit(v).cast("double").alias(k) for k, v in facts.items()]))


def _fit_lr(spark, sf):
    train, test = _prepared(spark, sf)
    model = H.fit(train, "logistic_regression", epochs=3, **STEPS)
    return _metrics(spark, train, test, model, model.loss)


def _fit_mlp(spark, sf):
    train, test = _prepared(spark, sf)
    model = H.fit(train, "NN", epochs=5, lr=0.01, hidden_dim=16)
    return _metrics(spark, train, test, model, model.loss)


def _fine_tune(spark, sf):
    """Two passes, stored, loaded and continued by two more."""
    train, test = _prepared(spark, sf)
    path = scratch_path(spark, "model")
    first = H.fit(train, "logistic_regression", epochs=2, **STEPS)
    first.save(path)
    model = H.fine_tune(H.HazardModel.load(spark, path), train, epochs=2)
    return _metrics(spark, train, test, model, first.loss + model.loss)


def _predict_fitted(spark, sf):
    """Inference: curves of all test rows, without their labels."""
    train, test = _prepared(spark, sf)
    model = H.fit(train, "logistic_regression", epochs=3, **STEPS)
    return tidy(H.wide(_tidy_curves(H.predict(model, test.drop("failure", "max_lifetime"), mode="infer"))), None)


def _predict_other(spark, sf):
    """The same with a classifier that has no formula of its own here, stored and loaded."""
    train, test = _prepared(spark, sf)
    path = scratch_path(spark, "tree")
    H.fit(train, DecisionTreeClassifier(maxDepth=4, seed=1)).save(path)
    curves = H.predict(H.HazardModel.load(spark, path), test.drop("failure", "max_lifetime"), mode="infer")
    return tidy(H.wide(_tidy_curves(curves)), None)


def _model_stats(spark, sf):
    """The history of a version that continues another, which continues a third; without the times, which differ from run to run."""
    train, test = _prepared(spark, sf)
    root, model = scratch_path(spark, "registry"), None
    for _ in range(3):
        model = H.fine_tune(model, train, epochs=1) if model else H.fit(train, "logistic_regression", epochs=1, **STEPS)
        version = R.save_version(spark, root, model, "logistic_regression", C.score_predictions(H.predict(model, test), digits=9))
        model = R.load_version(spark, root, version)
    return tidy(R.history(spark, root, version).where("metric <> 'fit_time'").select("metric", F.col("step").cast("bigint"), "value"))


_INPUTS = [*FEATURES, "tte"]


def steps_ctes(epochs: int) -> str:
    """Weights w0 ... of gradient descent from zero on the prepared train rows, and the losses l0 ... that each pass starts from."""
    rate, penalty = STEPS["lr"], STEPS["regParam"]
    z = " + ".join(["w_b", *[f"w_{f} * {f}" for f in _INPUTS]])
    out = [f"tr AS (SELECT *, (max_lifetime - time) / {float(_N)} AS tte, failure AS y FROM train_out WHERE time <> max_lifetime)",
           "w0 AS (SELECT 0.0::DOUBLE AS w_b, " + ", ".join(f"0.0::DOUBLE AS w_{f}" for f in _INPUTS) + ")"]
    for k in range(epochs):
        slopes = ", ".join(f"avg((p - y) * {f}) AS g_{f}" for f in _INPUTS)
        square = " + ".join(f"w_{f} * w_{f}" for f in _INPUTS)
        out += [
            f"z{k} AS (SELECT tr.*, {z} AS z FROM tr CROSS JOIN w{k})",
            f"g{k} AS (SELECT avg(p - y) AS g_b, {slopes}, avg(ln(1 + exp(z)) - y * z) AS loss FROM (SELECT *, 1 / (1 + exp(-z)) AS p FROM z{k}))",
            f"l{k} AS (SELECT loss + {penalty} / 2 * ({square}) AS loss FROM g{k} CROSS JOIN w{k})",
            f"w{k + 1} AS (SELECT w_b - {rate} * g_b AS w_b, "
            + ", ".join(f"w_{f} - {rate} * (g_{f} + {penalty} * w_{f}) AS w_{f}" for f in _INPUTS) + f" FROM w{k} CROSS JOIN g{k})",
        ]
    return ",\n".join(out)


def fitted_curve_ctes(rows: str, k: int, name: str) -> str:
    """Long form of the survival curves of relation ``rows`` under the weights after ``k`` passes."""
    z = " + ".join(["w_b", *[f"w_{f} * {f}" for f in FEATURES]])
    return f"""
{name}_grid AS (SELECT unnest(range(1, {_N + 1})) AS t),
{name}_h AS (SELECT x.*, t, 1 / (1 + exp(-({z} + w_tte / {float(_N)} * t))) AS h FROM {rows} x CROSS JOIN {name}_grid CROSS JOIN w{k}),
{name} AS (SELECT *, exp(-sum(h) OVER (PARTITION BY serial_number, time ORDER BY t)) AS s FROM {name}_h)"""


_TEST_CTE = "te_obs AS (SELECT *, max_lifetime - time AS duration, failure AS final FROM test_out WHERE time <> max_lifetime)"


def fitted_scores_ctes(k: int) -> str:
    """Relation m``k``: ci and ibs of the prepared test rows under the weights after ``k`` passes."""
    return f"""
{fitted_curve_ctes("te_obs", k, f"c{k}").strip()},
e{k} AS (SELECT serial_number, any_value(duration) AS duration, any_value(final) AS final, round({AREA}, 9) AS p FROM c{k} GROUP BY serial_number, time),
{pairs_ctes(f"e{k}", f"p{k}", "p").strip()},
b{k} AS (
  SELECT t, avg(pow(CASE WHEN duration > t THEN 1.0 ELSE 0.0 END - s, 2)) AS brier FROM c{k} WHERE duration > t OR final = 1 GROUP BY t),
m{k} AS (
  SELECT (concordant + tied / 2.0) / nullif(pairs, 0) AS ci,
         (SELECT sum((brier + before) / 2 * (t - since)) / (max(t) - (SELECT min(t) FROM b{k}))
          FROM (SELECT *, lag(brier) OVER (ORDER BY t) AS before, lag(t) OVER (ORDER BY t) AS since FROM b{k})) AS ibs
  FROM p{k})"""


def _metrics_sql(epochs: int) -> str:
    losses = ", ".join(f"(SELECT {r('loss')} FROM l{i}) AS loss_{i}" for i in range(epochs))
    return sql(
        f"SELECT (SELECT count(*) FROM tr) AS n_train, (SELECT count(*) FROM te_obs) AS n_test, {r('ci')} AS ci, {r('ibs')} AS ibs, {losses} FROM m{epochs}",
        *PREP_CTES, steps_ctes(epochs), _TEST_CTE, fitted_scores_ctes(epochs),
    )


_HISTORY_SQL = sql(
    " UNION ALL ".join(
        f"SELECT '{metric}' AS metric, CAST({i} AS BIGINT) AS step, {r(value)} AS value FROM {table}"
        for i in range(3) for metric, value, table in (("loss", "loss", f"l{i}"), ("CI_test", "ci", f"m{i + 1}"), ("IBS_test", "ibs", f"m{i + 1}"))
    ),
    *PREP_CTES, steps_ctes(3), _TEST_CTE, *[fitted_scores_ctes(k) for k in (1, 2, 3)],
)


_SCORED = [DAILY_CTE, TIMED_CTE, TRUTH_CTE]
_ALL_VERSIONS = [*_SCORED, *[version_ctes(v) for v in VERSIONS],
                 "versions AS (" + " UNION ALL ".join(f"SELECT '{v}' AS model_name, ci, ibs FROM m{v}" for v in VERSIONS) + ")"]
_WIDE = ", ".join(f"{r(f'max(s) FILTER (WHERE t = {t})')} AS \"{t}\"" for t in TIMES)
_BRIER_CTE = """
brier AS (
  SELECT t, avg(pow(CASE WHEN duration > t THEN 1.0 ELSE 0.0 END - s, 2)) AS brier, count(*) AS n_known
  FROM curve WHERE duration > t OR final = 1 GROUP BY t)"""

QUERIES = {
    "hazard_grid": (_by_model("hazards"), _by_model_sql("h")),
    "survival_curve": (_by_model("surv"), _by_model_sql("s")),
    "predict_survival": (
        _predict_survival,
        sql("SELECT serial_number, CAST(time AS BIGINT) AS time, any_value(duration) AS duration, any_value(final) = 1 AS failure, "
            + ", ".join(f"{r(f'max(s) FILTER (WHERE t = {t})')} AS s{t}" for t in TIMES) + " FROM curve GROUP BY serial_number, time",
            DAILY_CTE, TIMED_CTE, TRUTH_CTE, curve_ctes("obs")),
    ),
    "expected_time": (
        _expected_time,
        sql(f"SELECT serial_number, time, {r(AREA)} AS expected FROM curve GROUP BY serial_number, time",
            DAILY_CTE, TIMED_CTE, curve_ctes("timed")),
    ),
    "predict_wide": (
        _predict_wide,
        sql(f"SELECT serial_number, time, {_WIDE} FROM curve GROUP BY serial_number, time", DAILY_CTE, TIMED_CTE, curve_ctes("timed")),
    ),
    "ground_truth": (
        _ground_truth,
        sql("SELECT serial_number, time, duration, final = 1 AS failure FROM obs", DAILY_CTE, TIMED_CTE, TRUTH_CTE),
    ),
    "assemble": (
        _assemble,
        sql(f"""SELECT serial_number, time, {r('coalesce(smart_1_raw, 0)')} AS f_smart_1_raw, {r('smart_9_raw')} AS f_smart_9_raw,
                CAST(duration AS DOUBLE) AS f_time_to_event FROM obs""", DAILY_CTE, TIMED_CTE, TRUTH_CTE),
    ),
    "log_loss": (
        _log_loss,
        sql(f"""SELECT model, {r('avg(CASE WHEN failure = 1 THEN -ln(p) ELSE -ln(1 - p) END)')} AS log_loss
            FROM (SELECT *, 1.0 / (1.0 + exp(-({score_sql("v1")}))) AS p FROM panel) GROUP BY model"""),
    ),
    "concordance": (
        _concordance,
        sql(f"SELECT pairs, concordant, tied, {r('(concordant + tied / 2.0) / pairs')} AS ci FROM pr",
            DAILY_CTE, TIMED_CTE, TRUTH_CTE, pairs_ctes("obs", "pr", "round(smart_9_raw, 0)")),
    ),
    "concordance_buckets": (
        _concordance_buckets,
        sql(f"SELECT pairs, concordant, tied, {r('(concordant + tied / 2.0) / pairs')} AS ci FROM pr",
            DAILY_CTE, TIMED_CTE, TRUTH_CTE, pairs_ctes("obs", "pr", "round(smart_9_raw, 0)")),
    ),
    "concordance_fractional": (
        _concordance_fractional,
        sql(f"SELECT pairs, concordant, tied, {r('(concordant + tied / 2.0) / pairs')} AS ci FROM pr",
            DAILY_CTE, TIMED_CTE, TRUTH_CTE,
            "parts AS (SELECT * REPLACE (duration + coalesce(smart_1_raw, 0.5) / 1000.0 AS duration) FROM obs)",
            pairs_ctes("parts", "pr", "round(smart_9_raw, 0)")),
    ),
    "brier_curve": (
        lambda spark, sf: tidy(_brier(spark, sf)),
        sql(f"SELECT t, {r('brier')} AS brier, n_known FROM brier", DAILY_CTE, TIMED_CTE, TRUTH_CTE, curve_ctes("obs"), _BRIER_CTE),
    ),
    "integrated_brier": (
        lambda spark, sf: tidy(C.integrated_brier(_brier(spark, sf))),
        sql(f"""SELECT {r('(sum(brier) - (max(brier) FILTER (WHERE t = 1) + max(brier) FILTER (WHERE t = 159)) / 2) / 158')} AS ibs_known
            FROM brier""", DAILY_CTE, TIMED_CTE, TRUTH_CTE, curve_ctes("obs"), _BRIER_CTE),
    ),
    "score_model": (_score_model, sql(f"SELECT {r('ci')} AS ci, {r('ibs')} AS ibs FROM mv1", *_SCORED, version_ctes("v1"))),
    "registry_append": (_registry_append, sql(f"SELECT model_name, {r('ci')} AS ci, {r('ibs')} AS ibs FROM versions", *_ALL_VERSIONS)),
    "best_model": (
        _best_model,
        sql(f"""(SELECT 'ci' AS metric, model_name, {r('ci')} AS value FROM versions ORDER BY ci DESC LIMIT 1)
            UNION ALL (SELECT 'ibs', model_name, {r('ibs')} FROM versions ORDER BY ibs LIMIT 1)""", *_ALL_VERSIONS),
    ),
    "fit_lr_metrics": (_fit_lr, _metrics_sql(3)),
    "fit_mlp_metrics": (_fit_mlp, None),
    "fine_tune_metrics": (_fine_tune, _metrics_sql(4)),
    "predict_infer": (
        _predict_fitted,
        sql(f"SELECT serial_number, {big('time')} AS time, {_WIDE} FROM pc GROUP BY serial_number, time",
            *PREP_CTES, steps_ctes(3), fitted_curve_ctes("test_out", 3, "pc")),
    ),
    "predict_other_estimator": (_predict_other, None),
    "model_stats": (_model_stats, _HISTORY_SQL),
}
