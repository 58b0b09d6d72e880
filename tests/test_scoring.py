import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from hazardloom.functions import expected_time, linear_hazards, rounded_curve, survival_curve
from hazardloom.functions.curves import SLICE
from hazardloom.functions.dominance import exact_dot
from hazardloom.operators import ranks as R
from hazardloom.operators import scoring as C
from hazardloom.operators.hazard import HazardModel, predict
from hazardloom.operators.trainer import Network
from hazardloom.session import small_batches


def brute(t, e, p):
    pairs = conc = tied = 0
    for i in range(len(t)):
        for j in range(len(t)):
            if e[i] and (t[i] < t[j] or (t[i] == t[j] and not e[j])):
                pairs += 1
                conc += p[i] < p[j]
                tied += p[i] == p[j]
    return pairs, conc, tied


def frame(spark, t, e, p):
    return spark.createDataFrame([(int(a), bool(b), float(c)) for a, b, c in zip(t, e, p)], "duration int, failure boolean, predicted double")


def test_small(spark):
    r = C.concordance(frame(spark, [2, 4, 4, 6], [1, 1, 0, 0], [1, 3, 3, 2])).first()
    assert (int(r.pairs), int(r.concordant), int(r.tied), r.ci) == (5, 3, 1, 0.7)


@pytest.mark.parametrize("per_bucket", [10, 60, 10_000])
def test_against_all_pairs(spark, per_bucket):
    rng = np.random.default_rng(3)
    n = 400
    t, e = rng.integers(0, 40, n), rng.random(n) < 0.5
    p = np.where(rng.random(n) < 0.33, 5.0, np.round(rng.normal(5, 2, n), 1))  # a third of all predictions are equal
    r = C.concordance(frame(spark, t, e, p), values_per_bucket=per_bucket).first()
    assert (int(r.pairs), int(r.concordant), int(r.tied)) == brute(t, e, p)


def test_reversed_predictions(spark):
    rng = np.random.default_rng(4)
    t, e, p = rng.integers(0, 9, 60), rng.random(60) < 0.6, rng.integers(0, 12, 60)
    up, down = (C.concordance(frame(spark, t, e, s * p)).first().ci for s in (1, -1))
    assert up + down == pytest.approx(1)


def test_fractional_durations(spark):
    data = spark.createDataFrame([(1.2, True, 1.0), (1.8, True, 3.0), (2.5, True, 2.0)], "duration double, failure boolean, predicted double")
    r = C.concordance(data).first()
    assert (int(r.pairs), int(r.concordant), int(r.tied)) == (3, 2, 0)
    with pytest.raises(ValueError):
        C.concordance(data.withColumn("predicted", F.lit(float("nan"))))


def test_exact_dot_beyond_64_bits():
    a, b = np.array([2**62, 2**40 + 1, 7]), np.array([2**61 + 3, 2**50, 0])
    assert exact_dot(a, b) == sum(int(x) * int(y) for x, y in zip(a, b))


def test_no_pairs(spark):
    r = C.concordance(frame(spark, [1, 2], [0, 0], [1, 2])).first()
    assert (r.pairs, r.ci) == (0, None)


def test_constant_hazard(spark):
    df = spark.range(3).withColumn("h", F.array(F.lit(0.5), F.lit(0.5), F.lit(0.5)))
    out = df.withColumn("s", survival_curve(F.col("h"), 3)).withColumn("x", expected_time(F.col("s"), [1, 2, 3])).first()
    assert out.s == pytest.approx([0.606531, 0.367879, 0.223130], abs=1e-6)
    assert out.x == pytest.approx(0.782710, abs=1e-6)


def test_curve_falls(spark):
    df = spark.range(50).withColumn("h", linear_hazards(F.col("id") / 10.0 - 3, 0.01, range(1, 160)))
    for r in df.withColumn("s", survival_curve(F.col("h"), 159)).collect():
        s = np.array(r.s)
        assert len(s) == 159 and (np.diff(s) < 0).all() and 0 < s[-1] and s[0] <= 1
        assert s[0] == pytest.approx(math.exp(-1 / (1 + math.exp(-(r.id / 10 - 3 + 0.01)))))


def test_brier(spark):
    rng = np.random.default_rng(5)
    times, n = [1, 2, 4, 7], 80
    t, e = rng.integers(0, 9, n), rng.random(n) < 0.5
    s = np.sort(rng.random((n, 4)))[:, ::-1]
    df = spark.createDataFrame(
        [(int(a), bool(b), [float(x) for x in c]) for a, b, c in zip(t, e, s)], "duration int, failure boolean, surv array<double>"
    )
    want = []
    for k, at in enumerate(times):
        known = (t > at) | e
        want.append(np.mean(((t > at)[known] - s[known, k]) ** 2))
    curve = C.brier_curve(df, times)
    got = [r.brier for r in curve.orderBy("t").collect()]
    assert got == pytest.approx(want)
    assert C.integrated_brier(curve).first()[0] == pytest.approx(np.trapezoid(want, times) / 6)


def test_ranks_and_sums_on_two_levels(spark):
    rng = np.random.default_rng(5)
    values = [None if v < 0.05 else round(float(v), 2) for v in rng.random(700)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    ranked, n = R.dense_ranks(df, "v")
    order = sorted({v for v in values if v is not None})
    assert n == len(order) and sorted(map(tuple, ranked.collect())) == [(v, i) for i, v in enumerate(order)]
    rows_ = [(g, p, int(rng.integers(0, 9))) for g in ("a", "b") for p in rng.permutation(97)[:60].tolist()]
    table = spark.createDataFrame(rows_, "g string, p long, w long")
    for groups in (["g"], []):
        source = table if groups else table.where("g = 'a'")
        got = {(r.g, r.p): r.above for r in R.sums_above(source, groups, "p", "w", 97).collect()}
        assert got == {(g, p): sum(w for h, q, w in rows_ if h == g and q > p) for g, p, _ in rows_ if groups or g == "a"}
    plan = R.sums_above(table, ["g"], "p", "w", 97)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_both_scores_read_the_curves_once(spark):
    times = [1, 2, 4]
    data = [(1.5, True, [0.9, 0.5, 0.2]), (3.0, False, [0.8, 0.7, 0.6]), (5.0, False, [1.0, 0.9, 0.8]), (2.0, True, None), (None, True, [0.5, 0.4, 0.3])]
    curves = spark.createDataFrame(data, "duration double, failure boolean, surv array<double>").repartition(3)
    got = {r.t: (r.brier, r.n_known) for r in C.brier_curve(curves, times).collect()}
    want = {}
    for i, t in enumerate(times):
        known = [(d, s) for d, e, s in data if s is not None and ((d is not None and d > t) or e)]
        want[t] = (sum((float(d is not None and d > t) - s[i]) ** 2 for d, s in known) / len(known), len(known))
    assert got == {t: (pytest.approx(b), n) for t, (b, n) in want.items()}
    plan = C.scored_facts(curves, times)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan
    r = C.score_predictions(curves, times).first()
    assert r.ci == 1.0 and r.ibs == pytest.approx(sum((want[a][0] + want[b][0]) / 2 * (b - a) for a, b in zip(times, times[1:])) / 3)


def test_ranges_do_not_grow_with_the_points(spark, monkeypatch):
    """As many outcomes as rows, few points per range: the number of ranges, which are tasks and files, stays bounded, and no pair is lost."""
    rng = np.random.default_rng(8)
    n = 300
    t, e, p = np.round(rng.random(n) * 50, 3), rng.random(n) < 0.6, rng.integers(0, 60, n)
    asked, kept = [], C.written
    monkeypatch.setattr(C, "BUCKETS", 7)
    monkeypatch.setattr(C, "SPANS", 5)
    monkeypatch.setattr(C, "written", lambda df, label: asked.append(df.rdd.getNumPartitions()) or kept(df, label))
    data = spark.createDataFrame([(float(a), bool(b), float(c)) for a, b, c in zip(t, e, p)], "duration double, failure boolean, predicted double")
    r = C.concordance(data, values_per_bucket=2).first()
    assert (int(r.pairs), int(r.concordant), int(r.tied)) == brute(t, e, p)
    assert max(asked) <= 8  # 8 shuffle partitions
    assert C._ranges(54_000_000, 500, 256) == 1080 and C._ranges(15_000, 500, 256) == 30


def test_curves_are_rounded_on_their_array(spark):
    values = [[0.1234565, 0.9999995, 1e-7], [0.0000005, 0.5, 1.0], [float("nan"), 0.0000004999, 2.5e9 + 0.25]]
    df = spark.createDataFrame([(v,) for v in values], "s array<double>")
    got = df.select("s", rounded_curve(F.col("s"), 3, 6).alias("a"), F.transform("s", lambda x: F.round(x, 6) + 0.0).alias("b")).collect()
    assert all(repr(r.a) == repr(r.b) for r in got)


def test_a_worker_computes_slices(spark, monkeypatch):
    """What a worker holds besides its batch doesn't grow with the batch."""
    from hazardloom.functions import curves

    assert max(at.stop - at.start for at in curves.slices(10_000)) == curves.SLICE
    df = spark.range(2500, numPartitions=1).select((F.col("id") / 1000).alias("z"), F.lit(2.0).alias("duration"), (F.col("id") % 2 == 0).alias("failure"))
    rows_ = df.withColumn("surv", survival_curve(linear_hazards(F.col("z"), 0.1, [1, 2, 4]), 3))
    z = np.arange(2500) / 1000
    s = np.exp(-np.cumsum(1 / (1 + np.exp(-(z[:, None] + 0.1 * np.array([1, 2, 4])))), axis=1))
    assert np.allclose([r.surv for r in rows_.collect()], s)
    known = np.arange(2500) % 2 == 0
    want = [((1 - s[:, 0]) ** 2).mean(), (s[known, 1] ** 2).mean(), (s[known, 2] ** 2).mean()]
    assert [r.brier for r in C.brier_curve(rows_, [1, 2, 4]).orderBy("t").collect()] == pytest.approx(want)


def test_curves_are_scored_in_small_batches(spark):
    @F.arrow_udf("array<double>")
    def rows_held(x: pa.Array) -> pa.Array:
        return pa.array([[float(len(x))] * 2] * len(x), pa.list_(pa.float64()))

    # failed before the grid, so that each error is the square of the rows in the worker's batch
    curves = spark.range(2 * SLICE + 500, numPartitions=1).select(F.lit(0.0).alias("duration"), F.lit(True).alias("failure"), rows_held("id").alias("surv"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    assert spark.conf.get(name, None) is None
    want = (2 * SLICE**3 + 500**3) / (2 * SLICE + 500)
    assert [(r.brier, r.n_known) for r in C.brier_curve(curves, [1, 2]).collect()] == [(want, 2 * SLICE + 500)] * 2
    assert C.score_predictions(curves, [1, 2]).first().ibs == want
    assert spark.conf.get(name, None) is None


def test_small_batches_leave_the_session_as_it_was(spark):
    name, other = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.newSession()
    for own, inside in ((None, "7"), ("5", "5"), ("0", "7"), ("9", "7")):
        if own is not None:
            other.conf.set(name, own)
        with pytest.raises(KeyError), small_batches(other, 7):
            with small_batches(other, 7), small_batches(spark, 8):
                assert (other.conf.get(name), spark.conf.get(name)) == (inside, "8")
            assert other.conf.get(name) == inside
            raise KeyError
        assert other.conf.get(name, None) == own
    assert spark.conf.get(name, None) is None


def test_rows_without_a_curve_are_no_facts(spark):
    data = [(3.0, True, [0.9, 0.8]), (2.0, True, None), (1.0, False, [0.7, 0.6]), (None, None, None)]
    rows = spark.createDataFrame(data, "duration double, failure boolean, surv array<double>").repartition(1)
    got = C.scored_facts(rows, [1, 2]).where("errors IS NULL").collect()
    assert sorted((r.duration, round(r.predicted, 6)) for r in got) == [(1.0, 0.65), (3.0, 0.85)]
    none = rows.where("surv IS NULL")
    assert [r.known for r in C.scored_facts(none, [1, 2]).collect()] == [[0, 0]]


def test_predicted_curves_are_computed_where_they_are_scored(spark):
    """One Python worker per task: no plan node hands curves from one worker to another, and the scores are those of the column."""
    rows = [(str(i // 7), i % 7, 6, int(i % 3 == 0), None if i % 11 == 5 else i / 90) for i in range(2300)]
    df = spark.createDataFrame(rows, "serial_number string, time int, max_lifetime int, failure int, x double").repartition(3)
    times = [1, 2, 4]
    models = [HazardModel(["x"], Network([2, 1], [0.4, 0.1, -1.0])), HazardModel(["x"], Network.new(2, 3), 4.0)]
    for model in models:
        curves = predict(model, df, times)
        column = curves.select("*")
        plans = [C.scored_facts(c, times)._jdf.queryExecution().executedPlan().toString() for c in (curves, column)]
        assert [(p.count("MapInArrow"), "ArrowEvalPython" in p) for p in plans] == [(1, False), (1, True)]
        a, b = (sorted(map(repr, C.scored_facts(c, times).where("errors IS NULL").collect())) for c in (curves, column))
        assert a == b and len(a) == sum(r[1] != 6 for r in rows)
        a, b = ({r.t: r.n_known for r in C.brier_curve(c, times).collect()} for c in (curves, column))
        assert a == b and len(a) == 3
        known = df.where("x IS NOT NULL")
        a, b = (C.score_predictions(c, times).first() for c in (predict(model, known, times), predict(model, known, times).select("*")))
        assert (a.ci, a.ibs) == (b.ci, pytest.approx(b.ibs)) and 0 < a.ibs < 1
    with pytest.raises(PythonException):
        C.scored_facts(predict(models[0], df, [1]), times).collect()


def test_numbers_reach_numpy_without_pandas():
    """Loading pandas would add 47 MB to every worker."""
    code = """
import sys
import numpy as np, pyarrow as pa
from hazardloom.functions.curves import as_arrays, as_arrow, as_matrix, as_numpy, linear_fill, survival
from hazardloom.functions.dominance import bucket_counts, span_counts
x = as_arrow(np.arange(5.0))
assert as_numpy(x[1:4]).tolist() == [1, 2, 3] and as_numpy(x[:0]).tolist() == [] and as_numpy(pa.chunked_array([x, x[3:]])).tolist() == [0, 1, 2, 3, 4, 3, 4]
m = as_arrays(survival(linear_fill(1, [1, 2])(x)))
assert as_matrix(m[1:], 2).shape == (4, 2) and m.to_pylist()[1] == as_matrix(m[1:2], 2)[0].tolist()
assert as_arrays(np.array([[1, 2]])).to_pylist() == [[1, 2]] and as_arrays(np.zeros((0, 3))).to_pylist() == []
e, n = as_arrow(np.array([0, 1, 0, 0, 1], dtype=np.int32)), as_arrow(np.array([2, 1, 1, 2**40, 2**60]))
got = bucket_counts(pa.table({"d": x, "e": e, "p": x, "n": n})).to_pylist() + span_counts(pa.table({"d": x, "e": e, "b": e, "n": n})).to_pylist()
assert "pandas" not in sys.modules
pairs = 2 * (1 + 1 + 2**40 + 2**60) + 2**40 + 2**60 + 2**100
assert [{k: int(v) for k, v in r.items()} for r in got] == [{"concordant": pairs, "tied": 0}, {"pairs": pairs, "concordant": 2 * (1 + 2**60) + 2**60 + 2**100}]
missing = as_numpy(pa.array([1.5, None]))
assert missing[0] == 1.5 and np.isnan(missing[1])
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1])
