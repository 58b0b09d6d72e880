import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hazardloom.operators import hazard as H
from hazardloom.operators import scoring as C
from hazardloom.operators.trainer import Network
from hazardloom.sources import registry as R

TIMES = [1, 2, 5, 9]


@pytest.fixture(scope="module")
def prepared(spark):
    """Devices with ten rows; large x means failing."""
    return spark.range(2000).selectExpr(
        "CAST(id DIV 10 AS STRING) AS serial_number", "CAST(id % 10 AS INT) AS time",
        "CASE WHEN hash(id DIV 10) % 3 = 0 THEN 1 ELSE 0 END AS failure", "9 AS max_lifetime",
    ).withColumn("x", F.col("failure") * 1.5 + F.sin(F.col("time") * 3.0 + F.hash("serial_number") % 7)).withColumn("y", F.cos("time"))


@pytest.fixture(scope="module")
def lr(prepared):
    return H.fit(prepared)


def grid(model, df):
    """Hazards by the library's own scoring of every (row, t)."""
    long = df.select("serial_number", "time", *model.features, F.explode(F.array(*[F.lit(float(t)) for t in TIMES])).alias("t"))
    long = long.withColumn(H.TIME_INPUT, F.col("t") / model.time_unit)
    scored = model.fitted.transform(H.assemble(long, [*model.features, H.TIME_INPUT]))
    return {(r[0], r[1], r[2]): r[3] for r in scored.select("serial_number", "time", "t", vector_to_array("probability")[1]).collect()}


def check_grid(model, df):
    want = grid(model, df)
    for r in H.predict_hazard(model, df, TIMES).collect():
        assert r.hazards == pytest.approx([want[r.serial_number, r.time, float(t)] for t in TIMES], abs=1e-9)


def test_features_leave_out_label_and_keys(prepared, lr):
    assert lr.features == ["x", "y"]


def test_linear_hazards_match_the_classifier(prepared, lr):
    check_grid(lr, prepared.limit(20))
    assert lr.loss[-1] < lr.loss[0]


def test_network_hazards_match_the_classifier(prepared):
    model = H.fit(prepared, "NN", hidden_dim=5, maxIter=15)
    assert model.fitted.getLayers() == [3, 5, 5, 2] and model.time_unit == 159
    check_grid(model, prepared.limit(20))


def test_other_estimator(prepared):
    model = H.fit(prepared, RandomForestClassifier(numTrees=3, maxDepth=3, seed=1))
    check_grid(model, prepared.limit(10).persist())


def test_other_estimator_keeps_every_row(spark, prepared, tmp_path):
    model = H.fit(prepared, DecisionTreeClassifier(maxDepth=2, seed=1))
    odd = prepared.limit(4).union(prepared.limit(2)).union(prepared.limit(1).withColumn("serial_number", F.lit(None))).repartition(3)
    assert H.predict_hazard(model, odd, TIMES).count() == 7
    model.save(str(tmp_path / "tree"))
    again = H.HazardModel.load(spark, str(tmp_path / "tree"))
    assert sorted(map(str, H.predict_hazard(again, odd, TIMES).collect())) == sorted(map(str, H.predict_hazard(model, odd, TIMES).collect()))


def test_named_parameters_of_a_fit(prepared):
    model = H.fit(prepared, "NN", epochs=2, lr=0.01, hidden_dim=3)
    assert model.fitted.sizes == [3, 3, 3, 1] and len(model.loss) == 2
    other = H.fit(prepared, "NN", epochs=2, lr=0.05, hidden_dim=3)
    assert other.loss[1] != model.loss[1] and H.fit(prepared, "NN", epochs=2, lr=0.01, hidden_dim=3).loss == model.loss
    with pytest.raises(TypeError):
        H.fit(prepared, "NN", epochs=2, dept=3)


def plain_hazards(net, x):
    for i, (w, b) in enumerate(net.layers()):
        x = x @ w + b
        x = np.maximum(x, 0) if i + 1 < len(net.layers()) else x
    return 1 / (1 + np.exp(-x[:, 0]))


def test_trained_network_hazards(prepared):
    model = H.fit(prepared, "NN", epochs=3, lr=0.02, hidden_dim=4, batches=2)
    assert model.loss[-1] < model.loss[0]
    for r in H.predict_hazard(model, prepared.limit(20), TIMES).collect():
        want = plain_hazards(model.fitted, np.array([[r.x, r.y, t / 159] for t in TIMES]))
        assert r.hazards == pytest.approx(want.tolist(), abs=1e-12)


@pytest.mark.parametrize("hidden", [None, 3])
def test_gradients_equal_finite_differences(hidden):
    r = np.random.default_rng(4)
    net = Network.new(4, hidden, seed=1)
    net.theta = net.theta + 0.1 * r.standard_normal(len(net.theta))
    x, y = r.standard_normal((50, 4)), r.integers(0, 2, 50).astype(float)
    loss, gradient = net.sums(x, y)
    for i in range(len(net.theta)):
        ends = []
        for d in (1e-6, -1e-6):
            net.theta[i] += d
            ends.append(net.sums(x, y)[0])
            net.theta[i] -= d
        assert gradient[i] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-4)
    if hidden is None:
        net.theta[0] += 1e-6
        assert net.curvature(x).reshape(5, 5)[0] == pytest.approx((net.sums(x, y)[1] - gradient) / 1e-6, abs=1e-2)


@pytest.mark.parametrize("name, solver", [("NN", "adam"), ("logistic_regression", "sgd"), ("logistic_regression", "adam")])
def test_two_fits_are_one(spark, prepared, tmp_path, name, solver):
    settings = {"solver": solver, "lr": 0.02, "batches": 3, **({"hidden_dim": 4} if name == "NN" else {})}
    whole = H.fit(prepared, name, epochs=4, **settings)
    half = H.fit(prepared, name, epochs=2, **settings)
    half.save(str(tmp_path / "half"))
    rest = H.fine_tune(H.HazardModel.load(spark, str(tmp_path / "half")), prepared, epochs=2)
    assert rest.fitted.theta.tolist() == whole.fitted.theta.tolist() and half.loss + rest.loss == whole.loss
    assert rest.fitted.steps == whole.fitted.steps == 12 and half.fitted.steps == 6


def test_newton_finds_the_penalised_optimum(prepared, lr):
    model = H.fit(prepared, solver="newton", epochs=30, time_unit=1.0)
    assert model.linear[0] == pytest.approx(lr.linear[0], abs=1e-3) and model.loss[-1] == pytest.approx(lr.loss[-1], abs=1e-6)
    rows = [(r.x, r.y, 9.0 - r.time, float(r.failure)) for r in prepared.collect() if r.time != 9]
    x = np.array(rows)
    w, b = model.linear
    p = 1 / (1 + np.exp(-(x[:, :3] @ w + b)))
    assert x[:, :3].T @ (p - x[:, 3]) / len(x) + 1e-4 * w == pytest.approx(np.zeros(3), abs=1e-6)


def test_a_converged_regression_stays(prepared, lr):
    more = H.fine_tune(lr, prepared, epochs=5)
    assert more.linear[0] == pytest.approx(lr.linear[0], abs=1e-3) and more.fitted.l2 == 1e-4


def test_missing_values_are_an_error(spark, prepared):
    broken = prepared.withColumn("x", F.when(F.col("time") != 3, F.col("x")))
    with pytest.raises(Exception, match="not finite"):
        H.fit(broken, "NN", epochs=1, hidden_dim=2)


def test_predict_modes(prepared, lr):
    scored = H.predict(lr, prepared, TIMES)
    assert scored.columns == ["serial_number", "time", "duration", "failure", "surv"] and scored.count() == 1800
    assert scored.where("duration <> 9 - time").count() == 0
    infer = H.predict(lr, prepared.drop("failure", "max_lifetime"), TIMES, mode="infer")
    assert infer.columns == ["serial_number", "time", "surv"] and infer.count() == 2000
    assert H.wide(infer, TIMES).columns == ["serial_number", "time", "1", "2", "5", "9"]


def test_fine_tune_continues(prepared, lr):
    short = H.fit(prepared, maxIter=1, regParam=0.0)
    tuned = H.fine_tune(short, prepared, max_iter=50)
    assert tuned.linear is not None and tuned.loss[-1] < tuned.loss[0]
    exact = H.fit(prepared, regParam=0.0)
    more = H.fine_tune(exact, prepared, max_iter=5)
    assert more.loss[0] == pytest.approx(exact.loss[-1], abs=1e-6)
    assert more.linear[0] == pytest.approx(exact.linear[0], abs=0.05)
    net = H.fit(prepared, "NN", hidden_dim=4, maxIter=5)
    assert H.fine_tune(net, prepared, max_iter=5).loss[0] == pytest.approx(net.loss[-1], abs=1e-6)


def test_better_than_chance(prepared, lr):
    r = C.score(lr, prepared, TIMES).first()
    assert 0.5 < r.ci <= 1 and 0 <= r.ibs < 1


def test_unknown_name(prepared):
    with pytest.raises(ValueError):
        H.fit(prepared, "trees")


def test_versions(spark, prepared, lr, tmp_path):
    root = str(tmp_path / "vault")
    version = R.save_version(spark, root, lr, "logistic_regression", C.score(lr, prepared, TIMES))
    R.append_version(spark, root, "other", 0.01, 0.9)
    assert R.read_versions(spark, root).count() == 2
    assert R.save_best(spark, root, "ci") == version and R.save_best(spark, root, "ibs") == version
    again = R.load_version(spark, root)
    assert again.features == lr.features and np.allclose(again.linear[0], lr.linear[0])
    metrics = {r.metric for r in R.model_stats(spark, root).collect()}
    assert metrics == {"CI_test", "IBS_test", "fit_time", "loss"}


def test_continued_versions_have_one_history(spark, prepared, tmp_path):
    root, model = str(tmp_path / "vault"), H.fit(prepared, solver="sgd", lr=0.1, epochs=2, batches=1)
    scores = C.score(model, prepared, TIMES)
    versions = [R.save_version(spark, root, model, "first", scores)]
    R.save_version(spark, root, H.fit(prepared, solver="sgd", lr=0.1, epochs=1, batches=1), "unrelated", scores)
    losses = list(model.loss)
    for epochs in (1, 3):
        model = H.fine_tune(R.load_version(spark, root, versions[-1]), prepared, epochs=epochs)
        losses += model.loss
        versions.append(R.save_version(spark, root, model, "more", scores))
    got = sorted(map(tuple, R.history(spark, root, versions[-1]).select("metric", "step", "value").collect()))
    assert [v for m, _, v in got if m == "loss"] == losses and [s for m, s, _ in got if m == "loss"] == list(range(6))
    assert [s for m, s, _ in got if m == "CI_test"] == [0, 1, 2] and [s for m, s, _ in got if m == "fit_time"] == list(range(6))
    assert {r.version for r in R.history(spark, root, versions[1]).collect()} == set(versions[:2])


def test_best_rule(spark):
    table = spark.createDataFrame([("1", 0.6, 0.20), ("2", 0.7, 0.25)], "id string, ci double, ibs double").withColumn("timestamp", F.current_timestamp())
    assert R.best(table, "ci").first().id == "2" and R.best(table, "ibs").first().id == "1"
    with pytest.raises(ValueError):
        R.best(table, "loss")
