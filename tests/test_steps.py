import pytest
from pyspark.sql import functions as F

from hazardloom.functions import month_name
from hazardloom.operators import encoders as E
from hazardloom.operators import hazard as H
from hazardloom.operators import steps as S
from hazardloom.operators.prep import FittedPrep, PanelPrep, daily_rows

from conftest import rows


@pytest.fixture(scope="module")
def clean(e1):
    return daily_rows(e1)


def test_time_doubles_duplicates(clean):
    assert rows(clean, "serial_number", "time") == [
        ("A", 0), ("A", 2), ("A", 5), ("B", 0), ("B", 9), ("D", 0), ("E", 0), ("E", 6)
    ]


def test_steps_one_by_one_agree(e1, clean):
    other = S.drop_duplicates(S.drop_multi_failure(S.relative_time(e1)).drop("date"), ["serial_number", "time"])
    assert rows(other, "serial_number", "time", F.coalesce("smart_1", F.lit(-1.0))) == rows(
        clean, "serial_number", "time", F.coalesce("smart_1", F.lit(-1.0))
    )


def test_impute(clean):
    filled = S.impute(clean)
    assert rows(filled, "serial_number", "time", "smart_1") == [
        ("A", 0, 10.0), ("A", 2, 30.0), ("A", 5, 30.0), ("B", 0, 7.0), ("B", 9, 7.0), ("D", 0, 0.0), ("E", 0, 4.0), ("E", 6, 0.0)
    ]
    forward = S.impute(clean, fill={"smart_1": -1.5}, method="ffill")
    assert rows(forward, "serial_number", "time", "smart_1")[:5] == [
        ("A", 0, 10.0), ("A", 2, 10.0), ("A", 5, 30.0), ("B", 0, -1.5), ("B", 9, 7.0)
    ]


def test_label_shift_lifetime_reader(clean):
    out = S.lifetime_label(S.label_shift(S.impute(clean)))
    assert rows(out, "serial_number", "time", "failure", "max_lifetime") == [
        ("A", 0, 1, 2), ("A", 2, 1, 2), ("B", 0, 0, 0), ("E", 0, 0, 0)
    ]
    assert rows(H.training_rows(out), "serial_number", "time", "time_to_event", "failure") == [("A", 0, 2, 1)]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([("A", 0, float("nan")), ("A", 1, 2.0), ("A", 2, float("nan"))], "serial_number string, time int, smart_1 double")
    assert rows(S.impute(df), "time", "smart_1") == [(0, 2.0), (1, 2.0), (2, 0.0)]
    assert S.null_counts(df).first().smart_1 == 2
    marked = S.mark_nulls(df, ["serial_number", "time", "smart_1"])
    assert tuple(marked.agg(*S.marked_null_counts(["serial_number", "time", "smart_1"])).first()) == (0, 0, 2)


def test_marks_of_many_columns(spark):
    names = [f"smart_{i}" for i in range(130)]
    df = spark.range(20).select(*[F.when(F.col("id") % 20 < i % 20, F.lit(1.0)).alias(n) for i, n in enumerate(names)])
    got = S.mark_nulls(df, names).agg(*S.marked_null_counts(names)).first()
    assert [got[n] for n in names] == [20 - i % 20 for i in range(130)]


def test_coercion(spark):
    df = spark.createDataFrame([(1, "3.5"), (2, "x"), (3, None), (4, "NaN")], "k int, smart_1 string")
    assert rows(S.coerce_measures(df), "k", "smart_1") == [(1, 3.5), (2, 0.0), (3, 0.0), (4, 0.0)]


def test_filter_bound_is_strict(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (None, None, 1.0)], "smart_1 double, smart_2 double, smart_1_normalized double")
    assert S.columns_to_drop(df) == ["smart_2", "smart_1_normalized"]  # half missing is still allowed


def test_sample_keeps_edges(spark):
    df = spark.range(400).select((F.col("id") % 4).cast("string").alias("serial_number"), F.floor(F.col("id") / 4).cast("int").alias("time"))
    out = S.panel_sample(df, 10)
    per = out.groupBy("serial_number").agg(F.count("*").alias("n"), F.min("time").alias("a"), F.max("time").alias("b"))
    assert rows(per, "n", "a", "b") == [(11, 0, 99)] * 4
    assert rows(S.panel_sample(df.repartition(3), 10), "serial_number", "time") == rows(out, "serial_number", "time")


def test_target_encoding_formula(spark):
    data = [("a", 1)] * 3 + [("a", 0)] + [("b", 0)] * 4
    df = spark.createDataFrame(data, "model string, failure int")
    table, mean = E.target_encoding(df)
    v, n, s2 = 3 / 8 * 5 / 8, 4, 3 / 4 * 1 / 4
    w = v * n / (v * n + s2)
    assert mean == 0.375
    assert dict(rows(table, "model", "model_encoded")) == pytest.approx({"a": w * 0.75 + (1 - w) * mean, "b": 0.0})
    seen = E.target_encode(spark.createDataFrame([("a",), ("zz",), (None,)], "model string"), table, mean)
    assert sorted(r.model_encoded for r in seen.collect())[:2] == [0.375, 0.375]
    marked = E.known_category(spark.createDataFrame([("a",), ("zz",)], "model string"), table)
    assert rows(marked, "model") == [("UNKNOWN",), ("a",)]


@pytest.fixture(scope="module")
def raw(spark):
    """Forty devices, thirty days, two models; odd devices fail."""
    df = spark.range(1200).select(
        (F.col("id") % 40).cast("string").alias("serial_number"), F.expr("date_add(DATE'2024-01-20', CAST(id DIV 40 AS INT))").alias("date"),
        F.col("id").alias("row_key"), F.when(F.col("id") % 3 == 0, "m1").otherwise("m2").alias("model"),
        ((F.col("id") % 2 == 1) & (F.col("id") >= 1160)).cast("int").alias("failure"),
        F.when(F.col("id") % 5 != 0, F.sin("id") * 10).alias("smart_5_raw"), F.lit(3.0).alias("smart_9_raw"),
        F.when(F.col("id") % 3 == 0, 1.0).alias("smart_7_raw"), F.lit(1.0).alias("smart_9_normalized"),
    )
    return df.withColumn("season", month_name("date"))


def test_fit_transform(spark, raw, tmp_path):
    fitted = PanelPrep().fit(raw)
    assert fitted.measures == ["smart_5_raw", "smart_9_raw"]
    assert fitted.seasons == ["February", "January"]
    train = fitted.transform(raw, train=True)
    assert train.columns == ["serial_number", "time", "failure", "smart_5_raw", "smart_9_raw", "model_encoded", "season_February",
                             "season_January", "max_lifetime"]
    assert train.count() == 40 * 10  # 11 sampled rows, the last one gone
    assert rows(train.groupBy("failure").agg(F.countDistinct("serial_number").alias("n")), "failure", "n") == [(0, 20), (1, 20)]
    full = fitted.transform(raw)
    assert full.count() == 40 * 29
    assert full.agg(F.max(F.abs("smart_9_raw"))).first()[0] == 0.0  # constant column: divided by 1
    assert rows(fitted.transform(raw.repartition(5)), "serial_number", "time", "smart_5_raw") == rows(full, "serial_number", "time", "smart_5_raw")

    fitted.save(str(tmp_path / "prep"))
    again = FittedPrep.load(spark, str(tmp_path / "prep"))
    assert rows(again.transform(raw), *full.columns) == rows(full, *full.columns)


def test_transform_without_label_and_with_missing_column(raw):
    fitted = PanelPrep().fit(raw)
    out = fitted.transform(raw.drop("failure", "smart_5_raw"))
    assert "failure" not in out.columns and out.count() == 1200
    assert out.select("smart_5_raw").distinct().count() == 1


def test_ten_thousand_categories_as_a_sparse_vector(spark, tmp_path):
    n = 10_000
    rows_ = spark.range(3 * n).select(
        (F.col("id") % 3000).cast("string").alias("serial_number"), F.expr("date_add(DATE'2024-01-01', CAST(id DIV 3000 AS INT))").alias("date"),
        F.col("id").alias("row_key"), F.lit("m").alias("model"), F.format_string("s%05d", F.pmod(F.hash("id"), F.lit(n))).alias("season"),
        (F.col("id") == 3 * n - 1).cast("int").alias("failure"), F.sin("id").alias("smart_1_raw"),
    )
    fitted, train = PanelPrep(season_vector=True).fit_transform(rows_)
    fitted.save(str(tmp_path / "prep"))
    again = FittedPrep.load(spark, str(tmp_path / "prep"))
    unseen = rows_.withColumn("season", F.when(F.col("row_key") % 2 == 0, F.col("season")).when(F.col("row_key") % 3 == 0, "new"))
    got = again.transform(unseen).select("serial_number", "time", "season_vector").collect()
    counts = {r.season: r["count"] for r in rows_.groupBy("season").count().collect()}
    names, season = sorted(counts), {r.row_key: r.season for r in rows_.collect()}
    assert len(names) > 9_000 and {r.season_vector.size for r in got} == {len(names)}
    for r in got[:200]:
        key = int(r.serial_number) + 3000 * r.time
        if key % 2:
            assert r.season_vector.numNonzeros() == 0
        else:
            share = counts[season[key]] / (3 * n)
            assert dict(zip(r.season_vector.indices.tolist(), r.season_vector.values)) == pytest.approx(
                {names.index(season[key]): 1 / (share * (1 - share)) ** 0.5})
    model = H.fit(train, maxIter=2)
    assert model.features[-1] == "season_vector" and len(model.linear[0]) == len(names) + 3
    curves = H.predict(model, again.transform(unseen).limit(3), [1, 2], mode="infer").collect()
    assert len(curves) == 3 and all(0 < s <= 1 for r in curves for s in r.surv)
