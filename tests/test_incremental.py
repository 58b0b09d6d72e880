import datetime as dt

from pyspark.sql import functions as F

from hazardloom.columns import PANEL
from hazardloom.functions import month_name
from hazardloom.operators.prep import PanelPrep
from hazardloom.operators.split import initial_split, split_rows
from hazardloom.streaming import incremental as I

from conftest import rows


def _panel(spark, ids, first, days):
    """Daily rows; the first half of the devices stop one day early."""
    return spark.range(ids[0], ids[1]).select(F.col("id").cast("string").alias("serial_number"), F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("d"), "id").where(
        (F.col("d") < days - 1) | (F.col("id") >= (ids[0] + ids[1]) / 2)
    ).select(
        "serial_number", F.date_add(F.lit(first), F.col("d")).alias("date"), (F.col("id") * 1000 + F.col("d")).alias("row_key"),
        F.when(F.col("id") % 2 == 0, "m1").otherwise("m2").alias("model"), F.lit(0).alias("failure"), (F.col("d") * 1.0).alias("smart_1_raw"),
    ).withColumn("season", month_name("date"))


def test_lifetimes_keep_the_largest(spark):
    a = spark.createDataFrame([("x", 5), ("y", 3)], "serial_number string, max_lifetime int")
    b = spark.createDataFrame([("y", 9), ("x", 2), ("z", 1)], "serial_number string, max_lifetime int")
    assert rows(I.update_lifetimes(a, b), "serial_number", "max_lifetime") == [("x", 5), ("y", 9), ("z", 1)]


def test_versions_of_the_split(spark, tmp_path):
    state = I.StateFolder(spark, str(tmp_path / "split"))
    assert state.read() is None
    first = I.advance_split(_panel(spark, (0, 40), dt.date(2024, 1, 1), 10), state)
    assert first.where("truncated").count() == 20
    second = I.advance_split(_panel(spark, (20, 60), dt.date(2024, 1, 11), 10), state)
    assert state.versions() == [0, 1] and second.count() == 60
    assert second.where("truncated").count() == 20


def test_stream_of_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    one, two = _panel(spark, (0, 40), dt.date(2024, 1, 1), 10), _panel(spark, (20, 60), dt.date(2024, 1, 11), 12)
    split, life = I.StateFolder(spark, str(tmp_path / "split")), I.StateFolder(spark, str(tmp_path / "life"))
    for batch in (one, two):
        batch.coalesce(1).write.mode("append").parquet(source)
        query = I.follow(spark, source, batch.schema, split, life, str(tmp_path / "check"))
        query.awaitTermination(120)
        assert not query.isActive
    assert split.read().count() == 60 and life.versions() == [0, 1]
    top = {r.serial_number: r.max_lifetime for r in life.read().collect()}
    assert (top["0"], top["30"], top["59"]) == (8, 10, 11)


def test_update_prepared_reuses_the_fit(spark, tmp_path):
    one, two = _panel(spark, (0, 40), dt.date(2024, 1, 1), 10), _panel(spark, (40, 60), dt.date(2024, 2, 1), 10)
    state = initial_split(one)
    fitted = PanelPrep().fit(split_rows(one, state.where("split = 'train'")))
    path = str(tmp_path / "prepared")
    live = state.select(PANEL.id, "split", F.lit(False).alias("truncated"))
    I.update_prepared(one, fitted, live, path, "first")
    later = initial_split(two, rm_truncated_from_test=False).select(PANEL.id, "split", F.lit(False).alias("truncated"))
    stored = I.update_prepared(two, fitted, later, path, "second")
    assert rows(stored.select("batch").distinct(), "batch") == [("first",), ("second",)]
    # February was not there at fit time
    assert "season_February" not in stored.columns
    assert stored.where("batch = 'second'").agg(F.max("season_January") - F.min("season_January")).first()[0] == 0
