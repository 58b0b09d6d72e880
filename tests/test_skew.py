"""One device, or missing ids, own a third of all rows: same results, and the hot rows spread."""

import pytest
from pyspark.sql import functions as F

from hazardloom.operators import keyed as K
from hazardloom.operators import split as P
from hazardloom.operators import steps as S
from hazardloom.operators.prep import daily_rows

from conftest import rows


@pytest.fixture(scope="module")
def hot(spark):
    """9000 rows: a third belong to device 'hot' (all on two days), a tenth have no id, the rest to 300 devices."""
    return spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise((F.col("id") % 300).cast("string")).alias("serial_number"),
        F.expr("date_add(DATE'2024-01-01', CAST(CASE WHEN id % 3 = 0 THEN id % 2 ELSE id % 61 END AS INT))").alias("date"),
        F.col("id").alias("row_key"), F.when(F.col("id") % 4000 == 1, 1).otherwise(0).alias("failure"), F.rand(1).alias("smart_1"),
    ).persist()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(spark, hot, how):
    table = hot.where("serial_number IS NOT NULL").groupBy("serial_number").agg(F.max("row_key").alias("top")).where("top % 2 = 0 OR serial_number = 'hot'")
    plain = hot.join(table, "serial_number", how)
    salted = K.join_per_key(hot, table, "serial_number", how, rows_per_slot=100)
    columns = ["row_key", F.coalesce("top", F.lit(-1))] if "top" in plain.columns else ["row_key"]
    assert sorted(salted.columns) == sorted(plain.columns)
    assert rows(salted, *columns) == rows(plain, *columns)


def test_equal_copies_spread_too(spark):
    copies = spark.range(4000, numPartitions=8).select(F.when(F.col("id") < 3000, "hot").otherwise("cold").alias("serial_number"))
    table = copies.distinct().withColumn("x", F.lit(1))
    joined = K.join_per_key(copies, table, "serial_number", rows_per_slot=100)
    assert rows(joined.groupBy("serial_number").agg(F.sum("x").alias("n")), "serial_number", "n") == [("cold", 1000), ("hot", 3000)]
    plan = K.join_per_key(copies, table, "serial_number", rows_per_slot=100)._jdf.queryExecution().toString()
    assert "SPARK_PARTITION_ID()" in plan


def test_only_hot_keys_are_spread(hot):
    found = K.hot_keys(hot, "serial_number", 100).collect()
    assert [(r.serial_number, r._slots) for r in found] == [("hot", 30)]


@pytest.mark.parametrize("step", [S.relative_time, S.drop_multi_failure, lambda d: P.remove_truncated(d)[0]])
def test_steps_do_not_depend_on_the_way_of_joining(hot, step, monkeypatch):
    small = step(hot)
    want = rows(small, "row_key", *(["time"] if "time" in small.columns else []))
    monkeypatch.setattr(K, "lookup", lambda *a, **b: K.join_per_key(*a, **b, rows_per_slot=100))
    for module in (S, P):
        if hasattr(module, "lookup"):
            monkeypatch.setattr(module, "lookup", K.lookup)
    large = step(hot)
    assert rows(large, "row_key", *(["time"] if "time" in large.columns else [])) == want


def test_copies_shrink_before_the_shuffle(hot):
    plan = S.drop_duplicates(hot)._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("row_number(), 1, Partial")
    assert plan.index("row_number(), 1, Final") < plan.index("Exchange hashpartitioning(serial_number") < partial
    clean = daily_rows(hot.where("serial_number IS NOT NULL"))
    assert clean.where("serial_number = 'hot'").count() <= 2


def test_prep_windows_share_one_sort_and_shuffle(hot):
    chain = S.lifetime_label(S.label_shift(S.impute(daily_rows(hot))))
    plan = chain._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("SortAggregate")]  # everything above the removal of copies
    assert after.count("Sort [serial_number") == 1 and after.count("hashpartitioning(serial_number") == 1
