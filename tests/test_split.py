import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from hazardloom.operators import split as P

from conftest import rows


def _panel(spark, n=500, start=0):
    """Two rows per device; every fifth fails; the first hundred are still running on the last day."""
    return spark.range(start, start + n).select(F.col("id").cast("string").alias("serial_number"), "id").selectExpr(
        "serial_number", "id", "explode(array(DATE'2024-01-01', CASE WHEN id < 100 THEN DATE'2024-02-01' ELSE DATE'2024-01-05' END)) AS date"
    ).withColumn("failure", ((F.col("id") % 5 == 0) & (F.col("date") > dt.date(2024, 1, 1))).cast("int"))


def test_exact_strata(spark):
    out = P.stratified_split(_panel(spark))
    sizes = rows(out.groupBy("label", "split").count(), "label", "split", "count")
    assert sizes == [(0, "test", 80), (0, "train", 320), (1, "test", 20), (1, "train", 80)]
    assert out.select("serial_number").distinct().count() == 500


def test_prefix_rank_is_the_hash_rank(spark):
    out = P.stratified_split(_panel(spark), 0.3, seed=7)
    from hazardloom.functions import hash_order

    got = {(r.label, r.h): r.split for r in out.withColumn("h", hash_order("serial_number", seed=7)).collect()}
    for label in (0, 1):
        hashes = sorted(h for k, h in got if k == label)
        cut = round(len(hashes) * 0.3)
        assert [got[label, h] for h in hashes] == ["test"] * cut + ["train"] * (len(hashes) - cut)


def test_other_seed_other_split(spark):
    a, b = (P.stratified_split(_panel(spark), seed=s).where("split = 'test'") for s in (1, 2))
    assert rows(a, "serial_number") != rows(b, "serial_number")


def test_truncated(spark):
    kept, ids = P.remove_truncated(_panel(spark))
    assert ids.count() == 80 and kept.select("serial_number").distinct().count() == 420
    assert P.truncated_ids(_panel(spark), dt.date(2024, 3, 1)).count() == 0


def test_update(spark):
    first = P.initial_split(_panel(spark)).persist()
    assert first.where("truncated").count() == 80
    loose = P.initial_split(_panel(spark), rm_truncated_from_test=False)
    assert loose.where("truncated AND split = 'test'").count() == 0
    # later rows: devices 0..49 went on and stopped, 1000..1099 are new and run to the end
    later = spark.range(1200).where("id < 50 OR id BETWEEN 1000 AND 1099").select(
        F.col("id").cast("string").alias("serial_number"),
        F.when(F.col("id") < 50, F.lit(dt.date(2024, 2, 10))).otherwise(F.lit(dt.date(2024, 3, 1))).alias("date"),
        F.lit(0).alias("failure"),
    )
    back = P.find_untruncated(later, first)
    assert rows(back.select(F.col("serial_number").cast("int").alias("i")), "i") == [(i,) for i in range(50) if i % 5]
    assert P.new_devices(later, first).count() == 100
    after = P.update_split(later, first).persist()
    assert after.count() == 600 and after.select("serial_number").distinct().count() == 600
    assert after.where("truncated").count() == 40 + 100
    moved = first.join(after.withColumnRenamed("split", "now").drop("truncated"), "serial_number").where("split <> now")
    assert moved.count() == 0
    again = P.update_split(later, after)
    assert rows(again, "serial_number", "split", "truncated") == rows(after, "serial_number", "split", "truncated")


@pytest.mark.parametrize("ranked", [50_000, 20, 1])
def test_radix_selection_is_the_full_sort(spark, monkeypatch, ranked):
    monkeypatch.setattr(P, "RANKED", ranked)
    facts = spark.range(500).select(F.col("id").cast("string").alias("serial_number"), F.when(F.col("id") % 9 == 0, 1).when(F.col("id") == 7, 2).otherwise(0).alias("label"))
    for share in (0.0, 0.2, 0.37, 1.0):
        got = {r.serial_number: (r.label, r.split) for r in P.stratify(facts, share).collect()}
        for label in (0, 1, 2):
            ids = sorted((i for i, (l, _) in got.items() if l == label), key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())
            cut = int(len(ids) * share + 0.5)
            assert [got[i][1] for i in ids] == ["test"] * cut + ["train"] * (len(ids) - cut)
