import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazardloom.sources import batches as B
from hazardloom.sources import csv_files as V
from hazardloom.sources import prepared as W

from conftest import rows

DRIVES = "date,model,smart_1\n2013-04-10,Drive one,3000\n2013-04-10,Drive two,2000\n"


@pytest.fixture
def two_sources(tmp_path):
    for i in (1, 2):
        (tmp_path / f"source{i}").mkdir()
        (tmp_path / f"source{i}" / "data.csv").write_text(DRIVES)
        (tmp_path / f"source{i}" / "notes.txt").write_text("not a table")
    (tmp_path / "source1" / "deeper").mkdir()
    (tmp_path / "source1" / "deeper" / "data.csv").write_text(DRIVES)
    return [str(tmp_path / "source1"), str(tmp_path / "source2")], str(tmp_path / "storage")


def test_scan_is_flat_and_only_csv(spark, two_sources):
    assert [f.rsplit("/", 2)[1:] for f in V.list_csv(spark, two_sources[0])] == [["source1", "data.csv"], ["source2", "data.csv"]]


def test_collect(spark, two_sources):
    paths, storage = two_sources
    stored = V.collect(spark, paths, storage, 3)
    assert stored.count() == 4  # equal file names do not overwrite each other
    assert rows(B.manifest(stored), "batchnum", "n_rows", "min_date") == [(0, 3, dt.date(2013, 4, 10)), (1, 1, dt.date(2013, 4, 10))]
    assert rows(stored.select("season").distinct(), "season") == [("April",)]
    assert stored.select("row_key").distinct().count() == 4
    again = B.write_batches(stored.drop("batchnum"), storage + "2", 2)
    assert rows(B.manifest(again), "n_rows") == [(2,), (2,)]


def test_storage_must_not_be_a_source(spark, two_sources):
    with pytest.raises(ValueError):
        V.collect(spark, two_sources[0], two_sources[0][0])


def test_union_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,serial_number,smart_1\n2024-01-01,A,1\n2024-01-02,A,NaN\n")
    (tmp_path / "b.csv").write_text("date,smart_1,smart_2,serial_number\n2024-01-03 10:20:30,5,6,B\n2024-01-04,oops,,B\n")
    df = V.read_csv(spark, [str(tmp_path)])
    got = {r.date.day: (r.serial_number, r.smart_1, r.smart_2) for r in df.collect()}
    assert got == {1: ("A", 1.0, None), 2: ("A", None, None), 3: ("B", 5.0, 6.0), 4: ("B", 0.0, None)}


def test_many_small_files_of_several_layouts(spark, tmp_path):
    want = set()
    for i in range(300):
        layout = [["date", "serial_number", "smart_1"], ["smart_1", "serial_number", "date", "odd"], ["serial_number", "date"]][i % 3]
        value = {"date": f"2024-01-{1 + i % 28:02d}", "serial_number": f'"a,{i}"', "smart_1": str(i), "odd": "q"}
        lines = [",".join(layout)] + [",".join(value[c] for c in layout)] * 2 + [""]
        (tmp_path / f"{i}.csv").write_text("\r\n".join(lines) + ("\n" if i % 2 else ""))
        want.add((f"a,{i}", 1 + i % 28, float(i) if i % 3 < 2 else None, "q" if i % 3 == 1 else None))
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("date,smart_1\n")
    df = V.read_csv(spark, [str(tmp_path)])
    got = df.collect()
    assert len(got) == 600 and {(r.serial_number, r.date.day, r.smart_1, r.odd) for r in got} == want
    assert V.header_names("a,,a,b") == ["a0", "_c1", "a2", "b"]
    with pytest.raises(FileNotFoundError):
        V.read_csv(spark, [str(tmp_path / "empty.csv")])


def test_batches_go_to_tasks_of_their_own(spark):
    df = spark.range(1000).select(F.lit(dt.date(2024, 1, 1)).alias("date"), F.col("id").cast("string").alias("serial_number"), F.col("id").alias("row_key"))
    placed = B.arranged(df, 100).withColumn("task", F.spark_partition_id())
    assert rows(placed.groupBy("batchnum").agg(F.min("task").alias("a"), F.max("task").alias("b"), F.count("*").alias("n")), "batchnum", "a", "b", "n") == [
        (i, i, i, 100) for i in range(10)]


def test_small_batches_share_tasks(spark, tmp_path, monkeypatch):
    df = spark.range(300).select(F.lit(dt.date(2024, 1, 1)).alias("date"), F.col("id").cast("string").alias("serial_number"), F.col("id").alias("row_key"))
    monkeypatch.setattr(B, "TASKS", 7, raising=False)
    assert B.arranged(df, 10).rdd.getNumPartitions() == 7
    stored = B.write_batches(df, str(tmp_path / "storage"), 10)
    assert rows(B.manifest(stored), "batchnum", "n_rows") == [(i, 10) for i in range(30)]
    assert len(list((tmp_path / "storage").glob("batchnum=*"))) == len(list((tmp_path / "storage").glob("batchnum=*/*.parquet"))) == 30


def test_a_failed_write_leaves_the_old_batch(spark, tmp_path):
    base = spark.createDataFrame([("A", 0, 1, 0.5, 2), ("A", 2, 1, 0.7, 2)], "serial_number string, time int, failure int, x double, max_lifetime int")
    path = str(tmp_path / "prepared")
    W.write_split(base, base, path, "007")
    before = sorted(map(tuple, W.read_split(spark, path).collect()))
    with pytest.raises(Exception):
        W.write_split(base.withColumn("x", F.raise_error(F.lit("lost")).cast("double")), base, path, "007")
    assert sorted(map(tuple, W.read_split(spark, path).collect())) == before and {r[-1] for r in before} == {"007"}
    own = W.read_split(spark, path, "train")  # rows of the store itself
    W.write_split(own.withColumn("x", F.col("x") * 2), own.limit(0), path, "007")
    assert rows(W.read_split(spark, path), "x", "split") == [(1.0, "train"), (1.4, "train")]
    assert W.vacuum(spark, path) == 1 and W.read_split(spark, path).count() == 2
    W.write_split(base.withColumn("y", F.lit(1)), base.limit(0).withColumn("y", F.lit(1)), path, "new")
    assert W.read_split(spark, path).columns[-3:] == ["y", "split", "batch"] and W.read_split(spark, path).count() == 4
    assert W.write_split(base, base.limit(0), path, "only", replace_all=True).count() == 2


def test_rebatch_is_a_global_order(spark):
    df = spark.range(1003).select(
        F.expr("date_add(DATE'2024-01-01', CAST(hash(id) % 3 AS INT))").alias("date"), F.hash("id").cast("string").alias("serial_number"),
        F.col("id").alias("row_key"),
    ).repartition(7)
    out = B.rebatch(df, 100)
    sizes = rows(out.groupBy("batchnum").count(), "batchnum", "count")
    assert sizes == [(i, 100) for i in range(10)] + [(10, 3)]
    want = sorted((r.date, r.serial_number, r.row_key) for r in df.collect())
    got = {r.row_key: r.batchnum for r in out.collect()}
    assert [got[k] for _, _, k in want] == [i // 100 for i in range(1003)]


def test_store_and_readers(spark, tmp_path):
    rows_ = spark.createDataFrame(
        [("A", 0, 1, 0.5, 2), ("A", 2, 1, 0.7, 2), ("B", 0, 0, 0.1, 0)], "serial_number string, time int, failure int, x double, max_lifetime int"
    )
    path = str(tmp_path / "prepared")
    W.write_split(rows_, rows_.where("serial_number = 'B'"), path, rows_per_file=1)
    W.write_split(rows_.limit(1), rows_.limit(0), path, "later")
    W.write_split(rows_.limit(1), rows_.limit(0), path, "later")  # a repeated update replaces its own rows only
    assert W.read_split(spark, path).count() == 5
    assert W.read_split(spark, path, "test").count() == 1
    assert "PartitionFilters: [isnotnull(split" in W.read_split(spark, path, "test")._jdf.queryExecution().toString()
    assert rows(W.read_examples(rows_, "train"), "serial_number", "time", "time_to_event") == [("A", 0, 2)]
    assert rows(W.read_examples(rows_, "score"), "serial_number", "duration", "failure") == [("A", 2, True)]
    assert W.read_examples(rows_, "infer").columns == ["serial_number", "time", "x"]
    with pytest.raises(ValueError):
        W.read_examples(rows_, "other")
