"""Collect, prepare, fit, save, load, continue, choose: the whole way on small files."""

import datetime as dt
import math

import pytest

from hazardloom.workflow import Workspace


def _write(folder, first, days, devices, with_extra):
    folder.mkdir()
    for d in range(days):
        date = first + dt.timedelta(d)
        extra = ",smart_9_raw" if with_extra(d) else ""
        lines = [f"date,serial_number,model,failure,smart_1_normalized,smart_5_raw{extra}"]
        for i in devices:
            life = 8 + i % 13
            if d > life:
                continue
            x = math.sin(i + d) + (3 if i % 2 else 0)
            lines.append(f"{date},S{i},M{i % 3},{int(d == life and i % 2 == 1)},7,{x}" + (f",{d}" if extra else ""))
        (folder / f"{date}.csv").write_text("\n".join(lines) + "\n")


def test_whole_way(spark, tmp_path):
    _write(tmp_path / "in", dt.date(2024, 1, 25), 24, range(80), lambda d: d > 2)
    _write(tmp_path / "more", dt.date(2024, 3, 1), 24, range(100, 130), lambda d: True)
    w = Workspace(spark, str(tmp_path / "work"))
    with pytest.raises(ValueError):
        w.preprocess()
    stored = w.collect_data([str(tmp_path / "in")], 500)
    n = stored.count()
    assert stored.groupBy("batchnum").count().where("count > 500").count() == 0
    assert w.rebatch(200).count() == n and w.storage.versions() == [0, 1]

    static, dynamic = w.data_stats(["data_size", "failure_rate"], ["mean_observ", "na_rate"], "monthly")
    assert static.first().n_rows == n and static.first().failure_rate == 50.0
    assert dynamic.count() == 2

    prepared = w.preprocess()
    assert {"smart_5_raw", "model_encoded", "season_January", "season_February", "max_lifetime"} <= set(prepared.columns)
    assert "smart_1_normalized" not in prepared.columns
    per_split = {r.split: r["count"] for r in prepared.select("serial_number", "split").distinct().groupBy("split").count().collect()}
    assert sum(per_split.values()) == 77  # three devices still run on the last day
    assert w.split.read().where("split = 'test'").count() == 16

    with pytest.raises(ValueError):
        w.fine_tune()
    first = w.fit("NN", hidden_dim=4, maxIter=5)
    second = w.fine_tune(max_iter=3)
    third = w.fit("logistic_regression")
    assert len({first, second, third}) == 3
    assert w.score_model().first().ci > 0.5
    assert w.save_best_model("ci") in {first, second, third}
    w.load_model()
    assert w.make_report().where("metric = 'CI_test'").count() == 3

    later = w.update_preprocessed([str(tmp_path / "more")], "march")
    assert {r.batch for r in later.select("batch").distinct().collect()} == {"initial", "march"}
    assert w.split.read().count() == 110
    w.load_model(third)
    w.fine_tune(max_iter=3)

    test_rows = later.where("split = 'test'").drop("split", "batch", "failure", "max_lifetime")
    w.predict(test_rows, str(tmp_path / "out"))
    wide = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert wide.columns == ["serial_number", "time", *[str(t) for t in range(1, 160)]] and wide.count() == test_rows.count()
