import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardloom.columns import STATIC_STATS
from hazardloom.operators import dynamics as D
from hazardloom.operators import stats as S
from hazardloom.operators.split import truncated_ids

from conftest import rows


@pytest.fixture(scope="module")
def fleet():
    """Seeded random panel of 100 devices with 3 to 9 rows; some fail on their last row."""
    rng = np.random.default_rng(42)
    out = []
    for device in range(1, 101):
        n = rng.integers(3, 10)
        days = sorted(rng.integers(0, 365, n))
        fails = rng.random() < 0.3
        for i, d in enumerate(days):
            out.append((device, dt.date(2020, 1, 1) + dt.timedelta(int(d)), int(fails and i == n - 1), rng.normal(100, 10), rng.normal(50, 5)))
    df = pd.DataFrame(out, columns=["serial_number", "date", "failure", "smart_1", "smart_2"])
    df.loc[rng.integers(0, len(df), 10), "smart_1"] = None
    return df


@pytest.fixture(scope="module")
def fleet_df(spark, fleet):
    data = [tuple(None if v != v else v for v in r) for r in fleet.itertuples(index=False, name=None)]
    return spark.createDataFrame(data, "serial_number bigint, date date, failure int, smart_1 double, smart_2 double")


def test_hand_computed(e1):
    r = S.static_stats(e1).first()
    assert (r.n_rows, r.n_columns) == (12, 4)
    assert (r.min_date, r.max_date) == (dt.date(2024, 1, 1), dt.date(2024, 1, 10))
    assert (r.mean_lifetime, r.max_lifetime) == (4.0, 5)
    assert (r.survival_rate, r.failure_rate, r.truncated_rate) == pytest.approx((60, 40, 20))
    assert r.double_failures == 1
    assert r.na_rate_smart_1 == pytest.approx(100 / 3)
    assert r.mean_time_between_observ == pytest.approx(23 / 7)
    assert r.mean_observ_per_day == pytest.approx(1.5)
    assert rows(S.durations(e1), "serial_number", "duration") == [("A", 5), ("C", 3)]
    assert rows(truncated_ids(e1), "serial_number") == [("B",)]


def test_against_pandas(fleet, fleet_df):
    r = S.static_stats(fleet_df).first()
    assert (r.n_rows, r.n_columns) == fleet.shape
    assert (r.min_date, r.max_date) == (fleet.date.min(), fleet.date.max())
    assert r.na_rate_smart_1 == pytest.approx(fleet.smart_1.isna().mean() * 100)
    dates = fleet.assign(date=pd.to_datetime(fleet.date))
    gaps = dates.groupby("serial_number").date.diff().dt.days
    assert r.mean_time_between_observ == pytest.approx(gaps.mean()) and r.mean_time_between_observ >= 0
    died = dates[dates.failure == 1].serial_number.unique()
    spans = dates[dates.serial_number.isin(died)].groupby("serial_number").date.agg(lambda d: (d.max() - d.min()).days)
    assert r.mean_lifetime == pytest.approx(spans.mean()) and r.max_lifetime == spans.max()
    assert r.mean_observ_per_day == pytest.approx(dates.groupby("date").size().mean())


def test_names_in_order_and_unknown(e1):
    assert S.static_stats(e1, ["max_date", "failure_rate", "min_date"]).columns == ["max_date", "failure_rate", "min_date"]
    for name in STATIC_STATS:
        assert S.static_stats(e1, [name]).count() == 1
    with pytest.raises(KeyError):
        S.static_stats(e1, ["nothing"])


def test_no_failures(e1):
    r = S.static_stats(e1.withColumn("failure", F.lit(0))).first()
    assert (r.survival_rate, r.failure_rate, r.mean_lifetime, r.max_lifetime) == (100.0, 0.0, None, None)


def test_empty_panel(e1):
    r = S.static_stats(e1.where("1 = 0")).first()
    assert r.n_rows == 0 and r.survival_rate is None and r.mean_time_between_observ is None


def test_rates_sum_to_100(fleet_df):
    for freq in ("daily", "monthly"):
        bad = D.survival_by_period(fleet_df, freq).where("abs(survival_rate + failure_rate - 100) > 1e-9")
        assert bad.count() == 0


def test_dynamic(e1):
    got = {r.period.day: r for r in D.dynamic_stats(e1, freq="daily").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 8, 10]
    assert (got[3].mean_lifetime, got[3].max_lifetime) == (1.0, 2)
    assert got[3].na_rate == 100.0 and got[2].mean_observ_per_day == 3
    assert got[10].survival_rate == 60.0 and got[4].failure_rate == 20.0
    month = D.dynamic_stats(e1, ["mean_observ", "survival_rate"], "monthly").collect()
    assert [tuple(r) for r in month] == [(dt.date(2024, 1, 1), 1.5, 60.0)]
    with pytest.raises(ValueError):
        D.dynamic_stats(e1, freq="yearly")


def test_elapsed_gap_counts_24_hour_periods(spark):
    ts = ["2024-01-01 23:00:00", "2024-01-03 01:00:00", "2024-01-03 02:00:00", "2024-01-09 01:59:59"]
    df = spark.createDataFrame([("a", t) for t in ts], "id string, t string").withColumn("t", F.to_timestamp("t"))
    assert S.mean_elapsed_gap(df, "id", "t").first()[0] == pytest.approx((1 + 0 + 5) / 3)


def test_the_panel_is_read_once(spark, fleet_df, tmp_path):
    fleet_df.write.parquet(str(tmp_path / "fleet"))
    stored = spark.read.parquet(str(tmp_path / "fleet"))
    plan = S.static_stats(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    whole = S.static_stats(stored).first()
    for name in STATIC_STATS:
        for column, value in S.static_stats(stored, [name]).first().asDict().items():
            assert value == whole[column], column


def test_statistics_of_missing_devices_and_days(spark):
    data = [("A", dt.date(2024, 1, 1), 0, 1.0), ("A", None, 0, None), (None, dt.date(2024, 1, 3), 1, None), (None, None, None, 2.0), ("B", dt.date(2024, 1, 1), 1, 3.0)]
    r = S.static_stats(spark.createDataFrame(data, "serial_number string, date date, failure int, smart_1 double")).first()
    assert (r.n_rows, r.min_date, r.max_date, r.mean_observ_per_day) == (5, dt.date(2024, 1, 1), dt.date(2024, 1, 3), 1.5)
    assert (r.na_rate_smart_1, r.na_rate_serial_number, r.na_rate_date) == (40.0, 40.0, 40.0) and r.survival_rate == 50.0
    empty = S.static_stats(spark.createDataFrame([], "serial_number string, date date, failure int")).first()
    assert empty.n_rows == 0 and empty.min_date is None and empty.double_failures == 0 and empty.truncated_rate is None
