import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hazardloom.session import local_session  # noqa: E402

# id, day of January 2024, failure, measure
E1 = [
    ("A", 1, 0, 10.0), ("A", 3, 0, None), ("A", 6, 1, 30.0), ("B", 1, 0, None), ("B", 10, 0, 7.0), ("C", 2, 0, 1.0),
    ("C", 4, 1, 2.0), ("C", 5, 1, 3.0), ("D", 3, 0, None), ("E", 2, 0, 4.0), ("E", 2, 0, 5.0), ("E", 8, 0, None),
]


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


@pytest.fixture(scope="session")
def e1(spark):
    rows = [(i, dt.date(2024, 1, d), f, x) for i, d, f, x in E1]
    return spark.createDataFrame(rows, "serial_number string, date date, failure int, smart_1 double")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
