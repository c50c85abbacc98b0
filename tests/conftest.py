import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import session  # noqa: E402

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def telemetry(spark):
    """600 rows at 10 Hz."""
    rows = [
        (i, START + dt.timedelta(milliseconds=100 * i), float(i), None if i % 100 == 50 else 20.0 + i % 10, 2 * i, i % 2 == 0, "a")
        for i in range(600)
    ]
    schema = "pos bigint, time timestamp_ntz, speed double, temp double, rpm int, on boolean, label string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def modes(spark):
    """100 rows at 1 Hz with a text state that is missing for a while."""
    states = ["idle"] * 30 + ["run"] * 40 + [None] * 10 + ["stop"] * 20
    rows = [(i, START + dt.timedelta(seconds=i), s, float(i)) for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "pos bigint, t timestamp_ntz, state string, v double")


@pytest.fixture(scope="session")
def sales(spark):
    rows = [(0, "North", 10, "b"), (1, "South", 20, "a"), (2, "North", 30, "a"), (3, "East", 5, "c")]
    return spark.createDataFrame(rows, "pos bigint, region string, revenue bigint, grade string")


@pytest.fixture(scope="session")
def skewed(spark):
    """Three series; one holds most rows, and half of those share one x."""
    rows = []
    for i in range(3000):
        series = "big" if i % 10 else ("small" if i % 20 else None)
        x = 500 if series == "big" and i % 2 else (i * 7919) % 1000
        rows.append((series, x, i, float((i * 31) % 97), f"s{i % 4}" if i % 5 else None))
    return spark.createDataFrame(rows, "series string, x bigint, pos bigint, v double, state string").repartition(5)
