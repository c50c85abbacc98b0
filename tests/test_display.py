from conftest import START
from pyspark.sql import functions as F

from seriesmill import Job
from seriesmill.functions.cells import readout_text
from seriesmill.operators import display as D
from seriesmill.plans.plot import plot_points, table_rows

LO = 1704067200.0


def pairs(df, series=None):
    df = df if series is None else df.filter(F.col("series") == series)
    return sorted((r.x, r.y) for r in df.collect())


def job(**settings):
    return Job.from_dict({"x": "time", "y": ["speed"], **settings})


def test_full_points(telemetry):
    got = plot_points(telemetry, job(y=["speed", "on"]))
    assert not got.reduced and got.rows == 600
    speed = pairs(got.points, "speed")
    assert speed[0] == (LO, 0.0) and round(speed[1][0] - speed[0][0], 6) == 0.1
    assert {y for _, y in pairs(got.points, "on")} == {0.0, 1.0}
    assert got.bounds.first().lo == LO * 1e6


def test_envelope_keeps_peaks(telemetry):
    got = plot_points(telemetry, job(y=["speed", "temp"]), buckets=20)
    speed = pairs(got.points, "speed")
    assert got.reduced and len(speed) == 40 and min(y for _, y in speed) == 0 and max(y for _, y in speed) == 599
    temp = pairs(got.points, "temp")
    assert min(y for _, y in temp) == 20 and max(y for _, y in temp) == 29


def test_envelope_of_buckets_and_missing_values(telemetry):
    empty = telemetry.withColumn("speed", F.when(F.col("speed") >= 300, F.col("speed")))
    got = plot_points(empty, job(), buckets=10)
    assert len(pairs(got.points)) == 10  # the five buckets without values are left out
    means = job(aggregation={"method": "interval", "every": "1s", "functions": ["mean", "max"]})
    got = plot_points(telemetry, means, buckets=6)
    assert got.reduced and len(pairs(got.points, "speed_max")) == 12


def test_scaled_points_and_table(telemetry):
    settings = job(scaling={"speed": {"scale": -1}, "time": {"offset": 60}})
    assert plot_points(telemetry, settings).bounds.first().lo == (LO + 60) * 1e6
    reduced = plot_points(telemetry, settings, buckets=10)
    assert min(y for _, y in pairs(reduced.points)) == -599
    assert table_rows(telemetry, settings, limit=1000).rows.collect()[1].speed == -1.0


def test_detail_and_splice(telemetry):
    overview = plot_points(telemetry, job(y=["speed", "rpm"]), buckets=10)
    detail = plot_points(telemetry, job(), view=(LO + 10, LO + 15))
    assert not detail.reduced and len(pairs(detail.points)) == 51
    both = D.splice(overview.points, detail.points, LO + 10, LO + 15)
    assert pairs(both, "rpm") == pairs(overview.points, "rpm")
    outside = [p for p in pairs(overview.points, "speed") if not LO + 10 <= p[0] <= LO + 15]
    assert pairs(both, "speed") == sorted(outside + pairs(detail.points))


def test_splice_recodes_the_detail(modes):
    settings = Job.from_dict({"x": "t", "y": ["state"]})
    overview = plot_points(modes, settings)
    detail = plot_points(modes, settings, view=(LO + 40, LO + 50))  # knows "run" only
    codes = {"state": (detail.categories["state"], overview.categories["state"])}
    both = D.splice(overview.points, detail.points, LO + 40, LO + 50, codes=codes)
    assert sorted(map(repr, pairs(both, "state"))) == sorted(map(repr, pairs(overview.points, "state")))


def test_readout_texts(spark):
    values = [0.0, -0.0, 1.0, 0.001, 0.00099999, 123456.5, 999999.5, 1234567.0, 1e7, -2.5e-9, 100.0, 0.1 + 0.2, 12345.65, 1e300, 9999999.9, 3822850000.0, 1234565.0, 9999999.5, 99999500.0, 1234.125, 1234.375, 2.0**60]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, float("nan"), float("inf"), None])], "i int, v double")
    got = [r.t for r in df.select("i", readout_text(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == [f"{v:.4e}" if v and (abs(v) >= 1e7 or abs(v) < 1e-3) else f"{v:.6g}" for v in values] + ["–"] * 3


def test_splice_keeps_series_without_detail(spark):
    base = spark.createDataFrame([(s, float(i), float(i)) for s in "ab" for i in range(5)], "series string, x double, y double")
    detail = spark.createDataFrame([("a", 2.5, 9.0), ("c", 2.5, 1.0)], "series string, x double, y double")
    got = D.splice(base, detail, 2, 3)
    assert [x for x, _ in pairs(got, "a")] == [0, 1, 2.5, 4] and len(pairs(got, "b")) == 5 and pairs(got, "c") == []


def test_text_codes(modes):
    got = plot_points(modes, Job.from_dict({"x": "t", "y": ["state", "v"]}))
    assert [r.value for r in got.categories["state"].orderBy("code").collect()] == ["idle", "run", "stop"]
    state = dict(pairs(got.points.filter("y IS NOT NULL"), "state"))
    assert state[LO] == 0 and state[LO + 30] == 1 and LO + 75 not in state and state[LO + 99] == 2


def test_detail_codes_move_to_the_overview(modes):
    settings = Job.from_dict({"x": "t", "y": ["state"]})
    overview = plot_points(modes, settings, buckets=5)
    detail = plot_points(modes, settings, view=(LO + 40, LO + 50))
    assert {y for _, y in pairs(detail.points)} == {0.0}
    moved = D.recode(detail.points, detail.categories["state"], overview.categories["state"])
    merged = D.splice(overview.points, moved, LO + 40, LO + 50)
    assert {y for x, y in pairs(merged) if LO + 40 <= x <= LO + 50} == {1.0}
    gone = D.recode(overview.points, overview.categories["state"], detail.categories["state"])
    assert {r.y for r in gone.collect()} == {0.0, None}


def test_category_axis(sales):
    got = plot_points(sales, Job.from_dict({"x": "region", "y": ["revenue", "grade"]}))
    assert [r.value for r in got.x_categories.orderBy("code").collect()] == ["North", "South", "East"]
    assert pairs(got.points, "revenue") == [(0, 10), (0, 30), (1, 20), (2, 5)]
    assert pairs(got.points, "grade") == [(0, 0), (0, 1), (1, 0), (2, 2)]
    reduced = plot_points(sales, Job.from_dict({"x": "region", "y": ["revenue"]}), buckets=1)
    assert pairs(reduced.points) == [(0, 10), (0, 30), (1, 20), (1, 20), (2, 5), (2, 5)]
    summary = {r.x: r.text for r in D.category_summary(got.points.filter("series = 'revenue'")).collect()}
    assert summary == {0: "10 … 30 (2 values)", 1: "20", 2: "5"}
    assert {r.series: r.single for r in D.category_unique(got.points).collect()} == {"revenue": False, "grade": False}


def test_table(modes, sales):
    settings = Job.from_dict({"x": "t", "y": ["state", "v"]})
    table = table_rows(modes, settings, limit=20)
    assert table.truncated and table.estimate == 100 and not table.windowed and table.rows.count() == 20
    table = table_rows(modes, settings, limit=20, view=(LO + 29, LO + 31))
    assert table.windowed and not table.truncated
    assert [r.state for r in table.rows.collect()] == ["idle", "run", "run"]
    table = table_rows(sales, Job.from_dict({"x": "region", "y": ["grade"]}), view=(0.5, 1.5), limit=50)
    assert not table.windowed and table.rows.count() == 4


def test_state_intervals(modes):
    got = D.state_intervals(modes, [], "t", ["pos"], "state").orderBy("x_start").collect()
    assert got[0].x_start == START and got[0].x_end == got[1].x_start and got[-1].x_end is None and got[75].value is None
