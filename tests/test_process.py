"""Jobs against plain Python over a fixture of water levels."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from seriesmill import Job, JobError, process
from seriesmill.plans.estimate import estimate_rows
from seriesmill.plans.job import ROW_INDEX
from seriesmill.plans.process import prepare

BEGIN = dt.datetime(2021, 3, 20)
QUARTER = dt.timedelta(minutes=15)
#: (pos, at, level, gate, open, place): two and a half days of readings every quarter of an hour, in a shuffled file order.
TIDE = [
    ((i * 77) % 240, BEGIN + i * QUARTER, None if i % 31 == 7 else (i * 37 % 101) / 8, i // 50 - 2, i % 3 == 0, ["pier", "lock", None][i % 7 % 3]) for i in range(240)
]


@pytest.fixture(scope="module")
def tide(spark):
    return spark.createDataFrame(TIDE, "pos bigint, at timestamp_ntz, level double, gate int, open boolean, place string").repartition(3)


@pytest.fixture(scope="module")
def rope(spark):
    """Loads along a rope, at uneven places from -3.5 on."""
    return spark.createDataFrame([(i, -3.5 + i + (i % 4) / 4, float((i * 13) % 29)) for i in range(60)], "pos bigint, place double, load double")


def job(**settings):
    return Job.from_dict({"x": "at", "y": ["level"], **settings})


def along(**settings):
    return Job.from_dict({"x": "place", "y": ["load"], **settings})


def rows(df, settings, **options):
    return process(df, settings, ordered=True, **options).collect()


def agg(method, functions=("mean",), **more):
    return {"method": method, "functions": list(functions), **more}


def known(values):
    return [v for v in values if v is not None]


def between(*ranges):
    return [r for r in TIDE if any((a is None or r[1] >= a) and (b is None or r[1] <= b) for a, b in ranges)]


def test_ranges_keep_what_lies_in_any_of_them(tide):
    noon, late = BEGIN + dt.timedelta(hours=12), BEGIN + dt.timedelta(hours=50)
    for ranges, want in (
        ([["2021-03-20T12:00", "2021-03-20T18:30"]], between((noon, noon + dt.timedelta(hours=6.5)))),
        ([["2021-03-20T12:00", "2021-03-20T18:30"], ["2021-03-22T02:00", None]], between((noon, noon + dt.timedelta(hours=6.5)), (late, None))),
        ([["2021-03-22T02:00", None], [None, "2021-03-20T12:00"], ["2021-03-20T11:00", "2021-03-20T12:00"]], between((late, None), (None, noon))),
        ([["2021-03-20T12:00", "2021-03-20T13:00"], [None, None]], TIDE),
    ):
        assert [(r["at"], r.level) for r in rows(tide, job(ranges=ranges))] == [r[1:3] for r in want]
    got = rows(tide, job(range_mode="relative", ranges=[["3h", "4h30m"], [200000, None]]))
    assert [r["at"] for r in got] == [r[1] for r in between((BEGIN + dt.timedelta(hours=3), BEGIN + dt.timedelta(hours=4.5)), (BEGIN + dt.timedelta(seconds=200000), None))]
    for bad in (["2021-03-21", "2021-03-20"], ["noonish", None]):
        with pytest.raises(JobError):
            process(tide, job(ranges=[bad]))


def test_bounds_without_zone_mean_wall_time(spark):
    utc = [dt.datetime(2022, 7, 9, h) for h in (3, 4, 5, 6)]  # 23:00 of the 8th to 02:00 in New York
    df = spark.createDataFrame([(i, t, i * 1.5) for i, t in enumerate(utc)], "pos bigint, ts timestamp_ntz, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    settings = Job.from_dict({"x": "ts", "y": ["v"], "ranges": [["2022-07-09", "2022-07-09T01:00"]]})
    assert [r.v for r in rows(df, settings, zone="America/New_York")] == [1.5, 3.0]
    assert [r.v for r in rows(df, settings.override(ranges=[[None, "2022-07-09T04:00Z"]]), zone="America/New_York")] == [0.0, 1.5]


@pytest.mark.parametrize("every, seconds", [("45m", 2700), ("6h", 21600), (5400, 5400)])
def test_intervals_group_by_their_start(tide, every, seconds):
    functions = ["mean", "min", "max", "sum", "count", "median", "first", "last"]
    got = rows(tide, job(y=["level", "open"], aggregation=agg("interval", functions, every=every)))
    groups = {}
    for r in TIDE:
        groups.setdefault(BEGIN + (r[1] - BEGIN) // dt.timedelta(seconds=seconds) * dt.timedelta(seconds=seconds), []).append(r)
    assert [r["at"] for r in got] == sorted(groups)
    for r in got:
        levels, opened = [x[2] for x in groups[r["at"]]], [int(x[4]) for x in groups[r["at"]]]
        some = known(levels)
        assert (r.level_min, r.level_max, r.level_count, r.level_first, r.level_last) == (min(some), max(some), len(some), levels[0], levels[-1])
        assert r.level_mean == pytest.approx(statistics.mean(some)) and r.level_median == pytest.approx(statistics.median(some)) and r.level_sum == pytest.approx(sum(some))
        assert r.open_mean == pytest.approx(statistics.mean(opened)) and r.open_sum == sum(opened)


@pytest.mark.parametrize("points", [1, 7, 50])
def test_target_points_are_equally_wide(tide, rope, points):
    got = rows(tide, job(aggregation=agg("target_points", ["count", "first"], points=points)))
    span = int((TIDE[-1][1] - BEGIN).total_seconds() * 1e6)
    width = -(-(span + 1) // points)
    groups = {}
    for r in TIDE:
        groups.setdefault(int((r[1] - BEGIN).total_seconds() * 1e6) // width, []).append(r[2])
    assert [(r.level_count, r.level_first) for r in got] == [(len(known(g)), g[0]) for _, g in sorted(groups.items())]
    places = [-3.5 + i + (i % 4) / 4 for i in range(60)]
    width = (max(places) - min(places)) / points
    counts = {}
    for x in places:
        k = min(int((x - min(places)) // width), points - 1)
        counts[k] = counts.get(k, 0) + 1
    assert [r.load for r in rows(rope, along(aggregation=agg("target_points", ["count"], points=points)))] == [n for _, n in sorted(counts.items())]


def test_target_points_of_nothing_and_of_one_row(tide):
    assert rows(tide, job(aggregation=agg("target_points", points=5), ranges=[["2035-01-01", None]])) == []
    assert rows(tide.filter("pos = 0"), job(aggregation=agg("target_points", ["std"], points=5)))[0].level is None


@pytest.mark.parametrize("n", [1, 17, 500])
def test_every_nth_in_x_order_and_in_file_order(tide, n):
    assert [r["at"] for r in rows(tide, job(aggregation={"method": "every_nth", "n": n}))] == [r[1] for r in TIDE[::n]]
    file = sorted(TIDE)
    assert [r["at"] for r in rows(tide, job(sort=False, aggregation={"method": "nth", "n": n}))] == [r[1] for r in file[::n]]
    first = rows(tide, job(sort=False, aggregation=agg("interval", ["first"], every="1d")))
    assert [r.level for r in first] == [next(r[2] for r in file if r[1].day == day) for day in (20, 21, 22)]


@pytest.mark.parametrize("every", [4, 2.5])
def test_steps_of_numbers(rope, every):
    got = rows(rope, along(aggregation=agg("interval", ["max", "count"], every=every)))
    groups = {}
    for i in range(60):
        groups.setdefault((-3.5 + i + (i % 4) / 4) // every * every, []).append(float((i * 13) % 29))
    assert [(r.place, r.load_max, r.load_count) for r in got] == [(x, max(g), len(g)) for x, g in sorted(groups.items())]
    with pytest.raises(JobError):
        process(rope, along(aggregation=agg("interval", every="2h")))


def test_whole_numbers_stay_whole(tide):
    got = rows(tide, Job.from_dict({"x": "gate", "y": ["open"], "aggregation": agg("interval", ["count"], every=3)}))
    assert [(r.gate, r.open) for r in got] == [(-3, 100), (0, 140)]
    assert all(isinstance(r.gate, int) for r in got)


def test_the_row_number_is_an_axis(tide):
    file = sorted(TIDE)
    got = rows(tide, job(x=ROW_INDEX, aggregation=agg("interval", ["first"], every=64)))
    assert [(r[ROW_INDEX], r.level) for r in got] == [(k, file[k][2]) for k in range(0, 240, 64)]
    got = rows(tide, job(x=ROW_INDEX, y=["gate"], scaling={ROW_INDEX: {"scale": -0.5, "offset": 10}}, ranges=[[-109, -108]]))
    assert [(r[ROW_INDEX], r.gate) for r in got] == [(10 - k / 2, file[k][3]) for k in (238, 237, 236)]


@pytest.mark.parametrize(
    "change",
    [
        {"x": "shape"}, {"y": ["shape"]}, {"x": "missing"}, {"y": ["level", "missing"]}, {"y": [ROW_INDEX]},
        {"aggregation": {"method": "interval", "every": "soon"}}, {"x": "place", "aggregation": {"method": "interval", "every": 2}},
        {"x": "place", "aggregation": {"method": "target_points", "points": 3}}, {"x": "place", "ranges": [[None, 4]]},
        {"y": ["place"], "scaling": {"place": {"offset": 1}}}, {"y": ["open"], "scaling": {"open": {"scale": 3}}}, {"scaling": {"at": {"scale": 0.5}}},
        {"scaling": {"level": {"offset": "5m"}}},
    ],
)
def test_jobs_that_do_not_fit(tide, change):
    with pytest.raises(JobError):
        process(tide.withColumn("shape", F.struct("level")), job(**change))


def test_scaled_values_and_times(tide, rope):
    scaling = {"level": {"scale": -0.25, "offset": 3}, "gate": {"scale": 10}, "other": {"scale": 7}}
    got = rows(tide, job(y=["level", "gate"], scaling=scaling))
    assert [(r.level, r.gate) for r in got] == [(None if r[2] is None else 3 - r[2] / 4, r[3] * 10.0) for r in TIDE]
    got = rows(tide, job(scaling={**scaling, "at": {"offset": "-1d"}}, ranges=[["2021-03-19T06:00", "2021-03-19T08:00"]]))
    assert [r["at"] for r in got] == [BEGIN + dt.timedelta(hours=-18) + k * QUARTER for k in range(9)]
    got = rows(rope, along(scaling={"place": {"scale": -2, "offset": 1}}, ranges=[[-10, -4]]))
    assert [r.place for r in got] == sorted(1 - 2 * x for x in (-3.5 + i + (i % 4) / 4 for i in range(60)) if -10 <= 1 - 2 * x <= -4)


@pytest.mark.parametrize("scale, offset", [(0.3, 0), (-0.7, 2.1), (1 / 7, -0.3)])
def test_scaled_bounds_keep_the_rows_on_them(rope, scale, offset):
    place = lambda i: -3.5 + i + (i % 4) / 4
    lo, hi = sorted((place(9) * scale + offset, place(30) * scale + offset))
    assert len(rows(rope, along(scaling={"place": {"scale": scale, "offset": offset}}, ranges=[[lo, hi]]))) == 22


def test_texts_as_values_and_as_axis(tide):
    got = process(tide, job(y=["place", "level"], aggregation=agg("interval", ["mean", "last", "count"], every="1d")), ordered=True)
    assert got.columns == ["at", "place_last", "place_count", "level_mean", "level_last", "level_count"]
    days = [[r for r in TIDE if r[1].day == day] for day in (20, 21, 22)]
    assert [(r.place_last, r.place_count) for r in got.collect()] == [(d[-1][5], len(known(r[5] for r in d))) for d in days]
    alone = rows(tide, job(y=["place"], aggregation=agg("interval", every="1d")))  # texts have no mean, so the first stands
    assert [r.place for r in alone] == [d[0][5] for d in days]
    file = [r for r in sorted(TIDE) if r[5] is not None]
    raw = rows(tide, Job.from_dict({"x": "place", "y": ["gate"]}))
    assert [(r.place, r.gate) for r in raw] == [(r[5], r[3]) for r in file]
    got = rows(tide, Job.from_dict({"x": "place", "y": ["gate"], "aggregation": agg("per_value", ["max", "count"])}))
    assert [(r.place, r.gate_max, r.gate_count) for r in got] == [
        (name, max(r[3] for r in file if r[5] == name), sum(r[5] == name for r in file)) for name in dict.fromkeys(r[5] for r in file)
    ]


def test_estimates_count_rows(tide, rope):
    def estimate(df, settings, by=()):
        return estimate_rows(prepare(df, settings, by, need_bounds=True)).collect()[0].estimate

    assert estimate(tide, job()) == 240 and estimate(tide, job(aggregation={"method": "nth", "n": 11})) == 22
    assert estimate(tide, job(aggregation=agg("interval", every="2h"))) == 30 and estimate(tide, job(aggregation=agg("points", points=33))) == 33
    assert estimate(rope, along(scaling={"place": {"scale": 100}}, aggregation=agg("interval", every=1000))) == 6
    assert estimate_rows(prepare(tide, Job.from_dict({"x": "place", "y": ["gate"], "aggregation": agg("per_value")}))).collect()[0].estimate == 2


def test_split_gives_a_row_to_every_range_that_holds_it(tide):
    ranges = [["2h", "5h", "early"], [7200, 9000], ["1h", None, "rest"]]
    got = process(tide, job(range_mode="relative", ranges=ranges), split=True).groupBy("range_no", "range").count().orderBy("range_no").collect()
    assert [tuple(r) for r in got] == [(1, "early", 13), (2, "2", 3), (3, "rest", 236)]


def test_zoned_buckets_across_clock_changes(spark):
    """The repeated hour stays two buckets, and days have 23 or 25 hours."""
    start = dt.datetime(2024, 10, 26, 22)  # midnight in Berlin, 27 October has 25 hours
    df = spark.createDataFrame([(i, start + dt.timedelta(minutes=30 * i), 1.0) for i in range(60)], "pos bigint, ts timestamp_ntz, v double")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    hours = rows(df, Job.from_dict({"x": "ts", "y": ["v"], "aggregation": agg("interval", ["count"], every="1h")}), zone="Europe/Berlin")
    assert [r.v for r in hours] == [2] * 30
    days = rows(df, Job.from_dict({"x": "ts", "y": ["v"], "aggregation": agg("interval", ["count"], every="1d")}), zone="Europe/Berlin")
    assert [r.v for r in days] == [50, 10]


def test_calendar_buckets_before_1970(spark):
    times = [dt.datetime(1969, 12, 31, 23, 59, 59), dt.datetime(1969, 11, 2), dt.datetime(1970, 1, 4), dt.datetime(1970, 1, 5)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(times)], "pos bigint, t timestamp_ntz, v double")

    def starts(every):
        return [r.t for r in rows(df, Job.from_dict({"x": "t", "y": ["v"], "aggregation": agg("interval", every=every)}))]

    assert starts("1d")[1] == dt.datetime(1969, 12, 31)
    assert starts("1w") == [dt.datetime(1969, 10, 27), dt.datetime(1969, 12, 29), dt.datetime(1970, 1, 5)]
    assert starts("1q") == [dt.datetime(1969, 10, 1), dt.datetime(1970, 1, 1)]
    assert starts("1y") == [dt.datetime(1969, 1, 1), dt.datetime(1970, 1, 1)]
    for bad in ("1mo2d", "1w3d", "1.5mo", "500ns"):
        with pytest.raises(JobError):
            starts(bad)


def test_missing_values(spark):
    nan = float("nan")
    data = [(0, 1.0, 5.0), (1, nan, 9.0), (2, None, 9.0), (3, 1.0, None), (4, 2.0, nan), (5, 3.0, None)]
    df = spark.createDataFrame(data, "pos bigint, x double, v double")
    functions = ["sum", "count", "min", "max", "first", "last", "std"]
    got = rows(df, Job.from_dict({"x": "x", "y": ["v"], "aggregation": agg("per_value", functions)}))
    assert [r.x for r in got] == [1.0, 2.0, 3.0]
    assert (got[0].v_sum, got[0].v_count, got[0].v_first, got[0].v_last, got[0].v_std) == (5.0, 1, 5.0, None, None)
    assert got[1].v_min is None and got[1].v_max is None  # NaN is no extreme
    assert got[2].v_sum == 0.0 and got[2].v_min is None


def test_many_series_at_once(skewed):
    settings = Job.from_dict({"x": "x", "y": ["v"], "range_mode": "relative", "ranges": [[0, 400]], "aggregation": agg("points", ["count"], points=4)})
    got = process(skewed, settings, by=["series"]).groupBy("series").agg(F.sum("v").alias("n")).collect()
    first = {r.series: r.lo for r in skewed.groupBy("series").agg(F.min("x").alias("lo")).collect()}
    for r in got:
        same = F.col("series").eqNullSafe(F.lit(r.series))
        assert r.n == skewed.filter(same & F.col("x").between(first[r.series], first[r.series] + 400)).count()


def test_session_time_zone_does_not_matter(spark, tide):
    settings = job(
        scaling={"at": {"offset": "90m"}}, ranges=[["2021-03-20T05:00", "2021-03-21T22:10"]], aggregation=agg("interval", ["first", "last", "count"], every="7h")
    )
    points = job(aggregation=agg("points", ["mean"], points=7), range_mode="relative", ranges=[[1800, "20h"]])
    want = [rows(tide, settings), rows(tide, points)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [rows(tide, settings), rows(tide, points)] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_far_values_keep_their_own_buckets(spark):
    rows = [(0, 2.5), (1, 1e30), (2, 3e30), (3, float("inf")), (4, -7.25)]
    df = spark.createDataFrame([(pos, x, 1.0) for pos, x in rows], "pos bigint, x double, v double")
    got = process(df, Job(x="x", y=["v"], aggregation={"method": "interval", "every": 2, "functions": "count"})).collect()
    assert sorted(r.x for r in got) == [-8.0, 2.0, 1e30, 3e30, float("inf")]
