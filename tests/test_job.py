import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill import Affine, Job, JobError, Span, process
from seriesmill.functions.durations import duration_us, is_duration, offset_seconds
from seriesmill.functions.times import bound_us, date_pattern, strftime_text
from seriesmill.plans import job as J
from seriesmill.plans.checks import check_job
from seriesmill.sources.schema import default_x, default_y, with_defaults

COLUMNS = T.StructType().add("when", "timestamp").add("depth", "double").add("ok", "boolean").add("site", "string").add("raw", "binary")


@pytest.mark.parametrize("section", sorted(J.SETTINGS))
def test_every_default_passes_its_own_reader(section):
    for name, (default, reader) in J.SETTINGS[section].items():
        assert reader(default) == default, name


def test_documents_hold_what_differs_from_the_defaults():
    assert Job(x="when", y="depth").to_dict() == {"version": 1, "x": "when", "y": ["depth"]}
    document = {
        "x": "when", "y": ["depth", "ok"], "scaling": {"depth": {"scale": 0.3048}, "when": {"offset": "-90s"}}, "ranges": [["-", "7.50", "dive"], {"start": "3"}],
        "aggregation": {"method": "bucket", "every": "5m", "functions": "max,first"}, "csv": {"separator": "\\t"}, "output": {"split_ranges": True},
    }
    job = Job.from_dict(document)
    assert job.ranges == [Span(None, 7.5, "dive"), Span(3)] and job.scaling["when"] == Affine(1.0, "-90s")
    assert (job.aggregation.method, job.aggregation.functions, job.csv.separator, job.output.path) == ("interval", ["max", "first"], "\t", "{stem}_export.csv")
    again = Job.from_json(job.to_json())
    assert again.to_dict() == job.to_dict() == json.loads(job.to_json())
    assert again.ranges == job.ranges and again.scaling == job.scaling


WRONG = {
    "aggregation": [{"method": "weekly"}, {"n": 2.0}, {"n": True}, {"points": 0}, {"every": "2 moons"}, {"every": -1}, {"functions": ["mode"]}, {"functions": [], "method": "group"}, {"size": 3}, 7],
    "csv": [{"separator": ""}, {"include_bom": "yes"}, {"float_precision": -1}, {"decimal_comma": True}, {"time_format": "rfc"}, {"line_terminator": "cr"}, {"datetime_format": "", "time_format": "custom"}],
    "output": [{"folder": "x"}, {"split_ranges": 1}],
    "scaling": [{"depth": {"scale": 0}}, {"depth": {"scale": "1/3"}}, {"depth": {"offset": "later"}}, {"depth": {"gain": 2}}, {"depth": 3}, ["depth"]],
    "ranges": [[[1, 2, "a", "b"]], [{"from": 1}], [5], [{"color": "#12345"}], [[True, None]], [["1e999", None]], 4],
    "range_mode": ["both"],
    "version": [2, "1", True],
    "extra": [1],
}


@pytest.mark.parametrize("name, value", [(name, value) for name, values in WRONG.items() for value in values])
def test_wrong_settings_are_named(name, value):
    with pytest.raises(JobError, match=name):
        Job.from_dict({"x": "when", "y": ["depth"], name: value})


@pytest.mark.parametrize("document", ["", "[1]", "3", "{", "null"])
def test_no_document(document):
    with pytest.raises(JobError):
        Job.from_json(document)


def test_override_replaces_single_settings():
    job = Job(x="when", y=["depth"], csv={"null_value": "NA"}, aggregation="nth")
    other = job.override(csv={"separator": ";"}, y=["ok"], aggregation={"n": 4})
    assert (other.csv.null_value, other.csv.separator, other.y, other.aggregation.method, other.aggregation.n) == ("NA", ";", ["ok"], "every_nth", 4)
    assert job.csv.separator == "," and job.y == ["depth"]


def test_output_columns():
    def names(**settings):
        return [name for name, *_ in Job(x="x", y=["a", "x", "t", "a"], **settings).outputs(frozenset("t"))]

    assert names() == ["a", "t"]
    assert names(aggregation={"method": "group", "functions": "min,mean,min"}) == ["a_min", "a_mean", "t_min"]
    assert names(aggregation={"method": "group", "functions": "median"}) == ["a", "t"]
    assert Job(x="x", y=["t"], aggregation={"method": "group", "functions": "median"}).outputs(frozenset("t")) == [("t", "t", "first")]


UNFIT = [
    {"x": "raw"}, {"x": ""}, {"y": []}, {"x": "nowhere"}, {"y": ["raw"]}, {"y": ["when"]}, {"y": ["__row_index__"]}, {"x": "site", "aggregation": "points"},
    {"x": "site", "ranges": [[1, 2]]}, {"scaling": {"ok": {"scale": 2}}, "y": ["ok"]}, {"scaling": {"when": {"scale": 2}}}, {"scaling": {"depth": {"offset": "1h"}}},
    {"x": "depth", "y": ["ok"], "aggregation": {"method": "interval", "every": "1h"}},
]


@pytest.mark.parametrize("change", UNFIT)
def test_jobs_that_do_not_fit_the_columns(change):
    with pytest.raises(JobError):
        check_job(Job(**{"x": "when", "y": ["depth"], **change}), COLUMNS)


def test_jobs_that_fit():
    for settings in ({}, {"x": "site", "aggregation": "group"}, {"x": "__row_index__"}, {"scaling": {"when": {"offset": "2h"}, "depth": {"scale": 2}}}):
        check_job(Job(**{"x": "when", "y": ["depth", "site", "ok"], **settings}), COLUMNS)
    check_job(Job(x="when"), COLUMNS, need_y=False)


@pytest.mark.parametrize(
    "columns, x, y",
    [
        ("n int, ts_local timestamp, at timestamp", "ts_local", ["n"]),
        ("day date, at timestamp, s string, b boolean", "at", ["b", "s"]),
        ("s string, born date, utc_date date", "utc_date", ["s"]),
        ("s string, total double, epoch bigint, v int", "epoch", ["total", "v"]),
        ("s string, total double", "__row_index__", ["total", "s"]),
    ],
)
def test_default_columns(spark, columns, x, y):
    schema = spark.createDataFrame([], columns).schema
    assert default_x(schema) == x and default_y(schema, x) == y
    filled = with_defaults(Job(), schema)
    assert (filled.x, filled.y) == (x, y) and with_defaults(Job(x="s"), schema).x == "s"


def test_durations_and_conversions():
    assert duration_us("2d3h") == (51 * 3600) * 1e6 and duration_us("15us") == 15
    assert is_duration("3q") and not is_duration("three hours")
    assert offset_seconds("-1h") == -3600 and offset_seconds("0.25") == 0.25
    assert Affine(0.5, 3).invert(Affine(0.5, 3).apply(8)) == 8 and Affine(1, "0m").identity


def test_bounds_and_patterns():
    noon = 1_719_835_200_000_000  # 2024-07-01T12:00:00Z
    assert bound_us("2024-07-01T12:00:00Z", None) == bound_us("2024-07-01 14:00", "Europe/Berlin") == noon
    assert bound_us("2024-07-01T17:30:00.000001987+05:30", None) == noon + 1
    assert bound_us(noon / 1e6, None) == noon
    assert date_pattern("%d/%m at %H") == "dd'/'MM' at 'HH"
    with pytest.raises(ValueError):
        date_pattern("%!")


def test_strftime_texts(spark):
    moments = [dt.datetime(2023, 12, 31, 23, 59, 59, 120000), dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 29, 12, 5, 9, 7), dt.datetime(2021, 1, 3, 0, 30)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(moments)], "i int, t timestamp_ntz")
    pattern = "%Y-%m-%d %e %-d %-H %j %u %w %U %W %G %V %g %I %p %C 100%% %c"
    got = [r.t for r in df.select("i", strftime_text(F.col("t"), pattern, False, None).alias("t")).orderBy("i").collect()]
    assert got == [m.strftime(pattern.replace("%e", f"{m.day:2d}").replace("%-d", str(m.day)).replace("%-H", str(m.hour)).replace("%c", f"%a %b {m.day:2d} %H:%M:%S %Y")) for m in moments]
    fraction = [r.t for r in df.select("i", strftime_text(F.col("t"), "%S%.f", False, None).alias("t")).orderBy("i").collect()]
    assert fraction == ["59.120", "00", "09.000007", "00"]
    zoned = df.select("i", F.to_timestamp_ltz(F.col("t").cast("string")).alias("t"))
    got = [r.t for r in zoned.select("i", strftime_text(F.col("t"), "%H %z %:z %s", True, "Asia/Kolkata").alias("t")).orderBy("i").collect()]
    assert got[1] == f"05 +0530 +05:30 {int(moments[1].replace(tzinfo=dt.timezone.utc).timestamp())}"
    for bad in ("%z", "%!", "%Q"):
        with pytest.raises(ValueError):
            strftime_text(F.col("t"), bad, False, None)


def test_a_job_without_columns_takes_those_that_suggest_themselves(spark):
    df = spark.createDataFrame([(0, "a", dt.datetime(2024, 1, 1), 1.0, "p")], "pos bigint, source string, at timestamp_ntz, v double, w string")
    assert process(df, Job(), by=["source"]).columns == ["source", "at", "v", "w"]
    assert process(df, Job(x="v"), by=["source"]).columns == ["source", "v", "w"]
