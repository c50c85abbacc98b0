"""Hot keys, sliced windows and plans: results against plain Python on a skewed fixture."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from seriesmill import Job, process
from seriesmill.operators import aggregate as A
from seriesmill.operators import display as D
from seriesmill.operators import joins
from seriesmill.operators.lookup import lookup_hold, lookup_nearest
from seriesmill.operators.order import every_nth, first_rows, number_rows, number_table, ranked
from seriesmill.operators import ranges as R
from seriesmill.operators.ranges import merged


def series_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.series, []).append(r)
    for rows in out.values():
        rows.sort(key=lambda r: (r.x, r.pos))
    return out


@pytest.mark.parametrize("slices", [70, None])
def test_number_rows(skewed, slices):
    got = number_rows(skewed, ["series"], ["x", "pos"], "n", slices)
    want = {(r.series, r.pos): i for rows in series_of(skewed).values() for i, r in enumerate(rows)}
    assert {(r.series, r.pos): r.n for r in got.collect()} == want


def test_number_rows_of_one_series(skewed):
    ordered = sorted(skewed.collect(), key=lambda r: (r.x, r.pos))
    got = number_rows(skewed, [], ["x", "pos"], "n", 30).collect()
    assert {r.pos: r.n for r in got} == {r.pos: i for i, r in enumerate(ordered)}
    kept = every_nth(skewed, 7, [], ["x", "pos"], 30).collect()
    assert {r.pos for r in kept} == {r.pos for r in ordered[::7]}


def test_slices_split_a_hot_x(skewed):
    cut = ranked(skewed, ["series"], ["x", "pos"], 30)
    sizes = [r["count"] for r in cut.df.groupBy("series", cut.slice).count().collect()]
    assert max(sizes) < 400 and sum(sizes) == 3000
    assert cut.borders(F.count(F.lit(1))).count() == len(sizes) <= 30 + 3


@pytest.mark.parametrize("size", [50, None])
def test_state_intervals(skewed, size):
    got = D.state_intervals(skewed, ["series"], "x", ["pos"], "state", size).collect()
    want = []
    for series, rows in series_of(skewed).items():
        for i, r in enumerate(rows):
            want.append((series, r.x, rows[i + 1].x if i + 1 < len(rows) else None, r.state))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("size", [50, None])
def test_lookups(spark, skewed, size):
    rng = random.Random(3)
    probes = [(rng.choice(["big", "small", None, "unknown"]), rng.randint(-50, 1100), i) for i in range(400)]
    table = spark.createDataFrame(probes, "series string, x bigint, probe bigint")
    samples = series_of(skewed)
    nearest, hold = {}, {}
    for series, x, probe in probes:
        rows = samples.get(series, [])
        before = [r for r in rows if r.x < x]
        after = [r for r in rows if r.x >= x]
        upto = [r for r in rows if r.x <= x]
        b, a = (before[-1] if before else None), (after[0] if after else None)
        pick = a if a and (not b or a.x - x < x - b.x) else b
        nearest[probe] = (pick.x, pick.v) if pick else (None, None)
        hold[probe] = (upto[-1].x, upto[-1].state) if upto else (None, None)
    got = lookup_nearest(skewed, table, ["series"], "x", "pos", "v", "probe", None, size).collect()
    assert {r.probe: (r.sample_x, r.value) for r in got} == nearest
    got = lookup_hold(skewed, table, ["series"], "x", "pos", "state", "probe", size).collect()
    assert {r.probe: (r.sample_x, r.value) for r in got} == hold


def test_split_median(skewed):
    nulls = skewed.withColumn("v", F.when(F.col("pos") % 13 != 0, F.col("v")))
    got = A.aggregate(nulls, ["series", "state"], [("m", "v", "median"), ("n", "v", "count")], ["pos"])
    groups = {}
    for r in nulls.collect():
        groups.setdefault((r.series, r.state), []).append(r.v)
    for r in got.collect():
        values = [v for v in groups.pop((r.series, r.state)) if v is not None]
        assert r.m == (statistics.median(values) if values else None) and r.n == len(values)
    assert not groups


@pytest.mark.parametrize("slices", [None, 1, 40])
@pytest.mark.parametrize("values", [
    [float(i) for i in range(1001)],
    [1.7e9 + i / 8 for i in range(900)],  # all in one cell
    [-2.0] * 500 + [3.0] * 500,  # middle ranks in two cells
    [5.0] * 999 + [-1.0],
    [0.0, -0.0, 5e-324, -5e-324, float("inf"), float("-inf")],
    [float("inf"), float("nan"), float("nan"), 1.0, -1.0],
    [1e308, 1.7e308],
    [-3.5],
])
def test_exact_medians_of_any_spread(spark, values, slices):
    """One series with these values, and one that is larger, next to each other and to NULLs."""
    rows = [("a", v, True) for v in values] + [("b", float(i % 77), False) for i in range(2000)] + [("c", None, None)]
    df = spark.createDataFrame(rows, "value string, v double, which boolean").repartition(7)
    got = {r.value: r for r in A.exact_medians(df, ["value"], [("m", "v"), ("again", "v"), ("flag", "which")], slices).collect()}
    ordered = sorted(values, key=lambda v: (v != v, v))
    low, high = ordered[(len(ordered) - 1) // 2], ordered[len(ordered) // 2]
    assert set(got) == {"a", "b"} and got["a"].flag == 1 and got["b"].flag == 0
    assert got["a"].m == got["a"].again == (low if low == high else low / 2 + high / 2) and got["b"].m == statistics.median(i % 77 for i in range(2000))


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_lookup_join_with_and_without_a_broadcast(spark, skewed, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        table = spark.createDataFrame([("big", 1), (None, 2)], "series string, k int")
        got = joins.lookup_join(skewed, table, ["series"])
        assert got.columns == [*skewed.columns, "k"]
        counts = {r.k: r["count"] for r in got.groupBy("k").count().collect()}
        want = {r.series: r["count"] for r in skewed.groupBy("series").count().collect()}
        assert counts == {1: want["big"], 2: want.get(None, 0), None: want.get("small", 0)} or counts == {1: want["big"], 2: want[None]}
        inner = joins.lookup_join(skewed, table, ["series"], "inner")
        assert inner.count() == want["big"] + want.get(None, 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_number_table(spark):
    table = spark.createDataFrame([(f"t{i:03d}",) for i in range(300)], "value string")
    assert [r.code for r in number_table(table, ["value"], "code").orderBy("value").collect()] == list(range(300))


def test_user_columns_may_be_called_like_those_of_buckets(spark):
    rows = [(i, "ab"[i % 2], i, float(i % 5), float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "pos bigint, series_lo string, x bigint, bucket double, place double")
    job = Job.from_dict({"x": "x", "y": ["bucket", "place"], "aggregation": {"method": "target_points", "points": 3, "functions": ["first"]}})
    got = process(df, job, by=["series_lo"]).collect()
    assert len(got) == 6 and {(r.bucket, r.place) for r in got if r.x == 0} == {(0.0, 0.0)}
    relative = job.override(range_mode="relative", ranges=[[0, 9]])
    assert process(df, relative, by=["series_lo"]).groupBy("series_lo").count().count() == 2


def test_user_columns_may_have_any_name(spark):
    """Names that the operators would take for their own columns."""
    rows = [(i, i % 7, float(i), i, i) for i in range(100)]
    df = spark.createDataFrame(rows, "pos bigint, place bigint, slice double, first bigint, before bigint")
    got = number_rows(df, [], ["place", "pos"], "n", 4)
    assert got.columns == [*df.columns, "n"]
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.pos: r.n for r in got.collect()} == want


@pytest.mark.parametrize("few", [0, 64])
def test_filter_by_table(spark, skewed, few):
    rng = random.Random(5)
    pairs = [(lo, lo + rng.randint(0, 3)) for lo in (rng.randint(0, 1000) for _ in range(60))] + [(None, 4), (990, None)]
    table = spark.createDataFrame(pairs, "lo bigint, hi bigint")
    got = {r.pos for r in R.filter_by_table(skewed, "x", table, few, 20).collect()}
    wide = spark.createDataFrame([(f"{(1 << 60) + i}.5",) for i in range(4)], "v string").select(F.col("v").cast("decimal(25,1)").alias("v"))
    one = spark.createDataFrame([((1 << 60) + 1, (1 << 60) + 2)], "lo bigint, hi bigint")
    assert [str(r.v) for r in R.filter_by_table(wide, "v", one, 0, 2).collect()] == [f"{(1 << 60) + 1}.5"]  # doubles cannot tell these apart
    inside = lambda x: any((lo is None or x >= lo) and (hi is None or x <= hi) for lo, hi in pairs)
    assert got == {r.pos for r in skewed.collect() if inside(r.x)}
    assert merged([(5, 9), (1, 2), (2, 6), (11, None)]) == [(1, 9), (11, float("inf"))]


def test_many_slices_stay_plannable(skewed):
    got = number_rows(skewed, [], ["x", "pos"], "n", 750).filter("n % 100 = 0")
    assert got.count() == 30 and len(plan(got)) < 20_000


# -- plans --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(telemetry, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored") / "t")
    telemetry.orderBy("pos").coalesce(1).write.parquet(folder)
    return telemetry.sparkSession.read.parquet(folder)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_reaches_the_scan(stored):
    text = plan(process(stored, Job.from_dict({"x": "time", "y": ["speed"], "ranges": [["2024-01-01T00:00:10", None]]})))
    assert "GreaterThanOrEqual(time,2024-01-01T00:00:10)" in text
    assert "ReadSchema: struct<time:timestamp_ntz,speed:double>" in text


def test_shifted_range_reaches_the_scan(stored):
    settings = {"x": "time", "y": ["speed"], "scaling": {"time": {"offset": "1h"}}, "ranges": [["2024-01-01T01:00:10", "2024-01-01T01:00:20"]]}
    assert "GreaterThanOrEqual(time,2024-01-01T00:00:10)" in plan(process(stored, Job.from_dict(settings)))


def test_scaled_number_reaches_the_scan(stored):
    settings = {"x": "rpm", "y": ["speed"], "scaling": {"rpm": {"scale": -0.5}}, "ranges": [[-50, -20]]}
    text = plan(process(stored, Job.from_dict(settings)))
    assert "GreaterThanOrEqual(rpm,39)" in text and "LessThanOrEqual(rpm,101)" in text


def scanned(df):
    """The rows of *df*, and how many its scan of files gave."""
    rows = df.collect()
    plan, found, todo = df._jdf.queryExecution().executedPlan(), [], []
    todo = [plan]
    while todo:
        node = todo.pop()
        if "FileSourceScanExec" in node.getClass().getName():
            found.append(node.metrics().apply("numOutputRows").value())
        if "AdaptiveSparkPlanExec" in node.getClass().getName():
            todo.append(node.executedPlan())
        elif "QueryStageExec" in node.getClass().getName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows, found


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    """Sources of 20,000 seconds each, one file a source, in row groups; the later ones start much later."""
    folder = str(tmp_path_factory.mktemp("runs") / "t")
    row = spark.range(80_000).select(
        F.floor(F.col("id") / 20_000).alias("run"), (F.col("id") % 20_000).alias("pos"), F.rand(3).alias("v"),
    )
    row = row.withColumn("n", F.col("run") * 1_000_000 + F.col("pos") * 2).withColumn("t", F.timestamp_seconds("n").cast("timestamp_ntz"))
    row = row.withColumns({"d": F.date_from_unix_date((F.col("n") / 1000).cast("int")), "f": F.col("n") / -4})
    row.repartitionByRange(4, "run").sortWithinPartitions("run", "pos").write.option("parquet.block.size", 65536).option("parquet.page.row.count.limit", 2000).parquet(folder)
    return spark.read.parquet(folder)


@pytest.mark.parametrize("x, scaling, ranges", [
    ("t", {}, [["0s", "100s"]]),
    ("t", {"t": {"offset": "-3h"}}, [["10s", "100s"], ["1m", "150s"]]),
    ("n", {}, [[10, 300]]),
    ("n", {"n": {"scale": -0.25, "offset": 7}}, [[10, 300]]),
    ("f", {}, [[None, 120.5]]),
    ("d", {}, [["1d", "3d"]]),
])
def test_hull_of_relative_ranges(runs, x, scaling, ranges):
    job = Job.from_dict({"x": x, "y": ["v"], "scaling": scaling, "range_mode": "relative", "ranges": ranges})
    got = process(runs, job, by=["run"])
    assert "ubquery" in plan(got)
    rows = sorted(map(tuple, got.collect()))
    want = []
    for run in range(4):
        want += map(tuple, process(runs.filter(F.col("run") == run).drop("run"), job).select(F.lit(run).cast("bigint"), x, "v").collect())
    assert rows == sorted(want) and len(rows) > 100


def test_hull_prunes_the_scan(runs):
    one = runs.filter(F.col("run") < 1)
    job = Job.from_dict({"x": "n", "y": ["v"], "range_mode": "relative", "ranges": [[10, 300]]})
    rows, found = scanned(process(one, job, by=["run"]))
    assert len(rows) == 146 and min(found) < 20_000 < max(found) + 1


@pytest.mark.parametrize("n", [1, 100, 5000, 90_000])
@pytest.mark.parametrize("order", [["t", "pos"], ["n", "pos"], ["f", "pos"], ["d", "run", "pos"], ["pos", "run"]])
def test_first_rows_by_a_cut(runs, order, n):
    picked = first_rows(runs, n, order)
    assert [tuple(r) for r in picked.collect()] == [tuple(r) for r in runs.orderBy(*order).limit(n).collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 20])
@pytest.mark.parametrize("values", [
    [None, None, 1.0, float("nan"), 3.0, float("inf"), float("-inf"), -2.0], [5.0] * 9, [float("nan")] * 3, [None] * 4, [], [1e300, -1e300, 1e-300, 0.0, -0.0],
])
def test_first_rows_of_any_numbers(spark, values, n):
    df = spark.createDataFrame(list(enumerate(values)), "pos int, v double")
    order = ["v", "pos"]
    assert [r.pos for r in first_rows(df, n, order).collect()] == [r.pos for r in df.orderBy(*order).collect()][:n]


def test_cut_bounds_what_one_task_gets(runs):
    from seriesmill.operators.order import _cut

    cut = _cut(runs.select("n"), 1000, runs.schema["n"].dataType).first().cut
    assert 1000 <= runs.filter(F.col("n") <= cut).count() <= 1010
    rows, found = scanned(first_rows(runs.select("n", "pos"), 1000, ["n", "pos"]))
    assert len(rows) == 1000 and min(found) < 80_000


@pytest.mark.parametrize("functions", [["mean", "max", "std"], ["first", "last", "sum"]])
def test_aggregates_combine_in_hash_aggregates(stored, functions):
    settings = {"x": "time", "y": ["speed"], "aggregation": {"method": "interval", "every": "1s", "functions": functions}}
    text = plan(process(stored, Job.from_dict(settings)))
    assert "partial_" in text and "SortAggregate" not in text and text.count("Exchange") == 1


def test_every_nth_has_no_single_partition_window(skewed):
    kept = every_nth(skewed, 5, [], ["x", "pos"], 30)
    assert "SinglePartition" not in plan(kept)


def jobs_of(spark, build):
    """How many jobs *build* runs, and its result."""
    context, group = spark.sparkContext, f"jobs-{random.random()}"
    context.setJobGroup(group, "counted")
    try:
        return build(), len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_series_bounds_and_batches_need_no_job_before_they_run(spark, skewed):
    from seriesmill.plans import export as X

    points = Job.from_dict({"x": "x", "y": ["v"], "aggregation": {"method": "target_points", "points": 9, "functions": ["mean"]}})
    relative = points.override(range_mode="relative", ranges=[[5, 700]])
    for build in (
        lambda: process(skewed, points, by=["series"]),
        lambda: process(skewed, relative, by=["series"]),
        lambda: X.export_lines(skewed.withColumn("source", F.coalesce("series", F.lit("none"))), points),
    ):
        df, jobs = jobs_of(spark, build)
        assert jobs == 0 and df.count() > 9


@pytest.mark.parametrize("functions", [["first", "last"], ["min", "max", "first"]])
def test_ends_of_texts_need_no_sorting_aggregate(skewed, functions):
    job = Job.from_dict({"x": "x", "y": ["state"], "aggregation": {"method": "interval", "every": 100, "functions": functions}})
    got = process(skewed, job, by=["series"])
    assert "SortAggregate" not in plan(got)
    want = {}
    for series, rows in series_of(skewed).items():
        for r in rows:
            want.setdefault((series, r.x // 100 * 100), []).append(r.state)
    pick = {"first": lambda v: v[0], "last": lambda v: v[-1], "min": lambda v: min((t for t in v if t), default=None), "max": lambda v: max((t for t in v if t), default=None)}
    assert {(r.series, r.x): tuple(r[f"state_{f}"] for f in functions) for r in got.collect()} == {k: tuple(pick[f](v) for f in functions) for k, v in want.items()}


def test_envelope_needs_no_sorting_aggregate(spark, skewed):
    got = D.envelope(skewed.withColumnRenamed("series", "unit"), ["unit"], F.floor(F.col("x") / 50), F.col("x").cast("double"), ["v", "pos"])
    assert "SortAggregate" not in plan(got)
    groups = {}
    for series, rows in series_of(skewed).items():
        for r in rows:
            for name in ("v", "pos"):
                groups.setdefault((series, name, r.x // 50), []).append((float(r[name]), float(r.x)))
    want = []
    for (series, name, _), pairs in groups.items():
        low, high = min(pairs), min((-y, x) for y, x in pairs)
        ends = [(low[1], low[0]), (high[1], -high[0])]
        want += [(series, name, *end) for end in (ends if ends[0][0] <= ends[1][0] else ends[::-1])]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
