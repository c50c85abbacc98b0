import datetime as dt
import os
import pathlib
import random

import pytest
from conftest import START
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill import Job, JobError
from seriesmill.functions import cells
from seriesmill.plans import export as X
from seriesmill.sources import csv as C
from seriesmill.sources import files
from seriesmill.sources.schema import default_x, default_y, roles


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def job(**settings):
    return Job.from_dict({"x": "time", "y": ["speed"], **settings})


def lines(df, settings, **options):
    result = X.export_rows(df, settings, **options)
    got = X.csv_lines(X.csv_values(result), result)
    order = [c for c in got.columns if c.startswith("_order")]
    return [X.header_line(settings, result.names), *[r.line for r in got.orderBy(*order).collect()]]


# -- roles ---------------------------------------------------------------------------------


def test_roles(telemetry):
    schema = telemetry.drop("pos").withColumn("tags", F.array(F.lit(1))).schema
    assert default_x(schema) == "time" and default_y(schema, "time") == ["speed", "temp"]
    kinds = {name: (kind, x, y) for name, _, kind, x, y in roles(schema)}
    assert kinds["time"] == ("datetime", True, False) and kinds["on"] == ("boolean", False, True)
    assert kinds["label"] == ("text", True, True) and kinds["tags"] == ("other", False, False)
    plain = T.StructType().add("a", "double").add("t", "long").add("s", "string")
    assert default_x(plain) == "t" and default_y(plain, "t") == ["a", "s"]
    assert default_x(T.StructType().add("total", "double")) == "__row_index__"
    dates = T.StructType().add("begin", "timestamp_ntz").add("utc_time", "timestamp_ntz")
    assert default_x(dates) == "utc_time"


# -- CSV input ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "name, text, separator, comma",
    [
        ("point.csv", "depth,n\n-4.75,12\n.5,13\n", ",", False),
        ("comma.csv", "depth;n\n-4,75;12\n+0,5;13\n", ";", True),
        ("both.csv", "depth;n\n-4.75;12\n0,5;13\n", ";", False),
        ("tabs.csv", "at\tdepth\tn\nx\t0,25\t1\n", "\t", True),
        ("bars.csv", "k|l|m|n\n1,5|2,x|3|4\n7|8|9|0\n", "|", True),
        ("inner.csv", '"one;two;three",k\n"a;b",1\nc,"d;e;f"\n', ",", False),
        ("LOUD.TSV", "k;l\tm\n1;2\t3\n", "\t", False),
        ("marked.csv", "\ufeffk;l\n\"  7,25\";  \"1,5\" \n", ";", True),
    ],
)
def test_dialects(spark, tmp_path, name, text, separator, comma):
    write(tmp_path, name, text)
    row = C.file_dialects(spark, files.find_inputs(spark, [str(tmp_path)])).first()
    assert (row.separator, row.decimal_comma, row.error) == (separator, comma, None)


def test_dialect_of_many_and_broken_files(spark, tmp_path):
    write(tmp_path, "long.csv", "a;b\n" + "1,25;2\n" * 20_000)
    write(tmp_path, "empty.csv", "")  # Spark's file listing leaves empty files out
    (tmp_path / "blob.csv").write_bytes(b"\x00\x01binary")
    got = {os.path.basename(r.source): r for r in C.file_dialects(spark, files.find_inputs(spark, [str(tmp_path)])).collect()}
    assert got["long.csv"].separator == ";" and got["long.csv"].decimal_comma
    assert set(got) == {"long.csv", "blob.csv"} and "neither" in got["blob.csv"].error


def test_dialect_counts_all_lines(spark, tmp_path):
    write(tmp_path, "turn.csv", "a;b,c\n" + "1;2,5\n" * 60 + "1,2;3;4,x\n")  # the comma stays even, the semicolon does not
    write(tmp_path, "late.csv", "a;b\n" + "1;2\n" * 60 + "1;2,5\n")
    write(tmp_path, "both.csv", "a;b\n" + "1;2,5\n" * 60 + "1;2.5\n")
    got = {os.path.basename(r.source): (r.separator, r.decimal_comma) for r in C.file_dialects(spark, files.find_inputs(spark, [str(tmp_path)])).collect()}
    assert got["late.csv"] == (";", True) and got["both.csv"] == (";", False) and got["turn.csv"][0] == ","


def test_types_and_missing_cells(spark, tmp_path):
    text = "﻿time,speed,count,mode,ok\n2024-01-01T00:00:00.000000,1.5,1,RUN,true\n2024-01-01T00:00:00.100000,NA,2,,false\n"
    path = write(tmp_path, "data.csv", text)
    types, rows = C.inspect_csv(spark, path, ",", False)
    assert types == {"time": "datetime", "speed": "float", "count": "integer", "mode": "text", "ok": "boolean"} and rows == 2
    got = C.read_csv(spark, path, ",", False, types).orderBy("pos").collect()
    assert got[1].time == dt.datetime(2024, 1, 1, 0, 0, 0, 100000) and got[1].speed is None and got[1]["mode"] is None
    assert got[0].ok is True and got[0]["count"] == 1


def test_late_values_widen_types(spark, tmp_path):
    n = 10_010
    body = [f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d};{i};{i},5;true;2024-01-01" for i in range(n)]
    body += ["2024-01-02 00:00:00;7,25;1;maybe;2024-01-02 00:00:00", "yesterday;8;2;false;2024-01-03"]
    path = write(tmp_path, "late.csv", "t;n;v;flag;d\n" + "\n".join(body) + "\n")
    types, rows = C.inspect_csv(spark, path, ";", True)
    assert types == {"t": "text", "n": "float", "v": "float", "flag": "text", "d": "text"} and rows == n + 2
    got = C.read_csv(spark, path, ";", True, types).orderBy("pos").collect()
    assert got[-2].n == 7.25 and got[-1].v == 2.0 and got[5].pos == 5


def test_rows_of_a_split_file_keep_their_numbers(spark, tmp_path):
    path = write(tmp_path, "many.csv", "i\n" + "\n".join(str(i) for i in range(50_000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = C.read_csv(spark, path, ",", False, {"i": "integer"})
        assert C.read_lines(spark, path).rdd.getNumPartitions() > 3  # one file, many tasks
        assert df.filter("i != pos").count() == 0 and df.count() == 50_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def quoted(cell):
    return '"' + cell.replace('"', '""') + '"' if any(c in cell for c in '",\n\r') else cell


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_records_with_line_breaks_in_many_blocks(spark, tmp_path, small_blocks, end):
    draw = random.Random(len(end))
    bits = ["a", "b c", "\n", "\r\n", "\r", '"', ",", "\n\n", '""', "é", " "]
    want = {}
    for name in ("one.csv", "two.csv"):
        rows = [["".join(draw.choice(bits) for _ in range(draw.choice([0, 1, 4, 60]))) + "." for _ in range(3)] for _ in range(150)]
        blank = lambda: end if draw.random() < 0.2 else ""
        body = "".join(",".join(map(quoted, row)) + end + blank() for row in rows)
        write(tmp_path, name, "\ufeffk,l,m" + end + body)
        want[name] = [tuple(row) for row in rows]
    types = {"k": "text", "l": "text", "m": "text"}
    df = C.read_csv(spark, str(tmp_path), types=types)
    got = {}
    for r in df.collect():
        got.setdefault(os.path.basename(r.source), {})[r.pos] = (r.k, r.l, r.m)
    for name, rows in want.items():
        assert got[name] == dict(enumerate(rows))
    assert C.misfits(spark, str(tmp_path), types).count() == 0


def test_row_numbers_hold_when_the_blocks_change_after_the_plan(spark, tmp_path):
    path = write(tmp_path, "many.csv", "i,t\n" + "".join(f'{i},"x\ny"\n' for i in range(20_000)))
    df = C.read_csv(spark, path, types={"i": "integer", "t": "text"})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("9000", "50000", "1g"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            again = df.withColumn("same", F.col("i") == F.col("pos"))  # a plan of its own
            assert again.filter("same AND t = 'x\ny'").count() == 20_000 and again.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_misfits_are_reported(spark, tmp_path):
    write(tmp_path, "a.csv", 'n,t\n1,x\nnope,y\n2\n3,z,more\nNA,w\n')
    write(tmp_path, "b.csv", 'n,t\n1,x\n2,"never closed\n3,y\n4,z\n')
    write(tmp_path, "c.csv", "n,other\n1,x\n")
    types = {"n": "integer", "t": "text"}
    got = {(os.path.basename(r.source), r.pos, r.column, r.cell, r.reason) for r in C.misfits(spark, str(tmp_path), types).collect()}
    assert got == {
        ("a.csv", 1, "n", "nope", "the cell is no integer"),
        ("a.csv", 2, None, "2", C.UNEVEN), ("a.csv", 3, None, "3,z,more", C.UNEVEN),
        ("b.csv", 1, None, '2,"never closed', C.UNCLOSED), ("b.csv", 1, None, "3,y", C.UNCLOSED), ("b.csv", 1, None, "4,z", C.UNCLOSED),
        ("c.csv", -1, None, "n,other", C.RENAMED),
    }
    rows = sorted((r.pos, r.n, r.t) for r in C.read_csv(spark, str(tmp_path / "a.csv"), types=types).collect())
    assert rows == [(0, 1, "x"), (1, None, "y"), (2, 2, None), (3, 3, "z"), (4, None, "w")]


def test_a_folder_of_several_dialects_is_one_frame(spark, tmp_path):
    write(tmp_path, "us.csv", "day,v,k\n2024-02-01,1.5,a\n2024-02-02,2.5,b\n")
    write(tmp_path, "eu.csv", "day;v;k\n2024-02-03;7;c\n2024-02-04;8,25;\"d\nd\"\n")
    write(tmp_path, "whole.tsv", "day\tv\textra\n2024-02-05\t9\tyes\n")
    write(tmp_path, "more.csv", "day,v,k\nsoon,3,e\n")
    (tmp_path / "blob.csv").write_bytes(b"\x00\x01binary")
    df, left = C.read_csv_folder(spark, files.find_inputs(spark, [str(tmp_path)]))
    assert dict(df.dtypes) == {"source": "string", "pos": "bigint", "day": "string", "v": "double", "k": "string", "extra": "string"}
    got = {(os.path.basename(r.source), r.pos, r.day, r.v, r.k, r.extra) for r in df.collect()}
    assert got == {
        ("us.csv", 0, "2024-02-01", 1.5, "a", None), ("us.csv", 1, "2024-02-02", 2.5, "b", None), ("more.csv", 0, "soon", 3.0, "e", None),
        ("eu.csv", 0, "2024-02-03", 7.0, "c", None), ("eu.csv", 1, "2024-02-04", 8.25, "d\nd", None), ("whole.tsv", 0, "2024-02-05", 9.0, None, "yes"),
    }
    assert [os.path.basename(r.source) for r in left.collect()] == ["blob.csv"]


def test_csv_job(spark, tmp_path):
    body = [f"{START + dt.timedelta(seconds=i)};{i},5;{'on' if i % 2 else 'off'}" for i in range(20)]
    path = write(tmp_path, "eu.csv", "wann;tiefe;zustand\n" + "\n".join(body) + "\n")
    settings = {"x": "wann", "y": ["tiefe", "zustand"], "aggregation": {"method": "interval", "every": "10s", "functions": ["max"]}}
    got = lines(C.read_csv(spark, path, ";", True), Job.from_dict(settings))
    assert got == ["wann,tiefe,zustand", "2024-01-01T00:00:00.000000,9.5,on", "2024-01-01T00:00:10.000000,19.5,on"]


# -- files ---------------------------------------------------------------------------------------


def test_inventory_and_row_numbers(spark, telemetry, tmp_path):
    for name, low in (("b", 0), ("a", 400)):
        telemetry.filter(F.col("pos").between(low, low + 199)).drop("pos").coalesce(1).write.parquet(str(tmp_path / name))
    (tmp_path / "broken.parquet").write_text("nope")
    write(tmp_path, "notes.txt", "hello")
    write(tmp_path, "UPPER.CSV", "a\n1\n")
    flat = files.find_inputs(spark, [str(tmp_path)])
    assert sorted(os.path.basename(r.path) for r in flat.collect()) == ["UPPER.CSV", "broken.parquet"]
    deep = files.find_inputs(spark, [str(tmp_path), str(tmp_path / "UPPER.CSV")], recursive=True)
    assert deep.count() == 4
    facts = files.inventory(deep).collect()
    assert sorted((r.format, r.rows) for r in facts if r.rows is not None) == [("parquet", 200), ("parquet", 200)]
    assert sorted((r.format, bool(r.error)) for r in facts if r.rows is None) == [("csv", False), ("parquet", True)]
    df = files.read_parquet(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert df.filter("pos = 0").count() == 2
    whole = files.number_across_sources(df)
    assert sorted(r.pos for r in whole.select("pos").collect()) == list(range(400))
    assert whole.filter("speed = 400").first().pos == 0  # folder a comes first


# -- text output ------------------------------------------------------------------------------------


def test_default_lines(telemetry):
    got = lines(telemetry, job(y=["speed", "temp"]))
    assert len(got) == 601 and got[0] == "time,speed,temp" and got[1] == "2024-01-01T00:00:00.000000,0.0,20.0"


@pytest.mark.parametrize("fmt, text", [("epoch_s", "1704067200.1"), ("epoch_ms", "1704067200100"), ("elapsed_s", "0.1")])
def test_time_formats(telemetry, fmt, text):
    assert lines(telemetry, job(csv={"time_format": fmt}))[2].split(",")[0] == text


def test_custom_format(telemetry):
    csv = {
        "separator": ";", "decimal_comma": True, "float_precision": 1, "time_format": "custom", "datetime_format": "%H:%M:%S%.3f",
        "null_value": "NA", "rename": {"speed": "Speed [m/s]"},
    }
    got = lines(telemetry, job(y=["speed", "temp"], csv=csv, range_mode="relative", ranges=[[5, 5]]))
    assert got == ["time;Speed [m/s];temp", "00:00:05.000;50,0;NA"]


def test_quotes(telemetry, spark):
    got = lines(telemetry, job(csv={"quote_style": "always"}, ranges=[[None, "2024-01-01T00:00:00.1"]]))
    assert got[1:] == ['"2024-01-01T00:00:00.000000","0.0"', '"2024-01-01T00:00:00.100000","1.0"']
    df = spark.createDataFrame([(0, 1, 'say "hi", you'), (1, 2, ""), (2, 3, None)], "pos bigint, i int, s string")
    settings = {"x": "i", "y": ["s"]}
    assert lines(df, Job.from_dict(settings))[1:] == ['1,"say ""hi"", you"', '2,""', "3,"]
    assert lines(df, Job.from_dict({**settings, "csv": {"quote_style": "never"}}))[1] == '1,say "hi", you'
    assert lines(df, Job.from_dict({**settings, "csv": {"quote_style": "non_numeric"}}))[:2] == ['"i","s"', '1,"say ""hi"", you"']


def test_zoned_text(spark):
    df = spark.createDataFrame([(0, dt.datetime(2024, 7, 1, 10), 1.0)], "pos bigint, t timestamp_ntz, v double")
    df = df.withColumn("t", F.col("t").cast("timestamp"))
    assert lines(df, Job.from_dict({"x": "t", "y": ["v"]}), zone="Europe/Berlin")[1] == "2024-07-01T12:00:00.000000+0200,1.0"


def test_float_texts(spark):
    values = [0.0, -0.0, 1.5, 12345678.9, 1e15, 123456789012345680.0, 1e16, 1e20, 0.00012, 1e-5, 1.5e-7, 0.1 + 0.2, float("nan"), float("inf"), -float("inf"), 1e22]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.t for r in df.select("i", cells.float_text(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == [
        "0.0", "-0.0", "1.5", "12345678.9", "1000000000000000.0", "1.2345678901234568e17", "1e16", "1e20", "0.00012", "0.00001",
        "1.5e-7", "0.30000000000000004", "NaN", "inf", "-inf", "1e22",
    ]
    fixed = [r.t for r in df.filter("i in (2, 3, 11)").select("i", cells.fixed_text(F.col("v"), 2).alias("t")).orderBy("i").collect()]
    assert fixed == ["1.50", "12345678.90", "0.30"]
    ties = spark.createDataFrame([(v,) for v in (2.675, 0.125, 0.375, 1e10 + 0.5)], "v double")
    assert [r[0] for r in ties.select(cells.fixed_text(F.col("v"), 2)).collect()] == [f"{v:.2f}" for v in (2.675, 0.125, 0.375, 1e10 + 0.5)]


def test_headers(telemetry):
    with pytest.raises(JobError, match="would be called"):
        lines(telemetry, job(y=["speed", "temp"], csv={"rename": {"temp": "speed"}}))
    assert lines(telemetry, Job.from_dict({"x": "__row_index__", "y": ["speed"]}))[0] == "row_index,speed"


def test_preview(telemetry):
    got = [r.line for r in X.preview(telemetry, job(y=["speed", "rpm"]), rows=3).orderBy("line_no").collect()]
    assert got == [
        "time,speed,rpm", "2024-01-01T00:00:00.000000,0.0,0", "2024-01-01T00:00:00.100000,1.0,2", "2024-01-01T00:00:00.200000,2.0,4",
    ]


# -- paths and batches ----------------------------------------------------------------------------------


def test_output_paths(spark):
    def path(template, source, label=None, base=None):
        column = X.output_path(template, F.lit(source), None if label is None else F.lit(label), base)
        return spark.range(1).select(column).first()[0]

    assert path("{parent}/{stem}_{range}.csv", "/d/run/telemetry.parquet", "a b") == "/d/run/run/telemetry_a_b.csv"
    assert path("{dir}/x/{name}", "/d/a.b.csv") == "/d/x/a.b.csv" and path("{stem}.csv", "/d/.data", None, "/o") == "/o/.data.csv"
    assert path("{stem}_{range}", "/d/a.csv", "///") == "/d/a_///"
    assert X.range_template("out/{stem}.csv") == "out/{stem}_{range}.csv" and X.range_template("v1.0/out") == "v1.0/out_{range}"
    for bad in ("{nope}.csv", "{stem", "{}"):
        with pytest.raises(JobError):
            path(bad, "/d/a.csv")
    sources = spark.createDataFrame([("/d/a.csv",)], "source string")
    assert "overwrite the source" in X.planned_outputs(sources, job(output={"path": "{name}"})).first().error
    same = job(ranges=[[0, 1, "a b"], [2, 3, "a/b"]], output={"split_ranges": True})
    with pytest.raises(JobError):
        X.planned_outputs(sources, same)


def test_own_outputs(spark):
    sources = spark.createDataFrame([("/d/dive.csv",), ("/d/dive_export.csv",), ("/d/other.csv",)], "source string")
    keep, skipped = X.split_own_outputs(sources, job())
    assert {r.source for r in keep.collect()} == {"/d/dive.csv", "/d/other.csv"} and skipped.count() == 1
    assert X.split_own_outputs(sources, job(output={"path": "/out/{stem}.csv"}))[1].count() == 0


def both_sources(telemetry):
    named = telemetry.withColumn("source", F.lit("/d/one.parquet"))
    return named.unionByName(telemetry.filter("pos < 15").withColumn("source", F.lit("/d/two.parquet")))


def read_parts(folder, output):
    """The concatenated parts of one output, as a user would join them."""
    found = [os.path.join(root, name) for root, _, names in os.walk(folder) for name in names if name.startswith("part-")]
    escaped = output.replace("/", "%2F")
    return b"".join(open(p, "rb").read() for p in sorted(found) if f"output={escaped}" in p)


def test_batch(telemetry, tmp_path):
    settings = job(
        range_mode="relative", ranges=[[0, 0.2, "start"], [10, 10.1]], output={"path": "/out/{stem}.csv", "split_ranges": True},
        csv={"include_bom": True, "line_terminator": "crlf"},
    )
    folder = str(tmp_path / "batch")
    batch = X.write_batch(both_sources(telemetry), settings, folder, quarantine={"/d/bad.parquet": "no such column"})
    got = {(r.source, r.range): (r.output, r.rows, r.status) for r in batch.manifest.collect()}
    assert got[("/d/one.parquet", "start")] == ("/out/one_start.csv", 3, "written")
    assert got[("/d/one.parquet", "2")][1] == 2 and got[("/d/two.parquet", "2")][1] == 0
    assert got[("/d/bad.parquet", None)][2] == "failed" and len(got) == 5
    text = "﻿time,speed\r\n2024-01-01T00:00:10.000000,100.0\r\n2024-01-01T00:00:10.100000,101.0\r\n"
    assert read_parts(folder, "/out/one_2.csv") == text.encode()
    assert read_parts(folder, "/out/two_2.csv") == "﻿time,speed\r\n".encode()  # an empty range still has its header
    with pytest.raises(JobError):
        X.write_batch(both_sources(telemetry), settings, folder, quarantine={"/d/bad.parquet": "x"}, fail_fast=True)


def test_batch_in_order_and_resumed(telemetry, tmp_path):
    settings = job(output={"path": "{stem}_export.csv"}, csv={"time_format": "elapsed_s"})
    df = both_sources(telemetry).repartition(6)
    done = df.sparkSession.createDataFrame([("/d/two_export.csv",)], "output string")
    batch = X.write_batch(df, settings, str(tmp_path / "b"), skip=done)
    assert {r.source: (r.rows, r.status) for r in batch.manifest.collect()} == {"/d/one.parquet": (600, "written"), "/d/two.parquet": (None, "skipped")}
    body = read_parts(str(tmp_path / "b"), "/d/one_export.csv").decode().splitlines()
    assert body[0] == "time,speed" and body[2] == "0.1,1.0" and len(body) == 601
    assert [float(line.split(",")[1]) for line in body[1:]] == [float(i) for i in range(600)]


def test_misfits_and_dry_run(telemetry):
    bad = X.misfits(job(), {"a": telemetry.schema, "b": telemetry.drop("speed").schema})
    assert list(bad) == ["b"]
    split = job(range_mode="relative", ranges=[[0, 10, "a"], [20, None, "b"]], output={"split_ranges": True})
    got = {r.output: r.estimate for r in X.dry_run(both_sources(telemetry), split).collect()}
    assert got["/d/one_export_a.csv"] == 100 and set(got) == {f"/d/{s}_export_{r}.csv" for s in ("one", "two") for r in "ab"}


def test_csv_round_trip(spark, telemetry, tmp_path):
    settings = job(y=["speed", "rpm", "on", "label", "temp"])
    X.write_csv(X.export_rows(telemetry, settings), str(tmp_path / "round"))
    types, rows = C.inspect_csv(spark, str(tmp_path / "round"), ",", False)
    assert types == {"time": "datetime", "speed": "float", "rpm": "integer", "on": "boolean", "label": "text", "temp": "float"} and rows == 600
    back = C.read_csv(spark, str(tmp_path / "round")).select("time", "speed", "rpm", "on", "label", "temp")
    same = telemetry.select("time", "speed", F.col("rpm").cast("bigint"), "on", "label", "temp")
    assert back.exceptAll(same).count() == 0 and same.exceptAll(back).count() == 0


def test_resume_keeps_earlier_outputs_and_counts_rows(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, "x\ny", "/d/a.csv"), (1, 2, "z", "/d/a.csv"), (0, 3, "w", "/d/b c.csv")], "pos bigint, i int, s string, source string")
    settings, folder = Job(x="i", y=["s"]), str(tmp_path / "out")
    first = X.write_batch(df, settings, folder)
    rows = {r.output: (r.rows, r.status) for r in first.manifest.collect()}
    assert rows == {"/d/a_export.csv": (2, "written"), "/d/b c_export.csv": (1, "written")}
    before = {r.output: r["count"] for r in spark.read.text(folder).groupBy("output").count().collect()}
    done = first.manifest.filter("output LIKE '%a_export.csv'").select("output")
    second = X.write_batch(df, settings, folder, skip=done)
    assert {r.output: r.status for r in second.manifest.collect()} == {"/d/a_export.csv": "skipped", "/d/b c_export.csv": "written"}
    assert {r.output: r["count"] for r in spark.read.text(folder).groupBy("output").count().collect()} == before


@pytest.mark.parametrize("csv, text", [({"quote_style": "non_numeric"}, '"i","s"\n1,"a"\n2,"b"\n'), ({"quote_style": "never", "include_bom": True}, "\ufeffi,s\n1,a\n2,b\n")])
def test_own_quote_styles_and_mark_reach_the_file(spark, tmp_path, csv, text):
    df = spark.createDataFrame([(0, 1, "a"), (1, 2, "b")], "pos bigint, i int, s string")
    X.write_csv(X.export_rows(df, Job(x="i", y=["s"], csv=csv)), str(tmp_path / "o"))
    parts = sorted(p for p in os.listdir(tmp_path / "o") if p.startswith("part-"))
    assert "".join((tmp_path / "o" / p).read_text(encoding="utf-8") for p in parts) == text


def test_late_times_as_milliseconds(spark):
    df = spark.sql("SELECT 0L AS pos, TIMESTAMP_NTZ '9999-12-31 23:59:59.999999' AS t, 1 AS v UNION ALL SELECT 1L, TIMESTAMP_NTZ '1969-12-31 23:59:59.999999', 2")
    values = X.csv_values(X.export_rows(df, Job(x="t", y=["v"], csv={"time_format": "epoch_ms"}))).collect()
    assert sorted(r.t for r in values) == [-1, 253402300799999]


def test_folders_with_spaces_have_one_name(spark, tmp_path):
    folder = tmp_path / "my dir+x"
    spark.range(3).write.parquet(str(folder / "a.parquet"))
    listed = {r.path for r in files.find_inputs(spark, [str(folder)], recursive=True).collect()}
    read = {r.source for r in files.read_parquet(spark, str(folder), recursive=True).select("source").distinct().collect()}
    assert read <= listed and read


def test_an_empty_file_is_no_broken_one(spark, tmp_path):
    spark.range(0).coalesce(1).write.parquet(str(tmp_path / "none"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "five"))
    (tmp_path / "torn.parquet").write_bytes(b"PAR1 and no more")
    facts = {os.path.basename(os.path.dirname(r.path)): (r.rows, bool(r.error)) for r in files.inventory(files.find_inputs(spark, [str(tmp_path)], recursive=True)).collect()}
    assert facts == {"none": (0, False), "five": (5, False), tmp_path.name: (None, True)}


def test_schema_groups(spark, tmp_path):
    for i in range(9):
        spark.range(3).select(F.col("id").cast("string" if i == 4 else "double").alias("v"), *([F.lit(1).alias("more")] if i == 7 else [])).coalesce(1).write.parquet(f"{tmp_path}/{i}.parquet")
    (tmp_path / "5b.parquet").write_text("nope")
    paths = [f"{tmp_path}/{i}.parquet" for i in range(9)] + [f"{tmp_path}/5b.parquet"]
    groups, broken = files.schema_groups(spark, paths)
    assert list(broken) == [paths[-1]] and "not a readable" in broken[paths[-1]]
    texts = [mine for schema, mine in groups if schema["v"].dataType == T.StringType()]
    assert texts == [[paths[4]]] and sorted(p for _, mine in groups for p in mine) == sorted(paths[:-1])
    whole = [files.read_parquet(spark, mine, schema=schema).count() for schema, mine in groups]
    assert sum(whole) == 27 and len(groups) <= 5


def test_a_batch_isolates_files_that_do_not_fit(spark, tmp_path):
    day = lambda i: dt.datetime(2024, 3, 1, 0, i)
    for name, rows, schema in (
        ("a", [(day(i), float(i)) for i in range(4)], "t timestamp_ntz, v double"), ("b", [(day(1), "up")], "t timestamp_ntz, v string"),
        ("c", [(day(2), 1)], "t timestamp_ntz, w int"), ("x/d", [(day(i), 9.0) for i in range(2)], "t timestamp_ntz, v double"),
        ("y/d", [(day(3), 8.0)], "t timestamp_ntz, v double"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        [part] = [p for p in os.listdir(f"{tmp_path}/in/{name}") if p.startswith("part-")]
        os.rename(f"{tmp_path}/in/{name}/{part}", f"{tmp_path}/in/{name}.parquet")
    write(tmp_path / "in", "e.csv", "t;v\n2024-03-01 00:00:00;1,5\n")
    (tmp_path / "in" / "f.parquet").write_text("nope")
    found = files.find_inputs(spark, [str(tmp_path / "in")], recursive=True).filter("path NOT RLIKE '/part-'")
    settings = Job.from_dict({"x": "t", "y": ["v"], "output": {"path": "/out/{stem}.csv"}})
    batch = X.write_batch_files(spark, found, settings, str(tmp_path / "out"))
    got = {r.source.split("/in/")[1]: (r.rows, r.status, (r.error or "")[:15]) for r in batch.manifest.collect()}
    assert got == {
        "a.parquet": (4, "written", ""), "b.parquet": (1, "written", ""), "e.csv": (1, "written", ""), "c.parquet": (None, "failed", "Column 'v' not "),
        "f.parquet": (None, "failed", "not a readable "), "x/d.parquet": (None, "failed", "another input w"), "y/d.parquet": (None, "failed", "another input w"),
    }
    assert read_parts(str(tmp_path / "out"), "/out/b.csv") == b"t,v\n2024-03-01T00:01:00.000000,up\n"
    assert read_parts(str(tmp_path / "out"), "/out/e.csv") == b"t,v\n2024-03-01T00:00:00.000000,1.5\n"
    with pytest.raises(JobError):
        X.write_batch_files(spark, found, settings, str(tmp_path / "out2"), fail_fast=True)


def test_stored_nanoseconds(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    moments = [0, 1, 1_700_000_000_123_456_789, -1]
    pq.write_table(pa.table({"t": pa.array(moments, pa.timestamp("ns")), "took": pa.array([1, 1500, None, -7], pa.duration("ms"))}), str(tmp_path / "n.parquet"))
    before = spark.conf.get("spark.sql.legacy.parquet.nanosAsLong")
    try:
        rows = files.read_parquet(spark, str(tmp_path), units={"t": "ns", "took": "duration ms"}).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", before)
    assert [r.t for r in rows] == [dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=n // 1000) for n in moments]
    assert [r.took for r in rows] == [None if n is None else dt.timedelta(milliseconds=n) for n in (1, 1500, None, -7)]
    with pytest.raises(ValueError):
        files.with_units(spark.range(1), {"id": "weeks"})


def test_outputs_move_to_their_paths(spark, telemetry, tmp_path):
    df = both_sources(telemetry).withColumn("source", F.concat(F.lit(f"{tmp_path}/in"), F.col("source")))
    sources = sorted(r.source for r in df.select("source").distinct().collect())
    settings = Job.from_dict({"x": "time", "y": ["speed"], "output": {"path": "{stem} +1%.csv"}})
    for _ in range(2):  # an earlier output is replaced
        placed = X.place_outputs(spark, X.write_batch(df, settings, str(tmp_path / "batch")))
        rows = {r.source: r for r in placed.manifest.collect()}
        assert sorted(rows) == sources and {r.status for r in rows.values()} == {"written"}
        for r in rows.values():
            assert spark.read.text(r.output).count() == r.rows + 1
            assert os.path.isdir(r.output)
    taken = rows[sources[0]].output
    (pathlib.Path(taken) / "notes.txt").write_text("mine")
    again = X.place_outputs(spark, X.write_batch(df, settings, str(tmp_path / "batch")))
    states = {r.source: (r.status, r.rows is None, r.error) for r in again.manifest.collect()}
    assert states[sources[0]] == ("failed", True, "something that is no output lies at its path")
    assert states[sources[1]][0] == "written" and (pathlib.Path(taken) / "notes.txt").read_text() == "mine"


def test_a_batch_works_out_paths_once_a_source(telemetry, tmp_path, monkeypatch):
    """A filter on planned paths must not find its way below the aggregate over all rows."""
    plans, plan_outputs = [], X.planned_outputs

    def spy(sources, *rest):
        planned = plan_outputs(sources, *rest)
        plans.append(planned.filter("error IS NULL")._jdf.queryExecution().optimizedPlan().toString())
        return planned

    monkeypatch.setattr(X, "planned_outputs", spy)
    rows = {r.source: r.rows for r in X.write_batch(both_sources(telemetry), job(output={"path": "{stem}.out"}), str(tmp_path / "b")).manifest.collect()}
    assert rows == {"/d/one.parquet": 600, "/d/two.parquet": 15}
    assert plans and not any("Aggregate" in plan for plan in plans)


def test_a_batch_over_files_of_a_split_table(spark, tmp_path, monkeypatch):
    from catalog import outputs

    rows = [(i, START + dt.timedelta(seconds=i), i % 50, ("view", "click", "purchase")[i % 3], i / 8, "{}") for i in range(3000)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    monkeypatch.setattr(outputs, "find_inputs", lambda *a: seen.append(files.find_inputs(*a)) or seen[0])
    conf = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "20000"}
    before = {name: spark.conf.get(name) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        got = {(r.name, r.rows, r.status) for r in outputs._batch_files(spark, str(tmp_path)).collect()}
        assert seen[0].count() > 6  # no kind passes through one task
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == {("view", 1000, "written"), ("click", 1000, "written"), ("other", 1000, "written"), ("texts", 2400, "written"), ("no", None, "failed"), ("broken", None, "failed")}
