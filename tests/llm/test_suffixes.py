import random
import re
import time
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import suffixes

SCHEMA = "doc_id long, text string, print string, n int"


def brute(rows, length):
    """Removed bytes per (id, text), by a table of all strings."""
    docs = sorted({(i if i is not None else 1 << 70, t or "") for i, t, *_ in rows}, key=lambda d: d[0])
    seen, out = {}, {}
    for doc, (i, t) in enumerate(docs):
        data = t.encode()
        flags = np.zeros(len(data), dtype=bool)
        for at in range(len(data) - length + 1):
            if seen.setdefault(data[at : at + length], (doc, at)) != (doc, at):
                flags[at : at + length] = True
        out[i if i < 1 << 70 else None, t] = flags
    return out


def documents(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé ") for _ in range(draw.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(draw.randint(10, 80)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [text(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            parts += [draw.choice(shared), text(draw.randint(0, 20))]
        rows.append((1000 - 3 * i, "".join(parts), "x", 1))
    rows += [(2000 + i, rows[i][1], "copy", 1) for i in range(10)]
    rows += [(3000, "ab" * 400, "", 1), (3001, "a" * 500, "", 1), (3002, "a" * 99, "", 1), (3003, None, None, None), (3004, "", "", 1), (3005, "x" + "a" * 100, "", 1)]
    rows += [(3006, "Thsh " * 300, "", 1), (3007, "Thsh " * 100 + "end", "", 1), rows[5], rows[5], (None, rows[3][1] + "tail", "", 1)]
    return rows


@pytest.mark.parametrize("seed, hot, block", [(1, 2000, 300_000), (2, 3, 500)])
def test_spans_match_brute_force(spark, seed, hot, block):
    rows, length = documents(seed), 40
    want = brute(rows, length)
    got = suffixes.repeated(spark.createDataFrame(rows, SCHEMA).repartition(4), length=length, hot=hot, block=block, keep=("print",)).collect()
    assert len(got) == len(rows)
    for r in got:
        flags = np.zeros(len(r.text), dtype=bool)
        for a, b in r.spans:
            assert not flags[max(0, a - 1) : b + 1].any()
            flags[a:b] = True
        assert (flags == want[r.id, bytes(r.text).decode()]).all(), r.id


def test_whole_length_and_several_batches(spark):
    draw = random.Random(3)
    base = "".join(draw.choice("abcdefgh ") for _ in range(3000))
    rows = [(i, base[(i * 37) % 2000 :][: draw.randint(50, 900)] + str(i), "", 1) for i in range(60)]
    want = brute(rows, 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = suffixes.repeated(spark.createDataFrame(rows, SCHEMA).repartition(3), hot=5, block=400).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in got:
        flags = np.zeros(len(r.text), dtype=bool)
        for a, b in r.spans:
            flags[a:b] = True
        assert (flags == want[r.id, bytes(r.text).decode()]).all()


def test_cover_and_order():
    assert suffixes.shifts().shape == (32, 32)
    draw = np.random.default_rng(2)
    data = np.concatenate([draw.choice(np.frombuffer(b"ab", dtype=np.uint8), 300)] + [np.frombuffer(b"abcabcabc" * 30, dtype=np.uint8)] * 4)
    text = suffixes.padded(data, 400)
    positions = np.arange(len(data) - 130)
    order, _ = suffixes.sorted_suffixes(text, positions, np.zeros(len(positions), dtype=np.int64), suffixes.cover_ranks(text, len(data) + 32, 100))
    strings = [bytes(data[p : p + 100]) for p in order]
    assert strings == sorted(strings)


def test_marked_starts_keep_the_first():
    rows = pa.array([b"x" * 10 + b"0123456789" * 5, b"y" * 10 + b"0123456789" * 5])
    row, start = suffixes.marked_starts(rows, np.array([4, 4]), np.array([7, 3]), np.array([30, 30]), 31)
    assert set(row.tolist()) == {0} and min(start) == 10


def test_query_and_empty_table(spark):
    assert suffixes.repeated(spark.createDataFrame([], SCHEMA)).count() == 0
    got = suffixes.op5_suffix_dedup(spark, "/root/testdata/sf0.001")
    assert got.filter(F.length("kept_sha256") != 64).count() == 0 and got.count() == 200


def test_many_rows_without_id_share_a_line(spark):
    """Texts that 31 bits cannot tell apart: each keeps its own ends, and one of them the line."""
    line = "Permission is granted to use this text for any purpose, provided that this notice stays with it, says the line. "
    own = F.lpad(F.hex(F.xxhash64("id")), 16, "0")
    docs = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(own, F.lit("\n" + line + "\n"), own).alias("text"))
    spans = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.begin)")
    found = suffixes.repeated(docs).select(F.col("id"), F.length("text").alias("size"), F.size("spans").alias("spans"), spans.alias("removed"))
    sizes = found.groupBy("id", "size", (F.col("removed") > 0).alias("cut")).agg(F.count("*").alias("rows"), F.max("spans").alias("spans"), F.min("removed").alias("least"), F.max("removed").alias("most"))
    got = {r.cut: r for r in sizes.collect()}
    whole = 32 + len(line) + 2
    assert got[False].rows <= 16 and got[False].rows + got[True].rows == 200_000 and got[True].id is None and got[True].size == whole
    assert got[True].spans == 1 and got[True].least >= 100 and got[True].most < whole - 16


def test_equal_strings_of_hot_minimizers_are_cut_to_the_earliest_of_a_task(monkeypatch):
    """Whatever the order of the documents and however little a task remembers, what goes without text starts later than an equal string."""
    import zstandard

    passage = b"0123456789abcdefghij" * 3
    docs = [5, 9, 2, 7, 3]
    listed = [{"key": 1, "pos": (k << 32) + 4, "n": 21, "state": suffixes.SINGLE} for k in range(5)]
    kind = pa.struct([("key", pa.int64()), ("pos", pa.int64()), ("n", pa.int32()), ("state", pa.int32())])
    packed = [zstandard.ZstdCompressor().compress(b"head" + passage + b"tail") for _ in docs]
    batch = pa.RecordBatch.from_arrays([pa.array(docs), pa.array(packed), pa.array([[x] for x in listed], pa.list_(kind))], ["doc", "packed", "listed"])
    for seen in (1 << 16, 7):
        monkeypatch.setattr(suffixes, "SEEN", seen)
        out = pa.Table.from_batches(list(suffixes._cut(40)([batch]))).to_pylist()
        starts = {}
        for row in out:
            for k in range(row["n"]):
                starts.setdefault(row["doc"], []).append(row["pos"] + k)
        assert starts == {doc: [(at << 32) + 4 + k for k in range(21)] for at, doc in enumerate(docs)}
        for row in out:
            if not row["text"]:
                assert any(len(o["text"]) == 40 and (o["doc"], o["pos"]) < (row["doc"], row["pos"]) for o in out)
        if seen > 7:
            assert sum(len(r["text"]) > 0 for r in out) == 40 and [r["n"] for r in out if not r["text"]] == [1, 21, 1, 21, 21]


def shuffle_files(spark):
    names = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", names))


def test_text_of_a_hot_short_phrase_is_not_dealt_out(spark, tmp_path, monkeypatch):
    """A phrase of 52 bytes in all documents repeats no 100 bytes, so none of the text around it is cut out; a passage of some documents is."""
    draw = random.Random(4)
    own = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    passage = own(170)
    rows = [(i, f"{own(300)}\nReleased under the MIT License, see the file LICENSE\n{own(200)}{passage if i % 100 == 7 else ''}{own(90)}", "", 1) for i in range(400)]
    real = suffixes._mark

    def counted(length, block):
        inner = real(length, block)

        def run(batches):
            def seen():
                for batch in batches:
                    size = sum(len(x) for x in batch.column(4).to_pylist())
                    (tmp_path / uuid.uuid4().hex).write_text(str(size))
                    yield batch

            return inner(seen())

        return run

    monkeypatch.setattr(suffixes, "_mark", counted)
    want = brute(rows, 100)
    for r in suffixes.repeated(spark.createDataFrame(rows, SCHEMA).repartition(4), hot=20).collect():
        flags = np.zeros(len(r.text), dtype=bool)
        for a, b in r.spans:
            flags[a:b] = True
        assert (flags == want[r.id, bytes(r.text).decode()]).all(), r.id
    assert 4 * 170 <= sum(int(x.read_text()) for x in tmp_path.iterdir()) < 20_000


@pytest.mark.parametrize("hot", [2, 5, 2000])
def test_parts_of_runs_keep_all_that_repeats(hot):
    """Repeats at every distance from the minimizer, runs of large keys in several batches: what is left gives all starts that repeat."""
    draw = random.Random(hot)
    base = "".join(draw.choice("abcdefgh ") for _ in range(1500))
    texts = [(base[draw.randint(0, 1300) :][: draw.randint(60, 400)] + str(i)).encode() for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array([0] * 40, pa.int64()), pa.array(texts)], ["doc", "print", "text"])
    length, gram = 50, 16
    rows = pa.Table.from_batches(list(suffixes._find(length, gram)([batch])))

    def passed(rows, shift, pick):
        rows = rows.sort_by("key")
        out = list(suffixes._shared(hot, shift, pick)(rows.to_batches(max_chunksize=3)))
        return pa.Table.from_batches(out, schema=out[0].schema) if out else rows.slice(0, 0)

    met = passed(rows, suffixes.PART, suffixes._met)
    state = met["state"].to_numpy()
    again = passed(met.filter(pa.array(state == suffixes.SPLIT)), 0, suffixes._again)
    starts = lambda rows: sorted((r["doc"], (r["pos"] & 0xFFFFFFFF) + k) for r in rows.to_pylist() for k in range(r["n"]))

    def later(listed):
        seen = {}
        return {(doc, at) for doc, at in listed if seen.setdefault(texts[doc][at : at + length], (doc, at)) != (doc, at)}

    marked = set(starts(met.filter(pa.array(state == suffixes.MARKED))))
    left = sorted(starts(met.filter(pa.array(state == suffixes.NORMAL))) + starts(again))
    want = later((doc, at) for doc, text in enumerate(texts) for at in range(len(text) - length + 1))
    assert want and marked | later(left) == want and set(again["state"].to_pylist()) <= {suffixes.NORMAL, suffixes.SINGLE}
    assert (hot < 2000) == (suffixes.SPLIT in state)


def test_shuffle_files_go_with_each_written_table(spark):
    """When the plan of the result is there, the shuffles of the tables written for it have left the disk, without a collection of garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(name, None)
    found = suffixes.repeated(spark.createDataFrame(documents(5), SCHEMA).repartition(4), length=40)
    for _ in range(40):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.25)
    assert shuffle_files(spark) <= before and spark.conf.get(name, None) == setting
    assert found.count() == len(documents(5))
