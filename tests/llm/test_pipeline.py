import random

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import suffixes
from test_jaccard import shingles, similarity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small folder of documents and labels: clean, junk and toxic texts, copies, near copies and shared passages."""
    draw = random.Random(11)
    words = [f"word{i}" for i in range(400)] + ["Ünder", "naïve"]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    shared = text(70)
    rows, labels = [], []
    for i in range(600):
        kind = i % 6
        body = text(draw.randint(60, 200))
        if kind == 4:
            body = " ".join(w + "###" for w in body.split())
        if kind == 5:
            body = " ".join(w if draw.random() > 0.08 else draw.choice(["scum", "moron", "trash"]) for w in body.split())
        if kind == 3:
            body += "\n" + shared
        rows.append((i, body, "en" if i % 4 else None, f"s{i % 5}" if i % 50 else None, len(body)))
        if i % 5:
            labels.append((i, int(kind != 4), int(kind == 5)))
    rows += [(1000 + i, rows[6 * i][1], "en", "s1", 1) for i in range(20)]
    rows += [(1100 + i, rows[6 * i][1] + " end", "en", "s2", 1) for i in range(20)]
    rows += [rows[0], (None, text(80), "en", "s1", 1), (None, rows[6][1], "en", "s1", 1), (2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


@pytest.fixture(scope="module")
def stages(spark, corpus):
    folder, _ = corpus
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in pipeline.STAGES:
        out.append(pipeline.saved(stage(spark, out[-1], folder)))
    return out


def test_quality_stage_rejects_junk_and_toxic_texts_only(stages, corpus):
    kept = [r.doc_id for r in stages[1].collect()]
    clean = [i for i in range(600) if i % 6 < 4]
    assert set(clean) - set(kept) == set() and kept.count(0) == 2
    assert len([i for i in kept if i is not None and i < 600 and i % 6 >= 4]) <= 4
    assert stages[1].columns == list(pipeline.COLUMNS)


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after = stages[1].collect(), stages[2].collect()
    rows = list({(r.doc_id, r.text) for r in before})
    sets = [shingles(text, pipeline.NEAR_WORDS) for _, text in rows]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for k in range(i):
            if top[i] != top[k] and similarity(sets[i], sets[k]) >= 0.8:
                top = [top[k] if t == top[i] else t for t in top]
    groups = {}
    for t, (doc_id, text) in zip(top, rows):
        groups.setdefault(t, []).append((doc_id is None, doc_id or 0, text))
    want = sorted((None if none else doc_id) or -1 for none, doc_id, _ in (min(g, key=lambda x: x[:2]) for g in groups.values()))
    assert sorted(r.doc_id or -1 for r in after) == want
    assert len(want) < len(before) - 25  # the copies and the near copies went


def test_suffix_stage_removes_what_starts_earlier(stages):
    before, after = stages[2].collect(), {r.doc_id: r for r in stages[3].collect()}
    seen = {}
    for r in sorted(before, key=lambda r: (r.doc_id is None, r.doc_id)):
        data = (r.text or "").encode()
        gone = [False] * len(data)
        for at in range(len(data) - suffixes.LENGTH + 1):
            if seen.setdefault(data[at : at + suffixes.LENGTH], (r.doc_id, at)) != (r.doc_id, at):
                gone[at : at + suffixes.LENGTH] = [True] * suffixes.LENGTH
        left = bytes(b for b, g in zip(data, gone) if not g)
        if b"\xc3" not in data:  # else parts of characters stay
            assert after[r.doc_id].text.encode() == left
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text) and after[r.doc_id].lang == r.lang
    assert len(after) == len(before)


def test_mixing_stage_takes_near_targets(stages):
    size = lambda r: len((r.text or "").split())
    before, after = stages[3].collect(), stages[4].collect()
    total, names = {}, sorted({r.source for r in before if r.source is not None})
    for r in before:
        total[r.source] = total.get(r.source, 0) + size(r)
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate([*names, *([None] if None in total else [])])}
    taken = {}
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + size(r)
    open_ = {s for s in total if weight[s] * sum(total.values()) / sum(weight.values()) <= 3 * total[s]}
    shares = {s: taken[s] / weight[s] for s in open_ if taken.get(s, 0) < 2.9 * total[s]}
    assert max(shares.values()) - min(shares.values()) <= 0.1 * max(shares.values())
    counts = {}
    for r in after:
        counts[r.doc_id, r.text] = counts.get((r.doc_id, r.text), 0) + 1
    assert max(counts.values()) <= 3 and set(counts) <= {(r.doc_id, r.text) for r in before}


def test_packing_stage_places_all_tokens(stages):
    places = {}
    for r in stages[5].collect():
        assert r.length * 4 == len(r.ids)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_on_the_smallest_tables_and_on_none(spark, tmp_path):
    assert pipeline.run(spark, "/root/testdata/sf0.001").filter(F.col("length") < 1).count() == 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
