import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import quality

SCHEMA = "doc_id long, text string, source string, lang string, low string, kept int"


def test_labelled_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    shown = labels.filter("doc_id % 3 <> 0")  # the rest is held out
    found = {r.id: r for r in quality.classify(docs, shown).filter("id % 3 = 0").collect()}
    wrong = {}
    for r in labels.filter("doc_id % 3 = 0").collect():
        bad = r.quality == 0 or r.toxic == 1
        wrong.setdefault(bad, []).append(found[r.doc_id].kept == bad)
    assert np.mean(wrong[True]) <= 0.06 and np.mean(wrong[False]) <= 0.01


def test_rates_match_the_hierarchy_by_hand(spark):
    draw = np.random.default_rng(4)
    rows = []
    for host in range(30):
        level = draw.beta(2, 5)
        for path in range(4):
            for _ in range(int(draw.integers(1, 60)) if host else 2000):
                rows.append((f"h{host}", f"p{path}", float(np.clip(draw.normal(level, 0.1), 0.01, 0.99))))
    got = {(r.host, r.path): r.low_site for r in quality.site_rates(spark.createDataFrame(rows, "host string, path string, low double"), "low").collect()}

    def tally(keys):
        out = {}
        for key, row in zip(keys, rows):
            n, total, squares = out.get(key, (0, 0.0, 0.0))
            out[key] = (n + 1, total + row[2], squares + row[2] ** 2)
        return out

    def strength(groups, means):
        n = sum(g[0] for g in groups.values())
        spread = sum(g[0] * (g[1] / g[0] - means[k]) ** 2 for k, g in groups.items())
        within = sum(max(g[2] - g[1] ** 2 / g[0], 0.0) for g in groups.values())
        between = (spread - within / n * len(groups)) / n
        most = sum(g[0] * means[k] * (1 - means[k]) for k, g in groups.items()) / n
        return min(max(most / between - 1, 1.0), 1e6) if between > 0 else 1e6

    hosts, paths = tally([r[0] for r in rows]), tally([(r[0], r[1]) for r in rows])
    mean = sum(r[2] for r in rows) / len(rows)
    power = strength(hosts, {h: mean for h in hosts})
    host_rate = {h: (g[1] + power * mean) / (g[0] + power) for h, g in hosts.items()}
    power = strength(paths, {k: host_rate[k[0]] for k in paths})
    for key, g in paths.items():
        assert got[key] == pytest.approx((g[1] + power * host_rate[key[0]]) / (g[0] + power), rel=1e-6)


def test_final_odds_use_the_site(spark):
    rows = [(i, "plain words here" if i % 2 else "ugly junk words", f"s{i % 3}" if i % 7 else None, None if i % 5 == 0 else "en", "x", 1) for i in range(400)]
    rows += [(1000, None, None, None, None, None), (1001, "", "s0", "en", "", 0), (None, "junk", "s1", "en", "", 0), (1002, "word " * 60000, "s1", "en", "", 0)]
    labels = spark.createDataFrame([(i, i % 2, 0 if i % 4 else 1) for i in range(200)] + [(3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(spark.createDataFrame(rows, SCHEMA).repartition(3), labels)
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= r.low <= 1 and 0 <= r.toxic <= 1 for r in out)
    kept = {r.id: r.kept for r in out}
    assert not any(kept[i] for i in range(0, 400, 2)) and np.mean([kept[i] for i in range(1, 400, 2)]) > 0.95
    assert {(r.host, r.path) for r in out if r.id in (0, 1000)} == {(None, None)}
    assert got.filter(F.col("host").isNull()).count() > 0


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en", "", 1)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in quality.classify(docs, labels).collect()] == [True]
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_logistic_fit_recovers_coefficients():
    draw = np.random.default_rng(1)
    rows = draw.standard_normal((20000, quality.KINDS + 3))
    rows[:, quality.KINDS] = 1
    true = draw.standard_normal(quality.KINDS + 3)
    target = (draw.random(20000) < 1 / (1 + np.exp(-rows @ true))).astype(float)
    assert np.abs(quality.fit(rows, target) - true).max() < 0.15
    assert math.isclose(quality.fit(rows[:4], np.zeros(4))[quality.KINDS], math.log(0.5 / 4.5))
