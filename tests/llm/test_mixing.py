import math
import random

import pytest

from seriesmill.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, block int"


def level_by_hand(sizes, weights, limit):
    """Resharing round by round until no target is above its limit."""
    total, targets, open_sources = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_sources:
        rest = total - sum(t for i, t in enumerate(targets) if i not in open_sources)
        share = {i: rest * weights[i] / sum(weights[j] for j in open_sources) for i in open_sources}
        above = {i for i in open_sources if share[i] > limit * sizes[i]}
        for i in open_sources:
            targets[i] = limit * sizes[i] if i in above else share[i]
        if not above:
            break
        open_sources -= above
    return targets


def test_targets_and_taken_words(spark):
    draw = random.Random(1)
    rows = []
    for i in range(3000):
        source = "hot" if i % 3 == 0 else draw.choice(["a", "B", "tiny", None, "ü"]) if i % 50 else "tiny"
        rows.append((i, "w " * int(draw.lognormvariate(3, 1)), source, "clash", 1))
    rows += [(5000, None, "empty", "", 1), (None, "a b", "a", "", 1), (None, "a b", "a", "", 1), (5001, "x " * 5000, "hot", "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix(docs, block=100).collect()
    again = mixing.mix(docs.repartition(3), block=100).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = dict(zip(names, level_by_hand([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)))
    for source in names:
        mine = [r for r in got if r.source == source]
        assert all(r.source_size == sizes[source] and math.isclose(r.target, want[source], abs_tol=1e-6) for r in mine)
        assert all(0 <= r.copies <= 3 for r in mine)
        taken = sum(r.size * r.copies for r in mine)
        expected = len(mine) * want[source] / sizes[source] if sizes[source] else 0
        assert abs(taken - want[source]) <= max(r.size for r in mine)
        assert abs(sum(r.copies for r in mine) - expected) <= 2 + 1e-6


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_both_totals_and_leaves_two(seed):
    draw = random.Random(seed)
    sizes = [draw.choice([0, 3, 3, 10, 500]) for _ in range(300)]
    chances = [0.37] * 300
    left = mixing.flight(chances, sizes, str(seed))
    assert math.isclose(sum(left), sum(chances), abs_tol=1e-5)
    assert math.isclose(sum(p * s for p, s in zip(left, sizes)), sum(p * s for p, s in zip(chances, sizes)), abs_tol=1e-3)
    assert sum(0 < p < 1 for p in left) <= 2
    assert set(mixing.landing(left, sizes)) <= {0.0, 1.0}


def test_each_document_keeps_its_chance():
    hits = sum(mixing.flight([0.3] * 7, [5, 1, 9, 2, 2, 8, 4], str(seed))[3] for seed in range(3000))
    assert abs(hits / 3000 - 0.3) < 0.03


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
