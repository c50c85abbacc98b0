import collections
import math
import random

import numpy as np
import pytest

from seriesmill.llm import vector_codes as v

SCHEMA = "vec_id long, embedding array<double>, label int, size string, id int"  # names that the operator uses, too


def brute(rows, rounds=v.ROUNDS):
    """Codes, errors and codebooks by comparing every part with every entry in Python's numbers."""
    sizes = collections.defaultdict(list)
    for vec_id, vector, label, *_ in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            sizes[len(vector)].append((vec_id, vector, label))
    coded, books = [], {}
    for size, kept in sizes.items():
        width = -(-size // v.PARTS)
        whole = [[math.floor(int(x) * 4096 if abs(x) > 2**50 else x * 4096) for x in vector] + [0] * (width * v.PARTS - size) for _, vector, _ in kept]
        order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[: v.ENTRIES]
        cut = [[x[p * width : (p + 1) * width] for p in range(v.PARTS)] for x in whole]
        book = [[cut[i][p] for i in order] for p in range(v.PARTS)]

        def near(part, p):
            return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book[p]))

        for _ in range(rounds):
            for p in range(v.PARTS):
                groups = collections.defaultdict(list)
                for x in cut:
                    groups[near(x[p], p)[1]].append(x[p])
                for e, parts in groups.items():
                    book[p][e] = [sum(column) // len(parts) for column in zip(*parts)]
        books[size] = book
        for (vec_id, _, label), x in zip(kept, cut):
            found = [near(x[p], p) for p in range(v.PARTS)]
            error = sum(d for d, _ in found)
            coded.append((vec_id, label, size, bytes(e for _, e in found), error if error < 1 << 63 else None))
    errors = collections.defaultdict(list)
    for _, label, *_, error in coded:
        errors[label].append(error)
    total = {label: None if None in x or sum(x) >= 1 << 63 else sum(x) for label, x in errors.items()}
    return [(*x, total[x[1]]) for x in coded], books


def clusters(draw, n, size, spread=0.05):
    centers = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(7)]
    return [[x + draw.gauss(0, spread) for x in draw.choice(centers)] for _ in range(n)]


def cases():
    draw = random.Random(8)
    plain = [(i, x, draw.choice([1, 2, None]), "s", 1) for i, x in enumerate(clusters(draw, 300, 16))]
    odd = [(1000, None, 1, None, None), (1001, [0.5] * 15 + [None], 1, None, None), (1002, [float("nan")] * 16, 1, "", 0), (1003, [float("inf")] * 16, 2, "", 0)]
    ties = [(None, [0.25, -0.25] * 8, 3, None, None), (None, [0.25, -0.25] * 8, 3, None, None), (5, [0.0] * 16, 4, None, None), (5, [-0.0] * 16, None, None, None)]
    hot = [(2000 + i, [0.125] * 16, 9, "h", 1) for i in range(200)]
    other = [(3000 + i, x, 1, "o", 1) for i, x in enumerate(clusters(draw, 40, 11))] + [(4000, [], 7, None, None), (4001, [], 7, None, None), (4002, [1.5], 8, None, None)]
    far = [(5000 + i, [draw.choice([1e20, -3e25, 1.7e308, 0.1]) for _ in range(16)], 50 + i, None, None) for i in range(30)]
    return {"plain": plain, "all": plain + odd + ties + hot + other, "far": plain + far, "few": plain[:9], "one": plain[:1], "none": []}


@pytest.mark.parametrize("name", list(cases()))
def test_codes_and_books_match_brute_force(spark, name):
    rows = cases()[name]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    laid = v.layouts(df, "vec_id", "embedding", "label")
    books = v.fitted(laid, v.first_books(df, "vec_id", "embedding"))
    want, want_books = brute(rows)
    assert {size: [[list(map(int, e)) for e in book] for book in parts] for size, parts in books.items()} == want_books
    got = [tuple(r) for r in v.label_errors(v.coded(laid, books), 4).collect()]
    assert sorted(((i, a, s, bytes(c), e, t) for i, a, s, c, e, t in got), key=str) == sorted(want, key=str)


def test_decoded_vectors_are_near(spark):
    rows = cases()["plain"]
    df = spark.createDataFrame(rows, SCHEMA)
    laid = v.layouts(df, "vec_id", "embedding", None)
    books = v.fitted(laid, v.first_books(df, "vec_id", "embedding"))
    found = {r.id: (r.vector, r.error) for r in v.decoded(v.coded(laid, books), books).collect()}
    for vec_id, vector, *_ in rows:
        near, error = found[vec_id]
        assert abs(sum((math.floor(a * 4096) - b * 4096) ** 2 for a, b in zip(vector, near)) - error) < 1e-3 * error + 1


def test_shortlists_never_lose_the_nearest_and_leave_most_out():
    draw = np.random.default_rng(2)
    data = np.array(clusters(random.Random(3), 4000, 8, 0.2))
    data = v.whole(data)
    data = data[v.hilbert_rank(data)]
    book = data[draw.choice(len(data), 16, replace=False)]
    begins = np.arange(0, len(data), v.BLOCK)
    lists = v.shortlists(book, np.minimum.reduceat(data, begins), np.maximum.reduceat(data, begins))
    square = ((data[:, None] - book[None]) ** 2).sum(axis=2)
    entry, least = v.nearest(book, data, lists, np.arange(len(lists)))
    assert (entry.ravel()[: len(data)] == square.argmin(axis=1)).all() and (least.ravel()[: len(data)] == square.min(axis=1)).all()
    assert lists.mean() < 0.6


def test_the_curve_visits_neighbouring_cells():
    side = np.arange(8)
    points = np.array([(x, y, z) for x in side for y in side for z in side])
    step = np.abs(np.diff(points[v.hilbert_rank(points)], axis=0)).sum(axis=1)
    assert (step == 1).all()


def test_limbs_add_up():
    for value in (0, 5, -1, -(1 << 28), (1 << 200) + 12345, -(1 << 90) - 7):
        assert sum(x << v.LIMB * i for i, x in enumerate(v.limbs(value))) == value
