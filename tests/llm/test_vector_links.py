import numpy as np

from seriesmill.llm import vector_links

SCHEMA = "vec_id long, embedding array<float>, first string, copies int"


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and len(v) and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    ids = [i for i, _ in good]
    top = list(range(len(good)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    links = [0] * len(good)
    for x in range(len(good)):
        for y in range(x):
            a, b = good[x][1], good[y][1]
            if len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                links[x] += 1
                links[y] += 1
                top[find(x)] = find(y)
    least = {}
    for x in range(len(good)):
        least[find(x)] = min(least.get(find(x), ids[x]), ids[x])
    return [(ids[x], links[x], least[find(x)]) for x in range(len(good))]


def vectors():
    draw = np.random.default_rng(3)
    rows = []
    for i in range(250):
        centre = draw.standard_normal(16)
        rows.append((3 * i, centre.tolist(), "x", 1))
        if i % 3 == 0:
            rows.append((3 * i + 1, (centre + 0.28 * draw.standard_normal(16)).tolist(), "x", 1))
            rows.append((3 * i + 2, (2.5 * centre).tolist(), "x", 1))
    hot = draw.standard_normal(16)
    rows += [(5000 + i, hot.tolist(), "x", 1) for i in range(200)]
    rows += [(6000 + i, (hot + 0.02 * draw.standard_normal(16)).tolist(), "x", 1) for i in range(60)]
    rows += [(7000, None, None, None), (7001, [0.0] * 16, "", 1), (7002, [1.0, None] * 8, "", 1), (7003, [float("nan")] * 16, "", 1), (7004, [float("inf")] * 16, "", 1)]
    rows += [(7005, [], "", 1), (7006, hot.tolist()[:8], "", 1), (7007, [-0.0] + [1.0] * 15, "", 1), (7008, [0.0] + [1.0] * 15, "", 1), (7009, hot.tolist(), "", 1), (7009, hot.tolist(), "", 1)]
    return rows


def test_links_match_brute_force(spark):
    rows = vectors()
    got = vector_links.link(spark.createDataFrame(rows, SCHEMA).repartition(4), bucket=32, split=40).collect()
    assert len(got) == len(rows)
    want = sorted(brute(rows))
    assert sorted((r.id, r.n_links, r.component) for r in got if r.id not in (7000, 7001, 7002, 7003, 7004, 7005)) == want
    assert all(r.n_links == 0 and r.component == r.id for r in got if 7000 <= r.id <= 7005)


def test_null_ids_take_no_part(spark):
    rows = [(None, [1.0, 0.0], "", 1), (1, [1.0, 0.0], "", 1), (2, [1.0, 0.01], "", 1)]
    got = {r.id: (r.n_links, r.component) for r in vector_links.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {None: (0, None), 1: (1, 1), 2: (1, 1)}


def test_counts_are_calibrated():
    draw = np.random.default_rng(8)
    needed = vector_links.count_needed()
    gaps = draw.standard_normal((20000, vector_links.PROJECTIONS))
    assert ((np.abs(gaps) <= vector_links.WINDOW).sum(axis=1) >= needed).mean() >= 0.998
    lines, others = draw.standard_normal((30, 5)), draw.standard_normal((40, 5))
    want = (np.abs(lines[:, None] - others[None]) <= 0.4).sum(axis=2)
    assert (vector_links.collisions(lines, others, 0.4) == want).all()


def test_rounds_grow_with_the_table():
    assert vector_links.signs_and_rounds(0) == (0, 1) and vector_links.signs_and_rounds(100) == (0, 1)
    assert vector_links.signs_and_rounds(51282) == (9, 15)


def test_empty_table(spark):
    assert vector_links.link(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signs_do_not_depend_on_the_batch_or_the_stored_precision():
    draw = np.random.default_rng(6)
    vectors = draw.standard_normal((500, 48)).astype(np.float32).astype(float)
    whole = vector_links.codes_of(vectors, 9, range(12))
    for _ in range(20):
        mine = draw.permutation(500)[: draw.integers(1, 60)]
        assert (vector_links.codes_of(vectors[mine], 9, range(5)) == whole[mine, :5]).all()
    assert (vector_links.codes_of(vectors * 4, 9, range(12)) == whole).all()
