import random

import corpus_pipeline as pipeline

from seriesmill.llm import jaccard
from tests_llm_helpers import brute_print

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, min(len(words), 1)))}


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_texts():
    """Texts of 60 to 600 words, and copies of them with 0.5 to 3 % of their words replaced."""
    draw = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(250):
        body = [draw.choice(words) for _ in range(draw.randint(60, 600))]
        rate = draw.uniform(0.005, 0.03)
        rows += [(2 * i, " ".join(body)), (2 * i + 1, " ".join(draw.choice(words) if draw.random() < rate else w for w in body))]
    return rows


def brute_groups(rows, least=0.8):
    """The smallest id of the group of each row."""
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for k in range(i):
            if top[i] != top[k] and similarity(sets[i], sets[k]) >= least:
                top = [top[k] if t == top[i] else t for t in top]
    low = {}
    for t, (doc_id, _) in zip(top, rows):
        low[t] = min(low.get(t, doc_id), doc_id)
    return {doc_id: low[t] for t, (doc_id, _) in zip(top, rows)}


def test_edited_copies_are_found_as_by_brute_force(spark):
    rows = edited_texts()
    pairs = [similarity(shingles(rows[k][1]), shingles(rows[k + 1][1])) for k in range(0, len(rows), 2)]
    assert sum(0.8 <= s < 0.85 for s in pairs) >= 20 and sum(s < 0.8 for s in pairs) >= 20
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(4)
    want = brute_groups(rows)
    for block in (jaccard.BLOCK, 300):  # the second cuts nearly every group into blocks
        got = {r.id: r.component for r in jaccard.similar_groups(docs, block=block).collect()}
        assert sum(got[i] != want[i] for i in want) <= 1  # keys find 0.9996 of the pairs right at 0.8
    kept = {r.doc_id for r in pipeline.one_of_each_group(spark, docs, "").collect()}
    assert len(kept ^ set(want.values())) <= 1


def test_fingerprints_within_four_bits_do_not_join_what_is_not_similar(spark):
    a, b = "a b c d e " * 9 + "x y z", "a b c d e " * 9 + "u v w"
    assert brute_print(a, 5) == brute_print(b, 5) and similarity(shingles(a), shingles(b)) < 0.5
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (2, b, "en", "s", 1)], SCHEMA)
    assert pipeline.one_of_each_group(spark, docs, "").count() == 2


def test_chains_copies_nulls_and_short_texts(spark):
    words = [f"w{i}" for i in range(104)]
    chain = [(10 + k, " ".join(words[:4] + [f"n{k}_{i}" if i < 4 * k else w for i, w in enumerate(words)])) for k in range(8)]
    rows = [*chain, (1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, chain[0][1]), (7, chain[0][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows] + [(None, "one two", "en", "s", 1)], SCHEMA)
    for block in (jaccard.BLOCK, 150):
        found = jaccard.similar_groups(docs, block=block).collect()
        got = {r.id: r.component for r in found}
        want = brute_groups([(i, t) for i, t in rows])
        assert len(found) == len(rows) + 1
        assert got == {**want, None: 4}
    none = spark.createDataFrame([], SCHEMA)
    assert jaccard.similar_groups(none).count() == 0


def test_links_span_groups_of_exact_similarity():
    import numpy as np

    sets = [np.arange(0, 10, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64), np.arange(2, 10, dtype=np.uint64), np.arange(3, 10, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    links = jaccard.similar_links(np.arange(5), sets, 0.8)
    assert len(links) == 3 and {n for pair in links for n in pair} == {0, 1, 2, 3}
    assert jaccard.similar_links(np.arange(2), [sets[0], sets[3]], 0.8) == []


def templated_texts():
    """Fifty families of texts that share about half their shingles across families and nearly all within one."""
    draw = random.Random(9)
    common = [f"c{i}" for i in range(160)]
    rows = []
    for family in range(50):
        own = [f"f{family}_{i}" for i in range(80)]
        for member in range(4):
            body = own + common
            body[draw.randrange(240)] = f"m{family}_{member}"
            rows.append((10 * family + member, " ".join(body)))
    return rows


def test_candidates_that_do_not_verify_join_nothing(spark):
    """Templates share keys across families, in every form: hubs over several tasks, keys cut into blocks."""
    rows = templated_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(4)
    want = brute_groups(rows)
    assert len(set(want.values())) == 50
    for block, spokes in ((jaccard.BLOCK, jaccard.SPOKES), (700, 3)):
        assert {r.id: r.component for r in jaccard.similar_groups(docs, block=block, spokes=spokes).collect()} == want


def test_a_chain_through_one_key_is_joined_although_its_ends_are_not_alike(spark):
    """The first node of a key is not similar to all others, which then meet each other."""
    import numpy as np

    sets = [np.arange(10 * k, 10 * k + 100, dtype=np.uint64) for k in range(4)]  # 90 of 110 with the next, 80 of 120 beyond
    assert {frozenset(x) for x in jaccard.similar_links(np.arange(4), sets, 0.8)} == {frozenset((k, k + 1)) for k in range(3)}
    assert jaccard.similar_links(np.arange(4), sets, 0.8, np.array([7, 7, 9, 9])) in ([(1, 2)], [(2, 1)])


def test_fingerprint_groups_alone_join_what_is_similar_within_four_bits(spark, monkeypatch):
    """The step of the stage's method: without any min-hash in common, texts meet through their fingerprints, and only similar ones are joined."""
    import numpy as np

    def no_common_keys(hashes, bounds):
        starts = bounds[:-1][np.diff(bounds) > 0]
        return np.zeros((len(starts), 20), dtype=np.uint64) + np.bitwise_xor.reduceat(hashes, starts)[:, None]

    monkeypatch.setattr(jaccard, "band_keys", no_common_keys)
    rows = [(i, t) for i, t in edited_texts()[:300]] + [(1000, "a b c d e " * 9 + "x y z"), (1001, "a b c d e " * 9 + "u v w"), (1002, "one two"), (1003, None)]
    prints = [brute_print(t or "", 5) for _, t in rows]
    near = {k: (prints[k] ^ prints[k + 1]).bit_count() <= 4 and similarity(shingles(rows[k][1]), shingles(rows[k + 1][1])) >= 0.8 for k in range(0, 302, 2)}
    assert 20 <= sum(near.values()) <= 130 and not near[300]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(4)
    got = {r.id: r.component for r in jaccard.similar_groups(docs).collect()}
    assert got == {**{i: i for i, _ in rows}, **{rows[k + 1][0]: rows[k][0] for k, joined in near.items() if joined}}
    assert pipeline.STAGES[1] == ("simhash near-dedup", pipeline.one_of_each_group)
