import random

import numpy as np

from seriesmill.llm import simhash
from seriesmill.llm.components import components
from tests_llm_helpers import brute_components, brute_print

SCHEMA = "doc_id long, text string, print string, a int"


def near_prints(seed=7, centres=60):
    draw = random.Random(seed)
    prints = [0, 1, (1 << 64) - 1]
    for _ in range(centres):
        centre = draw.getrandbits(64)
        prints.append(centre)
        for _ in range(6):
            bits = draw.sample(range(64), draw.randint(1, 7))
            prints.append(centre ^ sum(1 << b for b in bits))
    return prints


def test_code_is_perfect_and_keys_meet():
    errors = simhash._errors()
    assert (np.bitwise_count(errors) <= 3).all() and len(set(errors.tolist())) == 2048
    draw = random.Random(2)
    for bits in (21, 22, 23):
        for _ in range(300):
            word = draw.getrandbits(bits)
            other = word ^ sum(1 << b for b in draw.sample(range(bits), draw.randint(0, 2)))
            keys = [set(k[n].tolist()) for k, n in (simhash.fuzzy_keys(np.array([w]), bits, errors) for w in (word, other))]
            assert keys[0] & keys[1] and max(map(len, keys)) <= 6


def test_every_pair_within_four_bits_shares_a_key():
    draw = random.Random(4)
    for _ in range(400):
        a = draw.getrandbits(64)
        b = a ^ sum(1 << k for k in draw.sample(range(64), 4))
        one, two = (set(simhash.keys_of(np.array([x], dtype=np.uint64))[0].tolist()) for x in (a, b))
        assert one & two


def check(spark, prints, group):
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in sorted(set(signed))], "print long").repartition(3)
    found = {r.node: r.component for r in components(simhash.link_prints(df, group=group)).collect()}
    want, groups = brute_components([p % (1 << 64) for p in prints]), {}
    for p, top in want.items():
        groups.setdefault(top, []).append(p - (1 << 64) if p >> 63 else p)
    for members in groups.values():
        for p in members:
            assert found.get(p, p) == min(members)


def test_components_match_brute_force(spark):
    check(spark, near_prints(), 4096)


def test_groups_cut_into_blocks(spark):
    draw = random.Random(9)
    base = draw.getrandbits(64)
    dense = [base ^ sum(1 << b for b in draw.sample(range(0, 64, 3), draw.randint(0, 3))) for _ in range(150)]
    check(spark, dense + near_prints(3, 10), 16)


def test_documents(spark):
    draw = random.Random(5)
    words = ["Über", "DER", "word", "ändern", "x", "42", "lorem"] + [f"w{i}" for i in range(200)]
    rows = []
    for i in range(80):
        text = draw.choice([" ", "\n", "\t \r"]).join(draw.choice(words) for _ in range(draw.choice([1, 2, 3, 4, 5, 60, 300])))
        rows += [(2 * i, text, "clash", 1), (2 * i + 1, text + draw.choice(["", " ", " end"]), "clash", None)]
    rows += [(900, None, None, None), (901, "", "", 0), (902, " \n", "", 0), (None, "a b", "", 0), (None, "a b", "", 0), (903, "long word " * 20000, "", 0)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    prints = {}
    for doc_id, text, *_ in rows:
        prints.setdefault(doc_id, brute_print(text))
    tops, least = brute_components(list(prints.values())), {}
    for doc_id, p in prints.items():
        if doc_id is not None:
            least[tops[p]] = min(least.get(tops[p], doc_id), doc_id)
    for r in got:
        assert r.print % (1 << 64) == prints[r.id]
        assert r.component == least.get(tops[prints[r.id]])


def test_chain_and_star_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 7 for i in range(8, 60)}}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
