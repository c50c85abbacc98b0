import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import ppm

SCHEMA = "doc_id long, text string, block string, n int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def read_as(text):
    return " ".join(words_of(lowered(text))).encode() + b"\n"


class Trie:
    """The model byte by byte, with dictionaries."""

    def __init__(self, order):
        self.order, self.counts = order, {}

    def learn(self, data):
        data = b"\n" * self.order + data
        for at in range(self.order, len(data)):
            for length in range(self.order + 1):
                seen = self.counts.setdefault(data[at - length : at], {})
                seen[data[at]] = seen.get(data[at], 0) + 1

    def chance(self, context, byte):
        excluded, chance = set(), 1.0
        for length in range(self.order, -1, -1):
            seen = {b: n for b, n in self.counts.get(context[len(context) - length :], {}).items() if b not in excluded}
            if not seen:
                continue
            total = sum(seen.values())
            if byte in seen:
                return chance * (seen[byte] - 0.5) / total
            chance *= 0.5 * len(seen) / total
            excluded |= set(seen)
        return chance / (256 - len(excluded))

    def score(self, data):
        data = b"\n" * self.order + data
        return sum(math.log10(self.chance(data[at - self.order : at], data[at])) for at in range(self.order, len(data)))


def corpus(seed=1):
    draw = random.Random(seed)
    bits = ["th", "er", "on", "é", "ß", "ing", "A", "日", "x1", "###"]
    text = lambda n: draw.choice([" ", "  ", "\n"]).join("".join(draw.choice(bits) for _ in range(draw.randint(1, 4))) for _ in range(n))
    rows = [(i, text(draw.choice([0, 1, 3, 30, 120])), "x", 1) for i in range(120)]
    rows += [(500, None, None, None), (501, "", "", 1), (502, " \t ", "", 1), (None, "th er", "", 1), (None, "th er", "", 1), rows[3], (503, "th" * 30000, "", 1)]
    return rows


@pytest.mark.parametrize("order", [3, 5])
def test_scores_match_a_plain_trie(spark, order):
    rows = corpus()
    held = lambda i: i is not None and i % 4 == 1
    trie, seen, total = Trie(order), {}, 0
    for i, text, *_ in rows:
        if not held(i):
            trie.learn(read_as(text))
            for w in [*words_of(lowered(text)), None]:
                seen[w] = seen.get(w, 0) + 1
                total += 1
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = ppm.score(docs, F.col("id") % 4 == 1, order=order, blocks=5).collect()
    assert len(got) == len(rows)
    texts = {i: text for i, text, *_ in rows}
    for r in got:
        tokens = [*words_of(lowered(texts[r.id])), None]
        assert r.held_out == held(r.id) and r.n_tokens == len(tokens) and r.train_tokens == total
        assert r.n_known == sum(t in seen for t in tokens)
        base = sum(math.log10((seen.get(t, 0) + 0.5) / (total + 0.5 * (len(seen) + 1))) for t in tokens)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(trie.score(read_as(texts[r.id])), rel=1e-9)


def test_chances_of_all_bytes_sum_to_one():
    trie = Trie(3)
    for text in ("the cat sat", "the rat ran that way"):
        trie.learn(read_as(text))
    for context in (b"the", b"hat", b"xyz", b"\n\n\n", b"t t"):
        assert sum(trie.chance(context, b) for b in range(256)) == pytest.approx(1)


def test_grams_and_stream():
    texts = [b" The  cat", b"", b"a\tb"]
    import pyarrow as pa

    text, offsets, words, before = ppm.stream(*ppm.byte_view(pa.array(texts)))
    assert bytes(text) == b"the cat\n\na b\n" and offsets.tolist() == [0, 8, 9, 13] and before.tolist() == [0, 2, 2, 4]
    assert words.to_pylist() == [b"the", b"cat", b"a", b"b"]
    first = ppm.grams(text, offsets, 3)
    assert [int(first[2]), int(first[9])] == [int.from_bytes(b"ht\ne", "big"), int.from_bytes(b"\n\n\na", "big")]


def test_beats_the_unigram_model_on_held_out_texts(spark):
    rows = ppm.op3_ppm_scores(spark, "/root/testdata/sf0.1").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(10000) if zlib.crc32(str(i).encode()) % 5 == 1}
    assert np.sum([r.score for r in held]) > np.sum([r.base_score for r in held])


def test_empty_table(spark):
    assert ppm.score(spark.createDataFrame([], SCHEMA), F.lit(False)).count() == 0
