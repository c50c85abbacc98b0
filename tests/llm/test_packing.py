import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from seriesmill.llm import packing

SCHEMA = "doc_id long, text string, piece int, length string"


def documents(spark):
    draw = random.Random(3)
    words = ["The", "rain", "naïve", "x1", "it's", "###", "ÉTÉ", "日本", "é", "end.", "<|endoftext|>"]
    rows = [(i, " \n".join(draw.choice(words) for _ in range(draw.choice([0, 1, 5, 40, 300]))), 1, "clash") for i in range(120)]
    rows += [(200, None, None, None), (None, "no id", 0, ""), (None, "no id", 0, ""), (201, "", 1, ""), (202, "word " * 9000, 1, "long"), (203, " \t\n", 1, "")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_pieces_hold_the_tokenizers_ids_and_fill_sequences_without_gaps(spark):
    rows, docs = documents(spark)
    path = packing.tokenizer_path()
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    pieces = packing.tokenise(docs, path, size=256)
    placed = packing.pack(pieces, size=256, salts=4).collect()
    for doc_id, text, *_ in rows:
        if doc_id is None:
            continue
        want = plain.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted((r for r in placed if r.id == doc_id), key=lambda r: r.piece)
        assert [r.start for r in mine] == list(range(0, len(want), 256))
        got = np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine])
        assert got.tolist() == want and [r.length for r in mine] == [len(r.ids) // 4 for r in mine]
        assert all(r.length == 256 for r in mine[:-1])
    assert sum(r.id is None for r in placed) == 2
    sequences = {}
    for r in placed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.1 * sum(r.length for r in placed) / 256 + 1
    assert zlib.crc32(placed[0].ids) >= 0


def test_plan_uses_every_length_and_wastes_little():
    draw = np.random.default_rng(5)
    histogram = np.bincount(np.clip(draw.lognormal(5.5, 1.0, 30000).astype(int), 1, 2048), minlength=2049)
    made = packing.plan(histogram)
    used = np.zeros(2049, dtype=int)
    for row, often in made:
        assert sum(row) <= 2048 and often > 0
        for length in row:
            used[length] += often
    assert (used == histogram).all()
    least = (np.arange(2049) * histogram).sum() / 2048
    assert sum(often for _, often in made) <= 1.005 * least + 1


def test_non_negative_fit_reaches_the_optimum():
    rows = np.array([[2, 2, 0], [3, 1, 0], [4, 0, 0], [1, 1, 2]])
    histogram = np.array([0.0, 6, 9, 2, 5])
    fit = packing.non_negative_fit(rows, histogram, 3000)
    matrix = np.array([[(row == length).sum() for row in rows] for length in range(1, 5)])
    slope = matrix.T @ (matrix @ fit - histogram[1:])
    assert (fit >= 0).all() and (slope > -1e-3).all() and abs(slope * fit).max() < 1e-2


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert packing.pack(packing.tokenise(docs, packing.tokenizer_path())).count() == 0
    assert packing.plan(np.zeros(2049, dtype=int)) == []


def test_many_groups_of_a_length_and_full_pieces(spark, monkeypatch):
    """Equal rows without ids, spread over as many groups as their number asks for; full pieces stay alone."""
    monkeypatch.setattr(packing, "GROUP", 7)
    rows = [(None, 0, 0, n, b"") for n in [10] * 500 + [31] * 60 + [64] * 40 + [33] * 3]
    pieces = spark.createDataFrame(rows, "id long, piece int, start long, length long, ids binary").repartition(5)
    placed = packing.pack(pieces, size=64).collect()
    sequences = {}
    for r in placed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(r.length for r in placed) == sorted(r[3] for r in rows)
    for parts in sequences.values():
        ends = np.cumsum([length for _, length in sorted(parts)])
        assert [offset for offset, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 64
    assert sum(parts == [(0, 64)] for parts in sequences.values()) == 40
    assert len(sequences) <= 1.1 * sum(r[3] for r in rows) / 64 + 1
