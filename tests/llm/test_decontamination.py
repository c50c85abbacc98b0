import hashlib
import random
import re

import pytest

from seriesmill.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, row int, kept string"  # names that the operator uses, too
ITEMS = "item_id long, text string, text2 string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    windows = {}
    for item, text, *_ in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc_id, text, *_ in docs:
        w, hit, names = words(text), set(), set()
        for size in range(1, n + 1):
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    names |= windows[tuple(w[i : i + size])]
        names = sorted(str(x) for x in names - {None})
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    vocabulary = ["The", "cat", "été", "x1", "日本", "go", "run", "A", "b", "naïve", "9"]

    def text(n):
        return "".join(draw.choice(vocabulary) + draw.choice([" ", ", ", "\n", "-", "\x7f", " \x00"]) for _ in range(n))

    items = [(i, text(draw.choice([10, 11, 30, 60])), "x") for i in range(25)]
    items += [(100, items[3][1].upper().replace("É", "é"), None), (9, items[4][1], None), (None, text(15), None), (101, None, None), (102, " ,;", None)]
    items += [(103, "five words that stand alone", None), (104, "zzz", None), (105, text(9000), None)]
    docs = [(i, text(draw.choice([0, 3, 9, 10, 50, 400])), 1, "k") for i in range(120)]
    for i in range(40):  # passages of items, whole and in part, also two that touch
        item = draw.choice(items[:29])[1] or ""
        cut = draw.choice([0, 0, 4])
        docs.append((200 + i, text(20) + item[cut:] + draw.choice(["", items[5][1]]) + text(20), 2, None))
    docs += [(300, None, 0, ""), (None, "ZZZ", 0, ""), (None, "ZZZ", 0, ""), (301, "", 0, ""), (302, "five words that  STAND\talone zzzz", 0, "")]
    docs += [(303, items[-1][1][100:], 0, ""), (304, text(200_000) + items[0][1], 0, "")]
    return docs, items


@pytest.mark.parametrize("block", [d.BLOCK, 20_000])
def test_hits_match_brute_force_in_one_block_and_in_many(spark, rows, block, monkeypatch):
    monkeypatch.setattr(d, "PIECE", 500)
    docs, items = rows
    found = d.scanned(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), block=block)
    got = sorted(
        (
            (r.row.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0)
            for r in found.collect()
        ),
        key=str,
    )
    want = brute(docs, items)
    assert got == want
    assert sum(x[5] for x in want) > 30 and not all(x[5] for x in want)


def test_removal_leaves_no_window_and_keeps_all_else(spark, rows):
    docs, items = rows
    items = [x for x in items if x[0] != 104]  # windows of one word would appear anew where two words meet
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    hit = {(x[0], x[1]) for x in brute(docs, items) if x[5]}
    whole = d.decontaminated(frame, bench, "documents")
    assert whole.columns == frame.columns
    assert sorted(whole.collect(), key=str) == sorted((r for r in frame.collect() if (r.doc_id, len(words(r.text))) not in hit), key=str)
    cut = {r.doc_id: r for r in d.decontaminated(frame, bench, "spans").collect()}
    assert len(cut) == len({x[0] for x in docs})
    spans = {r.row.doc_id: r.spans for r in d.scanned(frame, bench, keep=False).collect()}
    for doc_id, text, *rest in docs:
        if doc_id is None:
            continue
        raw, out, at = (text or "").encode(), b"", 0
        for begin, stop in spans[doc_id]:
            out, at = out + raw[at:begin], stop
            assert raw[begin:stop].decode() and words(raw[begin:stop].decode())
        assert (cut[doc_id].text or "") == (out + raw[at:]).decode() and [cut[doc_id].row, cut[doc_id].kept] == rest
    with pytest.raises(ValueError):
        d.decontaminated(frame, bench, "all")


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch, spark, rows):
    monkeypatch.setattr(d, "_mixed", lambda x: x & d.np.uint64(0xF))
    docs, items = rows[0][:60], rows[1][:12]
    index = d.Index([str(x[0]) for x in items], [" ".join(words(x[1])).encode() for x in items])
    column = d.pa.array([x[1] for x in docs])
    data, offsets = d.byte_view(column)
    found = d.Words(data, offsets)
    flags, names = d._hits(found, index)
    n_hit = [int(flags[a:b].sum()) for a, b in zip(found.before, found.before[1:])]
    got = sorted(((x[0], n_hit[i], len(names.get(i, []))) for i, x in enumerate(docs)), key=str)
    assert got == sorted(((x[0], x[2], x[3]) for x in brute(docs, items)), key=str)


def test_empty_tables(spark, rows):
    docs, none = spark.createDataFrame(rows[0][:5], DOCS), spark.createDataFrame([], ITEMS)
    assert {(r.n_hit, len(r["items"])) for r in d.scanned(docs, none).collect()} == {(0, 0)}
    assert d.scanned(spark.createDataFrame([], DOCS), spark.createDataFrame(rows[1], ITEMS)).count() == 0
