import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from seriesmill.llm import alignment
from seriesmill.llm.packing import tokenizer_path

SCHEMA = "doc_id long, text string, a_ids int, id string"  # names that the operator uses, too
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def texts():
    draw = random.Random(4)
    words = ["The", "river", "naïve", "x1", "it's", "###", "日本語", "é", "  ", "\n", "\t\t", "<|endoftext|>", "<s>", "</s>", "<0x41>", "🙂", "12,345", "antidisestablishment"]
    rows = ["".join(draw.choice(words) + draw.choice([" ", "", "  "]) for _ in range(draw.choice([1, 5, 60, 400]))) for _ in range(80)]
    return rows + [None, "", " ", "▁", "a▁b", "\x00", "\r\n", "é", "x" * 20000, " " * 5000, "word " * 30000, rows[0], rows[0]]


def brute(rows):
    """Tokens by the plain libraries, and cuts by sets of ends."""
    whole = Tokenizer.from_file(tokenizer_path(A))
    whole.encode_special_tokens = True
    letters = {c: bytes([b]) for c, b in alignment._letters().items()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
    found = []
    for text in rows:
        a_ids, b_ids = (whole.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        a = [b"".join(letters[c] for c in whole.id_to_token(i)) for i in a_ids]
        names = [pieces.id_to_piece(i) for i in b_ids]
        b = [bytes([int(x[3:5], 16)]) if pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in zip(b_ids, names)]
        if not text or b"".join(a) != (" " + text).encode() or b"".join(b) != (" " + text).encode():
            found.append(([], []))
            continue
        ends = set(np.cumsum([len(x) for x in a]).tolist()) & set(np.cumsum([len(x) for x in b]).tolist())
        groups, at = [[[], []]], {0: 0, 1: 0}
        split = []
        for side, (ids, parts) in enumerate(((a_ids, a), (b_ids, b))):
            one, out = [], []
            for i, part in zip(ids, parts):
                one.append(i)
                at[side] += len(part)
                if at[side] in ends:
                    out.append(one)
                    one = []
            split.append(out)
        groups = list(zip(*split))
        found.append((groups, [(x[-1], y[-1]) for x, y in groups]))
    counts = collections.Counter(pair for _, links in found for pair in links)
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for groups, links in found:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        print_ = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        sums = sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups)
        out.append((*sums, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), print_))
    return out


def test_documents_match_plain_tokenizers_and_sets_of_ends(spark):
    rows = texts()
    ids = [None if i in (3, 5) else i for i in range(len(rows))]
    docs = spark.createDataFrame([(i, text, 1, "x") for i, text in zip(ids, rows)], SCHEMA).repartition(3)
    found = alignment.aligned(docs, tokenizer_path(A), tokenizer_path(B))
    got = sorted((tuple(r) for r in alignment.scored(found, alignment.link_counts(found)).collect()), key=str)
    want = brute(rows)
    assert got == sorted(((i, *x) for i, x in zip(ids, want)), key=str)
    for r in alignment.unpacked(found).collect():
        assert (len(r.a_ids), len(r.b_ids)) == (sum(r.a_sizes), sum(r.b_sizes)) and len(r.a_sizes) == len(r.b_sizes)
    assert sum(x[0] == 0 for x in want) == 4  # None, "" and the two with U+2581


@pytest.mark.parametrize("lane", [1, 7, 64, 10_000])
def test_merge_in_lanes_finds_every_common_end(lane):
    draw = np.random.default_rng(lane)
    sizes = [1, 2, 50, 3000, 17]
    bounds = np.append(0, np.cumsum(sizes))
    ends = []
    for _ in range(2):
        inner = draw.choice(np.arange(1, bounds[-1]), 1100, replace=False)
        ends.append(np.unique(np.concatenate([inner, bounds[1:]])))
    a, b = alignment.merged(*ends, bounds, lane)
    assert (ends[0][a] == np.intersect1d(*ends)).all() and (ends[0][a] == ends[1][b]).all()


def test_ids_agree_with_the_plain_tokenizer_on_rare_characters():
    whole = Tokenizer.from_file(tokenizer_path(A))
    whole.encode_special_tokens = True
    own, _ = alignment._tokenizer(tokenizer_path(A))
    for low in range(0, 0x20000, 64):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)} " for c in range(low, low + 64) if not 0xD800 <= c < 0xE000)
        assert own.encode(text) == whole.encode(" " + text, add_special_tokens=False).ids


def test_empty_table(spark):
    found = alignment.aligned(spark.createDataFrame([], SCHEMA), tokenizer_path(A), tokenizer_path(B))
    assert alignment.scored(found, alignment.link_counts(found)).count() == 0
