"""Alignment of the tokens of two tokenizers by lockstep vectorised merging.

Each text is encoded by tokenizer A (with a space before it) and by tokenizer B (which adds that space itself). Where a token
of A and one of B end at the same byte, the text is cut, and the two tokens are linked. The ends of both are merged for all
documents of a batch at the same time: one state vector holds each document's pointers into A and B, every step compares the
two ends under the pointers, emits links and cuts where they agree, advances the pointer that is behind (both on a link) and
drops documents that are done from the state. Documents longer than LANE bytes take several places in the state, one for
each stretch of LANE bytes, so that no long document keeps a state of one.

Aligned documents are written once; counting the links of the corpus and scoring the documents read that table. The table
of counts goes to all tasks. Its size is bounded by the vocabularies: two linked tokens end together, so the bytes of one are
a suffix of the other's, and there are at most (ids of A * bytes of its tokens + the same for B) such pairs, in practice a few
hundred thousand, whatever the corpus.

NULL and empty texts, and those that a tokenizer does not give back byte for byte, have no tokens. Special tokens in a text
are plain text. Each row is aligned on its own, so repeated rows and rows without id stay as they are. An empty table gives an
empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import tokenizer_path
from .shared import by_bytes, byte_view, saved, table

LANE = 512  # bytes that one place of the state merges
SLICE = 1 << 21  # bytes of text merged at once
PARTS = ["a_ids", "b_ids", "a_cuts", "b_cuts"]
LISTS = ["a_ids", "b_ids", "a_sizes", "b_sizes"]


class ByteLevel:
    """A byte-level BPE from its JSON file: its ids as ranks of the merges, which tiktoken applies to each part of a text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        model = json.load(open(path, encoding="utf-8"))["model"]
        ranks = {_raw(token): i for token, i in model["vocab"].items()}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        before = -1
        for merge in model["merges"]:  # ranks in the order of the merges, or the ids would differ
            i = ranks[_raw("".join(merge) if isinstance(merge, list) else merge.replace(" ", ""))]
            if i <= before:
                raise ValueError(f"the ids of {path} do not follow its merges")
            before = i
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(" " + text)


@functools.cache
def _letters() -> dict[str, int]:
    """The bytes that byte-level vocabularies write as letters: printable ones as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _raw(token: str) -> bytes:
    letters = _letters()
    return bytes(letters[c] for c in token)


class Pieces:
    """A sentencepiece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@functools.cache
def _tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker."""
    made = ByteLevel(path) if path.endswith(".json") else Pieces(path)
    return made, np.array([len(x) for x in made.tokens], dtype=np.int64)


def _encoded(tokenizer, texts: list[str | None]) -> list[np.ndarray | None]:
    """Ids of each text; None where there are none or they do not give back a space and the text."""
    out: list[np.ndarray | None] = []
    for text in texts:
        ids = tokenizer.encode(text) if text else []
        whole = bool(ids) and b"".join([tokenizer.tokens[i] for i in ids]) == b" " + text.encode()
        out.append(np.array(ids, dtype=np.int32) if whole else None)
    return out


def merged(a_ends: np.ndarray, b_ends: np.ndarray, bounds: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of A and of B that end at the same byte, in order.

    The documents' bytes follow each other, document i ending at bounds[i + 1]; *a_ends* and *b_ends* ascend.
    """
    sizes = np.diff(bounds)
    count = -(-sizes // lane)
    begin = np.repeat(bounds[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * lane
    stop = np.minimum(begin + lane, np.repeat(bounds[1:], count))
    a, b = np.searchsorted(a_ends, begin, side="right"), np.searchsorted(b_ends, begin, side="right")
    a_stop, b_stop = np.searchsorted(a_ends, stop, side="right"), np.searchsorted(b_ends, stop, side="right")
    a_found, b_found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    while True:
        open_ = (a < a_stop) & (b < b_stop)
        if not open_.all():  # compact the state
            a, b, a_stop, b_stop = a[open_], b[open_], a_stop[open_], b_stop[open_]
        if not len(a):
            break
        x, y = a_ends[a], b_ends[b]
        met = x == y
        a_found.append(a[met])
        b_found.append(b[met])
        a, b = a + (x <= y), b + (y <= x)
    links = np.concatenate(a_found), np.concatenate(b_found)
    order = np.argsort(links[0])
    return links[0][order], links[1][order]


def _binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A row of raw numbers for each count."""
    bounds = np.append(0, np.cumsum(counts) * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(values)]).cast(pa.binary())


def _aligned(texts: list[str | None], one: str, other: str) -> list[pa.Array]:
    (a, a_lengths), (b, b_lengths) = _tokenizer(one), _tokenizer(other)
    a_rows, b_rows = _encoded(a, texts), _encoded(b, texts)
    none = np.zeros(0, dtype=np.int32)
    pairs = [(x, y) if x is not None and y is not None else (none, none) for x, y in zip(a_rows, b_rows)]
    a_ids, b_ids = (np.concatenate([none, *x]) for x in ([x for x, _ in pairs], [y for _, y in pairs]))
    a_counts, b_counts = np.array([len(x) for x, _ in pairs], dtype=np.int64), np.array([len(y) for _, y in pairs], dtype=np.int64)
    a_ends, b_ends = np.cumsum(a_lengths[a_ids]), np.cumsum(b_lengths[b_ids])
    at = np.append(0, np.cumsum(a_counts))
    a_last, b_last = merged(a_ends, b_ends, np.append(0, a_ends)[at])
    out = []
    for ids, counts, last, made in ((a_ids, a_counts, a_last, a), (b_ids, b_counts, b_last, b)):
        cuts = np.zeros(len(ids), dtype=np.uint8)
        cuts[last] = 1
        out.append((_binaries(ids.astype("<u2" if len(made.tokens) <= 1 << 16 else "<u4"), counts), _binaries(cuts, counts)))
    return [out[0][0], out[1][0], out[0][1], out[1][1]]


def aligned(docs: DataFrame, a: str, b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, a_ids, b_ids, a_cuts, b_cuts): the tokens of both, and for each token a byte that is 1 where a cut follows.

    Ids are little-endian numbers of two bytes, of four for vocabularies beyond 65,536. The n-th tokens with a cut of both are linked; see
    unpacked() for lists. *a* and *b* are tokenizer files, which the workers need at the same place:
    byte-level BPE (``.json``) or sentencepiece (``.model``).
    """

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, 1, SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), *_aligned(part.column(1).to_pylist(), a, b)], ["id", *PARTS])

    narrow = docs.select(docs[id].alias("id"), docs[text].cast("string").alias("text"))
    return narrow.mapInArrow(run, T.StructType([narrow.schema["id"], *[T.StructField(x, T.BinaryType()) for x in PARTS]]))


def _slices(batches, size: int = 1 << 19):
    """Slices of *batches* with about so many tokens each, one row at least."""
    for batch in batches:
        until = np.cumsum(np.diff(byte_view(batch.column("a_cuts"))[1]))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(until, (until[begin - 1] if begin else 0) + size, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


class _Aligned:
    """A slice of aligned documents: ids, and where each document's and each group's tokens begin and end."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids, self.rows, self.until = [], [], []
        for side in "ab":
            raw, _ = byte_view(batch.column(f"{side}_ids"))
            cuts, at = byte_view(batch.column(f"{side}_cuts"))
            self.ids.append(raw.view(f"<u{len(raw) // len(cuts)}") if len(cuts) else np.zeros(0, dtype=np.uint16))
            self.rows.append(at)
            self.until.append(np.flatnonzero(cuts) + 1)
        self.groups = np.searchsorted(self.until[0], self.rows[0], side="right")  # groups before each document

    @property
    def links(self) -> np.ndarray:
        """The linked ids of A and B of all groups as one number each."""
        a, b = (ids[until - 1].astype(np.int64) for ids, until in zip(self.ids, self.until))
        return a << 32 | b


def unpacked(found: DataFrame) -> DataFrame:
    """A result of aligned() as lists (id, a_ids, b_ids, a_sizes, b_sizes): the sizes say how many tokens lie in each group."""

    def run(batches):
        for batch in _slices(batches):
            part = _Aligned(batch)
            lists = [*zip(part.ids, part.rows), *((np.diff(until, prepend=0), part.groups) for until in part.until)]
            columns = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32))) for values, at in lists]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", *LISTS])

    return found.mapInArrow(run, T.StructType([found.schema["id"], *[T.StructField(x, T.ArrayType(T.IntegerType())) for x in LISTS]]))


def link_counts(found: DataFrame) -> DataFrame:
    """Rows (a, b, n): how many links of *found*, a result of aligned(), join these ids."""

    def run(batches):
        pairs, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in _slices(batches):  # what a task holds is bounded by the vocabularies
            new, times = np.unique(_Aligned(batch).links, return_counts=True)
            pairs, where = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([counts, times]), minlength=len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(counts)], ["a", "b", "n"])

    return found.select(*PARTS).mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def rendered(a_ids, b_ids, a_sizes, b_sizes, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups of documents as bytes ``a1,a2|b1;a3|b2,b3``, and the end of each document, whose last group is flagged in *last*."""
    group = np.arange(len(a_sizes))
    a_until, b_until = np.cumsum(a_sizes), np.cumsum(b_sizes)
    place_a = np.arange(len(a_ids)) + np.repeat(b_until - b_sizes, a_sizes)
    place_b = np.arange(len(b_ids)) + np.repeat(a_until, b_sizes)
    rest, mark = np.empty(len(a_ids) + len(b_ids), dtype=np.int32), np.full(len(a_ids) + len(b_ids), ord(","), dtype=np.uint8)
    rest[place_a], rest[place_b] = a_ids, b_ids
    mark[place_a[a_until - 1]] = ord("|")
    ends = place_b[b_until - 1]
    mark[ends] = np.where(last[group], 0, ord(";"))
    digits, bound = np.ones(len(rest), dtype=np.int64), 10
    while bound <= rest.max(initial=0):
        digits += rest >= bound
        bound *= 10
    until = np.cumsum(digits + (mark > 0))
    out = np.empty(int(until[-1]) if len(until) else 0, dtype=np.uint8)
    out[until[mark > 0] - 1] = mark[mark > 0]
    at = until - 1 - (mark > 0)
    left = np.arange(len(rest))
    for _ in range(digits.max(initial=0)):
        out[at[left]] = 48 + rest[left] % 10
        rest //= 10
        digits -= 1
        at -= 1
        left = left[digits[left] > 0]
    return out, until[ends[last]]


def scored(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for a result of aligned() and its link_counts().

    *groups* is the SHA-256 of the groups as text. The counts come to the driver and go to all tasks, see the bound above.
    """
    rows = counts.toArrow()
    a, b, n = (rows.column(x).to_numpy().astype(np.int64) for x in ("a", "b", "n"))
    most = np.zeros(int(b.max(initial=-1)) + 1, dtype=np.int64)
    np.maximum.at(most, b, n)
    order = np.argsort(a << 32 | b)
    sent = found.sparkSession.sparkContext.broadcast(((a << 32 | b)[order], n[order], (n == most[b])[order]))

    def run(batches):
        pairs, number, best = sent.value
        for batch in _slices(batches):
            part = _Aligned(batch)
            place = np.searchsorted(pairs, part.links)
            a_sizes, b_sizes = (np.diff(x, prepend=0) for x in part.until)
            at = part.groups
            last = np.zeros(len(a_sizes), dtype=bool)
            full = np.diff(at) > 0
            last[at[1:][full] - 1] = True
            text, until = rendered(*part.ids, a_sizes, b_sizes, last)
            begins = np.append(0, until)
            prints = [""] * batch.num_rows
            for row, begin, end in zip(np.flatnonzero(full).tolist(), begins.tolist(), until.tolist()):
                prints[row] = hashlib.sha256(text[begin:end]).hexdigest()
            total = lambda x: pa.array(np.diff(np.append(0, np.cumsum(x))[at]))
            links = pa.array(np.diff(at).astype(np.int64))
            columns = [*[pa.array(np.diff(x)) for x in part.rows], links, links, total(best[place]), total(number[place]), pa.array(prints, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", *RESULT])

    return found.mapInArrow(run, T.StructType([found.schema["id"], *[T.StructField(x, T.LongType()) for x in RESULT[:-1]], T.StructField("groups", T.StringType())]))


RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def op12_align_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = saved(aligned(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")))
    return scored(found, link_counts(found)).withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


QUERIES = {"op12_align_tokens": (op12_align_tokens, None)}
