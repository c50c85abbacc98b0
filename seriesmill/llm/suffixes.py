"""Removal of repeated passages by blockwise suffix sorting with difference covers.

Every byte covered by a string of LENGTH bytes that also starts earlier (smaller id, or same document and earlier
start) is removed; strings are those of the input and never cross documents.

Equal strings contain the same GRAM-byte gram of least hash (leftmost among equals) at the same place. So the starts
in a document fall into runs that share this minimizer, and only runs with the same minimizer can hold equal strings. A batch
keeps the earliest of identical runs and marks the others; copies of whole documents, found by their SHA-256, are marked,
too. The minimizers of the rest are shuffled without text. A run has two parts, the starts far before the minimizer and those
near it; all strings of a part share more than half of their bytes, and 24 bits of a hash of these travel along. Parts that meet no other with
their minimizer and hash are dropped, so what repeats by chance (short phrases, a frequent word) is never cut out. Parts of a minimizer with more than
HOT different surroundings are dealt by minimizer and hash first, again without text. For the others
the text is dealt by minimizer, the suffix bucket; only parts whose shared bytes have more than HOT surroundings are
dealt start by start, by their whole string, so that no bucket is large.

A task sorts its buckets in blocks of bounded size: suffixes by their first COVER bytes, and what still ties by the
ranks of a precomputed difference-cover sample. The positions whose residue modulo COVER is in the cover are ranked by
prefix doubling; for any two suffixes there is a shift below COVER that takes both into the sample, where
one look-up compares them. Neighbours in the sorted order with LENGTH bytes in common are equal strings; all but the
earliest are marked. Spans of marked strings, joined per document, are what is removed.

A NULL text counts as empty. Rows equal in id and text are one document whose row is repeated: they do not remove each
other. Rows with equal ids and different texts are told apart by 31 bits of a hash of the text, which also orders them; without an id 62 more bits of
another hash stand for it, so that NULL ids come after all others below 2^62. An
empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_bytes, byte_view, hand_back, saved, table

LENGTH = 100
GRAM = 16
HOT = 2000
BLOCK = 300_000
SEEN = 1 << 16  # strings of hot minimizers that a task remembers
COVER = 32
SAMPLE = (0, 1, 2, 3, 7, 11, 19)  # fixed value: a difference cover modulo 32
NO_ID = 1 << 62  # rows without an id are numbered from here by a hash
NORMAL, SINGLE, MARKED, SPLIT = 0, 1, 2, 3
PART = 24  # bits of the hash of what the strings of a part share


@functools.cache
def shifts() -> np.ndarray:
    """For residues a and b, the least shift that takes both into the sample."""
    sample = np.zeros(COVER, dtype=bool)
    sample[list(SAMPLE)] = True
    at = np.arange(COVER)
    both = sample[(at[:, None, None] + at) % COVER] & sample[(at[None, :, None] + at) % COVER]
    if not both.any(axis=2).all():
        raise ValueError("not a difference cover")
    return both.argmax(axis=2)


def word_at(text: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number that sorts like the bytes."""
    return np.lib.stride_tricks.as_strided(text[: len(text) // 8 * 8].view("<u8"), (len(text) - 8,), (1,))[positions].byteswap()


def padded(text: np.ndarray, room: int) -> np.ndarray:
    out = np.zeros((len(text) + room + 8) // 8 * 8 + 8, dtype=np.uint8)
    out[: len(text)] = text
    return out


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    up, down = np.full(size, base, dtype=np.uint64), np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of starts that share a minimizer: first start, number of starts, the minimizer's hash, a hash of the run's text.

    Then the two parts: how many starts come first, far before the minimizer, and a hash of PART bits of the bytes that all strings of
    the first and of the second part share (0 for a part without starts).
    """
    size = len(data)
    empty = np.zeros(0, dtype=np.int64)
    none = (empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty)
    if size < length:
        return none
    text = padded(data, 16)
    words = np.lib.stride_tricks.as_strided(text.view("<u8"), (len(text) - 8,), (1,))
    hashed = (words[:size] * np.uint64(0x9E3779B97F4A7C15)) ^ ((words[gram - 8 : size + gram - 8] + np.uint64(gram)) * np.uint64(0xC2B2AE3D27D4EB4F))
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    least = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(size, dtype=np.uint64)
    window, got = length - gram + 1, 1
    while 2 * got <= window:
        least = np.minimum(least[:-got], least[got:])
        got *= 2
    if got < window:
        least = np.minimum(least[: -(window - got)], least[window - got :])
    lengths = np.diff(offsets)
    long = lengths >= length
    flags = np.zeros(size + 1, dtype=np.int32)
    flags[offsets[:-1][long]] += 1
    np.subtract.at(flags, offsets[1:][long] - length + 1, 1)
    starts = np.flatnonzero(np.cumsum(flags[:size]) > 0)
    if not len(starts):
        return none
    place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    first, count = starts[at], np.diff(at, append=len(starts))
    up, down = _powers(1 << max(20, int(size).bit_length()))
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
    content = (sums[first + count + length - 1] - sums[first]) * down[first] ^ (count.astype(np.uint64) << np.uint64(56))
    place, middle = place[at], (window + 1) // 2
    far = np.clip(place - first - middle + 1, 0, count)

    def part(begins, ends):
        begins, ends = np.maximum(begins, 0), np.minimum(ends, size)
        mixed = (sums[ends] - sums[begins]) * down[begins]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.maximum(mixed >> np.uint64(64 - PART), np.uint64(1)).astype(np.int64)

    first_part = np.where(far > 0, part(place - middle, place + gram), 0)
    second_part = np.where(far < count, part(place, place + length - middle + 1), 0)
    return first, count, hashed[place], content, far, first_part, second_part


def _find(length: int, gram: int):
    """(key, doc, pos, n, parts) of the runs of a batch; *pos* holds the text's hash and the start.

    The lowest PART bits of *key* are the hash of the first part, the others are the minimizer's. *parts* is the hash of the second part
    and, in the lower 32 bits, the number of starts in the first; it is -1 for what equals an earlier run.
    """

    def run(batches):
        for batch in batches:
            found = []
            for part in by_bytes(batch, 2, 1 << 19):
                data, offsets = byte_view(part.column(2))
                first, count, key, content, far, first_part, second_part = runs(data, offsets, length, gram)
                key = key << np.uint64(PART) | first_part.view(np.uint64)
                row = np.searchsorted(offsets, first, side="right") - 1
                doc, print_ = part.column(0).to_numpy()[row], part.column(1).to_numpy()[row]
                found.append((key.view(np.int64), content, doc, (print_ << 32) | (first - offsets[row]), count, (second_part << 32) | far))
            if not found:
                continue
            key, content, doc, pos, count, parts = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((pos, doc, content, key))
            key, content, doc, pos, count, parts = (x[order] for x in (key, content, doc, pos, count, parts))
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else order
            later = (doc != doc[lead]) | (pos != pos[lead])  # identical to an earlier run
            kept = new | later  # repeated rows drop out
            key, parts = np.where(later, doc ^ (pos << 20), key), np.where(later, -1, parts)
            yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (key, doc, pos, count.astype(np.int32), parts)], ["key", "doc", "pos", "n", "parts"])

    return run


def _rows(key, doc, pos, n, state):
    columns = [pa.array(key), pa.array(doc), pa.array(pos), pa.array(n.astype(np.int32)), pa.array(np.broadcast_to(np.int32(state), len(key)))]
    return pa.RecordBatch.from_arrays(columns, ["key", "doc", "pos", "n", "state"])


def _met(rows, key, large):
    """(key, doc, pos, n, state) of the parts of runs, sorted by *key*, that meet another of their minimizer and hash; runs of *large* minimizers come part by part.

    Where both parts of a run are alike to others, the run stays in one piece.
    """
    whole, doc, pos, n, parts = (x.to_numpy() for x in rows.columns)
    marked, far = parts < 0, parts & 0xFFFFFFFF
    found = np.flatnonzero(marked)
    yield _rows(key[found], doc[found], pos[found], n[found], MARKED)
    first, second = whole & ((1 << PART) - 1), parts >> 32
    for at, code, begin, size in ((large & ~marked & (first > 0), whole, 0, far), (large & ~marked & (second > 0), ~(key << PART | second), far, n - far)):
        at = np.flatnonzero(at)
        begin = np.broadcast_to(begin, len(n))
        yield _rows(code[at], doc[at], pos[at] + begin[at], size[at], SPLIT)
    at = np.flatnonzero(~large & ~marked)
    key, first, second, far, n, doc, pos = (x[at] for x in (key, first, second, far, n, doc, pos))
    met = []
    for part in (first, second):
        order = np.lexsort((part, key))
        same = (key[order[1:]] == key[order[:-1]]) & (part[order[1:]] == part[order[:-1]])
        alike = np.zeros(len(order), dtype=bool)
        alike[order[1:]] = same
        alike[order[:-1]] |= same
        met.append(alike & (part > 0))
    at = np.flatnonzero(met[0] | met[1])
    skip, end = np.where(met[0], 0, far)[at], np.where(met[1], n, far)[at]
    yield _rows(key[at], doc[at], pos[at] + skip, end - skip, NORMAL)


def _again(rows, key, large):
    """Of parts sorted by *key*, those that share it; the *large* ones are to be dealt start by start."""
    sizes = np.unique(key, return_counts=True)[1]
    at = np.flatnonzero((np.repeat(sizes, sizes) > 1) | large)
    _, doc, pos, n, _ = (x.to_numpy()[at] for x in rows.columns)
    yield _rows(key[at], doc, pos, n, np.where(large[at], SINGLE, NORMAL))


def _shared(hot: int, shift: int, pick):
    """*pick* of rows sorted by key, whole keys at a time; keys (without the lowest *shift* bits) of more than *hot* rows are large and come as they are read."""

    def run(batches):
        held, hot_key = None, None  # rows of the last key; that key, if its rows went out as hot already
        for batch in _with_end(batches):
            parts = [held, *([] if batch is None else [pa.Table.from_batches([batch])])]
            parts = [x for x in parts if x is not None and x.num_rows]
            if not parts:
                continue
            rows = pa.concat_tables(parts)
            key = rows["key"].to_numpy() >> shift
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(new, append=len(key))
            large = np.repeat(sizes > hot, sizes)
            if hot_key is not None:
                large |= key == hot_key
            done = len(key) if batch is None or large[-1] else int(new[-1])
            hot_key = key[-1] if large[-1] else None
            if done:
                yield from (x for x in pick(rows.slice(0, done), key[:done], large[:done]) if x.num_rows)
            held = rows.slice(done)

    return run


def _with_end(batches):
    yield from batches
    yield None


def _cut(length: int):
    """(bucket, doc, pos, n, text) of the runs listed for each document; the runs of hot minimizers start by start.

    Of equal strings of hot minimizers, a task hands on only those that start before all it saw lately; the others are
    known to repeat and go without text, so one passage of all documents is a few rows a task.
    """

    def spread(doc):
        return xxhash.xxh3_64_intdigest(doc.to_bytes(8, "little", signed=True)) - (1 << 63)

    def emit(rows):
        buckets, docs, places, counts, texts = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(buckets, pa.int64()), pa.array(docs, pa.int64()), pa.array(places, pa.int64()), pa.array(counts, pa.int32()), pa.array(texts, pa.binary())],
            ["bucket", "doc", "pos", "n", "text"],
        )

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        first: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            rows = []
            for doc, packed, listed in zip(*batch.columns):
                doc, text = doc.as_py(), unpack(packed.as_py())
                for item in listed.as_py():
                    start, n = item["pos"] & 0xFFFFFFFF, item["n"]
                    if item["state"] == NORMAL:
                        rows.append((item["key"], doc, item["pos"], n, text[start : start + n + length - 1]))
                    else:
                        later = 0  # starts up to here that are known to repeat
                        for k in range(n + 1):
                            one, at = text[start + k : start + k + length], (doc, item["pos"] + k)
                            if k < n and first.get(one, at) < at:
                                later += 1
                                continue
                            if later:
                                rows.append((spread(doc), doc, item["pos"] + k - later, later, b""))
                                later = 0
                            if k < n:
                                if len(first) >= SEEN:
                                    first.clear()
                                first[one] = at
                                rows.append((xxhash.xxh3_64_intdigest(one) - (1 << 63), doc, item["pos"] + k, 1, one))
                    if len(rows) >= 20_000:
                        yield emit(rows)
                        rows = []
            if rows:
                yield emit(rows)

    return run


def cover_ranks(text: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Ranks of the sample positions below *size* by their first *depth* bytes or more, 0 elsewhere; *text* is padded."""
    steps = -(-size // COVER)
    sample = np.array(SAMPLE)
    place = (np.arange(steps) * COVER)[None, :] + sample[:, None]
    rank = _dense(np.stack([word_at(text, place + 8 * n).ravel() for n in range(COVER // 8)]))
    got = 1
    while got * COVER < depth:
        table = rank.reshape(len(sample), steps)
        later = np.zeros_like(table)
        later[:, : steps - got] = table[:, got:] + 1
        rank = _dense((table * (table.max() + 2) + later).reshape(1, -1).astype(np.uint64))
        got *= 2
    out = np.zeros(steps * COVER, dtype=np.int32)
    out[place.ravel()] = rank
    return out


def _dense(words: np.ndarray) -> np.ndarray:
    """Ranks, equal for equal columns, in the order of the columns (first row most significant)."""
    order = np.lexsort(words[::-1]) if len(words) > 1 else np.argsort(words[0])
    new = np.zeros(len(order), dtype=np.int64)
    new[1:] = (words[:, order[1:]] != words[:, order[:-1]]).any(axis=0)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


def sorted_suffixes(text: np.ndarray, positions: np.ndarray, bucket: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at *positions* within their *bucket*, and which may equal the one before (all first COVER bytes do)."""
    order = np.lexsort((word_at(text, positions), bucket))
    first = word_at(text, positions[order])
    tied = np.zeros(len(order), dtype=bool)
    tied[1:] = (bucket[order[1:]] == bucket[order[:-1]]) & (first[1:] == first[:-1])
    for n in range(1, COVER // 8):  # more words, for what is tied
        group = np.cumsum(~tied)
        open_ = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(open_):
            return order, tied
        word = word_at(text, positions[order[open_]] + 8 * n)
        turn = np.lexsort((word, group[open_]))
        order[open_] = order[open_][turn]
        word, same = word[turn], group[open_][1:] == group[open_][:-1]
        tied[open_[1:]] = same & (word[1:] == word[:-1])
    shift = shifts()
    ended = ~tied  # whether the order from the suffix before is settled
    settled = np.zeros(len(order), dtype=bool)
    while True:  # quicksort of all tied groups at a time, by one look-up of cover ranks per suffix
        group = np.cumsum(ended) - 1
        open_ = np.flatnonzero(~settled & (~ended | np.append(~ended[1:], False)))
        if not len(open_):
            return order, tied
        mine = group[open_]
        begins = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        sizes = np.diff(begins, append=len(mine))
        at = positions[order[open_]]
        pivot = np.repeat(at[begins + sizes // 2], sizes)
        by = shift[at % COVER, pivot % COVER]
        side = np.sign(ranks[at + by] - ranks[pivot + by])
        turn = np.lexsort((side, mine))
        order[open_] = order[open_][turn]
        side = side[turn]
        split = np.concatenate([[True], (mine[1:] != mine[:-1]) | (side[1:] != side[:-1])])
        ended[open_] |= split
        settled[open_] = side == 0


def marked_starts(texts: pa.Array, bucket: np.ndarray, rank: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of the strings of *length* bytes that a row of lower *rank* in the same bucket holds, too."""
    data, offsets = byte_view(texts)
    text = padded(data, length + 2 * COVER)
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    positions = offsets[row] + at
    order, tied = sorted_suffixes(text, positions, bucket[row], cover_ranks(text, len(data) + COVER, length))
    pairs = np.flatnonzero(tied)
    left, right = positions[order[pairs - 1]], positions[order[pairs]]
    for n in [*range(0, length - 7, 8), length - 8]:
        equal = word_at(text, left + n) == word_at(text, right + n)
        pairs, left, right = pairs[equal], left[equal], right[equal]
    same = np.zeros(len(order), dtype=bool)
    same[pairs] = True
    begins = np.flatnonzero(~same)
    ranks = rank[row[order]]
    least = np.repeat(np.minimum.reduceat(ranks, begins), np.diff(begins, append=len(order))) if len(order) else ranks
    hit = order[ranks > least]
    return row[hit], at[hit]


def _mark(length: int, block: int):
    """(doc, pos, n): runs of starts that are to be removed, from rows sorted by bucket."""

    def solve(rows):
        known = pc.equal(pc.binary_length(rows["text"]), 0)  # repeats that need no sorting
        found = rows.filter(known)
        yield tuple(found[name].to_numpy() for name in ("doc", "pos", "n"))
        rows = rows.filter(pc.invert(known))
        if not rows.num_rows:
            return
        bucket, doc, pos, n = (rows[name].to_numpy() for name in ("bucket", "doc", "pos", "n"))
        order = np.lexsort((pos, doc))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (pos[order[1:]] != pos[order[:-1]])
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(new)
        texts = rows["text"].combine_chunks()
        coded = texts.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        turn = np.lexsort((rank, coded, bucket))  # identical runs of a bucket: only the first is sorted
        lead = np.ones(len(turn), dtype=bool)
        lead[1:] = (coded[turn[1:]] != coded[turn[:-1]]) | (bucket[turn[1:]] != bucket[turn[:-1]])
        leader = np.empty(len(turn), dtype=np.int64)
        leader[turn] = turn[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
        whole = np.flatnonzero(rank > rank[leader])
        yield doc[whole], pos[whole], n[whole]
        kept = np.sort(turn[lead])
        _, size = np.unique(bucket[kept], return_counts=True)
        kept = kept[np.repeat(size, size) > 1] if len(kept) else kept
        if not len(kept):
            return
        row, start = marked_starts(texts.take(pa.array(kept)), bucket[kept], rank[kept], n[kept].astype(np.int64), length)
        turn = np.lexsort((start, row))
        row, start = row[turn], start[turn]
        begins = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])) if len(row) else np.zeros(0, dtype=np.int64)
        yield doc[kept[row[begins]]], pos[kept[row[begins]]] + start[begins], np.diff(begins, append=len(row)).astype(np.int32)

    def run(batches):
        held: list = []
        waiting = 0
        for batch in _with_end(batches):
            if batch is not None:
                held.append(batch)
                waiting += int(batch.column(3).to_numpy().sum())
                if waiting < block:
                    continue
            if not held:
                continue
            rows = pa.Table.from_batches(held)
            bucket = rows["bucket"].to_numpy()
            done = len(bucket) if batch is None else int(np.searchsorted(bucket, bucket[-1], side="left"))
            held = rows.slice(done).to_batches()
            waiting = int(rows["n"].to_numpy()[done:].sum())
            begin = 0
            while begin < done:  # whole buckets, about *block* starts at a time
                total = np.cumsum(rows["n"].to_numpy()[begin:done])
                end = begin + int(np.searchsorted(total, block, side="right"))
                last = bucket[min(end, done - 1)]
                end = done if end >= done else max(int(np.searchsorted(bucket, last, side="left")), begin)
                if end == begin:  # one bucket larger than a block
                    end = int(np.searchsorted(bucket[:done], last, side="right"))
                for doc, pos, n in solve(rows.slice(begin, end - begin)):
                    if len(doc):
                        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos), pa.array(n.astype(np.int32))], ["doc", "pos", "n"])
                begin = end
            del rows, bucket
            hand_back()

    return run


def spans_of(listed, length: int) -> list[tuple[int, int]]:
    """Maximal spans covered by the strings of the runs (start, n)."""
    out: list[list[int]] = []
    for start, n in sorted(listed):
        end = start + n - 1 + length
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def repeated(docs: DataFrame, id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, *keep*, text, spans), one per row of *docs*: its bytes as they came and the spans of them (begin, end) that repeat."""
    if length < gram + 8 or gram not in range(8, 17):
        raise ValueError("strings must be longer than a gram by 8 bytes, and a gram has 8 to 16")
    narrow = docs.select(
        F.coalesce(docs[id].cast("long"), NO_ID + F.xxhash64(F.lit("no id"), docs["text"]).bitwiseAND(F.lit(NO_ID - 1))).alias("doc"), (F.xxhash64(docs["text"]).bitwiseAND(F.lit(0x7FFFFFFF))).alias("print"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), docs[id].isNull().alias("no_id"), *(docs[c].alias(f"keep_{c}") for c in keep),
    )
    kind = "key long, doc long, pos long, n int, state int"
    found = narrow.select("doc", "print", "text").mapInArrow(_find(length, gram), "key long, doc long, pos long, n int, parts long")
    found = _kept(found.repartition(F.shiftright("key", PART)).sortWithinPartitions("key").mapInArrow(_shared(hot, PART, _met), kind))
    print_ = F.shiftright("pos", 32).alias("print")
    copies = _kept(_copies(narrow))
    split = found.filter(F.col("state") == SPLIT).repartition("key").sortWithinPartitions("key").mapInArrow(_shared(hot, 0, _again), kind)
    item = F.struct("key", "pos", "n", "state")
    listed = found.filter(F.col("state") == NORMAL).union(split).groupBy("doc", print_).agg(F.collect_list(item).alias("listed"))  # runs of one document
    listed = listed.join(copies, ["doc", "print"], "left_anti")
    packed = narrow.mapInArrow(_pack, _packed_schema(narrow))
    cut = packed.select("doc", "print", "packed").dropDuplicates(["doc", "print"]).join(listed, ["doc", "print"]).select("doc", "packed", "listed")
    cut = cut.mapInArrow(_cut(length), "bucket long, doc long, pos long, n int, text binary")
    marked = cut.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_mark(length, block), "doc long, pos long, n int")
    whole = copies.filter(F.col("size") >= length).select("doc", F.shiftleft("print", 32).alias("pos"), (F.col("size") - length + 1).cast("int").alias("n"))
    marked = _kept(marked.union(found.filter(F.col("state") == MARKED).select("doc", "pos", "n")).union(whole))
    removed = marked.groupBy("doc", print_).agg(F.collect_list(F.struct(F.col("pos").bitwiseAND(F.lit(0xFFFFFFFF)).alias("start"), "n")).alias("removed"))
    joined = packed.join(removed, ["doc", "print"], "left")
    names = [f"keep_{c}" for c in keep]
    shown = joined.select(F.when(~F.col("no_id"), F.col("doc")).alias("id"), *names, "packed", "removed")

    def finish(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            width = batch.num_columns
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                texts = [unpack(x) for x in part.column(width - 2).to_pylist()]
                spans = [spans_of([(x["start"], x["n"]) for x in (listed or ())], length) for listed in part.column(width - 1).to_pylist()]
                spans = [[{"begin": a, "end": b} for a, b in row] for row in spans]
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                columns = [*part.columns[: width - 2], pa.array(texts, pa.binary()), pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["id", *names, "text", "spans"])
            hand_back()

    fields = shown.drop("packed", "removed").schema
    fields = fields.add("text", "binary").add("spans", T.ArrayType(T.StructType().add("begin", "long").add("end", "long")))
    out = shown.mapInArrow(finish, fields)
    return out.withColumnsRenamed({f"keep_{c}": c for c in keep})


def _kept(df: DataFrame) -> DataFrame:
    """*df* as *saved* gives it; the shuffle files of its job go at once, not when the driver happens to collect its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return saved(df)
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)


def _copies(narrow: DataFrame) -> DataFrame:
    """(doc, print, size) of the documents whose whole text an earlier one has; all their strings repeat, so none needs sorting."""
    texts = narrow.select("doc", "print", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("digest"))
    first = texts.groupBy("digest").agg(F.min(F.struct("doc", "print")).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    return texts.join(first, "digest").filter(F.struct("doc", "print") > F.col("first")).select("doc", "print", "size").distinct()


def _pack(batches):
    """The text column compressed, so that it is cheap to shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            part = batch.slice(begin, 1000)
            columns = {name: part.column(n) for n, name in enumerate(part.schema.names)}
            texts = columns.pop("text").cast(pa.large_binary())
            columns["packed"] = pa.array([pack(x.as_py()) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _packed_schema(narrow: DataFrame):
    return narrow.drop("text").schema.add("packed", "binary")


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated(table(spark, folder, "documents"))

    def digest(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                left, at = hashlib.sha256(), 0
                for span in spans:
                    left.update(text[at : span["begin"]])
                    at = span["end"]
                left.update(text[at:])
                rows.append((len(text), sum(s["end"] - s["begin"] for s in spans), len(spans), left.hexdigest()))
            n_bytes, n_removed, n_spans, kept = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return found.select("id", "text", "spans").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


QUERIES = {"op5_suffix_dedup": (op5_suffix_dedup, None)}
