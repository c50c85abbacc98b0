"""Best-fit packing of token sequences by patterns and non-negative least squares.

Documents become pieces of at most *size* tokens. Full pieces are sequences of their own. Pieces of equal length are alike, so the packing is planned on the
histogram of lengths, which has at most *size* entries whatever the corpus: patterns of one, two or three lengths that
fill a sequence are enumerated, non-negative least squares fits how often each is used, the numbers are rounded down
and the residual lengths are packed best fit first, again on the histogram. The plan goes to all tasks as ranges:
the pieces of one length, numbered from 0, go to the pattern places of that length one range after the other. Pieces
are numbered in groups of (length, salt), the salts' counts giving each group's first number. A length has the more salts the more
pieces it has, so one that a third of all pieces share is spread over many tasks.

The queries give the ids of a plain encode(text, add_special_tokens=False): added tokens of the tokenizer that stand in a
text, such as <|endoftext|>, get their own ids. Without *added* they are read as any other characters.

A NULL text counts as empty; every document has at least its end token. Repeated rows and NULL ids are pieces of their own. An empty
table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER, SPACES, by_bytes, byte_view, hand_back, row_starts, saved, table, word_spans

SIZE = 2048
GROUP = 1 << 18  # pieces that one task numbers
GRID = 32
ROUNDS = 600
PIECES = "piece int, start long, length long, ids binary"


KNOWN = 300_000  # words whose ids a worker keeps between batches
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
KINDS = np.full(256, ODD, dtype=np.uint8)
KINDS[:128] = OTHER
KINDS[SPACES] = SPACE
KINDS[48:58] = DIGIT
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[39] = ODD  # apostrophes begin contractions


class _Vocabulary:
    """Ids of words, kept from batch to batch.

    The tokenizer lowers letters, drops white space and joins nothing across letters, single digits and runs of other
    characters. Words of ASCII and of the letters from U+00C0 to U+00FF are therefore cut here and each different part
    is encoded once; all other words go through the whole tokenizer, with *added* also those that hold an added token.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.parts = path, Tokenizer.from_file(path)
        self.parts.encode_special_tokens = True  # its parts never hold an added token
        literals = [token.content.encode() for token in self.parts.get_added_tokens_decoder().values()] if added else []
        self.added = re.compile(b"|".join(map(re.escape, sorted(literals, key=len, reverse=True)))) if literals else None
        self.parts.normalizer = normalizers.Sequence([])
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()

    @functools.cached_property
    def whole(self):
        """The tokenizer as it is, loaded where a word needs it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = self.added is None
        return found

    def forget(self):
        self.known: dict[bytes, int] = {}
        self.ids, self.bounds = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where each word's ids are."""
        if len(self.known) > KNOWN:
            self.forget()
        known = self.known
        new = [w for w in words if w not in known]
        plain, other = [], []
        for word in new:
            (plain if _plain(word) and not (self.added and self.added.search(word)) else other).append(word)
        ids, counts = [self.ids], [np.diff(self.bounds)]
        for begin in range(0, len(plain), 2000):
            part = plain[begin : begin + 2000]
            found = self.parts.encode(b" ".join(part).decode(), add_special_tokens=False)
            ids.append(np.array(found.ids, dtype=np.uint32))
            counts.append(np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(part)))
        for word in other:
            found = self.whole.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
            ids.append(np.array(found, dtype=np.uint32))
            counts.append(np.array([len(found)]))
        for word in (*plain, *other):
            known[word] = len(known)
        self.ids = np.concatenate(ids)
        self.bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words))


PLAIN = bytes(b for b in range(256) if KINDS[b] in (LETTER, DIGIT, OTHER))


def _plain(word: bytes) -> bool:
    """Whether only plain bytes are left without the letters from U+00C0 to U+00FF."""
    if word.isascii():
        return b"'" not in word
    rest = word.translate(None, PLAIN)
    return not len(rest) % 2 and not rest.strip(LATIN) and all(b == 0xC3 for b in rest[::2]) and not any(b in (0x97, 0xB7, 0xC3) for b in rest[1::2])


LATIN = bytes([0xC3, *range(0x80, 0xC0)])


@functools.cache
def _vocabulary(path: str, added: bool = False) -> _Vocabulary:
    return _Vocabulary(path, added)


def parts_of(data: np.ndarray, offsets: np.ndarray, added: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes of all parts of words, the bounds of the parts, and the number of parts before each row; words with a match of *added* stay as they are."""
    kinds, text = KINDS[data], LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    follow = data[lead + 1]
    fits = (follow >= 0x80) & (follow < 0xC0) & (follow != 0x97) & (follow != 0xB7)
    lead, follow = lead[fits], follow[fits]
    kinds[lead] = kinds[lead + 1] = LETTER
    text[lead + 1] += np.where(follow < 0x9F, 32, 0).astype(np.uint8)
    if added is not None:
        hits = np.array([found.span() for found in added.finditer(data)], dtype=np.int64).reshape(-1, 2)
        hits = hits[np.searchsorted(offsets, hits[:, 0], side="right") == np.searchsorted(offsets, hits[:, 1] - 1, side="right")]  # within a row
        kinds[hits[:, 0]] = ODD
    odd = np.flatnonzero(kinds == ODD)
    if len(odd):  # a word with such a byte stays whole
        starts, ends, _ = word_spans(data, offsets)
        hit = np.unique(np.searchsorted(starts, odd, side="right") - 1)
        sizes = ends[hit] - starts[hit]
        place = np.repeat(starts[hit] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        kinds[place] = ODD
        text[place] = data[place]
    begins = kinds != SPACE
    inside = begins.copy()
    begins[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT) | row_starts(offsets, len(data))[1:]
    starts = np.flatnonzero(begins)
    kept = np.cumsum(inside)
    bounds = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int64)
    return text[inside], bounds, np.searchsorted(starts, offsets)


def token_ids(vocabulary: _Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts with the end token 0 after each, and the offsets of the texts."""
    text, bounds, before = parts_of(*byte_view(column), vocabulary.added)
    words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(text)])
    coded = words.dictionary_encode()
    place = vocabulary.places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    first = vocabulary.bounds[place]
    counts = vocabulary.bounds[place + 1] - first
    total = np.zeros(len(place) + 1, dtype=np.int64)
    np.cumsum(counts, out=total[1:])
    rows = len(column)
    at_row = total[before] + np.arange(rows + 1)
    ids = vocabulary.ids[np.repeat(first - total[:-1], counts) + np.arange(total[-1])]
    out = np.zeros(int(at_row[-1]), dtype=np.uint32)
    inner = np.ones(len(out), dtype=bool)
    inner[at_row[1:] - 1] = False
    out[inner] = ids
    return out, at_row


def tokenise(docs: DataFrame, path: str, size: int = SIZE, id: str = "doc_id", added: bool = False) -> DataFrame:
    """Pieces (id, piece, start, length, ids): each document's token ids and end token, cut after every *size* tokens; ids are little-endian 32-bit.

    *added*: whether added tokens in the texts get their own ids, as in a plain encode.
    """

    def run(batches):
        hand_back()
        vocabulary = _vocabulary(path, added)
        for batch in batches:
            for part in by_bytes(batch, 1, 1 << 20):
                ids, offsets = token_ids(vocabulary, part.column(1))
                pieces = -(-np.diff(offsets) // size)
                row = np.repeat(np.arange(part.num_rows), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * size
                length = np.minimum(np.diff(offsets)[row] - start, size)
                bounds = np.zeros(len(row) + 1, dtype=np.int64)
                np.cumsum(length * 4, out=bounds[1:])  # pieces follow each other without a gap
                binary = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), binary.cast(pa.binary())],
                    ["id", "piece", "start", "length", "ids"],
                )
            hand_back()

    narrow = docs.select(docs[id].alias("id"), docs["text"].cast("string").alias("text"))
    schema = T.StructType([narrow.schema["id"], *T._parse_datatype_string(PIECES).fields])
    return narrow.mapInArrow(run, schema)


def patterns(lengths: np.ndarray, size: int = SIZE, grid: int = GRID) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a sequence as far as the *lengths* there are allow.

    All pairs are listed. Of the triples, those whose first length is one of *grid* spread over the lengths that occur
    and whose other two sum to the rest.
    """
    here = np.zeros(size + 1, dtype=bool)
    here[lengths] = True
    rows = [np.stack([lengths, np.zeros_like(lengths), np.zeros_like(lengths)], axis=1)[lengths == size]]
    pair = lengths[(lengths <= size // 2) & here[size - lengths]]
    rows.append(np.stack([size - pair, pair, np.zeros_like(pair)], axis=1))
    short = lengths[lengths < size - 1]
    for first in short[np.unique(np.linspace(0, len(short) - 1, min(grid, len(short))).astype(int))] if len(short) else []:
        rest = size - first
        second = lengths[(lengths <= rest // 2)]
        second = second[here[rest - second]]
        rows.append(np.stack([rest - second, second, np.full_like(second, first)], axis=1))
    return np.unique(-np.sort(-np.concatenate(rows), axis=1), axis=0)


def non_negative_fit(rows: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used by the patterns near the *histogram* in least squares (accelerated projected gradient)."""
    if not len(rows):
        return np.zeros(0)
    used = rows > 0
    gather = lambda x: np.bincount(rows[used], weights=np.broadcast_to(x[:, None], rows.shape)[used], minlength=len(histogram))
    back = lambda r: (r[rows] * used).sum(axis=1)
    probe = np.ones(len(rows))
    for _ in range(30):  # largest eigenvalue of the normal equations, for the step
        probe = back(gather(probe))
        bound = np.linalg.norm(probe)
        probe /= bound
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - back(gather(y) - histogram) / (1.05 * bound), 0.0)
        step = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if np.dot(y - new, new - x) > 0:  # restart when the momentum points uphill
            step, y = 1.0, new
        else:
            y = new + (t - 1) / step * (new - x)
        x, t = new, step
    return x


def plan(histogram: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) that use up the *histogram* (index: length) exactly."""
    left = histogram.astype(np.int64).copy()
    lengths = np.flatnonzero(left)
    lengths = lengths[lengths > 0]
    found: list[tuple[tuple[int, ...], int]] = []
    rows = patterns(lengths, size) if len(lengths) else np.zeros((0, 3), dtype=np.int64)
    for row, often in zip(rows.tolist(), np.floor(non_negative_fit(rows, left.astype(float)) + 1e-6).astype(np.int64).tolist()):
        row = tuple(x for x in row if x)
        often = min([often, *(int(left[x]) // row.count(x) for x in row)])
        if often > 0:
            for x in row:
                left[x] -= often
            found.append((row, often))
    # Residuals, longest first: each joins the open sequences with the least room that still holds it.
    room: dict[int, list[list]] = {}
    for length in range(size, 0, -1):
        count = int(left[length])
        fits = sorted(r for r in room if r >= length)
        for r in fits:
            while count and room.get(r):
                row, often = room[r].pop()
                put = min(often, count)
                if often > put:
                    room[r].append([row, often - put])
                room.setdefault(r - length, []).append([(*row, length), put])
                count -= put
                if r - length >= length and r - length not in fits:
                    fits.append(r - length)
        while count:
            k = size // length
            put = count // k
            if put:
                room.setdefault(size - k * length, []).append([(length,) * k, put])
                count -= put * k
            else:
                room.setdefault(size - count * length, []).append([(length,) * count, 1])
                count = 0
    merged: dict[tuple[int, ...], int] = {}
    for row, often in [*found, *((tuple(row), often) for rows in room.values() for row, often in rows)]:
        merged[row] = merged.get(row, 0) + often
    return list(merged.items())


def ranges(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: the first piece number of each range, the sequence it begins with, and the place in the sequence."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for row, often in made:
        at = 0
        for length in row:
            begin = taken.get(length, 0)
            out.setdefault(length, []).append((begin, first, at))
            taken[length] = begin + often
            at += length
        first += often
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for length, rows in out.items()}


def pack(pieces: DataFrame, size: int = SIZE, salts: int | None = None) -> DataFrame:
    """*pieces* (id, piece, length, …) with sequence_id and offset.

    Full pieces are sequences of their own, without a plan or a shuffle. The others are numbered in groups of (length, salt) with about
    GROUP pieces each, or *salts* groups of each length. The pieces are written first, with the numbers that salt them.
    """
    rows = saved(pieces.withColumn("number", F.monotonically_increasing_id()))
    short = rows.filter(F.col("length") < size)
    histogram = np.zeros(size + 1, dtype=np.int64)
    for length, count in short.groupBy("length").count().collect():  # size rows at most
        histogram[length] = count
    parts = np.maximum(1, -(-histogram // GROUP)) if salts is None else np.full(size + 1, salts)
    base = np.cumsum(parts) - parts
    salt = F.pmod(F.xxhash64("number"), F.get(F.lit(parts.tolist()), F.col("length").cast("int"))).cast("int")
    salted = short.withColumn("salt", salt).drop("number")
    tally = np.zeros(parts.sum(), dtype=np.int64)
    for length, one, count in salted.groupBy("length", "salt").count().collect():  # a row for GROUP pieces, and one of each length
        tally[base[length] + one] = count
    passed_by = np.cumsum(tally) - tally
    begins = passed_by - np.repeat(passed_by[base], parts)
    made = plan(histogram, size)
    where = ranges(made)
    schema = T.StructType([*salted.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        last, passed = None, 0  # the group at the end of the batch before, and how many of its rows went by
        for batch in batches:
            length, salt = batch.column("length").to_numpy(), batch.column("salt").to_numpy()
            group = base[length] + salt
            new = np.flatnonzero(np.diff(group, prepend=-1))
            sizes = np.diff(new, append=len(group))
            rank = np.arange(len(group)) - np.repeat(new, sizes)
            if len(group):
                rank[: sizes[0]] += passed if group[0] == last else 0
                last, passed = group[-1], rank[-1] + 1
            number = begins[group] + rank
            sequence_id, offset = np.empty(len(group), dtype=np.int64), np.empty(len(group), dtype=np.int64)
            for one in np.unique(length):
                first, sequence, at = where[int(one)]
                mine = length == one
                found = np.searchsorted(first, number[mine], side="right") - 1
                sequence_id[mine], offset[mine] = sequence[found] + number[mine] - first[found], at[found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence_id), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"])

    ordered = salted.repartition("length", "salt").sortWithinPartitions("length", "salt", "id", "piece")
    placed = ordered.mapInArrow(run, schema).drop("salt")
    planned = sum(often for _, often in made)
    whole = rows.filter(F.col("length") >= size).withColumns({"sequence_id": F.col("number") + planned, "offset": F.lit(0).cast("long")})
    return placed.unionByName(whole.drop("number"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    pieces = tokenise(table(spark, folder, "documents"), tokenizer_path(), added=True).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces).withColumnRenamed("id", "doc_id")


QUERIES = {"op10_pack_sequences": (op10_pack_sequences, None)}
