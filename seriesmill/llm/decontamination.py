"""Benchmark decontamination: test n-grams as a broadcast hash set, scanned over all training windows.

Letters A-Z are lowered and words are runs of digits, letters and all characters beyond ASCII. A window is *n* consecutive
words of an item; an item of fewer words is one window of its own length. The windows of the items are hashed into sorted
64-bit sets, one per window length, which every task gets together with the items' words. Documents pass by once: rolling
hashes of their windows are looked up, each hit is verified word for word, and the words under verified windows are marked.
Nothing of the documents is shuffled.

The broadcast is bounded: items are cut into pieces of PIECE words (which overlap, so that no window is lost), and pieces
are dealt to blocks of at most BLOCK bytes of words, about four times that in memory. Benchmarks beyond one block are
scanned block by block, against numbered documents written once; the hits of a document are united afterwards.

NULL and empty texts have no words and no hits. Repeated documents, and documents without id, are each judged on their own.
Items of one id are one item, those without words have no window, and those without id mark words but are not listed.
An empty benchmark hits nothing, an empty table of documents gives an empty result, columns of any name pass through.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER, by_bytes, byte_view, row_starts, saved, table

N = 10
PIECE = 4096  # words of an item in one piece
BLOCK = 1 << 24  # bytes of words in one broadcast
STEP = 1 << 17  # words hashed at once

WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True  # after lowering
BYTES_BASE, WORDS_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so that they have inverses


@functools.lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    """1, base, base**2 … modulo 2**64."""
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _room(size: int) -> int:
    return 1 << max(10, (size - 1).bit_length())


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash of each run values[begin:end], wherever it lies."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, _room(len(values)))[: len(values)], out=sums[1:])
    back = _powers(pow(base, -1, 1 << 64), _room(len(values) + 1))
    return (sums[ends] - sums[begins]) * back[begins]


class Words:
    """The words of a column of texts: where they lie, whose they are, and their bytes with one space between them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.text = LOWER[data]
        inside = WORD[self.text]
        first = row_starts(offsets, len(data))
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | first[1:]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.before = np.searchsorted(self.starts, offsets)  # words before each row
        kept = inside
        kept[1:] |= stops[:-1] & ~inside[1:] & ~first[1:]  # the byte after a word
        self.text = np.where(WORD[self.text], self.text, np.uint8(32))[kept]
        place = np.cumsum(kept)
        self.begins, self.stops = place[self.starts] - 1, place[self.ends - 1]

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self, lengths):
        """(length, first words, hashes) of all windows of these *lengths*, some words at a time."""
        if not len(lengths):
            return
        reach = max(lengths)
        last = np.repeat(self.before[1:], np.diff(self.before))  # the end of each word's row
        for begin in range(0, len(self), STEP):
            end = min(begin + STEP + reach - 1, len(self))
            low = self.begins[begin]
            piece = self.text[low : self.stops[end - 1]].astype(np.uint64)
            one = _mixed(_runs(piece, self.begins[begin:end] - low, self.stops[begin:end] - low, BYTES_BASE))
            for length in lengths:
                at = np.arange(min(STEP, end - begin - length + 1)) if end - begin >= length else np.zeros(0, dtype=np.int64)
                at = at[last[begin + at] - begin - at >= length]
                if len(at):
                    yield length, begin + at, _mixed(_runs(one, at, at + length, WORDS_BASE) + np.uint64(length))


def _same(x, x_begins, x_ends, y, y_begins, y_ends, step: int = 1 << 22) -> np.ndarray:
    """Whether the bytes x[x_begin:x_end] and y[y_begin:y_end] agree, pair by pair."""
    sizes = x_ends - x_begins
    equal = sizes == y_ends - y_begins
    pairs = np.flatnonzero(equal)
    while len(pairs):
        total = np.cumsum(sizes[pairs])
        now, pairs = np.split(pairs, [max(1, int(np.searchsorted(total, step, side="right")))])
        size = sizes[now]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differ = x[np.repeat(x_begins[now], size) + inner] != y[np.repeat(y_begins[now], size) + inner]
        equal[now[np.unique(np.repeat(np.arange(len(now)), size)[differ])]] = False
    return equal


class Index:
    """The different windows of a block of items; per length their hashes in order, their words, and the items of each."""

    def __init__(self, names: list[str | None], texts: list[bytes], n: int = N):
        order = {name: i for i, name in enumerate(sorted({name for name in names if name is not None}))}
        self.names = list(order)
        owner = np.array([order.get(name, -1) for name in names], dtype=np.int32)
        words = Words(*byte_view(pa.array(texts, pa.large_binary())))
        self.text = words.text
        counts = np.diff(words.before)
        self.sets = {}
        for length in np.unique(np.minimum(counts[counts > 0], n)).tolist():
            found = [(at, hashes) for _, at, hashes in words.windows([length])]
            at, hashes = (np.concatenate(x) for x in zip(*found))
            row = np.searchsorted(words.before, at, side="right") - 1
            mine = counts[row] >= n if length == n else counts[row] == length
            at, hashes, row = at[mine], hashes[mine], row[mine]
            rank = np.lexsort((at, hashes))
            at, hashes, row = at[rank], hashes[rank], row[rank]
            begins, ends = words.begins[at], words.stops[at + length - 1]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | ~_same(self.text, begins[1:], ends[1:], self.text, begins[:-1], ends[:-1])
            first = np.flatnonzero(new)
            bits = min(24, max(12, int(len(first)).bit_length() + 5))
            flags = np.zeros(1 << bits, dtype=bool)
            flags[(hashes[first] >> np.uint64(64 - bits)).astype(np.int64)] = True
            runs = np.diff(np.flatnonzero(np.append(np.diff(hashes[first], prepend=~hashes[first[:1]]) != 0, True)))
            self.sets[length] = {
                "hashes": hashes[first],
                "begins": begins[first].astype(np.int32),
                "ends": ends[first].astype(np.int32),
                "bounds": np.append(first, len(at)),
                "owners": owner[row],
                "flags": np.packbits(flags),
                "bits": bits,
                "most": int(runs.max()),  # windows with the same hash
            }

    def find(self, words: Words):
        """(length, first words, windows) of all verified hits in *words*, part by part."""
        open_flags = {length: np.unpackbits(found["flags"]).view(bool) for length, found in self.sets.items()}
        for length, at, hashes in words.windows(sorted(self.sets)):
            one = self.sets[length]
            mine = open_flags[length][(hashes >> np.uint64(64 - one["bits"])).astype(np.int64)]
            at, hashes = at[mine], hashes[mine]
            place = np.searchsorted(one["hashes"], hashes)
            for _ in range(one["most"]):
                mine = place < len(one["hashes"])
                mine[mine] = one["hashes"][place[mine]] == hashes[mine]
                at, hashes, place = at[mine], hashes[mine], place[mine]
                if not len(at):
                    break
                begins, ends = words.begins[at], words.stops[at + length - 1]
                good = _same(words.text, begins, ends, self.text, one["begins"][place], one["ends"][place])
                yield length, at[good], place[good]
                place = place + 1


def _hits(words: Words, index: Index) -> tuple[np.ndarray, dict[int, list[str]]]:
    """A flag for each word under a window, and the names of the items found in each row."""
    edges = np.zeros(len(words) + 1, dtype=np.int32)
    met: dict[tuple[int, int], list[np.ndarray]] = {}
    for length, at, window in index.find(words):
        np.add.at(edges, at, 1)
        np.add.at(edges, at + length, -1)
        row = np.searchsorted(words.before, at, side="right") - 1
        pairs = np.unique(np.stack([row, window]), axis=1)
        for one in np.unique(pairs[0]):
            met.setdefault((int(one), length), []).append(pairs[1][pairs[0] == one])
    codes: dict[int, list[np.ndarray]] = {}
    for (row, length), windows in met.items():
        bounds, owners = index.sets[length]["bounds"], index.sets[length]["owners"]
        for window in np.unique(np.concatenate(windows)).tolist():
            codes.setdefault(row, []).append(owners[bounds[window] : bounds[window + 1]])
    names = {row: [index.names[i] for i in np.unique(np.concatenate(found)).tolist() if i >= 0] for row, found in codes.items()}
    return np.cumsum(edges[:-1]) > 0, names


SPANS = "array<struct<begin:bigint,stop:bigint>>"
RESULT = f"n_words bigint, n_hit bigint, items array<string>, spans {SPANS}, kept string"
RESULTS = ["n_words", "n_hit", "items", "spans", "kept"]
RUNS = f"items array<string>, spans {SPANS}"


def _lists(rows: int, counts: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> pa.Array:
    bounds = np.zeros(rows + 1, dtype=np.int32)
    np.cumsum(counts, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(begins), pa.array(stops)], ["begin", "stop"]))


def _flag_runs(flags: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of each run of flags within a row, and the row."""
    first = row_starts(before, len(flags)) if len(flags) else flags
    begins, stops = flags.copy(), flags.copy()
    begins[1:] &= ~flags[:-1] | first[1:]
    stops[:-1] &= ~flags[1:] | first[1:]
    begins, stops = np.flatnonzero(begins), np.flatnonzero(stops)
    return begins, stops, np.searchsorted(before, begins, side="right") - 1


def _judged(column: pa.Array, words: Words, offsets: np.ndarray, flags: np.ndarray, names, keep: bool) -> list[pa.Array]:
    """The columns of RESULT for texts whose hit words are flagged."""
    rows = len(column)
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    first, last, row = _flag_runs(flags, words.before)
    begins, stops = words.starts[first] - offsets[row], words.ends[last] - offsets[row]
    counts = np.bincount(row, minlength=rows)
    kept: list = column.to_pylist() if keep else [None] * rows
    if keep:
        at = np.concatenate([[0], np.cumsum(counts)])
        for one in np.flatnonzero(counts).tolist():
            raw = kept[one].encode()
            cuts = slice(at[one], at[one + 1])
            edges = [0, *np.stack([begins[cuts], stops[cuts]], axis=1).ravel().tolist(), len(raw)]
            kept[one] = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
    return [
        pa.array(np.diff(words.before).astype(np.int64)),
        pa.array(total[words.before[1:]] - total[words.before[:-1]]),
        pa.array(names, pa.list_(pa.string())),
        _lists(rows, counts, begins.astype(np.int64), stops.astype(np.int64)),
        pa.array(kept, pa.string()),
    ]


def _pieces(benchmark: DataFrame, id: str, text: str, n: int) -> DataFrame:
    """Rows (item, words): the items' words with one space between them, long items in pieces that share n - 1 words."""
    lowered = F.translate(benchmark[text].cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    found = benchmark.select(benchmark[id].cast("string").alias("item"), words.alias("words")).filter(F.size("words") > 0)
    begins = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (n - 1)), F.lit(PIECE))
    found = found.select("item", "words", F.explode(begins).alias("begin"))
    return found.select("item", F.concat_ws(" ", F.slice("words", F.col("begin"), PIECE + n - 1)).alias("words"))


def _blocks(pieces: DataFrame, block: int) -> tuple[DataFrame, int]:
    """*pieces* with a block number, and how many blocks there are, none of more than *block* bytes (one piece at least)."""
    count = 1
    while True:
        number = F.lit(0) if count == 1 else F.pmod(F.xxhash64("item", "words"), F.lit(count)).cast("int")
        dealt = pieces.withColumn("block", number)
        most = dealt.groupBy("block").agg(F.sum(F.octet_length("words") + 1).alias("size"), F.countDistinct("words").alias("n"))
        worst = most.filter((F.col("size") > block) & (F.col("n") > 1)).agg(F.max("size")).first()[0]
        if worst is None:
            return dealt, count
        count = max(count * 2, -(-2 * count * worst // block))


def scanned(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, block: int = BLOCK, keep: bool = True
) -> DataFrame:
    """Rows (row, n_words, n_hit, items, spans, kept): *row* holds all columns of a document, *items* the found item ids in order,
    *spans* the bytes of its text under windows, *kept* the text without them (NULL unless *keep*)."""
    spark = docs.sparkSession
    # Distinct on hashed pairs of whole words: repeated items cost one piece.
    pieces, count = _blocks(saved(_pieces(benchmark, item, item_text, n).distinct()), block)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].cast("string").alias("text"))
    if count == 1:
        schema = T.StructType([packed.schema["row"], *T._parse_datatype_string(RESULT).fields])
        return packed.mapInArrow(functools.partial(_whole, index=_sent(spark, pieces, n), keep=keep), schema)
    packed = saved(packed.withColumn("number", F.monotonically_increasing_id()))
    runs = T.StructType([packed.schema["number"], *T._parse_datatype_string(RUNS).fields])
    parts = []
    for one in range(count):
        index = _sent(spark, pieces.filter(F.col("block") == one), n)
        parts.append(saved(packed.select("number", "text").mapInArrow(functools.partial(_part, index=index), runs)))
    # At most *count* rows of a document meet here.
    hits = functools.reduce(DataFrame.union, parts).groupBy("number")
    hits = hits.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    joined = packed.join(hits, "number", "left").select("row", "text", "items", "spans")
    schema = T.StructType([packed.schema["row"], *T._parse_datatype_string(RESULT).fields])
    return joined.mapInArrow(functools.partial(_united, keep=keep), schema)


def _sent(spark: SparkSession, pieces: DataFrame, n: int):
    """The index of one block, for all tasks; its size is that of a block."""
    rows = pieces.select("item", "words").toArrow()
    return spark.sparkContext.broadcast(Index(rows.column(0).to_pylist(), [x.encode() for x in rows.column(1).to_pylist()], n))


def _whole(batches, index, keep):
    for batch in batches:
        for part in by_bytes(batch, 1):
            data, offsets = byte_view(part.column(1))
            words = Words(data, offsets)
            flags, items = _hits(words, index.value)
            items = [items.get(i, []) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), *_judged(part.column(1), words, offsets, flags, items, keep)], ["row", *RESULTS])


def _part(batches, index):
    """Items and hit words of the rows that one block hits."""
    for batch in batches:
        for part in by_bytes(batch, 1):
            words = Words(*byte_view(part.column(1)))
            flags, items = _hits(words, index.value)
            first, last, row = _flag_runs(flags, words.before)
            counts = np.bincount(row, minlength=part.num_rows)
            at = np.flatnonzero(counts)
            spans = _lists(len(at), counts[at], first - words.before[row], last + 1 - words.before[row])
            named = pa.array([items.get(i, []) for i in at.tolist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), named, spans], ["number", "items", "spans"])


def _united(batches, keep):
    """Judges documents by the hit words of all blocks."""
    for batch in batches:
        for part in by_bytes(batch, 1):
            data, offsets = byte_view(part.column(1))
            words = Words(data, offsets)
            spans = part.column(3)
            row = np.repeat(np.arange(part.num_rows), spans.value_lengths().fill_null(0).to_numpy())
            flat = spans.flatten()
            edges = np.zeros(len(words) + 1, dtype=np.int32)
            np.add.at(edges, words.before[row] + flat.field(0).to_numpy(), 1)
            np.add.at(edges, words.before[row] + flat.field(1).to_numpy(), -1)
            items = [x or [] for x in part.column(2).to_pylist()]
            judged = _judged(part.column(1), words, offsets, np.cumsum(edges[:-1]) > 0, items, keep)
            yield pa.RecordBatch.from_arrays([part.column(0), *judged], ["row", *RESULTS])


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text: str = "text", **settings) -> DataFrame:
    """*docs* without the passages of *benchmark* (``remove="spans"``) or without the documents that hold one (``"documents"``)."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    found = scanned(docs, benchmark, text, keep=remove == "spans", **settings)
    if remove == "documents":
        return found.filter("n_hit = 0").select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return found.select(*[(F.col("kept").cast(docs.schema[c].dataType) if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def op13_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = scanned(docs, table(spark, folder, "benchmark"), keep=False)
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, coalesce({_WORDS}, []) AS words FROM documents
), items AS MATERIALIZED (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item, least(len(words), {N}) AS size, array_to_string(words[i : i + least(len(words), {N}) - 1], ' ') AS w
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - {N} + 1, 1) + 1)) AS i FROM items WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT size FROM windows), seen AS (
  SELECT row, size, i, array_to_string(words[i : i + size - 1], ' ') AS w
  FROM (SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM docs, sizes WHERE len(words) >= size)
), hits AS MATERIALIZED (
  SELECT row, seen.size, i, item FROM seen JOIN windows ON seen.w = windows.w AND seen.size = windows.size
), covered AS (
  SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS k FROM hits) GROUP BY row
), named AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT row, item FROM hits WHERE item IS NOT NULL) GROUP BY row
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""

QUERIES = {"op13_decontaminate": (op13_decontaminate, OP13_SQL)}
