"""SimHash near-duplicates, found with Golay codes.

A document's fingerprint has a bit for each of the 64 bits of its shingles' hashes: set where over half the shingles
have it. Fingerprints that differ in at most 4 bits are linked. To find them, the fingerprint is cut into segments of
22, 21 and 21 bits, each read as a word of the perfect binary Golay code of length 23. Every word lies within 3 bits of
exactly one codeword, whose 12 message bits are its index; the fuzzy keys of a word are the indices of itself and of
all words one bit away. They are 1 or 6 keys, and

* words at most 1 bit apart: the index of either is among the fuzzy keys of the other;
* words at most 2 bits apart: they share a fuzzy key, as there is a word one bit from both.

Of 4 errors in three segments, either one segment has none and another at most two: key (the whole segment, a fuzzy key
of the other), for each ordered pair of segments; or two segments have one each: keys (fuzzy key, index) and (index,
fuzzy key) for each pair of segments. So no pair is missed. Fingerprints with a key in common are compared, and links
that span each group are kept, not all pairs. Groups beyond a few thousand different fingerprints are cut into blocks,
and pairs of blocks are spread over tasks.

Documents with equal fingerprints are one node, so copies cost nothing. A NULL or blank text has fingerprint 0, which
links like any other. Rows with a NULL id keep their fingerprint and component, but give no component its id. Repeated rows stay. An empty table gives an
empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import LOWER, by_bytes, byte_view, saved, table, word_spans

WORDS = 4
SEED = 42
DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GROUP = 4096
SMALL = 8
GENERATOR = 0b110001110101


def shingle_hashes(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles in text order, and the bounds of the texts."""
    data, offsets = byte_view(column)
    starts, ends, before = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(column) + 1, dtype=np.int64)
    lengths = ends - starts
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=at[1:])
    joined = np.full(at[-1], 32, dtype=np.uint8)  # every word followed by one space
    joined[np.repeat(at[:-1] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())] = LOWER[data[~_outside(data)]]
    counts = np.diff(before)
    shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(shingles, out=bounds[1:])
    first = np.repeat(before[:-1] - bounds[:-1], shingles) + np.arange(bounds[-1])
    last = np.minimum(first + words, np.repeat(before[1:], shingles))
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    found = np.fromiter((digest(text[s:e], SEED) for s, e in zip(at[first].tolist(), (at[last] - 1).tolist())), dtype=np.uint64, count=len(first))
    return found, bounds


def fingerprints(column: pa.Array, words: int = WORDS) -> np.ndarray:
    """The fingerprint of each text as an unsigned 64-bit number."""
    return prints_of(*shingle_hashes(column, words))


def prints_of(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The fingerprints of texts from what :func:`shingle_hashes` gives of them."""
    shingles = np.diff(bounds)
    out = np.zeros(len(shingles), dtype=np.uint64)
    full = np.flatnonzero(shingles)
    step = 1 << 16
    votes = np.zeros((len(shingles), 64), dtype=np.int32)
    row = np.repeat(np.arange(len(shingles)), shingles)
    for begin in range(0, len(found), step):  # bits of a part of the hashes at a time
        part = np.unpackbits(found[begin : begin + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = row[begin : begin + step]
        new = np.flatnonzero(np.diff(rows, prepend=-1))
        votes[rows[new]] += np.add.reduceat(part, new, axis=0, dtype=np.int32)
    bits = votes[full] * 2 > shingles[full, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _outside(data):
    return (data == 32) | ((data >= 9) & (data <= 13))


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _errors() -> np.ndarray:
    """The error of weight 3 or less for each of the 2048 remainders."""
    one = 1 << np.arange(23)
    two = (one[:, None] | one)[np.triu_indices(23, 1)]
    three = np.unique((two[:, None] | one).ravel())
    errors = np.concatenate([[0], one, two, three[np.bitwise_count(three) == 3]])
    out = np.zeros(2048, dtype=np.int64)
    out[_syndromes(errors)] = errors
    return out


def _indices(words: np.ndarray, errors: np.ndarray) -> np.ndarray:
    return (words ^ errors[_syndromes(words)]) >> 11


def fuzzy_keys(words: np.ndarray, bits: int, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of each word and of its neighbours within *bits*, and which of them are the first of their value."""
    near = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(bits))], axis=1)
    keys = np.sort(_indices(near, errors), axis=1)
    new = np.ones(keys.shape, dtype=bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, new


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints, and the row of each."""
    errors = _errors()
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    index = [_indices(part, errors) for part in parts]
    fuzzy = [fuzzy_keys(part, bits, errors) for part, (_, bits) in zip(parts, SEGMENTS)]
    keys, rows, family = [], [], 0
    for i in range(3):
        for j in range(3):
            if i == j:
                continue
            values, new = fuzzy[j]
            row = np.nonzero(new)[0]
            keys.append((family << 48) | (parts[i][row] << 12) | values[new])
            keys.append(((8 + min(i, j) + max(i, j)) << 48) | np.where(i < j, (index[i][row] << 12) | values[new], (values[new] << 12) | index[i][row]))
            rows += [row, row]
            family += 1
    return np.concatenate(keys), np.concatenate(rows)


def spanning_links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what lies within *distance*, one less than the members of each group of links."""
    root = np.arange(len(values))
    links = []

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for begin in range(0, len(values), 512):
        part = values[begin : begin + 512]
        hit_a, hit_b = np.nonzero(np.bitwise_count(part[:, None] ^ values[None, :]) <= distance)
        hit_a = hit_a + begin
        keep = hit_a < hit_b
        hit_a, hit_b = hit_a[keep], hit_b[keep]
        while len(hit_a):  # drop pairs that are joined already, then join the first of the rest for each b
            top = np.array([find(k) for k in range(len(values))])
            open_pairs = top[hit_a] != top[hit_b]
            hit_a, hit_b = hit_a[open_pairs], hit_b[open_pairs]
            for k in np.unique(hit_b, return_index=True)[1]:
                a, b = find(hit_a[k]), find(hit_b[k])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links.append((int(values[hit_a[k]]), int(values[hit_b[k]])))
    return links


LINKS = "key long, a long, b long, block int"


def _compare(distance: int, group: int | None):
    """Links within the runs of equal keys of a sorted partition; runs over *group* rows are passed on in blocks."""

    def links_of(key, value):
        new = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        sizes = np.diff(new, append=len(key))
        small = np.repeat(sizes <= SMALL, sizes)
        found = []
        for off in range(1, SMALL):
            same = small[off:] & (key[off:] == key[:-off]) if len(key) > off else np.zeros(0, dtype=bool)
            near = np.flatnonzero(same)
            near = near[np.bitwise_count(value[near] ^ value[near + off]) <= distance]
            found.append(np.stack([value[near], value[near + off]], axis=1).view(np.int64))
        for begin, size in zip(new[sizes > SMALL], sizes[sizes > SMALL]):
            links = spanning_links(np.unique(value[begin : begin + size]), distance)
            if links:
                found.append(np.array(links, dtype=np.uint64).view(np.int64))
        return np.concatenate(found)

    def rows(keys, a, b, blocks):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(blocks, pa.int32())], ["key", "a", "b", "block"])

    def run(batches):
        held_key, held_value, passed = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), 0  # the run that may go on; blocks of it passed on
        for batch in _with_end(batches):
            if batch is None:
                key, value, cut = held_key, held_value, len(held_key)
            else:
                key = np.concatenate([held_key, batch.column(0).to_numpy()])
                value = np.concatenate([held_value, batch.column(1).to_numpy().view(np.uint64)])
                cut = int(np.searchsorted(key, key[-1], side="left")) if len(key) else 0  # the last run waits for the next batch
            begin = 0
            if passed and len(key):  # the rest of a run of which blocks went before
                end = int(np.searchsorted(key, key[0], side="right"))
                if end <= cut:
                    yield rows(key[:end], value[:end].view(np.int64), np.full(end, None), np.full(end, passed))
                    begin, passed = end, 0
            if begin < cut:
                sizes = np.diff(np.flatnonzero(np.diff(key[begin:cut], prepend=key[begin] - 1)), append=cut - begin)
                large = np.repeat(sizes > group, sizes) if group else np.zeros(cut - begin, dtype=bool)
                found = links_of(key[begin:cut][~large], value[begin:cut][~large]) if not large.all() else np.zeros((0, 2), dtype=np.int64)
                if len(found):
                    yield rows(np.full(len(found), None), found[:, 0], found[:, 1], np.full(len(found), None))
                if large.any():
                    place = np.arange(cut - begin) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    yield rows(key[begin:cut][large], value[begin:cut][large].view(np.int64), np.full(large.sum(), None), place[large] // group)
            cut = max(cut, begin)
            held_key, held_value = key[cut:], value[cut:]
            while group and len(held_key) > group:  # too long already: hand on a block
                yield rows(held_key[:group], held_value[:group].view(np.int64), np.full(group, None), np.full(group, passed))
                held_key, held_value, passed = held_key[group:], held_value[group:], passed + 1

    return run


def _with_end(batches):
    yield from batches
    yield None


def link_prints(prints: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Links (a, b) between the different fingerprints of *prints* (print) that span every group within *distance*."""
    if not 0 <= distance <= 4:
        raise ValueError("the keys cover 4 differing bits at most")

    def expand(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                value = batch.column(0).slice(begin, 4096).to_numpy()
                key, row = keys_of(value.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value[row])], ["key", "print"])

    keyed = prints.select("print").mapInArrow(expand, "key long, print long")
    found = saved(keyed.repartition("key").sortWithinPartitions("key", "print").mapInArrow(_compare(distance, group), LINKS))
    links, blocks = found.filter("block IS NULL"), found.filter("block IS NOT NULL")
    if not blocks.isEmpty():
        count = blocks.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        pairs = blocks.join(count, "key").withColumn("other", other)
        pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
        pairs = pairs.select(pair.alias("key"), F.col("a").alias("print")).distinct()
        links = links.union(pairs.repartition("key").sortWithinPartitions("key", "print").mapInArrow(_compare(distance, None), LINKS))
    return links.select("a", "b")


def print_groups(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Different fingerprints (print, …) with the smallest one that links reach, *root*."""
    found = components(link_prints(prints, distance))
    return prints.join(found, prints["print"] == found["node"], "left").select(*prints.columns, F.coalesce("component", "print").alias("root"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", words: int = WORDS, distance: int = DISTANCE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, print, component, root, *carry*): the fingerprint as a signed 64-bit number, and the smallest id and fingerprint that links reach."""
    carried = [f"carry_{c}" for c in carry]
    narrow = docs.select(docs[id].alias("id"), docs["text"].cast("string").alias("text"), *(docs[c].alias(f"carry_{c}") for c in carry))

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, 1, 1 << 19):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part.column(1), words).view(np.int64)), *part.columns[2:]], ["id", "print", *carried])

    printed = saved(narrow.mapInArrow(run, narrow.select("id", F.lit(0).cast("long").alias("print"), *carried).schema))
    prints = saved(printed.groupBy("print").agg(F.min("id").alias("first")))
    rooted = print_groups(prints, distance)
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least, "root").select("print", "component", "root")
    return printed.join(named, "print").select("id", "print", "component", "root", *(F.col(f"carry_{c}").alias(c) for c in carry))


def op9_simhash_golay(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op9_simhash_golay": (op9_simhash_golay, None)}
