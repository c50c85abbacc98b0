"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model reads a text as its lower-cased words, one space between them and an end byte after the last; before a text
stands the end byte. It is a trie of byte contexts of up to ORDER bytes with the counts of what followed them in the
training documents. A byte is coded in its longest known context, half a count being taken from each byte seen there; where it was not
among them, an escape with what was taken (PPM method D) leads to the next shorter context, in which the bytes that were seen in the
longer one are excluded. Below the empty context all bytes that are left are equal. The score is the log10 probability
of all bytes. Next to it stands the score of a smoothed unigram model of the words and the end.

What a byte costs depends on the ORDER bytes before it alone, so texts are scored by their different grams (context and
byte). Documents are dealt to blocks of bounded size. A block hands on its different grams and words with their training counts, compressed
in pieces by bucket: grams by a hash of the last three bytes of the context, words by their own. In a bucket the counts of all
blocks are added, the costs of all grams are computed, and the answers go back to the blocks that asked. The number of
buckets grows with that of the blocks. The trie is thus never in one place; only the contexts of up to two bytes are, at most 2^24 counts. All counts grow
with the corpus.

A NULL text counts as empty; it has the end token alone. Rows with a NULL id count as training. Repeated rows are documents of their own. An
empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, SPACES, byte_view, saved, table, word_spans

ORDER = 5
SHARED = 2  # contexts of up to so many bytes are known to all tasks
BLOCK_BYTES = 1 << 25
BLOCKS = 32
BUCKETS = 256
SLICE = 1 << 20
END = 10


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The bytes that the model reads, their offsets by row, the words, and the number of words before each row."""
    starts, ends, before = word_spans(data, offsets)
    sizes = ends - starts
    rows = len(offsets) - 1
    counts = np.diff(before)
    bounds = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=bounds[1:])
    packed = LOWER[data[~SPACES[data]]]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    lengths = np.maximum(np.bincount(np.repeat(np.arange(rows), counts), sizes + 1, rows).astype(np.int64), 1)
    at = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(lengths, out=at[1:])
    out = np.full(at[-1], 32, dtype=np.uint8)
    out[at[1:] - 1] = END
    blank = np.cumsum(counts == 0) - (counts == 0)  # end bytes of blank rows before each row
    gaps = np.arange(len(starts)) + np.repeat(blank, counts)
    out[np.repeat(gaps, sizes) + np.arange(bounds[-1])] = packed
    return out, at, words, before


def grams(text: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte: the bytes before it, the nearest in the highest place, then itself in the lowest."""
    rows = len(offsets) - 1
    room = np.full(len(text) + order * rows, END, dtype=np.uint8)
    place = np.arange(len(text)) + order * np.repeat(np.arange(1, rows + 1), np.diff(offsets))
    room[place] = text
    wide = room.astype(np.uint64)
    out = wide.copy()
    for back in range(1, order + 1):
        out[back:] |= wide[:-back] << np.uint64(8 * (order - back + 1))
    return out[place]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _slices(rows: pa.Table, unpack):
    """(part of the rows, their texts) in slices of bounded size."""
    for batch in rows.combine_chunks().to_batches():
        texts, first, size = [], 0, 0
        for n, packed in enumerate(batch.column("packed")):
            texts.append(unpack(packed.as_py()))
            size += len(texts[-1])
            if size >= SLICE or len(texts) == 60_000:
                yield batch.slice(first, len(texts)), pa.array(texts, pa.large_binary())
                texts, first, size = [], n + 1, 0
        if texts:
            yield batch.slice(first, len(texts)), pa.array(texts, pa.large_binary())


def squeeze(*columns: np.ndarray) -> bytes:
    """Equally long number columns, compressed; the first is sorted and stored by its steps."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in (first, *columns[1:])))


def unsqueeze(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    rows, at, out = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for kind in kinds:
        size = rows * np.dtype(kind).itemsize
        out.append(np.frombuffer(data[at : at + size], dtype=kind))
        at += size
    return [np.cumsum(out[0], dtype=kinds[0]), *out[1:]]


def squeeze_words(words: pa.Array, counts: np.ndarray) -> bytes:
    data, offsets = byte_view(words)
    parts = (np.array([len(words)], dtype=np.int64), np.diff(offsets).astype(np.int32), counts.astype(np.int64), data)
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in parts))


def unsqueeze_words(blob: bytes) -> tuple[pa.Array, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    rows = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
    sizes = np.frombuffer(data, dtype=np.int32, count=rows, offset=8)
    counts = np.frombuffer(data, dtype=np.int64, count=rows, offset=8 + 4 * rows) if not rows % 2 else np.frombuffer(data[8 + 4 * rows : 8 + 12 * rows], dtype=np.int64)
    bounds = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(sizes, out=bounds[1:])
    return pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(bounds), pa.py_buffer(data[8 + 12 * rows :])]), counts


GRAMS, WORDS, CLOSE = range(3)
ASKED = "block long, bucket long, kind int, data binary"


def _rows(rows: list[tuple]) -> pa.Table:
    block, bucket, kind, data = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"block": pa.array(block, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "kind": pa.array(kind, pa.int32()), "data": pa.array(data, pa.binary())})


def _bucket_of(gram: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Contexts of three bytes stay together."""
    owner = (gram >> np.uint64(8 * (order - SHARED))) * np.uint64(0x9E3779B97F4A7C15)
    return ((owner >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _parts(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], bucket[order[1:]] != bucket[order[:-1]]])) if len(order) else []
    for begin, end in zip(begins, [*begins[1:], len(order)]):
        yield int(bucket[order[begin]]), order[begin:end]


def _count(order: int, buckets: int):
    """The different grams and words of a block with the training documents' counts, in pieces by bucket."""

    def run(key, rows):
        block, unpack = key[0].as_py(), zstandard.ZstdDecompressor().decompress
        found, words = [], []
        for part, texts in _slices(rows, unpack):
            text, offsets, parts, before = stream(*byte_view(texts))
            held = part.column("held").to_numpy(zero_copy_only=False)
            keys = (grams(text, offsets, order) << np.uint64(1)) | np.repeat(held, np.diff(offsets)).astype(np.uint64)
            keys.sort()
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts = np.diff(new, append=len(keys)) * (keys[new] & np.uint64(1) == 0)
            found.append((keys[new] >> np.uint64(1), counts))
            if len(found) == 8:
                found = [_merge(found)]
            coded = parts.dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False)
            trained = np.bincount(index, np.repeat(~held, np.diff(before)), len(coded.dictionary)).astype(np.int64)
            words.append(pa.table({"word": coded.dictionary, "n": trained}))
            if len(words) == 8:
                words = [_add_up(words)]
        if not found:
            return _rows([])
        gram, count = _merge(found)
        out = [(block, bucket, GRAMS, squeeze(gram[at], count[at])) for bucket, at in _parts(_bucket_of(gram, order, buckets))]
        short = (gram >> np.uint64(8 * (order - SHARED + 1)) << np.uint64(8)) | (gram & np.uint64(255))
        out.append((block, -1, CLOSE, squeeze(*_merge([(short[count > 0], count[count > 0])]))))
        tally = _add_up(words)
        word, number = tally["word"].combine_chunks(), tally["n"].to_numpy()
        place = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in word.to_pylist()), dtype=np.int64, count=len(word))
        out += [(block, bucket, WORDS, squeeze_words(word.take(pa.array(at)), number[at])) for bucket, at in _parts(place)]
        return _rows(out)

    return run


def _add_up(words: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(words).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def _close(batches):
    """Counts of (context of SHARED bytes, byte)."""
    for batch in batches:
        found = [unsqueeze(blob.as_py(), (np.uint64, np.int64)) for blob in batch.column(0)]
        if found:
            key, count = _merge(found)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], ["key", "n"])


class Short:
    """Contexts of up to SHARED bytes from the counts of (context, byte), the nearest byte in the highest place."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels = [None] * (SHARED + 1)
        self.levels[SHARED] = (keys, counts)
        for order in range(SHARED - 1, -1, -1):
            keys, counts = self.levels[order + 1]
            self.levels[order] = _merge([((keys >> np.uint64(16)) << np.uint64(8) | (keys & np.uint64(255)), counts)])

    def counts(self, order: int, context: np.ndarray, byte: np.ndarray) -> np.ndarray:
        keys, counts = self.levels[order]
        wanted = (context << np.uint64(8)) | byte
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, counts[at], 0) if len(keys) else np.zeros(len(wanted), dtype=np.int64)

    def totals(self, order: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, distinct bytes, and, for their bytes, the count in the context one byte shorter."""
        keys, counts = self.levels[order]
        owner = keys >> np.uint64(8)
        begin, end = np.searchsorted(owner, context, side="left"), np.searchsorted(owner, context, side="right")
        below = self.counts(order - 1, owner >> np.uint64(8), keys & np.uint64(255)) if order else np.zeros(len(keys), dtype=np.int64)
        sums, lower = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, below))
        return sums[end] - sums[begin], end - begin, lower[end] - lower[begin]


def costs(gram: np.ndarray, count: np.ndarray, short: Short, order: int) -> np.ndarray:
    """log10 probability of each of the sorted, different *gram*s; all grams of their contexts of three bytes must be there."""
    byte = gram & np.uint64(255)
    size = len(gram)
    levels = []  # from the empty context: context, count of the byte, count, distinct, exclusion below
    for length in range(order + 1):
        context = gram >> np.uint64(8 * (order - length + 1))
        if length <= SHARED:
            levels.append((short.counts(length, context, byte), *short.totals(length, context)))
            continue
        node, back = np.unique((context << np.uint64(8)) | byte, return_inverse=True)
        own = np.bincount(back, count, len(node)).astype(np.int64)
        below = np.zeros(len(node), dtype=np.int64)
        below[back] = levels[length - 1][0]  # the same byte's count in the context one byte shorter
        parent = node >> np.uint64(8)
        new = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        group = np.cumsum(np.concatenate([[0], (parent[1:] != parent[:-1]).astype(np.int64)]))
        total = np.add.reduceat(own, new)[group]
        distinct = np.add.reduceat((own > 0).astype(np.int64), new)[group]
        lower = np.add.reduceat(np.where(own > 0, below, 0), new)[group]
        levels.append((own[back], total[back], distinct[back], lower[back]))
    cost, open_ = np.zeros(size), np.ones(size, dtype=bool)
    gone_distinct, gone_count = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for own, total, distinct, lower in levels[::-1]:
        known = open_ & (total > 0)
        left, kinds = total - gone_count, distinct - gone_distinct
        hit = known & (own > 0)
        cost[hit] += np.log10((own[hit] - 0.5) / left[hit])
        miss = known & (own == 0)
        escape = miss & (kinds > 0)
        cost[escape] += np.log10(0.5 * kinds[escape] / left[escape])
        open_ = open_ & ~hit
        gone_distinct, gone_count = np.where(miss, distinct, gone_distinct), np.where(miss, lower, gone_count)
    cost[open_] -= np.log10(256 - gone_distinct[open_])
    return cost


def _answer(short: Short, order: int):
    """For the pieces of a bucket: grams with their costs, words with their counts, and the bucket's tokens and different words."""

    def run(key, rows):
        bucket, out = key[0].as_py(), []
        kind, block, data = rows["kind"].to_numpy(), rows["block"].to_pylist(), rows["data"]
        mine = np.flatnonzero(kind == GRAMS).tolist()
        if mine:
            asked = [unsqueeze(data[n].as_py(), (np.uint64, np.int64)) for n in mine]
            gram, count = _merge(asked)
            cost = costs(gram, count, short, order)
            out += [(block[n], bucket, GRAMS, squeeze(own, cost[np.searchsorted(gram, own)])) for n, (own, _) in zip(mine, asked)]
        mine = np.flatnonzero(kind == WORDS).tolist()
        if mine:
            asked = [unsqueeze_words(data[n].as_py()) for n in mine]
            tally = _add_up([pa.table({"word": w, "n": c}) for w, c in asked])
            word, count = tally["word"].combine_chunks(), tally["n"].to_numpy()
            out += [(block[n], bucket, WORDS, squeeze_words(w, count[pc.index_in(w, value_set=word).to_numpy(zero_copy_only=False)])) for n, (w, _) in zip(mine, asked)]
            out.append((int(count.sum()), int((count > 0).sum()), CLOSE, b""))
        return _rows(out)

    return run


def _score(order: int, ends: int, total: int, kinds: int):
    """Scores of the documents of a block from the costs of its grams and the counts of its words."""
    base = np.log10(total + 0.5 * (kinds + 1))

    def run(docs, answers):
        unpack = zstandard.ZstdDecompressor().decompress
        kind, data = answers["kind"].to_numpy(), answers["data"]
        found = [unsqueeze(data[n].as_py(), (np.uint64, np.float64)) for n in np.flatnonzero(kind == GRAMS).tolist()]
        gram, cost = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.uint64), np.zeros(0))
        turn = np.argsort(gram)
        gram, cost = gram[turn], cost[turn]
        found = [unsqueeze_words(data[n].as_py()) for n in np.flatnonzero(kind == WORDS).tolist()]
        words = pa.concat_arrays([w for w, _ in found]) if found else pa.array([], pa.large_binary())
        count = np.concatenate([c for _, c in found]) if found else np.zeros(0, dtype=np.int64)
        out = []
        for part, texts in _slices(docs, unpack):
            text, offsets, parts, before = stream(*byte_view(texts))
            rows = part.num_rows
            keys = (grams(text, offsets, order) << np.uint64(16)) | np.repeat(np.arange(rows, dtype=np.uint64), np.diff(offsets))
            keys.sort()
            mine = keys >> np.uint64(16)
            new = np.concatenate([[True], mine[1:] != mine[:-1]])
            each = cost[np.searchsorted(gram, mine[new])][np.cumsum(new) - 1]
            score = np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), each, rows)
            coded = parts.dictionary_encode()
            seen = count[pc.index_in(coded.dictionary, value_set=words).to_numpy(zero_copy_only=False)] if len(coded.dictionary) else np.zeros(0, dtype=np.int64)
            seen = seen[coded.indices.to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(rows), np.diff(before))
            unigram = np.bincount(row, np.log10(seen + 0.5) - base, rows) + np.log10(ends + 0.5) - base
            tokens = np.diff(before) + 1
            familiar = np.bincount(row, seen > 0, rows).astype(np.int64) + (ends > 0)
            out.append(pa.table({
                "id": part.column("id"), "held_out": part.column("held"), "n_tokens": tokens.astype(np.int64), "n_known": familiar,
                "train_tokens": np.full(rows, total, dtype=np.int64), "base_score": unigram, "score": score,
            }))
        return pa.concat_tables(out) if out else empty

    kind = {"held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    empty = pa.table({"id": pa.array([], pa.int64()), **{k: pa.array([], v) for k, v in kind.items()}})
    return run


def score(docs: DataFrame, held_out: Column, id: str = "doc_id", order: int = ORDER, block_bytes: int = BLOCK_BYTES, blocks: int = BLOCKS) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score); documents where *held_out* (on ``id``) holds teach nothing."""
    if not SHARED < order <= 5:
        raise ValueError("the order must be 3, 4 or 5")
    narrow = docs.select(docs[id].cast("long").alias("id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(blocks, -(-size // block_bytes))
    narrow = narrow.withColumn("held", F.coalesce(held_out, F.lit(False))).withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(count)))
    packed = narrow.mapInArrow(_pack, "id long, held boolean, block long, packed binary")
    buckets = max(BUCKETS, count // 16)
    asked = saved(packed.groupBy("block").applyInArrow(_count(order, buckets), ASKED))
    close = asked.filter(F.col("kind") == CLOSE).select("data").mapInArrow(_close, "key long, n long")
    close = close.groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()  # 2^24 rows at most
    short = Short(close["key"].to_numpy().astype(np.uint64), close["n"].to_numpy())
    answers = saved(asked.filter(F.col("kind") != CLOSE).groupBy("bucket").applyInArrow(_answer(short, order), ASKED))
    total, kinds = answers.filter(F.col("kind") == CLOSE).agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("bucket"), F.lit(0))).first()
    ends = narrow.filter(~F.col("held")).count()
    answers = answers.filter(F.col("kind") != CLOSE)
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, ends, total + ends, kinds + (ends > 0)), schema)


def _pack(batches):
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([pack(x) for x in texts], pa.binary())], ["id", "held", "block", "packed"])


def op3_ppm_scores(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 1
    return score(table(spark, folder, "documents"), held_out).withColumnRenamed("id", "doc_id")


QUERIES = {"op3_ppm_scores": (op3_ppm_scores, None)}
