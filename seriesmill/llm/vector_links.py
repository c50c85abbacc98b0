"""Embedding near-duplicates by collision counting over one-dimensional projections.

A pair with cosine ``t`` or more is at most ``sqrt(2 - 2t)`` apart after scaling to length 1, so on a random line its
projections differ by a normal variable of at most that spread. Each of PROJECTIONS lines is sorted; a query's window
covers WINDOW spreads to either side of its own projection, and a pair's count is the number of lines where one lies
in the window of the other. Pairs whose count reaches a threshold, set by the binomial distribution so that a pair
right at ``t`` passes with the wanted probability, are verified by the exact cosine in double precision.

Sorting all vectors on one line and counting there would meet a fixed share of all pairs. So the lines are sorted
within buckets: in each of several rounds vectors are dealt by the signs of further projections, with one sign more
whenever the table doubles, so that a bucket holds about BUCKET vectors at any size of the table. The number of rounds
follows from the probability that a pair right at ``t`` meets in none. A pair that meets in several rounds is counted
in the first: signs are sums of whole numbers, exact in any order, so a task works out the earlier rounds' signs of
the pairs it verified, and only the vector itself, as precise as it is stored, travels with a round. Vectors meet as one
row per different vector, which carries its number of copies; a bucket of more than
SPLIT vectors is cut into blocks and its pairs of blocks are spread over tasks. A bucket gives each vector's number of
links and links that span its groups, never all pairs.

Vectors that are NULL, empty, all zero or hold NULL or non-finite components link with nothing. Vectors of different
length never link. Repeated rows are vectors of their own. Rows with a NULL id take no part and come back with 0 links, no component
and ``kept`` false. An empty table gives an empty result. Columns other than id and vector are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import saved, table
from .vectors import by_length, matrix, narrowed, unit, usable

THRESHOLD = 0.95
PROJECTIONS = 32
WINDOW = 1.5
RECALL = 0.999
BUCKET = 128
SPLIT = 512
SEED = 20


def signs_and_rounds(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Signs in a round, so that a bucket holds about *bucket* vectors, and rounds, so that a pair at *threshold* meets with probability *recall*."""
    signs = min(max(0, math.ceil(math.log2(max(vectors, 1) / bucket))), 40)
    meet = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def count_needed(projections: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability *recall*."""
    hit = math.erf(window / math.sqrt(2))
    tail = 0.0
    for count in range(projections, -1, -1):
        tail += math.comb(projections, count) * hit**count * (1 - hit) ** (projections - count)
        if tail >= recall:
            return count
    return 0


@functools.lru_cache(maxsize=512)
def planes(length: int, signs: int, turn: int) -> np.ndarray:
    return np.rint(np.random.default_rng([SEED, length, turn]).standard_normal((length, signs)) * (1 << 10))


def codes_of(vectors: np.ndarray, signs: int, rounds: range) -> np.ndarray:
    """The bucket of each vector in each of *rounds*. Whole factors whose sums stay below 2^53 give a vector the same signs in any batch."""
    length = vectors.shape[1]
    whole = np.rint(vectors / np.abs(vectors).max(axis=1, keepdims=True) * (1 << 20))
    out = np.zeros((len(vectors), len(rounds)), dtype=np.int64)
    for n, turn in enumerate(rounds):
        out[:, n] = (whole @ planes(length, signs, turn) > 0) @ (1 << np.arange(signs, dtype=np.int64)) * 4096 + length % 4096
    return out


def collisions(lines: np.ndarray, others: np.ndarray, reach: float) -> np.ndarray:
    """For each row of *lines* and of *others* (vectors by projections), on how many lines the second is in the first's window."""
    counts = np.zeros((len(lines), len(others)), dtype=np.int8)
    for line, other in zip(lines.T, others.T):
        order = np.argsort(other)
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        low = np.searchsorted(other[order], line - reach, side="left").astype(np.int32)
        high = np.searchsorted(other[order], line + reach, side="right").astype(np.int32)
        counts += (rank >= low[:, None]) & (rank < high[:, None])
    return counts


def _spanning(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) are needed to join what they join."""
    top, needed = list(range(size)), []

    def find(k):
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for n, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            top[max(x, y)] = min(x, y)
            needed.append(n)
    return np.array(needed, dtype=np.int64)


def link(df: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL,
         bucket: int = BUCKET, split: int = SPLIT) -> DataFrame:
    """Rows (id, n_links, component), one per row of *df*."""
    rows = narrowed(df, id, vector)
    good = usable("vector") & F.col("id").isNotNull()
    stored = df.schema[vector].dataType  # array<float> is exact in half the room of doubles
    distinct = saved(rows.filter(good).groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    signs, rounds = signs_and_rounds(distinct.count(), threshold, recall, bucket)
    reach, needed = WINDOW * math.sqrt(2 - 2 * threshold), count_needed(recall=recall)

    def deal(batches):
        for batch in batches:
            vectors = batch.column(0)
            codes = np.zeros((batch.num_rows, rounds), dtype=np.int64)
            for length, mine in by_length(vectors.value_lengths().to_numpy()):
                codes[mine] = codes_of(matrix(vectors.take(pa.array(mine))), signs, range(rounds))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * rounds)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), vectors], ["first", "copies", "codes", "vector"])

    coded = saved(distinct.mapInArrow(deal, "first long, copies long, codes array<long>, vector array<double>").withColumn("vector", F.col("vector").cast(stored)))
    dealt = coded.select("first", "copies", "vector", F.posexplode("codes").alias("round", "code"))
    large = dealt.groupBy("round", "code").count().filter(F.col("count") > split).withColumn("blocks", F.ceil(F.col("count") / (split // 2)))
    dealt = dealt.join(large.drop("count"), ["round", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("first"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("round", "code", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "first", "copies", "vector")

    def count(key, rows):
        turn, _, low, high = (k.as_py() for k in key)
        lengths = rows["vector"].combine_chunks().value_lengths().to_numpy()
        first, copies, block = (rows[name].to_numpy() for name in ("first", "copies", "block"))
        nodes, ends_a, ends_b, partners = [], [], [], []
        for length, mine in by_length(lengths):
            raw = matrix(rows["vector"].combine_chunks().take(pa.array(mine))).astype(np.float64)
            vectors = unit(raw)
            lines = vectors @ np.random.default_rng([SEED + 1, length]).standard_normal((length, PROJECTIONS))
            left, right = np.flatnonzero(block[mine] == low), np.flatnonzero(block[mine] == high)
            a, b = np.nonzero(collisions(lines[left], lines[right], reach) >= needed)
            a, b = left[a], right[b]
            keep = (a < b) if low == high else np.ones(len(a), dtype=bool)
            a, b = a[keep], b[keep]
            keep = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= threshold
            a, b = a[keep], b[keep]
            ends = np.unique(np.concatenate([a, b]))
            codes = codes_of(raw[ends], signs, range(turn if len(ends) else 0))
            seen = np.zeros(len(a), dtype=bool)  # met in an earlier round
            for code in codes.T:
                seen |= code[np.searchsorted(ends, a)] == code[np.searchsorted(ends, b)]
            a, b = a[~seen], b[~seen]
            counted = np.bincount(a, copies[mine][b], len(mine)) + np.bincount(b, copies[mine][a], len(mine))
            linked = np.flatnonzero(counted)
            span = _spanning(len(mine), a, b)
            ids = first[mine]
            nodes += [ids[linked]]
            partners += [counted[linked].astype(np.int64)]
            ends_a, ends_b = [*ends_a, ids[a[span]]], [*ends_b, ids[b[span]]]
        nodes, partners, ends_a, ends_b = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (nodes, partners, ends_a, ends_b))
        none = [pa.nulls(len(ends_a), pa.int64()), pa.nulls(len(nodes), pa.int64())]
        return pa.table({
            "node": pa.concat_arrays([pa.array(nodes), none[0]]), "links": pa.concat_arrays([pa.array(partners), none[0]]),
            "a": pa.concat_arrays([none[1], pa.array(ends_a)]), "b": pa.concat_arrays([none[1], pa.array(ends_b)]),
        })

    found = saved(dealt.groupBy("round", "code", "low", "high").applyInArrow(count, "node long, links long, a long, b long"))
    links = found.filter("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter("a IS NOT NULL").select("a", "b"))
    known = distinct.join(links, distinct["first"] == links["node"], "left").drop("node")
    known = known.join(joined, known["first"] == joined["node"], "left").select(
        F.col("vector").alias("same"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component")
    )
    taking = rows.filter(good)
    taking = taking.join(known, (F.xxhash64("vector") == F.xxhash64("same")) & (taking["vector"] == known["same"]))
    rest = rows.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return taking.select("id", "n_links", "component").union(rest)


def op1_vector_links(spark: SparkSession, folder: str) -> DataFrame:
    found = link(table(spark, folder, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept")
    )


QUERIES = {"op1_vector_links": (op1_vector_links, None)}
