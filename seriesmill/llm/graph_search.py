"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors are dealt to shards by a hash. Each shard builds a graph: points enter in batches; a greedy beam search from
the middle of the shard proposes the neighbours of each, and robust pruning keeps a diverse few: the nearest candidate
stays and removes those that are nearer to it, by the factor ALPHA, than to the point. Edges back are added and pruned
the same way, and a second pass over all points repairs what the first batches could not see. A query searches every
shard with a beam; its best of each shard are merged. The whole beam of a shard is scored again by the cosine of the
original vectors in double precision.

Graphs are built once and written. The queries are dealt to blocks of no more than about a shard's points, and a task
searches one graph with one block, so neither side of a task grows beyond a shard.

Equal vectors are one point that carries the smallest ids of its copies, as many as an answer can need, so copies
neither break the pruning nor fill a beam. Shards grow with the square root of the table (SHARD at least, LARGEST at
most), which keeps the searches of queries that are a share of the table below its square.

Vectors that are NULL, empty, all zero or hold NULL or non-finite components take no part, as queries or candidates,
nor do rows with a NULL id. Vectors of another length than the query's are no candidates. Ties go to the smaller id; repeated rows
of one id count once. An empty table gives an empty result. Columns other than id and vector are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved, table
from .vectors import by_length, matrix, narrowed, unit, usable

NEIGHBOURS = 5
DEGREE = 32
BEAM = 64
SEARCH_BEAM = 96
ALPHA = 1.2
SHARD = 4096
LARGEST = 1 << 20
BATCH = 512
EXPAND = 4
SEED = 11


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The *beam* nearest points found for each query, nearest first, and their squared distances (-1 and inf where fewer)."""
    rows = len(queries)
    seen = np.zeros((rows, len(points) + 1), dtype=bool)  # the last column stands for no point
    seen[:, -1] = True
    seen[:, start] = True
    ids = np.full((rows, beam), -1, dtype=np.int64)
    far = np.full((rows, beam), np.inf, dtype=np.float32)
    ids[:, 0], far[:, 0] = start, 2 - 2 * (queries @ points[start])
    closed = ids < 0
    line = np.arange(rows)[:, None]
    while True:
        pick = np.argsort(closed, axis=1, kind="stable")[:, :EXPAND]  # the nearest that are not expanded yet
        usable_pick = ~closed[line, pick]
        active = np.flatnonzero(usable_pick.any(axis=1))
        if not len(active):
            return ids, far
        pick, usable_pick, lane = pick[active], usable_pick[active], active[:, None]
        chosen = np.where(usable_pick, ids[lane, pick], -1)
        closed[lane, pick] = True
        near = np.where(chosen[:, :, None] >= 0, edges[chosen], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[lane, near]] = -1
        row, at = np.nonzero(near >= 0)
        new = near[row, at]
        seen[active[row], new] = True
        gap = np.full(near.shape, np.inf, dtype=np.float32)
        gap[row, at] = 2 - 2 * np.einsum("ij,ij->i", points[new], queries[active[row]])
        all_far = np.concatenate([far[active], gap], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        here = np.arange(len(active))[:, None]
        far[active] = all_far[here, order]
        ids[active] = np.concatenate([ids[active], near], axis=1)[here, order]
        closed[active] = np.concatenate([closed[active], near < 0], axis=1)[here, order]


def robust_prune(points: np.ndarray, owner: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most *degree* of each owner's *candidates* (-1: none): the nearest, without those a kept one stands for."""
    out = np.full((len(owner), degree), -1, dtype=np.int64)
    step = max(1, (1 << 22) // max(1, candidates.shape[1] ** 2))
    for begin in range(0, len(owner), step):
        own, near = owner[begin : begin + step], np.sort(candidates[begin : begin + step], axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[near == own[:, None]] = -1
        far = np.where(near >= 0, 2 - 2 * np.einsum("ijk,ik->ij", points[near], points[own]), np.inf)
        order = np.argsort(far, axis=1, kind="stable")
        line = np.arange(len(own))
        near, far = near[line[:, None], order], far[line[:, None], order]
        between = 2 - 2 * points[near] @ points[near].transpose(0, 2, 1)
        alive = near >= 0
        for slot in range(degree):
            best = alive.argmax(axis=1)
            some = alive[line, best]
            if not some.any():
                break
            out[begin : begin + step, slot] = np.where(some, near[line, best], -1)
            alive &= ~(some[:, None] & (alpha * alpha * between[line, best] <= far))
            alive[line, best] = False
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (points by degree, -1: none) and the point to start from."""
    size = len(points)
    edges = np.full((size + 1, degree), -1, dtype=np.int64)  # the last row stands for no point
    middle = points.mean(axis=0)
    start = int(np.argmax(points @ middle))
    order = np.random.default_rng(SEED).permutation(size)
    order = np.concatenate([[start], order[order != start]])
    batch_limit = max(16, min(BATCH, (1 << 28) // (size + 1)))
    first = order[: min(size, 2 * degree)]  # few enough to look at all of each other
    edges[first] = robust_prune(points, first, np.broadcast_to(first, (len(first), len(first))).copy(), degree, alpha)
    for again in (False, True):
        begin = 0 if again else len(first)
        while begin < size:
            batch = order[begin : begin + (batch_limit if again else min(batch_limit, begin))]
            begin += len(batch)
            found, _ = beam_search(points, edges, start, points[batch], beam)
            edges[batch] = robust_prune(points, batch, np.concatenate([found, edges[batch]], axis=1), degree, alpha)
            back = edges[batch].ravel()
            origin = np.repeat(batch, degree)[back >= 0]
            back = back[back >= 0]
            turn = np.argsort(back, kind="stable")
            back, origin = back[turn], origin[turn]
            target, at, count = np.unique(back, return_index=True, return_counts=True)
            added = np.full((len(target), count.max() if len(count) else 0), -1, dtype=np.int64)
            added[np.repeat(np.arange(len(target)), count), np.arange(len(back)) - np.repeat(at, count)] = origin
            merged = np.concatenate([edges[target], added], axis=1)
            widths = (merged >= 0).sum(axis=1)
            for few in (True, False):  # most targets get few edges; only the others need wide rows
                mine = np.flatnonzero((widths <= 2 * degree) == few)
                if len(mine):
                    rows = -np.sort(-merged[mine], axis=1)[:, : widths[mine].max()]
                    edges[target[mine]] = robust_prune(points, target[mine], rows, degree, alpha)
    return edges, start


def search(rows: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """Rows (query_id, rank, id, score): for each of *queries* (id, vector) its *k* nearest found among *rows* (id, vector), not its own id."""
    good = usable("vector") & F.col("id").isNotNull()
    rows, queries = rows.filter(good), queries.filter(good)
    placed = Window.partitionBy("vector").orderBy("id")
    nearest = rows.distinct().withColumn("place", F.row_number().over(placed)).filter(F.col("place") <= k + 1)
    points = saved(nearest.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))  # k + 1 ids at most
    count = points.count()
    size = min(max(shard, int(18 * math.sqrt(count))), LARGEST)
    shards = max(1, math.ceil(count / size))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)))
    graphs = saved(dealt.groupBy("shard").applyInArrow(_graphs, "shard long, place int, first boolean, ids array<long>, vector array<double>, edges array<int>"))
    queries = saved(queries.distinct())
    blocks = max(1, math.ceil(queries.count() / size))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("shard", every(shards))

    def answer(mine, asked):
        out = []
        if mine.num_rows and asked.num_rows:
            lengths = mine["vector"].combine_chunks().value_lengths().to_numpy()
            wanted = asked["vector"].combine_chunks().value_lengths().to_numpy()
            for length, held in by_length(lengths):
                who = np.flatnonzero(wanted == length)
                if len(who):
                    part = mine.take(pa.array(held)).sort_by("place")
                    out += _answer(part, asked["id"].to_numpy()[who], matrix(asked["vector"].take(pa.array(who))), k, beam)
        columns = [np.concatenate([x[n] for x in out]) if out else np.zeros(0, dtype=t) for n, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("query_id", "id", "score"), columns)))

    met = graphs.withColumn("block", every(blocks)).groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    found = met.applyInArrow(answer, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _graphs(key, mine):
    """The points of a shard with their edges, one graph for each length of vectors."""
    out = []
    for _, held in by_length(mine["vector"].combine_chunks().value_lengths().to_numpy()):
        part = mine.take(pa.array(held))
        points = unit(matrix(part["vector"])).astype(np.float32)
        edges, start = build(points) if len(points) > 2 else (np.full((len(points) + 1, 1), -1), 0)
        if len(points) == 2:
            edges[:2, 0] = 1, 0
        edges = edges[:-1].astype(np.int32)
        bounds = pa.array(np.arange(len(edges) + 1, dtype=np.int32) * edges.shape[1])
        out.append(pa.table({
            "shard": pa.array(np.full(len(points), key[0].as_py())), "place": pa.array(np.arange(len(points), dtype=np.int32)), "first": pa.array(np.arange(len(points)) == start),
            "ids": part["ids"], "vector": part["vector"], "edges": pa.ListArray.from_arrays(bounds, pa.array(edges.ravel())),
        }))
    return pa.concat_tables(out)


def _answer(mine, query_ids, queries, k, beam):
    vectors = matrix(mine["vector"])
    points = unit(vectors).astype(np.float32)
    ids = mine["ids"].to_pylist()
    edges = matrix(mine["edges"]).astype(np.int64)
    edges = np.concatenate([edges, np.full((1, edges.shape[1]), -1)])  # what id -1 leads to
    start = int(np.argmax(mine["first"].to_numpy()))
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    step = max(16, min(BATCH, (1 << 28) // len(points)))
    out = []
    for begin in range(0, len(query_ids), step):
        own, asked = query_ids[begin : begin + step], queries[begin : begin + step]
        near, _ = beam_search(points, edges, start, unit(asked).astype(np.float32), beam)
        exact = np.einsum("ijk,ik->ij", vectors[near], asked) / norms[near] / np.sqrt(np.einsum("ij,ij->i", asked, asked))[:, None]
        exact[near < 0] = -np.inf
        for row, who in enumerate(own.tolist()):
            best: list[tuple[float, int]] = []
            for at in np.argsort(-exact[row], kind="stable"):
                score = float(exact[row, at])
                if near[row, at] < 0 or (len(best) >= k and score < sorted(best)[k - 1][0] * -1):
                    break
                best += [(-score, i) for i in ids[near[row, at]] if i != who]
            best = sorted(best)[:k]
            out.append((np.full(len(best), who), np.array([i for _, i in best], dtype=np.int64), np.array([-s for s, _ in best])))
    return out


def nearest(df: DataFrame, asked: Column, id: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, shard: int = SHARD) -> DataFrame:
    """The *k* nearest rows of each row where *asked* (a condition on ``id``) holds."""
    rows = narrowed(df, id, vector)
    return search(rows, rows.filter(asked), k, shard)


def op7_graph_search(spark: SparkSession, folder: str) -> DataFrame:
    found = nearest(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


QUERIES = {"op7_graph_search": (op7_graph_search, None)}
