"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a share of all words by weight, at most *limit* times its own words. A document is taken ``floor(r)``
times, ``r`` being its source's target over its size, and once more with probability ``frac(r)``. Which documents get
the extra copy is drawn by the cube method: the vector of probabilities moves along directions that leave the source's
expected words and expected number of documents as they are, until each is 0 or 1; the last one or two per source (the
landing) are rounded to the nearest total of words.

The flight runs in blocks of a few thousand documents. What a block leaves undecided (two documents at most) meets what
other blocks left in the next round, until each source has one block. So no task holds a source, however large, and
the number of rounds grows with the logarithm of its documents.

A NULL text has size 0, a NULL source is a source of its own and the last. Rows that repeat are documents of their own;
ties in the order do not matter, as the seed depends on source and block alone. An empty table gives an empty result.
Columns other than id, text and source are ignored, so that they may have any name.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import by_bytes, byte_view, saved, table, word_spans

WEIGHTS = (5, 2, 1)
LIMIT = 3
BLOCK = 2000


def _sizes(batches):
    for batch in batches:
        for part in by_bytes(batch, 2):
            words = np.diff(word_spans(*byte_view(part.column(2)))[2])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.int64())], ["id", "source", "size"])


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """One row per source of (source, size): its words, its documents and its target.

    Resharing what exceeds a limit until nothing does ends where each target is ``min(limit * words, level * weight)``
    with one level for all. Ordered by ``limit * words / weight``, the sources at their limit come first, so running
    sums give the level. The table has a row per source, not per document.
    """
    of_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("cap_level", "place")
    everything = Window.partitionBy()
    rest = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "weight"
    ).over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        of_source.withColumn("place", F.row_number().over(ordered))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(limit)))
        .withColumn("cap_level", F.col("cap") / F.col("weight"))
        .withColumn("level", rest)
        .withColumn("level", F.max(F.when(F.col("cap_level") >= F.col("level"), F.col("level"))).over(everything))
        .select("source", "source_size", "documents", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def flight(chances: list[float], sizes: list[int], seed: str) -> list[float]:
    """Moves *chances* to 0 or 1, all but two at most, keeping their sum and their sum weighted by *sizes*."""
    draw, left, active = random.Random(seed), list(chances), []
    for unit in range(len(left)):
        if 0.0 < left[unit] < 1.0:
            active.append(unit)
        while len(active) == 3:
            a, b, c = active
            move = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(move):
                move = (1, -1, 0)
            up = down = math.inf
            for step, k in zip(move, active):
                if step:
                    high, low = (1.0 - left[k]) / abs(step), left[k] / abs(step)
                    up, down = min(up, high if step > 0 else low), min(down, low if step > 0 else high)
            go = up if draw.random() * (up + down) < down else -down
            for step, k in zip(move, active):
                now = left[k] + go * step
                left[k] = 0.0 if now < 1e-9 else 1.0 if now > 1 - 1e-9 else now
            active = [k for k in active if 0.0 < left[k] < 1.0]
    return left


def landing(chances: list[float], sizes: list[int]) -> list[float]:
    """The last one or two undecided units, rounded to the nearest total of sizes, then of units."""
    open_units = [k for k, p in enumerate(chances) if 0.0 < p < 1.0]
    best, choice = None, chances
    for bits in range(1 << len(open_units)):
        taken = list(chances)
        for n, k in enumerate(open_units):
            taken[k] = float(bits >> n & 1)
        off = abs(sum((taken[k] - chances[k]) * sizes[k] for k in open_units)), abs(sum(taken[k] - chances[k] for k in open_units)), bits
        if best is None or off < best:
            best, choice = off, taken
    return choice


def _fly(key, rows):
    rows = rows.sort_values(["id", "row"], kind="stable", na_position="last", ignore_index=True)
    order = list(range(len(rows)))
    seed = f"{rows['source'].iloc[0]}/{key[1]}/{len(rows)}"
    random.Random(seed).shuffle(order)
    rows = rows.iloc[order].reset_index(drop=True)
    sizes = rows["size"].tolist()
    left = flight(rows["chance"].tolist(), sizes, seed)
    if rows["blocks"].iloc[0] == 1:
        left = landing(left, sizes)
    rows["chance"] = left
    return rows


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT, block: int = BLOCK, id: str | Column = "doc_id") -> DataFrame:
    """Rows (id, source, size, source_size, target, copies), one per row of *docs* (*id*, text, source)."""
    narrow = docs.select(docs[id].alias("id") if isinstance(id, str) else id.alias("id"), docs["source"].alias("source"), docs["text"].alias("text"))
    sized = saved(narrow.mapInArrow(_sizes, narrow.select("id", "source", F.lit(0).cast("long").alias("size")).schema))
    plan = targets(sized, weights, limit).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = saved(plan)
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select(
        sized["id"].cast("string").alias("id"), sized["source"], "size", "source_size", "target", F.floor("ratio").cast("int").alias("whole"),
        (F.col("ratio") - F.floor("ratio")).alias("chance"), F.greatest(F.ceil(F.col("documents") / block), F.lit(1)).cast("long").alias("blocks"),
    )
    rows = rows.withColumn("row", F.xxhash64("id", "size"))
    done, blocks = [], plan.agg(F.ceil(F.max("documents") / block)).first()[0] or 1
    while True:
        place = rows.withColumn("block", F.pmod(F.xxhash64("row", F.lit(7)), "blocks"))
        rows = saved(place.groupBy(F.xxhash64("source"), "block").applyInPandas(_fly, place.schema)).drop("block")
        undecided = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(rows.filter(~undecided))
        if blocks == 1:
            break
        # A block leaves two documents at most.
        left = F.ceil(2 * F.col("blocks") / block)
        rows, blocks = rows.filter(undecided).withColumn("blocks", F.when(F.col("blocks") == 1, 1).otherwise(left)), math.ceil(2 * blocks / block)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.select(F.col("id").cast(sized.schema["id"].dataType), "source", "size", "source_size", "target", (F.col("whole") + F.col("chance").cast("int")).alias("copies"))


def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mix(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken)


QUERIES = {"op8_mix_sources": (op8_mix_sources, None)}
