"""Near-duplicates by SimHash groups and the exact Jaccard similarity of their sets of shingles.

Documents with the same set of shingles are one node. Candidates are the groups of SimHash fingerprints that op9's Golay keys
link (:func:`.simhash.print_groups`): a group is a key of its nodes. Four bits miss most edited texts, so min-hashes propose
the rest: 20 more keys of five minima each, so that a pair of similarity s shares one with probability 1 - (1 - s^5)^20:
0.9996 right at 0.8, more above. Nodes are only ever joined by a similarity counted exactly on whole sets of shingles, in two steps. First each node meets the first
node of each of its keys, which is linear in the nodes and joins what is dense; a hub's members are spread over tasks. Then
the keys whose nodes are still apart compare those pairs that nothing joins yet; keys with the same nodes do so once. Keys of many
shingles are cut into blocks, and pairs of blocks are spread over tasks. Candidates that do not verify join nothing, so
templated texts, of which many share some key, form no common group.

A NULL or blank text has no shingles; all such rows are one node, which nothing else joins. A text of fewer words than
a shingle has is one shingle. Rows with a NULL id get a component, but give no component its id. Repeated rows stay.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import by_bytes, hand_back, saved
from .simhash import print_groups, prints_of, shingle_hashes

LEAST = 0.8
BANDS, DEPTH = 20, 5
BLOCK = 1 << 19  # shingles in a block of a large key
SPOKES = 1 << 12  # nodes that one task compares with the first node of their key
_DRAW = np.random.default_rng(42)
FACTORS = _DRAW.integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _DRAW.integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64)


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each text, ascending, and the bounds of the texts."""
    return different(*shingle_hashes(column, words))


def different(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each text, ascending, and the new bounds."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, row))
    hashes = hashes[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(bounds)))


def band_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of keys for each set that is not empty."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    keys = np.zeros((len(starts), BANDS), dtype=np.uint64)
    if not len(starts):
        return keys
    for k, (factor, shift) in enumerate(zip(FACTORS, SHIFTS)):
        least = np.minimum.reduceat((hashes ^ shift) * factor, starts)
        mixed = (keys[:, k // DEPTH] ^ least) * np.uint64(0x9E3779B97F4A7C15)
        keys[:, k // DEPTH] = mixed ^ (mixed >> np.uint64(32))
    return keys ^ (np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def similar_links(nodes: np.ndarray, sets: list[np.ndarray], least: float, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the nodes whose sets have a Jaccard similarity of *least* or more, as few as do; equal *labels* are joined already."""
    if len(nodes) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    _, shingle, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    first = np.cumsum(often) - often
    holders = owner[np.argsort(shingle, kind="stable")]  # the sets that hold each shingle
    ends = np.cumsum(sizes)
    top, links = np.arange(len(sets)) if labels is None else np.unique(labels, return_inverse=True)[1], []
    for i in range(len(sets)):
        if (top == top[i]).all():
            break
        mine = shingle[ends[i] - sizes[i] : ends[i]]
        mine = mine[often[mine] > 1]
        if not len(mine):
            continue
        count = often[mine]
        place = np.repeat(first[mine] - np.cumsum(count) + count, count) + np.arange(count.sum())
        shared = np.bincount(holders[place], minlength=len(sets))
        for k in np.flatnonzero((top != top[i]) & (shared / (sizes + sizes[i] - shared) >= least)):
            if top[k] != top[i]:
                links.append((int(nodes[i]), int(nodes[k])))
                top[top == top[k]] = top[i]
    return links


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _spokes(least: float):
    """Links of the first rows of each (hub, salt) with those that follow it, from a sorted partition of (hub, salt, turn, node, shingles)."""

    def run(batches):
        hub = None
        for batch in batches:
            links = []
            for head, turn, node, shingles in zip(*(batch.column(n).to_pylist() for n in (0, 2, 3)), batch.column(4)):
                mine = np.frombuffer(shingles.as_py(), dtype=np.uint64)
                if turn == 0:
                    hub = mine
                    continue
                at = np.minimum(np.searchsorted(hub, mine), len(hub) - 1)
                shared = int((hub[at] == mine).sum())
                if shared / (len(hub) + len(mine) - shared) >= least:
                    links.append((head, node))
            yield _links(links)

    return run


def _verified(least: float):
    """Links within the runs of equal keys of a sorted partition of (key, node, label, shingles)."""

    def run(batches):
        held, nodes, labels, sets = None, [], [], []
        for batch in batches:
            links = []
            for key, node, label, shingles in zip(*(batch.column(n).to_pylist() for n in range(3)), batch.column(3)):
                if key != held:
                    links += similar_links(np.array(nodes), sets, least, np.array(labels))
                    held, nodes, labels, sets = key, [], [], []
                nodes.append(node)
                labels.append(label)
                sets.append(np.frombuffer(shingles.as_py(), dtype=np.uint64))
            yield _links(links)
        yield _links(similar_links(np.array(nodes), sets, least, np.array(labels)))

    return run


def _similar_to_hubs(members: DataFrame, sets: DataFrame, least: float, spokes: int) -> DataFrame:
    """Links (a, b) of the first nodes of keys with their keys' other nodes."""
    pairs = saved(members.filter("node <> head").select("head", "node").distinct())
    hubs = pairs.groupBy("head").agg(F.ceil(F.count("*") / spokes).alias("salts"))
    dealt = pairs.join(hubs, "head").select("head", F.expr("pmod(xxhash64(node), salts)").alias("salt"), F.lit(1).alias("turn"), "node")
    first = hubs.select("head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("turn"), F.col("head").alias("node"))
    rows = first.union(dealt).join(sets, "node").select("head", "salt", "turn", "node", "shingles")
    return rows.repartition("head", "salt").sortWithinPartitions("head", "salt", "turn").mapInArrow(_spokes(least), "a long, b long")


def _similar_in_keys(members: DataFrame, joined: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """Links (a, b) of nodes that share a key and that *joined* (node, component) leaves apart."""
    joined = joined.select(F.col("node").alias("joined_node"), "component")
    labelled = members.filter("n > 2").join(joined, F.col("node") == F.col("joined_node"), "left")  # two nodes have met
    labelled = saved(labelled.select("key", "node", "size", F.coalesce("component", "node").alias("label")))
    same = [F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark_{k}") for k in range(2))]
    apart = labelled.groupBy("key").agg(*same, F.min("label").alias("low"), F.max("label").alias("high"), F.sum("size").alias("total")).filter("low <> high")
    once = apart.groupBy("n", "mark_0", "mark_1").agg(F.min("key").alias("key"), F.ceil(F.max("total") / block).cast("int").alias("blocks"))
    dealt = labelled.join(once.select("key", "blocks"), "key").withColumn("block", F.expr("pmod(xxhash64(node), blocks)").cast("int"))
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: other != F.col("block")),
        lambda other: F.xxhash64("key", F.least("block", other), F.greatest("block", other)),
    )
    runs = F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(F.array("key"))).alias("run")
    rows = dealt.select(runs, "node", "label").join(sets, "node").select("run", "node", "label", "shingles")
    return rows.repartition("run").sortWithinPartitions("run", "node").mapInArrow(_verified(least), "a long, b long")


def similar_groups(docs: DataFrame, id: str = "doc_id", words: int = 5, least: float = LEAST, carry: tuple[str, ...] = (), block: int = BLOCK, spokes: int = SPOKES) -> DataFrame:
    """Rows (id, component, root, *carry*): the smallest id and the node that links of similarity *least* or more reach."""
    carried = [f"carry_{c}" for c in carry]
    text = docs["text"].cast("string")
    narrow = docs.select(docs[id].alias("id"), text.alias("text"), F.xxhash64(text).alias("pick"), *(docs[c].alias(f"carry_{c}") for c in carry))

    def describe(batches):
        for batch in batches:
            hand_back()
            for part in by_bytes(batch, 1, 1 << 19):
                found, ends = shingle_hashes(part.column(1), words)
                prints = prints_of(found, ends).view(np.int64)
                hashes, bounds = different(found, ends)
                digests = [xxhash.xxh64_intdigest(hashes[s:e].tobytes()) for s, e in zip(bounds[:-1], bounds[1:])]
                keys = band_keys(hashes, bounds).view(np.int64)
                at = np.append(0, np.cumsum(np.where(np.diff(bounds) > 0, BANDS, 0))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.array(digests, dtype=np.uint64).view(np.int64)), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel())), pa.array(prints), *part.columns[3:]],
                    ["id", "pick", "node", "size", "keys", "print", *carried],
                )

    zero = F.lit(0).cast("long")
    described = narrow.select("id", "pick", zero.alias("node"), zero.alias("size"), F.array(zero).alias("keys"), zero.alias("print"), *carried)
    described = saved(narrow.mapInArrow(describe, described.schema))
    nodes = saved(described.groupBy("node").agg(F.min("id").alias("first"), F.min("pick").alias("pick"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    printed = saved(described.filter("size > 0").select("print", "node", "size").distinct())  # texts of one set may repeat shingles unlike
    groups = print_groups(saved(printed.select("print").distinct()))
    grouped = printed.join(groups, "print").select(F.xxhash64("root", F.lit("print")).alias("key"), "node", "size").distinct()
    keyed = grouped.union(nodes.select(F.explode("keys").alias("key"), "node", "size"))
    keys = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).filter("n > 1")
    members = saved(keyed.join(keys, "key"))

    def shingled(batches):
        for batch in batches:
            hand_back()
            for part in by_bytes(batch, 1, 1 << 19):
                hashes, bounds = shingle_sets(part.column(1), words)
                sets = pa.array([hashes[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["node", "shingles"])

    wanted = nodes.join(members.select("node").distinct(), "node").select("pick", "node")
    fetched = narrow.select("pick", "text").join(wanted, "pick").dropDuplicates(["node"]).select("node", "text")
    sets = saved(fetched.mapInArrow(shingled, "node long, shingles binary"))
    joined = components(_similar_to_hubs(members, sets, least, spokes))
    more = _similar_in_keys(members, joined, sets, least, block)
    found = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    rooted = nodes.join(found, nodes["node"] == found["node"], "left").select(nodes["node"], "first", F.coalesce("component", nodes["node"]).alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component")), "root").select("node", "component", "root")
    return described.join(named, "node").select("id", "component", "root", *(F.col(f"carry_{c}").alias(c) for c in carry))
