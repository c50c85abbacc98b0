"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Two things make a document unwanted: low quality and toxicity. For each, labelled documents give the evidence of a
text. All words of the labelled documents are counted by class under hashed keys: their first 5 to 8 bytes, their last
3 and whether they are in capitals. Keys whose share of documents differs between the classes beyond chance get the log ratio of
their rates, shrunk to the common rate by a Dirichlet prior; a text's sum over its words is its log likelihood
ratio under Poisson rates. A logistic fit turns these sums, the share of different words and the length into calibrated
log odds. The fit uses about LABELLED labels, chosen by a hash of the id (all, if there are fewer), so that they can be
broadcast to the texts: half of them give the counts, the other half the logistic fit. Everything else covers all documents.

Then grouped aggregates give each host's posterior rate, shrunk to the global rate, and each path's, shrunk to its
host's. The strength of each prior comes from the spread between hosts, or between the paths of a host, beyond what
their sizes explain, so sparse sites stay near the prior above them. A document's final log odds are its own evidence
with the global rate as prior replaced by its path's. Documents with odds above even on either count are rejected.

A NULL text counts as empty, a NULL host or path is one of its own. Labels that are NULL are left out, and of several for one id the worst counts; without labels of
both classes a target says nothing about texts and its odds are the labels' share. Repeated rows are documents of their own. An empty table gives an
empty result. Columns other than those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, by_bytes, byte_view, saved, table, word_spans

KEYS = 1 << 16
FIRST = (5, 6, 7, 8)
KINDS = len(FIRST) + 2
LABELLED = 40_000
SIGNIFICANT = 3.0
PRIOR = 200.0
TARGETS = ("low", "toxic")
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each kind of key, the hashed key of each word."""
    low, sizes = LOWER[data], ends - starts
    low = np.concatenate([low, np.zeros(8, dtype=np.uint8)])
    found, value = [], np.zeros(len(starts), dtype=np.uint64)

    def hashed(value, salt):
        return ((value * MIX + np.uint64(salt * 0xD1B54A32D192ED03 % (1 << 64))) >> np.uint64(48)).astype(np.int32)

    for at in range(max(FIRST)):
        value |= np.where(at < sizes, low[starts + at], 0).astype(np.uint64) << np.uint64(8 * at)
        if at + 1 in FIRST:
            found.append(hashed(value, at + 1))
    tail = np.zeros(len(starts), dtype=np.uint64)
    for at in range(3):
        tail |= np.where(at < sizes, low[np.maximum(ends - 1 - at, 0)], 0).astype(np.uint64) << np.uint64(8 * at)
    found.append(hashed(tail, 20))
    second = data[np.minimum(starts + 1, ends - 1)] if len(starts) else data[:0]
    capitals = (sizes > 1) & (data[starts] >= 65) & (data[starts] <= 90) & (second >= 65) & (second <= 90)
    return [*found, hashed(capitals.astype(np.uint64), 30)]


def _count(batches):
    """(key, class, words, documents) of a batch; class is low + 2 * toxic."""
    for batch in batches:
        sums: dict[int, np.ndarray] = {}
        for part in by_bytes(batch, 0):
            data, offsets = byte_view(part.column(0))
            starts, ends, before = word_spans(data, offsets)
            kind = part.column(1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(part.num_rows, dtype=np.int64), np.diff(before))
            for n, keys in enumerate(word_keys(data, starts, ends)):
                own, count = np.unique((row << 16) | keys, return_counts=True)
                at = (kind[own >> 16] * KINDS + n) * KEYS + (own & (KEYS - 1))
                size = 4 * KINDS * KEYS
                tally = sums.setdefault(0, np.zeros((2, size), dtype=np.int64))
                tally[0] += np.bincount(at, count, size).astype(np.int64)
                tally[1] += np.bincount(at, minlength=size)
        if sums:
            words, documents = sums[0]
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at % (KINDS * KEYS)), pa.array(at // (KINDS * KEYS)), pa.array(words[at]), pa.array(documents[at])], ["key", "kind", "words", "documents"]
            )


def weights(words: np.ndarray, documents: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios by (kind of key, key), 0 where not significant, and what each word costs, from (other, target) counts."""
    words, documents = words.reshape(2, KINDS, KEYS).astype(float), documents.reshape(2, KINDS, KEYS).astype(float)
    total = words.sum(axis=2, keepdims=True)
    common = (words[0] + words[1]) / np.maximum(total[0] + total[1], 1)
    rate = (words + PRIOR * common + 0.05) / (total + PRIOR + 0.1)
    ratio = np.log(rate[1] / rate[0])
    share = (documents[0] + documents[1] + 1) / (sizes.sum() + 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (documents[1] / sizes[1] - documents[0] / sizes[0]) / np.sqrt(share * (1 - share) * (1 / sizes[0] + 1 / sizes[1]))
    kept = (np.abs(np.nan_to_num(score)) > SIGNIFICANT) & (score * ratio > 0)
    return np.where(kept, ratio, 0.0), np.where(kept, rate[1] - rate[0], 0.0).sum(axis=1)


def features(column: pa.Array, ratios: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Rows by targets by features of the texts; *ratios* is (targets, kinds, keys)."""
    data, offsets = byte_view(column)
    starts, ends, before = word_spans(data, offsets)
    rows, counts = len(column), np.diff(before)
    row = np.repeat(np.arange(rows), counts)
    out = np.zeros((rows, len(ratios), KINDS + 3))
    for n, keys in enumerate(word_keys(data, starts, ends)):
        for target in range(len(ratios)):
            value = np.bincount(row, ratios[target, n][keys], rows) - counts * costs[target, n]
            out[:, target, n] = np.sign(value) * np.log1p(np.abs(value))
    power = np.cumprod(np.full(64, 0x100000001B3, dtype=np.uint64))  # different words, by a hash of up to 64 bytes and the length
    sizes, value = ends - starts, (ends - starts).astype(np.uint64)
    for at in range(min(64, int(sizes.max()) if len(sizes) else 0)):
        longer = np.flatnonzero(sizes > at)
        value[longer] += data[starts[longer] + at].astype(np.uint64) * power[at]
    order = np.lexsort((value, row))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (value[order[1:]] != value[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    out[:, :, KINDS] = 1.0
    out[:, :, KINDS + 1] = (np.bincount(row[order], new, rows) / np.maximum(counts, 1))[:, None]
    out[:, :, KINDS + 2] = np.log1p(np.diff(offsets))[:, None]
    return out


def fit(rows: np.ndarray, target: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton steps; the constant feature alone where there is one class only."""
    out = np.zeros(rows.shape[1])
    if len(target) == 0 or target.min() == target.max():
        out[KINDS] = np.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5)) if len(target) else -10.0
        return out
    for _ in range(40):
        chance = 1 / (1 + np.exp(-np.clip(rows @ out, -30, 30)))
        slope = rows.T @ (target - chance) - ridge * out
        out += np.linalg.solve((rows * (chance * (1 - chance))[:, None]).T @ rows + ridge * np.eye(len(out)), slope)
    return out


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", rows: int = LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ratios, costs, coefficients) by target from *docs* (id, text) and *labels* (id, quality, toxic)."""
    known = labels.select(F.col(id).alias("id"), (F.col("quality") == 0).cast("int").alias("low"), (F.col("toxic") == 1).cast("int").alias("toxic")).dropna()
    known = saved(known.groupBy("id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic")))
    part = int(1_000_000 * min(1.0, rows / max(1, known.count())))
    known = known.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < part)
    known = known.withColumn("half", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2)))
    texts = docs.select(docs[id].alias("id"), docs["text"].cast("string").alias("text"))
    joined = texts.join(F.broadcast(known), "id")  # about *rows* labels, whatever the table
    sizes = np.zeros((2, 4), dtype=np.int64)
    for half, low, toxic, count in joined.groupBy("half", "low", "toxic").count().collect():  # 8 rows at most
        sizes[half, low + 2 * toxic] = count
    counted = joined.filter("half = 0").select("text", (F.col("low") + 2 * F.col("toxic")).alias("kind"))
    counted = counted.mapInArrow(_count, "key long, kind long, words long, documents long")
    sums = counted.groupBy("key", "kind").agg(F.sum("words").alias("words"), F.sum("documents").alias("documents")).toArrow()  # 4 * KINDS * KEYS rows at most
    tally = np.zeros((2, 4, KINDS * KEYS), dtype=np.int64)
    for n, name in enumerate(("words", "documents")):
        tally[n, sums["kind"].to_numpy(), sums["key"].to_numpy()] = sums[name].to_numpy()
    ratios, costs = [], []
    for classes in ((1, 3), (2, 3)):  # classes with the target
        of = np.isin(np.arange(4), classes)
        split = [np.stack([x[~of].sum(axis=0), x[of].sum(axis=0)]) for x in (*tally, sizes[0])]
        ratio, cost = weights(*split)
        ratios.append(ratio)
        costs.append(cost)
    ratios, costs = np.stack(ratios), np.stack(costs)
    chosen = joined.filter("half = 1").select("text", "low", "toxic")

    def measure(batches):
        for batch in batches:
            for part in by_bytes(batch, 0):
                rows = features(part.column(0), ratios, costs).reshape(part.num_rows, -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([lists, part.column(1), part.column(2)], ["row", "low", "toxic"])

    sample = chosen.mapInArrow(measure, "row array<double>, low int, toxic int").toArrow()
    measured = sample["row"].combine_chunks().flatten().to_numpy().reshape(-1, 2, KINDS + 3) if sample.num_rows else np.zeros((0, 2, KINDS + 3))
    return ratios, costs, np.stack([fit(measured[:, n], sample[name].to_numpy().astype(float)) for n, name in enumerate(TARGETS)])


def _logit(p):
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean, weight: str = "n") -> float:
    """Prior strength of rates ``total / n`` around *mean*, from their spread beyond what their sizes explain."""
    rate = F.col("total") / F.col("n")
    row = groups.agg(
        F.sum(F.col("n") * (rate - mean) ** 2).alias("spread"), F.sum(F.col("n")).alias("n"), F.sum(F.col("within")).alias("within"), F.count("*").alias("groups"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("single"),
    ).first()
    if not row["n"]:
        return 1.0
    # spread = sum n (between + within / n), within being the variance of a document around its group
    between = (row["spread"] - row["within"] / row["n"] * row["groups"]) / row["n"]
    most = row["single"] / row["n"]
    return min(max(most / between - 1, 1.0), 1e6) if between > 0 else 1e6


def site_rates(scored: DataFrame, target: str) -> DataFrame:
    """(host, path, rate): the posterior rate of *target* (a chance per document) for each path."""
    chance = F.col(target)
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(chance).alias("total"), F.sum(chance * chance).alias("squares"))
    paths = saved(paths.withColumn("within", F.greatest(F.col("squares") - F.col("total") ** 2 / F.col("n"), F.lit(0.0))))
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")))
    hosts = hosts.withColumn("within", F.greatest(F.col("squares") - F.col("total") ** 2 / F.col("n"), F.lit(0.0)))
    total = hosts.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).first()
    mean = F.lit(min(max((total["total"] or 0.0) / (total["n"] or 1), 1e-6), 1 - 1e-6))
    strength = _strength(hosts, mean)
    hosts = hosts.select("host", ((F.col("total") + strength * mean) / (F.col("n") + strength)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    strength = _strength(paths, F.col("host_rate"))
    rate = (F.col("total") + strength * F.col("host_rate")) / (F.col("n") + strength)
    return paths.select("host", "path", F.greatest(F.least(rate, F.lit(1 - 1e-6)), F.lit(1e-6)).alias(f"{target}_site"), mean.alias(f"{target}_mean"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, host, path, low_evidence, toxic_evidence, low, toxic, kept, *carry*) with the final chances, one per row of *docs*."""
    model = train(docs, labels, id)

    def score(batches):
        ratios, costs, coefficients = model
        for batch in batches:
            for part in by_bytes(batch, 3):
                odds = np.einsum("rtf,tf->tr", features(part.column(3), ratios, costs), coefficients)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in range(3)), *(pa.array(x) for x in odds), *part.columns[4:]], names)

    def named(column):  # NULL is a site of its own
        return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("NULL"))

    carried = [f"carry_{c}" for c in carry]
    names = ["id", "host", "path", *(f"{t}_evidence" for t in TARGETS), *carried]
    narrow = docs.select(
        docs[id].alias("id"), named(docs[host]).alias("host"), named(docs[path]).alias("path"), docs["text"].cast("string").alias("text"), *(docs[c].alias(f"carry_{c}") for c in carry)
    )
    odds = F.lit(0.0)
    schema = narrow.select("id", "host", "path", *(odds.alias(f"{t}_evidence") for t in TARGETS), *carried).schema
    scored = saved(narrow.mapInArrow(score, schema))
    chances = scored.withColumns({t: 1 / (1 + F.exp(-F.col(f"{t}_evidence"))) for t in TARGETS})
    out = scored
    for target in TARGETS:
        out = out.join(site_rates(chances, target), ["host", "path"])
    for target in TARGETS:
        final = F.col(f"{target}_evidence") - _logit(F.col(f"{target}_mean")) + _logit(F.col(f"{target}_site"))
        out = out.withColumn(target, 1 / (1 + F.exp(-final)))
    plain = {c: F.when(F.col(c) != "NULL", F.substring(c, 2, 1 << 30)) for c in ("host", "path")}
    out = out.withColumns(plain)
    return out.select("id", "host", "path", *(f"{t}_evidence" for t in TARGETS), *TARGETS, ((F.col("low") <= 0.5) & (F.col("toxic") <= 0.5)).alias("kept"), *(F.col(f"carry_{c}").alias(c) for c in carry))


def op6_site_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.withColumnRenamed("id", "doc_id").withColumn("quality", 1 - F.col("low"))


QUERIES = {"op6_site_quality": (op6_site_quality, None)}
