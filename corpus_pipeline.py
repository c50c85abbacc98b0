"""The corpus pipeline: documents go through the stages one after the other.

Each stage takes (spark, docs, sf_dir) and returns documents with the same columns, the last one packed sequences. A
document is known by its id and a hash of its text, so rows with repeated or NULL ids keep apart.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import jaccard, mixing, packing, quality, suffixes
from seriesmill.llm.shared import saved, shipped, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CHECK = "text_hash"
NEAR_WORDS = 5


def _checked(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64("text").alias(CHECK))


def _those(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of *docs* (checked) whose id and text hash are among *chosen* (id, CHECK)."""
    chosen = chosen.select(F.col("id").alias("chosen_id"), F.col(CHECK).alias("chosen_hash"))
    return docs.join(chosen, (docs[CHECK] == chosen["chosen_hash"]) & docs["doc_id"].eqNullSafe(chosen["chosen_id"]), "left_semi")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps: neither of low quality nor toxic."""
    docs = _checked(docs)
    found = quality.classify(docs, table(spark, sf_dir, "labels"), carry=(CHECK,))
    return _those(docs, found.filter("kept")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates, one row of it: SimHash groups, and what min-hashes propose
    beyond four bits, held against the exact similarity of shingles, 0.8 or more."""
    docs = _checked(docs)
    found = jaccard.similar_groups(docs, words=NEAR_WORDS, carry=(CHECK,))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col(CHECK).alias(CHECK))).alias("first")
    chosen = found.groupBy("root").agg(first).select("first.id", f"first.{CHECK}")
    return _those(docs, chosen).dropDuplicates(["doc_id", CHECK]).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start earlier, too; a character that a passage covers in part stays."""
    found = suffixes.repeated(docs, keep=("lang", "source"))

    def cut(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                left, at = [], 0
                for span in spans:
                    begin, end = span["begin"], span["end"]
                    while begin < end and text[begin] & 0xC0 == 0x80:
                        begin += 1
                    while begin < end < len(text) and text[end] & 0xC0 == 0x80:
                        end -= 1
                    left.append(text[at:begin])
                    at = end
                left.append(text[at:])
                texts.append(b"".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("id", "lang", "source")] + [pa.array(texts, pa.string())], ["id", "lang", "source", "text"])

    kept = found.mapInArrow(cut, found.select("id", "lang", "source", F.lit("").alias("text")).schema)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", "lang", "source", length.alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    docs = _checked(docs)
    name = F.concat_ws("/", F.coalesce(docs["doc_id"].cast("string"), F.lit("NULL")), F.coalesce(docs[CHECK].cast("string"), F.lit("NULL")), F.coalesce(docs["source"], F.lit("")))
    copies = mixing.mix(docs, id=name).groupBy("id").agg(F.sum("copies").cast("int").alias("copies"))
    rows = docs.withColumn("name", name).dropDuplicates(["name"])
    taken = rows.join(copies.filter("copies > 0"), rows["name"] == copies["id"])
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, and where each lies in which sequence."""
    pieces = packing.tokenise(docs, packing.tokenizer_path(), added=True)
    return packing.pack(pieces).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]
ORACLE_SQL = None  # hashes, tokenizers and sampling have no SQL; tests hold each stage against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(shipped(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
