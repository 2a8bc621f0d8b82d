"""From raw documents to tokens: toxic texts go, one of each group of near copies stays, texts with benchmark passages go,
personal data is replaced, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlens.llm import bpe_trie, pii_boost, size_aware_join, tiling, toxicity
from quadlens.llm.common import bounded_batches, read, remainder
from quadlens.session import cut


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the calibrated threshold of their language."""
    labels = read(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1)
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, once; rows without an id stay."""
    bounded_batches(spark)
    groups = size_aware_join.jaccard_components(docs.select("doc_id", "text"))
    first = cut(groups.where("doc_id = component_id").select("doc_id").distinct(), "first")
    return docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns).unionByName(docs.where("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than half of every benchmark item."""
    return tiling.clean(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; n_chars follows the text."""
    out = pii_boost.redacted(docs, pii_boost.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and digests of the ids and of what they decode to."""
    bounded_batches(spark)
    return bpe_trie.encode_decode(docs).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids")


STAGES = [("toxicity", without_toxic), ("near_duplicates", one_of_each_group), ("decontamination", without_benchmark),
          ("personal_data", without_personal_data), ("tokens", encoded)]

#: No SQL expresses a trained classifier or merges; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
