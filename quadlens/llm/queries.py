"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlens.llm import bpe_trie, embed_forest, embed_whitening, kneser_ney, licences, nbsvm, pii_boost, prefix_counts, shard_tree, size_aware_join, tiling, token_alignment, toxicity
from quadlens.llm.common import read, remainder
from quadlens.session import cut


def op1_embed_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_forest.near_copies(read(spark, sf_dir, "embeddings"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score(read(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0)


def op3_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder("doc_id", 3) != 1))
    scored = toxicity.score(docs, model, ("doc_id", "lang"))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= toxicity.PREDICT_AT).cast("int").alias("predicted"),
                         toxicity.thresholds(model).alias("threshold"))


def op5_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.place(read(spark, sf_dir, "documents"))


def op6_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.digests(bpe_trie.encode_decode(read(spark, sf_dir, "documents")))


def op7_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = nbsvm.score(docs, nbsvm.fit(docs, labels.where(remainder("doc_id", 5) != 0)))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= nbsvm.PREDICT_AT).cast("int").alias("predicted"))


def op8_size_aware_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_aware_join.jaccard_components(read(spark, sf_dir, "documents"))


def op9_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii_boost.report(docs, pii_boost.fit(docs))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    # documents have no path of their own: their source and language are the directories
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licences.licensed(docs.select("doc_id", F.when(F.col("source").isNotNull(), path).alias("path"), "text"))


def op11_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cut(prefix_counts.prefix_table(read(spark, sf_dir, "documents")), "prefixes")
    return prefix_counts.report(table, 512)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.report(read(spark, sf_dir, "documents"))


def op13_embed_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_whitening.whiten(read(spark, sf_dir, "embeddings"))


OPERATORS = (op1_embed_forest, op2_kneser_ney, op3_tiling, op4_toxicity, op5_shard_tree, op6_bpe_trie, op7_nbsvm, op8_size_aware_join, op9_pii_boost,
             op10_licences, op11_prefix_counts, op12_token_alignment, op13_embed_whitening)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}

#: DuckDB SQL where it can express the operator; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {}
