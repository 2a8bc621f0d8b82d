"""Ranked reports, pattern documents and the validity cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlens import vocab
from quadlens.functions import text as X


def report_lines(df: DataFrame, *columns: str) -> DataFrame:
    """value: columns joined as ``a & b``, newlines escaped."""
    def cell(name: str) -> Column:
        return X.escape_newlines(F.coalesce(F.col(name).cast("string"), F.lit("")))
    return df.select(F.concat_ws(vocab.REPORT_SEPARATOR, *[cell(c) for c in columns or df.columns]).alias("value"))


def write_ranked_report(df: DataFrame, path: str, *columns: str) -> None:
    report_lines(df, *columns).write.mode("overwrite").text(path)


def write_pattern_docs(docs: DataFrame, path: str) -> None:
    """JSON lines per number of triples."""
    docs.select(
        "num", F.concat(F.lit("Query pattern "), F.col("rank").cast("string")).alias("Title"),
        F.col("pattern").alias("SPARQL Query Pattern"), F.col("instance").alias("Instance Query"),
        F.col("num").alias("Contained Triple's Number"), F.col("freq").alias("Frequency")) \
        .write.mode("overwrite").partitionBy("num").json(path)


def append_validity(df: DataFrame, path: str) -> None:
    """df: text_key, valid. Undecided queries are not kept, so a later run tries them again."""
    df.select("text_key", "valid").filter("valid is not null").write.mode("append").parquet(path)


def load_validity(spark: SparkSession, path: str) -> DataFrame:
    """text_key, valid; a query checked more than once keeps one verdict."""
    return spark.read.parquet(path).groupBy("text_key").agg(F.max("valid").alias("valid"))
