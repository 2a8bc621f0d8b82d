"""The log as a stream: cleaning, running counts and counts per time window.

Sinks are files, so nothing is gathered on the driver, and every batch can be written again after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadlens.functions import text as X
from quadlens.operators import decompose as D
from quadlens.operators.cleaning import clean_log


def stream_clean_log(http_log: DataFrame, out: str, state: str, words: tuple[str, ...]) -> StreamingQuery:
    """Clean a streaming access log into parquet files; stateless, each batch is appended once."""
    return (clean_log(http_log, words).writeStream.format("parquet").option("checkpointLocation", state)
            .outputMode("append").trigger(availableNow=True).start(out))


def _upsert_log(out: str):
    """Keep every batch of changed counts in a folder of its own, so a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return write


def stream_counts(stream: DataFrame, keys: list[str], out: str, state: str) -> StreamingQuery:
    """Running counts per key: only changed counts of a batch are written."""
    return (stream.groupBy(*keys).agg(F.count("*").alias("n")).writeStream.outputMode("update")
            .option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(_upsert_log(out)).start())


def latest_counts(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Current state of running counts: counts only grow, so the largest is the latest."""
    return spark.read.parquet(out).groupBy(*keys).agg(F.max("n").alias("n"))


def stream_term_counts(http_log: DataFrame, out: str, state: str, words: tuple[str, ...]) -> StreamingQuery:
    """Frequency of normalised well-formed queries, counted batch by batch, so no text stays in the stream's state."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = D.parse_or_keep(batch.select(F.col("query").alias("query_text"))).filter("is_ok")
        norm = rows.select(X.normalise_query(F.col("query_text")).alias("norm_text"))
        _upsert_log(out)(norm.groupBy("norm_text").agg(F.count("*").alias("n")).withColumn("text_key", F.md5("norm_text")), batch_id)
    return (clean_log(http_log, words).writeStream.option("checkpointLocation", state).trigger(availableNow=True)
            .foreachBatch(write).start())


def term_counts(spark: SparkSession, out: str) -> DataFrame:
    """norm_text, n: the sums of all batches."""
    return spark.read.parquet(out).groupBy("text_key").agg(F.first("norm_text").alias("norm_text"), F.sum("n").alias("n")).drop("text_key")


def windowed_counts(http_log: DataFrame, out: str, state: str, width: str = "1 hour", late: str = "1 hour") -> StreamingQuery:
    """Requests per window and domain; a window is final once the watermark has passed it."""
    stream = http_log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(F.window("ts", width).start.alias("start"), "domain")
    return stream_counts(stream, ["start", "domain"], out, state)
