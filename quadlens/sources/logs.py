"""Readers and writers for access logs, query corpora and parsed queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlens import vocab
from quadlens.functions import text as X

ACCESS_LOG_SCHEMA = "url string, domain string, agent string, `@timestamp` timestamp"
CLEAN_LOG_SCHEMA = "query string, domain string, agent string, ts timestamp"


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """url, domain, agent, ts of a CSV log with a header; columns are found by name.

    Urls are percent-encoded, so no value spans lines and a large file is read in splits.
    """
    rows = spark.read.csv(path, header=True, escape='"')
    return rows.select("url", "domain", "agent", F.col("`@timestamp`").cast("timestamp").alias("ts"))


def read_query_tsv(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """raw: first column of a TSV log. Gzip files are one split each, so their rows are spread right after reading."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    rows = rows.select(F.col(f"`{rows.columns[0]}`").alias("raw"))
    packed = any(name.endswith(".gz") for name in rows.inputFiles())
    return rows.repartition(partitions or spark.sparkContext.defaultParallelism) if packed or partitions else rows


def query_table(raw: DataFrame, column: str = "raw") -> DataFrame:
    """qid, query_text of the rows of a log: texts decoded, ids by a hash of the text, so they are the same in every run."""
    text = X.repair_and_decode(F.col(column))
    return raw.select(text.alias("query_text")).filter("query_text is not null").select(F.xxhash64("query_text").alias("qid"), "query_text")


def read_delimited_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_text per record of a text file with records split by a line of hash signs."""
    rows = spark.read.text(path, lineSep=vocab.RECORD_SEPARATOR)
    return rows.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("query_text")).filter("query_text != ''")


def write_delimited_queries(df: DataFrame, path: str, column: str = "query_text") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").option(
        "lineSep", vocab.RECORD_SEPARATOR + "\n").text(path)


def write_clean_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLEAN_LOG_SCHEMA).csv(path, header=True, multiLine=True, escape='"')


def write_parsed_json(df: DataFrame, path: str) -> None:
    """One JSON document per query."""
    df.write.mode("overwrite").json(path)


def write_statement_json(df: DataFrame, path: str) -> None:
    """qid, statements as JSON lines; variables are written as explicit nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


STATEMENTS = "qid bigint, statements array<struct<subjectValue:string,predicateValue:string,objectValue:string>>"


def read_statement_json(spark: SparkSession, path: str) -> DataFrame:
    """qid, pos, s, p, o: null where the query had a variable."""
    return explode_statements(spark.read.schema(STATEMENTS).json(path))


def explode_statements(rows: DataFrame) -> DataFrame:
    return rows.select("qid", F.posexplode("statements").alias("pos", "t")).select(
        "qid", F.col("pos").cast("bigint").alias("pos"), F.col("t.subjectValue").alias("s"),
        F.col("t.predicateValue").alias("p"), F.col("t.objectValue").alias("o"))

