"""Readers and writers for graph data as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlens import vocab
from quadlens.functions import text as X

_QUAD = (r"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+"
         r"(<[^>]*>|_:\S+|\x22(?:[^\x22\\]++|\\.)*+\x22(?:@[A-Za-z0-9\-]+|\^\^<[^>]*>)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*$")


def parse_nquads(lines: DataFrame, column: str = "value") -> DataFrame:
    """s, p, o, o_kind, datatype, lang, g of N-Quads lines; comments, blanks and lines in another form are left out."""
    parts = [F.regexp_extract(column, _QUAD, i).alias(n) for i, n in enumerate(("s", "p", "o", "g"), 1)]
    rows = lines.filter(F.col(column).rlike(_QUAD)).select(*parts)

    def plain(name: str) -> Column:
        return F.when(F.col(name).startswith("<"), F.substr(name, F.lit(2), F.length(name) - 2)).otherwise(F.col(name))
    term = X.term_struct(F.col("o"))
    return rows.select(plain("s").alias("s"), plain("p").alias("p"), term.alias("t"),
                       F.nullif(plain("g"), F.lit("")).alias("g")).select(
        "s", "p", F.col("t.value").alias("o"), F.col("t.kind").alias("o_kind"),
        F.when(F.col("t.lang").isNull(), F.col("t.datatype")).alias("datatype"), F.col("t.lang").alias("lang"), "g")


def rejected_nquads(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are neither a quad, a comment nor blank."""
    return lines.filter(~F.col(column).rlike(_QUAD) & ~F.col(column).rlike(r"^\s*(#.*)?$"))


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    return parse_nquads(spark.read.text(path))


def nquad_lines(quads: DataFrame) -> DataFrame:
    """value: quads as N-Quads lines."""
    def node(name: str) -> Column:
        return F.when(F.col(name).startswith("_:"), F.col(name)).otherwise(F.concat(F.lit("<"), F.col(name), F.lit(">")))
    suffix = (F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang"))
              .when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).otherwise(""))
    obj = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), X.escape(F.col("o")), F.lit('"'), suffix)) \
        .otherwise(node("o"))
    return quads.select(F.concat_ws(" ", node("s"), node("p"), obj, F.when(F.col("g").isNotNull(), node("g")), F.lit("."))
                        .alias("value"))


def write_ntriples(df: DataFrame, path: str) -> None:
    """s, p, o, o_kind as N-Triples text; whole numbers are typed."""
    number = F.when((F.col("o_kind") == "literal") & F.col("o").rlike("^[0-9]+$"), F.lit(vocab.XSD + "integer"))
    null = F.lit(None).cast("string")
    nquad_lines(df.select("s", "p", "o", "o_kind", number.alias("datatype"), null.alias("lang"), null.alias("g"))) \
        .write.mode("overwrite").text(path)
