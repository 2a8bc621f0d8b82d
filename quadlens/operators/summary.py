"""Summaries of a quad table: how types are linked by predicates, profiles of properties, classes and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlens import vocab


def _typed(quads: DataFrame) -> DataFrame:
    return quads.filter((F.col("p") == vocab.RDF_TYPE) & (F.col("o_kind") == "uri")).select(
        F.col("s").alias("node"), F.col("o").alias("type")).distinct()


def kg_summary(quads: DataFrame, graph: str | None = None) -> DataFrame:
    """p, stype, otype, scount, ocount: distinct subjects and objects per predicate and pair of types.

    An object that fills a large share of the graph is one (p, stype, o) row before its types are joined for the
    object count, and the subject count drops repeated objects early too.
    """
    if graph is not None:
        quads = quads.filter(F.col("g") == graph)
    types = _typed(quads)
    links = quads.filter("o_kind = 'uri'").select("s", "p", "o").join(
        types.select(F.col("node").alias("s"), F.col("type").alias("stype")), "s")
    otypes = types.select(F.col("node").alias("o"), F.col("type").alias("otype"))
    objects = links.select("p", "stype", "o").distinct().join(otypes, "o")
    ocount = objects.groupBy("p", "stype", "otype").agg(F.count("*").alias("ocount"))
    subjects = links.join(otypes, "o").select("p", "stype", "otype", "s").distinct()
    scount = subjects.groupBy("p", "stype", "otype").agg(F.count("*").alias("scount"))
    return scount.join(ocount, ["p", "stype", "otype"]).select("p", "stype", "otype", "scount", "ocount")


def kg_summary_labelled(quads: DataFrame, graph: str | None = None) -> DataFrame:
    """kg_summary with the (smallest) rdfs:label of both types, where there is one."""
    label = quads.filter((F.col("p") == vocab.RDFS_LABEL) & (F.col("o_kind") == "literal")).groupBy("s").agg(
        F.min("o").alias("label"))
    return (kg_summary(quads, graph)
            .join(label.select(F.col("s").alias("stype"), F.col("label").alias("slabel")), "stype", "left")
            .join(label.select(F.col("s").alias("otype"), F.col("label").alias("olabel")), "otype", "left")
            .select("p", "stype", "otype", "scount", "ocount", "slabel", "olabel"))


def void_triples(summary: DataFrame, dataset: str) -> DataFrame:
    """s, p, o, o_kind: the labelled summary as a dataset description with nested partitions."""
    key = F.concat_ws(" ", "p", "stype", "otype")
    part, cls, ocls = (F.concat(F.lit(f"_:{n}"), F.md5(key)) for n in ("p", "c", "o"))

    def t(s, p: str, o, kind: str):
        return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    rows = F.array(
        t(F.lit(dataset), vocab.RDF_TYPE, F.lit(vocab.VOID + "Dataset"), "uri"),
        t(F.lit(dataset), vocab.VOID + "propertyPartition", part, "blank"),
        t(part, vocab.VOID + "property", F.col("p"), "uri"),
        t(part, vocab.VOID + "classPartition", cls, "blank"),
        t(cls, vocab.VOID + "class", F.col("stype"), "uri"),
        t(cls, vocab.VOID + "distinctSubjects", F.col("scount").cast("string"), "literal"),
        t(part, vocab.VOID_EXT + "objectClassPartition", ocls, "blank"),
        t(ocls, vocab.VOID + "class", F.col("otype"), "uri"),
        t(ocls, vocab.VOID + "distinctObjects", F.col("ocount").cast("string"), "literal"),
        t(F.col("stype"), vocab.RDFS_LABEL, F.col("slabel"), "literal"),
        t(F.col("otype"), vocab.RDFS_LABEL, F.col("olabel"), "literal"))
    return summary.select(F.inline(rows)).filter("o is not null").distinct()


def property_profile(quads: DataFrame) -> DataFrame:
    """p, n, ns, no: triples, distinct subjects and distinct objects per property.

    Counts per (p, s) and per (p, o) come first, so a property that fills a third of the graph is spread over its
    subjects and objects before its totals are added up.
    """
    subjects = quads.groupBy("p", "s").agg(F.count("*").alias("n")).groupBy("p").agg(
        F.sum("n").alias("n"), F.count("*").alias("ns"))
    objects = quads.select("p", "o", "o_kind", "datatype", "lang").distinct().groupBy("p").agg(F.count("*").alias("no"))
    return subjects.join(objects, "p").select("p", "n", "ns", "no")


def class_profile(quads: DataFrame) -> DataFrame:
    return _typed(quads).groupBy(F.col("type").alias("class")).agg(F.count("*").alias("n"))


def graph_profile(quads: DataFrame) -> DataFrame:
    return quads.groupBy("g").agg(F.count("*").alias("n"))
