"""Basic graph patterns as graphs: shape signatures, isomorphism clusters, simplified triples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlens.functions.canonical import canonical_form

KEY = ["uq_id", "bgp_id"]
WEIGHTED = [*KEY, "freq"]  # the frequency of the query travels with its patterns


def _group(kind: Column) -> Column:
    return F.when(kind.isin("uri", "blank"), "entity").otherwise(kind)


def _node(role: str) -> Column:
    """Node identity: kind and value (with datatype and language), so a variable never merges with a literal."""
    return F.concat_ws(" ", f"{role}.kind", f"{role}.value", f"{role}.datatype", f"{role}.lang")


def bgp_edges(triples: DataFrame, multigraph: bool = False) -> DataFrame:
    """uq_id, bgp_id, freq, pos, src, dst, src_group, dst_group, pval, pgrp; by default one edge per ordered pair."""
    rows = triples.select(
        *WEIGHTED, "pos", _node("s").alias("src"), _node("o").alias("dst"), _group(F.col("s.kind")).alias("src_group"),
        _group(F.col("o.kind")).alias("dst_group"), F.col("p.value").alias("pval"),
        F.when(F.col("p.kind") == "variable", "variable").otherwise("property").alias("pgrp"))
    if multigraph:
        return rows
    first = F.min(F.struct("pos", "src_group", "dst_group", "pval", "pgrp")).alias("e")
    return rows.groupBy(*WEIGHTED, "src", "dst").agg(first).select(*WEIGHTED, "e.pos", "src", "dst", "e.src_group",
                                                             "e.dst_group", "e.pval", "e.pgrp")


def bgp_nodes(edges: DataFrame) -> DataFrame:
    """uq_id, bgp_id, node, grp."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("src_group").alias("grp")),
                   F.struct(F.col("dst").alias("node"), F.col("dst_group").alias("grp")))
    return edges.select(*KEY, F.inline(ends)).distinct()


def shape_signature(edges: DataFrame) -> DataFrame:
    """uq_id, bgp_id, n_edges, n_nodes, n_entity, n_variable, n_literal, degrees (sorted, ``2,1,1``)."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("src_group").alias("grp")),
                   F.struct(F.col("dst").alias("node"), F.col("dst_group").alias("grp")))
    degree = edges.select(*KEY, F.inline(ends)).groupBy(*KEY, "node", "grp").agg(F.count("*").alias("d"))

    def n(group: str) -> Column:
        return F.count(F.when(F.col("grp") == group, 1)).alias(f"n_{group}")
    return degree.groupBy(*KEY).agg(
        (F.sum("d") / 2).cast("bigint").alias("n_edges"), F.count("*").alias("n_nodes"),
        n("entity"), n("variable"), n("literal"),
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list("d"), asc=False), lambda d: d.cast("string")))
        .alias("degrees"))


def structures(edges: DataFrame, edge_label: str = "group") -> DataFrame:
    """uq_id, bgp_id, freq, n_edges, n_nodes, structure: nodes renamed by first appearance, as JSON.

    Equal texts are equal structures, which folds nearly all patterns before anything is compared. The edges of one
    pattern come from one query text, so the list is bounded by it.
    """
    label = F.col("pgrp") if edge_label == "group" else F.concat_ws(" ", "pgrp", "pval")
    packed = edges.groupBy(*WEIGHTED).agg(F.array_sort(F.collect_list(F.struct(
        "pos", "src", "dst", "src_group", "dst_group", label.alias("label")))).alias("es"))
    packed = packed.withColumn("nodes", F.array_distinct(F.flatten(F.transform("es", lambda e: F.array(
        F.struct(e["src"].alias("node"), e["src_group"].alias("grp")),
        F.struct(e["dst"].alias("node"), e["dst_group"].alias("grp")))))))

    def number(node: Column, group: Column) -> Column:
        return F.array_position(F.col("nodes"), F.struct(node.alias("node"), group.alias("grp"))) - 1
    links = F.transform("es", lambda e: F.array(
        number(e["src"], e["src_group"]).cast("string"), number(e["dst"], e["dst_group"]).cast("string"), e["label"]))
    body = F.concat(
        F.lit('{"g": '), F.to_json(F.transform("nodes", lambda n: n["grp"])),
        F.lit(', "e": ['), F.array_join(F.transform(links, lambda x: F.concat(
            F.lit("["), F.get(x, F.lit(0)), F.lit(", "), F.get(x, F.lit(1)), F.lit(", "),
            F.regexp_extract(F.to_json(F.array(F.get(x, F.lit(2)))), r"(?s)^\[(.*)\]$", 1), F.lit("]"))), ", "),
        F.lit("]}"))
    return packed.select(*WEIGHTED, F.size("es").cast("bigint").alias("n_edges"),
                         F.size("nodes").cast("bigint").alias("n_nodes"), body.alias("structure"))


def canonical_structures(found: DataFrame) -> DataFrame:
    """structure, canon for the distinct structures (exact: equal canon means isomorphic)."""
    def canon(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(canon=[canonical_form(s) for s in batch["structure"]])
    distinct = found.select("structure").distinct()
    return distinct.mapInPandas(canon, "structure string, canon string").select("structure", F.md5("canon").alias("canon"))


def iso_members(found: DataFrame) -> DataFrame:
    """uq_id, bgp_id, canon: every basic graph pattern (see ``structures``) with the key of its isomorphism class."""
    return found.join(canonical_structures(found), "structure").select(*KEY, "canon")


def iso_clusters(found: DataFrame) -> DataFrame:
    """canon, n (patterns in the log), n_unique, uq_id and bgp_id of the representative (the smallest), n_edges, n_nodes.

    Patterns of equal structure are counted before their canonical form is looked up.
    """
    folded = found.groupBy("structure").agg(
        F.sum("freq").alias("n"), F.count("*").alias("n_unique"), F.min(F.struct(*KEY)).alias("first"),
        F.first("n_edges").alias("n_edges"), F.first("n_nodes").alias("n_nodes"))
    return folded.join(canonical_structures(found), "structure").groupBy("canon").agg(
        F.sum("n").alias("n"), F.sum("n_unique").alias("n_unique"), F.min("first").alias("first"),
        F.first("n_edges").alias("n_edges"), F.first("n_nodes").alias("n_nodes")) \
        .select("canon", "n", "n_unique", "first.*", "n_edges", "n_nodes")


def cluster_report(clusters: DataFrame, threshold: int = 100) -> DataFrame:
    """n_clusters, n_shown (more than threshold members), n_skipped."""
    big = F.col("n") > threshold
    return clusters.agg(F.count("*").alias("n_clusters"), F.count(F.when(big, 1)).alias("n_shown"),
                        F.count(F.when(~big, 1)).alias("n_skipped"))


def first_small_cluster(members: DataFrame, clusters: DataFrame, threshold: int = 100) -> DataFrame:
    """Members of the first cluster (by representative) with fewer than ``threshold`` members."""
    small = clusters.filter(F.col("n") < threshold).orderBy("uq_id", "bgp_id").limit(1).select("canon")
    return members.join(small, "canon", "left_semi").select(*KEY)


# --- equivalence and simplified triples -------------------------------------------------------------------------------

def map_equivalence(triples: DataFrame, equiv: DataFrame) -> DataFrame:
    """Triple patterns with the class of each term: s_class, p_class, o_class.

    ``equiv`` (term, class) is a lookup table; Spark sends it to all executors when its size allows.
    """
    for role in ("s", "p", "o"):
        classes = equiv.select(F.col("term").alias(f"{role}_term"), F.col("class").alias(f"{role}_known"))
        default = F.when(F.col(f"{role}.kind") == "uri", F.lit("property" if role == "p" else "entity")) \
            .otherwise(_group(F.col(f"{role}.kind")))
        triples = (triples.withColumn(f"{role}_term", F.when(F.col(f"{role}.kind") == "uri", F.col(f"{role}.value")))
                   .join(classes, f"{role}_term", "left")
                   .withColumn(f"{role}_class", F.coalesce(f"{role}_known", default)).drop(f"{role}_term", f"{role}_known"))
    return triples


def simplified_key(triples: DataFrame, equiv: DataFrame | None = None) -> DataFrame:
    """uq_id, n_simple, key: the (subject class, predicate, object class) of a query as one key.

    Two queries agree if they have as many triples and the same set of lines, so the key holds the number of triples.
    """
    if equiv is None:
        s, o = _group(F.col("s.kind")), _group(F.col("o.kind"))
    else:
        triples = map_equivalence(triples, equiv)
        s, o = F.col("s_class"), F.col("o_class")
    line = F.concat_ws(" ", s, F.concat("p.kind", F.lit(":"), "p.value"), o)
    lines = triples.groupBy("uq_id", line.alias("line")).agg(F.count("*").alias("n"))
    return lines.groupBy("uq_id").agg(F.sum("n").alias("n_simple"), F.md5(F.concat_ws(
        "\n", F.sum("n").cast("string"), F.array_join(F.array_sort(F.collect_list("line")), "\n"))).alias("key"))
