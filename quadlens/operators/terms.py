"""Term statistics and rankings over triple patterns.

Every function takes triple patterns with an optional weight column. Counting over unique queries weighted by their
frequency gives the counts of the whole log, with the repeated texts already folded away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlens import vocab


def _total(weight: str | None) -> Column:
    return (F.sum(weight) if weight else F.count("*")).cast("bigint").alias("n")


def term_freq(triples: DataFrame, role: str, weight: str | None = None) -> DataFrame:
    """term, n: URIs in one role (s, p or o)."""
    return (triples.filter(F.col(f"{role}.kind") == "uri").groupBy(F.col(f"{role}.value").alias("term"))
            .agg(_total(weight)))


def _literals(triples: DataFrame, weight: str | None) -> DataFrame:
    return triples.filter(F.col("o.kind") == "literal").select(
        F.col("o.value").alias("value"), F.coalesce("o.datatype", F.lit(vocab.NO_TYPE)).alias("datatype"),
        F.coalesce("o.lang", F.lit(vocab.NO_LANGUAGE)).alias("lang"), *([weight] if weight else []))


def literal_freq(triples: DataFrame, weight: str | None = None) -> DataFrame:
    return _literals(triples, weight).groupBy(F.col("value").alias("term")).agg(_total(weight))


def datatype_freq(triples: DataFrame, weight: str | None = None) -> DataFrame:
    return _literals(triples, weight).groupBy(F.col("datatype").alias("term")).agg(_total(weight))


def language_freq(triples: DataFrame, weight: str | None = None) -> DataFrame:
    return _literals(triples, weight).groupBy(F.col("lang").alias("term")).agg(_total(weight))


def literal_label_freq(triples: DataFrame, weight: str | None = None) -> DataFrame:
    label = F.concat("datatype", F.lit("---"), "lang")
    return _literals(triples, weight).groupBy(label.alias("term")).agg(_total(weight))


def rdf_type_freq(triples: DataFrame, weight: str | None = None) -> DataFrame:
    return term_freq(triples.filter((F.col("p.kind") == "uri") & (F.col("p.value") == vocab.RDF_TYPE)), "o", weight)


def _uri_roles(triples: DataFrame, weight: str | None) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}.kind").alias("kind"),
                               F.col(f"{r}.value").alias("term")) for r in ("s", "p", "o")])
    return (triples.select(F.explode(cells).alias("c"), *([weight] if weight else [])).filter("c.kind = 'uri'")
            .select("c.role", "c.term", *([weight] if weight else [])))


def entity_freq(triples: DataFrame, weight: str | None = None) -> DataFrame:
    """term, n: URIs in any role; one pass instead of a union of the three role counts."""
    return _uri_roles(triples, weight).groupBy("term").agg(_total(weight))


def distinct_terms(triples: DataFrame, weight: str | None = None, approximate: bool = False) -> DataFrame:
    """role, n_distinct, n_total for s, p, o and all roles together.

    Terms are counted per role first, so no group of the final step is larger than its number of distinct terms.
    """
    rows = _uri_roles(triples, weight)
    if approximate:
        both = rows.select(F.explode(F.array("role", F.lit("all"))).alias("role"), "term", *([weight] if weight else []))
        return both.groupBy("role").agg(F.approx_count_distinct("term").alias("n_distinct"),
                                        _total(weight).alias("n_total"))
    per_role = rows.groupBy("role", "term").agg(_total(weight))
    total = per_role.groupBy("term").agg(F.sum("n").alias("n")).select(F.lit("all").alias("role"), "term", "n")
    return per_role.unionByName(total).groupBy("role").agg(
        F.count("*").alias("n_distinct"), F.sum("n").alias("n_total"))


def word_count(df: DataFrame, column: str) -> DataFrame:
    """word, n over whitespace-separated words."""
    return (df.select(F.explode(F.split(column, r"\s+")).alias("word")).filter("word != ''")
            .groupBy("word").agg(F.count("*").alias("n")))


def type_statistics(triples: DataFrame, unique: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """type, n, sample: type objects of unique queries with one query that uses each (the one with the largest id)."""
    from quadlens.operators.decompose import type_objects
    types = type_objects(triples, "uq_id")
    if valid is not None:
        types = types.join(valid.filter("valid"), "uq_id", "left_semi")
    stats = types.groupBy("type", "kind").agg(F.count("*").alias("n"), F.max("uq_id").alias("uq_id"))
    return stats.join(unique.select("uq_id", F.col("norm_text").alias("sample")), "uq_id").select(
        "type", "kind", "n", "sample")


# --- rankings (ties by value) -------------------------------------------------------------------------------------

def ranked_plain(freq: DataFrame, n: int = 100) -> DataFrame:
    return freq.orderBy(F.desc("n"), *[c for c in freq.columns if c != "n"]).limit(n)


def top_labelled(freq: DataFrame, labels: DataFrame, n: int = 10, exclude: str | None = None) -> DataFrame:
    """The n most frequent terms that have a label, optionally without terms containing a text."""
    if exclude:
        freq = freq.filter(~F.contains("term", F.lit(exclude)))
    return freq.join(labels.select("term", "label"), "term").orderBy(F.desc("n"), "term").limit(n)


def top_labelled_types(freq: DataFrame, labels: DataFrame, n: int = 10) -> DataFrame:
    return top_labelled(freq, labels, n, exclude=":Resource")


def ranked_with_label(freq: DataFrame, labels: DataFrame, present: DataFrame, n: int = 100) -> DataFrame:
    """The n most frequent terms that have a label or occur in the graph (``present``: column term)."""
    known = freq.join(labels.select("term", "label"), "term", "left").join(
        present.select("term", F.lit(True).alias("seen")), "term", "left")
    return known.filter("label is not null or seen").select("term", "label", "n").orderBy(F.desc("n"), "term").limit(n)


def ranked_optional_label(freq: DataFrame, labels: DataFrame) -> DataFrame:
    return freq.join(labels.select("term", "label"), "term", "left").select("term", "label", "n")
