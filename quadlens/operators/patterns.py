"""Unique queries, query patterns (constants and variables replaced by slots) and their frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadlens import vocab
from quadlens.functions import text as X
from quadlens.operators import decompose as D
from quadlens.operators.conditions import shape_conditions
from quadlens.session import cut


#: What the structure of a query says about its answers, see ``shape_checks``.
FACTS = ("covered", "one_row", "branches", "binds", "conditions")


def unique_queries(queries: DataFrame) -> DataFrame:
    """uq_id, norm_text, freq, form and facts of the well-formed queries that differ after normalisation.

    The facts are what the structure says about the answers: covered, one_row, branches, binds (see ``shape_checks``) and conditions, the
    places of filters, inline data and tests (see ``shape_conditions``).

    Repeated texts are folded first (map-side), so normalisation runs once per distinct text.
    """
    texts = queries.groupBy("query_text").agg(F.min("qid").alias("qid"), F.count("*").alias("n"))
    texts = texts.select("qid", "n", X.canonical(F.col("query_text")).alias("joined"))
    texts = cut(texts.select("qid", "n", X.normal_text(F.col("joined")).alias("norm_text"), X.skeleton(F.col("joined")).alias("skeleton"))
                .withColumn("shape", F.md5("skeleton")), "texts")
    annotated = cut(D.annotated(D.shapes_of(texts)), "annotated")
    ok = D.shape_checks(annotated).filter("is_ok").join(shape_conditions(annotated), "shape", "left").select("shape", *FACTS)
    rows = texts.select("qid", "n", "norm_text", "shape").join(ok, "shape")
    return rows.groupBy("norm_text").agg(
        F.min("qid").alias("uq_id"), F.sum("n").alias("freq"), *[F.first(f).alias(f) for f in FACTS]).select(
        "uq_id", "norm_text", "freq", X.query_form(F.col("norm_text")).alias("form"), *FACTS)


def unique_triples(unique: DataFrame) -> DataFrame:
    """Triple patterns of unique queries with the frequency of their query."""
    return D.triple_patterns(unique, key="uq_id", text="norm_text", carry=("freq",), repeated=False)


def _shape_slots(annotated: DataFrame) -> DataFrame:
    """Positions of everything a pattern replaces, packed per skeleton."""
    c = F.col
    t = c("t")
    opened = F.last(F.when((t == "(") & (c("pd") == 1), c("next")), True).over(
        W.partitionBy("shape", "stmt").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    a = annotated.filter("is_ok").withColumn("opened", opened)
    named = (t == "v") & (c("prev") == "AS")
    a = a.withColumn("agg", F.when(named & (c("head") == "SELECT") & c("opened").isin(*vocab.AGGREGATES),
                                   F.lower("opened")))
    a = a.withColumn("agg_n", F.row_number().over(W.partitionBy("shape", "agg").orderBy("pos")))
    a = a.withColumn("joined", F.max(t.isin("&&", "||") & (c("pd") == 1)).over(W.partitionBy("shape", "stmt")))
    triple = (c("hidden") == 0) & c("is_term") & (c("rank") > c("base")) & ~c("is_path")
    constant = (c("head") == "FILTER") & (c("hidden") == 0) & ~c("joined") & (c("pd") == 1) & t.isin("i", "l", "n") \
        & (c("prev") == "=") & (c("next") == ")")
    return a.groupBy("shape").agg(
        F.array_sort(F.collect_list(F.when(triple, F.struct(
            c("idx").alias("o"), c("subj").alias("s"), c("pred").alias("p"))))).alias("places"),
        F.collect_list(F.when(named & (c("head") == "BIND"), c("pos"))).alias("binds"),
        F.collect_list(F.when(c("agg").isNotNull(), F.struct(
            c("pos").alias("at"), F.concat(F.lit("?"), "agg", c("agg_n").cast("string")).alias("slot")))).alias("aggs"),
        F.collect_list(F.when((t == "n") & c("prev").isin("LIMIT", "OFFSET"), c("pos"))).alias("numbers"),
        F.collect_list(F.when(constant, c("pos"))).alias("constants"))


def generalise(unique: DataFrame, generalise_filters: bool = False, rename_free: bool = False) -> DataFrame:
    """uq_id, freq, form, n_triples, pattern_id, pattern, guards, triples (of the pattern) per unique query.

    Slots are numbered by first appearance: ``?variableN`` for subject and object variables, ``?entN`` for IRIs and
    blank nodes there (types stay), ``?strN`` for literals, ``?predicateN``, ``?bindN``, ``?countN`` and so on for
    aggregate names; LIMIT and OFFSET numbers become 1. A variable with several parts follows bind > predicate >
    variable > aggregate. ``rename_free`` also numbers variables outside all triples as ``?freeN``.
    """
    c = F.col
    tok = D.stored_tokens(unique, "norm_text", ["uq_id", "freq", "form"])
    slots = _shape_slots(D.annotated(D.shapes_of(tok)))
    rows = tok.drop("skeleton").join(slots, "shape")

    def tokens_at(places: Column) -> Column:
        return F.transform(places, lambda i: F.get(c("tokens"), i))

    rows = rows.withColumn("ends", F.array_union(
        tokens_at(F.transform("places", lambda r: r["s"])), tokens_at(F.transform("places", lambda r: r["o"]))))
    rows = rows.withColumn("types", tokens_at(F.transform(F.filter(
        "places", lambda r: F.get(c("tokens"), r["p"]).isin(*[f"<{p}>" for p in vocab.TYPE_PREDICATES])),
        lambda r: r["o"])))
    constants = tokens_at(c("constants")) if generalise_filters else F.array().cast("array<string>")
    rows = rows.withColumn("terms", F.array_union("ends", constants))

    def ordered(values: Column) -> Column:
        return F.array_distinct(F.filter(c("tokens"), lambda t: F.array_contains(values, t)))

    rows = rows.select(
        "*", tokens_at(c("binds")).alias("bind_set"),
        F.filter(tokens_at(F.transform("places", lambda r: r["p"])), lambda t: t.startswith("?")).alias("pred_set"),
        F.filter("ends", lambda t: t.startswith("?")).alias("var_set"),
        F.filter("terms", lambda t: (t.startswith("<") | t.startswith("_:"))
                 & ~F.array_contains("types", t)).alias("ent_set"),
        F.filter("terms", lambda t: t.rlike(r"^[\x22\x270-9+.\-]") | t.isin("true", "false")).alias("str_set"),
        F.transform("aggs", lambda a: F.struct(F.get(c("tokens"), a["at"]).alias("tok"), a["slot"].alias("slot")))
        .alias("agg_set"))
    rows = rows.select("*", *[ordered(c(f"{k}_set")).alias(f"{k}_order") for k in ("bind", "pred", "var", "ent", "str")])
    if rename_free:
        rows = rows.withColumn("free_order", F.array_distinct(F.filter("tokens", lambda t: t.startswith("?") & ~(
            F.array_contains("bind_set", t) | F.array_contains("pred_set", t) | F.array_contains("var_set", t)
            | F.exists("agg_set", lambda a: a["tok"] == t)))))

    def slot(t: Column, kind: str, name: str) -> tuple[Column, Column]:
        nth = F.array_position(c(f"{kind}_order"), t)
        return nth > 0, F.concat(F.lit(name), nth.cast("string"))

    def replaced(t: Column, i: Column) -> Column:
        out = F.when(F.array_contains("numbers", i), F.lit("1"))
        for kind, name in (("bind", "?bind"), ("pred", "?predicate"), ("var", "?variable")):
            out = out.when(*slot(t, kind, name))
        out = out.when(F.exists("agg_set", lambda a: a["tok"] == t),
                       F.get(F.filter("agg_set", lambda a: a["tok"] == t), F.lit(0))["slot"])
        for kind, name in (("ent", "?ent"), ("str", "?str")) + ((("free", "?free"),) if rename_free else ()):
            out = out.when(*slot(t, kind, name))
        return out.otherwise(t)

    def guards(kind: str, test: str, name: str) -> Column:
        return F.when(F.size(f"{kind}_order") > 0, F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(f"{kind}_order"), F.lit(1))),
            lambda i: F.concat(F.lit(f"FILTER {test}({name}"), i.cast("string"), F.lit(")")))) \
            .otherwise(F.array().cast("array<string>"))

    rows = rows.select(
        "uq_id", "freq", "form", "places", F.transform("tokens", replaced).alias("slotted"),
        F.array_join(F.concat(guards("ent", "isIRI", "?ent"), guards("str", "isLiteral", "?str")), " ").alias("guards"))
    rows = rows.select(
        "uq_id", "freq", "form", F.size("places").cast("bigint").alias("n_triples"),
        F.array_join("slotted", " ").alias("pattern"), "guards",
        F.transform("places", lambda r: F.struct(*[D.at(r[k], c("slotted")).alias(k) for k in ("s", "p", "o")]))
        .alias("triples"))
    return rows.withColumn("pattern_id", F.md5("pattern"))


def pattern_instances(patterns: DataFrame) -> DataFrame:
    return patterns.select("pattern_id", "uq_id")


def pattern_freq(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("pattern").agg(F.count("*").alias("n_unique"))


def pattern_freq_weighted(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("pattern").agg(F.sum("freq").alias("n_log"))


def pattern_statistics(patterns: DataFrame) -> DataFrame:
    """pattern, n_unique, n_log in one aggregation; the frequency travels with the pattern, so no join is needed."""
    return patterns.groupBy("pattern").agg(F.count("*").alias("n_unique"), F.sum("freq").alias("n_log"))


def pattern_listing(patterns: DataFrame, unique: DataFrame) -> DataFrame:
    """pattern_id, pattern, uq_id, instance: one row per instance, because a popular pattern has no bounded list."""
    return patterns.select("pattern_id", "pattern", "uq_id").join(
        unique.select("uq_id", F.col("norm_text").alias("instance")), "uq_id")


def length_hist(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("n_triples").agg(F.sum("freq").alias("n"))


def length_hist_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("pattern_id").agg(F.first("n_triples").alias("n_triples")).groupBy("n_triples").agg(
        F.count("*").alias("n"))


def max_length(patterns: DataFrame) -> DataFrame:
    return patterns.agg(F.max("n_triples").alias("max_length"))


def form_hist(checked: DataFrame) -> DataFrame:
    return checked.filter("is_ok").groupBy(X.query_form(F.col("query_text")).alias("form"), "n_triples").agg(
        F.count("*").alias("n"))


def top_queries(unique: DataFrame, n: int = 100) -> DataFrame:
    """rank, query, freq of the n most frequent unique queries (rank over the n kept rows only)."""
    top = unique.orderBy(F.desc("freq"), "uq_id").limit(n)
    return top.select(F.row_number().over(W.orderBy(F.desc("freq"), "uq_id")).cast("bigint").alias("rank"),
                      F.col("norm_text").alias("query"), "freq")


def pattern_docs(patterns: DataFrame, unique: DataFrame, top: int = 10) -> DataFrame:
    """num, rank, pattern, instance, freq: the ``top`` patterns per length with their first instance."""
    stats = patterns.groupBy("pattern").agg(
        F.first("n_triples").alias("num"), F.sum("freq").alias("freq"), F.min("uq_id").alias("uq_id"))
    rank = F.row_number().over(W.partitionBy("num").orderBy(F.desc("freq"), "pattern"))
    kept = stats.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= top)
    return kept.join(unique.select("uq_id", F.col("norm_text").alias("instance")), "uq_id").select(
        "num", "rank", "pattern", "instance", "freq")


def pattern_graph(patterns: DataFrame) -> DataFrame:
    """pattern_id, pos, edge_text: triples of a pattern as ``( group predicate group )``."""
    def group(t: Column) -> Column:
        return (F.when(t.rlike("^[?]ent[0-9]+$"), "entity").when(t.rlike("^[?]str[0-9]+$"), "literal")
                .when(t.startswith("?"), "variable").when(t.rlike(r"^[\x22\x270-9]"), "literal").otherwise("entity"))
    one = patterns.groupBy("pattern_id").agg(F.first("triples").alias("triples"))
    rows = one.select("pattern_id", F.posexplode("triples").alias("pos", "r"))
    return rows.select("pattern_id", F.col("pos").cast("bigint").alias("pos"), F.format_string(
        "( %s %s %s )", group(F.col("r.s")), X.term_struct(F.col("r.p"))["value"], group(F.col("r.o")))
        .alias("edge_text"))
