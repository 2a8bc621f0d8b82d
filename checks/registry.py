"""Every operator as a query over the fixture tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.catalog import EX, RDF_TYPE, RDFS_LABEL
from checks.fixtures import Fixture
from quadlens.functions import text as X
from quadlens.operators import cleaning as B
from quadlens.operators import decompose as C
from quadlens.operators import lookup as L
from quadlens.operators import matching as M
from quadlens.operators import patterns as P
from quadlens.operators import selection as E
from quadlens.operators import shapes as G
from quadlens.operators import summary as N
from quadlens.operators import terms as D
from quadlens.plans.collectors import collect
from quadlens.sources import graph as graph_io
from quadlens.sources import logs as log_io
from quadlens.sources import reports as report_io
from quadlens.session import cut, work_folder
from quadlens.streaming import logs as J

DOMAIN = "bio.example.org"
SPAM = ("buynow",)
NATION, REGION, CUSTOMER, STATUS = (f"<{EX}p/{n}>" for n in ("nation", "region", "customer", "status"))
PARENT = f"<{EX}p/parent>"
TYPE, LABEL = f"<{RDF_TYPE}>", f"<{RDFS_LABEL}>"


def leaves(w: Workload) -> DataFrame:
    """Nodes that have a parent and are no one's parent."""
    links = w.keyed.filter(F.col("p") == PARENT)
    return links.select(F.col("s").alias("x")).join(links.select(F.col("o").alias("x")), "x", "left_anti").distinct()


class Workload(Fixture):
    """Fixture tables plus the intermediate tables several queries share.

    Shared tables are written once to the shared checkpoint folder, so later queries start from a scan.
    """

    @cached_property
    def unique(self) -> DataFrame:
        return cut(P.unique_queries(self.query_log), "unique")

    @cached_property
    def triples(self) -> DataFrame:
        return cut(P.unique_triples(self.unique), "triples")

    @cached_property
    def patterns(self) -> DataFrame:
        return cut(P.generalise(self.unique), "patterns")

    @cached_property
    def valid(self) -> DataFrame:
        return cut(L.validity(self.unique, self.triples, self.quads), "valid")

    @cached_property
    def answers(self) -> DataFrame:
        return cut(L.bindings(self.unique, self.triples, self.quads, most=5), "answers")

    @cached_property
    def keyed(self) -> DataFrame:
        return M.keyed_quads(self.quads)

    @cached_property
    def log_triples(self) -> DataFrame:
        return C.triple_patterns(self.query_log)

    @property
    def clean(self) -> DataFrame:
        return B.clean_log(self.http_log, SPAM)

    @property
    def entities(self) -> DataFrame:
        return D.entity_freq(self.triples, "freq")

    @property
    def ranked(self) -> DataFrame:
        return D.top_labelled(self.entities, L.labels(self.quads, self.entities), 10)

    @cached_property
    def structures(self) -> DataFrame:
        return cut(G.structures(G.bgp_edges(self.triples)), "structures")

    @cached_property
    def by_length(self) -> DataFrame:
        return cut(E.select_by_length(self.patterns, self.valid, 10, 1, 25), "by_length")

    @cached_property
    def index(self) -> DataFrame:
        return cut(L.iri_query_index(self.triples, self.valid, self.ranked), "index")

    @cached_property
    def selected(self) -> DataFrame:
        picks = {"frequency": E.select_top_valid(self.unique, self.valid, 50),
                 "random": E.select_random_valid(self.unique, self.valid, 50, 7),
                 "length": E.fill_selection(self.by_length, self.unique, self.valid, 50, 7),
                 "entity": E.select_by_entity(self.index, 50, 7)}
        out = None
        for name, rows in picks.items():
            rows = rows.select(F.lit(name).alias("func"), "uq_id")
            out = rows if out is None else out.unionByName(rows)
        return cut(out, "selected")  # at most 200 rows

    @cached_property
    def statistics(self) -> DataFrame:
        return cut(E.selection_statistics(self.selected, E.informativeness(self.triples),
                                      self.patterns.select("uq_id", "n_triples")), "statistics")

    @property
    def coverage(self) -> DataFrame:
        return E.complexity_coverage(self.statistics, self.by_length.filter("emitted"))

    @property
    def tops(self) -> DataFrame:
        out = None
        for role, freq in (("s", D.term_freq(self.triples, "s", "freq")), ("p", D.term_freq(self.triples, "p", "freq")),
                           ("o", D.term_freq(self.triples, "o", "freq")), ("type", D.rdf_type_freq(self.triples, "freq"))):
            rows = D.top_labelled(freq, L.labels(self.quads, freq), 5).select(F.lit(role).alias("role"), "term")
            out = rows if out is None else out.unionByName(rows)
        return out

    @cached_property
    def cache(self) -> DataFrame:
        """Verdicts of a first run over the queries with even ids, as a later run reads them."""
        path = work_folder(self.spark, "validity")
        report_io.append_validity(_named(self, "uq_id % 2 = 0"), path)
        return report_io.load_validity(self.spark, path)


_loaded: dict[tuple[str, str], Workload] = {}


def workload(spark: SparkSession, sf_dir: str) -> Workload:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _loaded:
        _loaded[key] = Workload(spark, sf_dir)
    return _loaded[key]


def forget() -> None:
    _loaded.clear()


def flat(triples: DataFrame) -> DataFrame:
    return C.flat_triples(triples).drop("s_at", "p_at", "o_at", "branch", "freq")


# --- streaming ----------------------------------------------------------------------------------------------------

def _hits(w: Workload) -> DataFrame:
    """The access log as a stream: events arrive as files, query texts come from the static order table."""
    events = w.table("events")
    stream = w.spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(w.sf_dir)
    stream.createOrReplaceTempView("quadlens_events")
    from checks.fixtures import TABLES, derived_sql
    names = {t: f"parquet.`{w.sf_dir}/{t}.parquet`" for t in TABLES} | {"events": "quadlens_events"}
    return w.spark.sql(derived_sql(names)["http_log"])


def _stream(start: Callable, read: Callable) -> Callable[[Workload], DataFrame]:
    def run(w: Workload) -> DataFrame:
        base = work_folder(w.spark, "stream")
        start(_hits(w), f"{base}/out", f"{base}/state").awaitTermination()
        return read(w.spark, f"{base}/out")
    return run


QUERIES: dict[str, Callable[[Workload], DataFrame]] = {
    # sources and sinks
    "a5_read_nquads": lambda w: graph_io.parse_nquads(graph_io.nquad_lines(w.quads)),
    "a11_pattern_docs": lambda w: P.pattern_docs(w.patterns, w.unique, 10),
    "a12_validity_cache": lambda w: _cached(w),
    "a14_sample_head": lambda w: B.sample_head(w.http_log, 50, "ts", "hit_id"),
    # log
    "b1_log_selector": lambda w: B.select_sparql_requests(w.http_log, DOMAIN),
    "b2_extract_query_param": lambda w: w.http_log.select(
        "hit_id", X.extract_query_param(F.col("url")).alias("query")),
    "b3_unquote_plus": lambda w: w.http_log.select("hit_id", X.unquote_plus(F.col("url")).alias("url")),
    "b4_repair_and_decode": lambda w: w.http_log.select(
        "hit_id", X.repair_and_decode(X.extract_query_param(F.col("url"))).alias("query")),
    "b5_drop_spam": lambda w: B.drop_spam(w.http_log, SPAM, "url").select("hit_id"),
    "b6_clean_log": lambda w: w.clean,
    "b7_query_form": lambda w: w.query_log.select("qid", X.query_form(F.col("query_text")).alias("form")),
    "b8_parse_or_keep": lambda w: C.parse_or_keep(w.query_log),
    "b9_parse_failures": lambda w: C.parse_failures(C.parse_or_keep(w.query_log)),
    "b10_normalise_query": lambda w: C.parse_or_keep(w.query_log).filter("is_ok").select(
        "qid", X.normalise_query(F.col("query_text")).alias("norm_text")),
    "b10b_expand_prefixes": lambda w: C.parse_or_keep(w.query_log).filter("is_ok").select(
        "qid", (F.lower("query_text").contains("prefix") & ~F.lower(X.normalise_query(F.col("query_text"))).contains("prefix")).alias("expanded"),
        X.normalise_query(F.col("query_text")).alias("norm_text")),
    "b11_strip_limit_offset": lambda w: L.stripped(w.unique),
    "b12_escape_newlines": lambda w: w.query_log.select("qid", X.escape_newlines(F.col("query_text")).alias("line")),
    "b13_faq_search": lambda w: B.faq_search(w.patterns.join(w.unique.select("uq_id", "norm_text"), "uq_id").select(
        F.col("norm_text").alias("question"), "pattern", F.col("uq_id").alias("instance")), "CUSTOMER"),
    "b14_exclude_resource_types": lambda w: D.top_labelled_types(
        D.rdf_type_freq(w.triples, "freq"), L.labels(w.quads), 10),
    "b15_row_audit": lambda w: B.row_audit(w.http_log, w.clean),
    # decomposition
    "c1_tokenise": lambda w: C.token_rows(w.query_log),
    "c2_triple_patterns": lambda w: flat(w.log_triples),
    "c3_classify_terms": lambda w: flat(w.log_triples).groupBy(
        "s_kind", "p_kind", "o_kind", "o_datatype", "o_lang").agg(F.count("*").alias("n")),
    "c4_triple_count": lambda w: C.triple_count(C.parse_or_keep(w.query_log)),
    "c5_iri_mentions": lambda w: C.iri_mentions(w.query_log),
    "c6_values_blocks": lambda w: C.values_blocks(w.query_log).drop("block"),
    "c7_bind_vars": lambda w: C.bind_vars(w.query_log),
    "c8_slice_numbers": lambda w: C.slice_numbers(w.query_log).select("qid", "lim", "off"),
    "c9_aggregate_uses": lambda w: C.aggregate_uses(w.query_log),
    "c10_filter_constants": lambda w: C.filter_constants(w.query_log),
    "c11_type_objects": lambda w: C.type_objects(w.log_triples),
    "c12_bound_terms": lambda w: C.role_terms(w.log_triples, ("s", "o")),
    "c13_whole_terms": lambda w: C.role_terms(w.log_triples, ("s", "p", "o")),
    "c14_statement_rows": lambda w: log_io.explode_statements(C.statement_rows(w.log_triples)),
    "c15_modifier_profile": lambda w: C.modifier_profile(w.query_log),
    "c16_operator_profile": lambda w: C.operator_profile(w.query_log),
    "c17_subquery_levels": lambda w: C.subquery_levels(w.query_log),
    # term statistics
    "d1_subject_freq": lambda w: D.term_freq(w.triples, "s", "freq"),
    "d2_predicate_freq": lambda w: D.term_freq(w.triples, "p", "freq"),
    "d3_object_freq": lambda w: D.term_freq(w.triples, "o", "freq"),
    "d4_literal_freq": lambda w: D.literal_freq(w.triples, "freq"),
    "d5_datatype_freq": lambda w: D.datatype_freq(w.triples, "freq"),
    "d6_language_freq": lambda w: D.language_freq(w.triples, "freq"),
    "d7_literal_label_freq": lambda w: D.literal_label_freq(w.triples, "freq"),
    "d8_rdf_type_freq": lambda w: D.rdf_type_freq(w.triples, "freq"),
    "d9_entity_freq": lambda w: w.entities,
    "d10_distinct_terms": lambda w: D.distinct_terms(w.triples, "freq"),
    "d11_word_count": lambda w: D.word_count(w.table("documents"), "text"),
    "d11_top_words": lambda w: D.ranked_plain(D.word_count(w.table("documents"), "text"), 15),
    "d12_type_statistics": lambda w: D.type_statistics(w.triples, w.unique),
    "d12_valid_type_statistics": lambda w: D.type_statistics(w.triples, w.unique, w.valid),
    # unique queries and patterns
    "d13_unique_queries": lambda w: w.unique.drop(*P.FACTS),
    "d13b_top_queries": lambda w: P.top_queries(w.unique, 100),
    "h1_generalise_query": lambda w: w.patterns.select("uq_id", "pattern", "n_triples"),
    "h1_generalise_filters": lambda w: P.generalise(w.unique, generalise_filters=True).groupBy("pattern").agg(
        F.count("*").alias("n")),
    "h2_slot_guards": lambda w: w.patterns.select("uq_id", "guards"),
    "h3_keep_type_objects": lambda w: w.patterns.select("uq_id", "pattern", F.col("pattern").contains("class/").alias("has_type")),
    "h4_patterns_by_form": lambda w: w.patterns.groupBy("form").agg(
        F.count_distinct("pattern").alias("n_patterns"), F.count("*").alias("n_queries")),
    "d14_pattern_instances": lambda w: P.pattern_instances(w.patterns),
    "d15_pattern_freq": lambda w: P.pattern_freq(w.patterns),
    "d16_pattern_freq_weighted": lambda w: P.pattern_freq_weighted(w.patterns),
    "d17_pattern_statistics": lambda w: P.pattern_statistics(w.patterns),
    "d18_pattern_listing": lambda w: P.pattern_listing(w.patterns, w.unique).drop("pattern_id"),
    "d19_length_hist_queries": lambda w: P.length_hist(w.patterns),
    "d20_length_hist_patterns": lambda w: P.length_hist_patterns(w.patterns),
    "d21_max_length": lambda w: P.max_length(w.patterns),
    "d22_length_by_form": lambda w: P.form_hist(C.parse_or_keep(w.query_log)),
    # rankings and selections
    "e1_top_labelled": lambda w: w.ranked,
    "e2_top_labelled_types": lambda w: D.top_labelled_types(D.term_freq(w.triples, "o", "freq"), L.labels(w.quads), 10),
    "e3_ranked_with_label": lambda w: D.ranked_with_label(
        D.term_freq(w.triples, "s", "freq"), L.labels(w.quads),
        L.exists_in_role(D.term_freq(w.triples, "s", "freq"), w.quads, "s"), 100),
    "e4_ranked_plain": lambda w: D.ranked_plain(D.literal_freq(w.triples, "freq"), 100),
    "e4b_ranked_optional_label": lambda w: D.ranked_optional_label(w.entities, L.labels(w.quads)),
    "e5_select_top_valid": lambda w: E.select_top_valid(w.unique, w.valid, 50),
    "e6_select_random_valid": lambda w: E.select_random_valid(w.unique, w.valid, 50, 7),
    "e7_select_by_length": lambda w: w.by_length,
    "e8_fill_selection": lambda w: E.fill_selection(w.by_length, w.unique, w.valid, 50, 7),
    "e9_select_by_entity": lambda w: E.select_by_entity(w.index, 50, 7),
    "e10_queries_for_top_terms": lambda w: E.queries_for_top_terms(
        w.tops, L.iri_query_index(w.triples, w.valid, w.tops, key="any")),
    "e11_sort_by_value": lambda w: P.pattern_freq(w.patterns).orderBy(F.desc("n_unique"), "pattern"),
    "e12_cluster_report": lambda w: G.cluster_report(G.iso_clusters(w.structures), 500),
    "e12_first_small_cluster": lambda w: G.first_small_cluster(
        G.iso_members(w.structures), G.iso_clusters(w.structures), 500),
    # scores
    "s1_informativeness": lambda w: E.informativeness(w.triples),
    "s2_z_scores": lambda w: E.z_scores(
        w.unique.join(E.informativeness(w.triples), "uq_id").select("uq_id", "form", "score"), "score", "form"),
    "s3_selection_statistics": lambda w: w.statistics,
    "s4_complexity_coverage": lambda w: w.coverage,
    "s5_usefulness": lambda w: E.usefulness(w.statistics, w.coverage),
    "s6_ratio_threshold": lambda w: E.ratio_filter(E.informativeness(w.triples), 1.0),
    # look-ups
    "f1_label_lookup": lambda w: L.labels(w.quads),
    "f2_exists_in_role": lambda w: _roles(w),
    "f3_validity": lambda w: w.valid,
    "f5_memoised_validity": lambda w: L.validity_incremental(w.unique, w.triples, w.quads, w.cache),  # half are known
    "f6_first_binding": lambda w: L.first_binding(w.answers),
    "f7_ranked_entity_filter": lambda w: L.touching(w.triples, w.ranked).select("uq_id", "pos"),
    "f8_iri_query_index": lambda w: w.index,
    "f8_iri_query_index_any": lambda w: L.iri_query_index(w.triples, w.valid, w.ranked, key="any"),
    "f10_result_signature": lambda w: L.result_signature(w.answers, 5),
    "f11_equivalent_queries": lambda w: L.equivalent_queries(
        G.simplified_key(w.triples), L.result_signature(w.answers, 5)),
    # shapes
    "g1_bgp_edges": lambda w: G.bgp_edges(w.triples).select(
        "uq_id", "bgp_id", "pos", "src", "dst", "src_group", "dst_group", "pval", "pgrp"),
    "g1_bgp_nodes": lambda w: G.bgp_nodes(G.bgp_edges(w.triples)),
    "g1_bgp_multigraph": lambda w: G.bgp_edges(w.triples, multigraph=True).groupBy("uq_id", "bgp_id").agg(
        F.count("*").alias("n_edges")),
    "g2_shape_signature": lambda w: G.shape_signature(G.bgp_edges(w.triples)),
    "g3_iso_clusters": lambda w: G.iso_clusters(w.structures).drop("canon"),
    "g4_iso_clusters_by_predicate": lambda w: G.iso_clusters(
        G.structures(G.bgp_edges(w.triples), edge_label="value")).drop("canon"),
    "g5_equivalence_classes": lambda w: G.map_equivalence(w.triples, w.equiv).select(
        "uq_id", "pos", "s_class", "p_class", "o_class"),
    "g6_simplified_triples": lambda w: G.simplified_key(w.triples),
    "g7_pattern_graph": lambda w: P.pattern_graph(w.patterns),
    "g8_cluster_members": lambda w: _members(w),
    # graph summary
    "n1_type_predicate_type": lambda w: N.kg_summary(w.quads),
    "n1_one_graph": lambda w: N.kg_summary(w.quads, EX + "graph/geo"),
    "n2_summary_with_labels": lambda w: N.kg_summary_labelled(w.quads),
    "n3_void_partitions": lambda w: N.void_triples(N.kg_summary_labelled(w.quads), EX + "dataset"),
    "n4_property_profile": lambda w: N.property_profile(w.quads),
    "n5_class_profile": lambda w: N.class_profile(w.quads),
    "n6_graph_profile": lambda w: N.graph_profile(w.quads),
    # matching
    "i1_bgp_match": lambda w: M.bgp_match(
        [("?o", CUSTOMER, "?c"), ("?c", NATION, "?n")], w.keyed,
        w.keyed.filter(F.col("p") == REGION).select(F.col("s").alias("n"), F.col("o").alias("r"))),
    "i2_optional": lambda w: M.optional(
        M.triple(w.keyed, "?x", TYPE, "?t"), M.triple(w.keyed, "?x", LABEL, "?l"), ["x"]),
    "i3_union": lambda w: M.union_branches(
        M.triple(w.keyed, "?c", NATION, "?n"), M.triple(w.keyed, "?o", CUSTOMER, "?c")),
    "i4_minus": lambda w: M.minus(M.triple(w.keyed, "?o", CUSTOMER, "?c"),
                                  M.triple(w.keyed, "?c", NATION, f"<{EX}nation/1>"), ["c"]),
    "i5_exists": lambda w: M.exists(M.triple(w.keyed, "?c", NATION, "?n"),
                                    M.triple(w.keyed, "?o", CUSTOMER, "?c"), ["c"]),
    "i6_filter": lambda w: M.triple(w.keyed, "?x", LABEL, "?l").filter(
        M.lang_matches(F.col("l"), "en") & M.str_value(F.col("l")).rlike("[02468]$") & M.is_iri(F.col("x"))
        & M.is_literal(F.col("l"))),
    "i7_values_join": lambda w: M.values_join(
        M.triple(w.keyed, "?c", NATION, "?n"),
        w.table("nation").filter("n_regionkey = 1").select(
            F.concat(F.lit(f"<{EX}nation/"), "n_nationkey", F.lit(">")).alias("n"))),
    "i8_bind": lambda w: M.triple(w.keyed, "?o", CUSTOMER, "?c").select(
        "o", M.str_after(M.str_value(F.col("o")), "order/").alias("nr"),
        F.concat(M.str_value(F.col("c")), F.lit("#it")).alias("iri"),
        F.when(F.col("c").endswith("0>"), "zero").otherwise("other").alias("last")),
    "i9_group_aggregate": lambda w: M.bgp_match([("?o", CUSTOMER, "?c"), ("?o", STATUS, "?s")], w.keyed).groupBy("c")
    .agg(F.count("*").alias("n"), F.count_distinct("s").alias("n_status"), F.min("o").alias("first"),
         F.max("o").alias("last"), F.array_join(F.array_sort(F.collect_set("s")), "; ").alias("all_s"))
    .filter("n > 5"),
    "i10_modifiers": lambda w: M.triple(w.keyed, "?c", NATION, "?n").select(F.col("n").alias("nation")).distinct()
    .orderBy(F.desc("nation")).offset(3).limit(10),
    "i11_graph_clause": lambda w: M.graph(w.keyed, EX + "graph/geo").select("g", "s", "p", "o"),
    "i12_path_sequence": lambda w: M.path_sequence(w.keyed, CUSTOMER, NATION),
    "i12_path_alternative": lambda w: M.path_alternative(w.keyed, [NATION, REGION]),
    "i13_path_closure": lambda w: M.path_closure(w.keyed, PARENT),
    "i13_path_star": lambda w: M.path_closure(w.keyed, PARENT, start=leaves(w), zero=True),
    "i13_path_depth": lambda w: M.path_closure(w.keyed, PARENT, start=leaves(w), steps=2),
    "i13_path_groups": lambda w: M.path_groups(w.keyed, PARENT),
    "i13_path_condensed": lambda w: M.condensed_closure(w.keyed, PARENT, M.path_groups(w.keyed, PARENT)),
    "i14_subselect": lambda w: M.triple(w.keyed, "?c", NATION, "?n").join(
        M.triple(w.keyed, "?o", CUSTOMER, "?c").groupBy("c").agg(F.count("*").alias("orders"))
        .orderBy(F.desc("orders"), "c").limit(20), "c"),
    "i15_blank_property_list": lambda w: M.bgp_match(
        [("?o", CUSTOMER, "?b"), ("?b", NATION, f"<{EX}nation/2>"), ("?b", LABEL, "?l")], w.keyed).select("o", "l"),
    "i16_construct": lambda w: M.construct(
        M.bgp_match([("?s", NATION, "?n"), ("?n", REGION, "?r")], w.keyed),
        [(F.col("s"), F.lit(f"<{EX}p/in>"), F.col("r")), (F.col("r"), F.lit(f"<{EX}p/has>"), F.col("n"))]),
    "i17_ask": lambda w: M.ask(M.bgp_match([("?o", STATUS, '"F"^^http://www.w3.org/2001/XMLSchema#string'),
                                            ("?o", CUSTOMER, "?c")], w.keyed)),
    "i18_describe": lambda w: M.describe(
        w.keyed, w.table("nation").select(F.concat(F.lit(f"<{EX}nation/"), "n_nationkey", F.lit(">")).alias("term")),
        as_object=True),
    # plug-ins
    "x1_collectors": lambda w: _collected(w),
    "x2_visitor_rows": lambda w: flat(w.log_triples).filter("ctx in ('service', 'optional')"),
    # streams
    "j1_stream_clean_log": _stream(lambda s, out, st: J.stream_clean_log(s, out, st, SPAM),
                                   lambda spark, out: spark.read.parquet(out)),
    "j2_stream_term_counts": _stream(lambda s, out, st: J.stream_term_counts(s, out, st, SPAM),
                                     J.term_counts),
    "j3_windowed_counts": _stream(J.windowed_counts, lambda spark, out: J.latest_counts(
        spark, out, ["start", "domain"]).withColumn("start", F.col("start").cast("timestamp_ntz"))),
}


def _named(w: Workload, which: str) -> DataFrame:
    return w.valid.filter(which).join(w.unique, "uq_id").select(L.text_key(F.col("norm_text")).alias("text_key"), "valid")


def _cached(w: Workload) -> DataFrame:
    """Verdicts written by two runs, read back for every unique query."""
    path = work_folder(w.spark, "validity")
    for which in ("uq_id % 2 = 0", "uq_id % 2 = 1"):
        report_io.append_validity(_named(w, which), path)
    known = report_io.load_validity(w.spark, path)
    return w.unique.select("uq_id", L.text_key(F.col("norm_text")).alias("text_key")).join(known, "text_key", "left").select("uq_id", "valid")


def _roles(w: Workload) -> DataFrame:
    out = None
    for role in ("s", "p", "o"):
        rows = L.exists_in_role(D.term_freq(w.triples, role, "freq"), w.quads, role).select(
            F.lit(role).alias("role"), "term")
        out = rows if out is None else out.unionByName(rows)
    return out


def _members(w: Workload) -> DataFrame:
    """Members with the representative of their cluster."""
    reps = G.iso_clusters(w.structures).select(
        "canon", F.col("uq_id").alias("rep_uq_id"), F.col("bgp_id").alias("rep_bgp_id"))
    return G.iso_members(w.structures).join(reps, "canon").drop("canon")


def _collected(w: Workload) -> DataFrame:
    out = None
    for name, rows in collect(w.triples, "languages", "datatypes", "types").items():
        rows = rows.select(F.lit(name).alias("collector"), "term", "n")
        out = rows if out is None else out.unionByName(rows)
    return out
