"""Whole runs: log cleaning, term statistics, pattern ranking, isomorphism report, graph summary.

Shared intermediate tables (unique queries, their triple patterns, patterns, verdicts) are written once below ``out``
and read back, so later steps and restarted runs do not repeat the text work.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlens import vocab
from quadlens.operators import cleaning as B
from quadlens.operators import decompose as C
from quadlens.operators import lookup as L
from quadlens.operators import patterns as P
from quadlens.operators import selection as E
from quadlens.operators import shapes as G
from quadlens.operators import summary as N
from quadlens.operators import terms as D
from quadlens.plans.collectors import collect
from quadlens.session import cut
from quadlens.sources import graph as graph_io
from quadlens.sources import logs as log_io
from quadlens.sources import reports as report_io


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def run_cleaning(http_log: DataFrame, out: str, domain: str | None = None,
                 words: tuple[str, ...] = vocab.SPAM_WORDS) -> DataFrame:
    """Cleaned log as CSV and the number of rows read and kept."""
    rows = B.select_sparql_requests(http_log, domain) if domain else http_log
    cleaned = B.clean_log(rows, words)
    log_io.write_clean_csv(cleaned, f"{out}/clean_log.csv")
    return B.row_audit(rows, log_io.read_clean_csv(http_log.sparkSession, f"{out}/clean_log.csv"))


def prepare(queries: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """Unique queries and their triple patterns, written once."""
    unique = stored(P.unique_queries(queries), f"{out}/unique_queries")
    return unique, stored(P.unique_triples(unique), f"{out}/unique_triples")


def run_statistics(queries: DataFrame, quads: DataFrame, out: str, top: int = 100) -> dict[str, DataFrame]:
    """Ranked term reports: URIs with label or presence in the graph, literal properties as they are."""
    _, triples = prepare(queries, out)
    counts = collect(triples, "subjects", "predicates", "objects", "types", "literals", "languages", "datatypes",
                     "literal labels")
    reports = {}
    for name, role in (("subjects", "s"), ("predicates", "p"), ("objects", "o"), ("types", "o")):
        freq = counts[name]
        reports[name] = D.ranked_with_label(freq, L.labels(quads, freq), L.exists_in_role(freq, quads, role), top)
    for name in ("literals", "languages", "datatypes", "literal labels"):
        reports[name] = D.ranked_plain(counts[name], top)
    reports["vocabulary"] = D.distinct_terms(triples, "freq")
    for name, report in reports.items():
        report_io.write_ranked_report(report, f"{out}/statistics/{name.replace(' ', '_')}")
    return reports


def run_pattern_ranking(queries: DataFrame, quads: DataFrame, out: str, n: int = 50, top: int = 10, longest: int = 25,
                        seed: int = 0) -> dict[str, DataFrame]:
    """Patterns with frequencies, four selections of example queries, and their usefulness."""
    spark: SparkSession = queries.sparkSession
    unique, triples = prepare(queries, out)
    patterns = stored(P.generalise(unique), f"{out}/patterns")
    # verdicts are kept between runs; only queries not seen before are matched
    cache = f"{out}/validity"
    try:
        known = cut(report_io.load_validity(spark, cache), "validity")
    except AnalysisException:  # first run: no cache yet
        known = spark.createDataFrame([], "text_key string, valid boolean")
    valid = stored(L.validity_incremental(unique, triples, quads, known), f"{out}/verdicts")
    keys = unique.select("uq_id", L.text_key(F.col("norm_text")).alias("text_key")).join(known, "text_key", "left_anti")
    report_io.append_validity(valid.join(keys, "uq_id"), cache)

    entities = D.entity_freq(triples, "freq")
    index = stored(L.iri_query_index(triples, valid, D.top_labelled(entities, L.labels(quads, entities), n * top)),
                   f"{out}/iri_queries")
    by_length = stored(E.select_by_length(patterns, valid, top, 1, longest), f"{out}/by_length")
    picks = {
        "frequency": E.select_top_valid(unique, valid, n).select("uq_id"),
        "entity": E.select_by_entity(index, n, seed).select("uq_id"),
        "length": E.fill_selection(by_length, unique, valid, n, seed).select("uq_id"),
        "random": E.select_random_valid(unique, valid, n, seed).select("uq_id"),
    }
    selected = None
    for name, rows in picks.items():
        rows = rows.select(F.lit(name).alias("func"), "uq_id")
        selected = rows if selected is None else selected.unionByName(rows)
    scores = E.informativeness(triples)
    counts = patterns.select("uq_id", "n_triples")
    stats = stored(E.selection_statistics(selected, scores, counts, n), f"{out}/selection_statistics")
    coverage = E.complexity_coverage(stats, by_length.filter("emitted"))
    reports = {
        "pattern_statistics": P.pattern_statistics(patterns), "type_statistics": D.type_statistics(triples, unique, valid),
        "scores": scores, "selected": selected, "usefulness": E.usefulness(stats, coverage),
        "pattern_frequency": P.pattern_freq(patterns).orderBy(F.desc("n_unique"), "pattern"),
        "lengths": P.length_hist(patterns), "pattern_lengths": P.length_hist_patterns(patterns),
    }
    for name, report in reports.items():
        report_io.write_ranked_report(report, f"{out}/ranking/{name}")
    report_io.write_pattern_docs(P.pattern_docs(patterns, unique, top), f"{out}/ranking/pattern_docs")
    return reports


def run_isomorphism(queries: DataFrame, out: str, threshold: int = 100) -> dict[str, DataFrame]:
    """Clusters of basic graph patterns of the same shape, with the number of queries that were not well formed."""
    _, triples = prepare(queries, out)
    found = stored(G.structures(G.bgp_edges(triples)), f"{out}/structures")
    clusters = stored(G.iso_clusters(found), f"{out}/clusters")
    return {"clusters": clusters.filter(F.col("n") > threshold), "report": G.cluster_report(clusters, threshold),
            "failures": C.parse_failures(C.parse_or_keep(queries)),
            "members": G.first_small_cluster(G.iso_members(found), clusters, threshold)}


def run_summary(quads: DataFrame, out: str, dataset: str, graph: str | None = None) -> DataFrame:
    """Dataset description as N-Triples."""
    triples = N.void_triples(N.kg_summary_labelled(quads, graph), dataset)
    graph_io.write_ntriples(triples, f"{out}/metadata.nt")
    return triples
