"""Selections of example queries and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffled(seed: int, column: str = "uq_id") -> Column:
    """Sort key of a reproducible shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def _valid(df: DataFrame, valid: DataFrame) -> DataFrame:
    return df.join(valid.filter("valid"), "uq_id", "left_semi")


def select_top_valid(unique: DataFrame, valid: DataFrame, n: int = 50) -> DataFrame:
    return _valid(unique, valid).orderBy(F.desc("freq"), "uq_id").limit(n).select("uq_id", "norm_text", "freq")


def select_random_valid(unique: DataFrame, valid: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    return _valid(unique, valid).orderBy(shuffled(seed), "uq_id").limit(n).select("uq_id", "norm_text", "freq")


def select_by_length(patterns: DataFrame, valid: DataFrame, top: int = 10, offset: int = 1, longest: int = 25) -> DataFrame:
    """n_triples, rank, pattern, uq_id, freq, emitted, score: the ``top`` patterns per length by log occurrences.

    A pattern counts when one of its instances is valid (its slots then match too); the first valid instance is kept.
    Rank 1 of each length is emitted, the others are candidates. The score is that of the pattern.
    """
    c = F.col
    uris = F.aggregate("triples", F.lit(0), lambda n, t: n + sum(
        (F.when(t[r].startswith("<"), 1).otherwise(0) for r in ("s", "p", "o")), F.lit(0)))
    variables = F.aggregate("triples", F.lit(0), lambda n, t: n + sum(
        (F.when(t[r].startswith("?"), 1).otherwise(0) for r in ("s", "p", "o")), F.lit(0)))
    rows = patterns.filter(c("n_triples").between(offset, longest)).join(valid, "uq_id", "left")
    stats = rows.groupBy("pattern").agg(
        F.first("n_triples").alias("n_triples"), F.sum("freq").alias("freq"),
        F.min(F.when(c("valid"), c("uq_id"))).alias("uq_id"), F.first("triples").alias("triples"))
    # nested limits per length are taken before the exchange, so a length is never sorted whole in one task
    rank = F.row_number().over(W.partitionBy("n_triples").orderBy(F.desc("freq"), "pattern"))
    kept = stats.filter("uq_id is not null").withColumn("rank", rank.cast("bigint")).filter(c("rank") <= top)
    return kept.select("n_triples", "rank", "pattern", "uq_id", "freq", (c("rank") == 1).alias("emitted"),
                       _ratio(uris, variables).alias("score"))


def _ratio(uris: Column, variables: Column) -> Column:
    return F.round(F.when(variables == 0, uris.cast("double")).otherwise(uris / F.nullif(variables, F.lit(0))), 6)


def fill_selection(by_length: DataFrame, unique: DataFrame, valid: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """uq_id, phase: emitted picks, then candidates, then random valid queries, without repeats, n in all."""
    order = F.concat(F.lpad(F.col("n_triples").cast("string"), 6, "0"), F.lpad(F.col("rank").cast("string"), 6, "0"))
    picked = by_length.select("uq_id", F.when(F.col("emitted"), 1).otherwise(2).alias("phase"), order.alias("place"))
    # n random queries are enough to fill n places, picked ones included
    spare = select_random_valid(unique, valid, 2 * n, seed).select(
        "uq_id", F.lit(3).alias("phase"), shuffled(seed).alias("place"))
    rows = picked.unionByName(spare).groupBy("uq_id").agg(F.min(F.struct("phase", "place")).alias("f"))
    return rows.orderBy("f", "uq_id").limit(n).select("uq_id", F.col("f.phase").cast("bigint").alias("phase"))


def select_by_entity(index: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """term, uq_id: for shuffled IRIs the first valid query of each, n in all."""
    first = index.groupBy("term").agg(F.min("uq_id").alias("uq_id"))
    return first.orderBy(shuffled(seed, "term"), "term").limit(n)


def queries_for_top_terms(tops: DataFrame, index: DataFrame) -> DataFrame:
    """role, term, uq_id: every valid query of the top terms (columns role, term)."""
    return tops.select("role", "term").join(index.select("term", "uq_id"), "term").select("role", "term", "uq_id")


# --- scores ---------------------------------------------------------------------------------------------------------

def informativeness(triples: DataFrame, key: str = "uq_id") -> DataFrame:
    """key, score: URI occurrences over variable occurrences in all slots; URIs alone when there is no variable."""
    def n(kind: str) -> Column:
        return sum((F.when(F.col(f"{r}.kind") == kind, 1).otherwise(0) for r in ("s", "p", "o")), F.lit(0))
    sums = triples.groupBy(key).agg(F.sum(n("uri")).alias("uris"), F.sum(n("variable")).alias("vars"))
    return sums.select(key, _ratio(F.col("uris"), F.col("vars")).alias("score"))


def z_scores(df: DataFrame, column: str, by: str) -> DataFrame:
    """Add ``z``: (x - mean) / population standard deviation per group; null when all values agree.

    Mean and deviation come from one partial aggregation and a join of one row per group, so a large group is
    never gathered in a window.
    """
    stats = df.groupBy(by).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    z = (F.col(column) - F.col("mean")) / F.nullif(F.round("std", 12), F.lit(0.0))
    return df.join(stats, by).withColumn("z", F.round(z, 6)).drop("mean", "std")


def selection_statistics(selected: DataFrame, scores: DataFrame, counts: DataFrame, expected: int = 50) -> DataFrame:
    """func, n, mean_score, z_sum, n_lengths, short: scores of each selection (columns func, uq_id).

    A selection holds at most ``expected`` queries.
    """
    rows = selected.join(scores, "uq_id", "left").join(counts, "uq_id", "left")
    rows = z_scores(rows, "score", "func")
    return rows.groupBy("func").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"),
        (F.round(F.sum(F.coalesce("z", F.lit(0.0))), 3) + F.lit(0.0)).alias("z_sum"),
        F.count_distinct("n_triples").alias("n_lengths"), (F.count("*") != expected).alias("short"))


def complexity_coverage(statistics: DataFrame, reference_lengths: DataFrame) -> DataFrame:
    """func, coverage: distinct lengths of a selection over the distinct lengths of the by-length selection."""
    total = reference_lengths.agg(F.count_distinct("n_triples").alias("total"))
    return statistics.join(F.broadcast(total)).select(  # one row
        "func", F.round(F.col("n_lengths") / F.nullif(F.col("total"), F.lit(0)), 6).alias("coverage"))


def usefulness(statistics: DataFrame, coverage: DataFrame, basis: str = "mean_score") -> DataFrame:
    """func, z, coverage, usefulness: coverage plus the z-score of the selections' mean score (or sum of z)."""
    z = z_scores(statistics.withColumn("all", F.lit(1)), basis, "all").select("func", "z")
    return z.join(coverage, "func").select(
        "func", "z", "coverage", F.round(F.coalesce("z", F.lit(0.0)) + F.col("coverage"), 6).alias("usefulness"))


def ratio_filter(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.filter(F.col("score") > threshold)
