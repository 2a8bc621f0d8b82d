"""Access log to clean query table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlens import vocab
from quadlens.functions import text as X


def select_sparql_requests(http_log: DataFrame, domain: str) -> DataFrame:
    """Requests to ``domain`` or its subdomains whose url mentions sparql, query and one of the query forms."""
    url = F.col("url")
    return http_log.filter(
        ((F.col("domain") == domain) | F.col("domain").endswith("." + domain))
        & X.contains_any(url, ["sparql"]) & X.contains_any(url, ["query"]) & X.contains_any(url, vocab.REQUEST_FORMS))


def drop_spam(df: DataFrame, words: Sequence[str] = vocab.SPAM_WORDS, column: str = "query") -> DataFrame:
    return df.filter(~X.contains_any(F.col(column), words))


def clean_log(http_log: DataFrame, words: Sequence[str] = vocab.SPAM_WORDS) -> DataFrame:
    """query, domain, agent, ts: the decoded query of every request; spam and all other columns are dropped."""
    query = X.unquote_plus(X.extract_query_param(F.col("url")))
    return drop_spam(http_log.select(query.alias("query"), "domain", "agent", "ts"), words)


def row_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    def step(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")
    return step(before, "read").unionByName(step(after, "kept"))


def sample_head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First n rows in a stated order (a top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)


def faq_search(faq: DataFrame, term: str) -> DataFrame:
    return faq.filter(F.contains(F.lower("question"), F.lit(term.lower())))
