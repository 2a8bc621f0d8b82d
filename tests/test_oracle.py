"""A part of the registered queries next to their oracles on the smallest data; ``checks.run`` does all of them."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from checks.oracle import oracles
from checks.registry import QUERIES
from checks.run import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ["b1_log_selector", "b6_clean_log", "b8_parse_or_keep", "c1_tokenise", "c5_iri_mentions", "d2_predicate_freq",
         "d10_distinct_terms", "d13_unique_queries", "d17_pattern_statistics", "g3_iso_clusters", "g8_cluster_members",
         "h1_generalise_query", "i13_path_closure", "n1_type_predicate_type", "n3_void_partitions", "s2_z_scores",
         "j1_stream_clean_log", "j2_stream_term_counts", "j3_windowed_counts"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == "ok"


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracles())
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_entry_works_without_the_optional_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("quadlens", "checks"):
        shutil.copytree(os.path.join(root, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(root, name)):
            shutil.copy(os.path.join(root, name), tmp_path)
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True,
                           text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
    assert set(found.stdout.split()) == set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).count() > 5
