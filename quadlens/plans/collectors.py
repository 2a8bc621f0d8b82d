"""Collectors: named functions from triple patterns (with a frequency) to a report, the place to plug in new ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quadlens.operators import shapes as G
from quadlens.operators import terms as D

Collector = Callable[[DataFrame], DataFrame]

COLLECTORS: dict[str, Collector] = {
    "subjects": lambda t: D.term_freq(t, "s", "freq"),
    "predicates": lambda t: D.term_freq(t, "p", "freq"),
    "objects": lambda t: D.term_freq(t, "o", "freq"),
    "entities": lambda t: D.entity_freq(t, "freq"),
    "literals": lambda t: D.literal_freq(t, "freq"),
    "datatypes": lambda t: D.datatype_freq(t, "freq"),
    "languages": lambda t: D.language_freq(t, "freq"),
    "literal labels": lambda t: D.literal_label_freq(t, "freq"),
    "types": lambda t: D.rdf_type_freq(t, "freq"),
    "isomorphism": lambda t: G.iso_clusters(G.structures(G.bgp_edges(t))),
}


def register(name: str, collector: Collector) -> None:
    COLLECTORS[name] = collector


def collect(triples: DataFrame, *names: str) -> dict[str, DataFrame]:
    return {name: COLLECTORS[name](triples) for name in names or COLLECTORS}
