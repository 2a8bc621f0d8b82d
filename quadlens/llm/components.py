"""Connected components of a table of links by contraction inside partitions and by stars; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlens.session import cut

LINKS = 1_000_000  # links (two longs each) that a task holds at most


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these links with the smallest node they lead to, but for those nodes themselves."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[:len(u)], place[len(u):]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            break
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contracted(links: DataFrame, most: int = LINKS) -> DataFrame:
    """Links (u, v) of the same components: each task replaces what it reads by stars, `most` links at a time."""
    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u = v = np.empty(0, np.int64)
        for batch in batches:
            u, v = np.r_[u, batch["u"].to_numpy(np.int64)], np.r_[v, batch["v"].to_numpy(np.int64)]
            if len(u) >= most:
                u, v = forest(u, v)
                if len(u) >= most // 2:
                    yield pd.DataFrame({"u": u, "v": v})
                    u = v = np.empty(0, np.int64)
        u, v = forest(u, v)
        yield pd.DataFrame({"u": u, "v": v})
    return links.mapInPandas(work, "u long, v long")


def components(links: DataFrame, a: str, b: str, most: int = LINKS) -> DataFrame:
    """(node, component): each node of a link with the smallest node it can reach. Links may repeat or be loops.

    Tasks first contract the links they read, then the links of several tasks together, as many as one may hold. If one task
    may hold all that are left, this is the outcome. Otherwise stars are made of all links in turn with more contraction, until
    nothing changes, a logarithmic number of rounds. Large star: every node's larger neighbours are linked to its smallest one.
    Small star: every node's smaller neighbours and itself are linked to its smallest one. Both are a grouped minimum and a
    join. A hub's links stay rows; its minimum is a partial aggregation.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
    edges = cut(contracted(edges, most), "links")
    while True:
        tasks = -(-edges.count() // most)
        edges = cut(contracted(edges.coalesce(max(1, tasks)), most), "links", [edges])
        if tasks <= 1 or _stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star
        stars = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        joined = stars.join(least, "u")
        stars = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(stars, "links", [edges])
    edges = edges.distinct() if tasks > 1 else edges
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link down or is only linked to, which makes it its component's smallest."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("downs"), F.count("*").alias("all"))
    return nodes.where("downs > 1 or (downs = 1 and all > 1)").isEmpty()
