"""Benchmark decontamination by greedy string tiling.

A document meets the items with which it shares a seed: a run of LEAST tokens, the shortest match that counts. For each
such pair the longest matches of tokens not used yet are marked, again and again, with Karp-Rabin hashes of the lengths
searched for. The tiles cover the item in any order, so a passage whose parts were moved is caught as well.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quadlens.llm.common import keep_rows, map_texts, mix, only, word_hashes, words

LEAST = 5  # tokens of the shortest match
FIRST = 24  # the length searched for first
COVERED = 0.5  # share of an item's tokens in tiles from which on a document counts as contaminated
#: Characters of benchmark text that one pass over the documents takes; more text means more passes.
BLOCK_CHARS = 20_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE, _BACK = np.uint64(0x100000001B3), np.uint64(pow(0x100000001B3, -1, 1 << 64))


def tokens(text: str) -> np.ndarray:
    """Hashes of the words without punctuation at their ends; what is punctuation alone is no token."""
    bare = [w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in words(text)]
    return word_hashes([w for w in bare if w])


def grams(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k tokens."""
    if len(x) < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = x[:len(x) - k + 1]
        for j in range(1, k):
            out = mix(out * _STEP + x[j:len(x) - k + 1 + j])
    return out


def _rolled(x: np.ndarray, free: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of the runs of k free tokens, and where they start."""
    if len(x) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    used = np.r_[0, np.cumsum(~free)]
    at = np.flatnonzero(used[k:] == used[:-k])
    # prefix sums of x[i] * base^i, scaled back by base^-start: the same value for equal runs wherever they start
    with np.errstate(over="ignore"):
        forth, back = (np.cumprod(np.r_[np.uint64(1), np.full(len(x) - 1, f)], dtype=np.uint64) for f in (_BASE, _BACK))
        total = np.r_[np.uint64(0), np.cumsum(x * forth, dtype=np.uint64)]
        return (total[at + k] - total[at]) * back[at], at


def tile(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length), none overlapping another, longest first at each search length."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(FIRST, len(item)))
    while True:
        longest, matches = _matches(item, doc, free_item, free_doc, length)
        if longest > 2 * length:
            length = longest
            continue
        marked = False
        for size in sorted(matches, reverse=True):
            for a, b in matches[size]:
                if free_item[a:a + size].all() and free_doc[b:b + size].all():
                    free_item[a:a + size] = free_doc[b:b + size] = False
                    tiles.append((a, b, size))
                    marked = True
        if marked:
            continue  # what is left of matches that others cut short
        if length <= least:
            return tiles
        length = max(least, length // 2)


def _matches(item: np.ndarray, doc: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray, k: int) -> tuple[int, dict[int, list[tuple[int, int]]]]:
    """Maximal matches of at least k free tokens by length, and the greatest length."""
    hashes, at = _rolled(item, free_item, k)
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    if not len(at):
        return 0, found
    places = defaultdict(list)
    for h, i in zip(hashes.tolist(), at.tolist()):
        places[h].append(i)
    other, there = _rolled(doc, free_doc, k)
    hit = np.isin(other, hashes)
    longest = 0
    for h, b in zip(other[hit].tolist(), there[hit].tolist()):
        for a in places[h]:
            if a and b and free_item[a - 1] and free_doc[b - 1] and item[a - 1] == doc[b - 1]:
                continue  # begins earlier
            most = min(len(item) - a, len(doc) - b)
            same = (item[a:a + most] == doc[b:b + most]) & free_item[a:a + most] & free_doc[b:b + most]
            size = most if same.all() else int(same.argmin())
            if size >= k:
                found[size].append((a, b))
                longest = max(longest, size)
    return longest, found


class Items:
    """A block of the benchmark, ready to be compared with texts."""

    def __init__(self, rows: list[tuple[int, str]], least: int) -> None:
        self.least = least
        self.tokens = [(i, t) for i, t in ((i, tokens(t or "")) for i, t in rows) if len(t)]
        by_width: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, t) in enumerate(self.tokens):
            k = min(least, len(t))
            by_width[k] += [(int(g), n) for g in grams(t, k)]
        #: for each width: the sorted seeds, the items that have each, and a table of bits that most other runs fail
        self.seeds = []
        for k, pairs in by_width.items():
            owners = defaultdict(set)
            for g, n in pairs:
                owners[g].add(n)
            keys = np.array(sorted(owners), np.uint64)
            bits = np.zeros(1 << 20, bool)
            bits[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.seeds.append((k, keys, [sorted(owners[g]) for g in keys.tolist()], bits))

    def found_in(self, text: str, covered: float) -> list[tuple[int, int, int, int, float]]:
        """(item, its tokens, tokens in tiles, tiles, share) of the items of which at least `covered` is found."""
        return self.found_in_tokens(tokens(text), covered)

    def found_in_tokens(self, x: np.ndarray, covered: float) -> list[tuple[int, int, int, int, float]]:
        met: dict[int, list[int]] = defaultdict(list)
        for k, keys, owners, bits in self.seeds:
            g = grams(x, k)
            maybe = np.flatnonzero(bits[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if not len(maybe):
                continue
            place = np.searchsorted(keys, g[maybe])
            place[place == len(keys)] = 0
            sure = keys[place] == g[maybe]
            for at, p in zip(maybe[sure].tolist(), place[sure].tolist()):
                for n in owners[p]:
                    met[n].append(at)
        out = []
        for n, places in sorted(met.items()):
            name, item = self.tokens[n]
            k = min(self.least, len(item))
            near = np.unique(np.asarray(places)[:, None] + np.arange(k))
            # no tile can reach beyond the seeds; different stretches are kept apart by a token no text has
            stretch = x[near]
            apart = np.flatnonzero(np.diff(near) > 1) + 1
            stretch = np.insert(stretch, apart, np.arange(1, len(apart) + 1, dtype=np.uint64))
            most = np.zeros(len(item), bool)
            own = np.isin(grams(item, k), grams(stretch, k))
            for j in range(k):
                most[j:len(item) - k + 1 + j] |= own
            if most.sum() < covered * len(item):
                continue
            tiles = tile(item, stretch, k)
            total = sum(size for *_, size in tiles)
            if total >= covered * len(item):
                out.append((name, len(item), total, len(tiles), total / len(item)))
        return out


def blocks(benchmark: DataFrame, least: int, limit: int = BLOCK_CHARS) -> Iterator[Items]:
    """The benchmark in blocks of about `limit` characters: what the driver and a task hold does not grow with it."""
    rows = only(benchmark, "item_id", "text").where("item_id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(size // limit) + 1
    for b in range(n):
        yield Items([(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()], least)


def contaminated(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, item_tokens, covered_tokens, tiles, coverage) of every document and item with enough coverage.

    Null and empty texts and items match nothing; items shorter than `least` tokens must occur in whole to be a seed.
    Repeated rows give repeated results; equal items each give their rows. Rows with a null id are compared as others.
    """
    spark, out = docs.sparkSession, None
    item = benchmark.schema["item_id"].dataType.simpleString()
    for block in blocks(benchmark, least):
        shared = spark.sparkContext.broadcast(block)  # bounded by BLOCK_CHARS

        def work(texts: list[str], shared=shared) -> tuple[list, np.ndarray]:
            hits = [(row, *hit) for row, t in enumerate(texts) for hit in shared.value.found_in(t, covered)]
            return [[h[i] for h in hits] for i in range(1, 6)], np.array([h[0] for h in hits], np.int64)

        part = map_texts(docs, ["doc_id"], "text", [("item_id", item, to_arrow_type(benchmark.schema["item_id"].dataType)), *(
            (n, "long", pa.int64()) for n in ("item_tokens", "covered_tokens", "tiles")), ("coverage", "double", pa.float64())], work)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, least: int = LEAST) -> DataFrame:
    """The rows of docs, all columns, that hold no item; one pass for each block of the benchmark, no exchange."""
    for block in blocks(benchmark, least):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        docs = keep_rows(docs, "text", lambda texts, _, shared=shared: np.array([not shared.value.found_in(t, covered) for t in texts], bool))
    return docs
