"""Jaccard join of word shingles: a size-aware heavy-light join.

1. Possible documents. Two linked sets share most of their elements, so they share several of their smallest hashes. Only
   those are dealt out and counted; a document too few of whose smallest hashes occur elsewhere links with nothing. The
   hashes travel as packed arrays, one for each piece of text and part of the hash space. A hash that a piece holds often
   is sent once, so a very common shingle costs one entry for each piece.
2. Equal sets become one class at once; the join runs over one representative of each.
3. Light-light pairs meet in subsets of two elements, all others in inverted lists of single elements. Both are taken from
   a set's rarest elements only, as many as linked sets cannot help sharing. The size that parts light from heavy is the
   one with the lowest counted cost.
4. Each set is first compared with the hubs of a few of its most frequent elements, so most of a large group of copies is one
   component before its lists are made, and lists with a single component are not made at all.
5. Long lists are then compared with one member, their hub. Members that are in one component by then need no more
   comparing; what is left is compared in whole, or with ever more hubs while a list is very long, until each list has one
   component left or every pair of it was compared. So a large group of copies costs links in proportion to its size, and
   no pair is lost. A pair's sets are read only if what both have after the shared element is enough for a link, and if the
   parities of their elements in BITS hash classes do not show that they differ in too many elements.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlens.llm.common import grow, map_texts, mix, only, pack, parts_of, pieces, runs_of, shrink, unpack, word_hashes, words
from quadlens.llm.components import components
from quadlens.session import cut

WIDTH = 5  # words of a shingle
PIECE = 2_000_000  # characters that share one packed array
MANY = np.uint32(0xFFFFFFFF)  # in place of a document: several of the piece
LIGHT_MOST = 64  # the boundary is looked for up to this size
#: Lists up to these lengths are compared in whole, in the first round and in the second; longer ones with hubs. Each round after
#: that takes lists 16 times as long in whole: what hubs have not made one component by then are sets that hardly link.
WHOLE = (8, 1024)
FIRST = 3  # elements by which each set meets hubs before lists are made
BITS = 512  # hash classes whose parities are kept of each set, as BITS / 64 longs
PARITY = [f"p{i}" for i in range(BITS // 64)]


def needed(n: np.ndarray) -> np.ndarray:
    """Elements that a set of n shares at least with any set it links with: three quarters of it."""
    return (3 * n + 3) // 4


def shingle_sets(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles in order, and each set's size. Fewer words than a shingle make one."""
    found = [words(t) for t in texts]
    size = np.array([len(ws) for ws in found], np.int64)
    h = word_hashes([w for ws in found for w in ws])
    count = np.where(size >= WIDTH, size - WIDTH + 1, (size > 0).astype(np.int64))
    starts = np.r_[0, np.cumsum(count)]
    out = np.empty(starts[-1], np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        if len(h) >= WIDTH:
            text = np.repeat(np.arange(len(found), dtype=np.int32), size)
            x = h[:len(h) - WIDTH + 1]
            for k in range(1, WIDTH):
                x = mix(x * step + h[k:len(h) - WIDTH + 1 + k])
            out[np.repeat(size >= WIDTH, count)] = x[text[WIDTH - 1:] == text[:len(text) - WIDTH + 1]]
        first = np.r_[0, np.cumsum(size)]
        for i in np.flatnonzero((size > 0) & (size < WIDTH)):
            x = np.array([size[i]], np.uint64)
            for w in h[first[i]:first[i + 1]]:
                x = mix(x * step + w)
            out[starts[i]] = x[0]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        out[a:b].sort()
    owner = np.repeat(np.arange(len(found)), count)
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.bincount(owner[new], minlength=len(found))


def possible(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, same, candidate): size and name of every row's set (equal sets have equal names), and whether it may link.

    Of a set of n the n - needed(n) + 1 + n // 16 smallest hashes are counted; linked sets share 1 + needed(n) // 16 of them.
    """
    shards = parts_of(docs.sparkSession)

    def deal(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a task that runs again reads the same split and numbers its pieces alike
        number = TaskContext.get().partitionId() << 32
        for piece in pieces(batches, "t", PIECE):
            x, n = shingle_sets(piece["t"])
            ends = np.cumsum(n)
            same = b"".join(xxhash.xxh3_128_digest(x[a:b].tobytes()) for a, b in zip((ends - n).tolist(), ends.tolist()))
            taken = np.where(n > 0, n - needed(n) + 1 + n // 16, 0)
            starts = np.cumsum(n) - n
            place = np.arange(len(x)) - np.repeat(starts, n) < np.repeat(taken, n)
            x, owner = x[place], np.repeat(np.arange(len(n), dtype=np.uint32), n)[place]
            order = np.argsort(x, kind="stable")
            x, owner = x[order], owner[order]
            run = runs_of(x)
            length = np.diff(np.r_[run, len(x)])
            shared = np.bincount(owner[np.repeat(length > 1, length)], minlength=len(n)).astype(np.int32)
            x, owner = x[run], np.where(length > 1, MANY, owner[run])
            shard = (x % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            x, owner, shard = x[order], owner[order], shard[order]
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            full = np.flatnonzero(np.diff(cuts))
            ids = piece["k"].to_numpy()
            yield pd.DataFrame({
                "shard": [*full, number % shards], "piece": number,
                "hashes": [*(shrink(x[cuts[s]:cuts[s + 1]]) for s in full), None],
                "owners": [*(pack(owner[cuts[s]:cuts[s + 1]]) for s in full), same],
                "keys": [*[None] * len(full), ids.astype(np.int64).tobytes()],
                "sizes": [*[None] * len(full), n.astype(np.int32).tobytes()],
                "shared": [*[None] * len(full), shared.tobytes()]})
            number += 1

    def count(group: pd.DataFrame) -> pd.DataFrame:
        """For each piece, how many of each document's hashes occur in other pieces; rows of documents pass."""
        passing = group[group["hashes"].isna()].drop(columns=["shard", "hashes"])
        group = group[group["hashes"].notna()]
        if not len(group):
            return passing
        x = [grow(b) for b in group["hashes"]]
        owner = np.concatenate([unpack(b) for b in group["owners"]]).astype(np.uint64)
        source = np.repeat(np.arange(len(x), dtype=np.uint64), [len(v) for v in x])
        x = np.concatenate(x)
        order = np.argsort(x, kind="stable")
        run = runs_of(x[order])
        length = np.diff(np.r_[run, len(x)])
        hit = order[np.repeat(length > 1, length)]
        hit = hit[owner[hit] != np.uint64(MANY)]
        both, times = np.unique((source[hit] << np.uint64(32)) | owner[hit], return_counts=True)
        at = np.searchsorted(both >> np.uint64(32), np.arange(len(group) + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(at))
        low = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        answers = pd.DataFrame({"piece": group["piece"].to_numpy()[full],
                                "owners": [pack(low[at[i]:at[i + 1]]) for i in full], "keys": None, "sizes": None,
                                "shared": [times[at[i]:at[i + 1]].astype(np.int32).tobytes() for i in full]})
        return pd.concat([passing, answers]) if len(passing) else answers

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        docs_row = group[group["keys"].notna()].iloc[0]
        n, total = np.frombuffer(docs_row["sizes"], np.int32).astype(np.int64), np.frombuffer(docs_row["shared"], np.int32).copy()
        for keys, owners, shared in zip(group["keys"], group["owners"], group["shared"]):
            if keys is None:
                total[unpack(owners)] += np.frombuffer(shared, np.int32)
        same = docs_row["owners"]
        return pd.DataFrame({key: np.frombuffer(docs_row["keys"], np.int64), "n": n, "same": [same[i:i + 16] for i in range(0, len(same), 16)],
                             "candidate": ((n > 0) & (total >= 1 + needed(n) // 16)).astype(np.int32)})

    rows = only(docs, key, text).toDF("k", "t").where("k is not null").withColumn("k", F.col("k").cast("long"))
    dealt = rows.mapInPandas(deal, "shard long, piece long, hashes binary, owners binary, keys binary, sizes binary, shared binary")
    counted = dealt.groupBy("shard").applyInPandas(count, "piece long, owners binary, keys binary, sizes binary, shared binary")
    return counted.groupBy("piece").applyInPandas(settle, f"`{key}` long, n long, same binary, candidate int")


def parities(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each set the parity of its number of elements in each hash class, packed in longs."""
    at = np.repeat(np.arange(len(n), dtype=np.int64), n) * BITS + (x >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(n) * BITS) & 1).astype(np.uint8).reshape(len(n), BITS)
    return np.packbits(odd, axis=1).view(np.int64)


def sets_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n, s): each text's set as an array of hashes."""
    def work(texts: list[str]) -> tuple[list, None]:
        x, n = shingle_sets(texts)
        ends = np.r_[0, np.cumsum(n)]
        return [n, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.view(np.int64)))], None

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    return map_texts(rows, ["id"], "t", [("n", "long", pa.int64()), ("s", "array<long>", pa.list_(pa.int64()))], work)


def ranked_sets(sets: DataFrame) -> DataFrame:
    """(id, n, m, r, parities): of each set that may link, how many elements others have too, and the rarest of these as (df, e).

    An element's df is the number of sets that have it, as a power of two; r has all elements among the n - needed + 2 rarest.
    Again only packed arrays travel: each piece asks for its distinct elements and is answered in the same order.
    """
    shards = parts_of(sets.sparkSession)

    def dealt(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct elements by shard, how often they occur, where shards start, and each entry's place."""
        distinct, place, times = np.unique(x, return_inverse=True, return_counts=True)
        shard = (distinct % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return distinct[order], times[order], np.searchsorted(shard[order], np.arange(shards + 1)), back[place]

    def ask(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for batch in held(batches):
            x = np.concatenate([np.asarray(s, np.int64) for s in batch["s"]]).view(np.uint64)
            distinct, times, cuts, _ = dealt(x)
            full = np.flatnonzero(np.diff(cuts))
            yield pd.DataFrame({
                "shard": [*full, number % shards], "piece": number, "x": [*(shrink(distinct[cuts[s]:cuts[s + 1]]) for s in full), x.tobytes()],
                "times": [*(pack(times[cuts[s]:cuts[s + 1]]) for s in full), None],
                "ids": [*[None] * len(full), batch["id"].to_numpy(np.int64).tobytes()], "sizes": [*[None] * len(full), pack(batch["n"].to_numpy())]})
            number += 1

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        passing = group[group["ids"].notna()]
        group = group[group["ids"].isna()]
        if not len(group):
            return passing
        x, times = [grow(b) for b in group["x"]], [unpack(b) for b in group["times"]]
        ends = np.cumsum([len(v) for v in x])
        keys, place = np.unique(np.concatenate(x), return_inverse=True)
        df = np.bincount(place, np.concatenate(times), len(keys)).astype(np.int64)[place]
        return pd.concat([passing, group.assign(x=None, times=[pack(v) for v in np.split(df, ends[:-1])])])

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["ids"].notna()].iloc[0]
        x, n, ids = np.frombuffer(own["x"], np.uint64), unpack(own["sizes"]), np.frombuffer(own["ids"], np.int64)
        df = np.concatenate([unpack(b) for b in group[group["ids"].isna()].sort_values("shard")["times"]])[dealt(x)[3]]
        rows = []
        n = n.astype(np.int64)
        starts, bits = np.cumsum(n) - n, parities(x, n)
        for i, a, size, own_bits in zip(ids.tolist(), starts.tolist(), n.tolist(), bits):
            mine = df[a:a + size]
            shared = np.flatnonzero(mine > 1)
            most = size - (3 * size + 3) // 4 + 2 - (size - len(shared))
            if most < 2:
                continue  # too many elements that no other set has
            level = np.floor(np.log2(mine[shared])).astype(np.int64)
            rare = np.lexsort((x[a:a + size][shared], level))[:most]
            rows.append((i, size, len(shared), level[rare], x[a:a + size][shared][rare].view(np.int64), own_bits))
        return pd.DataFrame({**{c: np.array([r[i] for r in rows], np.int64) for i, c in enumerate(("id", "n", "m"))},
                             "df": pd.Series([r[3] for r in rows], dtype=object), "e": pd.Series([r[4] for r in rows], dtype=object), **{c: np.array([r[5][j] for r in rows], np.int64) for j, c in enumerate(PARITY)}})

    schema = "shard long, piece long, x binary, times binary, ids binary, sizes binary"
    answered = sets.select("id", "n", "s").mapInPandas(ask, schema).groupBy("shard").applyInPandas(answer, schema)
    rows = answered.groupBy("piece").applyInPandas(settle, "id long, n long, m long, df array<long>, e array<long>, " + ", ".join(f"{p} long" for p in PARITY))
    return rows.select("id", "n", "m", F.arrays_zip("df", "e").alias("r"), *PARITY)


def held(batches: Iterable[pd.DataFrame], limit: int = 500_000) -> Iterator[pd.DataFrame]:
    """Rows gathered until their sets have some `limit` elements."""
    own, total = [], 0
    for batch in batches:
        own.append(batch)
        total += int(batch["n"].sum())
        if total >= limit:
            yield pd.concat(own)
            own, total = [], 0
    if total:
        yield pd.concat(own)


def boundary(ranked: DataFrame) -> int:
    """The largest light size, by the counted cost of subsets and of scanned lists for each size up to LIGHT_MOST."""
    k2 = _rarest("2")
    by_size = ranked.groupBy(F.least("n", F.lit(LIGHT_MOST + 1)).alias("size")).agg(
        F.sum(k2 * (k2 - 1) / 2).alias("subsets"),
        F.sum(F.expr(f"aggregate(slice(r, 1, {_RAREST.format(c=1)}), 0D, (a, e) -> a + pow(2, e.df))")).alias("scan"))
    rows = {r["size"]: r for r in by_size.collect()}  # LIGHT_MOST + 1 rows at most
    def cost(b: int) -> float:
        return sum(r["subsets"] * (s <= b) + r["scan"] * (4 * s > 3 * b) for s, r in rows.items())
    return min(range(LIGHT_MOST + 1), key=cost)


#: How many of a set's m shared elements, rarest first, are among its n - needed + c rarest, as those found once come first.
_RAREST = "cast(greatest(0, n - floor((3 * n + 3) / 4) + {c} - (n - m)) as int)"


def _rarest(c: str) -> F.Column:
    return F.least(F.expr(_RAREST.format(c=c)), F.size("r"))


def lists(ranked: DataFrame, light: int) -> DataFrame:
    """(key, prev, id, n, at, kind, c, parities): the subsets of light sets (kind 2) and the single elements of heavy and nearly heavy ones (1, 0).

    at: the place of the (last) element in its set, rarest first. prev: the key of the entry before it in the same set, which
    has one element one place earlier, or null.
    """
    def both(a: str, b: str) -> str:
        return f"xxhash64(least({a}, {b}), greatest({a}, {b}))"
    subset = f"""flatten(transform(sequence(1, greatest(k - 1, 1)), i -> transform(slice(r, i + 1, greatest(k - i, 0)), (e, j) -> struct(
        {both("r[i - 1].e", "e.e")} as key, i + j as at,
        case when j > 0 then {both("r[i - 1].e", "r[i + j - 1].e")} when i > 1 then {both("r[i - 2].e", "e.e")} end as prev))))"""
    single = "transform(slice(r, 1, k), (e, i) -> struct(e.e as key, i as at, if(i > 0, r[i - 1].e, null) as prev))"

    def rows(some: DataFrame, expr: str, kind: F.Column) -> DataFrame:
        return some.select("id", "n", "m", "c", *PARITY, kind.alias("kind"), F.explode(F.expr(expr)).alias("x")).select(
            "x.key", "x.prev", "id", "n", (F.col("n") - F.col("m") + F.col("x.at")).alias("at"), "kind", "c", *PARITY)
    pairs = rows(ranked.where(F.col("n") <= light).withColumn("k", _rarest("2")).where("k > 1"), subset, F.lit(2))
    singles = rows(ranked.where(4 * F.col("n") > 3 * light).withColumn("k", _rarest("1")).where("k > 0"), single, (F.col("n") > light).cast("int"))
    return pairs.unionByName(singles)


#: Sets of a and b elements that link differ in (a + b) / 7 at most; they differ at least where parities do.
MAY_MATCH = "4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) and 7 * (" + " + ".join(f"bit_count(a.{p} ^ b.{p})" for p in PARITY) + ") <= a.n + b.n"
#: Whether members a and b of a list may link: light sets meet in subsets, sizes are near, and enough follows what they share.
MAY_LINK = f"""(a.kind = 2 or a.kind = 1 or b.kind = 1) and {MAY_MATCH}
    and 7 * (if(a.kind = 2, 2, 1) + least(a.n - a.at, b.n - b.at) - 1) >= 3 * (a.n + b.n)"""


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= 75 * union."""
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= 75 * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def first_links(ranked: DataFrame) -> DataFrame:
    """Pairs (a, b) of each set and the hubs of FIRST of its most frequent elements: near copies have most of these in common.

    A set's elements are those with the smallest of several hashes, an element's hub is the set with the smallest one.
    """
    top = "filter(r, e -> e.df = array_max(r.df))"
    keys = F.array_distinct(F.array(*(F.expr(f"array_min(transform({top}, e -> struct(xxhash64(e.e, {j}) as h, e.e as e))).e") for j in range(FIRST))))
    rows = ranked.select("id", "n", *PARITY, F.explode(keys).alias("key"))
    heads = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("h"), F.struct("id", "n", *PARITY).alias("hub"))).alias("x")).select("key", "x.hub.*")
    return rows.alias("a").join(heads.alias("b"), F.expr(f"a.key = b.key and a.id <> b.id and {MAY_MATCH}")).selectExpr(
        "least(a.id, b.id) as a", "greatest(a.id, b.id) as b").distinct()


def owners_of(sets: DataFrame) -> DataFrame:
    """(node, component) of the distinct sets that link with another."""
    ranked = cut(ranked_sets(sets), "ranked")
    owner = cut(components(verified(first_links(ranked), sets), "a", "b"), "owners")
    named = ranked.join(owner, F.col("id") == F.col("node"), "left").select(*ranked.columns, F.coalesce("component", "id").alias("c"))
    named = cut(named, "named", [ranked])
    entries = lists(named, boundary(named)).withColumn("two", F.col("kind") == 2)
    # if all members of a list have the same entry before it, they all meet in that one's list, at an earlier place.
    # lists of the same members are one list: elements of a passage that the same texts share make no work of their own
    often = entries.groupBy("key", "two").agg(
        F.count("*").alias("g"), F.max("kind").alias("heavy"), F.min("c").alias("c0"), F.max("c").alias("c1"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
        F.count("prev").alias("led"), F.min("prev").alias("p0"), F.max("prev").alias("p1")).where("heavy > 0 and c0 < c1 and not (led = g and p0 = p1)")
    entries = entries.join(often.select("key", "two", "g", F.xxhash64("g", "x", "y").alias("list")), ["key", "two"])
    entries = entries.groupBy(F.col("list").alias("key"), "two", "g", "id", "n", "kind", "c").agg(F.min("at").alias("at"), *(F.first(p).alias(p) for p in PARITY))
    entries = cut(entries, "lists", [named])
    if entries.isEmpty():
        return owner
    hubs = 1
    for whole in chain(WHOLE[:1], (WHOLE[1] * 16 ** k for k in count())):
        short, long = entries.where(F.col("g") <= whole), entries.where(F.col("g") > whole)
        pairs = short.alias("a").join(short.alias("b"), F.expr(f"a.key = b.key and a.two = b.two and a.id < b.id and a.c <> b.c and {MAY_LINK}")).selectExpr(
            "a.id as a", "b.id as b")
        # a list's hubs: the members with the smallest of several hashes
        member = F.struct("id", "n", "at", "kind", "c", *PARITY)
        picks = [F.min(F.struct(F.xxhash64("id", F.lit(j)).alias("h"), member.alias("m"))) for j in range(hubs)]
        heads = long.groupBy("key", "two").agg(F.array_distinct(F.array(*(p["m"] for p in picks))).alias("hubs"))
        met = long.join(heads, ["key", "two"])
        hubbed = long.alias("a").join(heads.select("key", "two", F.inline("hubs")).alias("b"), F.expr(
            f"a.key = b.key and a.two = b.two and a.id <> b.id and a.c <> b.c and {MAY_LINK}")).selectExpr("a.id as a", "b.id as b")
        pairs = pairs.unionByName(hubbed.selectExpr("least(a, b) as a", "greatest(a, b) as b")).distinct()
        new = cut(verified(pairs, sets), "verified")
        # components so far are links too: of those before only their outcome counts
        owner = cut(components(new.unionByName(owner.selectExpr("node as a", "component as b")), "a", "b"), "owners", [new, owner])
        rest = met.where(~F.exists("hubs", lambda h: (h["id"] == F.col("id")) & (h["n"] == F.col("n")) & (h["at"] == F.col("at")))).drop("hubs", "c", "g")
        rest = rest.join(owner, F.col("id") == F.col("node"), "left").select(rest["*"], F.coalesce("component", "id").alias("c"))
        left = rest.groupBy("key", "two").agg(F.count("*").alias("g"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1")
        entries = cut(rest.join(left.select("key", "two", "g"), ["key", "two"]), "lists", [entries])
        if entries.isEmpty():
            return owner
        hubs = min(4 * hubs, 32)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row: links are Jaccard similarities of at least 0.75, none is lost.

    Null and empty texts have no shingles and link with nothing. Rows with a null key have null in both columns. Rows that
    share a key give one row each and one component. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    sizes = cut(possible(docs, key, text), "possible")
    copies = sizes.where("n > 0").groupBy("same").agg(F.min(key).alias("first"), F.max("candidate").alias("candidate"), F.count("*").alias("copies"))
    copies = cut(copies, "copies")
    # one text for each set, that of the first copy
    chosen = docs.join(copies.where("candidate > 0").select(F.col("first").alias(key)), key, "left_semi")
    # a runtime filter of bounded size keeps most texts that cannot link out of the exchange
    least = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    usual = spark.conf.get(least)
    spark.conf.set(least, "1MB")
    heads = cut(sets_of(chosen, key, text), "heads")
    spark.conf.set(least, usual)
    owner = owners_of(heads)
    # a class has the id of its first copy
    first = sizes.join(copies.where("copies > 1").select("same", "first"), "same", "left").select(key, "n", F.when(F.col("n") > 0, F.coalesce("first", key)).alias("first"))
    if not sizes.groupBy(key).count().where("count > 1").isEmpty():
        # ids with several texts join the components of these
        links = owner.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(first.where("first is not null").select(F.col(key).alias("a"), F.col("first").alias("b")))
        owner, first = components(links, "a", "b"), first.withColumn("first", F.col(key))
    found = first.join(owner, F.col("first") == F.col("node"), "left")
    nulls = docs.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias(key), F.lit(None).cast("long").alias("n_shingles"),
                                                   F.lit(None).cast("long").alias("component_id"))
    return found.select(key, F.col("n").alias("n_shingles"), F.coalesce("component", "first", key).alias("component_id")).unionByName(nulls)
