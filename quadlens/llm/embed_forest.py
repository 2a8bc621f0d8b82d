"""Near copies among embeddings by a forest of random-projection trees with overlapping halves.

Vectors are compared only with those of their label. Each tree splits a group at a random quantile of a random projection;
vectors near the cut go to both sides, so close neighbours seldom part, and hardly ever in all trees. Splitting runs in
rounds: a bounded sample of each large group fits the cuts of several levels, all rows descend them, until every group is
a leaf. Leaves are compared in whole in double precision; a pair counts in the first leaf that it shares, so no pairs need
to be gathered. Equal vectors count as one with a weight. A group that no projection can split, or of whose pairs a fair
share are links (cuts would part them), is compared exactly, dealt out in pairs of blocks: that takes at most 1 / DENSE
comparisons for each link. Where that holds for all vectors of a label, one tree does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlens.llm.common import only, runs_of
from quadlens.llm.components import components
from quadlens.session import cut

LIMIT = 0.93
TREES, LEAF, SAMPLE, LEVELS, SPILL = 8, 500, 1_500, 5, 0.08
DENSE = 0.05  # share of links among a group's pairs from which it is not split
BLOCK, STEP = 4_096, 512  # rows of a block, and of it that are compared at a time
SEED = 20
HELD = 20_000  # rows that a task routes at a time


def matrix(blobs: Iterable[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float32).reshape(-1, dim).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))  # squares of floats neither overflow nor vanish in double


def packed(rows: DataFrame) -> DataFrame:
    """vec_id, label, v (32-bit floats as bytes, null where the vector links with nothing), dim."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            at = np.asarray(column.offsets, np.int64)
            values = column.values.to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)  # no -0.0; null is NaN
            bad, filled = np.r_[0, np.cumsum(~np.isfinite(values))], np.r_[0, np.cumsum(values != 0)]
            sound = (bad[at[1:]] == bad[at[:-1]]) & (filled[at[1:]] > filled[at[:-1]]) & ~np.asarray(column.is_null()) & ~np.asarray(batch.column(1).is_null())
            blobs = [values[a:b].tobytes() if ok else None for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), sound.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary()), pa.array(np.diff(at).astype(np.int32))],
                                             names=["vec_id", "label", "v", "dim"])
    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, v binary, dim int")


def directions(tree: int, node: int, dim: int, count: int) -> np.ndarray:
    """Random directions of the places below a node; every task draws the same."""
    return np.random.default_rng([SEED, tree, node & 0xFFFFFFFF, (node >> 32) & 0xFFFFFFFF]).normal(size=(count, dim))


def dense(x: np.ndarray, limit: float) -> bool:
    """Whether a fair share of the pairs of unit vectors are links."""
    n = len(x)
    return int((x @ x.T >= limit).sum()) - n >= DENSE * n * (n - 1)


def fit_cuts(x: np.ndarray, tree: int, node: int, levels: int, limit: float = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a binary heap of `levels` levels: from where on right, up to where left. NaN: not split."""
    count = (1 << levels) - 1
    d = directions(tree, node, x.shape[1], count)
    low, high = np.full(count, np.nan), np.full(count, np.nan)
    rng = np.random.default_rng([SEED + 1, tree, node & 0xFFFFFFFF, (node >> 32) & 0xFFFFFFFF])
    members = {0: np.arange(len(x))}
    for place in range(count):
        share = rng.uniform(0.42, 0.58)
        own = members.pop(place, None)
        if own is None or len(own) < 24 or dense(x[own], limit):
            continue
        p = x[own] @ d[place]
        a, b = np.quantile(p, [share - SPILL, share + SPILL])
        left, right = p <= b, p >= a
        if max(left.sum(), right.sum()) > 0.85 * len(own):
            continue  # it would hardly get smaller
        low[place], high[place] = a, b
        if 2 * place + 2 < count:
            members[2 * place + 1], members[2 * place + 2] = own[left], own[right]
    return low, high


def route(x: np.ndarray, tree: int, node: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and the places they end in; rows near a cut have several."""
    count = len(low)
    p = x @ directions(tree, node, x.shape[1], count).T
    rows, places = [], []
    at = [(0, np.arange(len(x)))]
    while at:
        place, own = at.pop()
        if place >= count or np.isnan(low[place]):
            rows.append(own)
            places.append(np.full(len(own), place))
            continue
        v = p[own, place]
        at.append((2 * place + 1, own[v <= high[place]]))
        at.append((2 * place + 2, own[v >= low[place]]))
    return np.concatenate(rows), np.concatenate(places)


GROUP = ["tree", "label", "dim", "node"]
STATE = [*GROUP, "id", "w", "v", "done"]


def leaves(vectors: DataFrame, trees: int = TREES, leaf: int = LEAF, limit: float = LIMIT) -> DataFrame:
    """(tree, label, dim, node, id, w, v, done): each vector once for each leaf that it lies in."""
    state = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "label", "dim", F.lit(1).cast("long").alias("node"),
                           "id", "w", "v", F.lit(False).alias("done")).select(*STATE)
    label, key = (vectors.schema[c].dataType.simpleString() for c in ("label", "id"))
    row = f"tree int, label {label}, dim int, node long, id {key}, w long, v binary, done boolean"  # as STATE
    first_round = True
    while True:
        sizes = state.where("not done").groupBy(*GROUP).agg(F.count("*").alias("n"))
        large = cut(sizes.where(F.col("n") > leaf), "large")
        if large.isEmpty():
            return state

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            first = group.iloc[0]
            levels = int(min(LEVELS, max(1, np.ceil(np.log2(first["n"] / leaf) * 1.25))))
            low, high = fit_cuts(unit(matrix(group["v"], int(first["dim"]))), int(first["tree"]), int(first["node"]), levels, limit)
            return pd.DataFrame([{**{c: first[c] for c in GROUP}, "low": low, "high": high}])

        sample = state.where("not done").join(large, GROUP).where(
            F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("n") / SAMPLE)) == 0)
        cuts = cut(sample.groupBy(*GROUP).applyInPandas(fit, f"tree int, label {label}, dim int, node long, low array<double>, high array<double>"), "cuts")

        if first_round and trees > 1:  # where the first tree's root is compared in whole, the other trees add nothing
            whole = cuts.where("tree = 0 and coalesce(isnan(low[0]), true)").select(F.explode(F.sequence(F.lit(1), F.lit(trees - 1))).alias("tree"), "label", "dim")
            state = state.join(whole, ["tree", "label", "dim"], "left_anti").select(*STATE)
        first_round = False

        def descend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in held(batches):
                names = [pd.factorize(table.column(c).to_pandas())[0].astype(np.int64) for c in GROUP]
                code = np.zeros(len(table), np.int64)
                for n in names:
                    code = pd.factorize(code * (n.max() + 1) + n)[0]
                order = np.argsort(code, kind="stable")
                starts = runs_of(code[order])
                tree, node, dim, done = (table.column(c).to_numpy() for c in ("tree", "node", "dim", "done"))
                took, nodes, ended = [], [], []
                for own in np.split(order, starts[1:]):
                    first = int(own[0])
                    low = table.column("low")[first].as_py()
                    if low is None:
                        took.append(own)
                        nodes.append(node[own])
                        ended.append(done[own])
                        continue
                    low, high = np.array(low, float), np.array(table.column("high")[first].as_py(), float)  # null is NaN
                    x = unit(matrix(table.column("v").take(pa.array(own)).to_pylist(), int(dim[first])))
                    rows, places = route(x, int(tree[first]), int(node[first]), low, high)
                    took.append(own[rows])
                    nodes.append(node[first] * (1 << (LEVELS + 1)) + places + 1)
                    ended.append(np.full(len(rows), bool(np.isnan(low[0]))))  # no projection splits it
                out = table.select(STATE).take(pa.array(np.concatenate(took)))
                for name, values in (("node", np.concatenate(nodes)), ("done", np.concatenate(ended))):
                    out = out.set_column(out.schema.get_field_index(name), name, pa.array(values))
                yield from out.to_batches()

        state = cut(state.join(cuts, GROUP, "left").select(*STATE, "low", "high").mapInArrow(descend, row), "forest")


def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of some HELD rows, so that groups are not met in small pieces."""
    own, n = [], 0
    for batch in batches:
        own.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield pa.Table.from_batches(own).combine_chunks()
            own, n = [], 0
    if n:
        yield pa.Table.from_batches(own).combine_chunks()


def compare(members: pd.DataFrame, limit: float) -> pd.DataFrame:
    """For each vector of a leaf (or of two blocks of one): weight of its links not counted before, and one link that joins it."""
    ids, w, block = members["id"].to_numpy(), members["w"].to_numpy(np.int64), members["block"].to_numpy()
    x = matrix(members["v"], len(members["v"].iloc[0]) // 4)
    norm = np.sqrt((x * x).sum(1))
    bi, bj = members["bi"].iloc[0], members["bj"].iloc[0]
    left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    steps = [slice(a, a + STEP) for a in range(0, len(left), STEP)]
    link = np.empty((len(left), len(right)), bool)
    for s in steps:
        link[s] = (x[left[s]] @ x[right].T) / np.outer(norm[left[s]], norm[right]) >= limit
    if bi == bj:
        np.fill_diagonal(link, False)
    fresh = link.copy()
    key = members["key"].iloc[0]
    earlier: dict[int, tuple[list[int], list[int]]] = {}
    for side, own in enumerate((left, right)):
        for i, keys in enumerate(members["keys"].iloc[own]):
            for k in keys:
                if k < key:
                    earlier.setdefault(k, ([], []))[side].append(i)
    for a, b in earlier.values():
        if a and b:
            fresh[np.ix_(a, b)] = False
    links = np.zeros(len(ids), np.int64)
    for s in steps:
        links[left[s]] += (fresh[s] * w[right][None]).sum(1)
        if bi != bj:
            links[right] += (fresh[s] * w[left[s]][:, None]).sum(0)
    low, far = ids.copy(), np.iinfo(np.int64).max
    while True:  # smallest id that links reach within the leaf
        new = low.copy()
        for s in steps:
            new[left[s]] = np.minimum(new[left[s]], np.where(link[s], low[right][None], far).min(1, initial=far))
            if bi != bj:
                new[right] = np.minimum(new[right], np.where(link[s], low[left[s]][:, None], far).min(0, initial=far))
        if (new == low).all():
            break
        low = new
    keep = np.zeros(len(ids), bool)
    keep[left] |= link.any(1)
    keep[right] |= link.any(0)
    return pd.DataFrame({"id": ids[keep], "links": links[keep], "to": low[keep]})


def near_copies(df: DataFrame, limit: float = LIMIT, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vec_id: links are cosines of at least `limit` under equal labels.

    Null labels, null or empty vectors, null or non-finite components and zero vectors link with nothing; vectors of other
    length neither. A row whose vec_id is null is left out; of an id given several times the smallest label and vector count.
    Which links are found depends on the forest; recall is measured in the tests.
    """
    rows = only(df, "vec_id", "embedding", "label").where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x")) \
        .select(F.col("vec_id").cast("long").alias("vec_id"), "x.label", F.col("x.embedding").cast("array<float>").alias("v"))
    rows = cut(packed(rows), "vectors")
    classes = cut(rows.where("v is not null").groupBy("label", "dim", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")), "classes")
    state = leaves(classes, trees, leaf, limit).withColumn("key", F.xxhash64(*GROUP))
    keys = state.groupBy("id").agg(F.collect_set("key").alias("keys"))  # as many as the vector has leaves
    blocks = state.groupBy("key").agg(F.ceil(F.count("*") / max(2 * leaf, block)).cast("int").alias("blocks"))  # 1 but for what is not split
    placed = state.join(keys, "id").join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("key", "keys", "id", "w", "v", "block", other).select(
        "*", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    found = placed.groupBy("key", "bi", "bj").applyInPandas(lambda m: compare(m, limit), "id long, links long, to long")
    found = cut(found, "links")
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.select("id", "to"), "id", "to")
    of_class = classes.join(counted, "id", "left").join(joined, F.col("id") == F.col("node"), "left").select(
        "label", "v", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(of_class, ["label", "v"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
