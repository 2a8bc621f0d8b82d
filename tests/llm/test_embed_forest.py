import numpy as np

from quadlens.llm import embed_forest as ef

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, labels):
    x = np.asarray(x, np.float32).astype(float)
    cosine = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    link = (cosine >= ef.LIMIT) & (labels[:, None] == labels[None])
    np.fill_diagonal(link, False)
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(link, low[None], 1 << 60).min(1))
        if (new == low).all():
            return link.sum(1), low
        low = new


def test_recall_on_groups_of_copies(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(120, 32))
    sizes = [300, 60, *rng.integers(1, 6, 118)]
    x = np.concatenate([c + rng.normal(0, 0.12, (n, 32)) for c, n in zip(centres, sizes)])
    labels, ids = rng.integers(0, 2, len(x)), rng.permutation(len(x)) * 7
    df = spark.createDataFrame([(int(i), [float(e) for e in v], int(c)) for i, v, c in zip(ids, x, labels)], SCHEMA)
    got = {r["vec_id"]: r for r in ef.near_copies(df, trees=8, leaf=100).collect()}
    want, component = brute(ids, x, labels)
    found = np.array([got[i]["n_links"] for i in ids])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum()
    assert np.mean([got[i]["component_id"] == c for i, c in zip(ids, component)]) > 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_recall_on_a_large_group_of_distinct_near_copies(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=32) + rng.normal(0, 0.15, (5000, 32)), rng.normal(size=(5000, 32))])
    labels, ids = np.ones(len(x), int), rng.permutation(len(x)) * 3
    df = spark.createDataFrame([(int(i), [float(e) for e in v], int(c)) for i, v, c in zip(ids, x, labels)], SCHEMA)
    got = {r["vec_id"]: r for r in ef.near_copies(df).collect()}
    want, component = brute(ids, x, labels)
    assert want.max() > 4000
    assert [got[i]["n_links"] for i in ids] == want.tolist()
    assert [got[i]["component_id"] for i in ids] == component.tolist()


def test_equal_and_collinear_vectors_that_no_projection_splits(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(50)] + [(100 + i, [(i + 1) * 1.0, (i + 1) * 2.0, (i + 1) * 3.0], 1) for i in range(60)]
    got = ef.near_copies(spark.createDataFrame(rows, SCHEMA), trees=3, leaf=10).collect()
    assert {r["component_id"] for r in got} == {0} and {r["n_links"] for r in got} == {109}


def test_what_links_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, nan], 1), (7, [1.0, inf], 1),
            (8, [1.0, None], 1), (9, [1.0, 0.0], 2), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", id int, node string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ef.near_copies(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False)} | {i: (0, i, True) for i in range(3, 12)}
    assert ef.near_copies(df.limit(0)).count() == 0
