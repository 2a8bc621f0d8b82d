import numpy as np
import pytest

from quadlens.llm.components import components, forest
from quadlens.llm.size_aware_join import BITS, parities


def smallest_reached(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [] if start in out else [start]
        while todo:
            i = todo.pop()
            if i not in out:
                out[i] = start
                todo += near[i]
    return out


CHAIN = [(i, i + 1) for i in range(300)]
RANDOM = [tuple(map(int, p)) for p in np.random.default_rng(5).integers(1000, 1900, (700, 2)) if p[0] != p[1]]
STAR = [(5000, 5001 + i) for i in range(200)]


def test_forest_of_chain_and_random_links():
    for links in (CHAIN, CHAIN[::-1], RANDOM, STAR):
        u, v = forest(*(np.array(side, np.int64) for side in zip(*links)))
        right = {k: c for k, c in smallest_reached(links).items() if k != c}
        assert dict(zip(u.tolist(), v.tolist())) == right
    assert [len(x) for x in forest(np.empty(0, np.int64), np.empty(0, np.int64))] == [0, 0]


@pytest.mark.parametrize("most", [1_000_000, 90])
def test_components_in_one_task_and_by_stars(spark, most):
    links = [*CHAIN, *RANDOM, *STAR, *STAR[:9], (7, 7), (9000, 9000)]
    found = components(spark.createDataFrame(links, "a long, b long").repartition(6), "a", "b", most).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["component"] for r in found} == smallest_reached([p for p in links if p[0] != p[1]])


def test_parities_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    for n in (1, 40, 2000):
        x = rng.integers(0, 2**64, n, np.uint64)
        other = np.r_[x[n // 4:], rng.integers(0, 2**64, n // 3, np.uint64)]
        a, b = parities(np.r_[x, other], np.array([len(x), len(other)]))
        assert a.shape == (BITS // 64,)
        assert sum(int(v).bit_count() for v in (a ^ b).view(np.uint64)) <= n // 4 + n // 3
    assert not parities(np.empty(0, np.uint64), np.array([0])).any()
