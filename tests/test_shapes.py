import itertools
import json
import random
import time

from quadlens.functions.canonical import canonical_form


def brute(structure):
    data = json.loads(structure)
    g, e, n = data["g"], data["e"], len(data["g"])
    return min(json.dumps([[g[p.index(i)] for i in range(n)], sorted([p[a], p[b], x] for a, b, x in e)])
               for p in (list(q) for q in itertools.permutations(range(n))))


def test_canonical_form_equals_brute_force_on_random_graphs():
    rng = random.Random(5)
    by_canon, by_brute = {}, {}
    for _ in range(600):
        n = rng.randint(1, 5)
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 6))})
        s = json.dumps({"g": [rng.choice("VE") for _ in range(n)], "e": [[a, b, rng.choice("pq")] for a, b in edges]})
        c, b = canonical_form(s), (n, brute(s))
        assert by_canon.setdefault(c, b) == b
        assert by_brute.setdefault(b, c) == c


def test_canonical_form_equals_brute_force_with_loops_and_repeated_links():
    rng = random.Random(1)
    by_canon, by_brute = {}, {}
    for _ in range(800):
        n = rng.randint(2, 5)
        s = json.dumps({"g": ["V"] * n, "e": [[rng.randrange(n), rng.randrange(n), "p"] for _ in range(rng.randint(1, 8))]})
        c, b = canonical_form(s), (n, brute(s))
        assert by_canon.setdefault(c, b) == b
        assert by_brute.setdefault(b, c) == c


def renamed(structure, rng):
    n = len(structure["g"])
    p = rng.sample(range(n), n)
    edges = [[p[a], p[b], x] for a, b, x in structure["e"]]
    return {"g": [structure["g"][p.index(i)] for i in range(n)], "e": rng.sample(edges, len(edges))}


def test_equal_branches_cost_no_search():
    triangles = {"g": ["V"] * 21, "e": [e for i in range(1, 21, 2) for e in ([0, i, "p"], [i, i + 1, "p"], [i + 1, 0, "p"])]}
    whole = {"g": ["V"] * 9, "e": [[i, j, "p"] for i in range(9) for j in range(9) if i != j]}
    cube = {"g": ["V"] * 16, "e": [[i, i | 1 << k, "p"] for i in range(16) for k in range(4) if not i >> k & 1]}
    rng = random.Random(2)
    for x in (triangles, whole, cube):
        start = time.perf_counter()
        form = canonical_form(json.dumps(x))
        assert time.perf_counter() - start < 1  # some hundredths; a search without pruning takes minutes
        assert all(canonical_form(json.dumps(renamed(x, rng))) == form for _ in range(3))


def test_symmetric_graphs_stay_cheap():
    star = {"g": ["V"] * 41, "e": [[0, i, "p"] for i in range(1, 41)]}
    spider = {"g": ["V"] * 41, "e": [[0, i, "p"] for i in range(1, 21)] + [[i, i + 20, "p"] for i in range(1, 21)]}
    fan = {"g": ["V"] * 22, "e": [[0, i, "p"] for i in range(2, 22)] + [[i, 1, "p"] for i in range(2, 22)]}
    ring = {"g": ["V"] * 24, "e": [[i, (i + 1) % 24, "p"] for i in range(24)]}
    assert len({canonical_form(json.dumps(x)) for x in (star, spider, fan, ring)}) == 4


def test_six_ring_is_not_two_triangles():
    ring = {"g": ["V"] * 6, "e": [[i, (i + 1) % 6, "p"] for i in range(6)]}
    pair = {"g": ["V"] * 6, "e": [[i, (i + 1) % 3, "p"] for i in range(3)] + [[3 + i, 3 + (i + 1) % 3, "p"] for i in range(3)]}
    assert canonical_form(json.dumps(ring)) != canonical_form(json.dumps(pair))
