import random
from collections import defaultdict

import pytest

from quadlens.llm import size_aware_join as saj
from quadlens.llm.common import words


def brute(rows):
    sets = defaultdict(list)
    for key, text in rows:
        w = words(text or "")
        sets[key].append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    items = [(k, s) for k, ss in sets.items() for s in ss if s]
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if min(len(x), len(y)) * 4 >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                a_, b_ = root(a), root(b)
                parent[max(a_, b_)] = min(a_, b_)
    return sorted((k, len(s), root(k)) for k, ss in sets.items() for s in ss)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    hot = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for family in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 9, 12, 20, 40, 90]))]
        if family % 4 == 0:
            base += hot
        for _ in range(rng.choice([1, 1, 2, 5, 14])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                text += [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 6]))]
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("whole", [(8, 1024), (2, 3)])
def test_components_as_by_brute_force(spark, monkeypatch, whole):
    monkeypatch.setattr(saj, "WHOLE", whole)
    rows = corpus(5) + [(5000, None), (5001, ""), (5002, "one"), (5003, "ONE"), (5002, "one two"), (5000, None), (6000, "x y " * 3000), (6001, "x y " * 3000)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n string")
    got = sorted(tuple(r) for r in saj.jaccard_components(df).collect())
    assert got == brute(rows)


def test_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, saj.jaccard_components(df).collect()), key=str) == [(1, 2, 1), (None, None, None)]
    assert saj.jaccard_components(df.limit(0)).count() == 0


def test_the_boundary_follows_the_cost(spark):
    rows = [(i, n, n, [(1, i * 100 + j) for j in range(n)]) for i, n in enumerate([8] * 5 + [60] * 5)]
    schema = "id long, n long, m long, r array<struct<df: long, e: long>>"
    ranked = spark.createDataFrame(rows, schema)
    assert 0 <= saj.boundary(ranked) <= saj.LIGHT_MOST
    dear = spark.createDataFrame([(i, n, m, [(13, e) for _, e in r]) for i, n, m, r in rows], schema)
    assert saj.boundary(dear) >= saj.boundary(ranked)


def test_pieces_without_a_possible_link(spark):
    rows = [(i, [i * 1000 + k for k in range(20)]) for i in range(40)]
    sets = spark.createDataFrame(rows, "id long, s array<long>").selectExpr("id", "20L as n", "s").repartition(5)
    assert saj.ranked_sets(sets).count() == 0
