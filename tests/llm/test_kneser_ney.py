import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quadlens.llm import kneser_ney as kn
from quadlens.llm.common import words


def brute(rows):
    """Scores by dictionaries, from the published formulas."""
    c, b = Counter(), Counter()
    texts = [(train, [*words(t or ""), "END"]) for _, t, train in rows]
    for train, w in texts:
        if train:
            c.update(w)
            b.update(zip(["START", *w[:-1]], w))
    total, v = sum(c.values()), len(c)
    context, follows = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (first, second), n in b.items():
        context[first][0] += n
        context[first][min(n, 3)] += 1
        follows[second] += 1
    of, ff = Counter(b.values()), Counter(follows.values())
    off, low = kn.discounts([of[i] for i in (1, 2, 3, 4)]), kn.discounts([ff[i] for i in (1, 2, 3, 4)])
    rest = (low[1] * ff[1] + low[2] * ff[2] + low[3] * (len(follows) - ff[1] - ff[2])) / len(b) if b else 1.0

    def p(first, second):
        lower = (max(follows[second] - low[min(follows[second], 3)], 0) / len(b) if b else 0) + rest / (v + 1)
        if first not in context:
            return lower
        x, n = context[first], b[first, second]
        return max(n - off[min(n, 3)], 0) / x[0] + sum(off[i] * x[i] for i in (1, 2, 3)) / x[0] * lower
    out = []
    for train, w in texts:
        out.append((not train, len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 0.1) / (total + 0.1 * (v + 1))) for x in w),
                    sum(math.log10(p(a, x)) for a, x in zip(["START", *w[:-1]], w))))
    if b:
        assert sum(p("w1", x) for x in c) + p("w1", "unseen") == pytest.approx(1)
    return out


def compared(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, learn boolean, piece int").repartition(partitions)
    got = kn.score(df, F.col("learn"), "doc_id").collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:4]))
    want = sorted(((r[0], *b) for r, b in zip(rows, brute(rows))), key=key)
    for g, w in zip(sorted(map(tuple, got), key=key), want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6])


def test_scores_as_by_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(kn, "PIECE", 400)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.3)), 60)}" for _ in range(rng.randrange(0, 60))), rng.random() < 0.8) for i in range(150)]
    rows += [(2 ** 60 + 1, None, True), (2 ** 60 + 3, "", False), (None, "W1 w1", False), (7, "the " * 3000, True), (7, "the " * 3000, True)]
    compared(spark, rows)


def test_without_training_rows_and_without_rows(spark):
    compared(spark, [(1, "a b", False), (2, None, False)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert kn.score(empty, F.lit(True)).count() == 0


def test_messages_follow_the_size_of_the_texts_not_the_number_of_partitions(spark, monkeypatch):
    kept, cut = {}, kn.cut
    monkeypatch.setattr(kn, "cut", lambda df, name: kept.setdefault(name, cut(df, name)))
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        compared(spark, [(i, f"a b w{i} w{i % 7}", True) for i in range(200)], 10)
        assert kept["pairs"].where("kind = 'pairs'").count() <= 10 * kn.LEAST and kept["pairs"].where("kind = 'before'").count() <= kn.LEAST ** 2
        monkeypatch.setattr(kn, "PART", 100)
        docs = kept["pieces"].select(F.lit("x" * 50).alias("text"))
        assert kn.parts_for(docs.limit(1), "text") == kn.LEAST and kn.parts_for(docs.unionByName(docs).unionByName(docs), "text") == 15
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


def test_exchange_files_go_when_a_table_is_written(spark, tmp_path):
    from quadlens.llm.common import read
    spark.range(2000).selectExpr("id as doc_id", "concat('w', id) as text").write.parquet(f"{tmp_path}/documents.parquet")
    docs, files = read(spark, str(tmp_path), "documents"), spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def exchanged():
        return {f for f in files.getAllFiles().mkString(" ").split() if "shuffle_" in f}
    before = exchanged()
    kn.cut(docs.groupBy("text").count(), "counted")
    assert not exchanged() - before


def test_packing_round_trips():
    import numpy as np
    x = np.array([0, 1, 255, 256, 70_000, 2 ** 32 - 1])
    assert (kn.unpack(kn.pack(x)) == x).all() and len(kn.unpack(kn.pack(x[:0]))) == 0
