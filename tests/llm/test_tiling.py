import random

import numpy as np

from quadlens.llm import tiling


def greedy(item, doc, least):
    """Tokens covered by always taking a longest match of unused tokens."""
    free_item, free_doc, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best, at = least - 1, None
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and free_item[a + n] and free_doc[b + n]:
                    n += 1
                if n > best:
                    best, at = n, (a, b)
        if at is None:
            return total
        for k in range(best):
            free_item[at[0] + k] = free_doc[at[1] + k] = False
        total += best


def test_tiles_do_not_overlap_and_cover_what_greedy_covers():
    rng = random.Random(2)
    for _ in range(60):
        item = [rng.randrange(40) for _ in range(rng.randrange(5, 40))]
        doc = [rng.randrange(40) for _ in range(10)]
        for _ in range(4):
            a = rng.randrange(len(item))
            doc += item[a:a + rng.randrange(3, 20)] + [rng.randrange(40)]
        tiles = tiling.tile(np.array(item, np.uint64), np.array(doc, np.uint64), 3)
        for a, b, n in tiles:
            assert item[a:a + n] == doc[b:b + n] and n >= 3
        assert len({i for a, _, n in tiles for i in range(a, a + n)}) == sum(n for *_, n in tiles) == len({i for _, b, n in tiles for i in range(b, b + n)})
        assert abs(sum(n for *_, n in tiles) - greedy(item, doc, 3)) <= 4  # of equal matches another may be taken


def test_whole_edited_and_reordered_passages(spark):
    passage = [f"word{i}" for i in range(40)]
    text = {1: " ".join(["x"] * 500 + passage + ["y"] * 500), 2: " ".join(passage[20:] + ["other"] * 30 + passage[:20]).upper() + ".",
            3: " ".join(passage[:15]), 4: "nothing of the kind", 5: None, 6: "", 7: " ".join("zz" if i % 3 == 0 else w for i, w in enumerate(passage)),
            8: " ".join(f"{w}, |" for w in passage)}
    docs = spark.createDataFrame([(k, v, "n") for k, v in text.items()] + [(None, text[1], "n"), (1, text[1], "n")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(2 ** 60 + 1, " ".join(passage), 1), (11, None, 1), (12, "", 1), (13, "tiny item", 1)], "item_id long, text string, doc_id int")
    got = sorted(((r["doc_id"], r["item_id"], r["tiles"], r["coverage"]) for r in tiling.contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(1, 2 ** 60 + 1, 1, 1.0)] * 2 + [(None, 2 ** 60 + 1, 1, 1.0), (2, 2 ** 60 + 1, 2, 1.0), (8, 2 ** 60 + 1, 1, 1.0)], key=str)
    assert sorted(r["doc_id"] for r in tiling.clean(docs, bench).collect()) == [3, 4, 5, 6, 7]
    assert tiling.clean(docs, bench).columns == docs.columns


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(30)], "doc_id long, text string")
    bench = docs.withColumnRenamed("doc_id", "item_id").where("item_id % 3 = 0")
    monkeypatch.setattr(tiling.blocks, "__defaults__", (60,))
    assert sorted((r["doc_id"], r["item_id"]) for r in tiling.contaminated(docs, bench).collect()) == [(i, i) for i in range(0, 30, 3)]
    assert tiling.clean(docs, bench).count() == 20
    assert tiling.contaminated(docs.limit(0), bench).count() == 0 and tiling.contaminated(docs, bench.limit(0)).count() == 0
