import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quadlens.llm import shard_tree as st


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    rows = st.place(df).collect()
    assert len(rows) == 20_000 and {r["law"] for r in rows} == {"key"}
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows)
    counts, moved = Counter(r["shard"] for r in rows), sum(r["grown_shard"] == 40 for r in rows)
    assert set(counts) == set(range(40)) and min(counts.values()) > 380 and max(counts.values()) < 620 and 380 < moved < 620
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        text = f"t{r['doc_id']}".encode()
        assert r["size"] == len(text) + 16 and r["text_crc32"] == zlib.crc32(text)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_a_grown_weight_moves_rows_only_into_its_subtrees(spark):
    before = st.regular_tree(16)
    region = before.children[0]
    rack = region.children[1]
    heavier = st.inner(rack.name, [st.Node("shard4", 3.0, shard=4), *rack.children[1:]])
    after = st.inner("root", [st.inner(region.name, [region.children[0], heavier]), before.children[1]])
    df = st.with_shards(spark.range(8_000).withColumnRenamed("id", "doc_id"), "doc_id", {"a": before, "b": after})
    moved = df.where("a <> b").groupBy("a", "b").count().collect()
    assert moved
    for r in moved:
        old, new = divmod(r["a"], 4), divmod(r["b"], 4)
        assert new[0] < 2  # never into the region that stayed
        if old[0] < 2:
            assert new[0] == 1  # inside the grown region only into the grown rack
        if old[0] == 1:
            assert r["b"] == 4  # inside the grown rack only into the grown shard


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None, 1), (None, "", 1), (7, "é", 1), (7, "é", 1), (8, "x" * 100_000, 1)], "doc_id long, text string, shard int")
    rows = st.place(df).collect()
    assert sorted(r["size"] for r in rows) == [16, 16, 18, 18, 100_016]
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert len({r["shard"] for r in by_id[None]}) == 1 and len({(r["shard"], r["slot"]) for r in by_id[7]}) == 2
    assert st.place(df.limit(0)).count() == 0
