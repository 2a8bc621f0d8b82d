import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_each_stage_takes_effect_on_what_the_last_one_kept(spark):
    from quadlens.llm.common import read
    from quadlens.llm import bpe_trie, size_aware_join, tiling
    from quadlens.session import cut
    docs = read(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "tokens":
            assert docs.columns == columns and docs.dtypes == before.dtypes
            assert {r[0] for r in docs.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    groups = size_aware_join.jaccard_components(kept["near_duplicates"]).where("doc_id <> component_id")
    assert groups.count() == 0
    assert tiling.contaminated(kept["decontamination"], read(spark, SF, "benchmark")).count() == 0
    assert kept["personal_data"].where("text rlike '[a-z0-9]+@[a-z0-9]+[.][a-z]'").count() == 0
    assert kept["personal_data"].where("n_chars <> length(text)").count() == 0
    want = {tuple(r) for r in bpe_trie.digests(bpe_trie.encode_decode(kept["personal_data"])).collect()}
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in kept["tokens"].collect()} == want


def test_no_rows(spark):
    from quadlens.llm.common import read
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
