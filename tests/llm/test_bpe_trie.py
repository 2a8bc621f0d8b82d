import numpy as np
import pytest
from pyspark.sql import functions as F

from quadlens.llm import bpe_trie

tokenizers = pytest.importorskip("tokenizers")

TEXTS = ["", " ", "Don't stop, I'll  go\n\nnow ", "a" * 3000, " " * 500 + "x", "aaaa aaa aaaaaaa", "ab" * 999, "éüß 中文字 ٣ x²½",
         "one<|endoftext|>two <|endoftext|>", "\x1c\x85\xa0 tab\tend", "the the the", "😀 smile ‍ zero", "x​y"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe_trie.default_vocabulary())


def test_every_text_is_encoded_and_decoded_as_by_the_library(spark, library):
    rng = np.random.default_rng(1)
    letters = list("abcdefgh   thein'sd \n\t\réüß中٣,.!?") + ["<|endoftext|>"]
    texts = TEXTS + ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe_trie.encode_decode(df).collect():
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert list(np.frombuffer(bytes(r["ids"]), "<u4")) == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_long_texts_are_encoded_in_parts(spark, library, monkeypatch):
    trie = bpe_trie.Trie(bpe_trie.default_vocabulary())
    text = "some words, and more of them! " * 300
    monkeypatch.setattr(bpe_trie, "HELD_CHARS", 1000)
    monkeypatch.setattr(bpe_trie, "CACHED_WORDS", 3)
    ids, back = trie.encode_decode(trie.parts(text))
    assert list(np.frombuffer(ids, "<u4")) == library.encode(text, add_special_tokens=False).ids and back == text


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None, "x", 1), (2 ** 60 + 1, "a b", "y", 2), (2 ** 60 + 1, "a b", "y", 2)],
                               "doc_id long, text string, ids string, decoded int")
    rows = bpe_trie.digests(bpe_trie.encode_decode(df)).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [None, 2 ** 60 + 1, 2 ** 60 + 1] and [r["n_tokens"] for r in rows] == [0, 2, 2]
    assert rows[0]["ids_sha256"] == rows[0]["decoded_sha256"] == df.select(F.sha2(F.lit(""), 256)).first()[0]
    assert bpe_trie.encode_decode(df.limit(0)).count() == 0


def test_workers_keep_no_vocabulary_after_their_task(spark):
    import pandas as pd
    df = spark.createDataFrame([(i, f"some words {i}") for i in range(80)], "doc_id long, text string").repartition(8)
    assert bpe_trie.encode_decode(df).count() == 80

    def held(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [bpe_trie.trie_of.cache_info().currsize]})
    assert [r["n"] for r in df.mapInPandas(held, "n long").distinct().collect()] == [0]
