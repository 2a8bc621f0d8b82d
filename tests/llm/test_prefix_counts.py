import numpy as np
import pytest
from pyspark.sql import functions as F

from quadlens.llm import prefix_counts
from quadlens.llm.bpe_trie import default_vocabulary

tokenizers = pytest.importorskip("tokenizers")

TEXTS = ["", " ", "Don't we're you've I'll 're 'v 'rex !!'s  'll", "I'll  go\n\nnow \n x\t\ty", "a" * 300, " " * 90 + "x", "éüß 中文字 ٣ x²½ 　　z",
         "one  <|endoftext|>two!!<|endoftext|><|endoftext|> '<|endoftext|>", "<|endoftext", "\x1c\x85\xa0 tab\tend", "-" * 200, "😀 smile ‍ zero"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(default_vocabulary())


def counts_of(library, text):
    return [len(e.ids) for e in library.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]


def test_each_prefix_counts_as_the_library_counts_it(spark, library):
    rng = np.random.default_rng(3)
    letters = list("abcdelrstv   thein'sd \n\t\réüß中٣,.!?'") + ["<|endoftext|>", "<|end", "'re", "'ll", "  "]
    texts = TEXTS + ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(400)]
    table = prefix_counts.prefix_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in table.collect():
        text = texts[r["doc_id"]]
        counts = prefix_counts.unpacked(bytes(r["prefix_counts"]))
        assert list(counts) == counts_of(library, text), text
        assert (r["n_tokens"], r["n_bytes"]) == (counts[-1], len(text.encode()))


def test_questions_are_answered_from_the_stored_table(spark, library):
    texts = ["we're here,  it's been a while", "", "short", "x" * 500 + " y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = prefix_counts.prefix_table(docs)
    for limit in (0, 1, 3, 7):
        fit = {r["doc_id"]: r["fitting_chars"] for r in prefix_counts.fitting_chars(table, F.lit(limit)).collect()}
        cut = {r["doc_id"]: r["text"] for r in prefix_counts.truncated(docs, table, limit).collect()}
        at = {r["doc_id"]: r["tokens_at"] for r in prefix_counts.tokens_at(table, F.lit(limit)).collect()}
        for i, text in enumerate(texts):
            counts = counts_of(library, text)
            assert fit[i] == max(k for k, c in enumerate(counts) if c <= limit)
            assert cut[i] == text[:fit[i]] and at[i] == counts[min(limit, len(text))]
    assert [r["tokens_at"] for r in prefix_counts.tokens_at(table, F.lit(None)).collect()] == [None] * 4
    over = {r["doc_id"]: r["over_limit"] for r in prefix_counts.report(table, 5).collect()}
    assert over == {i: counts_of(library, t)[-1] > 5 for i, t in enumerate(texts)}


def test_nulls_repeats_clashing_columns_long_texts_and_empty_tables(spark, library):
    long = "some words, and  more of them! " * 20_000
    rows = [(None, None, "x", 1), (2 ** 60 + 1, "a b", "y", 2), (2 ** 60 + 1, "a b", "y", 2), (3, long, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prefix_counts string, n_tokens int")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in prefix_counts.prefix_table(df).collect())
    assert got == [(0, 0, 0), (3, len(long), len(library.encode(long).ids)), (2 ** 60 + 1, 3, 2), (2 ** 60 + 1, 3, 2)]
    assert prefix_counts.prefix_table(df.limit(0)).count() == 0
    assert prefix_counts.report(prefix_counts.prefix_table(df.limit(0)), 512).count() == 0


def test_a_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(prefix_counts, "CACHED_WORDS", 2)
    counter = prefix_counts.PrefixCounter(default_vocabulary())
    text = "one two  three two  one\n\nfour" * 5
    assert list(np.r_[0, np.cumsum(counter.text(text))]) == counts_of(library, text)
