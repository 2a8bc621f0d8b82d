from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from quadlens.llm import token_alignment
from quadlens.llm.bpe_trie import byte_letters

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

TEXTS = ["", None, " ", "  two  spaces ", "Don't we're", "one\n two\n\n  three\tfour", "a" * 300, " " * 90 + "x", "éüß 中文字 ٣ x²½ 　z", "has ▁ inside",
         "one  <|endoftext|>two <s> </s><0x41>", "\x1c\x85\xa0 tab\tend", "😀 smile ‍ zero", "the the the of the", "a\n b　 c"]


def aligned(text, a, b):
    """Both tokenizers over the whole text, every token pair compared."""
    if not text:
        return None
    letters = byte_letters()
    back = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [back[i] for i in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return None
    a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    links = [(x, y) for x, s, e in zip(a_ids, [0] + a_ends, a_ends) for y, t, f in zip(b_ids, [0] + b_ends, b_ends) if s < f and t < e]
    groups, start = [], 0
    for end in sorted(set(a_ends) & set(b_ends)):
        inside = [[str(i) for i, e in zip(ids, ends) if start < e <= end] for ids, ends in ((a_ids, a_ends), (b_ids, b_ends))]
        groups.append("|".join(map(",".join, inside)))
        start = end
    return a_ids, b_ids, links, ";".join(groups)


def brute(texts):
    paths = token_alignment.default_vocabularies()
    a, b = tokenizers.Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    found = [aligned(t, a, b) for t in texts]
    documents = Counter(p for x in found if x for p in set(x[2]))
    most = {}
    for (i, _), n in documents.items():
        most[i] = max(most.get(i, 0), n)
    rows = []
    for x in found:
        if x is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            rows.append((len(x[0]), len(x[1]), x[3].count(";") + 1, len(x[2]), sum(documents[p] == most[p[0]] for p in x[2]), sum(documents[p] for p in x[2]),
                         sha256(x[3].encode()).hexdigest()))
    return rows, documents, [x[3] if x else "" for x in found]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_groups_links_and_counts_as_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    letters = list("abcdelrstv   thein'sd \n\t\réüß中٣,.!?'") + ["the", " of", "tion ", "<|endoftext|>", "  ", "▁"]
    texts = TEXTS + ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(300)]
    texts += texts[:50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows, documents, groups = brute(texts)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in token_alignment.report(df).collect()}
    assert got == dict(enumerate(rows))
    assert {r["doc_id"]: r["groups"] for r in token_alignment.align(df).collect()} == dict(enumerate(groups))
    stored = token_alignment.blocks(df)
    counts = {(r["a_id"], r["b_id"]): r["documents"] for r in token_alignment.pair_counts(stored).collect()}
    assert counts == dict(documents)


def test_small_blocks_and_a_small_cache_change_nothing():
    import pyarrow as pa
    texts = ["one two  three", "", "two three", "four\n five one", "x" * 50] * 4
    paths = token_alignment.default_vocabularies()
    whole, small = token_alignment.Aligner(*paths), token_alignment.Aligner(*paths)
    want, got = token_alignment.Block(), token_alignment.Block()
    want.add(pa.array(range(20)), whole, texts)
    for i in range(20):
        if i % 3 == 0:
            small.forget()
        got.add(pa.array([i]), small, texts[i:i + 1])
    assert [x.to_pylist() for x in want.row(7)] == [x.to_pylist() for x in got.row(7)]


def test_parts_aligned_at_once_are_as_parts_aligned_alone():
    whole, alone = (token_alignment.Aligner(*token_alignment.default_vocabularies()) for _ in range(2))
    texts = ["other", " the", " tokenisation", " ,.!é", "wrong", "wrong", " 1234567 99x", "x"]
    spelled = [(t if t.startswith(" ") else "?" + t).encode() for t in texts]
    of_a = [e.ids for e in whole.a.encode_batch(texts, add_special_tokens=False)]
    of_b = whole.b.encode([t[1:] for t in texts])
    whole.add(spelled, of_a, of_b)
    for row in zip(spelled, of_a, of_b):
        alone.add(*([x] for x in row))
    alone.add([], [], [])
    assert list(whole.same) == [t.startswith(" ") for t in texts] and [g != b"" for g in whole.groups] == [t.startswith(" ") for t in texts]
    for name in ("same", "n_a", "n_b", "n_groups", "links", "ends", "groups"):
        assert getattr(whole, name) == getattr(alone, name), name


def test_nulls_repeats_clashing_columns_long_texts_and_empty_tables(spark):
    long = "some words, and  more of them! " * 5_000
    rows = [(None, None, "x", 1), (2 ** 60 + 1, "a b", "y", 2), (2 ** 60 + 1, "a b", "y", 2), (3, long, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, key int")
    want, _, _ = brute(["a b", "a b", "some words, and  more of them! " * 3])
    got = {r["doc_id"]: r for r in token_alignment.report(df).collect()}
    assert got[None]["n_a"] == 0 and got[None]["groups_sha256"] == ""
    assert got[2 ** 60 + 1]["n_links"] == want[0][3]
    assert token_alignment.report(df).where("doc_id = 1152921504606846977").count() == 2
    assert got[3]["n_a"] > 20_000 and got[3]["n_links"] == got[3]["n_a"] + got[3]["n_b"] - got[3]["n_groups"]
    assert token_alignment.report(df.limit(0)).count() == 0
    assert token_alignment.report(df.where("text is null")).count() == 1
