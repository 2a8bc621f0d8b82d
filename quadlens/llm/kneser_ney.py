"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, mapped by its workers.

Texts become pieces: packed rows with the distinct words' hashes and the texts as numbers of those. A piece asks only for
its distinct words and word pairs, so what travels is much smaller than the texts' tokens, and very frequent ones cost one
entry for each piece. The same message counts and asks: the part of the hash space that it goes to adds up the training
counts of all pieces, writes its sorted arrays to a file of its own, maps that into memory and looks up every piece's
entries there. No worker and no driver holds the whole model; each part is a share of it that the size of the texts sets, so how many
messages there are does not follow the number of partitions.

Pairs are dealt out by their first word. A word that a large share of all tokens are is dealt out by the second word, and
its sums are added up from the parts; there are at most 8 such words for each part.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlens.llm.common import grow, mix, pack, pieces, runs_of, shrink, unpack, word_hashes, words
from quadlens.session import cut

PIECE = 2_500_000  # characters of a piece
PART, LEAST = 8_500_000, 12  # bytes of text for each part of the hash space; parts at least
END = np.uint64(0xE4D0E4D0E4D0E4D1)  # stands for the end of a text
START = -1  # number of the context before the first word
SHORT = np.uint64(16)  # words of a pair travel without so many low bits
SMOOTH = 0.1  # of the base score


def part_of(w: np.ndarray, parts: int) -> np.ndarray:
    return ((w >> SHORT) % np.uint64(parts)).astype(np.int64)


def parts_for(docs: DataFrame, text: str) -> int:
    """Parts of the hash space for these texts."""
    return max(LEAST, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // PART))


def mapped(folder: str, name: str, x: np.ndarray) -> np.ndarray:
    """The array as a read-only map of a file."""
    if not len(x):
        return x
    path = os.path.join(folder, name)
    x.tofile(path)
    return np.memmap(path, x.dtype, "r")


def packed_pieces(docs: DataFrame, key: str, text: str, train: str, parts: int) -> DataFrame:
    """A row for each piece of text: its texts as numbers of its distinct words, which lie in order of part and hash."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for piece in pieces(batches, "t", PIECE):
            found = [words(t) for t in piece["t"]]
            size = np.array([len(ws) + 1 for ws in found], np.int64)
            ends = np.cumsum(size) - 1
            h = np.empty(size.sum(), np.uint64)
            inner = np.ones(len(h), bool)
            inner[ends] = False
            h[inner] = word_hashes([w for ws in found for w in ws])
            h[ends] = END
            distinct, at = np.unique(h, return_inverse=True)
            part = part_of(distinct, parts)
            order = np.argsort(part, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at, distinct, part = place[at], distinct[order], part[order]
            learn = np.repeat(piece["train"].to_numpy(bool), size)
            count = np.bincount(at[learn], minlength=len(distinct))
            cuts = np.searchsorted(part, np.arange(parts + 1))
            often = np.flatnonzero(count * 8 * parts >= max(1, learn.sum()))
            # numbers by frequency: small ones are common, which packs well
            rank = np.argsort(-np.bincount(at, minlength=len(distinct)), kind="stable")
            by_rank = np.empty(len(rank), np.int64)
            by_rank[rank] = np.arange(len(rank))
            yield pd.DataFrame([{
                "piece": number, "ids": piece["k"].fillna(0).to_numpy(np.int64).tobytes(), "known": piece["k"].notna().to_numpy().tobytes(),
                "train": piece["train"].to_numpy(bool).tobytes(), "sizes": pack(size), "tokens": pack(by_rank[at]), "ranks": pack(rank),
                "words": [shrink(distinct[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], "counts": pack(count),
                "learned": int(learn.sum()), "often": [{"w": int(w), "n": int(c)} for w, c in zip(distinct[often].view(np.int64), count[often])]}])
            number += 1

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.col(train).alias("train"))
    return rows.mapInPandas(run, "piece long, ids binary, known binary, train binary, sizes binary, tokens binary, ranks binary, "
                                 "words array<binary>, counts binary, learned long, often array<struct<w: long, n: long>>")


def tokens_of(row) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the texts and their words' numbers."""
    return unpack(row["sizes"]), unpack(row["ranks"])[unpack(row["tokens"])]


def pairs_of(size: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (first, second) in order, with START first; each token's pair; the tokens' contexts."""
    before = np.r_[START, at[:-1]]
    before[np.r_[0, np.cumsum(size)[:-1]]] = START
    code, inverse = np.unique((before + 1) * n + at, return_inverse=True)
    return code // n - 1, code % n, inverse, before


def dealt(first: np.ndarray, second: np.ndarray, part: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The part each pair goes to; part, hot: of the piece's words."""
    spread = (first < 0) | hot[first]
    return np.where(spread, part[second], part[first])


def ask_pairs(table: DataFrame, parts: int, hot_words: list[int]) -> DataFrame:
    """For each piece and part: its pairs as runs of equal first words, with training counts."""
    hot_hashes = np.array(hot_words, np.int64).view(np.uint64)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                w = np.concatenate([grow(b) for b in row["words"]])
                size, at = tokens_of(row)
                first, second, inverse, _ = pairs_of(size, at, len(w))
                learn = np.repeat(np.frombuffer(row["train"], bool), size)
                count = np.bincount(inverse[learn], minlength=len(first))
                hot = np.isin(w, hot_hashes)
                part = dealt(first, second, part_of(w, parts), hot)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                out = []
                for p in np.flatnonzero(np.diff(cuts)):
                    own = order[cuts[p]:cuts[p + 1]]
                    run_ = runs_of(first[own])
                    lead = first[own][run_]
                    out.append({"part": p, "piece": row["piece"], "firsts": shrink(np.where(lead < 0, np.uint64(0), w[lead])),
                                "spread": ((lead < 0) | hot[lead]).tobytes(), "runs": pack(np.diff(np.r_[run_, len(own)])),
                                "seconds": (w[second[own]] >> SHORT).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes(), "counts": pack(count[own])})
                yield pd.DataFrame(out, columns=["part", "piece", "firsts", "spread", "runs", "seconds", "counts"])

    return table.select("piece", "words", "sizes", "tokens", "ranks", "train").mapInPandas(
        run, "part long, piece long, firsts binary, spread binary, runs binary, seconds binary, counts binary")


ANSWER = ("kind string, part long, piece long, a binary, b binary, word long, n array<long>")


def _row(kind: str, part: int | None = None, piece: int | None = None, a: bytes | None = None, b: bytes | None = None,
         word: int | None = None, n: list[int] | None = None) -> tuple:
    return kind, part, piece, a, b, word, n


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Whole numbers stay exact, also where some are missing."""
    names = ("kind", "part", "piece", "a", "b", "word", "n")
    columns = dict(zip(names, zip(*rows))) if rows else {n: () for n in names}
    return pd.DataFrame({n: pd.array(list(v), "Int64") if n in ("part", "piece", "word") else pd.Series(list(v), dtype=object) for n, v in columns.items()})


def answer_pairs(parts: int):
    """A part of the pair model: counts what all pieces sent, and answers each."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        first, second, count, at = [], [], [], [0]
        for _, r in group.iterrows():
            runs, lead = unpack(r["runs"]), grow(r["firsts"])
            first.append(np.repeat(lead, runs))
            six = np.zeros((int(runs.sum()), 8), np.uint8)
            six[:, :6] = np.frombuffer(r["seconds"], np.uint8).reshape(6, -1).T
            second.append(six.view(np.uint64).ravel())
            count.append(unpack(r["counts"]))
            at.append(at[-1] + len(count[-1]))
        first, second, count = np.concatenate(first), np.concatenate(second), np.concatenate(count)
        with np.errstate(over="ignore"):
            key = mix(first * np.uint64(0x9E3779B97F4A7C15) + second)
        learned = np.flatnonzero(count)
        order = learned[np.argsort(key[learned], kind="stable")]
        run_ = runs_of(key[order])
        total = np.add.reduceat(count[order], run_) if len(run_) else np.empty(0, np.int64)
        v, w = first[order][run_], second[order][run_]
        out = [_row("sum", n=[*(int((total == k).sum()) for k in range(1, 5)), len(total)])]
        with tempfile.TemporaryDirectory() as folder:
            keys, totals = mapped(folder, "pairs", key[order][run_]), mapped(folder, "counts", total)
            by = np.argsort(v, kind="stable")
            starts = runs_of(v[by])
            sums = np.zeros((len(starts), 4), np.int64)
            for j, x in enumerate((total, total == 1, total == 2, total > 2)):
                if len(starts):
                    sums[:, j] = np.add.reduceat(x[by].astype(np.int64), starts)
            contexts, sums = mapped(folder, "contexts", v[by][starts]), sums
            spread = np.unique(np.concatenate([grow(r)[np.frombuffer(s, bool)] for r, s in zip(group["firsts"], group["spread"])]))
            own = np.isin(contexts, spread)
            out += [_row("hot", word=int(c), n=[int(k) for k in s]) for c, s in zip(np.asarray(contexts[own]).view(np.int64), sums[own])]
            for i, (_, r) in enumerate(group.iterrows()):
                asked = key[at[i]:at[i + 1]]
                lead = grow(r["firsts"])
                out.append(_row("pairs", int(r["part"]), int(r["piece"]), pack(_look(keys, totals, asked)),
                                pack(np.concatenate([_look(contexts, sums[:, j], lead) for j in range(4)]))))
            del keys, totals, contexts
        by = np.argsort(w, kind="stable")
        starts = runs_of(w[by])
        seconds, times = w[by][starts], np.diff(np.r_[starts, len(w)])
        place = (seconds % np.uint64(parts)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(parts + 1))
        out += [_row("before", int(p), None, shrink(seconds[order[cuts[p]:cuts[p + 1]]]), pack(times[order[cuts[p]:cuts[p + 1]]]))
                for p in np.flatnonzero(np.diff(cuts))]
        return _frame(out)
    return run


def _look(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values of the asked keys among the sorted ones, 0 for others."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    return np.where(keys[at] == asked, values[at], 0)


def ask_words(table: DataFrame) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                count, at = unpack(row["counts"]), 0
                for p, blob in enumerate(row["words"]):
                    n = len(blob) // 8
                    if n:
                        out.append(_row("words", p, int(row["piece"]), blob, pack(count[at:at + n])))
                    at += n
            yield _frame(out)
    return table.select("piece", "words", "counts").mapInPandas(run, ANSWER)


def answer_words(hot_words: list[int]):
    """A part of the word model: training counts, how many words each follows; answers each piece."""
    hot_hashes = np.array(hot_words, np.int64).view(np.uint64)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asked, before = group[group["kind"] == "words"], group[group["kind"] == "before"]
        w, c = _added([grow(b) for b in asked["a"]], [unpack(b) for b in asked["b"]])
        s, k = _added([grow(b) for b in before["a"]], [unpack(b) for b in before["b"]])
        out = [_row("wordsum", n=[int(c.sum()), int((c > 0).sum()), *(int((k == j).sum()) for j in range(1, 5)), len(k)])]
        with tempfile.TemporaryDirectory() as folder:
            w, s = mapped(folder, "words", w), mapped(folder, "seconds", s)
            for _, r in asked.iterrows():
                own = grow(r["a"])
                n = _look(w, c, own)
                follows = np.where(n > 0, _look(s, k, own >> SHORT), 0)
                # a word that is dealt out by its second words is named by its place among those, from 1
                place = _look(hot_hashes, np.arange(1, len(hot_hashes) + 1), own)
                out.append(_row("words", int(r["part"]), int(r["piece"]), pack(np.concatenate([n, follows])), pack(place)))
            del w, s
        return _frame(out)
    return run


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    starts = runs_of(keys[order])
    return keys[order][starts], np.add.reduceat(counts[order], starts) if len(starts) else np.empty(0, np.int64)


def discounts(n: list[int]) -> np.ndarray:
    """What is taken off counts of 0, 1, 2, and 3 or more, from how many entries have the counts 1 to 4."""
    n1, n2, n3, n4 = n
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        out[1] = 1 - 2 * y * n2 / n1
        out[2] = 2 - 3 * y * n3 / n2
        if n3:
            out[3] = 3 - 4 * y * n4 / n3
    return np.clip(out, 0, [0, 1, 2, 3])


def scored_pieces(totals: dict, hot: dict[int, list[int]], hot_words: list[int], parts: int):
    """Scores of a piece's texts from its tokens and the answers to it."""
    off, low = discounts(totals["pairs"]), discounts(totals["follows"])
    n1, n2, _, _ = totals["follows"]
    kinds, entries, learned, vocabulary = totals["kinds"], totals["entries"], totals["learned"], totals["vocabulary"]
    rest = (low[1] * n1 + low[2] * n2 + low[3] * (kinds - n1 - n2)) / entries if entries else 1.0

    def run(group: pd.DataFrame) -> pd.DataFrame:
        row = group[group["kind"] == "piece"].iloc[0]
        answers = group[group["kind"] == "words"].sort_values("part")
        counts = [unpack(b) for b in answers["a"]]
        c = np.concatenate([x[:len(x) // 2] for x in counts])
        k = np.concatenate([x[len(x) // 2:] for x in counts])
        hot_place = np.concatenate([unpack(b) for b in answers["b"]])
        part = np.repeat(answers["part"].astype(int).to_numpy(), [len(x) // 2 for x in counts])
        size, at = tokens_of(row)
        first, second, inverse, before = pairs_of(size, at, len(c))
        place = dealt(first, second, part, hot_place > 0)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(parts + 1))
        n = np.zeros(len(first), np.int64)
        context = np.zeros((len(c) + 1, 4), np.int64)  # the last is START's
        for p, a, b in group.loc[group["kind"] == "pairs", ["part", "a", "b"]].astype({"part": int}).itertuples(index=False):
            own = order[cuts[p]:cuts[p + 1]]
            n[own] = unpack(a)
            lead = first[own][runs_of(first[own])]
            context[lead] = unpack(b).reshape(4, -1).T
        for i in np.flatnonzero(hot_place):
            context[i] = hot.get(hot_words[hot_place[i] - 1], [0, 0, 0, 0])
        context[START] = hot.get(0, [0, 0, 0, 0])
        lower = (np.maximum(k - low[np.minimum(k, 3)], 0) / entries if entries else np.zeros(len(k))) + rest / (vocabulary + 1)
        total = context[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(total > 0, (context[:, 1:] @ off[1:]) / total, 1.0)
            direct = np.where(total[first] > 0, np.maximum(n - off[np.minimum(n, 3)], 0) / total[first], 0.0)
        value = np.log10(direct + left[first] * lower[second])
        base = np.log10((c + SMOOTH) / (learned + SMOOTH * (vocabulary + 1)))
        starts = np.cumsum(size) - size
        ids = pd.array(np.frombuffer(row["ids"], np.int64), dtype="Int64")
        ids[~np.frombuffer(row["known"], bool)] = pd.NA
        return pd.DataFrame({"id": ids, "held_out": ~np.frombuffer(row["train"], bool), "n_tokens": size,
                             "n_known": np.add.reduceat((c > 0).astype(np.int64)[at], starts), "train_tokens": learned,
                             "base_score": np.add.reduceat(base[at], starts), "score": np.add.reduceat(value[inverse], starts)})
    return run


def score(docs: DataFrame, train: F.Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text, learned where `train` holds.

    score: log10 probability of the words and the end under the model; base_score: with single words, smoothed by 0.1.
    Null and empty texts have the end alone. Repeated rows count and are scored as often as they occur; null keys stay null.
    An empty table gives an empty result; without training rows every token is as likely as any other.
    """
    parts = parts_for(docs, text)
    table = cut(packed_pieces(docs.withColumn("_train", F.coalesce(train, F.lit(False))), key, text, "_train", parts), "pieces")
    learned = table.agg(F.sum("learned")).first()[0] or 0
    often = table.select(F.explode("often").alias("o")).groupBy("o.w").agg(F.sum("o.n").alias("n")).where(F.col("n") * 8 * parts >= max(1, learned))
    # at most 8 for each part, in the order of unsigned hashes
    hot_words = np.sort(np.array([r["w"] for r in often.collect()], np.int64).view(np.uint64)).view(np.int64).tolist()
    pairs = cut(ask_pairs(table, parts, hot_words).groupBy("part").applyInPandas(answer_pairs(parts), ANSWER), "pairs")
    asked = ask_words(table).unionByName(pairs.where("kind = 'before'"))
    found = cut(asked.groupBy("part").applyInPandas(answer_words(hot_words), ANSWER), "words")
    hot = {r["word"]: [int(x) for x in r["n"]] for r in pairs.where("kind = 'hot'").groupBy("word").agg(
        F.array(*(F.sum(F.col("n")[j]) for j in range(4))).alias("n")).collect()}
    a = pairs.where("kind = 'sum'").agg(*(F.sum(F.col("n")[j]) for j in range(5))).first()
    b = found.where("kind = 'wordsum'").agg(*(F.sum(F.col("n")[j]) for j in range(7))).first()
    a, b = [x or 0 for x in a], [x or 0 for x in b]
    totals = {"pairs": a[:4], "entries": a[4], "learned": b[0], "vocabulary": b[1], "follows": b[2:6], "kinds": b[6]}
    own = table.select(F.lit("piece").alias("kind"), "piece", "ids", "known", "train", "sizes", "tokens", "ranks")
    answers = pairs.where("kind = 'pairs'").unionByName(found.where("kind = 'words'")).select("kind", "part", "piece", "a", "b")
    both = own.unionByName(answers, allowMissingColumns=True)
    out = both.groupBy("piece").applyInPandas(scored_pieces(totals, hot, hot_words, parts), "id long, held_out boolean, n_tokens long, "
                                              "n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", key)


def perplexity(score_sum: float, tokens: int) -> float:
    return math.pow(10, -score_sum / tokens) if tokens else math.nan
