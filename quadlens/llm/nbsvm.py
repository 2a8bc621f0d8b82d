"""Quality classifier: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model.

Features are the distinct words and word pairs of a text, hashed, and a text's vector has length 1 after scaling. The
linear model is fitted by dual coordinate descent: each sampled text has one dual variable, each step solves for one of
them exactly. Fitting takes a bounded sample of labelled rows; scoring runs in Spark tasks over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quadlens.llm.common import labelled_sample, map_texts, mix, only, pieces, word_hashes, words

BITS = 18
#: Most labelled rows of each class, and most distinct features of one of their texts, that fitting takes.
SAMPLE_ROWS, TEXT_FEATURES = 3_000, 4_000
SMOOTH, COST, ROUNDS = 1.0, 1.0, 20
PREDICT_AT = 0.3


def features(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, in order of text and feature: numbers below 2^BITS, and where each text starts."""
    found = [words(t) for t in texts]
    sizes = np.array([len(ws) for ws in found], np.int64)
    h = word_hashes([w for ws in found for w in ws])
    text = np.repeat(np.arange(len(found)), sizes)
    follows = text[1:] == text[:-1]
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[follows]
    every = np.concatenate([(text << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64),
                            (text[:-1][follows] << BITS) | (pairs >> np.uint64(64 - BITS)).astype(np.int64)])
    every.sort()
    every = every[np.r_[True, every[1:] != every[:-1]]] if len(every) else every
    return every & ((1 << BITS) - 1), np.searchsorted(every >> BITS, np.arange(len(found)))


@dataclass
class Model:
    """weight: of each feature, the ratio included; ratio: log-count ratios; scale: of the logistic curve."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    scale: tuple[float, float]

    def margins(self, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Margin of each text; one without words has the bias alone."""
        ends = np.r_[starts[1:], len(index)]
        total = np.r_[0.0, np.cumsum(self.weight[index], dtype=np.float64)]
        square = np.r_[0.0, np.cumsum(self.ratio[index].astype(np.float64) ** 2)]
        length = np.sqrt(np.maximum(square[ends] - square[starts], 1e-12))
        return np.where(ends > starts, (total[ends] - total[starts]) / length, 0.0) + self.bias

    def scores(self, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.margins(index, starts) + self.scale[1], -40, 40)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    n = 1 << BITS
    count = [SMOOTH + np.bincount(np.concatenate([r for r, v in zip(rows, y) if v == side] or [np.empty(0, np.int64)]), minlength=n)
             for side in (1, 0)]
    return (np.log(count[0] / count[0].sum()) - np.log(count[1] / count[1].sum())).astype(np.float32)


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the bias is a feature of value 1."""
    w, bias = np.zeros(1 << BITS), 0.0
    sign, dual = np.where(y > 0, 1.0, -1.0), np.zeros(len(y))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(ROUNDS):
        most = 0.0
        for i in rng.permutation(len(y)):
            slope = sign[i] * (values[i] @ w[rows[i]] + bias) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), cost[i])
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                w[rows[i]] += step * values[i]
                bias += step
                most = max(most, abs(new - dual[i]))
                dual[i] = new
        if most < 1e-4:
            break
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, most: int = TEXT_FEATURES) -> Model:
    """Fit on at most `rows` labelled texts of each class; a fifth of them sets the logistic curve of the scores.

    docs: doc_id, text. labels: doc_id and the label, already without rows that are held out. Rows with a null id or label
    don't count. Without rows of both classes every text gets the labels' share.
    """
    found, share = labelled_sample(only(docs, "doc_id", "text"), labels, label, rows)

    def hashed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in pieces(batches):
            index, starts = features(piece["text"])
            own = [x if len(x) <= most else x[np.linspace(0, len(x) - 1, most).astype(int)] for x in np.split(index, starts[1:])]
            yield pd.DataFrame({"doc_id": piece["doc_id"], "label": piece["label"], "f": [x.astype(np.uint32).tobytes() for x in own]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = found.mapInPandas(hashed, f"doc_id {kind}, label int, f binary").dropDuplicates(["doc_id"]).collect()
    got.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r["doc_id"])), r["doc_id"]))
    x = [np.frombuffer(r["f"], np.uint32).astype(np.int64) for r in got]
    y = np.array([r["label"] for r in got], float)
    if len(set(y.tolist())) < 2:
        zero = np.zeros(1 << BITS, np.float32)
        return Model(zero, zero, 0.0, (1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))))
    kept = np.arange(len(y)) % 5 > 0
    learn = np.flatnonzero(kept if len(set(y[kept].tolist())) == 2 else np.ones(len(y), bool))
    ratio = log_count_ratios([x[i] for i in learn], y[learn])
    values = {i: v / max(float(np.linalg.norm(v)), 1e-6) for i in learn for v in [ratio[x[i]].astype(np.float64)]}
    even = np.where(y[learn] > 0, 0.5 / y[learn].mean(), 0.5 / (1 - y[learn].mean()))
    w, bias = descend([x[i] for i in learn], [values[i] for i in learn], y[learn], COST * even)
    model = Model((w * ratio).astype(np.float32), ratio, bias, (1.0, 0.0))
    rest = np.flatnonzero(~kept) if len(set(y[~kept].tolist())) == 2 else np.arange(len(y))
    margin = model.margins(np.concatenate([x[i] for i in rest]), np.cumsum([0, *(len(x[i]) for i in rest[:-1])]))
    part = y[rest].mean()
    model.scale = curve(margin, y[rest], np.where(y[rest] > 0, share / part, (1 - share) / (1 - part)))
    return model


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps, weighted to the labels' true share; a ridge keeps a separable sample finite."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([np.sum(weight * (p - y) * x) + 0.1 * (a - 1), np.sum(weight * (p - y))])
        s = weight * p * (1 - p)
        h = np.array([[np.sum(s * x * x) + 0.1, np.sum(s * x)], [np.sum(s * x), np.sum(s) + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return max(a, 1e-3), b


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and score (0 to 1) for every whole text; null and empty texts get the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size, whatever the corpus
    return map_texts(docs, list(keep), "text", [("score", "double", pa.float64())],
                     lambda texts: ([shared.value.scores(*features(texts))], None))
