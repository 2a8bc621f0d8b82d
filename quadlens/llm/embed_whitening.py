"""Whitening of embeddings from a bidiagonal form of their centred rows.

The covariance is never formed. Blocks of centred rows are reduced to one triangle R by QR, in tasks and then in groups of triangles,
so what travels is one small square for each task. R is made bidiagonal by reflections, dqds finds its singular values accurately, and
twisted factorisations give the right singular vectors, which are the covariance's eigenvectors (see qd.py).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlens.llm.common import parts_of
from quadlens.llm.qd import right_singular
from quadlens.session import cut

#: Steps of a unit, and what is added so that all numbers are positive.
SCALE, SHIFT = 64, 1_000_000
#: Triangles reduced to one by a task.
FAN_IN = 16
BLOCK_ROWS = 4096


class Whitening(NamedTuple):
    """What is needed to whiten a row; its size is that of a vector, not of a table."""
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the components, falling
    vectors: np.ndarray  # one column a component
    trace: float


def whole(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a usable vector, as whole numbers in column x.

    Left out: vectors that are null or empty, with null or non-finite entries, with entries beyond +-2^40, and vectors that have not
    the length most vectors have (of equally frequent lengths the longest).
    """
    c = F.col(f"`{vector}`")
    entry = F.transform(c, lambda v: v.cast("double"))
    usable = c.isNotNull() & (F.size(c) > 0) & F.forall(entry, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float(1 << 40)), F.lit(False)))
    rows = df.where(usable).withColumn("x", F.transform(entry, lambda v: F.floor(v * SCALE) + SHIFT))
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return rows.where(F.size("x") == (lengths[0]["length"] if lengths else 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, from whole numbers where they fit 64 bits."""
    if n * (float(np.abs(x).max(initial=0)) + 1) < 2.0 ** 62 and float(np.abs(sums).max(initial=0)) < 2.0 ** 62:
        return (n * x - sums.astype(np.int64)) / n
    return ((n * x.astype(object) - sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - S)^2; null where a long cannot hold it."""
    if n * (float(np.abs(x).max(initial=0)) + 1) < 2.0 ** 62 and float(np.abs(sums).max(initial=0)) < 2.0 ** 62:
        away = n * x - sums.astype(np.int64)
        if float(np.abs(away).max(initial=0)) ** 2 * x.shape[1] < 2.0 ** 62:
            return np.square(away).sum(axis=1).tolist()
    away = n * x.astype(object) - sums
    return [v if v < 1 << 63 else None for v in (int(r @ r) for r in away)]


def totals(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Rows of the fit list and exact sums of each dimension."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                own = matrix(batch.column(0)).sum(axis=0).astype(object)  # a batch's sum fits 64 bits, the table's need not
                n, sums = n + batch.num_rows, own if sums is None else sums + own
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(sums))], pa.int32()), pa.array([str(v) for v in (n, *sums)])], names=["dim", "part"])

    parts = fit.select("x").mapInArrow(run, "dim int, part string")
    found = {r["dim"]: int(r["total"]) for r in parts.groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()}
    return found.get(-1, 0), np.array([found[i] for i in range(len(found) - 1)], dtype=object)


def triangle(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of all centred rows."""
    def reduced(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                r = reduced(r, centred(matrix(batch.column(0).slice(start, BLOCK_ROWS)), n, sums))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["id", "r"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        r = None
        for blob in rows.sort_values("id")["r"]:
            r = reduced(r, np.frombuffer(blob).reshape(-1, len(sums)))
        return pd.DataFrame({"id": rows["id"].min() // FAN_IN, "r": [r.tobytes()]})

    found = cut(fit.select("x").mapInArrow(run, "id long, r binary"), "triangles")
    while (count := found.count()) > 1:
        found = cut(found.groupBy(F.expr(f"id div {FAN_IN}")).applyInPandas(join, "id long, r binary"), "triangles")
    r = np.frombuffer(bytes(found.first()["r"])).reshape(-1, len(sums)) if count else np.empty((0, len(sums)))
    return np.vstack([r, np.zeros((len(sums) - len(r), len(sums)))])  # fewer rows than dimensions


def fit_whitening(fit: DataFrame, components: int = 16) -> Whitening:
    """Whitening of a list of vectors (column x, each counted as often as it stands there).

    Components with an eigenvalue of 0 within rounding do not exist: fewer rows than dimensions, or dimensions that depend on others,
    give fewer components, one row or none gives none.
    """
    n, sums = totals(fit)
    if not n:
        return Whitening(0, [], np.empty(0), np.empty((0, 0)), 0.0)
    squares, vectors = right_singular(triangle(fit, n, sums), components)
    return Whitening(n, [int(s) for s in sums], squares[:vectors.shape[1]] / n, vectors, float(squares.sum()) / n)


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the covariance of the whitened fit list minus the identity, from a pass over its rows."""
    sums, k = np.array(model.sums, dtype=object), len(model.values)
    to_white = model.vectors / np.sqrt(model.values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            white = centred(matrix(batch.column(0)), model.n, sums) @ to_white
            total += white.T @ white
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["place", "part"])

    if not k:
        return None
    summed = fit.select("x").mapInArrow(run, "place long, part double").groupBy("place").agg(F.sum("part").alias("total")).collect()
    covariance = np.zeros(k * k)
    for r in summed:
        covariance[r["place"]] = r["total"] / model.n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error: a row for each usable vector and component.

    The fit list holds each distinct vector once. Vectors are compared as whole numbers, floor(64 c) + 1000000; which rows are left out
    says whole(). A null key stays, repeated rows give repeated rows, other columns are left out, an empty table gives no rows, and so
    does a table of equal vectors, which has no component. Equal eigenvalues have some orthogonal choice of components.
    """
    rows = whole(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector")), "vector").select("key", "x")
    fit = cut(rows.select("x").distinct().repartition(parts_of(df.sparkSession), "x"), "fit")
    model = fit_whitening(fit, components)
    error = identity_error(fit, model)
    sums, k = np.array(model.sums, dtype=object), len(model.values)
    to_white = model.vectors / np.sqrt(model.values)
    names = ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = matrix(batch.column(1))
            white = centred(x, model.n, sums) @ to_white
            each = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(deviations(x, model.n, sums), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), model.n)),
                deviation.take(pa.array(each)), pa.array(white.ravel()), pa.array(np.tile(model.values / model.trace, len(x))), pa.array(np.full(len(each), error))],
                names=names)

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
