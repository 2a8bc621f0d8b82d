"""What several operators share: reading, bounded batches, words and their hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python tasks work on pieces of about this many characters, so memory follows neither the partition nor the table.
PIECE_CHARS = 2_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by rows and bytes, as single texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    # a step's exchange files go once its table is written, not when the driver happens to collect garbage
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone: others, whatever their names, cannot clash with an operator's own."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def parts_of(spark: SparkSession, least: int = 12) -> int:
    """Partitions of a keyed exchange of the corpus, which the cluster sizes to its input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> tuple[DataFrame, float]:
    """Rows of docs for at most `rows` labelled ids of each class, by the order of a hash, with `label`; the share of label 1.

    Ids with several labels count with the smallest, null ids and labels don't count. Only the sampled ids are broadcast.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for v in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    return docs.join(F.broadcast(ids), "doc_id"), counts.get(1, 0) / max(1, sum(counts.values()))


def pieces(batches: Iterable[pd.DataFrame], text: str = "text", limit: int = PIECE_CHARS) -> Iterator[pd.DataFrame]:
    """Consecutive rows of at most `limit` characters, or one longer row; null texts become empty."""
    for batch in batches:
        batch[text] = batch[text].where(batch[text].notna(), "")
        ends = batch[text].str.len().cumsum().to_numpy()
        start = 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.iloc[start:stop].reset_index(drop=True)
            start = stop


def arrow_pieces(batch: pa.RecordBatch, texts: list[str], limit: int = PIECE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive rows with at most `limit` characters of text, or one row with more."""
    ends = np.cumsum([len(t) for t in texts])
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        yield batch.slice(start, stop - start), texts[start:stop]
        start = stop


def map_texts(df: DataFrame, keep: list[str], text: str, added: list[tuple[str, str, pa.DataType]],
              work: Callable[[list[str]], tuple[list, np.ndarray | None]], limit: int = PIECE_CHARS,
              done: Callable[[], None] | None = None) -> DataFrame:
    """The columns `keep`, as they are, with columns made from whole texts.

    work: from the texts of a piece to the added columns, and the row that each of their entries belongs to (None: all rows
    in order). A null text counts as empty. Kept values stay in Arrow, so whole numbers stay exact beside nulls.
    added: name, Spark type and Arrow type. done: called when a task ends, as its worker lives on into other stages.
    """
    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`"))
    names = [*keep, *(n for n, _, _ in added)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
                for part, own in arrow_pieces(batch, texts, limit):
                    columns, owner = work(own)
                    kept = [part.column(i) for i in range(len(keep))]
                    if owner is not None:
                        kept = [c.take(pa.array(owner, pa.int64())) for c in kept]
                    yield pa.RecordBatch.from_arrays([*kept, *(c if isinstance(c, pa.Array) else pa.array(c, kind)
                                                               for c, (_, _, kind) in zip(columns, added))], names=names)
        finally:
            if done:
                done()

    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"`{n}` {kind}" for n, kind, _ in added])
    return rows.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text: str, work: Callable[[list[str], pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of df, all columns as they are, for which `work` says so; null texts count as empty."""
    place = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in arrow_pieces(batch, [t or "" for t in batch.column(place).to_pylist()]):
                yield part.filter(pa.array(np.asarray(work(own, part), bool)))

    return df.mapInArrow(run, df.schema)


def words(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case: what lies between blanks x20 and x09 to x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads what is close."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])


def shrink(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as bytes: differences, byte planes apart, so that an exchange's codec takes the zeros."""
    gaps = np.diff(values, prepend=np.uint64(0))
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def grow(blob: bytes) -> np.ndarray:
    """What shrink() was given."""
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack(x: np.ndarray) -> bytes:
    """Small non-negative numbers as bytes: byte planes, compressed."""
    x = np.ascontiguousarray(x, np.uint32)
    return zstandard.compress(len(x).to_bytes(8, "little") + x.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(4, int.from_bytes(raw[:8], "little"))
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)
