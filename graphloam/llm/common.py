"""What the corpus operators share: checkpoints, bounded samples, checked broadcasts, text batches."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import cut

#: Rows of (id, flag), or positions of lines, that a broadcast may hold: about 100 MB as a hash relation.
BROADCAST_ROWS = 1_000_000

#: Characters of text that a Python worker handles at once.
CHUNK_CHARS = 1_000_000
#: Rows that it handles at once.
CHUNK_ROWS = 1024


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` is counted to have at most ``rows`` rows; beyond that Spark shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage: then Spark removes shuffle files, and checkpoints, that nothing refers to any more.

    Without it they stay on the disks until the driver runs short of memory, which big data don't bring about."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def label_rows(labels: DataFrame, value: str, keep: Column | None = None) -> DataFrame:
    """(doc_id, y): one row for each labelled id; the larger of conflicting labels counts, nulls don't."""
    x = labels.select("doc_id", F.col(value).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if keep is not None:
        x = x.where(keep)
    return x.groupBy("doc_id").agg(F.max("y").alias("y"))


def bounded_ids(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows of ``rows``, chosen by a hash of doc_id: the same ones in every run."""
    return rows.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(n)


def labelled_texts(docs: DataFrame, labelled: DataFrame, n: int) -> DataFrame:
    """(doc_id, y, text) of at most ``n`` labelled documents; of a repeated doc_id the largest text counts."""
    ids = cut(bounded_ids(labelled.join(docs.select("doc_id"), "doc_id", "left_semi"), n))
    taken = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return taken.groupBy("doc_id", "y").agg(F.max("text").alias("text"))


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null: empty), each of about ``chars`` characters or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // chars
        cuts = np.flatnonzero(np.diff(part) | np.diff(np.arange(len(size)) // CHUNK_ROWS)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            piece = batch.slice(a, b - a)
            yield piece, [t or "" for t in piece.column(piece.schema.get_field_index(column)).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over an array of unsigned integers."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def adam(grad, p: np.ndarray, steps: int, rate: float, seed: int = 0) -> np.ndarray:
    """Minimise by Adam; ``grad(p, step, rng)`` gives a (stochastic) gradient for the parameter vector."""
    rng, m, v = np.random.default_rng(seed), np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        g = grad(p, t, rng)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        now = rate * (1 - t / steps) ** 0.5
        p = p - now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
