"""What the operators share: reading tables, ids and texts, Python batches, and a bucketed exchange.

Python stages run under ``mapInArrow``. They read record batches, gather a bounded amount of text and work on it with
numpy. Where rows have to meet by a hash, a stage packs them into one binary value for each bucket (``pack``) so that the
JVM moves a few large rows, and ``exchange`` brings all values of a bucket together, in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut

__all__ = ["CHUNK_CHARS", "EXCHANGED", "chunks", "cut", "exchange", "id_text", "pack", "packed_batch", "release", "table", "trim", "tuned", "unpack"]

#: Characters of text that a Python stage holds at once, unless a single text is longer.
CHUNK_CHARS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> None:
    """Small Arrow batches, as rows hold whole documents; no inference of constraints, whose number explodes with nested array expressions."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column's name can clash; rows without doc_id take no part; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")


def trim() -> None:
    """Gives memory of finished work back to the system, as Python workers live on between tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], chars: int = CHUNK_CHARS, text: str = "text") -> Iterator[pa.Table]:
    """The batches, gathered into tables of about so many bytes of text."""
    trim()
    held, size = [], 0
    for batch in batches:
        step = max(1, int(batch.num_rows * chars / max(batch.nbytes, 1)))
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            held.append(part)
            size += part.nbytes
            if size >= chars:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pack(bucket: np.ndarray, n_buckets: int, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """One packed value for each bucket that has rows; columns lie one after the other."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(edges)):
        lo, hi = edges[b], edges[b + 1]
        # Byte by byte, as the high bytes of small or sorted numbers then compress to nothing.
        yield int(b), b"".join([np.int64(hi - lo).tobytes(), *(np.ascontiguousarray(c[lo:hi]).view(np.uint8).reshape(hi - lo, -1).T.tobytes() for c in columns)])


def unpack(values: list[bytes], dtypes: list[str]) -> list[np.ndarray]:
    """Inverse of pack for all values of a bucket."""
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for v in values:
        n, at = int(np.frombuffer(v, "<i8", 1)[0]), 8
        for p, t in zip(parts, dtypes, strict=True):
            size = np.dtype(t).itemsize
            p.append(np.ascontiguousarray(np.frombuffer(v, np.uint8, n * size, at).reshape(size, n).T).view(t).reshape(n))
            at += n * size
    return [np.concatenate(p) if p else np.empty(0, t) for p, t in zip(parts, dtypes, strict=True)]


EXCHANGED = "bucket long, value binary"


def packed_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "value"])


def exchange(df: DataFrame, n_buckets: int, reduce: Callable[[list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Brings the packed values of each bucket together and applies reduce to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for b, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != now and held:
                    yield from reduce(held)
                    held = []
                now = b
                held.append(v)
        if held:
            yield from reduce(held)
            held = []
        trim()

    return df.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of finished steps that nothing refers to any more."""
    import gc
    import time

    for _ in range(2):  # the driver's side learns of dropped references a moment later
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()
