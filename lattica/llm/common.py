"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.store import drop_tables, materialize

__all__ = ["ChunkCache", "drop_tables", "input_bytes", "long_id", "materialize", "read_table", "release", "text_groups", "trimmed"]


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files behind tables that are written: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_bytes(df: DataFrame, text_col: str) -> int:
    """About the compressed bytes of df: Catalyst's figure for files, else half the text's bytes, counted."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n < 1 << 56 and df.inputFiles():
        return n
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("n")).first()["n"]) // 2


class ChunkCache:
    """Bounded two-generation memo from a text chunk to its encoded bytes.

    ``fill`` encodes a list of unseen chunks at once.  When the young generation is full it
    becomes the old one; whatever is still in use is promoted, the rest is forgotten.
    """

    def __init__(self, fill: Callable[[list[str]], Iterable[bytes]], limit: int = 250_000):
        self.fill, self.limit = fill, limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def resolve(self, chunks: set[str]) -> Callable[[str], bytes]:
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = []
        for c in chunks.difference(new):
            hit = old.get(c)
            if hit is None:
                missing.append(c)
            else:
                new[c] = hit
        if missing:
            new.update(zip(missing, self.fill(missing), strict=True))
        return new.__getitem__


def text_groups(texts: list[str | None], size: int = 1_500_000) -> Iterable[tuple[int, int]]:
    """Cut a batch of texts into runs of about ``size`` characters: (first, end) indexes."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t) if t else 0
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a task gives free memory back: workers live on and serve later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_id(name: str):
    return F.col(name).cast("long").alias(name)
