"""Shared helpers: contract hashes, bounded samples, memory of Python workers, rejection of rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.llm import textkernel as tk
from quillwave.llm.bitmaps import likely
from quillwave.shared import fresh_path, shared_dir, stash

__all__ = ["BROADCAST_IDS", "TEXT_KEY", "bounded_sample", "by_slices", "fresh_path", "held_out", "id_hash", "shared_dir", "stash", "table", "text_key", "tidy", "without"]

SAMPLE_SPACE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(run):
    """`run` for mapInArrow, giving memory back at a task's end: workers live on, and other stages need the room."""

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library, which has no such call
            pass

    return task


def held_out(doc_id: Column) -> Column:
    """True for documents whose crc32(doc_id as text) mod 5 is 0; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def id_hash(doc_id: Column, salt: int = 0) -> Column:
    return F.xxhash64(doc_id, F.lit(salt))


def bounded_sample(df: DataFrame, class_col: str, id_col: str, per_class: int, weight: str | None = None) -> DataFrame:
    """About `per_class` rows of each class at most, of every class, chosen by a hash of the id, alike in every run.

    A column `weight`, if named, says how many rows of its class each one stands for: 1 where the class is whole.
    The counts of the classes are a written table; nothing reaches the driver.
    """
    part = F.least(F.lit(SAMPLE_SPACE), F.ceil(F.lit(SAMPLE_SPACE * per_class) / F.col("count")))
    parts = stash(df.where(F.col(class_col).isNotNull()).groupBy(class_col).count().select(class_col, part.alias("_part")), "class-counts")
    bucket = F.pmod(id_hash(F.col(id_col), 17), F.lit(SAMPLE_SPACE))
    kept = df.join(F.broadcast(parts) if parts.count() <= BROADCAST_IDS else parts, class_col).where(bucket < F.col("_part"))
    return kept.select(*df.columns, *([(F.lit(SAMPLE_SPACE) / F.col("_part")).alias(weight)] if weight else []))


def by_slices(batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch, int], pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """Apply `work` to slices of bounded text size of each batch."""
    for batch in batches:
        for lo, hi in tk.slices(batch.column(text_at)):
            yield work(batch.slice(lo, hi - lo), text_at)


#: Up to so many ids are broadcast to filter documents; more are shuffled.
BROADCAST_IDS = 500_000


#: The name of a hash of the text in tables of rows that a stage rejects; no table of documents is likely to have it.
TEXT_KEY = "__text_key"


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def without(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """`documents` but for the rows named by `gone`, a written table of doc_id and TEXT_KEY; null ids are ids like any other.

    Up to BROADCAST_IDS of them are broadcast.  Beyond, a bitmap of bounded size tells rows that stay for sure, which are
    not shuffled; the others, hardly more than those named, are joined.
    """
    some = gone.select(F.col("doc_id").alias("__gone_id"), F.col(TEXT_KEY).alias("__gone_key")).distinct()
    named = F.col("doc_id").eqNullSafe(F.col("__gone_id")) & (text_key(F.col("text")) == F.col("__gone_key"))
    n = gone.count()
    if n <= BROADCAST_IDS:
        return documents.join(F.broadcast(some), named, "left_anti")
    maybe = likely(gone.select(F.xxhash64("doc_id", TEXT_KEY).alias("hash")), n, F.xxhash64(F.col("doc_id"), text_key(F.col("text"))))
    return documents.where(~maybe).union(documents.where(maybe).join(some, named, "left_anti"))
