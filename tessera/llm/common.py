"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import CLEANUP, clear, cut, new_path, own_dir, remove, shared_dir, short_shuffles  # noqa: F401  used by the operators

def replaced(df: DataFrame, name: str, old: DataFrame) -> DataFrame:
    """As ``cut``, and ``old``, a table of ``cut`` that only ``df`` still reads, goes."""
    out = cut(df, name)
    remove(df.sparkSession, old.written_to)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names, null text as the empty text."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def small(batches, rows: int = 1024):
    """Arrow batches cut into smaller ones, so that a task never holds many texts' results at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back()


def give_back() -> None:
    """Return a worker's freed memory: workers outlive their tasks, and what they keep is missing in later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def repeated(batches):
    """The rows of sorted batches whose first column the row before or after has too. Holds one row."""
    held, again = None, False
    for b in batches:
        if not b.num_rows:
            continue
        key = np.asarray(b.column(0))
        same = key[1:] == key[:-1]
        keep = np.append(False, same) | np.append(same, False)
        before = held is not None and np.asarray(held.column(0))[0] == key[0]
        if held is not None and (again or before):
            yield held
        keep[0] |= before
        yield b.slice(0, b.num_rows - 1).filter(pa.array(keep[:-1]))
        held, again = b.slice(b.num_rows - 1), bool(keep[-1])
    if held is not None and again:
        yield held
    give_back()


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within it, actions hand Python so many rows at once: for rows as large as texts or sets, which are held twice then."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)
