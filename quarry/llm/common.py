"""Shared pieces of the operators: table access, size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 200_000      # largest table (narrow rows) that is broadcast by hand


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else
    unchanged (a shuffled join). ``df`` should be staged: it is counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread_tasks(df: DataFrame, *keys: str) -> int:
    """Partitions for a shuffle by hand: the session's setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def byte_slices(col: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """``(row, rows)``: consecutive rows of at most ``most`` bytes of a string or binary
    column, or one longer one."""
    ends, row = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while row < len(col):
        to = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + most, "right")))
        yield row, to - row
        row = to


def text_slices(col: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """``(row, texts)``: the slices as large strings (null: empty). Each slice is a copy:
    some Arrow kernels misread arrays whose first offset is not 0."""
    for row, n in byte_slices(col, most):
        texts = col.take(pa.array(np.arange(row, row + n)))
        yield row, pc.fill_null(pc.cast(texts, pa.large_string()), "")
