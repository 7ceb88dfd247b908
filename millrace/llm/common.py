"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.runtime import Scratch, cut, scratch_path, ship  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; every other character stays as it is."""
    return F.translate(text, UPPER, LOWER)


def small(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows; otherwise the planner shuffles it. df must be cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty string."""
    return [x or "" for x in column.to_pylist()]


def byte_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of an Arrow string column end to end, and the n + 1 offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def runs(sizes: np.ndarray, most: int, most_rows: int = 1 << 14) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `most` in total size and `most_rows` rows (a larger row stands alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (total + n > most or i - start >= most_rows):
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def byte_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a string or binary column; null has none."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most `most` bytes of that column, so that few of its values are Python objects at once."""
    for lo, hi in runs(byte_sizes(batch.column(column)), most):
        yield batch.slice(lo, hi - lo)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each of many ranges, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
