"""Vector sums: each task adds up its rows with numpy, and a task's sums are added up by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import ship


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column; a null or a row of another length fails."""
    if column.null_count or (len(column) and not np.all(np.asarray(column.value_lengths()) == dim)):
        raise ValueError(f"every vector must have {dim} components")
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def summed(df: DataFrame, columns: list[str], dim: int, groups: int, add: Callable[[list[pa.Array], np.ndarray], None]) -> np.ndarray:
    """groups x dim sums. add(columns of a batch, sums so far) adds to them; what comes to the driver is one row per component."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups, dim))
        for batch in batches:
            add(batch.columns, total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["j", "s"])

    out = np.zeros(groups * dim)
    for row in df.select(*columns).mapInArrow(run, "j bigint, s double").groupBy("j").agg(F.sum("s").alias("s")).collect():
        out[row["j"]] = row["s"]
    return out.reshape(groups, dim)
