"""K-means: a fixed number of Lloyd rounds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from millrace.operators.partials import matrix, summed
from millrace.runtime import ship


def assign(points: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    """Adds k (nearest center; ties to the lowest) and d (squared distance). The plan doesn't grow with the centers."""
    ship(points.sparkSession)
    table, at = np.asarray(centers, np.float64), points.columns.index("x")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(at), table.shape[1])
            own = _nearest(x, table)
            d = ((x - table[own]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(d)], names=[*batch.schema.names, "k", "d"])

    return points.mapInArrow(run, f"{schema}, k int, d double")


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    d = np.stack([((x - c) ** 2).sum(1) for c in centers])
    return np.where(np.isnan(d), np.inf, d).argmin(0)


def update(points: DataFrame, centers: np.ndarray, empty: str = "nan") -> np.ndarray:
    """Means of the points nearest to each center. A center without points becomes NaN, or stays with empty='keep'."""
    k, dim = centers.shape

    def add(columns: list[pa.Array], total: np.ndarray) -> None:
        x = matrix(columns[0], dim)
        own = _nearest(x, centers)
        for i in np.unique(own):
            part = x[own == i]
            total[i, :dim] += part.sum(0)
            total[i, dim] += len(part)

    sums = summed(points, ["x"], dim + 1, k, add)
    n = sums[:, dim:]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, sums[:, :dim] / n, centers if empty == "keep" else np.nan)


def delta(old: np.ndarray, new: np.ndarray) -> float:
    """Sum of the squared distances that the centers moved; reported, never used to stop."""
    return float(((np.asarray(old) - np.asarray(new)) ** 2).sum())


def fit(points: DataFrame, initial: Sequence[Sequence[float]], iterations: int, empty: str = "nan", level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> tuple[np.ndarray, list[float]]:
    """(centers, delta of each round)."""
    points = points.select("x").persist(level)
    centers, moved = np.array(initial, np.float64), []
    for _ in range(iterations):
        new = update(points, centers, empty)
        moved.append(delta(centers, new))
        centers = new
    points.unpersist()
    return centers, moved


def first_centers(points: DataFrame, k: int) -> list[list[float]]:
    """The k points with the smallest ids; fails if there are fewer."""
    rows = points.orderBy("id").limit(k).select("x").collect()
    if len(rows) < k:
        raise ValueError(f"{k} centers from {len(rows)} points")
    return [list(r["x"]) for r in rows]
