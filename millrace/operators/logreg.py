"""Logistic regression by full-batch gradient descent with step 1: no averaging, regularisation or intercept."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.vectors import dot, literal
from millrace.operators.partials import matrix, summed


def gradient(points: DataFrame, w: Sequence[float]) -> np.ndarray:
    """Sum over all points (x, y) of (1 / (1 + exp(-y w.x)) - 1) y x."""
    w = np.asarray(w, np.float64)

    def add(columns: list[pa.Array], total: np.ndarray) -> None:
        x, y = matrix(columns[0], len(w)), np.asarray(columns[1], np.float64)
        with np.errstate(over="ignore"):
            total[0] += ((1 / (1 + np.exp(-y * (x @ w))) - 1) * y) @ x

    return summed(points, ["x", "y"], len(w), 1, add)[0]


def fit(points: DataFrame, initial: Sequence[float], iterations: int, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> np.ndarray:
    """The weights after the iterations. Chained calls go on: pass the weights of one as the next one's initial."""
    points = points.select("x", "y").persist(level)
    if not points.count():  # fills the cache, too
        raise ValueError("no points")
    w = np.array(initial, np.float64)
    for _ in range(iterations):
        w = w - gradient(points, w)
    points.unpersist()
    return w


def margins(points: DataFrame, w: Sequence[float]) -> DataFrame:
    """Adds margin (w.x) and predicted (the sign: 1.0 or -1.0)."""
    return points.withColumn("margin", dot(F.col("x"), literal(w))).withColumn("predicted", F.when(F.col("margin") >= 0, 1.0).otherwise(-1.0))
