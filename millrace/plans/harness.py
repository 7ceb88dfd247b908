"""Timed runs: making and caching the input, warm-up, and steady iterations apart from each other."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import graph, kmeans, logreg
from millrace.sources import generators

#: Iterations before the clock of steady state starts.
WARM_UP = 2


def timed(load: Callable[[], DataFrame], steps: Callable[[DataFrame, int], object], iterations: int) -> dict:
    """Seconds of load (until the input is cached), of the warm-up, and of an iteration after it."""
    clock = [time.perf_counter()]
    cached = load().persist()
    cached.count()
    clock.append(time.perf_counter())
    steps(cached, WARM_UP)
    clock.append(time.perf_counter())
    steps(cached, iterations)
    clock.append(time.perf_counter())
    cached.unpersist()
    load_s, warm_s, steady_s = (b - a for a, b in zip(clock[:-1], clock[1:], strict=True))
    return {"load": round(load_s, 3), "warm_up": round(warm_s, 3), "iteration": round(steady_s / max(1, iterations), 3)}


def regression(spark: SparkSession, rows: int, dim: int, iterations: int) -> dict:
    return timed(lambda: generators.blob_points(spark, max(1, rows // 8), 8, dim), lambda p, n: logreg.fit(p, generators.initial_weights(dim), n), iterations)


def clustering(spark: SparkSession, rows: int, dim: int, iterations: int) -> dict:
    return timed(lambda: generators.blob_points(spark, max(1, rows // 8), 8, dim), lambda p, n: kmeans.fit(p, kmeans.first_centers(p, 8), n), iterations)


def ranks(spark: SparkSession, rows: int, dim: int, iterations: int) -> dict:
    """rows edges over rows / dim vertices."""
    ids = max(2, rows // dim)
    edge = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(ids)).cast("int")
    return timed(lambda: spark.range(rows).select(edge(1).alias("src"), edge(2).alias("dst")), lambda e, n: graph.pagerank(e, n).count(), iterations)


ALL = {"logreg": regression, "kmeans": clustering, "pagerank": ranks}
