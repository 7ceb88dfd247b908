"""Deterministic and seeded data: points for regression and clustering, and trades."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.codes import pack_code
from millrace.functions.draws import gaussian, seeded_hash

R, MIX = 0.00007, 0.7
#: Numbers that seeded_points draws at most.
MOST_DRAWN = 10_000_000


class JavaRandom:
    """The 48-bit linear congruential generator of java.util.Random, as its documentation defines it."""

    # fixed values of the documented algorithm
    MULTIPLIER, INCREMENT, MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1

    def __init__(self, seed: int):
        self.state, self.spare = (seed ^ self.MULTIPLIER) & self.MASK, None

    def bits(self, n: int) -> int:
        self.state = (self.state * self.MULTIPLIER + self.INCREMENT) & self.MASK
        return self.state >> (48 - n)

    def next_int(self) -> int:
        x = self.bits(32)
        return x - (1 << 32) if x >> 31 else x

    def next_double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) * 2.0**-53

    def next_gaussian(self) -> float:
        if self.spare is not None:
            x, self.spare = self.spare, None
            return x
        while True:
            a, b = 2 * self.next_double() - 1, 2 * self.next_double() - 1
            s = a * a + b * b
            if 0 < s < 1:
                scale = math.sqrt(-2 * math.log(s) / s)
                self.spare = b * scale
                return a * scale


def initial_weights(dim: int, seed: int = 42) -> list[float]:
    """Uniform in [-1, 1)."""
    rng = JavaRandom(seed)
    return [2 * rng.next_double() - 1 for _ in range(dim)]


def seeded_points(spark: SparkSession, n: int, dim: int, seed: int = 42) -> tuple[list[float], DataFrame]:
    """(weights, points): weights are drawn first, then points of classes 0 and 1 in turn.

    One generator draws all numbers in turn, on the driver, so there may be MOST_DRAWN of them; blob_points has no such bound.
    """
    if (n + 1) * dim > MOST_DRAWN:
        raise ValueError(f"more than {MOST_DRAWN} numbers from one generator")
    rng = JavaRandom(seed)
    w = [2 * rng.next_double() - 1 for _ in range(dim)]
    rows = []
    for i in range(n):
        y = float(i % 2)
        rows.append((i, [rng.next_gaussian() + y * R for _ in range(dim)], y))
    return w, spark.createDataFrame(rows, "id bigint, x array<double>, y double")


def deterministic_weights(dim: int) -> list[float]:
    return [2 * j * 0.037 - 1 for j in range(dim)]


def deterministic_points(spark: SparkSession, n: int, dim: int) -> DataFrame:
    """Points without any randomness, computed where they are used."""
    y = (F.col("id") % 2).cast("double")
    x = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.col("id") * F.lit(0.000013) + j * F.lit(0.00079) + y * F.lit(R))
    return spark.range(n).select("id", x.alias("x"), y.alias("y"))


def blob_points(spark: SparkSession, rows_per_slice: int, slices: int, dim: int, seed: int = 42, labelled: bool = True) -> DataFrame:
    """Normal points around +-MIX, alternately; a draw depends on the seed, the row's id and the component only."""
    y = F.when(F.col("id") % 2 == 0, -1.0).otherwise(1.0)
    x = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: gaussian(seeded_hash(seed, F.col("id"), j)) + MIX * F.col("y"))
    df = spark.range(0, rows_per_slice * slices, 1, slices).withColumn("y", y).withColumn("x", x)
    return df.select("id", "x", "y") if labelled else df.select("id", "x")


def trades(spark: SparkSession, n: int, slices: int | None = None) -> DataFrame:
    """Fixed-width trade records: price and quantity are the number of the row, sides alternate."""
    i = F.col("id")
    return spark.range(0, n, 1, slices).select(
        i.alias("trade_id"), F.lit(1).cast("bigint").alias("client_id"), pack_code(F.lit("XLON")).alias("venue_code"), pack_code(F.lit("BHP")).alias("instrument_code"),
        i.alias("price"), i.alias("quantity"), F.when(i % 2 == 0, "B").otherwise("S").alias("side"),
    )
