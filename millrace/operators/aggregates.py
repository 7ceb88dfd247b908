"""Single-pass aggregations: counts, conditional totals, keyed upserts, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.draws import seeded_hash


def count_by(df: DataFrame, column: str) -> DataFrame:
    """(column, n): rows per value, combined before the shuffle."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def trade_totals(trades: DataFrame, wrap: bool = False) -> DataFrame:
    """One row: buy_cost and sell_cost, sums of price * quantity by side ('B' buys, anything else sells).

    Exact in decimal(38,0); wrap gives what 64-bit integers that overflow silently would hold.
    """
    cost = F.col("price").cast("decimal(19,0)") * F.col("quantity").cast("decimal(19,0)")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, cost)), F.lit(0)).cast("decimal(38,0)")
    out = trades.agg(total(F.col("side") == "B").alias("buy_cost"), total(~F.coalesce(F.col("side") == "B", F.lit(False))).alias("sell_cost"))
    if not wrap:
        return out
    m = F.lit(str(1 << 64)).cast("decimal(38,0)")
    half = F.lit(str(1 << 63)).cast("decimal(38,0)")
    low = lambda c: F.pmod(F.col(c), m)
    return out.select(*(F.when(low(c) >= half, low(c) - m).otherwise(low(c)).cast("bigint").alias(c) for c in ("buy_cost", "sell_cost")))


def insertion_order(writes: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first_at): each key with its first write, by which a scan in order of insertion sorts."""
    return writes.groupBy(key).agg(F.min(order).alias("first_at"))


def upsert_latest(writes: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """A row per key with each column's last value that was written; a null is a column not written."""
    return writes.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def take_sample(df: DataFrame, k: int, seed: int, id_column: str) -> DataFrame:
    """Exactly k rows (all if there are fewer), without replacement: those whose seeded hash of the id is smallest."""
    return df.orderBy(seeded_hash(seed, F.col(id_column)), id_column).limit(k)
