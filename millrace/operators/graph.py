"""Edge lists, adjacency and PageRank.

PageRank reads the edges once, counts parallel ones and keeps the distinct edges with weights (parallel edges /
out-degree), partitioned by source and cached; an iteration joins the ranks to them and sums by target, so one shuffle
of contributions, combined before it, is all that an iteration costs. No adjacency list is built, so a hub is many rows
and not one; the rows of a source with more than HUB targets are spread over several partitions from the first join on,
and its out-degree and rank are sent to each. The cache is given back before the result is returned.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.iterate import iterate
from millrace.runtime import cut

DAMPING, BASE = 0.85, 0.15
#: Edges of a source up to which they stay in one partition, and hubs that are broadcast at most.
HUB, BROADCAST_ROWS = 1_000_000, 200_000


def adjacency(edges: DataFrame, ordered: bool = False) -> DataFrame:
    """(src, dsts): all targets of each source, duplicates kept, sorted; ordered: rows in order of the source."""
    lists = edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dsts"))
    return lists.orderBy("src") if ordered else lists


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("out_degree"))


def stats(edges: DataFrame) -> DataFrame:
    """One row: edges, distinct sources, distinct ids, and edges plus sources (cells of the adjacency)."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(True).alias("source")), F.struct(F.col("dst").alias("id"), F.lit(False).alias("source")))).alias("e")
    counted = edges.select(ends).select("e.*").agg(F.count_if("source").alias("edges"), F.count_distinct(F.when(F.col("source"), F.col("id"))).alias("sources"), F.count_distinct("id").alias("ids"))
    return counted.select("edges", "sources", "ids", (F.col("edges") + F.col("sources")).alias("cells"))


def symmetric_distinct(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once; a self-loop is one row."""
    both = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e")
    return edges.select(both).select(F.col("e.a").alias("src"), F.col("e.b").alias("dst")).distinct()


def hubs(pairs: DataFrame, hub: int = HUB) -> DataFrame:
    """(hub_id, salts): sources with more than `hub` rows, and over how many partitions theirs are spread."""
    return pairs.groupBy(F.col("src").alias("hub_id")).agg(F.ceil(F.count("*") / hub).cast("int").alias("salts")).filter("salts > 1")


def _per_salt(vertices: DataFrame, id_column: str, large: DataFrame | None) -> DataFrame:
    """A hub's row once for each of its salts, other rows once; adds `at`. large: None without hubs."""
    if large is None:
        return vertices.withColumn("at", F.lit(0))
    each = F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)
    return vertices.join(large, F.col(id_column) == F.col("hub_id"), "left").select(*vertices.columns, F.explode(each).alias("at"))


def weighted(pairs: DataFrame, large: DataFrame | None) -> DataFrame:
    """(src, dst, share, salt): the share of a source's rank that each distinct edge carries. pairs: src, dst, n."""
    spread = pairs.withColumn("salt", F.lit(0))
    if large is not None:
        salt = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("salts")), F.lit(0)).cast("int")
        spread = pairs.join(large, F.col("src") == F.col("hub_id"), "left").select("src", "dst", "n", salt.alias("salt"))
    degrees = _per_salt(pairs.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("out_degree")), "id", large)
    return spread.join(degrees, (F.col("src") == F.col("id")) & (F.col("salt") == F.col("at"))).select("src", "dst", (F.col("n") / F.col("out_degree")).alias("share"), "salt")


def pagerank(edges: DataFrame, iterations: int, form: str = "damped", single: bool = False, level: StorageLevel = StorageLevel.MEMORY_AND_DISK, checkpoint_every: int = 5, hub: int = HUB) -> DataFrame:
    """(id, rank) after the iterations, starting with 1.0 for every source.

    damped: rank = BASE + DAMPING * contributions. raw: rank is the sum of contributions, damped when it is read.
    Only vertices that something contributed to are left after an iteration: a source without in-edges goes.
    Ranks are not normalised, and what a vertex without out-edges holds is not given on. single: 32-bit ranks.
    """
    if form not in ("damped", "raw"):
        raise ValueError(f"unknown form {form!r}")
    if iterations < 0:
        raise ValueError("iterations must not be negative")
    kind = "float" if single else "double"
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n")).persist(level)
    large = cut(hubs(pairs, hub))
    if found := large.count():
        large = F.broadcast(large) if found <= BROADCAST_ROWS else large
    else:
        large = None
    links = weighted(pairs, large).repartition("src", "salt").persist(level)
    ranks = cut(pairs.select(F.col("src").alias("id")).distinct().withColumn("rank", F.lit(1.0).cast(kind)))

    def step(ranks: DataFrame, k: int) -> DataFrame:
        read = F.col("rank") if form == "damped" or k == 0 else F.col("rank") * DAMPING + BASE
        met = links.join(_per_salt(ranks, "id", large), (F.col("src") == F.col("id")) & (F.col("salt") == F.col("at")))
        sums = met.select(F.col("dst").alias("id"), (read * F.col("share")).cast(kind).alias("c")).groupBy("id").agg(F.sum("c").alias("s"))
        return sums.select("id", (F.col("s") * DAMPING + BASE if form == "damped" else F.col("s")).cast(kind).alias("rank"))

    final = cut(iterate(ranks, step, iterations, checkpoint_every)) if iterations else ranks
    links.unpersist()
    pairs.unpersist()
    return final
