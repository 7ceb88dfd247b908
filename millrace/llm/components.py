"""Connected components of a distributed list of links, by alternating large-star and small-star steps.

Each round is two joins and leaves every node with links to smaller nodes only, until each component is a
star around its smallest node. No node's links are ever gathered in one task: minima are pre-aggregated
before the shuffle, and a hub's links meet its minimum in a join, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))


def components(links: DataFrame) -> DataFrame:
    """(a, b): each node that has a link and is not its component's smallest, with that smallest node.

    links: columns a and b, of one orderable type; links with a null, and of a node to itself, are left out.
    """
    now = cut(links.select("a", "b").filter("a != b").distinct())
    was = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == was or not mark["n"]:
            return now
        was = mark
        now = cut(_small_star(_large_star(now)).distinct())
