"""One subcommand per job: python -m millrace.plans.cli JOB --help."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import aggregates, graph, kmeans, logreg
from millrace.plans import harness
from millrace.runtime import session
from millrace.sources import generators, text


def _pagerank(spark: SparkSession, a: argparse.Namespace) -> None:
    ranks = graph.pagerank(text.edges(text.lines(spark, a.input)), a.iterations, form=a.form, single=a.single)
    text.write_pairs(ranks, a.output, "id", "rank")


def _logreg(spark: SparkSession, a: argparse.Namespace) -> dict:
    w = logreg.fit(text.points(spark, a.input, a.dim), generators.initial_weights(a.dim, a.seed), a.iterations)
    return {"weights": w.tolist()}


def _kmeans(spark: SparkSession, a: argparse.Namespace) -> dict:
    points = text.points(spark, a.input, a.dim)
    sample = aggregates.take_sample(points, a.k, a.seed, "id").select("x").collect()
    centers, moved = kmeans.fit(points, [list(r["x"]) for r in sample], a.iterations, empty=a.empty)
    return {"centers": centers.tolist(), "delta": moved}


def _count(spark: SparkSession, a: argparse.Namespace) -> None:
    text.write_pairs(aggregates.count_by(text.tokens(text.lines(spark, a.input)), "token"), a.output, "token", "n")


def _symmetric(spark: SparkSession, a: argparse.Namespace) -> None:
    text.write_edges(graph.symmetric_distinct(text.edges(text.lines(spark, a.input, a.partitions))), a.output)


def _generate(spark: SparkSession, a: argparse.Namespace) -> None:
    text.write_points(generators.blob_points(spark, a.rows, a.slices, a.dim, a.seed, a.labelled), a.output)


def _vectors(spark: SparkSession, a: argparse.Namespace) -> None:
    rows: DataFrame = text.vectors(text.lines(spark, a.input), a.dim).withColumn("id", F.monotonically_increasing_id())
    text.write_points(text.random_labels(rows, a.seed, "id") if a.labelled else rows, a.output)


def _harness(spark: SparkSession, a: argparse.Namespace) -> dict:
    return harness.ALL[a.which](spark, a.rows, a.dim, a.iterations)


def _upserts(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Two maps: writes to one column, and writes to one or both of two columns."""
    one = [(1, 1.0, None), (1, 1.1, None), (2, 2.0, None), (3, 3.0, None), (4, 4.0, None), (2, 2.1, None)]
    two = [(1, 1.0, 1111), (2, 2.1, 2222), (3, 3.0, 3000), (4, 4.0, 4000), (5, 5.0, None), (5, None, 5555), (6, 6.0, 6000), (6, 6.1, None)]
    found = {}
    for name, writes in (("one", one), ("two", two)):
        df = spark.createDataFrame([(i, *w) for i, w in enumerate(writes)], "seq int, key int, v1 double, v2 bigint")
        latest = aggregates.upsert_latest(df, "key", "seq", ["v1", "v2"]).join(aggregates.insertion_order(df, "key", "seq"), "key")
        found[name] = [[r["key"], r["v1"], r["v2"]] for r in latest.orderBy("first_at").collect()]
    return found


def _trades(spark: SparkSession, a: argparse.Namespace) -> dict:
    took = []
    for _ in range(a.runs):
        began = time.perf_counter()
        row = aggregates.trade_totals(generators.trades(spark, a.rows), wrap=a.wrap).first()
        took.append(time.perf_counter() - began)
    return {"buy_cost": int(row["buy_cost"]), "sell_cost": int(row["sell_cost"]), "seconds": took}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, run, *names: str, **options) -> argparse.ArgumentParser:
        p = jobs.add_parser(name)
        p.set_defaults(run=run)
        for n in names:
            p.add_argument(n, type=int if n in ("iterations", "dim", "k", "rows", "slices") else str)
        for n, default in options.items():
            p.add_argument(f"--{n}", default=default, action=argparse.BooleanOptionalAction) if isinstance(default, bool) else p.add_argument(f"--{n}", default=default, type=int if default is None else type(default))
        return p

    job("pagerank", _pagerank, "input", "iterations", "output", form="damped", single=False)
    job("logreg", _logreg, "input", "dim", "iterations", seed=42)
    job("kmeans", _kmeans, "input", "dim", "k", "iterations", seed=42, empty="nan")
    job("count", _count, "input", "output")
    job("symmetric", _symmetric, "input", "output", partitions=None)
    job("generate", _generate, "dim", "rows", "slices", "output", seed=42, labelled=True)
    job("vectors", _vectors, "input", "dim", "output", seed=42, labelled=True)
    job("harness", _harness, "which", "rows", "dim", "iterations")
    job("upserts", _upserts)
    job("trades", _trades, rows=50_000_000, runs=5, wrap=False)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict | None:
    a = parser().parse_args(args)
    result = a.run(spark or session(f"millrace {a.job}"), a)
    if result is not None:
        print(json.dumps(result))
    return result


if __name__ == "__main__":
    main()
