import importlib.util
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace import runtime
from millrace.functions.codes import next_power_of_two
from millrace.operators import aggregates, graph
from millrace.plans import cli, harness
from millrace.sources import generators, text

ROOT = Path(__file__).resolve().parents[1]


def test_scratch_is_deleted(spark):
    path = runtime.scratch_path(spark, "some")
    spark.range(3).write.parquet(path)
    other = runtime.scratch_path(spark, "other")
    spark.range(3).write.parquet(other)
    local = path.removeprefix("file://").removeprefix("file:")
    assert os.path.exists(local)
    runtime.discard(spark, path)
    assert not os.path.exists(local) and spark.read.parquet(other).count() == 3
    scratch = runtime.Scratch(spark)
    assert scratch.store(spark.range(6), "mine", "zstd").count() == 6
    mine = scratch.paths[0].removeprefix("file://").removeprefix("file:")
    assert os.path.exists(mine)
    scratch.discard()
    assert not os.path.exists(mine) and spark.read.parquet(other).count() == 3
    assert runtime.cut(spark.range(4)).count() == 4
    runtime.clean(spark)
    assert not os.path.exists(other.removeprefix("file://").removeprefix("file:"))
    assert runtime.cut(spark.range(5)).count() == 5


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        runtime.shared_dir(Session())


def test_entry_without_the_text_operators(tmp_path):
    (tmp_path / "millrace").mkdir()
    for child in (ROOT / "millrace").iterdir():
        if child.name not in ("llm", "__pycache__"):
            os.symlink(child, tmp_path / "millrace" / child.name)
    (tmp_path / "entry.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import entry; q = entry.queries(); assert 'pagerank_parts' in q and not [n for n in q if n.startswith('op') or n == 'pipeline'], q; assert set(entry.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(importlib.util.find_spec("millrace.llm") is None or importlib.util.find_spec("corpus_pipeline") is None, reason="the text operators are not installed")
def test_a_missing_library_is_an_error_and_not_fewer_queries():
    code = "import sys; sys.modules['xxhash'] = None\ntry:\n    import __spark_entry__\nexcept ImportError:\n    sys.exit(7)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 7


def test_pagerank_leaves_no_cache(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src int, dst int")
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    result = graph.pagerank(edges, 6, checkpoint_every=2)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
    assert {r["id"] for r in result.collect()} == {1, 2, 3}


def test_draws_depend_on_the_row_only(spark):
    ids = spark.range(400)
    some = lambda df: {r["id"]: r["y"] for r in text.random_labels(df, 5, "id").collect()}
    labels = some(ids)
    assert labels == some(ids.repartition(7)) and 40 < sum(y == 1 for y in labels.values()) < 130
    assert labels != {r["id"]: r["y"] for r in text.random_labels(ids, 6, "id").collect()}
    x = [v for r in generators.blob_points(spark, 1000, 4, 3).filter("y = 1").collect() for v in r["x"]]
    mean = sum(x) / len(x)
    assert abs(mean - generators.MIX) < 0.05 and abs(sum((v - mean) ** 2 for v in x) / len(x) - 1) < 0.06
    a, b = (sorted(map(str, generators.blob_points(spark, 40, 6 // k, 2).limit(40).collect())) for k in (1, 2))
    assert a == b
    with pytest.raises(ValueError, match="one generator"):
        generators.seeded_points(spark, generators.MOST_DRAWN, 2)


def test_small_functions(spark):
    n = {0: 1, 1: 1, 2: 2, 3: 4, 4: 4, 5: 8, 1 << 40: 1 << 40, (1 << 40) + 1: 1 << 41}
    assert {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in n], "n bigint").select("n", next_power_of_two(F.col("n"))).collect()} == n
    edges = spark.createDataFrame([(i % 7, i) for i in range(40)], "src int, dst int").repartition(5)
    assert [r["src"] for r in graph.adjacency(edges, ordered=True).collect()] == list(range(7))
    lines = spark.createDataFrame([("1 2.5  -3e2",), ("7",)], "value string")
    assert [r["x"] for r in text.space_vectors(lines).collect()] == [[1.0, 2.5, -300.0], [7.0]]
    writes = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (5, "c")], "seq int, key string")
    scan = aggregates.insertion_order(writes, "key", "seq").orderBy("first_at")
    assert [r["key"] for r in scan.collect()] == ["a", "b", "c"] and aggregates.insertion_order(writes.limit(0), "key", "seq").count() == 0


@pytest.mark.parametrize("which", harness.ALL)
def test_harness(spark, which):
    took = cli.main(["harness", which, "200", "3", "2"], spark)
    assert set(took) == {"load", "warm_up", "iteration"} and all(v >= 0 for v in took.values())


def test_upsert_demo(spark):
    found = cli.main(["upserts"], spark)
    assert [x[:2] for x in found["one"]] == [[1, 1.1], [2, 2.1], [3, 3.0], [4, 4.0]]
    assert found["two"] == [[1, 1.0, 1111], [2, 2.1, 2222], [3, 3.0, 3000], [4, 4.0, 4000], [5, 5.0, 5555], [6, 6.1, 6000]]
