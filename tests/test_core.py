import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.codes import pack_code
from millrace.operators import aggregates, graph, kmeans, logreg
from millrace.plans import cli
from millrace.sources import generators, text

SAMPLE = [(2, 4), (7, 8), (12, 3), (12, 7), (7, 12), (3, 12)]
DAMPED = {
    0: {2: 1.0, 3: 1.0, 7: 1.0, 12: 1.0},
    1: {3: 0.575, 4: 1.0, 7: 0.575, 8: 0.575, 12: 1.425},
    2: {3: 0.755625, 7: 0.755625, 8: 0.394375, 12: 0.883125},
    5: {3: 0.498412177734, 7: 0.498412177734, 8: 0.414861826172, 12: 0.944585478516},
    10: {3: 0.491496882167, 7: 0.491496882167, 8: 0.352267618896, 12: 0.756802856689},
}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(SAMPLE, "src int, dst int")


def ranks(df):
    return {r["id"]: r["rank"] for r in df.collect()}


@pytest.mark.parametrize("n", DAMPED)
def test_pagerank_golden(edges, n):
    assert ranks(graph.pagerank(edges, n)) == pytest.approx(DAMPED[n], abs=1e-9)
    assert ranks(graph.pagerank(edges, n, single=True)) == pytest.approx(DAMPED[n], rel=1e-5)


def test_raw_form_relates_to_damped(edges):
    raw = ranks(graph.pagerank(edges, 5, form="raw"))
    assert {k: 0.15 + 0.85 * v for k, v in raw.items()} == pytest.approx(DAMPED[5], abs=1e-9)
    assert ranks(graph.pagerank(edges, 0, form="raw")) == DAMPED[0]


def test_pagerank_counts_parallel_edges_and_ignores_order(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(-3, 9), rng.randint(-3, 9)) for _ in range(60)]
    a = ranks(graph.pagerank(spark.createDataFrame(pairs, "src int, dst int"), 4))
    rng.shuffle(pairs)
    assert ranks(graph.pagerank(spark.createDataFrame(pairs, "src int, dst int").repartition(7), 4, checkpoint_every=1)) == pytest.approx(a, abs=1e-12)
    now = {s: 1.0 for s, _ in pairs}
    for _ in range(4):
        out = {s: sum(x == s for x, _ in pairs) for s, _ in pairs}
        nxt = {}
        for s, d in pairs:
            if s in now:
                nxt[d] = nxt.get(d, 0) + now[s] / out[s]
        now = {k: 0.15 + 0.85 * v for k, v in nxt.items()}
    assert a == pytest.approx(now, abs=1e-12)


def test_pagerank_spreads_hubs(spark):
    pairs = [(1, i) for i in range(2, 60)] + [(i, 1) for i in range(2, 60, 3)] + [(1, 5)] * 9 + [(7, 8), (8, 7)]
    edges = spark.createDataFrame(pairs, "src int, dst int")
    assert [tuple(r) for r in graph.hubs(edges, 10).collect()] == [(1, 7)]
    for form in ("damped", "raw"):
        want = ranks(graph.pagerank(edges, 4, form=form))
        assert ranks(graph.pagerank(edges, 4, form=form, hub=10, checkpoint_every=2)) == pytest.approx(want, abs=1e-12)


def test_edges_symmetric_distinct(spark, edges):
    want = {(2, 4), (4, 2), (7, 8), (8, 7), (3, 12), (12, 3), (7, 12), (12, 7)}
    once = graph.symmetric_distinct(edges)
    assert {tuple(r) for r in once.collect()} == want and once.count() == 8
    assert {tuple(r) for r in graph.symmetric_distinct(once).collect()} == want
    assert graph.symmetric_distinct(spark.createDataFrame([(5, 5)], "src int, dst int")).count() == 1


def test_adjacency_and_stats(spark, edges):
    doubled = edges.union(edges.filter("src = 12"))
    assert {r["src"]: r["dsts"] for r in graph.adjacency(doubled).collect()} == {2: [4], 3: [12], 7: [8, 12], 12: [3, 3, 7, 7]}
    assert tuple(graph.stats(edges).first()) == (6, 4, 6, 10)


def test_text_readers(spark, tmp_path):
    (tmp_path / "ok.txt").write_text("2 4\n7\t8  \n   \n12 3 extra\n")
    assert sorted(tuple(r) for r in text.edges(text.lines(spark, str(tmp_path / "ok.txt"), 3).filter("trim(value) != ''")).collect()) == [(2, 4), (7, 8), (12, 3)]
    got = text.tokens(text.lines(spark, str(tmp_path / "ok.txt")).filter("value NOT LIKE '%extra'"))
    assert sorted(r[0] for r in got.collect()) == [2, 4, 7, 8]


@pytest.mark.parametrize("line", ["", " 5 6", "5.0 1", "abc 1", "2147483648 1"])
def test_malformed_tokens_fail(spark, line):
    with pytest.raises(Exception, match="(?i)cast|malformed|overflow|invalid"):
        text.tokens(spark.createDataFrame([(line,)], "value string")).collect()


@pytest.mark.parametrize("line", ["", "   ", "7", "a 1"])
def test_malformed_edges_fail(spark, line):
    with pytest.raises(Exception, match="(?i)no edge|cast|invalid"):
        text.edges(spark.createDataFrame([(line,)], "value string")).collect()


def test_vector_lines(spark):
    df = spark.createDataFrame([("(9,, 1.5 ,,2,,3)",)], "value string")
    assert text.vectors(df, 2).first()["x"] == [1.5, 2.0]
    with pytest.raises(Exception, match="too few"):
        text.vectors(df, 4).collect()


def test_java_random():
    rng = generators.JavaRandom(42)
    assert [rng.next_int() for _ in range(3)] == [-1170105035, 234785527, -1360544799]
    rng = generators.JavaRandom(42)
    assert [rng.next_gaussian() for _ in range(4)] == pytest.approx([1.141905315473055, 0.919407948982788, -0.9498666368908959, -1.1069902863993377], abs=1e-12)
    golden = [0.4551273600657362, 0.36644694351969087, -0.38256108933468047, -0.4458430198517267, 0.33109790358914726, 0.8067445293443565, -0.2624341731773887, -0.44850386111659524, -0.07269284838169332, 0.5658035575800715]
    assert generators.initial_weights(10) == pytest.approx(golden, abs=1e-15)


def test_regression_golden(spark):
    w, points = generators.seeded_points(spark, 10, 2)
    assert logreg.fit(points, w, 1).tolist() == pytest.approx([1.2702659271710428, 1.3730309564428134], abs=1e-9)
    assert logreg.fit(points, logreg.fit(points, w, 15), 5).tolist() == pytest.approx([3.357858243703198, 4.5469131593629575], abs=1e-9)
    det = generators.deterministic_points(spark, 10, 2)
    assert logreg.fit(det, generators.deterministic_weights(2), 20).tolist() == pytest.approx([-0.9932466593504756, -0.8797274863309391], abs=1e-9)


def test_gradient_is_linear_in_rows_and_fails_on_bad_input(spark):
    _, points = generators.seeded_points(spark, 20, 3)
    w = [0.1, -0.2, 0.3]
    assert logreg.gradient(points.union(points), w) == pytest.approx(2 * logreg.gradient(points, w), abs=1e-9)
    with pytest.raises(Exception, match="components"):
        logreg.gradient(points, [0.0])
    with pytest.raises(ValueError, match="no points"):
        logreg.fit(points.limit(0), w, 1)
    m = logreg.margins(points, w).first()
    assert m["margin"] == pytest.approx(float(np.dot(m["x"], w)), abs=1e-12)


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in (0, 5)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, x array<double>")
    centers, moved = kmeans.fit(df, [x[0].tolist(), x[59].tolist()], 3)
    assert centers == pytest.approx(np.stack([x[:30].mean(0), x[30:].mean(0)]), abs=1e-9) and moved[-1] == pytest.approx(0, abs=1e-18)
    got = kmeans.assign(df, centers).collect()
    for r in got:
        d = ((np.array(r["x"]) - centers) ** 2).sum(1)
        assert r["k"] == int(d.argmin()) and r["d"] == pytest.approx(d.min(), abs=1e-9)
    far = [x[0].tolist(), [1e6, 1e6]]
    assert math.isnan(kmeans.fit(df, far, 1)[0][1][0]) and kmeans.fit(df, far, 1, empty="keep")[0][1].tolist() == [1e6, 1e6]
    tied = kmeans.assign(df.limit(1), [[1.0, 1.0], [1.0, 1.0]]).first()
    assert tied["k"] == 0
    with pytest.raises(ValueError, match="centers"):
        kmeans.first_centers(df, 61)


def test_trades(spark):
    t = generators.trades(spark, 1000)
    assert tuple(map(int, aggregates.trade_totals(t).first())) == (166167000, 166666500)
    big = spark.createDataFrame([(3 * 10**9, 4 * 10**9, "B"), (3 * 10**9, 4 * 10**9, None)], "price bigint, quantity bigint, side string")
    exact = 12 * 10**18
    assert tuple(map(int, aggregates.trade_totals(big).first())) == (exact, exact)
    assert aggregates.trade_totals(big, wrap=True).first()["buy_cost"] == (exact + 2**63) % 2**64 - 2**63
    assert tuple(map(int, aggregates.trade_totals(big.limit(0)).first())) == (0, 0)


def test_codes(spark):
    df = spark.createDataFrame([("XLON",), ("BHP",), (None,)], "c string")
    assert [r[0] for r in df.select(pack_code(F.col("c"))).collect()] == [1481396046, 1112035328, None]
    for bad in ("", "ABCDE"):
        with pytest.raises(Exception, match="1 to 4"):
            spark.createDataFrame([(bad,)], "c string").select(pack_code(F.col("c"))).collect()


def test_upserts(spark):
    puts = [(1, 1.0, None), (1, 1.1, None), (2, 2.0, 2000), (3, 3.0, 3000), (4, 4.0, 4000), (2, 2.1, None), (1, None, 1111), (2, None, 2222), (5, 5.0, None), (5, None, 5555), (6, 6.0, 6000), (6, 6.1, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(puts)], "seq int, key int, v1 double, v2 bigint")
    got = {r["key"]: (r["v1"], r["v2"]) for r in aggregates.upsert_latest(df, "key", "seq", ["v1", "v2"]).collect()}
    assert got == {1: (1.1, 1111), 2: (2.1, 2222), 3: (3.0, 3000), 4: (4.0, 4000), 5: (5.0, 5555), 6: (6.1, 6000)}


def test_counts_and_samples(spark):
    tokens = spark.createDataFrame([(x,) for p in SAMPLE for x in p], "token int")
    assert {r["token"]: r["n"] for r in aggregates.count_by(tokens, "token").collect()} == {2: 1, 3: 2, 4: 1, 7: 3, 8: 1, 12: 4}
    ids = spark.range(100)
    a = [r["id"] for r in aggregates.take_sample(ids, 10, 42, "id").collect()]
    assert len(set(a)) == 10 and a == [r["id"] for r in aggregates.take_sample(ids.repartition(7), 10, 42, "id").collect()]
    assert aggregates.take_sample(ids, 200, 42, "id").count() == 100


def test_command_line(spark, tmp_path):
    (tmp_path / "pr.txt").write_text("\n".join(f"{a} {b}" for a, b in SAMPLE) + "\n")
    run = lambda *a: cli.main([str(x) for x in a], spark)
    run("pagerank", tmp_path / "pr.txt", 1, tmp_path / "ranks")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "ranks")).collect())[0].startswith("(12,1.42")
    run("count", tmp_path / "pr.txt", tmp_path / "counts")
    assert "(12,4)" in [r[0] for r in spark.read.text(str(tmp_path / "counts")).collect()]
    run("symmetric", tmp_path / "pr.txt", tmp_path / "both", "--partitions", 2)
    assert spark.read.text(str(tmp_path / "both")).count() == 8
    run("generate", 3, 20, 2, tmp_path / "points")
    assert len(run("logreg", tmp_path / "points", 3, 2)["weights"]) == 3
    assert len(run("kmeans", tmp_path / "points", 3, 2, 1)["centers"]) == 2
    (tmp_path / "v.txt").write_text("(1,,2,,3)\n")
    run("vectors", tmp_path / "v.txt", 2, tmp_path / "vectors")
    assert spark.read.parquet(str(tmp_path / "vectors")).first()["x"] == [2.0, 3.0]
    assert json.dumps(run("trades", "--rows", 1000, "--runs", 1)["buy_cost"]) == "166167000"


def test_entry_registers_a_query_for_each_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "pagerank_transitions" in entry.queries()
