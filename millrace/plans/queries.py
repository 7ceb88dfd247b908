"""The registered queries over the star-schema tables, and the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.functions.codes import next_power_of_two, pack_code
from millrace.operators import aggregates, graph, kmeans, logreg
from millrace.runtime import scratch_path
from millrace.sources import generators, text

DIM, CLUSTERS = 64, 4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("int").alias("src"), F.col("l_suppkey").cast("int").alias("dst"))


def transition_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each event's user to the next event's."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id")
    after = events.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("next_id"))
    return events.join(after, "event_id").select(F.col("user_id").cast("int").alias("src"), F.col("next_id").cast("int").alias("dst"))


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.when(F.col("label") < 5, 1.0).otherwise(-1.0).alias("y"))


def start_weights() -> list[float]:
    return [0.01 * j - 0.3 for j in range(DIM)]


def _weights(spark: SparkSession, w) -> DataFrame:
    return spark.createDataFrame([(j, float(v)) for j, v in enumerate(w)], "j bigint, w double").select("j", F.round("w", 6).alias("w"))


def _ranks(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(F.col("id").cast("bigint").alias("id"), F.round(F.col("rank").cast("double"), digits).alias("rank"))


def pagerank_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(graph.pagerank(transition_edges(spark, sf_dir), 5))


def pagerank_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(graph.pagerank(part_supplier_edges(spark, sf_dir), 2))


def pagerank_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(graph.pagerank(transition_edges(spark, sf_dir), 3, form="raw"))


def pagerank_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-bit ranks: rounded coarsely, beside whether each is a number of 32 bits."""
    ranks = graph.pagerank(transition_edges(spark, sf_dir), 3, single=True)
    kind = ranks.schema["rank"].dataType.simpleString()
    return ranks.select(F.col("id").cast("bigint").alias("id"), F.round(F.col("rank").cast("double"), 3).alias("rank"), F.lit(kind).alias("kind"))


def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = graph.adjacency(part_supplier_edges(spark, sf_dir))
    return lists.select("src", F.array_join(F.col("dsts").cast("array<string>"), ",").alias("dsts"))


def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.out_degree(part_supplier_edges(spark, sf_dir))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(part_supplier_edges(spark, sf_dir))


def edges_symmetric_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symmetric_distinct(part_supplier_edges(spark, sf_dir))


def int_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_by(_table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("token")), "token")


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \t\n\f\r]+")).alias("token")).filter("token != ''")
    return aggregates.count_by(tokens, "token")


def edge_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as lines and parsed from them."""
    written = part_supplier_edges(spark, sf_dir).select(F.concat(F.col("src").cast("string"), F.lit("  \t"), F.col("dst").cast("string"), F.lit(" extra ")).alias("value"))
    return text.edges(written).groupBy("src").agg(F.count("*").alias("n"), F.sum("dst").alias("dst_sum"))


def vector_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines (id,,v1,,v2,,v3) parsed to vectors of two components."""
    written = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("("), F.concat_ws(",,", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.concat(F.lit(" "), F.col("o_orderkey").cast("string")), F.lit("7")), F.lit(")")).alias("value"))
    return text.vectors(written, 2).select(F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


def trade_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("price"), F.col("l_quantity").cast("bigint").alias("quantity"), F.when(F.col("l_linestatus") == "O", "B").otherwise("S").alias("side"))
    return aggregates.trade_totals(trades).select(F.col("buy_cost").cast("bigint").alias("buy_cost"), F.col("sell_cost").cast("bigint").alias("sell_cost"))


def lr_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, logreg.fit(labelled_vectors(spark, sf_dir), start_weights(), 3))


def lr_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, logreg.fit(generators.deterministic_points(spark, 1000, 8), generators.deterministic_weights(8), 3))


def lr_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, logreg.gradient(labelled_vectors(spark, sf_dir), start_weights())).withColumnRenamed("w", "g")


def lr_predict_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logreg.margins(labelled_vectors(spark, sf_dir), start_weights()).select("id", F.round("margin", 6).alias("margin"), "predicted")


def _centers(points: DataFrame) -> list[list[float]]:
    return kmeans.first_centers(points, CLUSTERS)


def kmeans_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = labelled_vectors(spark, sf_dir)
    centers, _ = kmeans.fit(points, _centers(points), 2)
    return spark.createDataFrame([(k, j, float(v)) for k, c in enumerate(centers) for j, v in enumerate(c)], "k bigint, j bigint, c double").select("k", "j", F.round("c", 6).alias("c"))


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = labelled_vectors(spark, sf_dir)
    return kmeans.assign(points, _centers(points)).select("id", F.col("k").cast("bigint").alias("k"), F.round("d", 6).alias("d"))


def kmeans_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = labelled_vectors(spark, sf_dir)
    _, moved = kmeans.fit(points, _centers(points), 1)
    return spark.createDataFrame([(moved[0],)], "delta double").select(F.round("delta", 6).alias("delta"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("event_type"))
    return aggregates.upsert_latest(events, "user_id", "event_id", ["value", "event_type"])


def gen_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.trades(spark, 100_000)


def gen_points_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.deterministic_points(spark, 1000, 4).select("id", F.posexplode("x").alias("j", "v"), "y").select("id", F.col("j").cast("bigint").alias("j"), F.round("v", 9).alias("v"), "y")


def pack_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _table(spark, sf_dir, "nation").select("n_nationkey", F.substring("n_name", 1, 4).alias("code"))
    return codes.select("n_nationkey", "code", pack_code(F.col("code")).alias("packed"))


def take_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.take_sample(_table(spark, sf_dir, "embeddings").select("vec_id", "label"), 20, 42, "vec_id")


def trade_totals_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals beyond 64 bits, as integers that overflow silently hold them."""
    trades = _table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 10**12).alias("price"), (F.col("l_quantity").cast("bigint") * 1000).alias("quantity"), F.when(F.col("l_linestatus") == "O", "B").otherwise("S").alias("side"))
    return aggregates.trade_totals(trades, wrap=True)


def edge_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges in both directions, written as lines to the shared folder and read from there."""
    path = scratch_path(spark, "edges")
    text.write_edges(graph.symmetric_distinct(part_supplier_edges(spark, sf_dir)), path)
    return text.edges(text.lines(spark, path))


def pair_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as lines (token,n)."""
    path = scratch_path(spark, "pairs")
    text.write_pairs(int_count(spark, sf_dir), path, "token", "n")
    return text.lines(spark, path)


def points_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled points, stored and read with a check of their dimension."""
    path = scratch_path(spark, "points")
    text.write_points(labelled_vectors(spark, sf_dir), path)
    read = text.points(spark, path, DIM).select("id", F.posexplode("x").alias("j", "v"), "y")
    return read.select("id", F.col("j").cast("bigint").alias("j"), F.round("v", 6).alias("v"), "y")


def gen_points_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.seeded_points(spark, 1000, 4)[1].select("id", F.posexplode("x").alias("j", "v"), "y")


def gen_points_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = generators.blob_points(spark, 1000, 8, 4).select("id", F.posexplode("x").alias("j", "v"), "y")
    return points.select("id", F.col("j").cast("bigint").alias("j"), F.round("v", 6).alias("v"), "y")


def gen_points_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = generators.blob_points(spark, 500, 4, 3, seed=7, labelled=False).select("id", F.posexplode("x").alias("j", "v"))
    return points.select("id", F.col("j").cast("bigint").alias("j"), F.round("v", 6).alias("v"))


def random_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.random_labels(_table(spark, sf_dir, "embeddings").select("vec_id"), 42, "vec_id")


def _token_lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder of text with a line of integers per order line."""
    path = scratch_path(spark, "tokens")
    numbers = [F.col(c).cast("bigint").cast("string") for c in ("l_partkey", "l_suppkey", "l_quantity")]
    _table(spark, sf_dir, "lineitem").select(F.concat_ws("  ", *numbers).alias("value")).write.text(path)
    return path


def token_text_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers of text lines, counted."""
    return aggregates.count_by(text.tokens(text.lines(spark, _token_lines(spark, sf_dir))), "token")


def text_scan_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text dealt over six partitions: how many there are, and how many lines they hold."""
    dealt = text.lines(spark, _token_lines(spark, sf_dir), 6).groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    return dealt.agg(F.count("*").alias("parts"), F.sum("n").alias("lines"))


def vector_space_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of numbers between white space, of any length, as vectors."""
    written = _table(spark, sf_dir, "orders").select(F.concat_ws(" ", F.col("o_orderkey").cast("string"), (F.col("o_custkey") / 4).cast("string"), F.lit("-1.5e2")).alias("value"))
    return text.space_vectors(written).select(F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), F.col("x")[2].alias("x2"), F.size("x").alias("n"))


def vector_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x + x / 2, by component."""
    x = F.col("x")
    summed = labelled_vectors(spark, sf_dir).select("id", F.posexplode(vectors.add(x, vectors.scale(x, 0.5))).alias("j", "v"))
    return summed.select("id", F.col("j").cast("bigint").alias("j"), F.round("v", 6).alias("v"))


def vector_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distance of each vector from the starting weights."""
    d = vectors.squared_distance(F.col("x"), vectors.literal(start_weights()))
    return labelled_vectors(spark, sf_dir).select("id", F.round(d, 6).alias("d"))


def upsert_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with their places in a scan in order of insertion."""
    first = aggregates.insertion_order(_table(spark, sf_dir, "events"), "user_id", "event_id")
    return first.select("user_id", "first_at")


def power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", next_power_of_two(F.col("p_partkey")).alias("capacity"))


def initial_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(j, w) for j, w in enumerate(generators.initial_weights(10))], "j bigint, w double").select("j", F.round("w", 12).alias("w"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    pagerank_transitions, pagerank_parts, pagerank_raw, pagerank_float, adjacency_lists, out_degree, graph_stats, edges_symmetric_distinct, int_count, token_count,
    edge_text_parse, vector_text_parse, trade_totals, lr_embeddings, lr_deterministic, lr_gradient, lr_predict_margin, kmeans_embeddings, kmeans_assign, kmeans_delta,
    upsert_latest, gen_trades, gen_points_det, pack_codes, take_sample, trade_totals_wrapped, edge_text_round_trip, pair_text_lines, points_round_trip,
    gen_points_seeded, gen_points_blobs, gen_points_unlabelled, random_labels, token_text_count, text_scan_partitions, vector_space_parse, vector_arithmetic,
    vector_distance, upsert_scan, power_of_two, initial_weights,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_PARTS = "SELECT l_partkey::INTEGER AS src, l_suppkey::INTEGER AS dst FROM lineitem"
_TRANSITIONS = "SELECT a.user_id::INTEGER AS src, b.user_id::INTEGER AS dst FROM events a JOIN events b ON b.event_id = a.event_id + 1"
_VECTORS = f"SELECT vec_id AS id, unnest(range({DIM})) AS j, unnest(embedding)::DOUBLE AS v, CASE WHEN label < 5 THEN 1.0e0 ELSE -1.0e0 END AS y FROM embeddings"
_PACK = "(ascii({0}) * 16777216 + CASE WHEN length({0}) > 1 THEN ascii(substr({0}, 2, 1)) ELSE 0 END * 65536 + CASE WHEN length({0}) > 2 THEN ascii(substr({0}, 3, 1)) ELSE 0 END * 256 + CASE WHEN length({0}) > 3 THEN ascii(substr({0}, 4, 1)) ELSE 0 END)::INTEGER"


def _pagerank_sql(edges: str, iterations: int, raw: bool = False, digits: int = 6) -> str:
    ctes = [f"e AS ({edges})", "d AS (SELECT src, count(*) AS n FROM e GROUP BY src)", "r0 AS (SELECT DISTINCT src AS id, 1.0e0 AS rank FROM e)"]
    for k in range(iterations):
        read = "(rank * 0.85e0 + 0.15e0)" if raw and k else "rank"
        total = f"sum({read} / n)" if raw else f"0.15e0 + 0.85e0 * sum({read} / n)"
        ctes.append(f"r{k + 1} AS (SELECT dst AS id, {total} AS rank FROM e JOIN d USING (src) JOIN r{k} ON id = src GROUP BY dst)")
    return f"WITH {', '.join(ctes)} SELECT id::BIGINT AS id, round(rank, {digits}) AS rank FROM r{iterations}"


def _lr_sql(points: str, weights: str, steps: int, gradient_only: bool = False) -> str:
    """points: id, j, v, y; weights: j, w."""
    ctes = [f"p AS ({points})", f"w0 AS ({weights})"]
    for k in range(steps):
        ctes.append(f"m{k} AS (SELECT id, any_value(y) AS y, sum(v * w) AS m FROM p JOIN w{k} USING (j) GROUP BY id)")
        ctes.append(f"g{k} AS (SELECT j, sum((1 / (1 + exp(-m{k}.y * m)) - 1) * m{k}.y * v) AS g FROM p JOIN m{k} USING (id) GROUP BY j)")
        ctes.append(f"w{k + 1} AS (SELECT j, w - g AS w FROM w{k} JOIN g{k} USING (j))")
    end = f"SELECT j::BIGINT AS j, round(g, 6) AS g FROM g{steps - 1}" if gradient_only else f"SELECT j::BIGINT AS j, round(w, 6) AS w FROM w{steps}"
    return f"WITH {', '.join(ctes)} {end}"


def _kmeans_ctes(rounds: int) -> list[str]:
    ctes = [f"p AS ({_VECTORS})", f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings QUALIFY k < {CLUSTERS})", "c0 AS (SELECT k, j, v AS c FROM p JOIN f ON id = vec_id)"]
    for i in range(rounds):
        ctes.append(f"d{i} AS (SELECT id, k, sum((v - c) * (v - c)) AS d FROM p JOIN c{i} USING (j) GROUP BY id, k)")
        ctes.append(f"a{i} AS (SELECT id, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, k) = 1)")
        ctes.append(f"c{i + 1} AS (SELECT k, j, avg(v) AS c FROM p JOIN a{i} USING (id) GROUP BY k, j)")
    return ctes


_LOW = "((({0}) % 18446744073709551616::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT)"
_WRAP = "(CASE WHEN {0} >= 9223372036854775808::HUGEINT THEN {0} - 18446744073709551616::HUGEINT ELSE {0} END)::BIGINT"
_COST = "sum(CASE WHEN l_linestatus {0} 'O' THEN l_partkey::HUGEINT * 1000000000000 * l_quantity::BIGINT * 1000 ELSE 0 END)::HUGEINT"
_START = f"SELECT j, 0.01e0 * j - 0.3e0 AS w FROM range({DIM}) t(j)"
_DET_POINTS = "SELECT i AS id, j, i * 0.000013e0 + j * 0.00079e0 + (i % 2) * 0.00007e0 AS v, (i % 2)::DOUBLE AS y FROM range({n}) a(i), range({dim}) b(j)"

#: A number in (0, 1) of an id, a seed and the place of eight digits in their digest.
_UNIFORM = "((('0x' || substr(md5('{1}:' || {0}), {2}, 8))::UBIGINT::DOUBLE + 0.5e0) / 4294967296e0)"


def _blobs_sql(n: int, dim: int, seed: int, label: str) -> str:
    draw = "id || ':' || j"
    normal = f"sqrt(-2.0e0 * ln({_UNIFORM.format(draw, seed, 1)})) * cos(2 * 3.141592653589793e0 * {_UNIFORM.format(draw, seed, 9)})"
    return f"SELECT id, j, round({normal} + 0.7e0 * (CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END), 6) AS v{label} FROM range({n}) a(id), range({dim}) b(j)"


ORACLE_SQL = {
    "pagerank_transitions": _pagerank_sql(_TRANSITIONS, 5),
    "pagerank_parts": _pagerank_sql(_PARTS, 2),
    "pagerank_raw": _pagerank_sql(_TRANSITIONS, 3, raw=True),
    "pagerank_float": f"SELECT *, 'float' AS kind FROM ({_pagerank_sql(_TRANSITIONS, 3, digits=3)})",
    "adjacency_lists": f"SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS dsts FROM ({_PARTS}) GROUP BY src",
    "out_degree": f"SELECT src, count(*) AS out_degree FROM ({_PARTS}) GROUP BY src",
    "graph_stats": f"WITH e AS ({_PARTS}) SELECT count(*) AS edges, count(DISTINCT src) AS sources, (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS ids, count(*) + count(DISTINCT src) AS cells FROM e",
    "edges_symmetric_distinct": f"WITH e AS ({_PARTS}) SELECT src, dst FROM e UNION SELECT dst, src FROM e",
    "int_count": "SELECT l_quantity::INTEGER AS token, count(*) AS n FROM lineitem GROUP BY 1",
    "token_count": r"SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \t\n\f\r]+')) AS token FROM documents) WHERE token <> '' GROUP BY token",
    "edge_text_parse": f"SELECT src, count(*) AS n, sum(dst)::BIGINT AS dst_sum FROM ({_PARTS}) GROUP BY src",
    "vector_text_parse": "SELECT o_custkey::DOUBLE AS x0, o_orderkey::DOUBLE AS x1 FROM orders",
    "trade_totals": "SELECT sum(CASE WHEN l_linestatus = 'O' THEN l_partkey * l_quantity::BIGINT ELSE 0 END)::BIGINT AS buy_cost, sum(CASE WHEN l_linestatus = 'O' THEN 0 ELSE l_partkey * l_quantity::BIGINT END)::BIGINT AS sell_cost FROM lineitem",
    "lr_embeddings": _lr_sql(_VECTORS, _START, 3),
    "lr_deterministic": _lr_sql(_DET_POINTS.format(n=1000, dim=8), "SELECT j, 2 * j * 0.037e0 - 1 AS w FROM range(8) t(j)", 3),
    "lr_gradient": _lr_sql(_VECTORS, _START, 1, gradient_only=True),
    "lr_predict_margin": f"WITH p AS ({_VECTORS}), w AS ({_START}) SELECT id, round(sum(v * w), 6) AS margin, CASE WHEN sum(v * w) >= 0 THEN 1.0e0 ELSE -1.0e0 END AS predicted FROM p JOIN w USING (j) GROUP BY id",
    "kmeans_embeddings": f"WITH {', '.join(_kmeans_ctes(2))} SELECT k::BIGINT AS k, j::BIGINT AS j, round(c, 6) AS c FROM c2",
    "kmeans_assign": f"WITH {', '.join(_kmeans_ctes(1))} SELECT id, k::BIGINT AS k, round(d, 6) AS d FROM a0",
    "kmeans_delta": f"WITH {', '.join(_kmeans_ctes(1))} SELECT round(sum((a.c - b.c) * (a.c - b.c)), 6) AS delta FROM c0 a JOIN c1 b USING (k, j)",
    "upsert_latest": "SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_id % 3 <> 0) AS value, arg_max(event_type, event_id) FILTER (WHERE event_id % 2 = 0) AS event_type FROM events GROUP BY user_id",
    "gen_trades": "SELECT i AS trade_id, 1::BIGINT AS client_id, 1481396046 AS venue_code, 1112035328 AS instrument_code, i AS price, i AS quantity, CASE WHEN i % 2 = 0 THEN 'B' ELSE 'S' END AS side FROM range(100000) t(i)",
    "gen_points_det": f"SELECT id, j, round(v, 9) AS v, y FROM ({_DET_POINTS.format(n=1000, dim=4)})",
    "trade_totals_wrapped": f"SELECT {_WRAP.format(_LOW.format('b'))} AS buy_cost, {_WRAP.format(_LOW.format('s'))} AS sell_cost FROM (SELECT {_COST.format('=')} AS b, {_COST.format('<>')} AS s FROM lineitem)",
    "edge_text_round_trip": f"WITH e AS ({_PARTS}) SELECT src, dst FROM e UNION SELECT dst, src FROM e",
    "pair_text_lines": "SELECT '(' || l_quantity::INTEGER || ',' || count(*) || ')' AS value FROM lineitem GROUP BY l_quantity::INTEGER",
    "points_round_trip": f"SELECT id, j::BIGINT AS j, round(v, 6) AS v, y FROM ({_VECTORS})",
    "take_sample": "SELECT vec_id, label FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 20",
    "random_labels": f"SELECT vec_id, CASE WHEN {_UNIFORM.format('vec_id', 42, 1)} < 0.2e0 THEN 1.0e0 ELSE -1.0e0 END AS y FROM embeddings",
    "gen_points_blobs": _blobs_sql(8000, 4, 42, ", CASE WHEN id % 2 = 0 THEN -1.0e0 ELSE 1.0e0 END AS y"),
    "gen_points_unlabelled": _blobs_sql(2000, 3, 7, ""),
    "token_text_count": "SELECT token, count(*) AS n FROM (SELECT unnest([l_partkey::INTEGER, l_suppkey::INTEGER, l_quantity::INTEGER]) AS token FROM lineitem) GROUP BY token",
    "text_scan_partitions": "SELECT 6::BIGINT AS parts, count(*) AS lines FROM lineitem",
    "vector_space_parse": "SELECT o_orderkey::DOUBLE AS x0, o_custkey / 4.0e0 AS x1, -150.0e0 AS x2, 3 AS n FROM orders",
    "vector_arithmetic": f"SELECT id, j::BIGINT AS j, round(v + v * 0.5e0, 6) AS v FROM ({_VECTORS})",
    "vector_distance": f"WITH p AS ({_VECTORS}), w AS ({_START}) SELECT id, round(sum((v - w) * (v - w)), 6) AS d FROM p JOIN w USING (j) GROUP BY id",
    "upsert_scan": "SELECT user_id, min(event_id) AS first_at FROM events GROUP BY user_id",
    "power_of_two": "SELECT p_partkey, CASE WHEN p_partkey < 2 THEN 1 ELSE (1::BIGINT << length(bin(p_partkey - 1))) END AS capacity FROM part",
    # fixed values of the documented generator with seed 42
    "initial_weights": "SELECT j, round(w, 12) AS w FROM (VALUES (0::BIGINT, 0.4551273600657362e0), (1, 0.36644694351969087e0), (2, -0.38256108933468047e0), (3, -0.4458430198517267e0), (4, 0.33109790358914726e0), (5, 0.8067445293443565e0), (6, -0.2624341731773887e0), (7, -0.44850386111659524e0), (8, -0.07269284838169332e0), (9, 0.5658035575800715e0)) t(j, w)",
    "pack_codes": f"SELECT n_nationkey, code, {_PACK.format('code')} AS packed FROM (SELECT n_nationkey, substr(n_name, 1, 4) AS code FROM nation)",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
