"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Texts are split into words once and stored. Every training token becomes a stored posting (term, document, position),
in files that are sorted by term, each over the documents of one task, so that building the index shuffles nothing and
a term's postings stand together in each. Each window of a benchmark item names its two rarest terms by
corpus frequency; the rarest one's postings are joined with the other one's nearby in the same document. Places where
both stand at their offsets may hold the window, places where they are merely close may hold its words nearby; both are
verified in the stored words. A window with a term that the corpus lacks is dropped before anything is fetched.

A window is *near* a place if all its words stand, in any order, within NEAR times as many consecutive words.

What is broadcast (vocabulary, rarest terms, windows, documents to verify) is counted first; beyond BROADCAST_ROWS
the same join is left to the planner, which shuffles it.

Defined results: a null text has no words; an item without words has no windows; rows that repeat give equal rows
of results; a null item_id is an item whose name is the empty string; texts of any length are taken whole; an empty
table of documents gives no rows, an empty benchmark no hits; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, ascii_lower, cut
from millrace.llm.common import small as small_rows

WINDOW, NEAR = 10, 2
#: Everything that is in no word, once A-Z are lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BREAKS), ""), F.array().cast("array<string>"))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return small_rows(df, most)


def split_once(docs: DataFrame, id_column: str, text_column: str, scratch: Scratch) -> DataFrame:
    """(doc, id, th, n, w), stored: each row's number, its text's XXH64, its number of words and its words."""
    # explode of one array: the words are made once, not again for their number
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_column).alias("id"), F.xxhash64(text_column).alias("th"), F.explode(F.array(words(F.col(text_column)))).alias("w"))
    return scratch.store(rows.select("doc", "id", "th", F.size("w").cast("bigint").alias("n"), "w"), "words")


def store_postings(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(term, doc, pos) of every word of all texts, stored. texts: as `split_once` makes them."""
    return scratch.store(texts.select("doc", F.posexplode("w").alias("pos", "term")).select("term", "doc", "pos").sortWithinPartitions("term", "doc", "pos"), "postings")


def windows(benchmark: DataFrame, id_column: str, text_column: str, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(wid, win array<string>): each distinct window; (wid, item): the items that have it."""
    items = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), F.explode(F.array(words(F.col(text_column)))).alias("w"))
    n = F.size("w")
    slices = F.when(n >= window, F.transform(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))), lambda i: F.slice("w", i + 1, window))).otherwise(F.array("w"))
    pairs = cut(items.filter(n > 0).select("item", F.explode(slices).alias("win")).distinct())
    wins = cut(pairs.select("win").distinct().select(F.monotonically_increasing_id().alias("wid"), "win"))
    return wins, cut(pairs.join(wins, "win").select("wid", "item"))


def term_counts(index: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, n): how often the corpus has each term of the vocabulary; terms that it lacks are absent."""
    terms, few = index.select("term"), small(vocabulary)
    if few is not vocabulary:
        return terms.join(few, "term").groupBy("term").agg(F.count("*").alias("n"))
    # a shuffled join comes behind the counting, so that a frequent term is one row of it
    return terms.groupBy("term").agg(F.count("*").alias("n")).join(vocabulary, "term")


def rarest(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """(wid, size, t1, o1, t2, o2): the two rarest terms of each window and their offsets in it; t2 is null where all its words are one.

    Windows with a term that has no count can't occur and are left out.
    """
    spread = wins.select("wid", F.size("win").alias("size"), F.posexplode("win").alias("off", "term")).join(counts, "term")
    ranked = spread.groupBy("wid", "size").agg(F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("r")).filter(F.size("r") == F.col("size"))
    a, rest = F.col("r")[0], F.filter("r", lambda x: x["term"] != F.col("r")[0]["term"])
    return ranked.select("wid", "size", a["term"].alias("t1"), a["off"].alias("o1"), F.get(rest, F.lit(0)).alias("b")).select("wid", "size", "t1", "o1", F.col("b.term").alias("t2"), F.col("b.off").alias("o2"))


def candidates(index: DataFrame, rare: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, wid, p, aligned): places p of t1 with t2 close by, and whether t2 stands at its offset from there."""
    terms = cut(rare.select(F.explode(F.array("t1", "t2")).alias("term")).filter("term IS NOT NULL").distinct())
    fetched = index.join(small(terms), "term", "left_semi")
    ones = fetched.join(small(rare), F.col("term") == F.col("t1")).select("doc", F.col("pos").alias("p"), "wid", "size", "o1", "t2", "o2")
    alone = ones.filter("t2 IS NULL").select("doc", "wid", "p", F.lit(True).alias("aligned"))
    width = NEAR * window  # no window's words reach further: partners stand in the same or a neighbouring stretch
    stretch = lambda c: F.floor(F.col(c) / width)
    first = ones.filter("t2 IS NOT NULL").withColumn("near", F.explode(F.array(stretch("p") - 1, stretch("p"), stretch("p") + 1)))
    second = fetched.select(F.col("doc").alias("doc2"), F.col("term").alias("term2"), F.col("pos").alias("p2"), stretch("pos").alias("at"))
    met = first.join(second, (F.col("doc") == F.col("doc2")) & (F.col("t2") == F.col("term2")) & (F.col("near") == F.col("at"))).filter(F.abs(F.col("p2") - F.col("p")) < NEAR * F.col("size"))
    return alone.union(met.groupBy("doc", "wid", "p").agg(F.max(F.col("p2") - F.col("p") == F.col("o2") - F.col("o1")).alias("aligned")))


def verified(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, n_hit, hits array<struct<wid, exact>>): the windows that stand in a document, or near a place of it.

    found: doc, found array<struct<p, aligned, o1, wid, win>>, stored.
    """
    keys, d = found.select(F.col("doc").alias("k")), texts.select("doc", "w")
    few = small(keys)
    if few is not keys:  # the texts to verify are few: only they are shuffled
        d = d.join(few, F.col("doc") == F.col("k"), "left_semi")
    exact = (
        "transform(found, c -> struct(c.wid AS wid, c.p AS p, c.p - c.o1 AS s, c.win AS win,"
        " c.aligned AND c.p >= c.o1 AND slice(w, greatest(c.p - c.o1, 0) + 1, size(c.win)) = c.win AS exact))"
    )
    # all words are in the widest stretch around the place, and in one of those that include it
    around = f"slice(w, greatest(c.p - {NEAR} * size(c.win) + 1, 0) + 1, {2 * NEAR} * size(c.win))"
    some = f"exists(sequence(greatest(c.p - {NEAR} * size(c.win) + 1, 0), c.p), s -> size(array_except(c.win, slice(w, s + 1, {NEAR} * size(c.win)))) = 0)"
    near = f"filter(places, c -> c.exact OR (size(array_except(c.win, {around})) = 0 AND {some}))"
    # overlapping occurrences hit a word once: sorted intervals, each counted beyond the end of those before
    n_hit = "aggregate(array_sort(transform(filter(places, c -> c.exact), c -> struct(c.s AS s, c.s + size(c.win) AS e))), struct(0 AS n, 0 AS end), (a, h) -> struct(a.n + greatest(0, h.e - greatest(h.s, a.end)) AS n, greatest(a.end, h.e) AS end), a -> CAST(a.n AS BIGINT))"
    at_places = d.join(found, "doc").select("doc", "w", F.expr(exact).alias("places"))
    marked = at_places.select("doc", F.expr(n_hit).alias("n_hit"), F.expr(f"array_distinct(transform({near}, c -> struct(c.wid AS wid, c.exact AS exact)))").alias("hits"))
    return marked.filter(F.size("hits") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW, with_key: bool = False) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256, contaminated and n_near of every row of docs; with_key adds th, its text's XXH64.

    n_near: how many items have a window that stands in the text or near a place of it.
    """
    wins, win_items = windows(benchmark, item_column, item_text, window)
    kept, scratch = Scratch(docs.sparkSession), Scratch(docs.sparkSession)  # what the result reads, and what it takes to get there
    texts = split_once(docs, id_column, text_column, kept)
    index = store_postings(texts, scratch)
    rare = cut(rarest(wins, cut(term_counts(index, cut(wins.select(F.explode("win").alias("term")).distinct())))))
    with_window = candidates(index, rare, window).join(small(rare.select("wid", "o1").join(wins, "wid")), "wid")
    found = cut(with_window.groupBy("doc").agg(F.collect_list(F.struct("p", "aligned", "o1", "wid", "win")).alias("found")))
    hits = cut(verified(texts, found))
    scratch.discard()
    item = F.col("item")
    per_item = hits.select("doc", F.explode("hits").alias("h")).select("doc", "h.wid", "h.exact").join(small(win_items), "wid")
    per_doc = per_item.groupBy("doc").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), item))).alias("items"), F.size(F.collect_set(item)).cast("bigint").alias("n_near"))
    of_doc = per_doc.join(hits.select("doc", "n_hit"), "doc").withColumnRenamed("doc", "h_doc")
    rows = texts.select("doc", "id", "th", "n").join(of_doc, F.col("doc") == F.col("h_doc"), "left")
    names, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return rows.select(
        F.col("id").alias(id_column), F.col("n").alias("n_words"), n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), *["th"] * with_key,
    )


def proximity(docs: DataFrame, queries: DataFrame, id_column: str, text_column: str, query_column: str, query_text: str, slop: int) -> DataFrame:
    """(query, id, first, places): for each query and document, the places of the query's rarest term that have all of the
    query's other terms at most `slop` words away, in order, and the first of them. A query without words, or with a term that no document has, matches nothing."""
    terms = cut(queries.select(F.col(query_column).alias("query"), F.explode(F.array_distinct(words(F.col(query_text)))).alias("term")))
    scratch = Scratch(docs.sparkSession)
    texts = split_once(docs, id_column, text_column, scratch)
    index = store_postings(texts, scratch)
    counts = term_counts(index, cut(terms.select("term").distinct()))
    ranked = terms.join(counts, "term", "left").groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("r")).filter("r[0].n > 0")
    wanted = cut(ranked.select("query", F.size("r").alias("wanted"), F.col("r")[0]["term"].alias("rarest"), F.explode("r.term").alias("term")))
    lists = index.join(small(wanted), "term").withColumn("at", F.floor(F.col("pos") / (slop + 1)))
    first = lists.filter("term = rarest").select("query", "doc", "wanted", F.col("pos").alias("p"), F.explode(F.array(F.col("at") - 1, "at", F.col("at") + 1)).alias("near"))
    others = lists.filter("term != rarest").select(F.col("query").alias("q"), F.col("doc").alias("d"), "term", "pos", "at")
    met = first.join(others, (F.col("query") == F.col("q")) & (F.col("doc") == F.col("d")) & (F.col("near") == F.col("at")), "left")
    close = F.when(F.abs(F.col("pos") - F.col("p")) <= slop, F.col("term"))
    per_place = met.groupBy("query", "doc", "p", "wanted").agg(F.count_distinct(close).alias("n")).filter("n = wanted - 1")
    per_doc = per_place.groupBy("query", "doc").agg(F.min("p").alias("first"), F.sort_array(F.collect_set("p")).alias("places"))
    return per_doc.join(texts.select("doc", "id"), "doc").select("query", F.col("id").alias(id_column), "first", "places")


def oracle_sql(window: int = WINDOW) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut_words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '{BREAKS}'), lambda x: x <> '')"
    return f"""
        WITH d AS (SELECT doc_id, {cut_words} AS w FROM documents),
        b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {cut_words} AS w FROM benchmark),
        win AS (SELECT DISTINCT item, least(len(w), {window}) AS n, array_to_string(w[i : i + least(len(w), {window}) - 1], ' ') AS k
                FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
        gram AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
                 FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
        occ AS (SELECT DISTINCT gram.doc_id, i, gram.n, item FROM gram JOIN win ON gram.k = win.k AND gram.n = win.n),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id),
        word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM d),
        freq AS (SELECT t, count(*) AS f FROM word GROUP BY t),
        term AS (SELECT DISTINCT k, n, unnest(string_split(k, ' ')) AS t FROM win),
        least_ AS (SELECT k, n, arg_min(t, f) AS t, list(t) AS terms FROM term LEFT JOIN freq USING (t) GROUP BY k, n HAVING count(f) = count(*)),
        spot AS MATERIALIZED (SELECT doc_id, i, k, n, terms FROM word JOIN least_ USING (t)),
        close AS (SELECT DISTINCT doc_id, k, n FROM (SELECT spot.*, w[greatest(1, i - {NEAR * window - 1}) : i + {NEAR * window - 1}] AS around FROM spot JOIN d USING (doc_id))
                  WHERE list_has_all(around, terms) AND len(list_filter(range(greatest(1, least(i, {NEAR * window}) - {NEAR} * n + 1), least(i, {NEAR * window}) + 1), lambda s: list_has_all(around[s : s + {NEAR} * n - 1], terms))) > 0),
        near AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM close JOIN win USING (k, n) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)"""
