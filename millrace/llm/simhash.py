"""SimHash near-duplicates, found with covering locality-sensitive hashing.

Every fingerprint bit gets a nonzero (radius + 1)-bit vector; table v keeps the bits whose vector has an odd
product with v. The vectors of at most `radius` differing bits leave some v != 0 orthogonal to all of them, and
in that table the two fingerprints agree: every pair within the radius collides somewhere, none is missed.

Work is on distinct fingerprints. A bucket (the bits kept, their values) of at most BUCKET members yields the
links of a spanning forest. A larger bucket is covered again over the bits that it leaves free, until it is
small. With 2**radius free bits or more, each table keeps one of them at least, so this ends; with fewer, a bucket
has fewer than 2**(2**radius) members (128 at radius 3) and yields its forest, or, with at most `radius` of them,
links of all members to one. No bucket yields all its pairs.

Rows come back to their fingerprint's component through (fingerprint, salt) pairs, a salt being a hash of the row's
id, so the rows of one fingerprint, however many, are dealt over SALTS places.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; equal texts link;
repeated rows stay; a null doc_id never becomes a component_id unless its component has no other id (then null);
texts of any length are taken whole, 32,768 shingles at a time; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, ship, slices
from millrace.llm.components import components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Members up to which a bucket is compared in one task.
BUCKET = 256
#: Places over which the rows of one fingerprint are dealt.
SALTS = 1024
ALL = (1 << BITS) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if over half of the shingles' XXH64 have it."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z, and white space of ASCII
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    totals = np.zeros(BITS, np.int64)
    for lo in range(0, n, 1 << 15):
        hi = min(n, lo + (1 << 15))
        h = np.fromiter((digest(b" ".join(words[i : i + shingle]), SEED) for i in range(lo, hi)), np.uint64, hi - lo)
        totals += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(totals * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, fp): the fingerprint as the signed long with its bits."""
    ship(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            fp = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[id_column, "fp"])

    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, fp bigint")


def covering_masks(kept: int = 0, radius: int = RADIUS) -> list[int]:
    """Per table, the bits kept: those of `kept`, and of the others those whose vector is odd with the table's."""
    free = [i for i in range(BITS) if not kept >> i & 1]
    size = (1 << radius + 1) - 1
    return [kept | sum(1 << b for j, b in enumerate(free) if ((j % size + 1) & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join what the pairs within the radius join, without a cycle."""
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, bits = [], fps.view(np.uint64)  # of a negative number, bitwise_count counts the absolute value's bits
    for i in range(1, len(fps)):
        for j in np.flatnonzero(np.bitwise_count(bits[:i] ^ bits[i]) <= radius).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out.append((int(fps[i]), int(fps[j])))
    return out


def _bucket_links(members: DataFrame, radius: int) -> DataFrame:
    """Links inside small buckets; members: mask, key, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [p for x in batch.column(0).to_pylist() for p in forest(np.array(sorted(x), np.int64), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    grouped = members.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
    return grouped.select("fps").mapInArrow(run, "a bigint, b bigint")


def _refined(members: DataFrame, radius: int) -> DataFrame:
    """Members of large buckets, dealt out to the tables that cover the bits which their bucket leaves free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, np.ndarray] = {}
        for batch in batches:
            mask, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for m in np.unique(mask).tolist():
                if m not in cache:
                    cache[m] = np.array([_signed(x) for x in covering_masks(m & ALL, radius)], np.int64)
                own = fp[mask == m]
                masks = np.repeat(cache[m], len(own))
                fps = np.tile(own, len(cache[m]))
                yield pa.RecordBatch.from_arrays([pa.array(masks), pa.array(masks & fps), pa.array(fps)], names=["mask", "key", "fp"])

    return members.select("mask", "fp").mapInArrow(run, "mask bigint, key bigint, fp bigint").distinct()


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links whose components are those of all pairs of the column fp within the radius."""
    ship(distinct.sparkSession)
    tables = F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in covering_masks(0, radius)))
    members = distinct.select("fp", F.explode(tables).alias("t")).select("t.mask", "t.key", "fp")
    found = []
    while True:
        buckets = cut(members.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("n > 1"))
        found.append(buckets.filter(f"n = 2 AND bit_count(lo ^ hi) <= {radius}").select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        tight = f"bit_count(~mask) <= {radius}"
        small = f"(n <= {bucket} OR bit_count(~mask) < {1 << radius})"
        many = buckets.filter("n > 2").withColumnRenamed("mask", "bmask").withColumnRenamed("key", "bkey")
        inside = members.join(many, (F.col("mask") == F.col("bmask")) & (F.col("key") == F.col("bkey"))).select("mask", "key", "fp", "n", "lo")
        found.append(inside.filter(f"{tight} AND fp != lo").select(F.col("fp").alias("a"), F.col("lo").alias("b")))
        found.append(_bucket_links(inside.filter(f"NOT ({tight}) AND {small}"), radius))
        if buckets.filter(f"n > 2 AND NOT ({tight}) AND NOT {small}").isEmpty():
            break
        members = cut(_refined(inside.filter(f"NOT ({tight}) AND NOT {small}"), radius))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(df: DataFrame, id_column: str, text_column: str, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(id, fingerprint, component_id) of every row of df."""
    rows = cut(fingerprints(df, id_column, text_column))
    per = cut(rows.groupBy("fp").agg(F.min(id_column).alias("least")))
    star = components(links(per, radius, bucket)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    # only fingerprints with a link take part in what follows; all others are components of their own
    linked = star.union(star.select(F.col("root").alias("fp"), "root").distinct())
    smallest = linked.join(per, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = per.join(linked.join(smallest, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(id_column, F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    per_salt = salted.select("fp", "salt").distinct().join(of_fp, "fp").select(F.col("fp").alias("s_fp"), F.col("salt").alias("s_salt"), "component_id")
    found = salted.join(per_salt, (F.col("fp") == F.col("s_fp")) & (F.col("salt") == F.col("s_salt")))
    return found.select(id_column, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
