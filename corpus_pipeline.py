"""A corpus pipeline over `documents`: each stage reads what its predecessor kept, as Parquet.

Toxic documents go, then all but one row of each near-duplicate group, then documents that hold a window of a
benchmark item; those that are left are encoded. Documents that no rule names pass unchanged, whatever their length.
Of a near-duplicate group the row with the smallest doc_id stays, of equal ids the one with the smallest text hash, of
equal rows one; a null id comes behind all others, and null texts are texts without words, which are near copies of
each other. Stages take the columns of documents and leave out any others; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, simhash, toxicity
from millrace.llm.common import cut, scratch_path, table
from millrace.llm.queries import byte_bpe_path
from millrace.runtime import discard

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of documents still here, doesn't reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    others = tuple(c for c in COLUMNS if c not in ("doc_id", "text"))
    return toxicity.score(docs, model, "doc_id", "text", keep=others, keep_text=True).filter("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: the smallest doc_id, null ids last, then the smallest text hash."""
    parts = ["no_id", "some_id", "th"]  # none of them null, so that the join and what follows it are dealt alike
    keyed = docs.select(*COLUMNS, F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("some_id"), F.xxhash64("text").alias("th"))
    kept = simhash.near_duplicates(keyed.select(F.struct(*parts).alias("key"), "text"), "key", "text").select("component_id.*").distinct()
    return keyed.join(kept, parts, "left_semi").dropDuplicates(parts).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), with_key=True)
    dirty = decontaminate.small(cut(found.filter("contaminated").select(F.col("doc_id").alias("dirty_id"), F.col("th").alias("dirty_th")).distinct()))
    return docs.join(dirty, F.col("doc_id").eqNullSafe(F.col("dirty_id")) & (F.xxhash64("text") == F.col("dirty_th")), "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document that is left, the digest of what they decode to, and whether that is the text."""
    return bpe.round_trip_column(docs, "doc_id", "text", byte_bpe_path())


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated), ("encode", encode)]

#: The stages' models and hashes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of `documents`."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)  # its successor has read it
        docs, before = spark.read.parquet(path), path
    return docs
