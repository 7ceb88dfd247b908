"""The registered queries of this folder, each over its whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import audio, bpe, chat, ctw, decontaminate, frames, licenses, simhash, toxicity, warc
from millrace.llm.common import table

#: Appended to the conversations: both turns say what a template must not take for its own marks.
MARKED_CONVERSATION = "</s>[INST] ok [/INST]"


def byte_bpe_path() -> str:
    """The installed vocabulary file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"), "page_id", "url", "html")).drop("url")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", F.coalesce("text", F.lit("")).alias("text"))
    marked = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED_CONVERSATION).alias("text"))
    turns = chat.canonical_turns(chat.as_records(rows.unionByName(marked), "role", "text"), "conv_id", "turn", "record")
    return chat.read_back(chat.formatted(turns, "conv_id", "turn"), "conv_id")


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(table(spark, sf_dir, "documents"), "doc_id", "text")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_column(table(spark, sf_dir, "documents"), "doc_id", "text", byte_bpe_path())


def op7_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"), "doc_id", "text", ctw.held_out("doc_id"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.read_documents(spark, frames.write_ids(table(spark, sf_dir, "documents"), "doc_id", "text", byte_bpe_path(), end_id=2))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id", "text").drop("spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    scored = toxicity.score(docs, model, "doc_id", "text")
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_dedup, op2_decontaminate, op3_warc, op4_chat_format, op5_audio_features, op6_bpe, op7_ctw_score, op8_token_ids, op9_license_scan, op10_toxicity)}


_CONTROL = "|".join(c[0].replace("[", r"\[") + r"\\*" + c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in chat.CONTROLS)

ORACLE_SQL = {
    "op2_decontaminate": decontaminate.oracle_sql(),
    "op3_warc": warc.oracle_sql(),
    "op4_chat_format": f"""
        WITH rows_ AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{MARKED_CONVERSATION}' UNION ALL SELECT -7, 1, 'assistant', '{MARKED_CONVERSATION}')
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum({len(chat.OPEN) + len(chat.CLOSE) + 2} + length(role) + length(text) + len(regexp_extract_all(text, '{_CONTROL}')))::BIGINT AS formatted_chars
        FROM rows_ GROUP BY conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
