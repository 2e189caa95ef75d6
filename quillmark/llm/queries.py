"""Registered queries of the operators, each with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.common import table
from quillmark.llm import chat_format, decontaminate, filter_audit, fingerprints, language_id, line_dedup, mixing, quality, secrets, simhash, substring_dedup, token_align, url_filter


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out()))
    out = language_id.identify(docs, model)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~language_id.held_out()))
    out = quality.score(docs, model)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "score", "predicted")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.train(None, spark))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``conversations`` and one record of another layout, all as JSON: their fingerprints choose the mappings."""
    rows = table(spark, sf_dir, "conversations")
    one = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(1).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("key"), F.to_json(F.struct(said.alias("prompt"), said.alias("response"))).alias("record"))
    turns = chat_format.canonical(rows.select(F.col("conv_id").alias("key"), one.alias("record")).union(extra))
    return chat_format.read_back(chat_format.formatted(turns)).withColumnRenamed("key", "conv_id")


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.alignment(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_secrets": op4_secrets,
    "op5_fingerprints": op5_fingerprints,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mix": op7_mix,
    "op8_simhash": op8_simhash,
    "op9_url_filter": op9_url_filter,
    "op10_line_dedup": op10_line_dedup,
    "op11_chat_format": op11_chat_format,
    "op12_token_align": op12_token_align,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {"op7_mix": mixing.ORACLE, "op11_chat_format": chat_format.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
