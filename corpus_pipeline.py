"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

No SQL gives its rows (language ID and near copies are not expressible), so tests hold every stage against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.common import bounded_batches, table, written
from quillmark.llm import decontaminate, language_id, line_dedup, mixing, simhash

ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is clear; null and letterless texts and texts between languages go.

    Learns from the rows that op1 learns from. Rows with a null id stay or go by their text; repeated rows and long
    texts are judged one by one and whole; an empty table gives none.
    """
    bounded_batches(spark)
    return language_id.filter_known(docs, language_id.train(docs.where(~language_id.held_out())))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that are equal or close to an earlier one; every document stays, n_chars follows the text.

    Null and empty texts stay as they are, a null id is later than any other, rows of one id don't take lines from
    each other at the same place. Long texts are read whole; an empty table gives none.
    """
    out = line_dedup.dedup(docs)
    n_lines, n_removed = out.columns[-2:]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop(n_lines, n_removed)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of near copies: five-word shingles of likeness 0.8 or more, by SimHash.

    Links are verified by the true likeness of the sets. Rows without an id stay; null and wordless texts are copies of each
    other; equal rows are one. Long texts are read whole; an empty table gives none.
    """
    return simhash.keep_one_alike(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null and wordless texts hold none.

    Rows without an id and repeated rows stay or go by their text. Long texts are read whole; an empty table gives none.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take from each document: (doc_id, source, size, source_size, target, taken).

    A null source is a source of its own; null texts have no words; repeated rows count and are taken one by one.
    Long texts are counted whole; an empty table gives none.
    """
    return mixing.mix(docs)


STAGES = [
    ("languages", languages),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark_free", benchmark_free),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
