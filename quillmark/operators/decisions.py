"""Requests, responses and decisions: parse, merge, audit, resume, chunk, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.common import width, written
from quillmark.functions import text


def latest(rows: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    """SC6, SC8, ST5: the last value of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def merged(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """JN1: requests (custom_id) with reply and decision, '' where there is none."""
    got = responses.select("custom_id", "analysis")
    out = requests.join(got, "custom_id", "left").withColumn("analysis", F.coalesce("analysis", F.lit("")))
    return out.withColumn("decision", text.decision(F.col("analysis")))


def flip_pairs(baseline: DataFrame, flipped: DataFrame) -> DataFrame:
    """JN2, ST1: one full outer join: both decisions, and which side has the id."""
    b = baseline.select("custom_id", F.col("decision").alias("b"), F.lit(True).alias("in_b"))
    f = flipped.select("custom_id", F.col("decision").alias("f"), F.lit(True).alias("in_f"))
    both = b.join(f, "custom_id", "full_outer")
    status = F.when(F.col("in_b").isNull(), "only_flipped").when(F.col("in_f").isNull(), "only_baseline").when(text.flips(F.col("b"), F.col("f")), "consistent").otherwise("inconsistent")
    return both.select("custom_id", "b", "f", status.alias("status"))


def flip_audit(baseline: DataFrame, flipped: DataFrame) -> DataFrame:
    """AG11: how many ids are common, consistent, inconsistent, or on one side only."""
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    return flip_pairs(baseline, flipped).agg(
        (n("consistent") + n("inconsistent")).alias("n_common"), n("consistent").alias("n_consistent"), n("inconsistent").alias("n_inconsistent"),
        n("only_baseline").alias("n_only_baseline"), n("only_flipped").alias("n_only_flipped"),
        F.round(n("consistent") / F.greatest(n("consistent") + n("inconsistent"), F.lit(1)), 6).alias("consistency"),
    )


def pending(tasks: DataFrame, done: DataFrame, key: str = "custom_id") -> DataFrame:
    """JN4, JN5: tasks without a result."""
    return tasks.join(done.select(key), key, "left_anti")


def to_retry(tasks: DataFrame, results: DataFrame, key: str = "custom_id") -> DataFrame:
    """JN6, SS10: tasks whose result is missing, empty or an error."""
    return tasks.join(results.select(key, "text", "error"), key, "left").where("text is null or text = '' or error is not null").drop("text", "error")


def overlaid(old: DataFrame, new: DataFrame, key: str = "custom_id") -> DataFrame:
    """ST5: new rows in place of old ones of the same key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def suffix_ordered(rows: DataFrame, key: str, position: str, sep: str = "-") -> DataFrame:
    """SR1, SR2: by the number after the last ``sep``, then as given."""
    return rows.withColumn("suffix", text.suffix_number(F.col(key), sep)).orderBy("suffix", position)


def chunked(rows: DataFrame, order: str, size: int, buckets: int = 64) -> DataFrame:
    """SK4: chunk and line of each row in order. Rows are numbered by ranges of ``order`` and prefix counts, not in one task.

    The ranges are written: bounds are drawn from a sample, so counts and rows must come from one drawing.
    """
    ranges = rows.repartitionByRange(max(buckets, width(rows.sparkSession)), order)
    placed = written(ranges.withColumn("__part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("__before", before).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    number = F.col("__inside") + F.col("__before") - 1
    out = placed.withColumn("__inside", inside).join(F.broadcast(starts), "__part")
    return out.withColumns({"chunk": F.floor(number / size).cast("long"), "line": (number % size).cast("long")}).drop("__part", "__inside", "__before")


def running_sums(rows: DataFrame, order: str, columns: list[str], buckets: int = 64) -> DataFrame:
    """``rows`` with ``number`` from 0 and, for each column, ``<column>_sum`` over all rows up to this one in order, by ranges as ``chunked``."""
    placed = written(rows.repartitionByRange(max(buckets, width(rows.sparkSession)), order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("__part").agg(F.count("*").alias("__rows"), *[F.sum(c).alias(f"__{c}") for c in columns])
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = totals.select("__part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in ("__rows", *(f"__{c}" for c in columns))])
    inside = Window.partitionBy("__part").orderBy(order)
    out = placed.withColumns({"__i": F.row_number().over(inside), **{f"{c}_sum": F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for c in columns}}).join(F.broadcast(starts), "__part")
    out = out.withColumns({"number": F.col("__i") + F.col("__rows_before") - 1, **{f"{c}_sum": F.col(f"{c}_sum") + F.col(f"__{c}_before") for c in columns}})
    return out.drop("__part", "__i", "__rows_before", *[f"__{c}_before" for c in columns])


def carried_situation(parts: DataFrame) -> DataFrame:
    """WN8: parts (custom_id, pos, kind, text) of a message: each image gets the last situation named before it; 1 or 2 by
    place where none was. A situation is not reset by an image."""
    marker = F.when(F.col("kind") == "text", F.nullif(F.regexp_extract("text", r"(?i)situation\s*(\d+)", 1), F.lit("")).try_cast("int"))
    order = Window.partitionBy("custom_id").orderBy("pos")
    named = F.last(marker, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = parts.withColumn("named", named).where("kind = 'image'")
    return rows.withColumn("situation", F.coalesce("named", F.row_number().over(Window.partitionBy("custom_id").orderBy("pos")))).drop("named")


def assigned_keys(tasks: DataFrame, n_keys: int, order: str) -> DataFrame:
    """SS5, SS12: tasks dealt to API keys in turn by hash of their id; the calls themselves are outside the engine."""
    return tasks.withColumn("key_slot", F.pmod(F.crc32(F.col(order).cast("string")), F.lit(n_keys)))
