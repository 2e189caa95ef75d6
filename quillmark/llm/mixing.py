"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents lie in key order: the key's first
digits deal them to ranges, each range is sorted on its own, and prefix sums of the ranges' words turn
places in a range into places in the source. A source's budget is then cut exactly: whole epochs first,
then documents in key order, the last one in part.

Defined cases: null text has no words; a null source is a source of its own, last in order; a null id
hashes as the empty string; repeated rows are taken one by one; without words every target is 0. Texts of any length are
counted whole; an empty table gives no rows; of columns of other names none is read. Rows of one id, and all without an id,
lie in one range of keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.common import written

#: No document is taken more often.
MAX_EPOCHS = 3
#: Rows of a key range of the whole table, about.
RANGE_ROWS = 2_000


def n_words(text: str = "text") -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weight: Column | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``by_source`` (source, source_size) with ``target``: all words shared by weight, none above max_epochs of its own.

    Weights are 1, 2, 3 in turn by the order of sources unless given. Sources are ranked by how soon they
    reach their limit; those that do are full, the others share the rest. One row a source, so the windows
    without a key hold the list of sources, not documents.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = weight if weight is not None else (F.row_number().over(ordered) - 1) % 3 + 1
    limited = by_source.withColumn("_w", w.cast("long")).withColumn("_cap", F.col("source_size") * max_epochs)
    by_need = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = left / F.sum("_w").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    ranked = limited.withColumn("_rank", F.row_number().over(by_need)).withColumn("_share", share)
    ranked = ranked.withColumn("_first", F.min(F.when(F.col("_cap") / F.col("_w") > F.col("_share"), F.col("_rank"))).over(everything))
    ranked = ranked.withColumn("_level", F.max(F.when(F.col("_rank") == F.col("_first"), F.col("_share"))).over(everything))
    full = F.col("_first").isNull() | (F.col("_rank") < F.col("_first"))
    target = F.when(full, F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_level"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) of every row of ``docs``."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = written(docs.select("doc_id", "source", n_words().alias("size"), key.alias("_key")), "mix-sizes")
    rows = sized.count()
    digits = max(2, math.ceil(math.log(max(rows, 1) / RANGE_ROWS + 1, 16)))
    # a null source joins as a source of its own
    keyed = sized.withColumns({"_null": F.col("source").isNull(), "_src": F.coalesce("source", F.lit("")), "_range": F.substring("_key", 1, digits)})
    ranges = keyed.groupBy("_null", "_src", "_range").agg(F.sum("size").alias("_n"))
    per_source = ranges.groupBy("_null", "_src").agg(F.sum("_n").alias("source_size")).withColumn("source", F.when(~F.col("_null"), F.col("_src")))
    budget = targets(per_source.select("source", "source_size"), weight, max_epochs)
    budget = budget.withColumns({"_null": F.col("source").isNull(), "_src": F.coalesce("source", F.lit(""))}).drop("source")
    in_order = Window.partitionBy("_null", "_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("_start", F.coalesce(F.sum("_n").over(in_order), F.lit(0))).join(budget, ["_null", "_src"])
    inside = Window.partitionBy("_null", "_src", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keyed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts.drop("_n"), ["_null", "_src", "_range"])
        .withColumn("_budget", F.floor(F.col("target") + F.lit(0.5)))
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0)))
        .withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("source_size") - F.col("_start") - F.col("_inside"))
    )
    taken = F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", "_rest"))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM s),
n AS (
  SELECT *, row_number() OVER o AS rk,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
      / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lv
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
f AS (SELECT min(rk) FILTER (WHERE cap / w > lv) AS first_open FROM n),
t AS (
  SELECT n.source, n.source_size,
    CASE WHEN f.first_open IS NULL OR n.rk < f.first_open THEN n.cap::DOUBLE
         ELSE n.w * (SELECT m.lv FROM n m, f g WHERE m.rk = g.first_open) END AS target
  FROM n, f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS ep FROM p)
SELECT doc_id, size, source_size, target,
  (ep * size + greatest(0, least(size, budget - ep * source_size - before)))::BIGINT AS taken
FROM e
"""
