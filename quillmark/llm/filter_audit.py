"""Filter interaction audit: what each filter removes after every set of others, from packed bitmaps.

Every row carries a bit for each filter that it fails and for its labels. Tasks pack those bits into NumPy bitsets, a
stretch of whole words for each part; for each set of earlier filters an AND-NOT gives the rows that are left,
and popcounts give what the next filter removes. Counts of blocks of rows are summed, so nothing but counts is
shuffled, and every order of the filters is read from the same counts.

Null texts are empty; equal texts without an id come after those with one, and rows of one id and text are no copies
of each other. A null source is the part ''. Labels of an id count once, if any of its rows gives 1; rows without an id
have none. An empty table has no parts and so no rows. Other columns of ``docs`` are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.common import written

NAMES = "ABCDE"
#: Rows that are packed at once: bounds a task's memory also where every row is a part of its own.
BLOCK_ROWS = 1 << 17
#: Sets of filters double with each.
MAX_FILTERS = 8

_WHITE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> list[Column]:
    """Whether a text fails A (few words), B (repeated words), C (capitals), D (signs); null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, _WHITE), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
    return [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals.cast("long") > 5 * F.length(t), t.rlike("[#$%&*|]")]


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) of every row of ``docs``; bit i of ``fails`` stands for filter i of ``NAMES``.

    A text is known by its SHA-256. The first id of each repeated text is found by a grouping that combines map-side,
    and joined back to the small rows, where Spark splits hot keys.
    """
    bits = sum((f.cast("int") * (1 << i) for i, f in enumerate(failures(F.col("text")))), F.lit(0))
    rows = written(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), bits.alias("fails"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    copy = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("k")).agg(*[F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    marks = written(marks.where("good or toxic"), "audit-labels")
    out = rows.join(written(first, "audit-firsts"), "digest", "left").select("doc_id", "part", (F.col("fails") + copy.cast("int") * 16).alias("fails"))
    out = out.join(marks, F.col("doc_id") == F.col("k"), "left")
    return out.select("part", F.col("fails").cast("long").alias("fails"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def packed_counts(part: np.ndarray, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray, n_filters: int) -> Iterator[tuple[np.ndarray, int, int, list[np.ndarray]]]:
    """(parts, subset, filter, [kept, removed, good lost, toxic lost]) of a block of rows, for each set of filters and each filter outside it."""
    codes, names = pd.factorize(part)
    sizes = np.bincount(codes, minlength=len(names))
    words = (sizes + 63) // 64
    starts = np.r_[0, np.cumsum(words)]
    order = np.argsort(codes, kind="stable")
    place = np.empty(len(codes), np.int64)  # a part's rows fill whole words of its own
    place[order] = np.arange(len(codes)) + np.repeat(64 * starts[:-1] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)

    def bitmap(rows: np.ndarray) -> np.ndarray:
        bits = np.zeros(64 * starts[-1], bool)
        bits[place[rows]] = True
        return np.packbits(bits).view(np.uint64)

    def each(bits: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(bits), starts[:-1], dtype=np.int64)

    failing = [bitmap(fails >> i & 1 == 1) for i in range(n_filters)]
    wanted, bad = bitmap(good), bitmap(toxic)
    left = {0: bitmap(np.ones(len(codes), bool))}
    for subset in range(1 << n_filters):
        if subset:
            low = (subset & -subset).bit_length() - 1
            left[subset] = left[subset & (subset - 1)] & ~failing[low]
        for f in range(n_filters):
            if not subset >> f & 1:
                out = left[subset] & failing[f]
                yield names, subset, f, [each(left[subset] & ~failing[f]), each(out), each(out & wanted), each(out & bad)]


def counts(rows: DataFrame, n_filters: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(part, subset, filter, kept, removed, good_lost, toxic_lost) over all ``rows`` (part, fails, good, toxic)."""

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in it:
            held.append(pdf)
            size += len(pdf)
            if size >= block_rows:
                yield block(held)
                held, size = [], 0
        if size:
            yield block(held)

    def block(held: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        found = packed_counts(pdf["part"].to_numpy(object), pdf["fails"].to_numpy(np.int64), pdf["good"].to_numpy(bool), pdf["toxic"].to_numpy(bool), n_filters)
        return pd.concat([pd.DataFrame({"part": names, "subset": subset, "filter": f} | dict(zip(_SUMS, n, strict=True))) for names, subset, f, n in found], ignore_index=True)

    out = rows.select("part", "fails", "good", "toxic").mapInPandas(pack, "part string, subset int, filter int, " + ", ".join(f"{c} long" for c in _SUMS))
    return out.groupBy("part", "subset", "filter").agg(*[F.sum(c).alias(c) for c in _SUMS])


_SUMS = ("kept", "removed", "good_lost", "toxic_lost")


def audit(rows: DataFrame, names: str = NAMES, orders: list[str] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``rows`` (part, fails, good, toxic): bit i of ``fails`` stands for the filter names[i]. ``orders``: by default every
    permutation. shapley is over all orders, whichever are asked for.
    """
    n = len(names)
    if not 0 < n <= MAX_FILTERS or len(set(names)) != n:
        raise ValueError(f"1 to {MAX_FILTERS} different filters, not {names!r}")
    steps = []
    for order in orders if orders is not None else map("".join, permutations(names)):
        before = 0
        for step, name in enumerate(order, 1):
            steps.append((order, step, names.index(name), before))
            before |= 1 << names.index(name)
    asked = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, subset int")  # n! times n small rows
    others = F.element_at(F.array(*[F.lit((1 << n) - 1 - (1 << i)) for i in range(n)]), F.col("filter") + 1)
    weight = F.element_at(F.array(*[F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n)]), F.bit_count("subset") + 1)
    by_filter = counts(rows, n).groupBy("part", "filter").agg(
        F.collect_list(F.struct("subset", *_SUMS)).alias("sets"),
        F.sum(F.when(F.col("subset") == 0, F.col("removed"))).alias("failing"),
        F.sum(F.when(F.col("subset") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(weight * F.col("removed")).alias("shapley"),
    )
    sets = by_filter.select("part", "filter", "failing", "unique_fails", "shapley", F.explode("sets").alias("s")).select("part", "filter", "failing", "unique_fails", "shapley", "s.*")
    out = sets.join(F.broadcast(asked), ["filter", "subset"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE = r"""
WITH words AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
fails AS (
  SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * len(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL)] f FROM words),
marks AS (SELECT doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, f, count(*) n, count(*) FILTER (WHERE coalesce(good, false)) n_good, count(*) FILTER (WHERE coalesce(toxic, false)) n_toxic
  FROM fails LEFT JOIN marks USING (doc_id) GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) x, unnest([1, 2, 3, 4, 5]) i),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x filter_order, [a.i, b.i, c.i, d.i, e.i] o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step::INT step, o[step] f_i, o[:step - 1] before FROM orders, unnest([1, 2, 3, 4, 5]) s(step)),
sums AS (
  SELECT part, filter_order, step, f_i,
    sum(n) FILTER (WHERE NOT here AND NOT earlier) kept, sum(n) FILTER (WHERE here AND NOT earlier) removed, sum(n) FILTER (WHERE here AND earlier) redundant,
    sum(n) FILTER (WHERE here AND n_fails = 1) unique_fails, sum(n_good) FILTER (WHERE here AND NOT earlier) good_lost, sum(n_toxic) FILTER (WHERE here AND NOT earlier) toxic_lost
  FROM (SELECT *, f[f_i] here, len(list_filter(before, lambda b: f[b])) > 0 earlier, len(list_filter(f, lambda v: v)) n_fails FROM cells, steps) GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT kept, coalesce(removed, 0)::BIGINT removed, coalesce(redundant, 0)::BIGINT redundant,
  coalesce(unique_fails, 0)::BIGINT unique_fails, coalesce(good_lost, 0)::BIGINT good_lost, coalesce(toxic_lost, 0)::BIGINT toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, f_i), 0)::BIGINT shapley
FROM sums
"""
