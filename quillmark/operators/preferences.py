"""Preference queries and labels: filters, accuracy, uncertainty sampling, k-centre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import maths, vectors
from quillmark.operators import neighbours


def kept(pairs: DataFrame, least_return: float) -> DataFrame:
    """PF2: pairs (r1, r2) with a sum over the threshold, which counts only if positive."""
    return pairs if least_return <= 0 else pairs.where(F.greatest(vectors.total(F.col("r1")), vectors.total(F.col("r2"))) > least_return)


def useful(pairs: DataFrame, a: str, b: str, least: float = 1e-3) -> DataFrame:
    """PF3: pairs whose contents differ. Distances are taken in floating point; unsigned bytes are not wrapped."""
    return pairs.where(vectors.l2(F.col(a), F.col(b)) >= least)


def labelled(pairs: DataFrame) -> DataFrame:
    """PF4."""
    return pairs.where("label <> -1")


def accuracy(pairs: DataFrame, truth: str, label: str) -> DataFrame:
    """AG10: share of matches, 0 without rows."""
    return pairs.agg(F.coalesce(F.avg((F.col(truth) == F.col(label)).cast("double")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def score_label(reply: Column) -> Column:
    """PF5: from 0..1 to -1..1; null where it can't be read."""
    return reply.try_cast("double") * 2 - 1


def disagreement(scores: DataFrame, k: int) -> DataFrame:
    """SP9: pairs (pair_id, member, p) of the largest spread over the ensemble: AG17 then top-k."""
    spread = scores.groupBy("pair_id").agg(F.round(F.avg("p"), 9).alias("mean_p"), F.round(F.stddev_pop("p"), 9).alias("std_p"))
    return spread.orderBy(F.desc("std_p"), "pair_id").limit(k)


def uncertain(scores: DataFrame, k: int) -> DataFrame:
    """SP10: pairs of the largest mean entropy."""
    mean = scores.groupBy("pair_id").agg(F.round(F.avg(maths.entropy(F.col("p"))), 9).alias("mean_entropy"))
    return mean.orderBy(F.desc("mean_entropy"), "pair_id").limit(k)


def ensemble_accuracy(scores: DataFrame) -> DataFrame:
    """AG26: for each member, how often the preferred side is the label (pair_id, member, p, label)."""
    return scores.where("label <> -1").groupBy("member").agg(F.avg(((F.col("p") < 0.5).cast("int") == F.col("label")).cast("double")).alias("accuracy"))


def k_center(points: DataFrame, k: int, group: str = "environment", small: int = neighbours.SMALL_GROUP) -> DataFrame:
    """SP11: greedy k-centre of each group's (id, embedding): first the least id, then the farthest from all picked."""
    found = neighbours.farthest_first(points.select(F.col(group).alias("g"), F.col("id").alias("i"), F.col("embedding").alias("v")), k, small)
    return found.select(F.col("g").alias(group), "pick", F.col("i").alias("id"))


def k_center_of_uncertain(scores: DataFrame, points: DataFrame, k: int, by: str = "disagreement") -> DataFrame:
    """SP12: k-centre among the 2k most uncertain."""
    first = (disagreement if by == "disagreement" else uncertain)(scores, 2 * k)
    return k_center(points.join(first.select(F.col("pair_id").alias("id")), "id", "left_semi"), k)


def flipped_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """PF6: 0 and 1 swap; -1 (no preference) becomes 2, as 1 less the label is."""
    return rows.withColumn(label, 1 - F.col(label))


def flipped_scores(rows: DataFrame, score: str = "score") -> DataFrame:
    """PF6: scores of the other sign."""
    return rows.withColumn(score, -F.col(score))
