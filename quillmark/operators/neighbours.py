"""Distances between vectors: kNN, centroids, dedup thresholds, sampling of point clouds."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.common import written
from quillmark.functions import maths, vectors
from quillmark.operators import metric


def knn(queries: DataFrame, points: DataFrame, k: int, block: str | None = None) -> DataFrame:
    """JN14, WN9: the k nearest points of each query (q, embedding; p, embedding), ties by id, exactly.

    With ``block``, only points of the query's block are seen. By pivots and triangle bounds, see ``metric``.
    """
    return metric.nearest(queries, points, k, block)


def state_entropy(states: DataFrame, k: int, block: str | None = None, queries: DataFrame | None = None) -> DataFrame:
    """VP3: the (k+1)-th least distance from each state to all states (or those of its block), itself among them.

    ``queries``: the states that are asked about, by default all.
    """
    more = [block] if block else []
    asked = (states if queries is None else queries).select(F.col("id").alias("q"), "embedding", *more)
    found = knn(asked, states.select(F.col("id").alias("p"), "embedding", *more), k + 1, block)
    return found.where(F.col("rank") == k + 1).select(F.col("q").alias("id"), "distance")


def nearest_in_bin(samples: DataFrame, first: int = 50, alpha: float = 1.0, beta: float = 0.0, gamma: float = 0.0) -> DataFrame:
    """VP4: each sample's least multi-factor distance among the ``first`` nearest others of its bin by L2.

    One more than ``first`` are asked for, as a sample finds itself. Samples (ids are distinct) without others have no row.
    """
    asked = samples.select("bin_id", F.col("sample_id").alias("q"), "embedding")
    found = knn(asked, asked.withColumnRenamed("q", "p"), first + 1, "bin_id").where("q <> p")
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "p"))).where(F.col("rank") <= first)
    side = lambda n: samples.select(F.col("sample_id").alias(n), F.col("reward").alias(f"r{n}"), F.col("time").alias(f"t{n}"))
    far = maths.multi_factor_distance(F.col("distance"), F.col("rq") - F.col("rp"), F.col("tq") - F.col("tp"), alpha, beta, gamma)
    return near.join(side("q"), "q").join(side("p"), "p").groupBy("bin_id", F.col("q").alias("sample_id")).agg(F.round(F.min(far), 6).alias("distance"))


def dedup_threshold(distances: DataFrame, initial: float, least: int = 5) -> DataFrame:
    """AG18: the median distance; the initial value with few distances or a median of next to nothing."""
    m = F.median("distance")
    return distances.agg(F.round(F.when((F.count("*") < least) | (m < 1e-9), initial).otherwise(m), 6).alias("threshold"), F.count("*").alias("n"))


def duplicates(samples: DataFrame, threshold: float) -> DataFrame:
    """ST7: samples with an earlier sample of their bin nearer than ``threshold``, and the first such."""
    found = metric.first_within(samples.select("bin_id", F.col("sample_id").alias("p"), "embedding"), threshold, "bin_id")
    return found.where("first < p").select("bin_id", F.col("p").alias("sample_id"), F.col("first").alias("earlier"))


MOST_CENTROIDS = 10_000


def nearest_centroid(samples: DataFrame, centroids: DataFrame) -> DataFrame:
    """JN15: (sample_id, centroid): centroids (centroid, embedding) are a checked short list."""
    if centroids.limit(MOST_CENTROIDS + 1).count() > MOST_CENTROIDS:
        raise ValueError(f"over {MOST_CENTROIDS} centroids: this is a join of every sample with every centroid")
    all_ = samples.select("sample_id", "embedding").crossJoin(F.broadcast(centroids.select("centroid", F.col("embedding").alias("ce"))))
    apart = all_.select("sample_id", "centroid", F.round(vectors.l2(F.col("embedding"), F.col("ce")), 9).alias("distance"))
    return apart.groupBy("sample_id").agg(F.min(F.struct("distance", "centroid")).alias("best")).select("sample_id", "best.centroid", "best.distance")


#: Rows of a group that one task may hold; larger groups are sampled by rounds over all tasks.
SMALL_GROUP = 100_000
#: Rounds between which the distances are written.
ROUNDS = 16


def _picks(x: np.ndarray, k: int) -> list[int]:
    """Rows of x: the first, then always the one farthest from those picked."""
    away, at, picks = np.full(len(x), np.inf), 0, []
    for _ in range(min(k, len(x))):
        picks.append(at)
        away = np.minimum(away, ((x - x[at]) ** 2).sum(1))
        away[picks] = -1
        at = int(away.argmax())
    return picks


def farthest_first(points: DataFrame, k: int, small: int = SMALL_GROUP) -> DataFrame:
    """(g, pick, i): of each group g of (g, i, v), the least i, then always the row farthest from those picked, ties by i.

    Groups of up to ``small`` rows are a frame in one task each. Larger ones take a round a pick: each row's
    least distance to the picks, and the farthest row of each group by partial aggregation. Both give the same rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    size = points.groupBy("g").agg((F.count("*") <= small).alias("small"))
    rows = points.alias("p").join(size.alias("s"), F.col("p.g").eqNullSafe(F.col("s.g"))).select("p.g", "p.i", F.col("p.v").cast("array<double>").alias("v"), "small")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i").reset_index(drop=True)
        picks = _picks(np.array(pdf["v"].tolist(), float), k)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "pick": range(len(picks)), "i": pdf["i"].iloc[picks].to_numpy()})

    found = rows.where("small").select("g", "i", "v").groupBy("g").applyInPandas(pick, f"g {kinds['g']}, pick int, i {kinds['i']}")
    if size.where("not small").isEmpty():
        return found
    left = written(rows.where("not small").select("g", "i", "v", F.lit(float("inf")).alias("away")), "farthest")
    done, recent = [], []
    for n in range(k):
        ahead = _after(left, recent) if recent else left
        if len(recent) == ROUNDS:
            left, recent = written(ahead, "farthest"), []
            ahead = left
        best = ahead.groupBy("g").agg(F.min_by(F.struct("i", "v"), F.struct(-F.col("away"), F.col("i"))).alias("best"))
        recent.append(written(best.select("g", F.lit(n).alias("pick"), "best.i", "best.v"), "picks"))
        done.append(recent[-1])
    return functools.reduce(DataFrame.union, [d.select("g", "pick", "i") for d in done], found)


def _after(left: DataFrame, picks: list[DataFrame]) -> DataFrame:
    """Rows (g, i, v, away) but the picked ones, with their distance to the nearest pick so far."""
    squares = lambda x, c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    near = functools.reduce(DataFrame.union, picks).groupBy("g").agg(F.collect_list("i").alias("seen"), F.collect_list("v").alias("at"))
    both = left.alias("l").join(near.alias("n"), F.col("l.g").eqNullSafe(F.col("n.g")))
    away = F.least("away", F.array_min(F.transform("at", lambda c: squares(F.col("v"), c))))
    return both.where(~F.array_contains("seen", F.col("i"))).select("l.g", "i", "v", away.alias("away"))


def farthest_points(clouds: DataFrame, n: int, small: int = SMALL_GROUP) -> DataFrame:
    """VP5: (cloud_id, pick, pt): from the least point on, always the point farthest from those picked."""
    found = farthest_first(clouds.select(F.col("cloud_id").alias("g"), F.col("pt").alias("i"), F.array("x", "y", "z").alias("v")), n, small)
    return found.select(F.col("g").cast("long").alias("cloud_id"), "pick", F.col("i").cast("int").alias("pt"))


def local_groups(clouds: DataFrame, n: int, k: int, small: int = SMALL_GROUP) -> DataFrame:
    """VP6, VP8: the k points nearest to each farthest-point centre, moved so that the centre is 0.

    A cloud of up to ``small`` points gives its centres and what can be among their nearest in one task; larger ones meet their centres in a join.
    """
    large = clouds.groupBy("cloud_id").agg(F.count("*").alias("n")).where(F.col("n") > small).select("cloud_id")
    if large.isEmpty():
        moved = _near_centres(clouds, n, k)
    else:
        most = clouds.join(large, "cloud_id", "left_semi")
        centre = farthest_points(most, n, small).join(most, ["cloud_id", "pt"]).select("cloud_id", F.col("pt").alias("centre"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))
        pairs = centre.join(most.select("cloud_id", "pt", "x", "y", "z"), "cloud_id")
        moved = pairs.select("cloud_id", "centre", "pt", *[(F.col(c) - F.col(f"c{c}")).alias(c) for c in "xyz"])
        moved = moved.unionByName(_near_centres(clouds.join(large, "cloud_id", "left_anti"), n, k))
    rank = F.row_number().over(Window.partitionBy("cloud_id", "centre").orderBy(F.round(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2, 9), "pt"))
    return moved.withColumn("rank", rank).where(F.col("rank") <= k).select("cloud_id", "centre", "rank", "pt", "x", "y", "z")


def _near_centres(clouds: DataFrame, n: int, k: int) -> DataFrame:
    """(cloud_id, centre, pt, x, y, z): of each cloud and centre the points that can rank among the k nearest by rounded distance, moved."""

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pt").reset_index(drop=True)
        x, pt = pdf[["x", "y", "z"]].to_numpy(float), pdf["pt"].to_numpy()
        out = []
        for at in _picks(x, n):
            moved = x - x[at]
            square = (moved**2).sum(1)
            last = np.partition(square, k - 1)[k - 1] if len(x) > k else np.inf
            may = np.flatnonzero(~(square > last + 2e-9 + 1e-12 * last))  # rounding may bring as many level
            out.append(pd.DataFrame({"cloud_id": pdf["cloud_id"].iloc[0], "centre": pt[at], "pt": pt[may], "x": moved[may, 0], "y": moved[may, 1], "z": moved[may, 2]}))
        return pd.concat(out, ignore_index=True)

    rows = clouds.where("cloud_id is not null").select(F.col("cloud_id").cast("long").alias("cloud_id"), F.col("pt").cast("int").alias("pt"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return rows.groupBy("cloud_id").applyInPandas(near, "cloud_id long, centre int, pt int, x double, y double, z double")
