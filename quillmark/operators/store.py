"""The bounded, diverse sample store: capacities, rebinning, and the fill, dedup and replace policy in batch form."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.common import width
from quillmark.operators.decisions import chunked, running_sums
from quillmark.operators.pairs import draw


def capacities(bins: DataFrame, total: int) -> DataFrame:
    """SP20: (bin_id, capacity): equal parts, the remainder to the first bins."""
    k = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy("bin_id")) - 1
    return bins.select("bin_id", (F.expr(f"{int(total)}L div 1") / k).cast("long").alias("base"), rank.alias("rank"), k.alias("k")).select(
        "bin_id", (F.col("base") + (F.col("rank") < F.lit(total) % F.col("k")).cast("long")).alias("capacity")
    )


def trimmed(samples: DataFrame, caps: DataFrame, seed: int) -> DataFrame:
    """SP22: at most capacity samples a bin, by random rank."""
    rank = F.row_number().over(Window.partitionBy("bin_id").orderBy(draw(seed, F.col("sample_id"))))
    return samples.withColumn("rank", rank).join(caps, "bin_id").where("rank <= capacity").drop("rank", "capacity")


def clustered(samples: DataFrame, ks: list[int], reward_weight: float = 0.3, seed: int = 1) -> DataFrame:
    """AG22, SR11: bins by k-means over embedding and weighted reward; k by silhouette; bins numbered by centroid reward.

    Spark's k-means|| and squared-Euclidean silhouette: an equivalent method, not equal labels.
    """
    rows = samples.withColumn("features", array_to_vector(F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(F.col("reward") * reward_weight))))
    best = max((KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows) for k in ks), key=lambda m: ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(m.transform(rows)))
    order = np.argsort([c[-1] for c in best.clusterCenters()])
    number = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(int(c)), F.lit(i))])
    return best.transform(rows).withColumn("bin_id", number[F.col("cluster")]).drop("features", "cluster")


class Store:
    """SP21: one bin's rows and running distances.

    A sample that fills the store enters, and its distance is taken after entry, so it finds itself at 0. Later
    ones are refused, and leave no distance, where they are nearer than the threshold to a stored one; else they
    enter while the bin has room, or replace the nearest, or by hash another. The threshold is the median of all
    distances so far, once there are five and it is not 0. Distance weighs vectors, rewards and times.
    """

    def __init__(self, capacity: int, initial: float, replace: str = "nearest", weights: tuple[float, float, float] = (1.0, 0.0, 0.0)):
        self.capacity, self.initial, self.replace, self.weights = capacity, initial, replace, weights
        self.ids: list[int] = []
        self.vectors: list[np.ndarray] = []
        self.extras: list[tuple[float, float]] = []
        self.distances: list[float] = []  # in order

    def threshold(self) -> float:
        n = len(self.distances)
        m = (self.distances[(n - 1) // 2] + self.distances[n // 2]) / 2 if n >= 5 else 0.0
        return self.initial if m < 1e-9 else m

    def offer(self, sample_id: int, vector: np.ndarray, reward: float = 0.0, time: float = 0.0, fill: bool | None = None) -> tuple[str, int | None]:
        """What happened to a sample, and the id that left for it. ``fill``: whether the whole store still fills (by default, the bin)."""
        if fill if fill is not None else len(self.ids) < self.capacity:
            self._enter(sample_id, vector, reward, time)
            bisect.insort(self.distances, 0.0)
            return "added", None
        if not self.ids:
            if self.capacity < 1:
                return "refused", None
            self._enter(sample_id, vector, reward, time)
            return "added", None
        alpha, beta, gamma = self.weights
        extras = np.array(self.extras)
        away = np.sqrt(alpha * ((np.array(self.vectors) - vector) ** 2).sum(1) + beta * (extras[:, 0] - reward) ** 2 + gamma * (extras[:, 1] - time) ** 2)
        at = int(away.argmin())
        if away[at] < self.threshold():
            return "refused", None
        bisect.insort(self.distances, float(away[at]))
        if len(self.ids) < self.capacity:
            self._enter(sample_id, vector, reward, time)
            return "added", None
        if self.replace == "random":
            at = (sample_id * 2654435761) % len(self.ids)
        gone, self.ids[at], self.vectors[at], self.extras[at] = self.ids[at], sample_id, vector, (reward, time)
        return "replaced", gone

    def _enter(self, sample_id: int, vector: np.ndarray, reward: float, time: float) -> None:
        self.ids.append(sample_id)
        self.vectors.append(vector)
        self.extras.append((reward, time))


def bounded(samples: DataFrame, capacity: int, initial: float, replace: str = "nearest", weights: tuple[float, float, float] = (1.0, 0.0, 0.0), total: int | None = None) -> DataFrame:
    """SP21: the fate of every sample (bin_id, sample_id, embedding, and reward and time where they weigh), in order of id.

    ``total``: the first so many samples of all bins enter without a look at likeness; by default each bin fills
    by itself. Each step of a bin needs the last, so a bin's rows pass one task in order, as a stream: what is
    held is the store and the distances, not the rows. A bin's threshold is its own.
    """
    given = set(samples.columns)
    more = [F.col(c).cast("double").alias(c) if c in given else F.lit(0.0).alias(c) for c in ("reward", "time")]
    rows = samples.select("bin_id", "sample_id", F.col("embedding").cast("array<double>").alias("embedding"), *more)
    if total is None:
        rows = rows.withColumn("fill", F.lit(None).cast("boolean"))
    else:
        rows = chunked(rows, "sample_id", total).withColumn("fill", F.col("chunk") == 0).drop("chunk", "line")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stores: dict[int, Store] = {}
        current = None
        for pdf in it:
            fates = []
            for r in pdf.itertuples(index=False):
                if r.bin_id != current:
                    current, stores = r.bin_id, {r.bin_id: Store(capacity, initial, replace, weights)}
                fates.append(stores[current].offer(int(r.sample_id), np.asarray(r.embedding, float), r.reward, r.time, None if total is None else bool(r.fill)))
            yield pd.DataFrame({"bin_id": pdf["bin_id"], "sample_id": pdf["sample_id"], "fate": [f for f, _ in fates], "gone": pd.array([g for _, g in fates], "Int64")})

    dealt = rows.repartition(width(rows.sparkSession), "bin_id").sortWithinPartitions("bin_id", "sample_id")
    return dealt.mapInPandas(run, "bin_id int, sample_id long, fate string, gone long")


def clusters(x: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """AG22, SR11: (bin of each row, centres), bins numbered by the last coordinate of their centres; as many as score best by silhouette.

    Lloyd's steps from seeds that are farthest from each other, so equal rows give equal bins on every run. Rows are a task's
    stored samples, at most as many as the store holds.
    """
    apart = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0))
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for k in range(least, min(most, len(x)) + 1):
        seeds = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
        while len(seeds) < k:
            seeds.append(int(apart[seeds].min(0).argmax()))
        centres = x[seeds].copy()
        for _ in range(50):
            label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            moved = np.stack([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(k)])
            if np.array_equal(moved, centres):
                break
            centres = moved
        score = _silhouette(apart, label) if len(set(label.tolist())) > 1 else -1.0
        if best is None or score > best[0]:
            best = (score, label, centres)
    _, label, centres = best
    order = np.argsort(centres[:, -1], kind="stable")
    return np.argsort(order, kind="stable")[label], centres[order]


def _silhouette(apart: np.ndarray, label: np.ndarray) -> float:
    """The mean over rows of how much nearer they are to their own cluster than to the next; rows alone in theirs count 0."""
    kinds = np.unique(label)
    sizes = np.array([(label == c).sum() for c in kinds])
    sums = np.stack([apart[:, label == c].sum(1) for c in kinds], axis=1)
    own = np.searchsorted(kinds, label)
    rows = np.arange(len(label))
    inside = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[rows, own] = np.inf
    other = means.min(1)
    both = np.maximum(inside, other)
    return float(np.where((sizes[own] > 1) & (both > 0), (other - inside) / np.where(both > 0, both, 1), 0.0).mean())


class TaskStore:
    """SP21 with SS2, SP20, SP22 and AG22: one task's samples, bounded in all, binned anew as they come.

    Each sample counts; where the count leaves 1 when divided by ``every`` and the store is full, bins are made anew from the
    stored samples (vectors beside weighted rewards), capacities are shared out again and bins over theirs lose samples by
    hash. Then the sample goes to the bin of the nearest centre (0 before there are any). The first ``total`` samples enter; later ones are
    refused where nearer than the threshold to one of their bin, else they enter while there is room or replace the nearest one
    (or one by hash). The threshold is ``scale`` times the median of all distances taken so far, from five on and unless it is 0. As the first ``total`` enter whatever their bin, other
    bins may have room left: the store holds less than twice ``total``.
    """

    def __init__(self, total: int, every: int, bins: tuple[int, int] = (2, 5), initial: float = 0.3, scale: float = 1.0, reward_weight: float = 0.3, replace: str = "nearest", weights: tuple[float, float, float] = (1.0, 0.0, 0.0)):
        self.total, self.every, self.bins, self.initial, self.scale, self.reward_weight, self.replace, self.weights = total, every, bins, initial, scale, reward_weight, replace, weights
        self.seen = 0
        self.centres: np.ndarray | None = None
        self.n_bins = bins[0]
        self.samples: dict[int, tuple[int, np.ndarray, float, float]] = {}  # id: bin, vector, reward, time; in order of entry
        self.distances: list[float] = []  # in order of size
        self.fresh: list[float] = []  # taken since the last time the state was put away
        self.touched: set[int] = set()

    def capacity(self, of: int) -> int:
        return self.total // self.n_bins + (of < self.total % self.n_bins)

    def threshold(self) -> float:
        n = len(self.distances)
        m = (self.distances[(n - 1) // 2] + self.distances[n // 2]) / 2 if n >= 5 else 0.0
        return self.initial if m < 1e-9 else self.scale * m

    def offer(self, sample_id: int, vector: np.ndarray, reward: float) -> list[tuple[int, str, int, int | None]]:
        """(sample, fate, bin, sample that left for it) of this sample and, before it, of those trimmed on its arrival."""
        out = []
        self.seen += 1
        if self.seen % self.every == 1 and len(self.samples) >= max(self.total, self.bins[0], 2):
            out += self._rebin()
        time = float(self.seen - 1)
        at = 0 if self.centres is None else int(((self.centres - np.r_[vector, reward * self.reward_weight]) ** 2).sum(1).argmin())
        if len(self.samples) < self.total:
            self._enter(sample_id, at, vector, reward, time)
            self._take(0.0)  # the sample finds itself
            return [*out, (sample_id, "added", at, None)]
        mine = [i for i, s in self.samples.items() if s[0] == at]
        near, away = None, None
        if mine:
            alpha, beta, gamma = self.weights
            vectors, extras = np.stack([self.samples[i][1] for i in mine]), np.array([self.samples[i][2:] for i in mine])
            d = np.sqrt(alpha * ((vectors - vector) ** 2).sum(1) + beta * (extras[:, 0] - reward) ** 2 + gamma * (extras[:, 1] - time) ** 2)
            near, away = mine[int(d.argmin())], float(d.min())
            if away < self.threshold():
                return [*out, (sample_id, "refused", at, None)]
        gone = None
        if mine and len(mine) >= self.capacity(at):
            gone = near if self.replace == "nearest" else min(mine, key=lambda i: zlib.crc32(f"{self.seen}|{i}".encode()))
            self._leave(gone)
        self._enter(sample_id, at, vector, reward, time)
        if away is not None:
            self._take(away)
        return [*out, (sample_id, "added" if gone is None else "replaced", at, gone)]

    def _rebin(self) -> list[tuple[int, str, int, int | None]]:
        ids = list(self.samples)
        label, self.centres = clusters(np.stack([np.r_[self.samples[i][1], self.samples[i][2] * self.reward_weight] for i in ids]), *self.bins)
        self.n_bins = len(self.centres)
        out = []
        for i, b in zip(ids, label.tolist(), strict=True):
            self.samples[i] = (b, *self.samples[i][1:])
        self.touched.update(ids)
        for b in range(self.n_bins):
            mine = sorted((i for i, s in self.samples.items() if s[0] == b), key=lambda i: zlib.crc32(f"{self.seen}|{i}".encode()))
            for i in mine[: max(0, len(mine) - self.capacity(b))]:
                self._leave(i)
                out.append((i, "trimmed", b, None))
        return out

    def _take(self, distance: float) -> None:
        bisect.insort(self.distances, distance)
        self.fresh.append(distance)

    def _enter(self, sample_id: int, at: int, vector: np.ndarray, reward: float, time: float) -> None:
        self.samples.pop(sample_id, None)
        self.samples[sample_id] = (at, vector, reward, time)
        self.touched.add(sample_id)

    def _leave(self, sample_id: int) -> None:
        del self.samples[sample_id]
        self.touched.add(sample_id)


REBINNED = "sample_id long, fate string, bin_id int, gone long"


def rebinned(samples: DataFrame, task: str, **policy) -> DataFrame:
    """(task, sample_id, fate, bin_id, gone) of all samples (task, sample_id, embedding, reward) in order of id, by a ``TaskStore`` each task.

    Each step needs the last, so a task's rows pass one Spark task in order, as a stream; what is held is the bounded store and a number a
    distance taken. Rows without a vector are left out.
    """
    kind = samples.schema[task].dataType.simpleString()
    rows = samples.where("size(embedding) > 0").select(task, "sample_id", F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(F.col("reward").cast("double"), F.lit(0.0)).alias("reward"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, store = object(), None
        for pdf in it:
            out = []
            for t, i, v, r in zip(pdf[task], pdf["sample_id"], pdf["embedding"], pdf["reward"], strict=True):
                if store is None or t != current:
                    current, store = t, TaskStore(**policy)
                out += [(t, *x) for x in store.offer(int(i), np.asarray(v, float), float(r))]
            fates = pd.DataFrame(out, columns=[task, "sample_id", "fate", "bin_id", "gone"])
            yield fates.assign(gone=fates["gone"].astype("Int64"))

    dealt = rows.where(F.col(task).isNotNull()).repartition(width(rows.sparkSession), task).sortWithinPartitions(task, "sample_id")
    return dealt.mapInPandas(run, f"{task} {kind}, {REBINNED}")


def observation_scale(rows: DataFrame, columns: list[str]) -> DataFrame:
    """AG25: each column less its mean, by its population spread plus 1e-8."""
    stats = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = rows.crossJoin(F.broadcast(stats))
    return out.withColumns({c: (F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-8) for c in columns}).drop(*[f"{n}_{c}" for c in columns for n in "ms"])


def running_moments(rows: DataFrame, column: str) -> DataFrame:
    """AG16: mean and variance over all batches, merged as Spark merges partial aggregates."""
    return rows.agg(F.avg(column).alias("mean"), F.var_pop(column).alias("variance"), F.count(column).alias("n"))


def running_steps(rows: DataFrame, batch: str, column: str, epsilon: float = 1e-4) -> DataFrame:
    """AG16, step by step as it is kept online: (batch, mean, variance, weight) after each batch in order of ``batch``.

    The weight starts at ``epsilon`` with mean 0 and variance 1. A step sets the mean to the batch's plus the batch's share of the
    weight so far, and adds the batch's sample variance by its rows and the squared move of the mean by w n / (w + n)
    to the sum of squares: sums over the batches before, so a prefix scan. Batches are moments of their rows by partial
    aggregation, numbered and summed by ranges; a batch of one row has no sample variance and counts none.
    """
    moments = rows.groupBy(F.col(batch).alias("batch")).agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.coalesce(F.var_samp(column), F.lit(0.0)).alias("v")).where("n > 0")
    weighed = running_sums(moments, "batch", ["n"])
    total = F.col("n_sum") + F.lit(epsilon)
    steps = weighed.withColumns({"weight": total, "mean": F.col("m") + F.col("n") / total})
    # the step before, by number; before the first stand the mean 0 and the weight epsilon
    before = steps.select((F.col("number") + 1).alias("number"), F.col("mean").alias("mean_before"), F.col("weight").alias("weight_before"))
    steps = steps.join(before, "number", "left").fillna({"mean_before": 0.0, "weight_before": epsilon})
    move = F.col("m") - F.col("mean_before")
    added = steps.withColumn("s", F.col("v") * F.col("n") + move * move * F.col("weight_before") * F.col("n") / F.col("weight"))
    summed = running_sums(added.select("batch", "mean", "weight", "s"), "batch", ["s"])
    return summed.select(F.col("batch").alias(batch), "mean", ((F.col("s_sum") + epsilon) / F.col("weight")).alias("variance"), "weight")


def distinct_check(rows: DataFrame, column: str, expected: int) -> DataFrame:
    """ST8: whether a column has the expected number of distinct values."""
    return rows.agg(F.countDistinct(column).alias("n_distinct"), (F.countDistinct(column) == expected).alias("ok"))
