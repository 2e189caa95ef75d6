"""Exact nearest neighbours among points of few dimensions, by boxes.

Medians of a bounded sample cut space into boxes, which only deal the rows to tasks. A task finds the nearest points of a box's queries inside the box, by a
tree of its own. A query whose neighbours can't be beaten from outside is done there; the others go to the boxes that their reach
touches, and what is found there is merged. The work of a query does not grow with the number of points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.common import width, written

#: Dimensions up to which boxes are used.
MAX_DIMENSIONS = 8
#: Points of a box, about, and of a leaf of the tree that a task makes of it.
BOX_ROWS = 8192
LEAF = 64
#: Vectors that are sent to the driver to cut space, about; a box has some of them at least.
SAMPLE, SAMPLED = 65_536, 16
_DIGITS = 9
#: Beyond the distance at rank k by so much, rounding can't bring a point level.
_LEVEL = 2e-9


class _Cuts:
    """A balanced tree of cuts, in heap order, and the boxes that its leaves stand for."""

    def __init__(self, x: np.ndarray, depth: int):
        self.depth, n = depth, 1 << depth
        self.axis, self.at = np.zeros(n, np.int64), np.zeros(n)
        self.low, self.high = np.full((2 * n, x.shape[1]), -np.inf), np.full((2 * n, x.shape[1]), np.inf)
        held = {1: x}
        for node in range(1, n):
            part = held.pop(node)
            axis = int(part.std(0).argmax()) if len(part) else 0
            at = float(np.median(part[:, axis])) if len(part) else 0.0
            self.axis[node], self.at[node] = axis, at
            for child, side in ((2 * node, part[:, axis] < at), (2 * node + 1, part[:, axis] >= at)):
                held[child] = part[side]
                self.low[child], self.high[child] = self.low[node], self.high[node]
            self.high[2 * node, axis] = min(self.high[2 * node, axis], at)
            self.low[2 * node + 1, axis] = max(self.low[2 * node + 1, axis], at)
        self.low, self.high = self.low[n:], self.high[n:]

    def box(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] >= self.at[node])
        return node - (1 << self.depth)

    def touched(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, box): the boxes that come within ``reach`` of each x, in a walk down the tree."""
        i, node = np.arange(len(x)), np.ones(len(x), np.int64)
        for _ in range(self.depth):
            apart = x[i, self.axis[node]] - self.at[node]
            left, right = apart <= reach[i], apart >= -reach[i]
            i, node = np.r_[i[left], i[right]], np.r_[2 * node[left], 2 * node[right] + 1]
        node -= 1 << self.depth
        gap = np.maximum(0, np.maximum(self.low[node] - x[i], x[i] - self.high[node]))
        near = (gap * gap).sum(1) <= (reach[i] * (1 + 1e-12)) ** 2
        return i[near], node[near]


def _leaves(x: np.ndarray, q: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of x in leaves of up to about ``most``, each with the rows of q on its side of the cuts."""
    out, todo = [], [(np.arange(len(x)), np.arange(len(q)))]
    while todo:
        i, j = todo.pop()
        spread = np.ptp(x[i], axis=0) if len(i) > most else np.zeros(1)
        axis = int(spread.argmax())
        if not spread[axis] > 0:
            out.append((i, j))
            continue
        order = i[np.argpartition(x[i, axis], len(i) // 2)]
        half = len(i) // 2
        at = x[order[half], axis]
        side = q[j, axis] < at
        todo += [(order[:half], j[side]), (order[half:], j[~side])]
    return out


def _apart(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squares of distances, summed in the order of dimensions."""
    out = np.zeros((len(q), len(x)))
    for n in range(q.shape[1]):
        d = np.subtract.outer(q[:, n], x[:, n])
        d *= d
        out += d
    return out


def _search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, reach: np.ndarray, k: int, tally: Accumulator | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, rounded distance) of the k of x that rank first within each reach, by rounded distance, then id; in order of row and rank."""
    leaves = _leaves(x, q, max(LEAF, 4 * k))
    rows = np.concatenate([i for i, _ in leaves])
    ends = np.cumsum([len(i) for i, _ in leaves])
    starts = ends - [len(i) for i, _ in leaves]
    x, ids = x[rows], ids[rows]
    low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
    out, made = [], 0
    for (_, j), a, b in zip(leaves, starts, ends, strict=True):
        for at in range(0, len(j), LEAF):
            mine = j[at : at + LEAF]
            p, r = q[mine], reach[mine]
            if b - a >= k:
                own = np.sqrt(np.partition(_apart(p, x[a:b]), k - 1, axis=1)[:, k - 1])
                r, made = np.minimum(r, own), made + len(mine) * int(b - a)
            r = r + _LEVEL
            gap = np.maximum(0, np.maximum(low - p.max(0), p.min(0) - high))
            near = np.flatnonzero((gap * gap).sum(1) <= (r.max() * (1 + 1e-12)) ** 2)
            if not len(near):
                continue
            may = np.concatenate([np.arange(starts[n], ends[n]) for n in near])
            # leaves come near the whole chunk; most points of them don't
            gap = np.maximum(0, np.maximum(p.min(0) - x[may], x[may] - p.max(0)))
            may = may[(gap * gap).sum(1) <= (r.max() * (1 + 1e-12)) ** 2]
            square = _apart(p, x[may])
            made += square.size
            limit = r
            if len(may) > k:
                limit = np.minimum(r, np.sqrt(np.partition(square, k - 1, axis=1)[:, k - 1]) + _LEVEL)
            i, c = np.nonzero(square <= ((limit * (1 + 1e-12)) ** 2)[:, None])
            d, p_id = np.round(np.sqrt(square[i, c]), _DIGITS), ids[may[c]]
            order = np.lexsort((p_id, d, i))
            i, d, p_id = i[order], d[order], p_id[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            out.append((mine[i[rank < k]], p_id[rank < k], d[rank < k]))
    if tally is not None:
        tally.add(made)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, p_id, d = (np.concatenate(z) for z in zip(*out, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], p_id[order], d[order]


def _matrix(v: pd.Series, dims: int) -> np.ndarray:
    return np.concatenate(v.to_list()).astype(float).reshape(-1, dims) if len(v) else np.zeros((0, dims))


def nearest(queries: DataFrame, points: DataFrame, dims: int, k: int, tally: Accumulator | None = None) -> DataFrame:
    """(q, p, d, rank): the k nearest points (id, v; up to k of equal ones) of each query (id, v; all different), ties by id. Vectors are finite, of ``dims`` numbers."""
    spark, w = points.sparkSession, width(points.sparkSession)
    n = points.count()
    seen = F.pmod(F.xxhash64("v"), F.lit(-(-n // SAMPLE))) == 0
    sample = np.array([r["v"] for r in points.where(seen).select("v").distinct().collect()], float).reshape(-1, dims)
    sample = sample[np.lexsort(sample.T)]
    depth = max(0, min(-(-n // BOX_ROWS), len(sample) // SAMPLED).bit_length() - 1)
    cuts = spark.sparkContext.broadcast(_Cuts(sample, depth))

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(box=cuts.value.box(_matrix(pdf["v"], dims)))

    def spread(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                i, box = cuts.value.touched(_matrix(part["v"], dims), part["reach"].to_numpy(float))
                other = box != part["box"].to_numpy()[i]
                yield part.iloc[i[other]].assign(box=box[other])

    def lists(q: pd.DataFrame, x: pd.DataFrame, reach: np.ndarray) -> pd.DataFrame:
        """One row a query that has any: its points and their distances in order."""
        row, p, d = _search(_matrix(x["v"], dims), x["id"].to_numpy(np.int64), _matrix(q["v"], dims), reach, k, tally)
        at, first = np.unique(row, return_index=True)
        parts = [pd.Series(np.split(z, first[1:]) if len(at) else [], dtype=object) for z in (p, d)]
        return pd.DataFrame({"row": at, "p": parts[0], "d": parts[1]})

    def inside(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(q):
            return pd.DataFrame(columns=["id", "box", "v", "p", "d", "reach", "done"], dtype=object)
        out = q[["id", "box", "v"]].reset_index(drop=True)
        if len(x):
            out = out.join(lists(q, x, np.full(len(q), np.inf)).set_index("row"))
        for c in "pd":
            out[c] = pd.Series([v if isinstance(v, np.ndarray) else None for v in out[c]] if c in out else [None] * len(out), dtype=object)
        out["reach"] = [v[-1] + _LEVEL if isinstance(v, np.ndarray) and len(v) == k else np.inf for v in out["d"]]
        m, box = _matrix(out["v"], dims), int(out["box"].iloc[0])
        room = np.minimum(m - cuts.value.low[box], cuts.value.high[box] - m).min(1)
        return out.assign(done=room > out["reach"].to_numpy() + _LEVEL if depth else True)[["id", "box", "v", "p", "d", "reach", "done"]]

    def outside(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame(columns=["id", "p", "d"], dtype=object)
        found = lists(q, x, q["reach"].to_numpy(float))
        return found.assign(id=q["id"].to_numpy()[found["row"].to_numpy(int)])[["id", "p", "d"]]

    def met(q: DataFrame, by, schema: str) -> DataFrame:
        # the count is given, as Spark would join partitions by their bytes, which say little of the work
        return boxed.repartition(w, "box").groupBy("box").cogroup(q.repartition(w, "box").groupBy("box")).applyInPandas(by, schema)

    boxed = points.select("id", "v").mapInPandas(assign, "id long, v array<double>, box long")
    asked = queries.select("id", "v").mapInPandas(assign, "id long, v array<double>, box long")
    own = written(met(asked, inside, "id long, box long, v array<double>, p array<long>, d array<double>, reach double, done boolean"), "box-own")
    border = own.where("not done")
    sent = border.select("id", "v", "box", "reach").mapInPandas(spread, "id long, v array<double>, box long, reach double")
    zipped = F.arrays_zip("d", "p")
    both = border.where("p is not null").select("id", zipped.alias("z")).union(met(sent, outside, "id long, p array<long>, d array<double>").select("id", zipped.alias("z")))
    merged = both.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("z"))), 1, k).alias("z"))
    every = own.where("done").select("id", zipped.alias("z")).union(merged)
    return every.select(F.col("id").alias("q"), F.posexplode("z").alias("rank", "z")).select("q", F.col("z.p").alias("p"), F.col("z.d").alias("d"), (F.col("rank") + 1).alias("rank"))
