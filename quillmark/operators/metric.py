"""Exact nearest-neighbour and range joins between vectors, by pivots and triangle bounds.

Space is cut into cells, each of the points nearest to one pivot; a cell's points lie in rings, stretches of up to ``RING`` points
in order of their distance to the pivot. A query first meets the rings of its own cell at its own distance, which
bounds how far its neighbours can be. It then goes only to cells that the bound reaches: a cell j is out of reach if
half of d(q, p_j) - d(q, p_own) is over it, or if all its rings are farther inside or outside. Chunks of queries and rings
are packed rows, joined by block and cell where their distances to the pivot come within the bound.

Points of up to eight dimensions, where no blocks are asked for, are searched by boxes instead, see ``boxes``.

Nothing is dropped: bounds only leave out what cannot be a neighbour. Cells and rings are dealt by ranges of (block, cell,
distance, id), so a crowded cell is many tasks' work; of equal points only the first k ids can be neighbours, and equal queries
are asked once, so copies multiply nothing. In data without structure (random vectors of many dimensions) bounds reach
everywhere: the join then makes about all distances, in matrix products, and sends a query to at most ``MAX_PIVOTS`` cells.

Rows without an id or a vector are left out; ids are whole numbers. A null block is a block. An empty side gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.common import release, width, written
from quillmark.operators import boxes

#: Points a cell has on average, as long as there are pivots for that.
CELL_ROWS = 1024
#: At most so many pivots are drawn and sent to the tasks, whatever the number of points.
MAX_PIVOTS = 1024
#: Points of a ring and queries of a chunk.
RING = 1024
CHUNK = 256
#: Relative error that matrix products may have before exact distances are taken.
_MARGIN = 1e-9
_DIGITS = 9


def _blocked(rows: DataFrame, key: str, block: str | None) -> DataFrame:
    """(b, key, v): the block as text, the id and the vector, without incomplete rows."""
    b = F.to_json(F.struct(F.col(block).alias("b"))) if block else F.lit("")
    return rows.select(b.alias("b"), F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("v")).where(f"{key} is not null and size(v) > 0")


def _level(n: Column) -> Column:
    """How many pivots a block of n points uses: a power of two, so that there are few kinds of cells."""
    wanted = F.least(F.greatest(F.ceil(n / F.lit(CELL_ROWS)), F.lit(1)), F.lit(MAX_PIVOTS))
    return F.pow(F.lit(2.0), F.floor(F.log2(wanted.cast("double")))).cast("int")


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), float)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact distances of all rows of x and y, a few dimensions at once."""
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        out += (x[:, i, None] - y[None, :, i]) ** 2
    return np.sqrt(out)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (b, cell, away, id, v, reach) in stretches of ``size`` by distance: (b, cell, low, high, reach, n, ids, m, r)."""

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in it:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            cut = held["cell"].to_numpy()[1:] != held["cell"].to_numpy()[:-1]
            cut |= held["b"].to_numpy()[1:] != held["b"].to_numpy()[:-1]
            edges = np.r_[0, np.flatnonzero(cut) + 1, len(held)]
            parts = [(i, min(i + size, b)) for a, b in zip(edges, edges[1:], strict=False) for i in range(a, b, size)]
            open_ = parts and parts[-1][1] - parts[-1][0] < size  # the last stretch may go on in the next batch
            yield stretches(held, parts[:-1] if open_ else parts)
            held = held.iloc[parts[-1][0] :].reset_index(drop=True) if open_ else None
        if held is not None and len(held):
            yield stretches(held, [(0, len(held))])

    def stretches(pdf: pd.DataFrame, parts: list[tuple[int, int]]) -> pd.DataFrame:
        out = []
        for i, j in parts:
            p = pdf.iloc[i:j]
            reach = p["reach"].to_numpy(float)
            out.append((p["b"].iloc[0], int(p["cell"].iloc[0]), float(p["away"].iloc[0]), float(p["away"].iloc[-1]), float(reach.max()), j - i, p["id"].to_numpy(np.int64).tobytes(), _matrix(p["v"]).tobytes(), reach.tobytes()))
        return pd.DataFrame(out, columns=["b", "cell", "low", "high", "reach", "n", "ids", "m", "r"])

    dealt = rows.select("b", "cell", "away", "id", "v", "reach").repartitionByRange(width(rows.sparkSession), "b", "cell", "away", "id").sortWithinPartitions("b", "cell", "away", "id")
    return dealt.mapInPandas(pack, "b string, cell int, low double, high double, reach double, n int, ids binary, m binary, r binary")


def _candidates(chunks: DataFrame, rings: DataFrame, keep: Callable, tally: Accumulator | None, bounded: bool = True) -> DataFrame:
    """(q, p, d) of chunks and rings of one cell that come within reach; ``keep(d, ids, limit)`` picks of a ring what counts for a query.

    Points beyond a query's reach are none of its own, unless not ``bounded``: then the reach only says which rings are met.
    """
    c, r = chunks.alias("c"), rings.alias("r")
    near = (F.col("r.low") - F.col("c.high") <= F.col("c.reach")) & (F.col("c.low") - F.col("r.high") <= F.col("c.reach"))
    met = c.join(r, (F.col("c.b") == F.col("r.b")) & (F.col("c.cell") == F.col("r.cell")) & near)
    met = met.select(F.col("c.ids").alias("q"), F.col("c.m").alias("x"), F.col("c.r").alias("reach"), F.col("r.ids").alias("p"), F.col("r.m").alias("y"))

    def compare(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples(index=False):
                q, p, reach = np.frombuffer(row.q, np.int64), np.frombuffer(row.p, np.int64), np.frombuffer(row.reach)
                x, y = np.frombuffer(row.x).reshape(len(q), -1), np.frombuffer(row.y).reshape(len(p), -1)
                if x.shape[1] != y.shape[1]:
                    raise ValueError(f"vectors of {x.shape[1]} and of {y.shape[1]} dimensions have no distance")
                yy, out = (y * y).sum(1), []
                if tally is not None:
                    tally.add(len(q) * len(p))
                square = (x * x).sum(1)[:, None] + yy - 2 * (x @ y.T)
                slack = _MARGIN * (1 + (x * x).sum(1)[:, None] + yy)
                limit = reach + 10.0**-_DIGITS if bounded else np.full(len(reach), np.inf)
                for i, close in enumerate(square <= limit[:, None] ** 2 + slack):
                    at = np.flatnonzero(close)
                    if len(at):
                        d = np.sqrt(((y[at] - x[i]) ** 2).sum(1))
                        chosen = keep(d, p[at], limit[i])
                        out.append((np.full(len(chosen), q[i]), p[at][chosen], d[chosen]))
                if out:
                    a, b, d = (np.concatenate(z) for z in zip(*out, strict=True))
                    yield pd.DataFrame({"q": a, "p": b, "d": np.round(d, _DIGITS)})

    return met.mapInPandas(compare, "q long, p long, d double")


def _least(k: int) -> Callable:
    """The k that rank first by rounded distance, then id, of those within the limit."""

    def keep(d: np.ndarray, ids: np.ndarray, limit: float) -> np.ndarray:
        near = np.flatnonzero(d <= limit)
        return near if len(near) <= k else near[np.lexsort((ids[near], np.round(d[near], _DIGITS)))[:k]]

    return keep


def _first_inside(radius: float) -> Callable:
    """Of the points nearer than ``radius`` the least id."""

    def keep(d: np.ndarray, ids: np.ndarray, limit: float) -> np.ndarray:
        near = np.flatnonzero(d < radius)
        return near[ids[near].argmin() :][:1] if len(near) else near

    return keep


def _first_copies(points: DataFrame, copies: int) -> DataFrame:
    """(b, id, v, copy): of equal points only the first ids can be among the nearest; Spark cuts groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("b", "v").orderBy("p"))
    return points.withColumn("copy", rank).where(F.col("copy") <= copies).select("b", F.col("p").alias("id"), "v", "copy")


def _few_dimensions(*rows: DataFrame) -> int | None:
    """How many dimensions all vectors have, if they are finite and so few that boxes do better than pivots."""
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kinds = functools.reduce(DataFrame.union, [r.groupBy(F.size("v").alias("dims"), odd.alias("odd")).count().select("dims", "odd") for r in rows]).distinct().limit(2).collect()
    return kinds[0]["dims"] if len(kinds) == 1 and not kinds[0]["odd"] and kinds[0]["dims"] <= boxes.MAX_DIMENSIONS else None


class _Space:
    """Points in rings, the pivots, and per kind of cell how near and far its points lie."""

    def __init__(self, points: DataFrame, copies: int, tally: Accumulator | None):
        self.tally, spark = tally, points.sparkSession
        held = written(_first_copies(points, copies), "metric-points")
        drawn = held.where("copy = 1").select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(MAX_PIVOTS).collect()
        if len({len(r["v"]) for r in drawn}) > 1:
            raise ValueError("vectors of several dimensions have no distance")
        self.empty = not drawn
        if self.empty:
            return
        self.pivots = spark.sparkContext.broadcast(np.array([r["v"] for r in drawn]))
        self.sizes = written(held.groupBy("b").agg(F.least(_level(F.count("*")), F.lit(len(drawn))).alias("level")), "metric-blocks")
        self.rings = written(_packed(self.cells(held).withColumn("reach", F.lit(0.0)), RING), "metric-rings")
        release(held)
        limits = self.rings.join(self.sizes, "b").groupBy("level", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()  # at most 3 * MAX_PIVOTS rows
        self.limits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for row in limits:
            low, high = self.limits.setdefault(row["level"], (np.full(row["level"], np.inf), np.full(row["level"], -np.inf)))
            low[row["cell"]], high[row["cell"]] = row["low"], row["high"]

    def cells(self, rows: DataFrame) -> DataFrame:
        """(b, level, cell, away, id, v) of rows (b, id, v): the nearest pivot and its distance. Blocks without points are left out."""
        pivots, tally = self.pivots, self.tally

        def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for n, part in _parts(it):
                d = _apart(_matrix(part["v"]), pivots.value[:n])
                if tally is not None:
                    tally.add(d.size)
                yield part.assign(cell=d.argmin(1), away=d.min(1))[["b", "level", "cell", "away", "id", "v"]]

        return rows.select("b", "id", "v").join(self.sizes, "b").mapInPandas(assign, "b string, level int, cell int, away double, id long, v array<double>")

    def reached(self, asked: DataFrame) -> DataFrame:
        """(b, cell, away, id, v, reach): each query (b, level, id, v, reach) once for every cell that its reach touches."""
        pivots, limits, tally = self.pivots, self.limits, self.tally

        def spread(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for n, part in _parts(it):
                d = _apart(_matrix(part["v"]), pivots.value[:n])
                if tally is not None:
                    tally.add(d.size)
                r = part["reach"].to_numpy(float)[:, None] + 10.0**-_DIGITS
                low, high = limits[n]
                i, j = np.nonzero((d - d.min(1, keepdims=True) <= 2 * r) & (d - high <= r) & (low - d <= r))
                yield part.iloc[i].assign(cell=j, away=d[i, j])[["b", "cell", "away", "id", "v", "reach"]]

        return asked.select("b", "level", "id", "v", "reach").mapInPandas(spread, "b string, cell int, away double, id long, v array<double>, reach double")

    def within(self, asked: DataFrame, keep: Callable) -> DataFrame:
        """(q, p, d) of queries (b, level, id, v, reach) and points within their reach."""
        return _candidates(_packed(self.reached(asked), CHUNK), self.rings, keep, self.tally)


#: Rows of a side that a task gets where all queries of a block meet all its points, and how many of each side are multiplied at once.
SIDE_ROWS, PRODUCT = 65_536, (256, 4096)


def _sends(space: _Space, asked: DataFrame) -> int:
    """How many rows ``reached`` makes; none of them is moved."""
    pivots, limits = space.pivots, space.limits

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, part in _parts(it):
            d, r = _apart(_matrix(part["v"]), pivots.value[:n]), part["reach"].to_numpy(float)[:, None] + 10.0**-_DIGITS
            low, high = limits[n]
            yield pd.DataFrame({"n": [int(((d - d.min(1, keepdims=True) <= 2 * r) & (d - high <= r) & (low - d <= r)).sum())]})

    return asked.select("b", "level", "id", "v", "reach").mapInPandas(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _least_of_products(x: np.ndarray, reach: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, id, rounded distance) of the k of y that rank first within each row's reach. Products in single precision tell what may be among them."""
    centre = y.mean(0)
    xc, yc = x - centre, y - centre
    xx, yy = (xc * xc).sum(1), (yc * yc).sum(1)
    kind = np.float32 if max(xx.max(), yy.max()) < 1e30 else np.float64
    slack = (2e-7 if kind == np.float32 else 1e-15) * (x.shape[1] + 8) * (xx + yy.max())
    left, right = np.c_[-2 * xc, xx, np.ones(len(x))].astype(kind), np.c_[yc, np.ones(len(y)), yy].astype(kind).T
    limit = (reach + 2 * 10.0**-_DIGITS) ** 2 + slack
    row, col, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(y), PRODUCT[1]):
        square = left @ right[:, at : at + PRODUCT[1]]
        if not at and square.shape[1] > k:
            last = np.maximum(np.partition(square, k - 1, axis=1)[:, k - 1].astype(float) + slack, 0)
            limit = np.minimum(limit, (np.sqrt(last) + 2 * 10.0**-_DIGITS) ** 2 + slack)
        i, j = np.nonzero(square <= np.nextafter(limit.astype(kind), kind(np.inf))[:, None])
        j += at
        d = np.concatenate([np.sqrt(((y[j[c : c + 65_536]] - x[i[c : c + 65_536]]) ** 2).sum(1)) for c in range(0, len(i), 65_536)] or [np.zeros(0)])
        near = d <= reach[i] + 10.0**-_DIGITS
        row, col, dist = np.r_[row, i[near]], np.r_[col, j[near]], np.r_[dist, np.round(d[near], _DIGITS)]
        order = np.lexsort((ids[col], dist, row))
        row, col, dist = row[order], col[order], dist[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col, dist = row[first], col[first], dist[first]
    return row, ids[col], dist


def _met_by_all(chunks: DataFrame, rings: DataFrame, sides: DataFrame, k: int, tally: Accumulator | None) -> DataFrame:
    """(q, p, d) as ``_candidates``, where bounds tell little: chunks and rings of a block are dealt to ``side`` parts each, and every two parts meet in a task.

    A row is moved ``side`` times, however many cells its reach touches.
    """
    def dealt(packed: DataFrame, mine: str, other: str) -> DataFrame:
        parts = packed.join(F.broadcast(sides), "b").withColumn(mine, F.pmod(F.xxhash64("ids"), F.col("side"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("side").cast("long") - 1)))
        return parts.select("b", "i", "j", "ids", "m", "r").repartition(width(packed.sparkSession), "b", "i", "j").groupBy("b", "i", "j")

    def compare(c: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(c) and len(r):
            p = np.concatenate([np.frombuffer(v, np.int64) for v in r["ids"]])
            y = np.concatenate([np.frombuffer(v) for v in r["m"]]).reshape(len(p), -1)
            for row in c.itertuples(index=False):
                q, reach = np.frombuffer(row.ids, np.int64), np.frombuffer(row.r)
                x = np.frombuffer(row.m).reshape(len(q), -1)
                if x.shape[1] != y.shape[1]:
                    raise ValueError(f"vectors of {x.shape[1]} and of {y.shape[1]} dimensions have no distance")
                if tally is not None:
                    tally.add(len(q) * len(p))
                found = _least_of_products(x, reach, y, p, k)
                out.append(pd.DataFrame({"q": q[found[0]], "p": found[1], "d": found[2]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"q": np.zeros(0, np.int64), "p": np.zeros(0, np.int64), "d": np.zeros(0)})

    return dealt(chunks, "i", "j").cogroup(dealt(rings, "j", "i")).applyInPandas(compare, "q long, p long, d double")


#: Distances to pivots that are held at once; a query that reaches every cell is sent so often.
_AT_ONCE = 16_384


def _parts(it: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Rows of one level each, so many that all the cells of its pivots take a bounded number of rows."""
    for pdf in it:
        for n in sorted(set(pdf["level"])):
            rows, step = pdf[pdf["level"] == n], max(1, _AT_ONCE // n)
            yield from ((n, rows.iloc[s : s + step]) for s in range(0, len(rows), step))


def _numbered(asked: DataFrame) -> DataFrame:
    """(b, v, id): equal queries once, with a number of their own."""
    return written(asked.select("b", "v").distinct().withColumn("id", F.monotonically_increasing_id()), "metric-queries")


def nearest(queries: DataFrame, points: DataFrame, k: int, block: str | None = None, tally: Accumulator | None = None) -> DataFrame:
    """(q, [block], p, distance, rank) of the k nearest points (p, embedding) of every query (q, embedding), exactly, ties by id.

    Distances are rounded to nine digits before they are ranked. With ``block`` a query sees the points of its own block.
    ``tally`` adds up how many distances are computed, to pivots and to points.
    """
    asked, names = _blocked(queries, "q", block), ["q", *([block] if block else [])]
    dealt = _blocked(points, "p", block)
    dims = _few_dimensions(dealt, asked) if block is None else None
    if dims:
        once = _numbered(asked)
        held = written(_first_copies(dealt, k), "metric-points")
        out = asked.join(once, "v").select("q", once["id"]).join(boxes.nearest(once, held, dims, k, tally).withColumnRenamed("q", "id"), "id")
        return out.select(F.col("q").cast(queries.schema["q"].dataType).alias("q"), F.col("p").cast(points.schema["p"].dataType).alias("p"), F.col("d").alias("distance"), "rank")
    space = _Space(dealt, k, tally)
    if space.empty:
        kinds = [f"{c} {queries.schema[c].dataType.simpleString()}" for c in names]
        return queries.sparkSession.createDataFrame([], ", ".join([*kinds, "p long, distance double, rank int"]))
    once = _numbered(asked)
    own = written(space.cells(once), "metric-cells")
    order = Window.partitionBy("q").orderBy("d", "p")
    # what a query finds in the rings of its own cell at its own distance bounds how far its neighbours are
    found = _candidates(_packed(own.withColumn("reach", F.lit(0.0)), CHUNK), space.rings, _least(k), tally, bounded=False)
    last = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).where(F.col("rank") == k).select(F.col("q").alias("id"), F.col("d").alias("bound"))
    bounded = written(own.join(last, "id", "left").select("b", "level", "cell", "away", "id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("reach")), "metric-reach")
    release(own)
    # where bounds tell little, all queries of a block meet all its points; a row is moved as often as the block has sides
    rows = space.rings.groupBy("b").agg(F.sum("n").alias("points")).join(bounded.groupBy("b").agg(F.count("*").alias("queries")), "b")
    total = rows.agg(F.sum(F.greatest("points", "queries"))).first()[0] or 1
    part = F.greatest("points", "queries")
    side = F.greatest(F.ceil(part / F.lit(SIDE_ROWS)), F.ceil(part * F.lit(width(queries.sparkSession) ** 0.5 / total)))
    sides = written(rows.withColumn("side", side).select("b", "side", (side * (F.col("points") + F.col("queries"))).alias("moved")), "metric-sides")
    moved = sides.agg(F.coalesce(F.sum("moved"), F.lit(0))).first()[0]
    if _sends(space, bounded) > moved:
        near = _met_by_all(_packed(bounded, PRODUCT[0]), space.rings, sides.select("b", "side"), k, tally)
    else:
        near = space.within(bounded, _least(k))
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = asked.join(once, ["b", "v"]).select("q", "b", "id")
    out = named.join(ranked.select(F.col("q").alias("id"), "p", F.col("d").alias("distance"), "rank"), "id")
    back = [F.from_json("b", f"b {queries.schema[block].dataType.simpleString()}")["b"].alias(block)] if block else []
    return out.select(F.col("q").cast(queries.schema["q"].dataType).alias("q"), *back, F.col("p").cast(points.schema["p"].dataType).alias("p"), "distance", "rank")


def first_within(points: DataFrame, radius: float, block: str | None = None, tally: Accumulator | None = None) -> DataFrame:
    """(p, [block], first) of every point (p, embedding): the least id of the points nearer than ``radius``, itself among them."""
    asked, names = _blocked(points, "p", block), ["p", *([block] if block else [])]
    space = _Space(asked, 1, tally)
    if space.empty or radius <= 0:
        return points.select(*names, F.col("p").alias("first")).where("false")
    once = _numbered(asked)
    reach = space.cells(once).withColumn("reach", F.lit(float(radius)))
    least = space.within(reach, _first_inside(radius)).groupBy(F.col("q").alias("id")).agg(F.min("p").alias("first"))
    back = [F.from_json("b", f"b {points.schema[block].dataType.simpleString()}")["b"].alias(block)] if block else []
    kind = points.schema["p"].dataType
    return asked.join(once, ["b", "v"]).join(least, "id").select(F.col("p").cast(kind).alias("p"), *back, F.col("first").cast(kind).alias("first"))
