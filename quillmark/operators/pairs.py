"""Pair generation over samples (sample_id, bin_id, embedding, ...): strategies, dedup, caps, fills.

Every join has an equal key: bins, or the short list of bin pairs joined to bins. Random choice is order by
MD5 of seed and ids, the same on every run and engine. Usage caps are a fold in order: a stream for a few
pairs, rounds over all tasks for many.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.common import release, unused, width, written
from quillmark.operators import shares
from quillmark.operators.decisions import chunked, running_sums

#: First digits of the random key by which a ratio sample is counted; 16 to this power counts a group.
RATIO_DIGITS = 3
#: Pairs up to which the usage cap goes through them in one task, in order; more are decided in rounds.
SMALL_GROUP = 1_000_000
#: Blocks to which the first samples of pairs are dealt, at least; each block meets all second samples, so a bin's pairs are made in as many tasks.
PAIR_BLOCKS = 16
#: First samples of a bin that make a block, about.
FIRSTS = 512
#: Second samples of a slice: few, so that their order repeats within a page of a file, and a multiple of 8, so that it does byte by byte. And slices of a part, about.
SECONDS, SLICES = 504, 128
#: Samples of a bin that make a block where vectors are compared, about; and numbers of a product of matrices that are held at once.
BLOCK_ROWS, PRODUCT = 4096, 1 << 20


def draw(seed: int, *keys: Column) -> Column:
    """Text whose order is the random order of rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def _n_blocks(samples: DataFrame) -> int:
    """Blocks to which the first samples of a bin are dealt: one for about ``FIRSTS`` of the largest bin."""
    most = samples.groupBy("bin_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return max(PAIR_BLOCKS, -(-most // FIRSTS))


def _dealt(firsts: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """First samples by key and block. The count is given, as Spark would join partitions by their bytes, which say little of pairs."""
    blocks = firsts.withColumn("__block", F.pmod(F.xxhash64("a"), F.lit(n_blocks)).cast("int"))
    return blocks.repartition(width(firsts.sparkSession), key, "__block")


def _in_all(seconds: DataFrame, n_blocks: int = PAIR_BLOCKS) -> DataFrame:
    return seconds.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))


def _sides(samples: DataFrame, bin_pairs: DataFrame) -> DataFrame:
    """(bin_a, bin_b, a, b): samples of the first bin of each bin pair with samples of the second.

    Both sides are shuffled as packed blocks, of which every two meet. Rows come block by block, each first sample with the block of second
    ones in the same order as the one before, so that what is written of them takes little room.
    """
    w, n, keys = width(samples.sparkSession), _n_blocks(samples), ["bin_b", "__block", "__part", "__slice"]
    block = lambda blocks: F.pmod(F.xxhash64("sample_id"), blocks).cast("int")
    ids = F.flatten(F.collect_list(F.array("sample_id")))  # with nulls
    parts = samples.groupBy("bin_id").agg(F.ceil(F.count("*") / F.lit(SECONDS * SLICES)).alias("__parts"))
    packed = samples.join(parts, "bin_id").groupBy(F.col("bin_id").alias("bin_b"), block(F.col("__parts")).alias("__part")).agg(ids.alias("b"))
    # slices of one size repeat byte by byte
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size("b") - 1) / SECONDS).cast("int")), lambda k: F.slice("b", k * SECONDS + 1, SECONDS))
    seconds = written(packed.select("bin_b", "__part", F.posexplode(slices).alias("__slice", "b")), "pairs-seconds")
    firsts = samples.groupBy(F.col("bin_id").alias("bin_a"), block(F.lit(n)).alias("__block")).agg(ids.alias("a")).join(bin_pairs, "bin_a")
    firsts = firsts.join(seconds.select("bin_b", "__part", "__slice"), "bin_b").select("bin_a", *keys, "a").repartition(w, *keys).withColumn("a", F.explode("a"))
    met = firsts.join(_in_all(seconds, n).repartition(w, *keys).hint("merge"), keys)
    return met.select("bin_a", "bin_b", "a", F.explode("b").alias("b"))


def cross_bin(samples: DataFrame) -> DataFrame:
    """JN8: every sample of a bin with every sample of a later bin. The result has as many rows as there are such pairs."""
    bins = samples.select("bin_id").distinct()
    pairs = bins.select(F.col("bin_id").alias("bin_a")).join(bins.select(F.col("bin_id").alias("bin_b")), F.col("bin_a") < F.col("bin_b"))
    return _sides(samples, pairs).select("bin_a", "bin_b", "a", "b")


def neighbor_bin(samples: DataFrame) -> DataFrame:
    """JN9: bins whose numbers differ by one."""
    bins = samples.select("bin_id").distinct()
    return _sides(samples, bins.select(F.col("bin_id").alias("bin_a"), (F.col("bin_id") + 1).alias("bin_b"))).select("bin_a", "bin_b", "a", "b")


def adjacent_bin(samples: DataFrame) -> DataFrame:
    """JN10: bins next to each other in the list of bins, whatever the gap. The window is over bins, not samples."""
    bins = samples.select("bin_id").distinct().withColumn("next", F.lead("bin_id").over(Window.orderBy("bin_id")))
    pairs = bins.where("next is not null").select(F.col("bin_id").alias("bin_a"), F.col("next").alias("bin_b"))
    return _sides(samples, pairs).select("bin_a", "bin_b", "a", "b")


def extreme_bins(samples: DataFrame) -> DataFrame:
    """SP2: the least bin with the greatest."""
    pairs = samples.agg(F.min("bin_id").alias("bin_a"), F.max("bin_id").alias("bin_b")).where("bin_a < bin_b")
    return _sides(samples, pairs).select("bin_a", "bin_b", "a", "b")


def intra_bin(samples: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """JN11: unordered pairs of a bin."""
    b = samples.select("bin_id", F.col("sample_id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in more])
    a = samples.select("bin_id", F.col("sample_id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in more])
    n = _n_blocks(samples)
    return _dealt(a, "bin_id", n).join(_in_all(b, n), ["bin_id", "__block"]).where("a < b").drop("__block")


def choose_two(rows: DataFrame, group: str, order: str) -> DataFrame:
    """JN12: pairs within a group, in order."""
    return rows.select(group, F.col(order).alias("first")).join(rows.select(group, F.col(order).alias("second")), group).where("first < second")


def _ninths(d: float) -> int:
    """``d`` in billionths, halves up, as Spark rounds its decimal text."""
    return int(Decimal(repr(d)).scaleb(9).to_integral_value(ROUND_HALF_UP))


def _apart(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L2 between rows of x and y, summed in order as ``vectors.l2`` does, and in whole billionths."""
    s = np.zeros(len(x))
    for k in range(x.shape[1]):
        s += (x[:, k] - y[:, k]) * (x[:, k] - y[:, k])
    d = np.sqrt(s)
    scaled = d * 1e9
    whole = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4 + scaled * 1e-14):
        whole[i] = _ninths(float(d[i]))
    return d, whole


def _ends_of_blocks(x: np.ndarray, cx: np.ndarray, y: np.ndarray, cy: np.ndarray, within: bool, top: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(low, high, distance) of the ``top`` nearest and of the ``top`` farthest pairs of a row of x and one of y, of codes cx and cy.

    Products of matrices tell which pairs may be among them; those get their distance by ``_apart``. Inside one block the lower code comes first.
    """
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    slack = 1e-12 * (1 + x.shape[1]) * float((xx.max() if len(xx) else 0) + (yy.max() if len(yy) else 0))
    out = []
    for sign in (1, -1):
        low, high, dist, key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        step = max(1, PRODUCT // max(1, len(y)))
        for at in range(0, len(x), step):
            part = slice(at, at + step)
            d2 = xx[part, None] + yy[None, :] - 2.0 * (x[part] @ y.T)
            d2 *= sign
            if within:
                d2[cx[part, None] >= cy[None, :]] = np.inf
            flat = d2.ravel()
            # beyond this value a pair cannot come among the first ``top``: distances are compared in billionths
            limit = flat[np.argpartition(flat, top - 1)[:top]].max() if len(flat) > top else np.inf
            if len(key) == top:
                limit = min(limit, sign * dist[-1] ** 2)
            root = np.sqrt(abs(limit)) if np.isfinite(limit) else 0.0
            may = np.flatnonzero((flat <= limit + slack + 4e-9 * root + 4e-18) & np.isfinite(flat))
            i, j = at + may // len(y), may % len(y)
            for cut in range(0, len(i), PRODUCT // 64):
                p, q = i[cut : cut + PRODUCT // 64], j[cut : cut + PRODUCT // 64]
                d, w = _apart(x[p], y[q])
                low, high = np.r_[low, np.minimum(cx[p], cy[q])], np.r_[high, np.maximum(cx[p], cy[q])]
                dist, key = np.r_[dist, d], np.r_[key, sign * w]
                best = np.lexsort((high, low, key))[:top]
                low, high, dist, key = low[best], high[best], dist[best], key[best]
        out.append((low, high, dist))
    return out


def extremes_by_distance(samples: DataFrame, top: int, ranked: bool = False) -> DataFrame:
    """SR6: the ``top`` nearest and ``top`` farthest pairs of each bin, by L2; with few pairs the sets overlap.

    A bin's samples are dealt to blocks of about ``BLOCK_ROWS``; a task gets two blocks (or one), finds the ends among their pairs by products
    of matrices, exactly, and gives no others. These are ranked and cut, each side by itself. A vector that is empty or holds a null or a
    number that is not finite has no distance, nor have vectors of different lengths.
    """
    id_kind = samples.schema["sample_id"].dataType.simpleString()
    bin_kind = samples.schema["bin_id"].dataType.simpleString()
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = samples.where((F.size("embedding") > 0) & ~odd & F.col("bin_id").isNotNull() & F.col("sample_id").isNotNull())
    rows = rows.select("bin_id", "sample_id", F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dims"))
    n_blocks = rows.groupBy("bin_id", "dims").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    held = rows.join(n_blocks, ["bin_id", "dims"]).withColumn("block", F.pmod(F.xxhash64("sample_id"), F.col("blocks")).cast("int"))
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.struct(F.least(t, F.col("block")).alias("i"), F.greatest(t, F.col("block")).alias("j"))))
    dealt = held.withColumn("m", meets).select("bin_id", "dims", "m.i", "m.j", "block", "sample_id", "v").repartition(width(samples.sparkSession), "bin_id", "dims", "i", "j")

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, codes = np.unique(pdf["sample_id"].to_numpy(), return_inverse=True)
        v, block = np.stack(pdf["v"].to_list()).astype(float), pdf["block"].to_numpy()
        one, within = block == pdf["i"].iloc[0], bool(pdf["i"].iloc[0] == pdf["j"].iloc[0])
        other = one if within else ~one
        found = _ends_of_blocks(v[one], codes[one], v[other], codes[other], within, top)
        return pd.concat([pd.DataFrame({"bin_id": pdf["bin_id"].iloc[0], "a": ids[low], "b": ids[high], "distance": d, "near": k == 0}) for k, (low, high, d) in enumerate(found)], ignore_index=True)

    found = dealt.groupBy("bin_id", "dims", "i", "j").applyInPandas(ends, f"bin_id {bin_kind}, a {id_kind}, b {id_kind}, distance double, near boolean")
    apart = found.withColumn("distance", F.round("distance", 9))
    near = F.row_number().over(Window.partitionBy("bin_id").orderBy("distance", "a", "b"))
    far = F.row_number().over(Window.partitionBy("bin_id").orderBy(F.desc("distance"), "a", "b"))
    small = apart.where("near").withColumn("rank", near).where(F.col("rank") <= top).withColumn("tag", F.lit("intra_bin_small"))
    large = apart.where("not near").withColumn("rank", far).where(F.col("rank") <= top).withColumn("tag", F.lit("intra_bin_large"))
    return small.unionByName(large).select("bin_id", "a", "b", "distance", "tag", *(["rank"] if ranked else []))


def _shares(pairs: DataFrame, ratio: float, seed: int, group: tuple[str, ...]) -> DataFrame:
    """(__group..., __end, __rest), as a written table: the digits where a group's share ends, and the pairs of it that have them."""
    keyed = pairs.withColumn("__digits", F.substring(draw(seed, F.col("a"), F.col("b")), 1, RATIO_DIGITS))
    counts = keyed.groupBy(*group, "__digits").agg(F.count("*").alias("__n"))
    g = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__n").over(g.orderBy("__digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.ceil(F.sum("__n").over(g) * F.lit(ratio)) - before
    ends = counts.withColumn("__rest", left).where((F.col("__rest") > 0) & (F.col("__rest") <= F.col("__n")))
    return written(ends.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("__digits").alias("__end"), "__rest"), "ratio-ends")


def _share(pairs: DataFrame, ends: DataFrame, seed: int, group: tuple[str, ...]) -> DataFrame:
    """The pairs of the groups' shares. Only pairs that have the digits of an end are shuffled, for their rank."""
    digits, end, rest, rank = unused(pairs, "digits", "end", "rest", "rank")
    keyed = pairs.withColumn(digits, F.substring(draw(seed, F.col("a"), F.col("b")), 1, RATIO_DIGITS))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group]
    held = keyed.join(ends, same).select(*pairs.columns, digits, F.col("__end").alias(end), F.col("__rest").alias(rest))
    at = F.row_number().over(Window.partitionBy(*group, digits).orderBy(draw(seed, F.col("a"), F.col("b"))))
    edge = held.where(F.col(digits) == F.col(end)).withColumn(rank, at).where(F.col(rank) <= F.col(rest))
    return edge.select(*pairs.columns).unionByName(held.where(F.col(digits) < F.col(end)).select(*pairs.columns))


def ratio_sample(pairs: DataFrame, ratio: float, seed: int, group: tuple[str, ...] = ("bin_a", "bin_b")) -> DataFrame:
    """SR10: ceil(n * ratio) pairs of each group by random rank.

    Pairs are counted by the first digits of their random key. Lower digits than those where a group's share ends are
    taken whole, as they are made; those with the digits of the end, one in 4,096, by rank. A group is ranked by its digits, not
    in one task. The ends, a row a group, are written: where they are small, as Spark then knows, no other pair is shuffled.
    """
    return _share(pairs, _shares(pairs, ratio, seed, group), seed, group)


def sampled_or_near(samples: DataFrame, ratio: float, seed: int) -> DataFrame:
    """ST3: (a, b, tag) of a ratio sample of crossed bins and then of neighbouring bins, these the other way round; a pair once, by its first strategy.

    Bins that neighbour are crossed too, so a pair of theirs comes second where the share of its bins leaves it: nothing is looked up, and
    pairs are neither shuffled nor rows before they are asked for, see ``shares``. Only pairs of ids that stand in more rows than one go
    through ``first_strategy``.
    """
    share = shares.Share(samples, ratio, seed)

    def named(p: DataFrame) -> DataFrame:
        two = F.col("beyond")
        ids = [F.when(two, F.col(other)).otherwise(F.col(c)).alias(c) for c, other in ("ab", "ba")]
        return p.select(*ids, F.when(two, "neighbor_bin").otherwise("cross_bin").alias("tag"), F.when(two, 2).otherwise(1).alias("priority"))

    if not share.again():
        return named(share.pairs(near=True)).select("a", "b", "tag")
    alone, shared = (named(share.pairs(near=True, again=again)) for again in (False, True))
    return alone.unionByName(first_strategy(shared)).select("a", "b", "tag")


def crossed_sample(samples: DataFrame, ratio: float, seed: int) -> DataFrame:
    """SR10 over JN8: (bin_a, bin_b, a, b) as ``ratio_sample`` of ``cross_bin`` gives them, whose pairs are not rows before they are asked for."""
    return shares.Share(samples, ratio, seed).pairs().select("bin_a", "bin_b", "a", "b")


def tagged(pairs: DataFrame, tag: str, priority: int) -> DataFrame:
    """ST2: candidates of one strategy, for a union by priority."""
    return pairs.select("a", "b", F.lit(tag).alias("tag"), F.lit(priority).alias("priority"))


def first_strategy(candidates: DataFrame, by_tag: bool = False, order: tuple[str, ...] = ("priority", "a", "b")) -> DataFrame:
    """ST3, ST4: one row an unordered pair (and tag), of the first strategy; then the order of ids as given."""
    key = [F.least("a", "b"), F.greatest("a", "b")] + ([F.col("tag")] if by_tag else [])
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return candidates.withColumn("rank", rank).where("rank = 1").drop("rank")


def flipped(pairs: DataFrame) -> DataFrame:
    """SP5."""
    return pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.concat("tag", F.lit("(FLIPPED)")).alias("tag"))


def usage_capped(pairs: DataFrame, limit: int, group: str = "environment", small: int = SMALL_GROUP) -> DataFrame:
    """SP3: pairs (group, rank, a, b, ...) in order of rank, taken while both members were taken less than ``limit`` times.

    Up to ``small`` pairs pass one task a group in order, as a stream; what is held is how often each member was taken. More
    are decided in parallel rounds, with the same result: see ``_capped_in_rounds``. Ranks of a group are distinct.
    """
    if pairs.limit(small + 1).count() > small:
        return _capped_in_rounds(pairs, limit, group)

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used = object(), {}
        for pdf in it:
            keep = []
            for g, a, b in zip(pdf[group], pdf["a"], pdf["b"], strict=True):
                if g != current and not (pd.isna(g) and pd.isna(current)):
                    current, used = g, {}
                ok = used.get(a, 0) < limit and used.get(b, 0) < limit
                keep.append(ok)
                if ok:
                    used[a] = used.get(a, 0) + 1
                    used[b] = used.get(b, 0) + 1
            yield pdf[keep]

    dealt = pairs.repartition(width(pairs.sparkSession), group).sortWithinPartitions(group, "rank")
    return dealt.mapInPandas(fold, pairs.schema)


#: Pairs that the cap decides in one stretch of rounds, at first; each later stretch is twice as long, as most of it is refused at once.
STRETCH = 1_000_000


def _capped_in_rounds(pairs: DataFrame, limit: int, group: str, stretch: int = STRETCH) -> DataFrame:
    """The pairs that a fold in order of (group, rank) would take, decided by rounds over all tasks.

    Pairs are numbered and looked at by stretches of numbers. Those of a member that earlier stretches used up go at
    once. In a round each open pair learns, for both members, how many earlier pairs were taken (t) and how many are still
    open (u). It is refused if t reaches the limit for one of them, and taken if t + u stays below it for both, whatever becomes of
    the open ones; the first open pair is always decided. A pair of one member with itself counts twice.
    """
    ordered = chunked(pairs.withColumn("__key", F.struct(F.col(group), F.col("rank"))), "__key", stretch).withColumn("__n", F.col("chunk") * stretch + F.col("line")).drop("__key", "chunk", "line")
    ordered = written(ordered, "cap-numbered")
    total, start, size = ordered.count(), 0, stretch
    used: DataFrame | None = None
    taken: list[DataFrame] = []
    while start < total:
        part = ordered.where((F.col("__n") >= start) & (F.col("__n") < start + size)).select("__n", F.col(group).alias("g"), "a", "b")
        if used is not None:
            full = used.where(F.col("w") >= limit).select(F.col("g").alias("fg"), F.col("m").alias("fm"))
            for side in ("a", "b"):
                part = part.join(full, F.col("g").eqNullSafe(F.col("fg")) & (F.col(side) == F.col("fm")), "left_anti")
        chosen = _rounds(part.withColumn("taken", F.lit(False)), used, limit)
        taken.append(chosen.select("__n"))
        used = _used(chosen, used)
        start, size = start + size, 2 * size
    chosen = functools.reduce(DataFrame.union, taken) if taken else ordered.select("__n").where("false")
    return ordered.join(chosen, "__n").select(*pairs.columns)


def _used(chosen: DataFrame, used: DataFrame | None) -> DataFrame:
    """``used`` with what was chosen besides, written anew."""
    out = written(_uses(chosen, used), "cap-used")
    if used is not None:
        release(used)
    return out


def _incidences(pairs: DataFrame) -> DataFrame:
    """A row for each member of a pair, with the times the pair uses it."""
    one = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("m"), F.lit(2).alias("w"))))
    both = F.array(F.struct(F.col("a").alias("m"), F.lit(1).alias("w")), F.struct(F.col("b").alias("m"), F.lit(1).alias("w")))
    return pairs.withColumn("i", F.explode(F.coalesce(one, both))).select("*", "i.m", "i.w").drop("i")


def _uses(chosen: DataFrame, used: DataFrame | None) -> DataFrame:
    """(g, m, w): how often each member was taken so far."""
    now = _incidences(chosen).select("g", "m", "w")
    return (now if used is None else now.union(used.select("g", "m", "w"))).groupBy("g", "m").agg(F.sum("w").alias("w"))


def _folded(part: DataFrame, used: DataFrame | None, limit: int) -> DataFrame:
    """``_rounds`` of a few pairs, in one task in order; how often earlier stretches took their members comes first."""

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: dict[int, int] = {}
        for pdf in it:
            keep = []
            for n, a, b, w in zip(pdf["__n"], pdf["a"], pdf["b"], pdf["w"], strict=True):
                if n < 0:
                    count[a] = w
                ok = n >= 0 and count.get(a, 0) < limit and count.get(b, 0) < limit
                keep.append(ok)
                if ok:
                    count[a] = count.get(a, 0) + 1
                    count[b] = count.get(b, 0) + 1
            yield pdf.loc[keep, names].assign(taken=True)

    names, rows = list(part.columns), part.withColumn("w", F.lit(0).cast("long"))
    if used is not None:
        here = _incidences(part).select("m").distinct()
        past = used.join(here.hint("merge"), "m", "left_semi")
        rows = rows.unionByName(past.select(F.lit(-1).cast("long").alias("__n"), "g", F.col("m").alias("a"), F.col("m").alias("b"), F.lit(True).alias("taken"), F.col("w").cast("long").alias("w")), allowMissingColumns=True)
    return rows.coalesce(1).sortWithinPartitions("__n").mapInPandas(fold, part.schema)


def _rounds(part: DataFrame, used: DataFrame | None, limit: int) -> DataFrame:
    """The pairs of a stretch (__n, g, a, b, taken) that are taken, after rounds until none is open."""
    before = Window.partitionBy("g", "m").orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)
    spent = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    state = None
    while True:
        rows = _incidences(part if state is None else state)
        if used is not None:  # what earlier stretches took comes before every pair of this one, for the members at hand
            here = rows.select("g", "m").distinct()
            past = used.alias("u").join(here.alias("h"), F.col("u.g").eqNullSafe(F.col("h.g")) & (F.col("u.m") == F.col("h.m")), "left_semi")
            rows = rows.unionByName(past.select(F.lit(-1).cast("long").alias("__n"), "g", F.col("m").alias("a"), F.col("m").alias("b"), F.lit(True).alias("taken"), "m", "w"))
        counted = rows.withColumns({"t": spent(F.when(F.col("taken"), F.col("w"))), "u": spent(F.when(~F.col("taken"), F.col("w")))}).where("__n >= 0")
        by_pair = counted.groupBy("__n").agg(*[F.first(c).alias(c) for c in ("g", "a", "b", "taken")], F.max("t").alias("t"), F.max(F.col("t") + F.col("u")).alias("most"))
        sure = by_pair.where(F.col("taken") | (F.col("t") < limit)).withColumn("taken", F.col("taken") | (F.col("most") < limit))
        last, state = state, written(sure.select("__n", "g", "a", "b", "taken"), "cap-round")
        if last is not None:
            release(last)
        if state.where("not taken").isEmpty():
            return state


def duplicate_fill(pairs: DataFrame, wanted: int) -> DataFrame:
    """SP4: copies of ranked pairs (rank from 0, a, b, tag) until there are ``wanted`` rows; the i-th copy is marked (DUPE_i).

    The list that is cycled over grows, so later copies are copies of copies and carry every mark.
    """
    n = pairs.count()
    if n == 0 or n >= wanted:
        return pairs
    rounds = -(-wanted // n)
    # the k-th mark of a row that goes back to rank r is that of copy r + (k - 1) n + 1
    marks = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("round"), F.lit(1))), lambda k: F.concat(F.lit("(DUPE_"), (F.col("rank") + (k - 1) * n + 1).cast("string"), F.lit(")"))), "")
    grown = pairs.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    grown = grown.withColumn("tag", F.when(F.col("round") == 0, F.col("tag")).otherwise(F.concat("tag", marks))).withColumn("rank", F.col("round") * n + F.col("rank"))
    return grown.where(F.col("rank") < wanted).drop("round")


# Generation. The pairs of two bins are a product, and a random sample of it in random order needs no list of it: a
# keyed permutation of the product's places gives the pair at each rank, and the rank of each pair. Candidates are
# made rank by rank, as far as the cap needs them.

#: Double rounds of the permutation.
TURNS = 3
#: Ranks that one row of a stretch is spread to.
SPREAD = 20_000
#: Blocks that the driver looks at to end a stretch.
AHEAD = 64


def _turned(x: np.ndarray, y: np.ndarray, n: np.ndarray, seed: np.ndarray, step: int, sign: int) -> np.ndarray:
    """x moved by a hash of y, within n."""
    h = (y.astype(np.uint64) + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) ^ seed.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h = (h ^ (h >> np.uint64(31))) % n.astype(np.uint64)
    return (x + sign * h.astype(np.int64)) % n


def _longs(*columns: pd.Series) -> list[np.ndarray]:
    return [c.to_numpy(np.int64) for c in columns]


@F.pandas_udf(T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]))
def _place_of(rank: pd.Series, n_x: pd.Series, n_y: pd.Series, seed: pd.Series) -> pd.DataFrame:
    r, a, b, s = _longs(rank, n_x, n_y, seed)
    x, y = r // b, r % b
    for step in range(TURNS):
        x = _turned(x, y, a, s, 2 * step, 1)
        y = _turned(y, x, b, s, 2 * step + 1, 1)
    return pd.DataFrame({"x": x, "y": y})


@F.pandas_udf(T.LongType())
def _rank_of(x: pd.Series, y: pd.Series, n_x: pd.Series, n_y: pd.Series, seed: pd.Series) -> pd.Series:
    x, y, a, b, s = _longs(x, y, n_x, n_y, seed)
    for step in reversed(range(TURNS)):
        y = _turned(y, x, b, s, 2 * step + 1, -1)
        x = _turned(x, y, a, s, 2 * step, -1)
    return pd.Series(x * b + y)


def at_rank(rows: DataFrame) -> DataFrame:
    """``rows`` with the place (x, y) of a product of n_x by n_y that stands at ``rank`` of its random order by ``seed``: a permutation of all places."""
    return rows.withColumn("__p", _place_of("rank", "n_x", "n_y", "seed")).withColumns({"x": F.col("__p.x"), "y": F.col("__p.y")}).drop("__p")


def rank_at(rows: DataFrame, x: str = "x", y: str = "y", rank: str = "rank") -> DataFrame:
    """``rows`` with the rank of a place: ``at_rank`` the other way."""
    return rows.withColumn(rank, _rank_of(x, y, "n_x", "n_y", "seed"))


def _inside(n: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The pair of different ones of n members at a place of the product that ``_inside_sides`` gives: each unordered pair once."""
    even = n % 2 == 0
    m = F.when(even, n - 1).otherwise(n)
    step = F.when(even, x).otherwise(x + 1)
    first, second = F.pmod(y + step, m), F.pmod(y - step, m)
    last = even & (x == 0)
    return F.when(last, n - 1).otherwise(first), F.when(last, y).otherwise(second)


def _inside_place(n: Column, i: Column, j: Column) -> tuple[Column, Column]:
    """The place of a pair (i, j): ``_inside`` the other way."""
    even = n % 2 == 0
    m = F.when(even, n - 1).otherwise(n)
    low, high = F.least(i, j), F.greatest(i, j)
    apart = F.pmod(high - low, m)  # twice the step, or its complement
    step = F.when(apart % 2 == 0, (apart / 2).cast("long")).otherwise(((m - apart) / 2).cast("long"))
    centre = F.when(apart % 2 == 0, F.pmod(low + step, m)).otherwise(F.pmod(high + step, m))
    last = even & (high == n - 1)
    return F.when(last, F.lit(0)).otherwise(F.when(even, step).otherwise(step - 1)), F.when(last, low).otherwise(centre)


def _members(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bin, place, sample_id) with the place of each sample in its bin, by ranges; and (bin, n, first) a bin. As written tables."""
    keyed = samples.select(F.col("bin_id").alias("bin"), "sample_id").withColumn("__key", F.struct("bin", "sample_id"))
    numbered = chunked(keyed, "__key", 1 << 40).select("bin", "sample_id", F.col("line").alias("number"))
    numbered = written(numbered, "pairs-numbered")
    bins = written(numbered.groupBy("bin").agg(F.count("*").alias("n"), F.min("number").alias("start"), F.min("sample_id").alias("first")), "pairs-bins")
    placed = written(numbered.join(bins.select("bin", "start"), "bin").select("bin", (F.col("number") - F.col("start")).alias("place"), "sample_id"), "pairs-members")
    release(numbered)
    return placed, bins


_BLOCK = ("strategy", "x1", "x2", "bin_x", "bin_y", "n_x", "n_y", "n_in", "seed", "tag")


def _crossed(bins: DataFrame, pairs: DataFrame, strategy: int, seed: int, ratio: float, tag: Column) -> DataFrame:
    """Blocks of the products of pairs of bins (bin_x, bin_y), in order of the bins. ``n_in`` is null: places are those of two bins."""
    side = lambda c: bins.select(F.col("bin").alias(f"bin_{c}"), F.col("n").alias(f"n_{c}"))
    rows = pairs.join(side("x"), "bin_x").join(side("y"), "bin_y").withColumns({"strategy": F.lit(strategy), "x1": F.col("bin_x").cast("long"), "x2": F.col("bin_y").cast("long"), "n_in": F.lit(None).cast("long"), "seed": F.xxhash64(F.lit(seed), "bin_x", "bin_y"), "tag": tag})
    return rows.select(*_BLOCK).withColumn("keep", F.ceil(F.col("n_x") * F.col("n_y") * F.lit(ratio)).cast("long"))


def _within(bins: DataFrame, strategy: int, seed: int, ratio: float) -> DataFrame:
    """Blocks of the pairs inside each bin, in order of the bins' first samples: a product of places that stands for the pairs."""
    even = F.col("n") % 2 == 0
    sides = {"n_x": F.when(even, F.col("n") / 2).otherwise((F.col("n") - 1) / 2).cast("long"), "n_y": F.when(even, F.col("n") - 1).otherwise(F.col("n"))}
    rows = bins.where("n > 1").withColumns({"strategy": F.lit(strategy), "x1": F.col("first").cast("long"), "x2": F.lit(0).cast("long"), "bin_x": F.col("bin"), "bin_y": F.col("bin"), **sides, "n_in": F.col("n"), "seed": F.xxhash64(F.lit(seed), "bin"), "tag": _named("intra_bin_random_", F.col("bin"))})
    return rows.select(*_BLOCK).withColumn("keep", F.ceil(F.col("n_x") * F.col("n_y") * F.lit(ratio)).cast("long"))


def _named(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _drawn(blocks: DataFrame, start: int, end: int, members: DataFrame, width_: int) -> DataFrame:
    """(__n, tag, bin_x, bin_y, x, y, a, b): the candidates of ``blocks`` (with ``before``, the ranks ahead of each) numbered start to end, of members at hand."""
    low, high = F.greatest(F.lit(start) - F.col("before"), F.lit(0)), F.least(F.lit(end) - F.col("before"), F.col("keep"))
    part = blocks.withColumns({"low": low, "high": high}).where("low < high")
    pieces = part.withColumn("from", F.explode(F.sequence(F.col("low"), F.col("high") - 1, F.lit(SPREAD).cast("long")))).repartition(width_)
    ranks = pieces.withColumn("rank", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + SPREAD, F.col("high")) - 1)))
    placed = at_rank(ranks)
    inside = _inside(F.col("n_in"), F.col("x"), F.col("y"))
    placed = placed.withColumns({"i": F.when(F.col("n_in").isNull(), F.col("x")).otherwise(inside[0]), "j": F.when(F.col("n_in").isNull(), F.col("y")).otherwise(inside[1])})
    side = lambda n, c: members.select(F.col("bin").alias(f"bin_{n}"), F.col("place").alias(c), F.col("sample_id").alias(f"__{c}")).hint("merge")
    found = placed.join(side("x", "i"), ["bin_x", "i"]).join(side("y", "j"), ["bin_y", "j"])
    return _ordered_pair(found.withColumn("__n", F.col("before") + F.col("rank")))


def _remaining(blocks: DataFrame, start: int, end: int, members: DataFrame, width_: int) -> DataFrame:
    """As ``_drawn``, from the products of the members at hand and the ranks of their pairs."""
    side = lambda n, c: members.select(F.col("bin").alias(f"bin_{n}"), F.col("place").alias(c), F.col("sample_id").alias(f"__{c}"))
    met = _dealt_members(blocks.join(side("x", "i"), "bin_x"), width_).join(_in_all(side("y", "j")), ["bin_y", "__block"]).drop("__block").where("n_in is null or i < j")
    place = _inside_place(F.col("n_in"), F.col("i"), F.col("j"))
    ranked = rank_at(met.withColumns({"x": F.when(F.col("n_in").isNull(), F.col("i")).otherwise(place[0]), "y": F.when(F.col("n_in").isNull(), F.col("j")).otherwise(place[1])}))
    return _ordered_pair(ranked.where(F.col("rank") < F.col("keep")).withColumn("__n", F.col("before") + F.col("rank"))).where((F.col("__n") >= start) & (F.col("__n") < end))


def _dealt_members(rows: DataFrame, width_: int) -> DataFrame:
    blocks = rows.withColumn("__block", F.pmod(F.xxhash64("__i"), F.lit(PAIR_BLOCKS)).cast("int"))
    return blocks.repartition(width_, "bin_y", "__block")


def _ordered_pair(found: DataFrame) -> DataFrame:
    """Pairs inside a bin have the earlier sample first."""
    alone = F.col("n_in").isNull()
    a, b = F.when(alone, F.col("__i")).otherwise(F.least("__i", "__j")), F.when(alone, F.col("__j")).otherwise(F.greatest("__i", "__j"))
    return found.select("__n", "strategy", "tag", "bin_x", "bin_y", "i", "j", a.alias("a"), b.alias("b"))


def _stretch_end(ahead: list[Row], start: int, limit: int, stretch: int) -> int:
    """The number where a stretch from ``start`` ends, by the next blocks in order: after about ``stretch`` candidates of open members, in all
    blocks, twice as many as a block's members may be taken, in one, and before the block of a bin that is likely used up by then."""
    end, room, spent = start, max(0.9 * stretch, 1.0), {}
    for row in ahead:
        low, high = max(start, row["before"]), row["before"] + row["keep"]
        used_up = any(spent.get(row[f"bin_{c}"], 0) >= limit * row[f"open_{c}"] for c in "xy")
        if low > start and (used_up or room <= 0):
            break
        density = min(row["fewer"] / (row["n_x"] * row["n_y"]), 1.0)
        most = min(room, 2.0 * max(limit, 1) * (row["open_x"] + row["open_y"]))
        if (high - low) * density > most:
            return low + max(1, int(most / density))
        end, room = high, room - (high - low) * density
        for c in {row["bin_x"], row["bin_y"]}:
            spent[c] = spent.get(c, 0) + (high - low) * density
    return end


class _Taking:
    """The usage cap over candidates in turn: what was taken, and how often each member."""

    def __init__(self, members: DataFrame, limit: int, stretch: int, small: int):
        self.members, self.limit, self.stretch, self.small = members, limit, stretch, small
        self.seen: Callable[[DataFrame], DataFrame] = lambda found: found
        self.used: DataFrame | None = None
        self.taken: list[DataFrame] = []

    def open_members(self) -> DataFrame:
        """Members that the cap leaves."""
        if self.used is None:
            return self.members
        full = self.used.where(F.col("w") >= self.limit).select(F.col("m").alias("sample_id"))
        return self.members.join(full.hint("merge"), "sample_id", "left_anti").select("bin", "place", "sample_id")

    def take(self, candidates: DataFrame) -> None:
        """Candidates (__n, strategy, tag, a, b) of open members, all later than those before."""
        held = written(candidates.select("__n", "strategy", "tag", "a", "b"), "cap-candidates")
        part = held.withColumns({"g": F.lit(0), "taken": F.lit(False)})
        if held.limit(self.small + 1).count() > self.small:
            chosen = _rounds(part.select("__n", "g", "a", "b", "taken"), self.used, self.limit)
            taken = written(part.join(chosen.select("__n"), "__n").select(*part.columns), "cap-taken")
            release(chosen)
        else:
            taken = written(_folded(part, self.used, self.limit), "cap-taken")
        self.used = _used(taken, self.used)
        self.taken.append(taken.select(*held.columns))
        release(held)

    def blocks(self, blocks: DataFrame) -> None:
        """All candidates of a strategy's blocks, as far as there are members that the cap leaves.

        A stretch is as many ranks as are expected to give ``stretch`` candidates of open members, and ends where a bin is likely to be used
        up, see ``_stretch_end``. A block is drawn rank by rank; where its open members make fewer pairs than the stretch has ranks of it, those
        pairs are made instead.
        """
        spark = self.members.sparkSession
        ordered = running_sums(blocks.withColumn("__order", F.struct("x1", "x2")), "__order", ["keep"])
        ordered = written(ordered.withColumn("before", F.col("keep_sum") - F.col("keep")).drop("__order", "keep_sum", "number"), "cap-blocks")
        start, size = 0, self.stretch
        while True:
            members = written(self.open_members(), "cap-open")
            left = members.groupBy("bin").agg(F.count("*").alias("open"))
            side = lambda n, left=left: left.select(F.col("bin").alias(f"bin_{n}"), F.col("open").alias(f"open_{n}"))
            alive = ordered.where(F.col("before") + F.col("keep") > start).join(side("x"), "bin_x").join(side("y"), "bin_y")
            alive = written(alive.withColumn("fewer", F.col("open_x").cast("double") * F.col("open_y") / F.when(F.col("n_in").isNull(), 1).otherwise(2)), "cap-alive")
            ahead = alive.orderBy("before").limit(AHEAD).collect()
            if not ahead:
                release(members, alive)
                break
            start = max(start, ahead[0]["before"])
            end = _stretch_end(ahead, start, self.limit, size)
            ranks = F.least(F.lit(end), F.col("before") + F.col("keep")) - F.greatest(F.lit(start), F.col("before"))
            mine, short = alive.where(F.col("before") < end), F.col("fewer") <= ranks
            met = [(r["fewer"], min(end, r["before"] + r["keep"]) - max(start, r["before"])) for r in ahead if r["before"] < end]
            drawn, made = sum(n for fewer, n in met if fewer > n), sum(fewer for fewer, n in met if fewer <= n)
            found = []
            if drawn:
                found.append(_drawn(mine.where(~short), start, end, members, min(width(spark), -(-drawn // SPREAD))))
            if made or not drawn:
                found.append(_remaining(mine.where(short), start, end, members, min(width(spark), int(made // SPREAD) + 1)))
            self.take(self.seen(functools.reduce(DataFrame.unionByName, found)))
            release(members, alive)
            # what passes one task doesn't grow; stretches that come to rounds anyway do
            start, size = end, 2 * size if self.small < self.stretch else min(2 * size, self.small)

    def result(self) -> DataFrame:
        """(rank, a, b, tag) in order of strategies and their candidates."""
        rows = functools.reduce(DataFrame.union, self.taken).withColumn("__order", F.struct("strategy", "__n"))
        return written(chunked(rows, "__order", 1 << 40).select(F.col("line").alias("rank"), "a", "b", "tag"), "pairs-capped")


def _finished(capped: DataFrame, max_pairs: int | None, seed: int, fill: bool) -> DataFrame:
    """(rank, a, b, tag): in order, or in random order where there are more than max_pairs, which are cut; filled by copies if asked."""
    if max_pairs is None:
        return capped
    n = capped.count()
    if n > max_pairs:
        shuffled = capped.withColumn("key", F.struct(draw(seed, F.col("a"), F.col("b"), F.col("tag")).alias("d"), F.col("rank")))
        chosen = chunked(shuffled, "key", max(max_pairs, 1))
        return chosen.where("chunk = 0" if max_pairs else "false").select(F.col("line").alias("rank"), "a", "b", "tag")
    return duplicate_fill(capped, max_pairs) if fill else capped


def _ends(samples: DataFrame, bins: DataFrame, top: int, strategy: int, by_first: bool) -> DataFrame:
    """(__n, strategy, tag, a, b): nearest pairs of each bin in order, then farthest ones with the farthest last; bins by first sample or by number."""
    ends = extremes_by_distance(samples, top, ranked=True).join(bins.select(F.col("bin").alias("bin_id"), "first"), "bin_id")
    small = F.col("tag") == "intra_bin_small"
    place = F.when(small, F.col("rank")).otherwise(F.lit(2 * top + 1) - F.col("rank"))
    ordered = ends.withColumn("__order", F.struct(F.col("first" if by_first else "bin_id").cast("long"), place.alias("place")))
    tag = _named("intra_bin_", F.col("bin_id"), F.when(small, "_small").otherwise("_large"))
    return chunked(ordered, "__order", 1 << 40).select(F.col("line").alias("__n"), F.lit(strategy).alias("strategy"), tag.alias("tag"), "a", "b")


def _bin_pairs(bins: DataFrame) -> DataFrame:
    x, y = (bins.select(F.col("bin").alias(f"bin_{c}")) for c in "xy")
    return x.join(y, F.col("bin_x") < F.col("bin_y"))


def generate(
    samples: DataFrame, max_pairs: int | None = None, seed: int = 42, usage_limit: int = 50, top: int = 5, ratios: tuple[float, float, float] = (0.4, 0.3, 0.2),
    allow_duplicates: bool = False, preserve_strategy: bool = False, strict: bool = True, stretch: int = STRETCH, small: int = SMALL_GROUP,
) -> DataFrame:
    """SP1: (rank, a, b, tag) of four strategies in turn: bins crossed, neighbouring bins, nearest and farthest of a bin, random of a bin.

    A pair comes once, by its first strategy; with ``preserve_strategy`` and not ``strict`` once a tag; with ``allow_duplicates`` as often
    as it is found. The usage cap goes through the candidates in the order of strategies, bins and random draw. More than
    ``max_pairs`` are shuffled and cut; fewer are filled with marked copies where duplicates are allowed. None: all of them.
    Samples of a bin are in order of their id. Products of bins are never made as far as the cap doesn't reach into them.
    """
    members, bins = _members(samples)
    if members.isEmpty():
        return members.select(F.col("place").alias("rank"), F.col("sample_id").alias("a"), F.col("sample_id").alias("b"), F.lit("").alias("tag"))
    by_tag = allow_duplicates or (preserve_strategy and not strict)
    cross = _crossed(bins, _bin_pairs(bins), 1, seed, ratios[0], _named("cross_bin_", F.col("bin_x"), "_", F.col("bin_y")))
    near = _crossed(bins, _bin_pairs(bins).where("bin_y - bin_x = 1"), 2, seed + 1, ratios[1], _named("neighbor_bin_", F.col("bin_x"), "_", F.col("bin_y")))
    ends = written(_ends(samples, bins, top, 3, True), "pairs-ends")

    def crossed_before(found: DataFrame) -> DataFrame:
        """Pairs of neighbouring bins that the first strategy has not drawn."""
        asked = found.join(cross.select("bin_x", "bin_y", "n_x", "n_y", "seed", F.col("keep").alias("drawn")), ["bin_x", "bin_y"])
        return rank_at(asked, "i", "j", "was").where(F.col("was") >= F.col("drawn"))

    def near_before(found: DataFrame) -> DataFrame:
        return found.join(ends.select("a", "b").hint("merge"), ["a", "b"], "left_anti")

    taking = _Taking(members, usage_limit, stretch, small)
    taking.blocks(cross)
    taking.seen = taking.seen if by_tag else crossed_before
    taking.blocks(near)
    taking.seen = lambda found: found
    taking.take(ends if by_tag else first_strategy(ends, False, ("__n",)))
    taking.seen = taking.seen if by_tag else near_before
    taking.blocks(_within(bins, 4, seed + 2, ratios[2]))
    return _finished(taking.result(), max_pairs, seed, allow_duplicates)


def generate_padded(samples: DataFrame, max_pairs: int | None = None, seed: int = 42, usage_limit: int = 50, top: int = 5, ratios: tuple[float, float] = (0.4, 0.3), stretch: int = STRETCH, small: int = SMALL_GROUP) -> DataFrame:
    """SP2: (rank, a, b, tag) of the least with the greatest bin, bins next to each other in the list, and nearest and farthest of a bin.

    A pair comes once, by its first strategy, and the usage cap goes through them in order. More than ``max_pairs`` are
    shuffled and cut, fewer are filled with marked copies.
    """
    members, bins = _members(samples)
    if members.isEmpty():
        return members.select(F.col("place").alias("rank"), F.col("sample_id").alias("a"), F.col("sample_id").alias("b"), F.lit("").alias("tag"))
    widest = bins.agg(F.min("bin").alias("bin_x"), F.max("bin").alias("bin_y")).where("bin_x < bin_y")
    following = bins.select(F.col("bin").alias("bin_x"), F.lead("bin").over(Window.orderBy("bin")).alias("bin_y")).where("bin_y is not null")
    cross = _crossed(bins, widest, 1, seed, ratios[0], F.lit("cross_bin_minmax"))
    near = _crossed(bins, following, 2, seed + 1, ratios[1], _named("neighbor_bin_", F.col("bin_x"), "_", F.col("bin_y")))

    def crossed_before(found: DataFrame) -> DataFrame:
        """With two bins only, pairs of the list may be drawn already."""
        drawn = cross.select("bin_x", "bin_y", "n_x", "n_y", "seed", F.col("keep").alias("drawn"))
        other = found.join(drawn, ["bin_x", "bin_y"], "left_anti")
        asked = rank_at(found.join(drawn, ["bin_x", "bin_y"]), "i", "j", "was").where(F.col("was") >= F.col("drawn"))
        return asked.select(*other.columns).unionByName(other)

    taking = _Taking(members, usage_limit, stretch, small)
    taking.blocks(cross)
    taking.seen = crossed_before
    taking.blocks(near)
    taking.take(first_strategy(written(_ends(samples, bins, top, 3, False), "pairs-ends"), False, ("__n",)))
    return _finished(taking.result(), max_pairs, seed, True)
