"""The usage cap over all pairs of neighbouring bins in random order, without a list of them.

The random order is that of the MD5 of seed and ids, as ``pairs.draw`` has it. Packed blocks of the two bins meet in tasks, which make
the digests of their pairs as matrices and give only those in the range of digests at hand: first so low a range that a few pairs for each member
are in it, then the next ranges, of members that the cap leaves. What is taken late is rare; its rank among all pairs is counted where the
blocks meet, so no other pair is ever a row.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.common import release, width, written
from quillmark.functions import digests

#: Pairs for each member of two bins that a range of digests is to have, about.
A_MEMBER = 16
#: Members of a packed block.
BLOCK_ROWS = 2048
#: Ends of the ranges of digests: their first 62 bits.
_ALL = 1 << 62
#: Buckets by which digests are counted.
_BUCKET_BITS = 16
#: Counts that a task holds before it gives them out.
_HELD = 1 << 20


def _members(samples: DataFrame) -> DataFrame:
    """(environment, side, id, used): each sample as a first one of its bin's pairs and as a second one of the bin's before. Without incomplete rows."""
    rows = samples.select("bin_id", F.col("sample_id").cast("string").alias("id")).dropna()
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("bin_id").alias("environment")), F.struct(F.lit(1).alias("side"), (F.col("bin_id") - 1).cast(samples.schema["bin_id"].dataType).alias("environment"))))
    return rows.withColumn("s", sides).select("s.environment", "s.side", "id", F.lit(0).alias("used"))


def _both(members: DataFrame) -> DataFrame:
    """(environment, m0, m1): how many first and second members there are, where there are both."""
    return members.groupBy("environment").agg(*[F.count_if(F.col("side") == s).alias(f"m{s}") for s in (0, 1)]).where("m0 > 0 and m1 > 0")


def _met(members: DataFrame, environments: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    """(environment, *extra, a, ua, b, ub): every block of first members with every block of second ones, as lists of ids and of uses.

    What an environment has besides (``extra``, which may be long) comes to the blocks that have met, not to members and not through a sort.
    """
    n = [F.ceil(F.col(f"m{s}") / F.lit(BLOCK_ROWS)).cast("int").alias(f"n{s}") for s in (0, 1)]
    sized = _both(members).join(environments.select("environment"), "environment").select("environment", *n)
    blocks = members.join(sized, "environment").withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))).cast("int"))
    packed = blocks.groupBy("environment", "side", "block", "n0", "n1").agg(F.collect_list("id").alias("ids"), F.collect_list("used").alias("uses"))

    def side(s: int, mine: str, other: str) -> DataFrame:
        dealt = packed.where(F.col("side") == s).withColumn("o", F.explode(F.sequence(F.lit(0), F.col(f"n{1 - s}") - 1)))
        return dealt.select("environment", F.col("block").alias(mine), F.col("o").alias(other), F.col("ids").alias("ab"[s]), F.col("uses").alias("u" + "ab"[s]))

    w = width(members.sparkSession)
    keys = ["environment", "i", "j"]
    first, second = side(0, "i", "j").repartition(w, *keys), side(1, "j", "i").repartition(w, *keys)
    return first.join(second.hint("merge"), keys).join(environments.select("environment", *extra), "environment")


def _texts(seed: int, a: list[str], b: list[str]) -> tuple[list[bytes], list[bytes]]:
    return [f"{seed}|{x}|".encode() for x in a], [y.encode() for y in b]


def _in_range(met: DataFrame, seed: int, kind: str) -> DataFrame:
    """(environment, digest, a, b, ua, ub): the pairs whose digest is from ``low`` to below ``high``."""

    def pick(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples(index=False):
                a, b, ua, ub = (np.asarray(v) for v in (row.a, row.b, row.ua, row.ub))
                first, last = np.uint32(row.low >> 30), np.uint32((row.high - 1) >> 30)
                firsts, seconds = _texts(seed, row.a, row.b)
                near = [(np.zeros(0, np.int64),) * 2]
                for i, j, words in digests.md5_of_products(firsts, seconds, whole=False):
                    p, q = np.nonzero((words[0] >= first) & (words[0] <= last))
                    near.append((i[p], j[q]))
                p, q = (np.concatenate(n) for n in zip(*near, strict=True))
                for at in range(0, len(p), _HELD // 16):
                    pa, qa = p[at : at + _HELD // 16], q[at : at + _HELD // 16]
                    made = [hashlib.md5(firsts[x] + seconds[y]).digest() for x, y in zip(pa.tolist(), qa.tolist(), strict=True)]
                    found = np.frombuffer(b"".join(made), ">u4").reshape(-1, 4)
                    place = (found[:, 0].astype(np.int64) << 30) | (found[:, 1] >> 2)
                    within = (place >= row.low) & (place < row.high)
                    pa, qa = pa[within], qa[within]
                    yield pd.DataFrame({"environment": row.environment, "digest": [made[k] for k in np.flatnonzero(within)], "a": a[pa], "b": b[qa], "ua": ua[pa], "ub": ub[qa]})

    return met.mapInPandas(pick, f"environment {kind}, digest binary, a string, b string, ua int, ub int")


def _folded(candidates: DataFrame, limit: int, kind: str) -> DataFrame:
    """(environment, digest, at, a, b) of the pairs that a fold in order of digests takes; ``at`` numbers all candidates of an environment from 1."""

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used, at = None, {}, 0
        for pdf in it:
            keep, places = [], []
            for g, a, b, ua, ub in zip(pdf["environment"], pdf["a"], pdf["b"], pdf["ua"], pdf["ub"], strict=True):
                if g != current:
                    current, used, at = g, {}, 0
                at += 1
                ok = used.setdefault(a, ua) < limit and used.setdefault(b, ub) < limit
                keep.append(ok)
                if ok:
                    used[a] += 1
                    used[b] += 1
                    places.append(at)
            yield pdf.loc[keep, ["environment", "digest", "a", "b"]].assign(at=places)[["environment", "digest", "at", "a", "b"]]

    dealt = candidates.repartition(width(candidates.sparkSession), "environment").sortWithinPartitions("environment", "digest")
    return dealt.mapInPandas(fold, f"environment {kind}, digest binary, at long, a string, b string")


def _counted(met: DataFrame, seed: int, kind: str) -> DataFrame:
    """(environment, k, n): how many pairs have a digest below ``marks[k]``, in order of digests."""

    def below(row, marks: list[bytes]) -> np.ndarray:
        """Digests below each mark, tile by tile: by the bucket where no mark is in it, else by the marks' first words, else by whole digests."""
        tops = np.frombuffer(b"".join(marks), ">u4")[::4].astype(np.uint32)
        shift = np.uint32(32 - _BUCKET_BITS)
        # marks below each bucket, and whether it holds some
        ahead = np.searchsorted(tops >> shift, np.arange(1 << _BUCKET_BITS))
        holds = np.zeros(1 << _BUCKET_BITS, bool)
        holds[tops >> shift] = True
        after = np.zeros(len(marks) + 1, np.int64)  # digests that come after so many marks, and not after more
        firsts, seconds = _texts(seed, row.a, row.b)
        for i, j, words in digests.md5_of_products(firsts, seconds, whole=False):
            first = words[0].ravel()
            bucket = first >> shift
            places = ahead[bucket]
            close = np.flatnonzero(holds[bucket])
            low, high = np.searchsorted(tops, first[close]), np.searchsorted(tops, first[close], side="right")
            places[close] = low
            for at in np.flatnonzero(low < high):  # the first words are equal
                p, q = divmod(int(close[at]), len(j))
                made = hashlib.md5(firsts[i[p]] + seconds[j[q]]).digest()
                places[close[at]] = bisect.bisect_left(marks, made, int(low[at]), int(high[at])) if made not in marks[low[at] : high[at]] else marks.index(made, int(low[at]), int(high[at])) + 1
            after += np.bincount(places, minlength=len(after))
        return np.cumsum(after)[:-1]

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in it:
            for row in pdf.itertuples(index=False):
                held[row.environment] = held.get(row.environment, 0) + below(row, list(row.marks))
                if sum(map(len, held.values())) > _HELD:
                    yield given(held)
                    held = {}
        if held:
            yield given(held)

    def given(held: dict) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"environment": g, "k": np.arange(len(n), dtype=np.int32), "n": n}) for g, n in held.items()], ignore_index=True)

    return met.mapInPandas(count, f"environment {kind}, k int, n long").groupBy("environment", "k").agg(F.sum("n").alias("n"))


def neighbors_capped(samples: DataFrame, limit: int, seed: int) -> DataFrame:
    """SP3: (environment, rank, a, b): of the pairs of a bin and the next, ranked by ``draw``, those that ``usage_capped`` takes.

    Pairs that are taken from the first range have their rank from the fold, as no pair of it is left out. An environment's fold is one task's, over
    about ``A_MEMBER`` pairs a member. Rows without an id or a bin are left out.
    """
    kind, id_kind = samples.schema["bin_id"].dataType.simpleString(), samples.schema["sample_id"].dataType.simpleString()
    everyone = written(_members(samples), "cap-members")
    sizes = written(_both(everyone).select("environment", (F.col("m0") + F.col("m1")).alias("wanted"), F.lit(0).cast("long").alias("low")), "cap-sizes")
    members, ranges, stages = everyone, sizes, []
    while not ranges.isEmpty():
        share = F.col("wanted") * F.lit(float(A_MEMBER)) / (F.col("m0").cast("double") * F.col("m1"))
        high = F.when(share >= 1, F.lit(_ALL)).otherwise(F.least(F.lit(_ALL), F.col("low") + F.greatest(F.lit(1), (share * F.lit(float(_ALL))).cast("long"))))
        now = written(ranges.join(_both(members), "environment").select("environment", "wanted", "low", high.alias("high")), "cap-ranges")
        found = _folded(_in_range(_met(members, now, ("low", "high")), seed, kind), limit, kind)
        stages.append(written(found.withColumn("stage", F.lit(len(stages))), "cap-taken"))
        taken = functools.reduce(DataFrame.union, stages)
        uses = taken.select("environment", F.explode(F.array("a", "b")).alias("id")).groupBy("environment", "id").agg(F.count("*").cast("int").alias("uses"))
        left = now.where(F.col("high") < _ALL).select("environment", "wanted", F.col("high").alias("low"))
        later = everyone.select("environment", "side", "id").join(left.select("environment"), "environment", "left_semi").join(uses, ["environment", "id"], "left")
        before, members = members, written(later.select("environment", "side", "id", F.coalesce("uses", F.lit(0)).alias("used")).where(F.col("used") < limit), "cap-members")
        ranges = left.join(_both(members).select("environment"), "environment", "left_semi")
        if before is not everyone:
            release(before)
    if not stages:
        return samples.select(F.col("bin_id").alias("environment"), F.lit(0).cast("long").alias("rank"), F.col("sample_id").alias("a"), F.col("sample_id").alias("b")).where("false")
    taken = functools.reduce(DataFrame.union, stages)
    every, same = Window.partitionBy("environment").orderBy("digest"), Window.partitionBy("environment", "digest").orderBy("a")
    # pairs of one digest are copies of one pair, which are taken in turn
    late = taken.where("stage > 0").withColumns({"k": F.dense_rank().over(every) - 1, "copy": F.row_number().over(same)})
    late = written(late.select("environment", "digest", "k", "copy", "a", "b"), "cap-late")
    marks = late.groupBy("environment").agg(F.array_sort(F.array_distinct(F.collect_list("digest"))).alias("marks"))
    below = _counted(_met(everyone, marks, ("marks",)), seed, kind)
    ranked = late.join(below, ["environment", "k"]).select("environment", (F.col("n") + F.col("copy")).alias("rank"), "a", "b")
    early = taken.where("stage = 0").select("environment", F.col("at").alias("rank"), "a", "b")
    return early.unionByName(ranked).select("environment", "rank", F.col("a").cast(id_kind).alias("a"), F.col("b").cast(id_kind).alias("b"))
