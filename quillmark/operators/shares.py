"""A share of the pairs of crossed bins in random order, without a list of them.

The random order is that of the MD5 of seed and ids, as ``pairs.draw`` has it. Packed blocks of two bins meet in tasks, which make the digests of
their pairs as matrices. The share of two bins ends near its ratio of all digests: pairs in a narrow range of digests about that place are
rows and get a rank, those below the range are only counted, and a second time given. So a pair is a row only where it is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.common import width, written
from quillmark.functions import digests

#: Members of a packed block.
BLOCK_ROWS = 2048
#: Standard deviations of a share's place that the range of digests reaches, to both sides. Where that is not enough, digests are counted by buckets.
DEVIATIONS = 5.0
#: Digests are told apart by their first 32 bits; buckets are the first 12 of them.
_ALL, _BUCKET_BITS = 1 << 32, 12
#: Counts that a task holds before it gives them out.
_HELD = 1 << 20


def _packed(samples: DataFrame) -> DataFrame:
    """(bin, block, members), written: the samples of each bin in blocks, each id once with its copies; ``again`` marks ids that stand in more rows than one, or are null."""
    rows = samples.where("bin_id is not null").groupBy(F.col("bin_id").alias("bin"), F.col("sample_id").alias("id")).agg(F.count("*").alias("copies"))
    again = F.col("id").isNull() | (F.sum("copies").over(Window.partitionBy("id")) > 1)
    text = F.coalesce(F.concat(F.lit("|"), F.col("id").cast("string")), F.lit(""))
    member = F.struct("id", text.alias("text"), "copies", again.alias("again"))
    blocks = rows.groupBy("bin").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    dealt = rows.select("bin", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("hash"), member.alias("member")).join(blocks, "bin")
    packed = dealt.groupBy("bin", (F.col("hash") % F.col("blocks")).cast("int").alias("block")).agg(F.collect_list("member").alias("members"))
    return written(packed, "share-blocks")


def _crossed(packed: DataFrame, ratio: float) -> DataFrame:
    """(bin_a, bin_b, na, nb, wanted, low, high), written: every two bins with their blocks, the size of their share, and the range of digests where it is expected to end."""
    one = packed.select("bin", "block", F.explode("members.copies").alias("copies"))
    sizes = one.groupBy("bin").agg((F.max("block") + 1).alias("n"), F.sum("copies").alias("m"), F.sqrt(F.sum(F.col("copies").cast("double") * F.col("copies"))).alias("spread"))
    side = lambda s: sizes.select(F.col("bin").alias(f"bin_{s}"), *[F.col(c).alias(f"{c}{s}") for c in ("n", "m", "spread")])
    every = side("a").join(side("b"), F.col("bin_a") < F.col("bin_b"))
    total = F.col("ma") * F.col("mb")
    off = F.lit(DEVIATIONS / 2) * F.col("spreada") * F.col("spreadb") / (F.col("ma").cast("double") * F.col("mb")) + F.lit(2.0 / _ALL)
    place = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * F.lit(float(_ALL))
    wanted = F.least(total, F.ceil(total * F.lit(ratio)).cast("long"))
    return written(every.select("bin_a", "bin_b", "na", "nb", wanted.alias("wanted"), place(F.lit(ratio) - off).cast("long").alias("low"), F.ceil(place(F.lit(ratio) + off)).cast("long").alias("high")), "share-bins")


def _met(packed: DataFrame, crossed: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    """(bin_a, bin_b, *extra, x, y): every block of the first bin with every block of the second."""
    w, keys = width(packed.sparkSession), ["bin_a", "bin_b", "i", "j"]
    first = packed.select(F.col("bin").alias("bin_a"), F.col("block").alias("i"), F.col("members").alias("x")).join(crossed, "bin_a")
    first = first.select("bin_a", "bin_b", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), *extra, "x")
    second = packed.select(F.col("bin").alias("bin_b"), F.col("block").alias("j"), F.col("members").alias("y")).join(crossed, "bin_b")
    second = second.select("bin_a", "bin_b", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"), "j", "y")
    return first.repartition(w, *keys).join(second.repartition(w, *keys).hint("merge"), keys).select("bin_a", "bin_b", *extra, "x", "y")


class _Side:
    """Members of a block: ids, bytes of their texts, copies, and which are there again."""

    def __init__(self, members: pa.StructArray, head: bytes = b""):
        self.ids, texts, copies, again = members.flatten()
        self.texts, self.copies, self.again = [head + t.encode() for t in texts.to_pylist()], copies.to_numpy(), again.to_numpy(zero_copy_only=False)

    def only(self, at: np.ndarray) -> _Side:
        out = object.__new__(_Side)
        out.ids, out.copies, out.again = self.ids.take(pa.array(at)), self.copies[at], self.again[at]
        out.texts = [self.texts[k] for k in at]
        return out


def _rows(it: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[pa.RecordBatch, int, _Side, _Side]]:
    for batch in it:
        for k in range(batch.num_rows):
            yield batch, k, _Side(batch.column("x")[k].values, str(seed).encode()), _Side(batch.column("y")[k].values)


def _firsts(x: _Side, y: _Side) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, words): the first words of the digests of all pairs of x and y, by tiles."""
    for i, j, words in digests.md5_of_products(x.texts, y.texts, whole=False):
        yield i, j, words[0]


def _same(batch: pa.RecordBatch, name: str, k: int, n: int) -> pa.Array:
    return batch.column(name).take(pa.array(np.full(n, k)))


def _in_range(met: DataFrame, seed: int, kinds: tuple[str, str]) -> DataFrame:
    """(bin_a, bin_b, copies, digest, a, b, again): the pairs whose digest is in the range; a row without a digest has how many are below."""

    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, x, y in _rows(it, seed):
            low, high = batch.column("low")[k].as_py(), batch.column("high")[k].as_py()
            alone, below, found = bool((x.copies == 1).all() and (y.copies == 1).all()), 0, [(np.zeros(0, np.int64),) * 2]
            for i, j, first in _firsts(x, y):
                under = first < low
                below += int(np.count_nonzero(under)) if alone else int(x.copies[i] @ (under @ y.copies[j]))
                p, q = np.nonzero((first >= low) & (first < high))
                found.append((i[p], j[q]))
            p, q = (np.concatenate(f) for f in zip(*found, strict=True))
            made = [hashlib.md5(x.texts[s] + y.texts[t]).digest() for s, t in zip(p.tolist(), q.tolist(), strict=True)]
            none = lambda a: pa.concat_arrays([pa.nulls(1, a.type), a])
            again = pa.array(x.again[p] | y.again[q])
            columns = [_same(batch, "bin_a", k, len(p) + 1), _same(batch, "bin_b", k, len(p) + 1), pa.array(np.r_[below, x.copies[p] * y.copies[q]], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *map(none, (pa.array(made, pa.binary()), x.ids.take(pa.array(p)), y.ids.take(pa.array(q)), again))], names)

    names = ["bin_a", "bin_b", "copies", "digest", "a", "b", "again"]
    return met.mapInArrow(pick, f"bin_a {kinds[0]}, bin_b {kinds[0]}, copies long, digest binary, a {kinds[1]}, b {kinds[1]}, again boolean")


def _by_buckets(met: DataFrame, seed: int, kind: str) -> DataFrame:
    """(bin_a, bin_b, bucket, n): how many pairs have a digest of each bucket."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch, k, x, y in _rows(it, seed):
            key = (batch.column("bin_a")[k], batch.column("bin_b")[k])
            n = held.setdefault(key, np.zeros(1 << _BUCKET_BITS, np.int64))
            for i, j, first in _firsts(x, y):
                bucket = (first >> np.uint32(32 - _BUCKET_BITS)).ravel()
                for c in np.unique(copies := np.multiply.outer(x.copies[i], y.copies[j]).ravel()):
                    n += c * np.bincount(bucket[copies == c], minlength=len(n))
            if len(held) << _BUCKET_BITS > _HELD:
                yield given(held)
                held = {}
        if held:
            yield given(held)

    def given(held: dict) -> pa.RecordBatch:
        each = 1 << _BUCKET_BITS
        a, b = (pa.array([key[s].as_py() for key in held for _ in range(each)], next(iter(held))[s].type) for s in (0, 1))
        return pa.RecordBatch.from_arrays([a, b, pa.array(np.tile(np.arange(each, dtype=np.int32), len(held))), pa.array(np.concatenate(list(held.values())))], ["bin_a", "bin_b", "bucket", "n"])

    return met.mapInArrow(count, f"bin_a {kind}, bin_b {kind}, bucket int, n long").groupBy("bin_a", "bin_b", "bucket").agg(F.sum("n").alias("n"))


def _ranked(packed: DataFrame, crossed: DataFrame, seed: int, kinds: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Of each two bins: (..., rest), how many pairs of the range the share takes, which may be more or fewer than there are; and the pairs with how many ``copies`` are ``taken``."""
    bins = ["bin_a", "bin_b"]
    found = written(_in_range(_met(packed, crossed, ("low", "high")), seed, kinds), "share-range")
    counts = found.groupBy(*bins).agg(F.sum(F.when(F.col("digest").isNull(), F.col("copies"))).alias("below"), F.coalesce(F.sum(F.when(F.col("digest").isNotNull(), F.col("copies"))), F.lit(0)).alias("inside"))
    ends = written(crossed.join(counts, bins).withColumn("rest", F.col("wanted") - F.col("below")).drop("below"), "share-ends")
    before = F.sum("copies").over(Window.partitionBy(*bins).orderBy("digest", "a", "b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    ranked = found.where("digest is not null").withColumn("before", before).join(ends.where("rest between 0 and inside").select(*bins, "rest"), bins)
    taken = F.greatest(F.lit(0), F.least(F.col("copies"), F.col("rest") - F.col("before")))
    return ends, written(ranked.withColumn("taken", taken).drop("digest", "before", "rest"), "share-ranked")


class Share:
    """ceil(n * ratio) pairs of each two bins (bin_a < bin_b) of ``samples`` (sample_id, bin_id, ...) by random rank: where the shares end."""

    def __init__(self, samples: DataFrame, ratio: float, seed: int):
        self.seed, self.kinds = seed, (samples.schema["bin_id"].dataType.simpleString(), samples.schema["sample_id"].dataType.simpleString())
        self.packed = _packed(samples)
        crossed, bins = _crossed(self.packed, ratio), ["bin_a", "bin_b"]
        ends, ranked = _ranked(self.packed, crossed, seed, self.kinds)
        missed = ends.where("not rest between 0 and inside").select(*crossed.columns)
        if not missed.isEmpty():  # few, or ids of very many copies: the bucket of digests where the share ends is counted out
            n = _by_buckets(_met(self.packed, missed, ()), seed, self.kinds[0])
            upto = n.withColumn("upto", F.sum("n").over(Window.partitionBy(*bins).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).join(missed.drop("low", "high"), bins)
            end = upto.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
            low = F.shiftleft(F.col("bucket").cast("long"), 32 - _BUCKET_BITS)
            counted = written(end.select("bin_a", "bin_b", "na", "nb", "wanted", low.alias("low"), (low + (1 << 32 - _BUCKET_BITS)).alias("high")), "share-bins")
            more, also = _ranked(self.packed, counted, seed, self.kinds)
            ends, ranked = ends.where("rest between 0 and inside").unionByName(more), ranked.unionByName(also)
        self.ends, self.ranked = ends, ranked

    def _given(self, near: bool, again: bool | None) -> DataFrame:
        """(bin_a, bin_b, a, b, beyond): pairs below the ranges; with ``near`` also those beyond, of neighbouring bins. ``again``: only pairs that hold an id that is there again, or only others."""

        def give(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, k, x, y in _rows(it, seed):
                low, high, beyond = (batch.column(c)[k].as_py() for c in ("low", "high", "beyond"))
                parts = [(x, y)]
                if again is not None and (x.again.any() or y.again.any()):
                    x0, x1, y0, y1 = (s.only(np.flatnonzero(s.again == v)) for s in (x, y) for v in (False, True))
                    parts = [(x1, y), (x0, y1)] if again else [(x0, y0)]
                elif again:
                    parts = []
                for x_, y_ in parts:
                    alone = bool((x_.copies == 1).all() and (y_.copies == 1).all())
                    for i, j, first in _firsts(x_, y_):
                        for mask, other in ((first < low, False), (first >= high, True)) if beyond else ((first < low, False),):
                            p, q = np.nonzero(mask)
                            p, q = i[p], j[q]
                            if not alone:
                                times = x_.copies[p] * y_.copies[q]
                                p, q = np.repeat(p, times), np.repeat(q, times)
                            if len(p):
                                made = [_same(batch, "bin_a", k, len(p)), _same(batch, "bin_b", k, len(p)), x_.ids.take(pa.array(p)), y_.ids.take(pa.array(q)), pa.array(np.full(len(p), other))]
                                yield pa.RecordBatch.from_arrays(made, ["bin_a", "bin_b", "a", "b", "beyond"])

        seed, is_near = self.seed, F.col("bin_b") == F.col("bin_a") + 1
        ends = self.ends.select("bin_a", "bin_b", "na", "nb", "low", "high", (is_near if near else F.lit(False)).alias("beyond"))
        met = _met(self.packed, ends, ("low", "high", "beyond"))
        return met.mapInArrow(give, f"bin_a {self.kinds[0]}, bin_b {self.kinds[0]}, a {self.kinds[1]}, b {self.kinds[1]}, beyond boolean")

    def pairs(self, near: bool = False, again: bool | None = None) -> DataFrame:
        """(bin_a, bin_b, a, b, beyond): the pairs of the shares; with ``near`` also those that the shares leave, marked ``beyond``, of bins that differ by one."""
        columns = ["bin_a", "bin_b", "a", "b"]
        ranked = self.ranked if again is None else self.ranked.where(F.col("again") == F.lit(again))
        times = lambda c: F.explode(F.array_repeat(F.lit(0), c.cast("int")))
        edge = ranked.where("taken > 0").select(*columns, F.lit(False).alias("beyond"), times(F.col("taken")).alias("copy")).drop("copy")
        if near:
            left = ranked.where("taken < copies and bin_b = bin_a + 1")
            edge = edge.unionByName(left.select(*columns, F.lit(True).alias("beyond"), times(F.col("copies") - F.col("taken")).alias("copy")).drop("copy"))
        return self._given(near, again).unionByName(edge)

    def again(self) -> bool:
        """Whether an id stands in more rows than one, or is null."""
        return not self.packed.where(F.exists("members", lambda m: m["again"])).isEmpty()
