"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if its least s-mer (by hash) lies first or last in it. That depends on
the k-mer alone, so equal passages have equal anchors wherever they stand. ``anchors`` gives their hashes
and places; a fingerprint is the SKETCH least distinct hashes, and the likeness of two fingerprints is the
share of common hashes among the least of their union (an estimate of the Jaccard likeness of the anchors).
``covered`` matches by place and over all anchors: the share of a text that lies in anchors of another.

Neighbours: every document is compared with the next in descending doc_id. Ids alone are range-sorted to
find bounds; each bucket then gets its rows and a copy of the next bucket's first row, so that one shuffle
of the texts and a sort inside partitions bring each text before its next.

Defined cases: null text is empty; texts shorter than k are one anchor of their own, longer ones without a
closed syncmer have their k-mer of least hash as anchor, the empty text has none and an empty fingerprint,
like only to another and covered only by another; a null id sorts last; rows of equal id follow the hash
of their texts; a lone row is its own next; an empty table gives no rows. Texts of any length are read whole. Columns of
other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.common import width
from quillmark.llm._ids import mapped

K, S, SKETCH = 15, 5, 64

_MULT, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _grams(c: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all runs of n values, by doubling."""
    out, done, have, power = None, 0, c, int(_MULT)
    size = 1
    while True:
        if n & size:
            if out is None:
                out, done = have, size
            else:  # out covers `done` values, append a run of `size`
                m = len(c) - done - size + 1
                out, done = out[:m] * np.uint64(power) + have[done : done + m], done + size
        size *= 2
        if size > n:
            return out
        half = size // 2
        have = have[: len(c) - size + 1] * np.uint64(power) + have[half : half + len(c) - size + 1]
        power = power * power % (1 << 64)


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the closed syncmers of a whole text; of its least k-mer if it has none."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    if not len(c):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(c) < k:
        return _mixed(_grams(c, len(c))), np.zeros(1, np.int64)
    h = _mixed(_grams(c, s))
    w = k - s + 1  # s-mers in a k-mer
    low, size = h, 1
    while size < w:
        step = min(size, w - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    n = len(c) - k + 1
    at = np.flatnonzero((h[:n] == low) | (h[w - 1 : w - 1 + n] == low))
    if not len(at):
        at = np.array([_mixed(_grams(c, k)).argmin()])
    run = np.zeros(len(at), np.uint64)
    for i in range(k):
        run = run * _MULT + c[at + i]
    return _mixed(run), at


def sketch(text: str, size: int = SKETCH) -> np.ndarray:
    """The least distinct 32-bit anchor hashes."""
    return least(anchors(text)[0], size)


def least(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The least distinct 32-bit ones of anchor hashes."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:size]


def covered(n_chars: int, found: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], k: int = K) -> float:
    """The share of a text's code points that lie in one of its anchors (``found``) that ``other`` has too."""
    if not n_chars:
        return float(not len(other[0]))
    at = found[1][np.isin(found[0], other[0])]
    if not len(at):
        return 0.0
    span = min(k, n_chars)  # places are in order: anchors overlap where the next starts within the span
    return float(np.minimum(np.diff(at, append=at[-1] + span), span).sum()) / n_chars


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    low = np.union1d(a, b)[:size]
    return float(np.isin(low, a, assume_unique=True).astype(int) @ np.isin(low, b, assume_unique=True).astype(int)) / len(low)


def _hex(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_kept, covered_edited, covered_next)."""
    n, lowest = 2 * width(docs.sparkSession), -(1 << 63)
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest))
    firsts = docs.select(rank.alias("r")).repartitionByRange(n, F.col("r").desc()).groupBy(F.spark_partition_id()).agg(F.max("r").alias("r"))
    bounds = np.sort(np.array([r["r"] for r in firsts.collect()], np.int64))  # the first row of each bucket, one number a partition
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("array<int>")
    def bucket(r: pd.Series) -> pd.Series:
        """A row's bucket; for a first row also the bucket before it, as -1 - bucket."""
        b, v = shared.value, r.to_numpy(np.int64)
        own = np.searchsorted(b, v)
        return pd.Series([[o, -1 - (o + 1) % len(b)] if b[o] == x else [o] for o, x in zip(own, v, strict=True)])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), rank.alias("r"))
    dealt = rows.select("doc_id", "text", "r", F.explode(bucket("r")).alias("b"))
    dealt = dealt.select("doc_id", "text", "r", F.when(F.col("b") < 0, -1 - F.col("b")).otherwise(F.col("b")).alias("bucket"), (F.col("b") >= 0).alias("own"))
    sorted_ = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", F.col("own").desc(), F.col("r").desc(), F.xxhash64("text"))

    def walk(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in it:
            out = []
            for k, text, b, own in zip(pdf["doc_id"], pdf["text"], pdf["bucket"], pdf["own"], strict=True):
                if last is not None and last[2] == b and last[4]:
                    found = anchors(text)
                    out.append(_compared(last, text, found))
                    last = (k, text, b, found, own)
                elif own:  # the first of a bucket
                    last = (k, text, b, anchors(text), own)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_kept", "covered_edited", "covered_next"])

    return mapped(
        sorted_.select("doc_id", "text", "bucket", "own"),
        walk,
        "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_kept long, covered_edited double, covered_next double",
    )


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the start of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(row: tuple, following: str, next_found: tuple[np.ndarray, np.ndarray]) -> tuple:
    k, text, _, found, _ = row
    changed = edited(text, following)
    found2 = anchors(changed)
    fp, fp2, next_fp = least(found[0]), least(found2[0]), least(next_found[0])
    near = (likeness(fp, fp2), likeness(fp, next_fp))
    return (k, len(text), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), _hex(fp), _hex(fp2), *near, len(fp), covered(len(text), found, found2), covered(len(text), found, next_found))
