"""Line deduplication by a deletion-neighbourhood join.

Lines are compared as sequences of words; two lines are close if at most one word is inserted, left out or
replaced. Every line's variants are itself and itself without one word, as hashed keys. Lines that share a
variant are joined: those that leave out the same place differ in that word alone, and a whole line that
equals another's variant lacks one word. Within a variant only the earliest line is carried on, never
pairs; the chosen partner's edit distance is verified on the words. A line goes if an earlier line (by
doc_id, then line number) is equal or close, as the input has them.

Before variants are made, lines are sieved: of two close lines with m words at most, either the first or
the last half of m-1 words agree, so lines that share neither half with another line have no close line.
The edit bound is one word for lines of MIN_WORDS words or more and none for shorter ones, where a word is more
than a fifth of the line; equal means the same characters, and is settled by hash first.

Defined cases: null text stays null; white lines are never removed nor compared; a null doc_id is later than
any other; rows of one doc_id are one document, whose equal places are not earlier than each other; an
empty table gives no rows. Lines and documents of any length are read whole. Other columns, whatever their
names, are carried on as they are; the names of the two counts are lengthened where a column has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.common import release, unused, width, written
from quillmark.llm._ids import mapped

#: The edit bound is one word from so many words on (a likeness of 0.8), and none for shorter lines.
MIN_WORDS = 5

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
_SEED = 42  # of Spark's xxhash64


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _halves(words: list[bytes], min_words: int) -> list[int | None]:
    """Hashes of the halves that a close line of as many or one more words must share; null for short lines."""
    n, out = len(words), []
    if n < min_words:
        return [None] * 4
    for m in (n, n + 1):
        head = (m - 1) // 2
        tail = m - 1 - head
        for side, part in enumerate((words[:head], words[n - tail :])):
            out.append(_signed(xxhash.xxh64_intdigest(b" ".join(part), 2 * m + side)))
    return out


def lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t, n, h1, h2, k0..k3) of every line that is not white: hash of the text, number and hash of the line, its halves."""

    def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            doc, rows = [], []
            for i, text in enumerate(pdf["text"]):
                raw = text.encode("utf-8", "replace")
                t = _signed(xxhash.xxh64_intdigest(raw, _SEED))
                for n, line in enumerate(raw.split(b"\n")):
                    words = line.split()
                    if words:
                        h = xxhash.xxh3_128_intdigest(line)
                        doc.append(i)
                        rows.append((t, n, _signed(h >> 64), _signed(h & (1 << 64) - 1), *_halves(words, min_words)))
                if len(rows) > 50_000:
                    yield frame(pdf, doc, rows)
                    doc, rows = [], []
            yield frame(pdf, doc, rows)

    def frame(pdf: pd.DataFrame, doc: list, rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["t", "n", "h1", "h2", "k0", "k1", "k2", "k3"], dtype=object).astype("Int64")
        out.insert(0, "doc_id", pdf["doc_id"].iloc[doc].to_numpy())
        return out

    rows = docs.select("doc_id", "text").where("text is not null")
    return mapped(rows, each, "t long, n int, h1 long, h2 long, k0 long, k1 long, k2 long, k3 long")


def _at():
    """Orders lines by document and number."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("n").alias("line"))


@F.pandas_udf(T.BinaryType())
def _packed(text: pd.Series) -> pd.Series:
    """Texts as they go through a shuffle."""
    pack = zstandard.ZstdCompressor(3).compress
    return text.map(lambda t: None if t is None else pack(t.encode("utf-8", "replace")))


def _unpacked(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def variants(words: list[bytes]) -> np.ndarray:
    """Hashes of the words without each in turn, then of all the words."""
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(h), _B)], dtype=np.uint64)
    kept = np.r_[np.uint64(0), np.cumsum(h * power[:-1], dtype=np.uint64)]  # before a place, words keep their power
    moved = np.r_[np.uint64(0), np.cumsum(h[1:] * power[: len(h) - 1], dtype=np.uint64)]  # after it, one less
    without = kept[:-1] + (moved[-1] - moved)
    sizes = np.r_[np.full(len(h), max(len(h) - 1, 0)), len(h)].astype(np.uint64)
    out = np.r_[without, kept[-1]] + sizes * _A
    out = (out ^ (out >> np.uint64(31))) * _A
    return out ^ (out >> np.uint64(29))


def close(a: list[bytes], b: list[bytes]) -> bool:
    """Whether at most one word is inserted, left out or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    return head + tail >= max(len(a), len(b)) - 1


def _sieved(distinct: DataFrame) -> DataFrame:
    """(h1) of distinct lines that share a half with another. A key's rows pass by in a stream; two of them tell all."""

    def shared(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, line = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pdf in it:
            if not len(pdf):
                continue
            key, line = np.r_[key, pdf["k"].to_numpy(np.int64)], np.r_[line, pdf["h1"].to_numpy(np.int64)]
            yield pd.DataFrame({"h1": several(key, line)})
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on
            key, line = key[last : last + 2], line[last : last + 2]

    def several(key: np.ndarray, line: np.ndarray) -> np.ndarray:
        same = key[1:] == key[:-1]
        return np.unique(line[np.r_[False, same] | np.r_[same, False]])

    keyed = distinct.select(F.explode(F.array("k0", "k1", "k2", "k3")).alias("k"), "h1").where("k is not null")
    return keyed.repartition(width(distinct.sparkSession), "k").sortWithinPartitions("k").mapInPandas(shared, "h1 long").distinct()


_LINE = "h1 long, h2 long, line string"


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, h2, line): texts of wanted lines (doc, t, n, h1, h2), each at one place."""
    by_doc = wanted.groupBy(F.col("doc").alias("__i"), F.col("t").alias("__t")).agg(F.collect_list(F.struct("n", "h1", "h2")).alias("want"))
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("t"), _packed("text").alias("z"))
    held = by_doc.join(rows, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("t") == F.col("__t"))).select("z", "want")

    def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for z, want in zip(pdf["z"], pdf["want"], strict=True):
                parts = _unpacked(z).split(b"\n")
                out += [(w["h1"], w["h2"], parts[w["n"]].decode("utf-8", "replace")) for w in want]
            yield pd.DataFrame(out, columns=["h1", "h2", "line"])

    return held.mapInPandas(each, _LINE).dropDuplicates(["h1", "h2"])


def _linked(chosen: DataFrame) -> DataFrame:
    """(own, best): places of lines of ``chosen`` (at, line), each with the earliest that shares a variant as close lines do.

    Variants are dealt and sorted by hash, then place of the line, and pass by in a stream: of an open hash only
    the first row of each word left out is held, however many lines share it.
    """
    kind = chosen.select("at.doc").schema[0].dataType

    def variants_of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            held, rows, size = [], [], 0
            for i, line in enumerate(pdf["line"]):
                v = variants(_words(line))
                held.append((v.view(np.int64), np.r_[0 : len(v) - 1, -1].astype(np.int32)))
                rows.append(np.full(len(v), i))
                size += len(v)
                if size > 50_000 or i == len(pdf) - 1:
                    v, place = (np.concatenate(x) for x in zip(*held, strict=True))
                    yield pd.concat([pd.DataFrame({"v": v, "place": place}), pdf[["none", "doc", "n"]].iloc[np.concatenate(rows)].reset_index(drop=True)], axis=1)
                    held, rows, size = [], [], 0

    def first_of(*columns: np.ndarray) -> np.ndarray:
        """For each row the first row with the same values."""
        order = np.lexsort(columns[::-1])
        new = np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)]
        out = np.empty(len(order), np.int64)
        out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]  # lexsort is stable
        return out

    def partners(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in it:
            if not len(pdf):
                continue
            old = 0 if held is None else len(held)
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            v, place = pdf["v"].to_numpy(np.int64), pdf["place"].to_numpy(np.int64)
            by_place, any_ = first_of(v, place), first_of(v)
            whole = np.full(len(v), len(v))
            np.minimum.at(whole, any_[place == -1], np.flatnonzero(place == -1))
            best = np.minimum(by_place, whole[any_])
            best = np.where(place == -1, np.minimum(best, any_), best)
            own = np.flatnonzero(best < np.arange(len(v)))
            own = own[own >= old]
            a, b = pdf[["none", "doc", "n"]].iloc[own].reset_index(drop=True), pdf[["none", "doc", "n"]].iloc[best[own]].reset_index(drop=True)
            yield pd.concat([a, b.rename(columns={"none": "none2", "doc": "doc2", "n": "n2"})], axis=1)
            tail = np.flatnonzero(v == v[-1])
            held = pdf.iloc[tail[by_place[tail] == tail]]

    # ids are text where Python sees them, and of their own kind where they are sorted
    whole = lambda df, to, *names: df.withColumns({c: F.col(c).cast(to) for c in names})
    made = whole(chosen.select("line", F.col("at.none").alias("none"), F.col("at.doc").alias("doc"), F.col("at.line").alias("n")), "string", "doc")
    made = whole(made.mapInPandas(variants_of, "v long, place int, none boolean, doc string, n int"), kind, "doc")
    dealt = made.repartition(width(chosen.sparkSession), "v").sortWithinPartitions("v", "none", "doc", "n")
    found = whole(dealt, "string", "doc").mapInPandas(partners, "none boolean, doc string, n int, none2 boolean, doc2 string, n2 int")
    found = whole(found, kind, "doc", "doc2")
    at = lambda a, b, c: F.struct(F.col(a).alias("none"), F.col(b).alias("doc"), F.col(c).alias("line"))
    return found.select(at("none", "doc", "n").alias("own"), at("none2", "doc2", "n2").alias("best")).groupBy("own").agg(F.min("best").alias("best"))


def _words(line: str) -> list[bytes]:
    return line.encode("utf-8", "replace").split()


def earliest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(h1, h2, until) of each distinct line of ``found`` that is repeated or close to another: occurrences after ``until`` go."""
    first = F.min(F.struct(_at().alias("at"), "t"))
    distinct = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), first.alias("first"), *[F.min(k).alias(k) for k in ("k0", "k1", "k2", "k3")])
    distinct = written(distinct.select("h1", "h2", "n", F.col("first.at").alias("at"), F.col("first.t").alias("t"), "k0", "k1", "k2", "k3"), "lines")
    places = distinct.join(_sieved(distinct), "h1", "left_semi")
    chosen = _texts(docs, places.select(F.col("at.doc").alias("doc"), "t", F.col("at.line").alias("n"), "h1", "h2"))
    chosen = written(chosen.join(places.select("h1", "h2", "at"), ["h1", "h2"]), "close-lines")
    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([close(_words(x), _words(y)) for x, y in zip(a, b, strict=True)])

    own = chosen.select(F.col("at").alias("own"), "h1", "h2", "line")
    other = chosen.select(F.col("at").alias("best"), F.col("line").alias("other"))
    linked = _linked(chosen).alias("l").join(own.alias("o"), [F.col(f"l.own.{f}").eqNullSafe(F.col(f"o.own.{f}")) for f in ("none", "doc", "line")]).select("best", "h1", "h2", "line")
    linked = linked.alias("l").join(other.alias("o"), [F.col(f"l.best.{f}").eqNullSafe(F.col(f"o.best.{f}")) for f in ("none", "doc", "line")]).select("l.best", "h1", "h2", "line", "other").where(verified("line", "other"))
    marked = distinct.select("h1", "h2", "n", "at").join(linked.select("h1", "h2", F.col("best").alias("near")), ["h1", "h2"], "left")
    until = written(marked.where("n > 1 or near is not null").select("h1", "h2", F.least("at", "near").alias("until")), "lines-until")
    release(distinct, chosen)
    return until


@F.pandas_udf(T.StringType())
def _cut(z: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines of the given numbers."""

    def one(raw: bytes | None, places) -> str | None:
        if raw is None:
            return None
        text = _unpacked(raw)
        if places is not None and len(places):
            drop = set(places)
            text = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in drop)
        return text.decode("utf-8", "replace")

    return pd.Series([one(a, b) for a, b in zip(z, gone, strict=True)], dtype=object)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later of equal or close lines taken out of ``text``, and __n_lines and __n_removed besides."""
    n_lines, n_removed, i, t, x, gone = unused(docs, "__n_lines", "__n_removed", "i", "t", "x", "gone")
    found = written(lines(docs, min_words), "all-lines")
    until = earliest(docs, found)
    lost = found.select("doc_id", "t", "n", "h1", "h2").join(until, ["h1", "h2"]).where(_at() > F.col("until"))
    lost = lost.groupBy(F.col("doc_id").alias(i), F.col("t").alias(t)).agg(F.collect_set("n").alias(gone))
    count = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long")
    rows = docs.withColumns({x: F.xxhash64("text"), n_lines: count, "text": _packed("text")})
    rows = rows.join(lost, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(x) == F.col(t)), "left")
    rows = rows.withColumns({n_removed: F.coalesce(F.size(gone), F.lit(0)).cast("long"), "text": _cut("text", gone)})
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], n_lines, n_removed)


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept) of every row of ``docs``."""
    out = dedup(docs.select("doc_id", "text"), min_words)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.col("text").alias("kept"))
