"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` deals the documents to segments of about SEGMENT_WORDS words and stores, a row a segment,
the postings of every term: sorted positions, with a gap between documents so that no phrase crosses one.
``search`` takes the benchmark's windows to every segment: a window's terms are ranked by the segment's
posting counts, the rarest term's postings are the candidates, and the other terms' postings, shifted by
their offsets, are intersected with them from rare to common. The same candidates, with a distance instead
of an offset, give proximity matches: every term of the window within reach of its rarest term.

The index is written to the shared folder; a segment needs nothing from another, so it is searched where it
lies and nothing is shuffled.
The windows are broadcast in blocks of about BLOCK_WINDOWS; one block is the rule, more are searched in
turn over the stored index, each released before the next, and their hits are merged by segment and document.

Defined cases: null or wordless texts have no words and are clean; null or wordless items have no windows;
a null item id counts as the empty string; items of one id are one item; repeated documents are judged
row by row; without documents there are no rows, without benchmark nothing is hit; texts of any length are
read whole, one that is longer than a segment makes a segment of its own; columns of other names are not
read, and ``drop_contaminated`` carries them on whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.common import release, unused, written

WINDOW = 10
SEGMENT_WORDS = 1_000_000
BLOCK_WINDOWS = 200_000
#: Candidate places that a segment looks at together.
CANDIDATES = 1_000_000
#: Words that may stand between the rarest term of a window and another beyond the window's length.
SLOP = 5

_WORD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and anything beyond ASCII."""
    return (text or "").encode("utf-8", "replace").lower().translate(_WORD).split()


def _segment(ids: list, lengths: array, vocabulary: dict[bytes, int], stream: array) -> dict:
    sizes = np.array(lengths, np.int64)
    at = np.arange(len(stream)) + np.repeat(np.arange(len(sizes)), sizes)  # a gap of one before each next document
    terms = np.frombuffer(stream, np.int32) if len(stream) else np.zeros(0, np.int32)
    positions = at[np.argsort(terms, kind="stable")]
    return {
        "ids": ids,
        "lengths": sizes.astype(np.int32).tobytes(),
        "terms": b" ".join(vocabulary),
        "counts": np.bincount(terms, minlength=len(vocabulary)).astype(np.int32).tobytes(),
        "positions": zstandard.ZstdCompressor(3).compress(np.diff(positions, prepend=0).astype(np.int32).tobytes()),  # steps from posting to posting
    }


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """One row a segment: ids (as JSON, so that they stay whole) and lengths of its documents, its terms, and their postings."""

    def build(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [], array("i"), {}, array("i")
        for pdf in it:
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                ids, lengths, vocabulary, stream = held
                ids.append(k)
                found = words(t if isinstance(t, str) else None)
                lengths.append(len(found))
                stream.extend([vocabulary.setdefault(w, len(vocabulary)) for w in found])
                if len(stream) >= segment_words:
                    yield pd.DataFrame([_segment(*held)])
                    held = [], array("i"), {}, array("i")
        if held[0]:
            yield pd.DataFrame([_segment(*held)])

    out = "ids array<string>, lengths binary, terms binary, counts binary, positions binary"
    return docs.select(F.to_json(F.struct("doc_id")).alias("k"), F.col("text").alias("t")).mapInPandas(build, out)


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, items): every distinct window, space-joined, and the sorted ids of its items."""

    def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                w = words(t if isinstance(t, str) else None)
                got += [(b" ".join(w[i : i + size]), k) for i in range(max(1, len(w) - size + 1)) if w]
            yield pd.DataFrame(got, columns=["window", "item"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("k"), F.col("text").alias("t"))
    return rows.mapInPandas(each, "window binary, item string").groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Queries:
    """A block of windows: their distinct terms, a matrix of term numbers (-1 past the end), and their items."""

    def __init__(self, rows: list[tuple[bytes, list[str]]]):
        split = [bytes(w).split() for w, _ in rows]
        vocabulary: dict[bytes, int] = {}
        for w in split:
            for term in w:
                vocabulary.setdefault(term, len(vocabulary))
        self.terms = list(vocabulary)
        self.lengths = np.array([len(w) for w in split], np.int64)
        self.matrix = np.full((len(split), max(map(len, split), default=1)), -1, np.int64)
        for i, w in enumerate(split):
            self.matrix[i, : len(w)] = [vocabulary[t] for t in w]
        self.items = [list(i) for _, i in rows]


class Segment:
    """A stored segment, opened for search."""

    def __init__(self, row):
        self.ids = list(row.ids)
        self.lengths = np.frombuffer(row.lengths, np.int32).astype(np.int64)
        self.first = np.r_[0, np.cumsum(self.lengths + 1)]
        self.terms = {t: i for i, t in enumerate(bytes(row.terms).split())}
        counts = np.frombuffer(row.counts, np.int32).astype(np.int64)
        self.starts = np.r_[0, np.cumsum(counts)]
        self.span = int(self.first[-1]) + 1
        self.positions = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(row.positions), np.int32), dtype=np.int64)
        self.keys = np.repeat(np.arange(len(counts)), counts) * self.span + self.positions

    def has(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term has a posting from low to high."""
        at = np.searchsorted(self.keys, term * self.span + low)
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (at < len(self.keys)) & (found <= term * self.span + high)

    def search(self, q: Queries, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, place) of exact matches, then (window, document) of proximity matches."""
        none = np.zeros(0, np.int64)
        if not len(q.lengths) or not len(self.keys):
            return none, none, none, none
        known = np.array([self.terms.get(t, -1) for t in q.terms] + [-2], np.int64)
        m = known[q.matrix]  # -1: not here, -2: past the window's end
        rows = np.flatnonzero((m != -1).all(1))
        if not len(rows):
            return none, none, none, none
        m, n = m[rows], q.lengths[rows]
        counts = np.where(m >= 0, self.starts[np.maximum(m, 0) + 1] - self.starts[np.maximum(m, 0)], np.iinfo(np.int64).max)
        rank = np.argsort(counts, axis=1, kind="stable")
        many = counts[np.arange(len(m)), rank[:, 0]]
        parts = [self.matches(m[c], n[c], rank[c], many[c], rows[c], slop) for c in np.split(np.arange(len(m)), np.flatnonzero(np.diff(np.cumsum(many) // CANDIDATES)) + 1)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def matches(self, m: np.ndarray, n: np.ndarray, rank: np.ndarray, many: np.ndarray, rows: np.ndarray, slop: int) -> tuple[np.ndarray, ...]:
        """``search`` for some windows: terms, lengths, places of terms from rare to common, postings of the rarest, numbers."""
        rarest = m[np.arange(len(m)), rank[:, 0]]
        who = np.repeat(np.arange(len(m)), many)
        inner = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
        place = self.positions[self.starts[rarest][who] + inner]
        doc = np.searchsorted(self.first, place, side="right") - 1
        low, high = self.first[doc], self.first[doc] + self.lengths[doc] - 1
        begin = place - rank[who, 0]
        exact = (begin >= low) & (begin + n[who] - 1 <= high)
        near = np.ones(len(who), bool)
        for j in range(1, m.shape[1]):
            offset = rank[who, j]
            term = m[who, offset]
            live = np.flatnonzero(exact & (term >= 0))
            exact[live] = self.has(term[live], begin[live] + offset[live], begin[live] + offset[live])
            live = np.flatnonzero(near & (term >= 0))
            reach = n[who[live]] - 1 + slop
            near[live] = self.has(term[live], np.maximum(place[live] - reach, low[live]), np.minimum(place[live] + reach, high[live]))
        # of proximity, a window and document count once, so chunks send each pair once
        pairs = np.unique(np.stack([rows[who[near]], doc[near]]), axis=1)
        return rows[who[exact]], begin[exact], pairs[0], pairs[1]


def _hits(segment: Segment, q: Queries, slop: int) -> tuple[list[list[int]], list[list[str]], np.ndarray]:
    """By document: covered runs of words (flat, start and end in turn), item ids, and windows matched nearby only or exactly."""
    win, begin, near_win, near_doc = segment.search(q, slop)
    size = len(segment.ids)
    spans: list[list[int]] = [[] for _ in range(size)]
    items: list[set[str]] = [set() for _ in range(size)]
    doc = np.searchsorted(segment.first, begin, side="right") - 1
    cover = np.zeros(segment.span + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + q.lengths[win], -1)
    inside = np.diff(np.r_[0, (np.cumsum(cover) > 0).astype(np.int8), 0])
    for a, b in zip(np.flatnonzero(inside == 1), np.flatnonzero(inside == -1), strict=True):
        d = int(np.searchsorted(segment.first, a, side="right")) - 1
        spans[d] += [int(a - segment.first[d]), int(b - segment.first[d])]
    for d, w in zip(doc, win, strict=True):
        items[d].update(q.items[w])
    pairs = np.unique(near_doc * (len(q.lengths) + 1) + near_win) if len(near_win) else near_win
    return spans, [sorted(i) for i in items], np.bincount(pairs // (len(q.lengths) + 1), minlength=size) if len(pairs) else np.zeros(size, np.int64)


def search(index: DataFrame, queries: DataFrame, slop: int = SLOP, block: int = BLOCK_WINDOWS) -> DataFrame:
    """(key, n_words, spans, n_hit, items, n_near) of every indexed document; ``key`` is its id as JSON.

    n_hit: words covered by exact matches; spans: their numbers as [start, end, ...]; n_near: windows with all terms close together.
    """
    sc = index.sparkSession.sparkContext
    queries = written(queries, "windows")
    blocks = max(1, -(-queries.count() // block))
    index = written(index.withColumn("segment", F.monotonically_increasing_id()), "index")  # numbered once, as it is stored
    parts = []
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        shared = sc.broadcast(Queries([(r.window, r.items) for r in mine.collect()]))

        def look(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in it:
                for row in pdf.itertuples(index=False):
                    s = Segment(row)
                    spans, items, near = _hits(s, shared.value, slop)
                    yield pd.DataFrame({
                        "segment": row.segment, "place": range(len(s.ids)), "key": pd.Series(s.ids, dtype=object), "n_words": s.lengths, "spans": spans, "n_hit": [_covered(x) for x in spans], "items": items, "n_near": near,
                    })

        found = index.mapInPandas(look, "segment long, place int, key string, n_words long, spans array<int>, n_hit long, items array<string>, n_near long")
        if blocks == 1:
            return found.drop("segment", "place")
        parts.append(written(found, "hits"))
        shared.destroy()
    release(index)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    merged = found.groupBy("segment", "place", "key", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.sum("n_near").alias("n_near")
    )

    @F.pandas_udf("long")
    def covered(spans: pd.Series) -> pd.Series:
        return spans.map(lambda s: _covered(list(s)))

    return merged.withColumn("n_hit", covered("spans")).drop("segment", "place")


def _covered(spans: list[int]) -> int:
    total, end = 0, 0
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP, block: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) of every row of ``docs``."""
    found = search(build_index(docs), windows(benchmark, size), slop, block)
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    return found.select(
        F.from_json("key", kind)["doc_id"].alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window, all columns as they were.

    Documents are named by id, and by a hash of the text in case an id is repeated or null.
    """
    i, h, t = unused(docs, "i", "h", "t")
    marked = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    bad = decontaminate(marked, benchmark, size).where("contaminated").select(F.col("doc_id.doc_id").alias(i), F.col("doc_id.h").alias(h)).distinct()
    rows = docs.withColumn(t, F.xxhash64("text"))
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(t) == F.col(h)), "left_anti").drop(t)
