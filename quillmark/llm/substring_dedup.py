"""Substring deduplication by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of MIN_LENGTH bytes that covers it also starts in a document of smaller doc_id.

1. Anchors. Every window of MIN_LENGTH bytes picks one anchor inside it, by its content alone (the
   mod-minimizer of Groot Koerkamp and Pibiri), so equal windows have equal anchors, about one in 15 bytes.
   Consecutive windows of one anchor are a run; a run's bytes are hashed. Batches of documents send, by
   anchor, each distinct run with its least document; what a batch already shows to be a copy is only noted.
2. By anchor: documents that hold a run after its first document lose it whole. Anchors whose runs differ
   need their texts compared.
3. By document: places of lost runs are noted; documents with a run to compare send the run's bytes, by anchor.
4. By anchor: the distinct runs are joined to one text and ordered by MIN_LENGTH symbols, which gives its
   transform. Intervals of the order are extended backward, breadth first, one more symbol a level. A
   boundary that appears at a level has that level's common prefix less one; no interval goes on that
   shows no new boundary, and the search stops at MIN_LENGTH. Boundaries that never appeared hold
   common prefixes of MIN_LENGTH or more: equal windows, whose least document keeps them.
5. By document: all that was found is marked, and the rest is hashed.

Hot anchors. An anchor of over HOT distinct runs in a batch, or over SPLIT by anchor, isn't brought together:
in step 2 a batch sends a word that it is hot instead of its runs, and in step 3 documents send each window of
their runs by the window's own hash, since a window is equal only to windows of equal hash. Equal windows are
combined to their least document (by their bytes) where they leave and where they arrive, so no step holds all
that surrounds a common phrase in one task.

Rows are packed arrays, so that no row a window or run exists; everything is dealt by anchor or document,
into as many buckets as the bytes of text ask for, and files cut the lineage between documents and comparison.

Defined cases: null text is empty; rows of one doc_id are the same document and never copies of each other;
a row without a doc_id loses nothing and is no source; texts of under MIN_LENGTH bytes lose nothing; very long
texts are searched whole, by one task a text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.common import width, written

MIN_LENGTH = 50
#: Bytes of text that a task looks at together.
BATCH_BYTES = 4_000_000
#: Bytes of text that are hashed together, about.
LOOK_BYTES = 100_000
#: Symbols of a transform; runs of one anchor are never parted.
TEXT_SYMBOLS = 1_000_000
#: Distinct runs of an anchor in a batch, and by anchor, beyond which it is dealt by window.
HOT, SPLIT = 64, 10_000
#: Bytes of text a bucket, about; a session's shuffle partitions are the least number of buckets.
BUCKET_BYTES = 128_000_000

_B = 0x100000001B3
_A = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Polynomial hashes of all runs of n bytes, composed of runs whose lengths are powers of two."""

    def __init__(self, b: np.ndarray, longest: int):
        self.levels = [b.astype(np.uint64) + np.uint64(1)]
        size = 1
        while size * 2 <= min(longest, len(b)):
            h = self.levels[-1]
            self.levels.append(h[:-size] * np.uint64(pow(_B, size, 1 << 64)) + h[size:])
            size *= 2

    def of(self, n: int) -> np.ndarray:
        out, have = None, 0
        for k in reversed(range(len(self.levels))):
            if n >> k & 1:
                size, h = 1 << k, self.levels[k]
                if out is None:
                    out = h
                else:
                    m = len(self.levels[0]) - have - size + 1
                    out = out[:m] * np.uint64(pow(_B, size, 1 << 64)) + h[have : have + m]
                have += size
        return out


def runs(b: np.ndarray, ends: np.ndarray, length: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """First and last window of each run of windows with one anchor, the anchor's hash, the run's hash, and the text's number.

    ``b`` holds the bytes of many texts in turn, up to ``ends``; windows over an end do not count.
    """
    n = len(b) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64), z
    w = max(1, length * 23 // 50)  # anchors are places 0..w-1 of a window, k bytes long, and k is t + w
    t = max(1, length + 1 - 2 * w)
    k = length - w + 1
    h = Hashes(b, length)
    order = (_mixed(h.of(t)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(b) - t + 1, dtype=np.uint64)
    size, span = 1, length - t + 1
    while size < span:
        step = min(size, span - size)
        order = np.minimum(order[:-step], order[step:])
        size += step
    at = (order[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    window = np.arange(n)
    text = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    anchor = window + (at - window) % w
    same = (anchor[1:] == anchor[:-1]) & (text[1:n] == text[: n - 1])
    s = np.flatnonzero(np.r_[True, ~same])
    e = np.r_[s[1:] - 1, n - 1]
    owner = text[s]
    e = np.minimum(e, ends[owner] - length)
    ok = e >= s
    s, e, owner = s[ok], e[ok], owner[ok]
    key = _mixed(h.of(k)[anchor[s]])
    full = h.of(length)
    return s, e, key, _mixed(_mixed(full[s] + (e - s).astype(np.uint64)) * np.uint64(3) + full[e]), owner


def place(doc: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a document."""
    return ((doc ^ (doc >> 7) ^ (doc >> 17)) % n).astype(np.int32)


def _packed(bucket: np.ndarray, columns: dict[str, np.ndarray], **more) -> pd.DataFrame:
    """A row a bucket with the bucket's part of each column as bytes."""
    order = np.argsort(bucket, kind="stable")
    at = bucket[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
    cut = [slice(a, z) for a, z in zip(first, np.r_[first, len(at)][1:], strict=True)]
    return pd.DataFrame({"bucket": at[first].astype(np.int32), **{k: [(_counted if k == "docs" else np.ndarray.tobytes)(v[order][c]) for c in cut] for k, v in columns.items()}, **more})


def _counted(docs: np.ndarray) -> bytes:
    """Numbers in runs of equal ones, as the runs' values and lengths."""
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, int)
    return docs[first].tobytes() + np.diff(np.r_[first, len(docs)]).astype(np.uint32).tobytes()


def _uncounted(raw: bytes) -> np.ndarray:
    n = len(raw) // 12
    return np.repeat(np.frombuffer(raw[: 8 * n], np.int64), np.frombuffer(raw[8 * n :], np.uint32))


def _packed_docs(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket by document, ids, sizes, texts): documents of a batch and bucket, compressed together for the shuffle."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in it:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                held.append((int(doc), text.encode("utf-8", "replace")))
                size += len(held[-1][1])
                if size >= BATCH_BYTES:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    def send(held: list) -> pd.DataFrame:
        ids = np.array([d for d, _ in held], np.int64)
        at, pack = place(ids, buckets), zstandard.ZstdCompressor(3).compress
        by: dict[int, list[int]] = {}
        for i, b in enumerate(at.tolist()):
            by.setdefault(b, []).append(i)
        return pd.DataFrame([(b, ids[i].tobytes(), np.array([len(held[j][1]) for j in i], np.int64).tobytes(), pack(b"".join(held[j][1] for j in i))) for b, i in by.items()], columns=["bucket", "ids", "sizes", "texts"])

    return docs.select("doc_id", "text").mapInPandas(batches, "bucket int, ids binary, sizes binary, texts binary")


#: What becomes of a run in a document: it is lost, compared with the runs of its anchor, or compared window by window.
LOST, COMPARE, WINDOWS = 0, 1, 2


def _runs_by_anchor(docs: DataFrame, buckets: int, length: int, hot: int) -> DataFrame:
    """(bucket, docs, keys, hashes, fate): distinct runs with their least document, without a fate.

    Rows without keys are runs whose fate is known, on any bucket; rows of keys alone tell which anchors are hot.
    """

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, looked, turn, some = [], 0, 0, 0, []
        for pdf in it:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                some.append((doc, text.encode("utf-8", "replace")))
                size += len(some[-1][1])
                if size >= BATCH_BYTES or size - looked >= LOOK_BYTES:
                    held.append(look(some))
                    some, looked = [], size
                if size >= BATCH_BYTES:
                    yield from send(held, turn)
                    held, size, looked, turn = [], 0, 0, turn + 1
        if some:
            held.append(look(some))
        if held:
            yield from send(held, turn)

    def look(some: list) -> tuple:
        ids, ends = np.array([d for d, _ in some], np.int64), np.cumsum([len(x) for _, x in some])
        _, _, key, run, owner = runs(np.frombuffer(b"".join(x for _, x in some), np.uint8), ends, length)
        return ids[owner], key, run

    def send(held: list, turn: int) -> Iterator[pd.DataFrame]:
        doc, key, run = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, run))
        doc, key, run = doc[order], key[order], run[order]
        first = np.r_[True, run[1:] != run[:-1]] if len(run) else np.zeros(0, bool)
        least = doc[np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))] if len(run) else doc
        by = np.flatnonzero(first)[np.argsort(doc[first], kind="stable")]
        keys, which, n = np.unique(key[by], return_inverse=True, return_counts=True)
        keys, apart, by = keys[n > hot], by[n[which] > hot], by[n[which] <= hot]
        yield _packed(bucket_of(key[by]), {"docs": doc[by], "keys": key[by].astype(np.uint32), "hashes": run[by]}, fate=None)[columns]
        if len(keys):
            yield _packed(bucket_of(keys), {"keys": keys.astype(np.uint32)}, docs=b"", hashes=b"", fate=WINDOWS)[columns]
        for fate, some in ((LOST, np.flatnonzero(~first & (doc > least))), (WINDOWS, apart)):
            if len(some):
                some = some[np.argsort(doc[some], kind="stable")]
                d, r = doc[some], run[some]
                yield pd.DataFrame({"bucket": [int(d[0] + turn) % buckets], "docs": [_counted(d)], "keys": [b""], "hashes": [r.tobytes()], "fate": [fate]})

    def bucket_of(key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(32)) % np.uint64(buckets)

    columns = ["bucket", "docs", "keys", "hashes", "fate"]
    return docs.select("doc_id", "text").mapInPandas(batches, "bucket int, docs binary, keys binary, hashes binary, fate int")


def _marks(sent: DataFrame, buckets: int, split: int) -> DataFrame:
    """(bucket by document, docs, hashes, compare): runs that a document loses whole or must send, in one piece or by windows."""

    def by_anchor(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, keys, hashes, hot = [], [], [], [np.zeros(0, np.uint32)]
        for pdf in it:
            for d, k, h, fate in zip(pdf["docs"], pdf["keys"], pdf["hashes"], pdf["fate"], strict=True):
                if k and not d:
                    hot = [np.unique(np.concatenate([*hot, np.frombuffer(k, np.uint32)]))]
                    continue
                d, h = _uncounted(d), np.frombuffer(h, np.uint64)
                if k:
                    docs.append(d)
                    keys.append(np.frombuffer(k, np.uint32))
                    hashes.append(h)
                else:
                    yield _packed(place(d, buckets), {"docs": d, "hashes": h, "compare": np.full(len(d), fate, np.uint8)})
        if not docs:
            return
        doc, key, run = np.concatenate(docs), np.concatenate(keys), np.concatenate(hashes)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        # an anchor seen once needs nothing
        order = order[np.r_[False, same] | np.r_[same, False] | np.isin(key[order], hot[0])]
        order = order[np.lexsort((doc[order], run[order], key[order]))]
        doc, key, run = doc[order], key[order], run[order]
        if not len(doc):
            return
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_run = new_key | np.r_[True, run[1:] != run[:-1]]
        least = doc[np.maximum.accumulate(np.where(new_run, np.arange(len(doc)), 0))]
        group = np.cumsum(new_key) - 1
        distinct = np.bincount(group, new_run)[group]
        wide = (distinct > split) | np.isin(key, hot[0])
        lost = ~new_run & (doc > least)
        ask = new_run & ((distinct > 1) | wide)
        pick = np.flatnonzero(lost | ask)
        pick = pick[np.argsort(doc[pick], kind="stable")]
        yield _packed(place(doc[pick], buckets), {"docs": doc[pick], "hashes": run[pick], "compare": np.where(ask, np.where(wide, WINDOWS, COMPARE), LOST)[pick].astype(np.uint8)})

    dealt = sent.repartition(buckets, "bucket")
    return dealt.mapInPandas(by_anchor, "bucket int, docs binary, hashes binary, compare binary")


def _result(b: np.ndarray, gone: np.ndarray) -> tuple[int, int, str]:
    """Removed bytes, their maximal runs, and the hash of the rest."""
    edges = np.diff(np.r_[0, gone.astype(np.int8)])
    return int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(b[~gone].tobytes()).hexdigest()


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, ends, -1)
    return np.cumsum(mark[:-1]) > 0


def _together(docs: DataFrame, notes: DataFrame, buckets: int) -> DataFrame:
    """Packed documents of each bucket after the notes about them."""
    names = [f.name for f in notes.schema if f.name != "bucket"]
    none = lambda columns: [F.lit(None).cast("binary").alias(c) for c in columns]
    rows = _packed_docs(docs, buckets).select("bucket", F.lit(1).alias("kind"), "ids", "sizes", "texts", *none(names))
    rows = rows.union(notes.select("bucket", F.lit(0).alias("kind"), *none(["ids", "sizes", "texts"]), *names))
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")


def _open(row) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Ids, texts and ends of texts of a row of packed documents."""
    return np.frombuffer(row.ids, np.int64), zstandard.ZstdDecompressor().decompress(row.texts), np.cumsum(np.frombuffer(row.sizes, np.int64))


_HALFWAY = "kind int, bucket int, docs binary, uids binary, starts binary, ends binary, keys binary, texts binary"


def _uid(raw: bytes) -> int:
    """Tells rows of one doc_id apart."""
    return xxhash.xxh64_intdigest(raw) - (1 << 63)


def _later(doc: np.ndarray, size: np.ndarray, texts: np.ndarray, length: int) -> np.ndarray:
    """Pieces of one window whose bytes a smaller document has too."""
    one = np.flatnonzero(size == length)
    least: dict[bytes, int] = {}
    for d, t in zip(doc[one].tolist(), texts[one], strict=True):
        if d < least.get(t, d + 1):
            least[t] = d
    out = np.zeros(len(doc), bool)
    out[one] = doc[one] > np.array([least[t] for t in texts[one]], np.int64)
    return out


def _by_document(docs: DataFrame, marks: DataFrame, buckets: int, length: int) -> DataFrame:
    """Kind 0, by document: places that are lost. Kind 1, by anchor or window: runs to compare, with their bytes."""

    def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, notes, ready, lost, asked = None, [], None, [], []
        for pdf in it:
            for row in pdf.itertuples(index=False):
                if row.bucket != current:
                    current, notes, ready = row.bucket, [], None
                if row.kind == 0:
                    notes.append((_uncounted(row.docs), np.frombuffer(row.hashes, np.uint64), np.frombuffer(row.compare, np.uint8)))
                    continue
                if not notes and ready is None:
                    continue
                if ready is None:
                    d, h, c = (np.concatenate(x) for x in zip(*notes, strict=True))
                    d = _mixed(d.view(np.uint64)) ^ h  # a document and a run as one number
                    order = np.lexsort((c, d))
                    ready, notes = (d[order], c[order]), []
                look(*_open(row), ready, lost, asked)
            if sum(len(x[0]) for x in asked) > 50_000:
                yield from packed(lost, asked)
                lost, asked = [], []
        if lost or asked:
            yield from packed(lost, asked)

    def look(ids: np.ndarray, whole: bytes, ends: np.ndarray, ready: tuple, lost: list, asked: list) -> None:
        s, e, key, run, owner = runs(np.frombuffer(whole, np.uint8), ends, length)
        both = _mixed(ids.view(np.uint64))[owner] ^ run
        at = np.minimum(np.searchsorted(ready[0], both), len(ready[0]) - 1)
        hit = np.flatnonzero(ready[0][at] == both)
        if not len(hit):
            return
        s, e, key, owner, fate = s[hit], e[hit], key[hit], owner[hit], ready[1][at[hit]]
        gone, ask, wide = fate == LOST, fate == COMPARE, fate == WINDOWS
        begin = np.r_[0, ends[:-1]]
        uids = np.zeros(len(ids), np.int64)
        for i in np.unique(owner):
            uids[i] = _uid(whole[begin[i] : ends[i]])
        if gone.any():
            o, a, z = owner[gone], s[gone], e[gone] + length
            new = np.r_[True, (o[1:] != o[:-1]) | (a[1:] > np.maximum.accumulate(z)[:-1])]  # places that overlap are one
            last = np.r_[new[1:], True]
            f = o[new]
            lost.append((ids[f], uids[f], a[new] - begin[f], np.maximum.accumulate(z)[last] - begin[f]))
        if ask.any():
            o = owner[ask]
            asked.append((ids[o], uids[o], s[ask] - begin[o], e[ask] + length - begin[o], key[ask], [whole[a:z] for a, z in zip(s[ask], e[ask] + length, strict=True)]))
        if wide.any():
            n = e[wide] - s[wide] + 1
            o = np.repeat(owner[wide], n)
            a = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - s[wide], n)
            texts = [whole[x : x + length] for x in a.tolist()]
            asked.append((ids[o], uids[o], a - begin[o], a - begin[o] + length, np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64), texts))

    def packed(lost: list, asked: list) -> Iterator[pd.DataFrame]:
        if asked:
            doc, uid, a, z, key = (np.concatenate([x[i] for x in asked]) for i in range(5))
            texts = np.empty(len(doc), object)
            texts[:] = [t for x in asked for t in x[5]]
            later = _later(doc, z - a, texts, length)
            if later.any():
                lost.append((doc[later], uid[later], a[later], z[later]))
            doc, uid, a, z, key, texts = (x[~later] for x in (doc, uid, a, z, key, texts))
            bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            out = _packed(bucket, {"docs": doc, "uids": uid, "starts": a.astype(np.int32), "ends": z.astype(np.int32), "keys": key.astype(np.uint32)})
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
            yield out.assign(kind=np.int32(1), texts=[b"".join(texts[o]) for o in np.split(order, first[1:])])[_HALFWAY_COLUMNS]
        if lost:
            doc, uid, a, z = (np.concatenate(x) for x in zip(*lost, strict=True))
            out = _packed(place(doc, buckets), {"docs": doc, "uids": uid, "starts": a.astype(np.int32), "ends": z.astype(np.int32)})
            yield out.assign(kind=np.int32(0), keys=b"", texts=b"")[_HALFWAY_COLUMNS]

    return _together(docs, marks, buckets).mapInPandas(each, _HALFWAY)


_HALFWAY_COLUMNS = [c.split()[0] for c in _HALFWAY.split(", ")]


def bounded_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Places of a cyclic text in order of their next ``length`` symbols (under 512).

    Seven symbols make the first number to sort by; then places that are still equal are sorted by the ranks
    of what follows, twice as many symbols a round.
    """
    n, have = len(symbols), min(7, length)
    key = symbols.astype(np.int64)
    for i in range(1, have):
        key = key * 512 + np.roll(symbols, -i)
    order = np.argsort(key)
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    while have < length:
        rank = np.empty(n, np.int64)
        start = np.flatnonzero(new)
        sizes = np.diff(np.r_[start, n])
        rank[order] = np.repeat(start, sizes)
        open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
        step = min(have, length - have)
        places = order[open_]
        key = rank[places] * n + rank[(places + step) % n]
        by = np.argsort(key)
        order[open_] = places[by]
        key = key[by]
        fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        new[open_] |= fresh
        have += step
    return order


def equal_windows(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a cyclic text's places, and a class number by rank: places of one class share ``length`` symbols.

    Breadth-first backward extension: level by level, each interval of the order (the places of one string)
    is split by the symbol before; the parts are intervals of strings one longer, and lie together where the
    ranks step back. A right end met for the first time has a common prefix of the level less one, and only
    its interval is extended further.
    """
    n = len(symbols)
    order = bounded_order(symbols, length)
    before = symbols[(order - 1) % n]  # the transform
    source = np.argsort(before, kind="stable")  # the rank from which a rank is one step back
    back = np.empty(n, np.int64)
    back[source] = np.arange(n)
    prefix = np.full(n + 1, -1, np.int32)  # common prefix at the boundary before a rank; -1 not met
    label = np.zeros(n, np.int64)
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for level in range(1, length + 1):
        sizes = high - low
        which = np.repeat(np.arange(len(low)), sizes)
        rank = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]
        label[rank] = which
        if 3 * len(rank) > n:
            there = np.zeros(n, bool)
            there[back[rank]] = True
            to = np.flatnonzero(there)
        else:
            to = np.sort(back[rank])
        came = source[to]
        own, symbol = label[came], before[came]
        first = np.r_[True, (own[1:] != own[:-1]) | (symbol[1:] != symbol[:-1])]
        last = np.r_[first[1:], True]
        low, high = to[first], to[last] + 1
        new = prefix[high] < 0
        prefix[high[new]] = level - 1
        low, high = low[new], high[new]
        if not len(low):
            break
    return order, np.cumsum(np.r_[0, prefix[1:n] >= 0])


def _compared(halfway: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket by document, docs, uids, starts, ends): further places that are lost."""

    def by_anchor(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = (("docs", np.int64), ("uids", np.int64), ("keys", np.uint32), ("starts", np.int32), ("ends", np.int32))
        held: list[list] = [[] for _ in columns]
        texts: list[bytes] = []
        for pdf in it:
            for row in pdf.itertuples(index=False):
                for into, (name, kind) in zip(held, columns, strict=True):
                    into.append(_uncounted(row.docs) if name == "docs" else np.frombuffer(getattr(row, name), kind))
                whole, ends = bytes(row.texts), np.cumsum(held[4][-1] - held[3][-1])
                texts += [whole[a:z] for a, z in zip(np.r_[0, ends[:-1]], ends, strict=True)]
        if not texts:
            return
        doc, uid, key, start, end = (np.concatenate(x).astype(np.int64) for x in held)
        size, pieces = end - start, np.empty(len(texts), object)
        pieces[:] = texts
        later = _later(doc, size, pieces, length)
        if later.any():
            d = doc[later]
            yield _packed(place(d, buckets), {"docs": d, "uids": uid[later], "starts": start[later].astype(np.int32), "ends": end[later].astype(np.int32)})
            doc, uid, key, start, end, size, texts = (x[~later] for x in (doc, uid, key, start, end, size, pieces))
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order][1:] != key[order][:-1]]
        part = np.cumsum(size[order] + 1) // TEXT_SYMBOLS
        part = part[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]  # an anchor goes where its first run does
        for o in np.split(order, np.flatnonzero(np.diff(part)) + 1):
            yield compared(doc[o], uid[o], start[o], size[o], b"".join(texts[i] for i in o))

    def compared(doc: np.ndarray, uid: np.ndarray, start: np.ndarray, size: np.ndarray, text: bytes) -> pd.DataFrame:
        # one text: every run and a 0 after it; a byte b is the symbol b + 1
        at = np.r_[0, np.cumsum(size + 1)]
        symbols = np.zeros(at[-1], np.int16)
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        symbols[inside] = np.frombuffer(text, np.uint8).astype(np.int16) + 1
        order, group = equal_windows(symbols, length)
        owner = np.repeat(np.arange(len(size)), size + 1)
        offset = np.arange(at[-1]) - at[:-1][owner]
        whole = offset <= size[owner] - length
        by_rank, ok = owner[order], whole[order]
        least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group[ok], doc[by_rank[ok]])
        lost = ok & (doc[by_rank] > least[group])
        places = np.sort(order[lost])
        own = owner[places]
        new = np.r_[True, (own[1:] != own[:-1]) | (places[1:] != places[:-1] + 1)] if len(places) else np.zeros(0, bool)
        end = np.r_[new[1:], True] if len(places) else new
        o = own[new]
        begin, finish = start[o] + offset[places[new]], start[o] + offset[places[end]] + length
        return _packed(place(doc[o], buckets), {"docs": doc[o], "uids": uid[o], "starts": begin.astype(np.int32), "ends": finish.astype(np.int32)})

    part = halfway.where("kind = 1").select("bucket", "docs", "uids", "keys", "starts", "ends", "texts")
    return part.repartition(buckets, "bucket").mapInPandas(by_anchor, _PLACES)


_PLACES = "bucket int, docs binary, uids binary, starts binary, ends binary"


def dedup(docs: DataFrame, length: int = MIN_LENGTH, hot: int = HOT, split: int = SPLIT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(width(docs.sparkSession), -(-size // bucket_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = rows.where("doc_id is not null")
    marks = _marks(_runs_by_anchor(named, buckets, length, hot), buckets, split)
    halfway = written(_by_document(named, marks, buckets, length), "substrings")
    places = halfway.where("kind = 0").select("bucket", "docs", "uids", "starts", "ends").union(_compared(halfway, buckets, length))

    def finish(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, notes, ready = None, [], None
        for pdf in it:
            out = []
            for row in pdf.itertuples(index=False):
                if row.bucket != current:
                    current, notes, ready = row.bucket, [], None
                if row.kind == 0:
                    notes.append((_uncounted(row.docs), np.frombuffer(row.uids, np.int64), np.frombuffer(row.starts, np.int32), np.frombuffer(row.ends, np.int32)))
                    continue
                if ready is None:
                    ready = [np.concatenate(x) for x in zip(*notes, strict=True)] if notes else [np.zeros(0, np.int64)] * 4
                    order = np.argsort(ready[0], kind="stable")
                    ready, notes = [x[order] for x in ready], []
                ids, whole, ends = _open(row)
                for doc, a, z in zip(ids.tolist(), np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                    raw = whole[a:z]
                    i, j = np.searchsorted(ready[0], [doc, doc + 1])
                    mine = np.flatnonzero(ready[1][i:j] == _uid(raw)) + i if i < j else []
                    if len(mine):
                        out.append((doc, len(raw), *_result(np.frombuffer(raw, np.uint8), _covered(len(raw), ready[2][mine], ready[3][mine]))))
                    else:
                        out.append((doc, len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = _together(named, places, buckets).mapInPandas(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    nameless = rows.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.sha2(F.col("text").cast("binary"), 256))
    return done.union(nameless)
