"""Near-duplicates by SimHash and pigeonhole blocks.

A document's fingerprint has a bit set where over half the hashes of its word shingles have it. Two
fingerprints that differ in at most d bits agree in at least m-d of m blocks, so every choice of m-d
blocks is a join key; rows that share a key are verified by Hamming distance. m grows with the number of
distinct fingerprints (6 blocks give keys of 21 bits, 7 of 27, 8 of 32), so that a key is shared by few
unrelated rows at any size. Equal fingerprints are one node from the start.

Within a key, rows already reached from the key's pivot are not compared with each other again: links
are a tree, never all pairs. Keys with over SPLIT rows are dealt to pairs of salts.

``keep_one_alike`` goes by likeness, not by a few bits. Two sets of shingles of Jaccard likeness 0.8 differ in
15 % of all fingerprint bits, so that no split in which some blocks must agree has keys of use. Its
fingerprint is wide (WIDE words of 64 bits or more), each block is a key by itself, and there are as many
blocks as a pair of likeness LIKE needs to share one in all but MISS of cases; pairs nearer share more.
Rows of a key whose first words are not near go no further; the others get their wide fingerprints, whose
distance is a filter: it tells likeness to about 0.013 (one deviation), and pairs go on that are up to SLACK deviations
beyond what LIKE would give. Links are then verified by the true Jaccard likeness of the sets, taken from the texts of the
few documents that are in a pair, so nothing under LIKE is joined; a pair of LIKE itself is found in 97 of 100 cases
by design, nearer ones in more. Within a key, rows that are surely near form trees; beyond those only pairs
of different trees are looked at.
Blocks have as many bits as the number of documents needs, so their number, and with it the work a document,
grows as about the fourth root of that number.

Defined cases: null text and text without words have fingerprint zero and link like any other; shorter
texts than a shingle are one shingle; repeated rows are rows of their own; an empty table gives no rows;
texts of any length are read whole. Null ids are listed with the component that they reach; a component of
null ids only has a null id. Both ``keep_one`` functions keep every row without an id, take rows of equal id and text
for one row and rows of equal id and different texts for rows of their own; of equal ids the least hash of the
text stays. Other columns, whatever their names, are carried on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.common import release, unused, width, written
from quillmark.llm._graph import stars
from quillmark.llm._ids import mapped

BITS, WITHIN, SHINGLE, SEED = 64, 4, 4, 42
#: A key with more rows is dealt to pairs of salts.
SPLIT = 20_000


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the word shingles of one whole text, repeats included; none if it has no words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, k = b" ".join(words), min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a : b - 1], SEED) for a, b in zip([0, *ends[:-1]], ends[k - 1 :], strict=False)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one whole text."""
    h = shingle_hashes(text, shingle).astype(">u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, and the long columns ``more``) with the fingerprint as a signed 64-bit number."""

    def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            fp = np.array([fingerprint(t if isinstance(t, str) else None, shingle) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp.view(np.int64)} | {c: pdf[c] for c in more})

    return mapped(docs.select("doc_id", "text", *more), each, ", ".join(["fp long", *(f"{c} long" for c in more)]))


def block_masks(n_blocks: int, within: int = WITHIN) -> list[int]:
    """A mask for every choice of n_blocks - within blocks, as signed numbers."""
    edges = [round(i * BITS / n_blocks) for i in range(n_blocks + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    out = [sum(c) for c in combinations(blocks, n_blocks - within)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def n_blocks(rows: int, within: int = WITHIN) -> int:
    """The fewest blocks whose keys have more values than there are rows."""
    m = within + 2
    while BITS * (m - within) / m < np.log2(max(rows, 2)) + 1 and m < 2 * within + 4:
        m += 1
    return m


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, each a number or a row of them."""
    n = np.bitwise_count(a ^ b)
    return n if n.ndim == 1 else n.sum(1, dtype=np.int32)


def _tree(fp: np.ndarray, within: int) -> Iterator[tuple[int, np.ndarray]]:
    """Links that join what is within reach: each row is linked once, from the first row that reaches it."""
    left = np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = distances(fp[left], fp[at]) <= within
            if near.any():
                got = left[near]
                left = left[~near]
                queue.extend(got)
                yield at, got


def near_in_runs(key: np.ndarray, fp: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) that link what is within reach among rows of equal key; rows are in order of key. A fingerprint is a number or a row of them."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(key)])
    small = np.repeat((sizes > 1) & (sizes <= 8), sizes)
    a, b = [], []
    for d in range(1, min(8, len(key))):
        i = np.flatnonzero((key[:-d] == key[d:]) & small[:-d])
        i = i[distances(fp[i], fp[i + d]) <= within]
        a.append(i)
        b.append(i + d)
    for s, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
        for at, got in _tree(fp[s : s + n], within):
            a.append(np.full(len(got), s + at))
            b.append(s + got)
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return cat(a), cat(b)


def link_runs(key: np.ndarray, fp: np.ndarray, within: int = WITHIN) -> pd.DataFrame:
    """Links (a, b) between fingerprints of equal key."""
    i, j = near_in_runs(key, fp, within)
    return pd.DataFrame({"a": fp[i].view(np.int64), "b": fp[j].view(np.int64)})


def hot_keys(keyed: DataFrame, rows: int, split: int = SPLIT) -> DataFrame:
    """(key, n) of the keys of ``keyed`` with over ``split`` rows; ``rows`` is about its number of rows.

    Keys are nearly all different, so counting each would shuffle them all. Cells of keys are counted first,
    which combines map-side; only keys of a cell over the limit are then counted one by one. Both tables
    are written, so that Spark knows their size where it chooses how to join them.
    """
    cell = F.pmod(F.xxhash64("key"), F.lit(max(1, 8 * rows // split)))
    full = written(keyed.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > split).select("cell"), "simhash-cells")
    within = keyed.select("key", cell.alias("cell")).join(full, "cell", "left_semi")
    return written(within.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > split), "simhash-hot")


def links(nodes: DataFrame, within: int = WITHIN, split: int = SPLIT) -> DataFrame:
    """(a, b) between fingerprints of ``nodes`` (fp, distinct): joins all that are within reach, by way of others."""
    rows = nodes.count()
    masks = block_masks(n_blocks(rows, within), within)
    key = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]))
    keyed = nodes.select(key.alias("key"), "fp")
    hot = hot_keys(keyed, rows * len(masks), split)
    shared = keyed
    if not hot.isEmpty():
        # a key over the limit is dealt so that any two of its rows meet in a pair of salts
        salts = F.coalesce(F.ceil(F.col("n") / split), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("fp"), salts).cast("int")
        meets = F.explode(F.transform(F.sequence(F.lit(0), salts - 1), lambda t: F.struct(F.least(t, own).alias("x"), F.greatest(t, own).alias("y"))))
        shared = keyed.join(hot, "key", "left").select("key", "fp", meets.alias("m")).select(F.xxhash64("key", "m.x", "m.y").alias("key"), "fp")

    def verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for pdf in it:
            key = np.concatenate([key, pdf["key"].to_numpy(np.int64)])
            fp = np.concatenate([fp, pdf["fp"].to_numpy(np.int64).view(np.uint64)])
            whole = np.searchsorted(key, key[-1]) if len(key) else 0  # the last key may go on in the next batch
            yield link_runs(key[:whole], fp[:whole], within)
            key, fp = key[whole:], fp[whole:]
        yield link_runs(key, fp, within)

    return shared.repartition(width(nodes.sparkSession), "key").sortWithinPartitions("key").mapInPandas(verify, "a long, b long").distinct()


def rooted(fps: DataFrame, within: int = WITHIN) -> DataFrame:
    """(fp, least, root) of every fingerprint of ``fps``: its least id and its component."""
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    reached = stars(links(nodes.select("fp"), within))
    return nodes.join(reached, nodes["fp"] == reached["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, shingle: int = SHINGLE, within: int = WITHIN) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    fps = written(fingerprints(docs, shingle), "simhash")
    named = rooted(fps, within)
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(first, "root").select("fp", "component_id")
    # millions of rows may share a fingerprint: the join's hot keys are split by Spark
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, within: int = WITHIN) -> DataFrame:
    """``docs`` with the row of least id, then least text hash, of each component of fingerprints, all columns as they were."""
    (text_hash,) = unused(docs, "text_hash")
    rows = docs.where("doc_id is not null").withColumn(text_hash, F.xxhash64("text"))
    fps = written(fingerprints(rows, shingle, (text_hash,)).withColumnRenamed(text_hash, "text_hash"), "simhash")
    best = fps.join(rooted(fps, within), "fp").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    return _only(docs, rows, best, text_hash)


def _only(docs: DataFrame, rows: DataFrame, best: DataFrame, text_hash: str) -> DataFrame:
    """One row of ``rows`` for each of ``best`` (least: doc_id and text_hash), and the rows of ``docs`` without an id."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    (rank,) = unused(rows, "rank")
    best = best.select(F.col("least.doc_id").alias("doc_id"), F.col("least.text_hash").alias(text_hash))
    number = F.row_number().over(Window.partitionBy("doc_id", text_hash).orderBy(F.lit(0)))
    kept = rows.join(best, ["doc_id", text_hash], "left_semi").withColumn(rank, number).where(F.col(rank) == 1)
    return kept.select(*columns).unionByName(docs.where("doc_id is null"))


#: Words of a shingle and least likeness of near copies; words of the wide fingerprint, at least; the share of pairs of
#: likeness LIKE that may share no block; bits of a block, at least.
NEAR_SHINGLE, LIKE, WIDE, MISS, BLOCK = 5, 0.8, 16, 0.02, 18
#: Blocks that are looked at first: what they join is not linked again by the others.
FIRST = 8
#: Bits by which the first word of wide fingerprints may differ, for a link to be looked at further.
NARROW = 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Hashes of words that were met; forgets them all when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_set(text: str | None, words: Words) -> np.ndarray:
    """The distinct hashes of the NEAR_SHINGLE-word shingles of a whole text, in order; of all its words if they are fewer."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    h = np.array([words[w] for w in found], np.uint64)
    k = min(NEAR_SHINGLE, len(h))
    out = np.full(len(h) - k + 1 if k else 0, k, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(32))) * _GOLD + h[i : i + len(out)]
    return np.unique((out ^ (out >> np.uint64(29))) * _GOLD)


def differing(like: float = LIKE) -> float:
    """The expected share of differing bits of two sets of one size and this Jaccard likeness."""
    return float(np.arccos(2 * like / (1 + like)) / np.pi)


#: Deviations by which a distance may be over what LIKE gives for a pair to be verified, and must be under it for one to be surely near.
SLACK = 2.5
#: Cells of text hashes by which texts of pairs are told from others: at most so many small rows are broadcast.
CELLS = 1 << 18


def wide_bound(n_words: int, like: float = LIKE, deviations: float = SLACK) -> int:
    """Differing bits that wide fingerprints have at ``like``, and so many deviations more."""
    n, p = 64 * n_words, differing(like)
    return int(n * p + deviations * np.sqrt(n * p * (1 - p)))


def candidates_in_runs(key: np.ndarray, fp: np.ndarray, sure: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of equal key (in order of key) that may be near: all pairs within ``bound`` in short runs.

    In longer runs a tree of what is within ``sure``, and pairs within ``bound`` of rows of different trees.
    """
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(key)])
    i, j = near_in_runs(key, fp, sure)
    a, b = [i], [j]
    tree = joined(len(key), i, j)
    for s, n in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
        mine = tree[s : s + n]
        if (mine == mine[0]).all():
            continue
        for at in range(n - 1):
            later = np.flatnonzero(mine[at + 1 :] != mine[at]) + at + 1
            got = later[distances(fp[s + later], fp[s + at]) <= bound]
            a.append(np.full(len(got), s + at))
            b.append(s + got)
    return np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)


def block_plan(rows: int, like: float = LIKE, miss: float = MISS) -> tuple[int, int, int]:
    """Bits of a block, number of blocks, and words of a fingerprint for so many documents."""
    bits = max(BLOCK, int(np.ceil(np.log2(max(rows, 2)))))
    n = int(np.ceil(np.log(miss) / np.log1p(-((1 - differing(like)) ** bits))))
    return bits, n, max(WIDE, -(-bits * n // 64))


def _lanes(n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands that make a word of a fingerprint's random bits of each hash."""
    rng = np.random.default_rng(SEED)
    drawn = rng.integers(0, 1 << 63, (n_words, 2), np.uint64)
    return drawn[:, 0] * np.uint64(2) + np.uint64(1), drawn[:, 1]


def wide_fingerprint(hashes: np.ndarray, factors: np.ndarray, summands: np.ndarray) -> np.ndarray:
    """The words of the SimHash of a set of hashes: bits that over half of them have, each hash giving 64 bits a word.

    Bits are counted all at once: full adders fold rows of words into one row a binary digit of the counts.
    """
    digits, carried = [], np.zeros((0, len(factors)), np.uint64)
    half = len(hashes) // 2
    n = max(1, len(hashes).bit_length())
    pending: list[list[np.ndarray]] = [[] for _ in range(n + 1)]
    for at in range(0, len(hashes), 1 << 12):
        m = hashes[at : at + (1 << 12), None] * factors + summands
        m = (m ^ (m >> np.uint64(32))) * _GOLD
        pending[0].append(m ^ (m >> np.uint64(29)))
    for digit in range(n):
        rows = np.concatenate(pending[digit]) if pending[digit] else carried
        while len(rows) > 1:
            if len(rows) == 2:
                pending[digit + 1].append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
                continue
            t = len(rows) // 3
            a, b, c = rows[:t], rows[t : 2 * t], rows[2 * t : 3 * t]
            u = a ^ b
            pending[digit + 1].append((a & b) | (u & c))
            rows = np.concatenate([u ^ c, rows[3 * t :]])
        digits.append(rows[0] if len(rows) else np.zeros(len(factors), np.uint64))
    more, same = np.zeros(len(factors), np.uint64), np.full(len(factors), ~np.uint64(0))
    for digit in reversed(range(n)):
        if half >> digit & 1:
            same &= digits[digit]
        else:
            more |= same & digits[digit]
            same &= ~digits[digit]
    return more


def block_keys(fps: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The n keys of each fingerprint (rows of words): number of the block and its bits."""
    each = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")[:, : bits * n].reshape(len(fps), n, bits)
    value = each.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
    return (np.arange(n, dtype=np.int64) << bits) | value


def _wide_rows(rows: DataFrame, text_hash: str, n_words: int) -> DataFrame:
    """(doc_id, text_hash, node, wide) of every row; a node is a set of shingles."""
    factors, summands = _lanes(n_words)

    def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in it:
            sets = [shingle_set(t if isinstance(t, str) else None, words) for t in pdf["text"]]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_hash": pdf["text_hash"], "node": node, "wide": [wide_fingerprint(s, factors, summands).tobytes() for s in sets]})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", F.col(text_hash).alias("text_hash"), "text").mapInPandas(each, f"doc_id {kind}, text_hash long, node long, wide binary")


def _keyed_nodes(signed: DataFrame, bits: int, n: int) -> DataFrame:
    """(node, doc_id, text_hash, wide, narrow, keys): a row a set of shingles, with its least document and its block keys."""
    kind = signed.schema["doc_id"].dataType.simpleString()

    def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            fps = np.frombuffer(b"".join(pdf["wide"]), np.uint64).reshape(len(pdf), -1)
            yield pdf.assign(narrow=fps[:, 0].view(np.int64) if len(pdf) else np.zeros(0, np.int64), keys=list(block_keys(fps, bits, n)) if len(pdf) else [])

    least = signed.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("wide").alias("wide"))
    return least.select("node", "least.*", "wide").mapInPandas(each, f"node long, doc_id {kind}, text_hash long, wide binary, narrow long, keys array<long>")


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that the links (i, j) join it to."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        if (low == label[i]).all() and (low == label[j]).all():
            break
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
    while (label[label] != label).any():
        label = label[label]
    return label


def _streamed(rows: DataFrame, columns: dict[str, object], of, schema: str) -> DataFrame:
    """``of`` over arrays of the named columns of ``rows``, whole keys at a time; ``columns`` gives what opens each column."""

    def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in it:
            if not len(pdf):
                continue
            new = [opened(pdf[c]) for c, opened in columns.items()]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            whole = np.searchsorted(held[0], held[0][-1])  # the last key may go on in the next batch
            if whole:
                yield of(*(h[:whole] for h in held))
                held = [h[whole:] for h in held]
        if held is not None:
            yield of(*held)

    return rows.repartition(width(rows.sparkSession), "key").sortWithinPartitions("key", "node").mapInPandas(each, schema)


def _long(s: pd.Series) -> np.ndarray:
    return s.to_numpy(np.int64)


def _words_of(s: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(s), np.uint64).reshape(len(s), -1)


def _links(keyed: DataFrame, nodes: DataFrame, rows: int, sure: int, bound: int, split: int) -> DataFrame:
    """(a, b), as a written table: nodes that may be near of ``keyed`` (key, node, root, narrow) that share a key, joined by a tree a key.

    First the rows of a key that may be near another of a different root are found by their narrow words; only
    those get wide fingerprints. Rows of a key over ``split`` are held against one node of the key and dealt to pairs of
    salts, so that every two of them meet in one.
    """
    hot = hot_keys(keyed, rows, split)
    direct = None
    if not hot.isEmpty():
        marked = keyed.join(hot, "key", "left")
        pivots = marked.where("n is not null").groupBy("key").agg(F.min(F.struct("node", "root", "narrow")).alias("p"))
        near = F.bit_count(F.col("narrow").bitwiseXOR(F.col("p.narrow"))) <= NARROW
        pairs = marked.where("n is not null").join(pivots, "key").where(near & (F.col("root") != F.col("p.root"))).select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct()
        one, other = (nodes.select(F.col("node").alias(n), F.col("wide").alias(w)) for n, w in (("a", "x"), ("b", "y")))

        @F.pandas_udf("boolean")
        def close(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(distances(_words_of(x), _words_of(y)) <= bound) if len(x) else pd.Series([], dtype=bool)

        direct = pairs.join(one, "a").join(other, "b").where(close("x", "y")).select("a", "b")
        # any two rows of a key over the limit meet in a pair of salts
        salts = F.coalesce(F.ceil(F.col("n") / split), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("node", "key"), salts).cast("int")
        meets = F.explode(F.transform(F.sequence(F.lit(0), salts - 1), lambda t: F.struct(F.least(t, own).alias("x"), F.greatest(t, own).alias("y"))))
        keyed = marked.withColumn("m", meets).select(F.xxhash64("key", "m.x", "m.y").alias("key"), "node", "root", "narrow")

    def active(key: np.ndarray, node: np.ndarray, root: np.ndarray, narrow: np.ndarray) -> pd.DataFrame:
        label = joined(len(key), *near_in_runs(key, narrow.view(np.uint64), NARROW))
        low, high = root.copy(), root.copy()
        np.minimum.at(low, label, root)
        np.maximum.at(high, label, root)
        at = np.flatnonzero(low[label] != high[label])
        return pd.DataFrame({"key": key[at], "node": node[at]})

    def linked(key: np.ndarray, node: np.ndarray, wide: np.ndarray) -> pd.DataFrame:
        i, j = candidates_in_runs(key, wide, sure, bound)
        return pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])}).drop_duplicates()

    may = _streamed(keyed, {"key": _long, "node": _long, "root": _long, "narrow": _long}, active, "key long, node long")
    found = _streamed(may.join(nodes.select("node", "wide"), "node"), {"key": _long, "node": _long, "wide": _words_of}, linked, "a long, b long")
    return written((found if direct is None else found.union(direct)).distinct(), "near-links")


def _sets(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes of ``pairs``, from the texts (doc_id, text_hash, text) of their least documents, as a written table.

    Texts of other documents are left out before the shuffle by cells of their hash.
    """
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id", "text_hash"), "node"), "near-wanted")
    cell = F.pmod(F.col("text_hash"), F.lit(CELLS))
    held = texts.withColumn("cell", cell).join(F.broadcast(wanted.select(cell.alias("cell")).distinct()), "cell", "left_semi").drop("cell")

    def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in it:
            yield pd.DataFrame({"node": pdf["node"], "shingles": [shingle_set(t if isinstance(t, str) else None, words).tobytes() for t in pdf["text"]]})

    found = held.join(wanted, ["doc_id", "text_hash"]).select("node", "text").mapInPandas(each, "node long, shingles binary")
    out = written(found.groupBy("node").agg(F.first("shingles").alias("shingles")), "near-sets")  # equal rows have equal sets
    release(wanted)
    return out


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, like: float = LIKE) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have this Jaccard likeness or more, as a written table."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(both >= like * (len(s) + len(t) - both))
        return pd.Series(out, dtype=bool)

    sets = _sets(pairs, nodes, texts)
    one, other = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    out = written(pairs.join(one, "a").join(other, "b").where(alike("x", "y")).select("a", "b"), "near-pairs")
    release(sets, pairs)
    return out


def near_roots(nodes: DataFrame, texts: DataFrame, plan: tuple[int, int, int], split: int = SPLIT) -> DataFrame:
    """(node, root) of the nodes of ``nodes`` that are joined to a lesser one; ``texts`` (doc_id, text_hash, text) verify the links."""
    _, n_blocks, n_words = plan
    n, sure, bound = nodes.count(), wide_bound(n_words, deviations=-SLACK), wide_bound(n_words)
    cut = F.posexplode("keys").alias("block", "key")
    first = nodes.select("node", "narrow", cut).where(F.col("block") < FIRST).select("key", "node", F.col("node").alias("root"), "narrow")
    known = stars(_verified(_links(first, nodes, n * FIRST, sure, bound, split), nodes, texts))
    rooted = nodes.select("node", "narrow", "keys").join(known, "node", "left").select("node", "narrow", F.coalesce("root", "node").alias("root"), cut)
    rest = rooted.where(F.col("block") >= FIRST).select("key", "node", "root", "narrow")
    # a component is joined to its root by the first links, so that the roots and the other links tell all of them
    more = _verified(_links(rest, nodes, n * (n_blocks - FIRST), sure, bound, split), nodes, texts)
    return stars(more.union(known.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def keep_one_alike(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of least id and then least text hash, all columns as they were."""
    (text_hash,) = unused(docs, "text_hash")
    rows = docs.where("doc_id is not null").withColumn(text_hash, F.xxhash64("text"))
    bits, blocks, n_words = plan = block_plan(rows.count())
    signed = written(_wide_rows(rows, text_hash, n_words), "near-rows")
    nodes = written(_keyed_nodes(signed, bits, blocks), "near-nodes")
    release(signed)
    texts = rows.select("doc_id", F.col(text_hash).alias("text_hash"), "text")
    rooted_ = nodes.select("node", "doc_id", "text_hash").join(near_roots(nodes, texts, plan, split), "node", "left")
    best = rooted_.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    return _only(docs, rows, best, text_hash)
