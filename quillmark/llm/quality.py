"""Quality scores by a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles over the features (Lou, Caruana, Gehrke: one feature a tree), then
over the pairs whose quadrant split helps the residuals most. Every tree is folded into its feature's
lookup table, so a score is a sum of table cells: bin the features, add, squash.

Defined cases: null text scores like the empty text; texts of any length are read whole; without
labelled rows of both kinds every score is the share of label 1 (0.5 without labels). Repeated ids
train once a labelled row and are scored once a row. Labels of one id that differ all train; of splits that help alike
the first feature's is taken, and a score of exactly 0.5 is predicted 1. An empty table gives no rows. Columns of
other names are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm._ids import mapped

FEATURES = (
    "log_chars", "log_words", "word_len", "alpha", "digit", "punct", "symbol", "upper", "space", "high_bytes",
    "distinct_words", "distinct_lines", "line_len", "mark_words", "short_words", "run", "top_word", "capital_words",
)
#: At most so many labelled rows train the model.
MAX_SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8

# classes of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 sentence marks, 5 other symbols, 6 white space, 7 over 127
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 5
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 6
_CLASS[128:] = 7


def describe(text: str | None) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    b = np.frombuffer(raw, np.uint8)
    n = max(len(b), 1)
    kind = np.bincount(_CLASS[b], minlength=8) / n
    words = text.split()
    w = max(len(words), 1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    edge = np.flatnonzero(np.diff(b)) if len(b) > 1 else np.zeros(0, int)
    run = np.diff(np.r_[-1, edge, len(b) - 1]).max() if len(b) else 0
    marked = sum(not x[-1].isalnum() and x[-1] not in ".,;:?'\")" for x in words)
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / w, kind[1] + kind[2] + kind[7], kind[3], kind[4], kind[5],
        kind[2], kind[6], kind[7], len(counts) / w, len(set(lines)) / max(len(lines), 1), np.log1p(len(text) / max(len(lines), 1)),
        marked / w, sum(len(x) < 3 for x in words) / w, np.log1p(run), max(counts.values(), default=0) / w, sum(x[0].isupper() for x in words) / w,
    ]


class AdditiveModel:
    """An intercept, a table a feature and a table a chosen pair, over quantile bins."""

    def __init__(self, base: float, cuts: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]):
        self.base, self.cuts, self.tables, self.pairs = base, cuts, tables, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each row."""
        z = np.full(len(x), self.base)
        for j, (cut, tab) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += tab[np.searchsorted(cut, x[:, j])]
        for i, j, ci, cj, tab in self.pairs:
            z += tab[np.searchsorted(ci, x[:, i]), np.searchsorted(cj, x[:, j])]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of a run of bins with gradient sums g and weights h."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(cg):
        return 0.0, 0
    gain = cg**2 / (ch + 1) + (g.sum() - cg) ** 2 / (h.sum() - ch + 1) - g.sum() ** 2 / (h.sum() + 1)
    return float(gain.max()), int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Leaf values by bin of a greedy tree of at most ``leaves`` leaves over ordered bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        (gain, cut), (a, b) = max(((_best_cut(g[a:b], h[a:b]), (a, b)) for a, b in parts), key=lambda s: s[0][0])
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best pair of cuts over a grid of gradient sums."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    best, at = -1.0, (0, 0)
    q = lambda a, b: a**2 / (b + 1)
    aa, ah = cg[:-1, :-1], ch[:-1, :-1]
    ra, rh, ca, chh = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1]
    gain = q(aa, ah) + q(ra - aa, rh - ah) + q(ca - aa, chh - ah) + q(tg - ra - ca + aa, th - rh - chh + ah)
    if gain.size:
        at = np.unravel_index(gain.argmax(), gain.shape)
        best = float(gain[at] - q(tg, th))
    out = np.zeros_like(g)
    i, j = at[0] + 1, at[1] + 1
    for s in ((slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))):
        out[s] = g[s].sum() / (h[s].sum() + 1)
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.1) -> AdditiveModel:
    """Cyclic boosting of shallow trees, main effects first, then the best pairs."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base, k = float(np.log(share / (1 - share))), len(FEATURES)
    cuts = [_cuts(x[:, j], BINS) if len(x) else np.zeros(0) for j in range(k)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    if len(np.unique(y)) < 2:
        return AdditiveModel(base if len(y) else 0.0, cuts, tables, [])
    at = [np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]
    z = np.full(len(y), base)

    def sums(where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return np.bincount(where, y - p, size), np.bincount(where, p * (1 - p), size)

    for _ in range(rounds):
        for j in range(k):
            if len(tables[j]) > 1:
                step = rate * _tree(*sums(at[j], len(tables[j])))
                tables[j] += step
                z += step[at[j]]
    coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(k)]
    cell = [np.searchsorted(c, x[:, j]) for j, c in enumerate(coarse)]
    ranked = []
    for i, j in combinations(range(k), 2):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        if min(shape) > 1:
            g, h = (s.reshape(shape) for s in sums(cell[i] * shape[1] + cell[j], shape[0] * shape[1]))
            ranked.append((_quadrants(g, h)[0], i, j, shape))
    pairs = [(i, j, np.zeros(shape)) for _, i, j, shape in sorted(ranked, reverse=True)[:PAIRS]]
    for _ in range(pair_rounds):
        for i, j, tab in pairs:
            flat = cell[i] * tab.shape[1] + cell[j]
            g, h = (s.reshape(tab.shape) for s in sums(flat, tab.size))
            step = rate * _quadrants(g, h)[1]
            tab += step
            z += step.ravel()[flat]
    return AdditiveModel(base, cuts, tables, [(i, j, coarse[i], coarse[j], tab) for i, j, tab in pairs])


def train(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> AdditiveModel:
    """Fits on the ``max_sample`` labelled ids of least hash; features are computed on the executors.

    The sampled ids (at most ``max_sample`` rows of two numbers) are broadcast to one scan of the texts. Equal
    labels of an id count once; of an id with several texts the one of least hash is learnt from.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("k"), F.col("quality").cast("double").alias("y"))
        .where("k is not null and y is not null")
        .distinct()
        .orderBy(F.xxhash64("k"), "k", "y")
        .limit(max_sample)
    )

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"k": pdf["k"], "y": pdf["y"], "h": pdf["h"], "v": [describe(t if isinstance(t, str) else None) for t in pdf["t"]]})

    got = (
        docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t"), F.xxhash64("text").alias("h"))
        .join(F.broadcast(chosen), "k")
        .mapInPandas(rows, "k long, y double, h long, v array<double>")
        .groupBy("k", "y")
        .agg(F.min_by("v", "h").alias("v"))
        .toPandas()
    )
    got = got.assign(s=[tuple(v) for v in got["v"]]).sort_values(["k", "y", "s"])
    x = np.array(got["v"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, (got["y"].to_numpy(float) > 0).astype(float))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x = np.array([describe(t if isinstance(t, str) else None) for t in pdf["text"]], float).reshape(len(pdf), len(FEATURES))
            s = shared.value.score(x)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return mapped(docs.select("doc_id", "text"), judge, "score double, predicted int")
