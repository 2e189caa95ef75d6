"""Language identification by error-correcting output codes.

Each language gets a codeword of +1/-1 bits. One binary classifier a bit (logistic regression on
hashed byte n-grams) predicts that bit; a text's language is the codeword with the least weighted
logistic loss, where a bit weighs by how well it was predicted for that language in training. Texts
whose nearest codeword does not lead the second by LEAD are flagged as ambiguous.

Defined cases: null text or text without a letter gives ``und`` with score 0; an empty training set
gives ``und`` for every text; one language alone is given to every text that has a letter, score 1.
Repeated rows are judged one by one; rows with a null language never train. Whole texts count, however long.
Codewords equally near give the language that sorts first, flagged as ambiguous; an empty table gives no rows.
Columns of other names are not read; ``filter_known`` carries all of them on, whatever their names, and drops
null and letterless texts as well as ambiguous ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm._ids import mapped

UND = "und"
DIMS = 4096
#: At most so many labelled rows train the classifiers, over all languages.
MAX_SAMPLE = 6000
#: A text whose nearest codeword leads the second by less than LEAD, in mean loss a bit, is ambiguous; texts of under
#: FULL characters owe less in proportion. Clean texts of the tried tables lead by 0.67 or more (0.3 at four characters),
#: halves of two languages by 0.13 to 0.28 in the median, random letters by 0.4.
LEAD, FULL = 0.6, 100

_ROUNDS = 250
_CODE_TRIES = 200


def has_letter(text: str) -> bool:
    """Whether a text has a letter of any script; signs such as fractions and powers are none."""
    return any(map(str.isalpha, text))


def _byte_table() -> np.ndarray:
    """Lower-cased ASCII letters and all bytes over 127 stay; the rest is a space."""
    keep = np.full(256, 32, np.uint64)
    keep[128:] = np.arange(128, 256)
    keep[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return keep


def features(text: str, dims: int = DIMS) -> np.ndarray:
    """Square roots of the counts of hashed 1- to 4-grams of bytes, scaled to length 1."""
    b = _byte_table()[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)]
    b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]]
    parts, gram = [], np.zeros(len(b), np.uint64)
    for n in range(1, 5):
        if len(b) < n:
            break
        gram = gram[: len(b) - n + 1] * np.uint64(0x100000001B3) + b[n - 1 :] + np.uint64(n)
        mixed = (gram ^ (gram >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        parts.append((mixed >> np.uint64(40)) % np.uint64(dims))
    v = np.sqrt(np.bincount(np.concatenate(parts).astype(np.int64), minlength=dims)).astype(np.float32)
    return v / max(float(np.linalg.norm(v)), 1e-9)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1/-1: the exhaustive code up to 6 languages, else the best of random codes by distance."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 6:
        bits = np.array([[(c >> r) & 1 for c in range(2 ** (k - 1), 2**k - 1)] for r in range(k)])
        return (2 * bits - 1).astype(np.int8) if bits.size else np.array([[1], [-1]], np.int8)
    rng, length, best, kept = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), -1, None
    for _ in range(_CODE_TRIES):
        code = rng.choice(np.array([-1, 1], np.int8), (k, length))
        inner = code.astype(int) @ code.T
        least = ((length - inner) // 2 + np.eye(k, dtype=int) * length).min()
        if least > best and (np.abs(code.sum(0)) < k).all():
            best, kept = least, code
    return kept


class EcocModel:
    """Languages, codewords, a linear classifier a bit, and the weight of each bit for each language."""

    def __init__(self, langs: list[str], code: np.ndarray, w: np.ndarray, bias: np.ndarray, weights: np.ndarray):
        self.langs, self.code, self.w, self.bias, self.weights = langs, code, w, bias, weights

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str]) -> EcocModel:
        langs = sorted(set(y))
        code = codewords(len(langs))
        k, n_bits = code.shape
        w, bias = np.zeros((x.shape[1] if len(x) else DIMS, n_bits), np.float32), np.zeros(n_bits, np.float32)
        if k < 2:
            return cls(langs, code, w, bias, np.ones((k, n_bits)))
        at = {v: i for i, v in enumerate(langs)}
        rows = np.array([at[v] for v in y])
        target = code[rows].astype(np.float32)
        # languages count alike, however many rows each has
        share = (1.0 / np.bincount(rows)[rows] / k).astype(np.float32)[:, None]
        ahead, last, step = w.copy(), w.copy(), np.float32(8.0)
        for t in range(1, _ROUNDS + 1):
            g = -target * share / (1 + np.exp(np.clip(target * (x @ ahead + bias), -30, 30)))
            w = ahead - step * (x.T @ g + np.float32(1e-5) * ahead)
            bias = bias - g.sum(0)
            ahead, last = w + np.float32((t - 1) / (t + 2)) * (w - last), w
        right = (np.sign(x @ w + bias) == target).astype(float)
        hit = np.stack([right[rows == i].mean(0) for i in range(k)]) + 1e-3
        return cls(langs, code, w, bias, hit / hit.sum(1, keepdims=True))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the belief, and its lead over the second in mean loss a bit."""
        signed = self.code[None].astype(float) * margins[:, None, :]
        mean = (self.weights[None] * np.logaddexp(0, -signed)).sum(2)
        belief = np.exp((mean.min(1, keepdims=True) - mean) * self.code.shape[1])
        near = np.sort(mean, axis=1)
        lead = near[:, 1] - near[:, 0] if mean.shape[1] > 1 else np.full(len(mean), np.inf)
        return mean.argmin(1), (belief / belief.sum(1, keepdims=True)).max(1), lead

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in 0..1 and ambiguity of each text."""
        known = [i for i, t in enumerate(texts) if t and self.langs and has_letter(t)]
        out, score, unsure = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if known:
            margins = np.stack([features(texts[i], self.w.shape[0]) @ self.w for i in known]) + self.bias
            best, share, lead = self.decode(margins.astype(float))
            score[known], unsure[known] = share, lead < LEAD * np.minimum(1, np.array([len(texts[i]) for i in known]) / FULL)
            for i, b in zip(known, best, strict=True):
                out[i] = self.langs[b]
        return out, score, unsure


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_sample: int = MAX_SAMPLE) -> EcocModel:
    """Fits on at most ``max_sample`` rows of ``labelled`` (20 a language at least), dealt evenly to the languages.

    Of each language the rows of least hash of id and text are taken; repeated rows count once. Features are
    computed on the executors; the driver gets ``max_sample`` rows of ``DIMS`` half floats.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(key, text).alias("h")).where("t is not null and l is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return EcocModel.fit(np.zeros((0, DIMS), np.float32), [])
    each = max(20, max_sample // len(counts))
    # a hash cut somewhat too wide leaves a bounded number of distinct rows, of which the least are taken exactly
    cut = F.create_map(*[x for lng, n in counts.items() for x in (F.lit(lng), F.lit(int(min(1.0, 1.5 * each / max(n, 1)) * 2**31)))])
    drawn = F.pmod("h", F.lit(2**31))
    sample = rows.where(drawn < cut[F.col("l")]).dropDuplicates(["l", "h"])
    sample = sample.withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy(drawn, "h"))).where(F.col("rank") <= each)

    def vectors(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ok = pdf[[has_letter(t) for t in pdf["t"]]]
            yield pd.DataFrame({"l": ok["l"], "h": ok["h"], "v": [features(t).astype(np.float16).tobytes() for t in ok["t"]]})

    # rows come a partition at a time and are put in order where they lie, so that no second copy of them is held
    at: list[tuple[int, str]] = []
    x = np.empty((each * len(counts), DIMS), np.float32)
    for r in sample.select("t", "l", "h").coalesce(8).mapInPandas(vectors, "l string, h long, v binary").toLocalIterator():
        x[len(at)] = np.frombuffer(r["v"], np.float16)
        at.append((r["h"], r["l"]))
    x, order = x[: len(at)], sorted(range(len(at)), key=at.__getitem__)
    _permute(x, order)
    return EcocModel.fit(x, [at[i][1] for i in order])


def _permute(x: np.ndarray, order: list[int]) -> None:
    """Puts row ``order[i]`` of x at i, in place."""
    done = np.zeros(len(order), bool)
    for start in range(len(order)):
        if done[start]:
            continue
        first, i = x[start].copy(), start
        while order[i] != start:
            x[i], done[i] = x[order[i]], True
            i = order[i]
        x[i], done[i] = first, True


def identify(docs: DataFrame, model: EcocModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, ambiguous) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            lang, score, unsure = shared.value.predict([t if isinstance(t, str) else None for t in pdf["t"]])
            yield pd.DataFrame({"k": pdf["k"], "lang_pred": lang, "score": score, "ambiguous": unsure})

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return mapped(rows, judge, "lang_pred string, score double, ambiguous boolean", "k").withColumnRenamed("k", key)


def held_out(key: str = "doc_id"):
    """Rows that never train: crc32 of the id as text leaves 1 when divided by 3. A null id trains."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def filter_known(docs: DataFrame, model: EcocModel) -> DataFrame:
    """Rows of ``docs`` with a clear language, all columns as they were; ``und`` and ambiguous texts go.

    Judged inside one pass over the rows, so repeated or null ids need no join back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clear(t: pd.Series) -> pd.Series:
        lang, _, unsure = shared.value.predict([v if isinstance(v, str) else None for v in t])
        return pd.Series([x != UND and not u for x, u in zip(lang, unsure, strict=True)])

    return docs.where(clear("text"))
