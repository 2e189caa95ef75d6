"""URL filtering: host and path rules first, then a logistic regression on hashed character n-grams.

The regression is fitted on a small labelled table of urls (the driver holds it whole; ``train`` refuses
over MAX_LABELLED rows) and applied to every url by a pandas function that adds up weights.

The built-in table is general vocabulary. New urls of its words are told apart well; words that it lacks are
mostly allowed, unwanted ones too, as letters alone don't tell meaning (the README has both figures). Users
with labelled urls of their own train on those.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule, and the verdict of
the regression on empty strings; urls of any length are read whole; rows without a page_id are judged like others;
repeated rows are judged one by one; rules of equal length fit in the order given, the last wins; an empty table
gives no rows. Columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS, MAX_LABELLED = 1 << 14, 100_000
#: The share of unwanted urls that the regression assumes, whatever the share in its table: unknown words are allowed.
PRIOR = 0.2

#: The rules of the contract as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: General words of unwanted sites by subject (gambling, medicine, adult, money, goods, piracy, fraud, junk), and of
#: ordinary ones; the labelled table is made of these.
UNWANTED = (
    "gambling", "poker", "roulette", "blackjack", "slots", "jackpot", "betting", "bookmaker", "wager", "bingo", "lottery", "baccarat",
    "tablets", "viagra", "cialis", "pharmacy", "steroids", "slimming", "miracle", "bargain", "discount", "tramadol", "supplements", "antibiotics",
    "porn", "explicit", "escort", "nude", "erotic", "fetish", "webcam", "dating", "hookup", "swingers", "lingerie", "hardcore",
    "loans", "payday", "forex", "millionaire", "jackpots", "bitcoin", "doubler", "debt", "profits", "refinance", "earnings", "cashback",
    "replica", "rolex", "handbags", "knockoff", "outlet", "giveaway", "gifts", "voucher", "prizes", "sweepstakes", "coupons", "raffle",
    "warez", "torrent", "cracked", "keygen", "pirated", "streams", "serials", "nulled", "leaked", "bootleg", "unlocker", "cheats",
    "phishing", "malware", "spyware", "ransom", "hijack", "verify", "suspended", "unlock", "botnet", "exploit", "stealer", "trojan",
    "junkmail", "clickbait", "popup", "adware", "profiling", "banner", "advertising", "redirect", "doorway", "backlinks", "linkswap", "affiliate",
)
ORDINARY = (
    "news", "weather", "library", "museum", "science", "history", "garden", "recipes", "travel", "music", "theatre", "school",
    "university", "research", "health", "hospital", "council", "parliament", "railway", "airport", "books", "journal", "archive", "maps",
    "photos", "forum", "wiki", "code", "docs", "support", "market", "energy", "dairy", "ocean", "mountain", "river",
    "kitchen", "bakery", "football", "cycling", "marathon", "orchestra", "festival", "gallery", "painting", "poetry", "grammar", "dictionary",
    "physics", "chemistry", "biology", "geology", "astronomy", "algebra", "geometry", "statistics", "engineering", "robotics", "software", "database",
    "insurance", "carpentry", "plumbing", "furniture", "architecture", "housing", "transport", "bridge", "harbour", "lighthouse", "aviation", "ferry",
    "forest", "wildlife", "birds", "fishing", "orchard", "vineyard", "village", "castle", "cathedral", "monastery", "heritage", "folklore",
    "children", "parents", "teacher", "student", "nursing", "dentist", "veterinary", "charity", "volunteer", "citizen", "election", "justice",
)
_PATHS = ("/", "/{a}", "/{a}/{n}", "/en/{n}", "/de/{n}/", "/{a}-{b}.html", "/{n}/{a}/{b}", "/category/{a}/page/{n}", "/index.php", "/es/{a}", "/fr/{n}.html", "/2019/05/{a}-{b}")
_TOPS = ("com", "net", "org", "example.com", "example.net", "example.org", "info", "co.uk", "de", "fr", "es", "io")


def labelled_urls(unwanted: Sequence[str] = UNWANTED, ordinary: Sequence[str] = ORDINARY) -> list[tuple[str, int]]:
    """The built-in table: (url, 1 for unwanted), made of words by rule. Each word stands in three hosts, alone and with another
    of its kind; tops, subdomains and path shapes are dealt alike to both kinds, so that only the words tell them apart."""
    out = [("", 0), ("no address", 0)]
    for label, words in ((1, unwanted), (0, ordinary)):
        for i, w in enumerate(words):
            for j, name in enumerate((w, f"{w}-{words[(7 * i + 3) % len(words)]}", f"{words[(11 * i + 5) % len(words)]}{w}")):
                k = 3 * i + j
                sub, top, shape = ("", "www.", "m.", "blog.", "shop.")[k % 5], _TOPS[k % len(_TOPS)], _PATHS[(k // 2) % len(_PATHS)]
                at = shape.format(a=words[(5 * i + j) % len(words)], b=words[(3 * i + 2 * j) % len(words)], n=1000 + 37 * k)
                out.append((f"{'https' if k % 2 else 'http'}://{sub}{name}.{top}{at}", label))
    return out


def host(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str = "url") -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _index(at_host: str, at_path: str) -> np.ndarray:
    """Places of the 3- to 5-grams of host and path; the two never share a gram."""
    out = []
    for salt, s in ((1, f"^{at_host}$"), (2, f"^{at_path}$")):
        b = np.frombuffer(s.encode("utf-8", "replace"), np.uint8).astype(np.uint64)
        gram = np.full(len(b), salt, np.uint64)
        for n in range(1, 6):
            if len(b) < n:
                break
            gram = gram[: len(b) - n + 1] * np.uint64(0x100000001B3) + b[n - 1 :]
            if n >= 3:
                out.append(((gram ^ (gram >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, np.int64)


class UrlModel:
    """Weights of a logistic regression over hashed n-grams."""

    def __init__(self, w: np.ndarray, bias: float):
        self.w, self.bias = w, bias

    def score(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """Chance that each url is unwanted."""
        ix = [_index(h, p) for h, p in zip(hosts, paths, strict=True)]
        z = np.array([self.w[i].sum() / np.sqrt(max(len(i), 1)) for i in ix]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(table: DataFrame | None, spark=None, rounds: int = 800, prior: float = PRIOR) -> UrlModel:
    """Fits on ``table`` (url, label), or on the built-in one, which takes the same way through Spark."""
    table = table if table is not None else spark.createDataFrame(labelled_urls(), "url string, label int")
    rows = table.where("label is not null").select(host().alias("h"), path().alias("p"), F.col("label").cast("int").alias("y")).limit(MAX_LABELLED + 1).toPandas()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table has over {MAX_LABELLED} rows; this operator learns from a small one")
    rows = rows.sort_values(["h", "p", "y"])
    return fit(list(rows["h"]), list(rows["p"]), rows["y"].to_numpy(float), rounds, prior)


def fit(hosts: Sequence[str], paths: Sequence[str], y: np.ndarray, rounds: int = 800, prior: float = PRIOR) -> UrlModel:
    """The regression by gradient descent; both kinds weigh as ``prior`` has it."""
    w, bias = np.zeros(DIMS), 0.0
    ix = [_index(h, p) for h, p in zip(hosts, paths, strict=True)]
    if len(np.unique(y)) < 2:
        return UrlModel(w, 5.0 if len(y) and y[0] else -5.0)
    flat, row = np.concatenate(ix), np.repeat(np.arange(len(ix)), [len(i) for i in ix])
    scale = (1 / np.sqrt([max(len(i), 1) for i in ix]))[row]
    share = np.where(y > 0, prior / (y > 0).sum(), (1 - prior) / (y <= 0).sum())
    for _ in range(rounds):
        z = np.bincount(row, w[flat] * scale, len(ix)) + bias
        g = (1 / (1 + np.exp(-z)) - (y > 0)) * share
        w -= 16.0 * (np.bincount(flat, g[row] * scale, DIMS) + 2e-4 * w)
        bias -= 2.0 * g.sum()
    return UrlModel(w, bias)


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the longest fitting rule's verdict, else the regression's."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def unwanted(h: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(h, p))

    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, at, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith(start)
        rule, by_rule = F.when(fits, F.lit(at + start)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(by_rule)
    split = pages.select("page_id", host().alias("host"), path().alias("path")).withColumn("score", unwanted("host", "path"))
    verdict = F.coalesce(by_rule, F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")
