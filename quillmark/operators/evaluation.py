"""Judge results: scores, reports, accuracies, costs, text metrics."""

from __future__ import annotations

import collections
import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text


def scores(results: DataFrame) -> DataFrame:
    """SF11: (file_name, question_id, metric, score) of readable numeric scores."""
    rows = results.select("file_name", "question_id", F.explode(text.judge_scores(F.col("evaluation_result"))).alias("metric", "value"))
    return rows.select("file_name", "question_id", "metric", F.col("value.Score").try_cast("double").alias("score")).where("score is not null")


def by_file(scored: DataFrame) -> DataFrame:
    """AG2: mean and population spread, the latter to 2 places."""
    return scored.groupBy("file_name", "metric").agg(F.avg("score").alias("mean"), F.round(F.stddev_pop("score"), 2).alias("std"), F.count("*").alias("n"))


def named(stats: DataFrame) -> DataFrame:
    """SF15-SF17 over file statistics."""
    part = text.model_and_annotation(text.display_name(F.col("file_name")))
    return stats.withColumns({"model": part.model, "annotation": part.annotation}).withColumn("category", text.category(F.col("model")))


def by_model(stats: DataFrame) -> DataFrame:
    """AG3, JN13: means of file means and of rounded spreads, in one aggregate."""
    return named(stats).groupBy("model", "annotation", "metric").agg(F.round(F.avg("mean"), 6).alias("mean"), F.round(F.avg("std"), 6).alias("std"))


def by_category(stats: DataFrame) -> DataFrame:
    """AG4."""
    return named(stats).groupBy("category", "annotation", "metric").agg(F.round(F.avg("mean"), 6).alias("mean"), F.round(F.avg("std"), 6).alias("std"))


def report(stats: DataFrame) -> DataFrame:
    """SK6's table: a row a model and annotation, a "mean ± std" column a metric."""
    cell = F.first(text.mean_and_spread(F.col("mean"), F.col("std")))
    wide = stats.groupBy("model", "annotation").pivot("metric", list(text.METRICS)).agg(cell)
    return wide.select("model", "annotation", *[F.coalesce(F.col(f"`{m}`"), F.lit("—")).alias(short) for m, short in text.METRICS.items()])


def accuracy(judged: DataFrame, group: list[str]) -> DataFrame:
    """AG5, AG6: (correct, invalid): percent of all and of valid answers; 0 where nothing is valid. An invalid answer counts once."""
    total, good, bad = F.count("*"), F.sum(F.col("correct").cast("long")), F.sum(F.col("invalid").cast("long"))
    clean = F.sum((F.col("correct") & ~F.col("invalid")).cast("long"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0)), 6)
    return judged.groupBy(*group).agg(
        total.alias("n"), good.alias("n_correct"), bad.alias("n_invalid"), share(good, total).alias("accuracy"), share(clean, total - bad).alias("clean_accuracy"), share(good, total - bad).alias("open_accuracy")
    )


def caption_score(rated: DataFrame, group: list[str]) -> DataFrame:
    """AG7, AG24, PF11: mean of ratings 0 to 100."""
    ok = F.when(F.col("rating").between(0, 100), F.col("rating"))
    return rated.groupBy(*group).agg(F.round(F.coalesce(F.avg(ok), F.lit(0.0)), 6).alias("mean_rating"), F.count(ok).alias("n_valid"), (F.count("*") - F.count(ok)).alias("n_invalid"))


def token_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """AG8: cost a model; prices are a short table a thousand tokens."""
    cost = F.col("prompt_tokens") * F.col("prompt_price") / 1000 + F.col("reply_tokens") * F.col("reply_price") / 1000
    return calls.join(prices, "model").groupBy("model").agg(F.round(F.sum(cost), 6).alias("cost"), F.count("*").alias("n_calls"))


def approximate_tokens(lines: DataFrame, group: str) -> DataFrame:
    """AG23: characters by four."""
    return lines.groupBy(group).agg(F.floor(F.sum(F.length("text")) / 4).cast("long").alias("tokens"))


def n_gram_metrics(pairs: DataFrame, key: str) -> DataFrame:
    """SF26, AG9: (key, bleu1..4, rouge1, rouge2) of (hypothesis, reference); an empty hypothesis reads as '##'.

    BLEU counts n-grams as often as they stand; ROUGE counts distinct ones, with full stops read as white space, and its
    F1 has 1e-8 in the denominator.

    Words are what stands between white space, as it is. A key's n-grams are counted where its texts are, so only texts are
    shuffled, once; rows of one key count together. An order without a match counts 0.1 (smoothing 1); without a common
    word BLEU is 0; BLEU-3 weighs its orders by 0.33 each. Keys without a word have no row. Embedding metrics are outside.
    """
    said = F.coalesce(F.nullif("hypothesis", F.lit("")), F.lit("##"))
    texts = pairs.select(key, said.alias("h"), F.col("reference").alias("r")).groupBy(key).agg(F.collect_list("h").alias("h"), F.collect_list("r").alias("r"))
    wide = texts.select(key, _matches("h", "r").alias("m")).select(key, "m.*").where("h1 + r1 > 0")
    short = F.when(F.col("h1") >= F.col("r1"), F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(F.col("r1").cast("double"), F.col("h1"))))
    out, logs = {}, F.lit(0.0)
    for n in (1, 2, 3, 4):
        logs = logs + F.log(F.when(F.col(f"hit{n}") > 0, F.col(f"hit{n}").cast("double")).otherwise(0.1) / F.greatest(f"h{n}", F.lit(1)))
        out[f"bleu{n}"] = F.when(F.col("hit1") == 0, F.lit(0.0)).otherwise(short * F.exp(logs * (0.33 if n == 3 else 1 / n)))
    share = lambda n, c: F.coalesce(F.try_divide(F.col(f"own_hit{n}").cast("double"), F.col(f"own_{c}{n}").cast("double")), F.lit(0.0))
    f1 = {f"rouge{n}": 2.0 * (share(n, "h") * share(n, "r")) / (share(n, "h") + share(n, "r") + 1e-8) for n in (1, 2)}
    return wide.withColumns(out | f1).select(key, *out, *f1)


#: Counts of n-grams: those in common, of the hypothesis and of the reference; ``own_`` of distinct ones, with full stops as white space.
_COUNTS = [f"{c}{n}" for n in (1, 2, 3, 4) for c in ("hit", "h", "r")] + [f"own_{c}{n}" for n in (1, 2) for c in ("hit", "h", "r")]


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS]))
def _matches(hypotheses: pd.Series, references: pd.Series) -> pd.DataFrame:
    grams = lambda words, n: zip(*[words[i:] for i in range(n)])

    def one(h: list[str], r: list[str]) -> list[int]:
        out: list[int] = []
        said, meant = ([re.findall(r"\S+", t, re.ASCII) for t in side] for side in (h, r))
        for n in (1, 2, 3, 4):
            x, y = (collections.Counter(itertools.chain.from_iterable(grams(w, n) for w in side)) for side in (said, meant))
            out += [sum(min(c, y[g]) for g, c in x.items() if g in y), x.total(), y.total()]
        said, meant = ([re.findall(r"[^\s.]+", t, re.ASCII) for t in side] for side in (h, r))
        for n in (1, 2):
            # each row's distinct n-grams count once
            x, y = (collections.Counter(itertools.chain.from_iterable(set(grams(w, n)) for w in side)) for side in (said, meant))
            out += [sum(min(c, y[g]) for g, c in x.items() if g in y), x.total(), y.total()]
        return out

    return pd.DataFrame([one(list(h), list(r)) for h, r in zip(hypotheses, references, strict=True)], columns=_COUNTS, dtype="int64")


def overall_scores(scored: DataFrame, metrics: tuple[str, ...] = ("bleu1", "bleu2", "bleu3", "bleu4", "rouge1", "rouge2")) -> DataFrame:
    """AG9: (metric, score): the mean of each metric over all rows times 100, with four decimals."""
    means = scored.agg(*[F.format_string("%.4f", F.avg(m) * 100).alias(m) for m in metrics])
    return means.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in metrics])).alias("s")).select("s.*")


def rouge_l(pairs: DataFrame, key: str) -> DataFrame:
    """SF26, AG9: (key, rouge_l) of (hypothesis, reference), by the longest common subsequence of words."""
    h = text.tokens(F.coalesce(F.nullif("hypothesis", F.lit("")), F.lit("##")))
    return pairs.select(key, _rouge_l(h, text.tokens(F.col("reference"))).alias("rouge_l"))


def text_metrics(pairs: DataFrame, key: str) -> DataFrame:
    """SF26, AG9: all of both."""
    return n_gram_metrics(pairs, key).join(rouge_l(pairs, key), key)


@F.pandas_udf(T.DoubleType())
def _rouge_l(h: pd.Series, r: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of words, by rows of bits."""

    def one(a: list[str], b: list[str]) -> float:
        where: dict[str, int] = {}
        for i, w in enumerate(a):
            where[w] = where.get(w, 0) | 1 << i
        row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
        for w in b:
            match = row & where.get(w, 0)
            row = ((row + match) | (row - match)) & full
        common = len(a) - bin(row).count("1")
        return 2.0 * common / max(len(a) + len(b), 1)

    return pd.Series([one(list(x), list(y)) for x, y in zip(h, r, strict=True)], dtype=float)


def meters(rows: DataFrame, group: list[str]) -> DataFrame:
    """AG12: (value, n): sums by the count, at least 1."""
    return rows.groupBy(*group).agg(F.round(F.sum("value") / F.greatest(F.lit(1), F.sum("n")), 6).alias("mean"))


def meter_key(key):
    """AG13: without "train/" or "eval/"; other slashes are underscores; ``train_critic/x`` is ``critic_x``."""
    return F.regexp_replace(F.regexp_replace(key, r"^(train|eval).", ""), "/", "_")


def meters_wide(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AG13, SK8: a row a step, a column a key in sorted order; keys unseen at a step are null."""
    mean = F.round(F.sum("value") / F.greatest(F.lit(1), F.sum("n")), 6)
    return rows.withColumn("key", meter_key(F.col("key"))).groupBy("step").pivot("key", sorted(keys)).agg(mean)


def stitch_layout(sizes: DataFrame, group: str) -> DataFrame:
    """AG20, AG21: (group, pos, w, h): grid, row and column sizes of the stitched image."""
    n = sizes.groupBy(group).agg(F.count("*").alias("n"), F.sum("w").alias("row_w"), F.max("h").alias("row_h"), F.max("w").alias("col_w"), F.sum("h").alias("col_h"))
    n = n.withColumn("cols", F.ceil(F.sqrt("n")).cast("long")).withColumn("rows", F.ceil(F.col("n") / F.col("cols")).cast("long"))
    cells = sizes.join(n, group).withColumns({"r": F.floor(F.col("pos") / F.col("cols")), "c": F.pmod("pos", "cols")})
    widths = cells.groupBy(group, "c").agg(F.max("w").alias("w")).groupBy(group).agg(F.sum("w").alias("grid_w"))
    heights = cells.groupBy(group, "r").agg(F.max("h").alias("h")).groupBy(group).agg(F.sum("h").alias("grid_h"))
    return n.join(widths, group).join(heights, group)


def with_truth(outputs: DataFrame, annotations: DataFrame) -> DataFrame:
    """JN16: (object_id, ground_truth, model_output): each output with the annotation of its object; every output must have one."""
    found = outputs.join(annotations.select("object_id", "ground_truth", F.lit(True).alias("known")), "object_id", "left")
    missing = F.assert_true(F.coalesce("known", F.lit(False)), F.concat(F.lit("no annotation of "), F.col("object_id").cast("string")))
    return found.select("object_id", "ground_truth", F.when(missing.isNull(), F.col("model_output")).alias("model_output"))
