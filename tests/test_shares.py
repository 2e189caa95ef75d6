"""A share of crossed bins is that of the ranked list of all pairs, of which only few get a rank."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.operators import pairs, shares

ROWS = [(i * 37, i * 7 % 4 if i < 280 else 8) for i in range(300)]
COPIES = ROWS + [(37, 1), (0, 0), (0, 0), (None, 2), (9, None)] + [(11, 8)] * 40


def counted(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize(("rows", "ratio", "deviations"), [(ROWS, 0.4, 5.0), (ROWS, 0.4, 0.01), (COPIES, 0.4, 5.0), (COPIES, 0.4, 0.01), (ROWS, 0.0, 5.0), (ROWS, 1.0, 5.0), (COPIES, 0.003, 5.0)])
def test_share_is_that_of_the_list(spark, monkeypatch, rows, ratio, deviations):
    """Several blocks, uneven bins, an id in two bins or many times in one, nulls; and ranges of digests that miss the end."""
    monkeypatch.setattr(shares, "BLOCK_ROWS", 32)
    monkeypatch.setattr(shares, "DEVIATIONS", deviations)
    s = spark.createDataFrame(rows, "sample_id long, bin_id int")
    assert counted(pairs.crossed_sample(s, ratio, 42)) == counted(pairs.ratio_sample(pairs.cross_bin(s), ratio, 42))


@pytest.mark.parametrize("rows", [ROWS, COPIES])
def test_share_and_near_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(shares, "BLOCK_ROWS", 32)
    s = spark.createDataFrame(rows, "sample_id long, bin_id int")
    one = pairs.tagged(pairs.ratio_sample(pairs.cross_bin(s), 0.4, 42), "cross_bin", 1)
    two = pairs.tagged(pairs.neighbor_bin(s).select(F.col("b").alias("a"), F.col("a").alias("b")), "neighbor_bin", 2)
    assert counted(pairs.sampled_or_near(s, 0.4, 42)) == counted(pairs.first_strategy(one.unionByName(two)).select("a", "b", "tag"))


def test_few_pairs_are_ranked(spark):
    """Digests are made as matrices, twice, and few pairs get a rank; before, every pair was a row with a digest three times."""
    s = spark.createDataFrame([(i, i % 2) for i in range(2000)], "sample_id long, bin_id int")
    share = shares.Share(s, 0.4, 42)
    assert 0 < share.ranked.count() < 15_000
    plan = share.pairs()._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and plan.count("MapInArrow") == 1 and "Window" not in plan
    assert share.pairs().count() == 400_000


def test_empty(spark):
    s = spark.createDataFrame([(1, 0), (2, 0)], "sample_id long, bin_id int")
    assert pairs.crossed_sample(s, 0.4, 42).count() == 0 and pairs.sampled_or_near(s.where("false"), 0.4, 42).count() == 0
