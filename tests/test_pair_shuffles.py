"""Pairs are not shuffled where only few of them can matter, with the same rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import pairs


def test_pairs_of_a_share_are_not_shuffled(spark):
    """Only the pairs that have the digits of an end come to a rank: of 3 x 400 pairs less than a tenth."""
    s = spark.createDataFrame([(i, i % 3) for i in range(60)], "sample_id long, bin_id int")
    crossed = pairs.cross_bin(s)
    ends = pairs._shares(crossed, 0.4, 1, ("bin_a", "bin_b"))
    digits = F.substring(pairs.draw(1, F.col("a"), F.col("b")), 1, pairs.RATIO_DIGITS)
    ranked = crossed.join(ends, [F.col("bin_a") == F.col("__bin_a"), F.col("bin_b") == F.col("__bin_b")]).where(digits == F.col("__end")).count()
    plan = pairs.ratio_sample(crossed, 0.4, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("Window ") == 1 and 0 < ranked < 120
    assert pairs.ratio_sample(crossed, 0.4, 1).count() == 3 * 160


@pytest.mark.parametrize("again", [False, True])
def test_near_pairs_beyond_the_share_come_second(spark, again):
    """As a union by priority gives them, also where an id stands in several bins or twice in one."""
    rows = [(i, i * 7 % 4) for i in range(40)] + ([(3, 2), (3, 2), (8, 1), (None, 1)] if again else [])
    s = spark.createDataFrame(rows, "sample_id long, bin_id int")
    one = pairs.tagged(pairs.ratio_sample(pairs.cross_bin(s), 0.4, 42), "cross_bin", 1)
    two = pairs.tagged(pairs.neighbor_bin(s).select(F.col("b").alias("a"), F.col("a").alias("b")), "neighbor_bin", 2)
    want = pairs.first_strategy(one.unionByName(two)).select("a", "b", "tag").collect()
    got = pairs.sampled_or_near(s, 0.4, 42)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want))
    if not again:
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "least(" not in plan  # pairs are not brought together by their ids


@pytest.mark.parametrize("blocks", [4096, 7])
def test_ends_of_bins_without_their_pairs(spark, monkeypatch, blocks):
    """Equal vectors, ties, distances halfway between billionths, several blocks; no row a pair reaches the ranking."""
    monkeypatch.setattr(pairs, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(pairs, "PRODUCT", 128)
    rng = np.random.default_rng(5)
    v = [[float(x) for x in rng.integers(0, 3, 4)] for _ in range(50)] + [[0.0, 0.0, 0.0, k * 0.5e-9] for k in range(6)]
    rows = [(100 - i, i % 2, x) for i, x in enumerate(v)] + [(500, 0, []), (501, 0, [float("nan")] * 4), (502, 3, [1.0])]
    s = spark.createDataFrame(rows, "sample_id long, bin_id int, embedding array<double>")
    want = []
    for b in (0, 1):
        mine = sorted((i, x) for i, c, x in rows if c == b and i < 500)
        apart = [(pairs._ninths(math.sqrt(sum_of(x, y))), i, j) for (i, x), (j, y) in itertools.combinations(mine, 2)]
        want += [(b, i, j, "intra_bin_small") for _, i, j in sorted(apart)[:6]]
        want += [(b, i, j, "intra_bin_large") for _, i, j in sorted(apart, key=lambda t: (-t[0], t[1], t[2]))[:6]]
    got = pairs.extremes_by_distance(s, 6)
    assert sorted((r.bin_id, r.a, r.b, r.tag) for r in got.collect()) == sorted(want)
    assert "FlatMapGroupsInPandas" in got._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_grow_with_the_largest_bin(spark, monkeypatch):
    """A bin of many samples is dealt to more tasks, with the same pairs."""
    monkeypatch.setattr(pairs, "FIRSTS", 4)
    s = spark.createDataFrame([(i, 0 if i < 200 else 1) for i in range(210)], "sample_id long, bin_id int")
    assert pairs._n_blocks(s) == 50 and pairs._n_blocks(s.where("bin_id = 1")) == pairs.PAIR_BLOCKS and pairs._n_blocks(s.where("false")) == pairs.PAIR_BLOCKS
    assert {(r.a, r.b) for r in pairs.neighbor_bin(s).collect()} == {(a, b) for a in range(200) for b in range(200, 210)}
    assert pairs.intra_bin(s).count() == 200 * 199 // 2 + 45


@pytest.mark.parametrize("pairs_of", [pairs.neighbor_bin, pairs.adjacent_bin, pairs.cross_bin])
def test_second_samples_come_in_the_same_order(spark, pairs_of):
    """Runs of a first sample hold a block of second ones, mostly the block of the run before; so rows take little room where they are written."""
    s = spark.createDataFrame([(i, 0 if i < 60 else 1) for i in range(2600)] + [(None, 0)], "sample_id long, bin_id int")
    rows = pairs_of(s).select(F.spark_partition_id().alias("task"), "a", "b").collect()
    assert len(rows) == 61 * 2540
    runs = [(k[0], tuple(r.b for r in run)) for k, run in itertools.groupby(rows, key=lambda r: (r.task, r.a))]
    # a run of equal firsts may join two blocks, where one ends and the next begins
    assert max(len(b) for _, b in runs) <= 2 * pairs.SECONDS
    assert sum(x == y for x, y in itertools.pairwise(runs)) > len(runs) / 3


def sum_of(x, y):
    s = 0.0
    for p, q in zip(x, y, strict=True):
        s += (p - q) * (p - q)
    return s
