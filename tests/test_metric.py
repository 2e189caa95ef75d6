"""Nearest-neighbour and range joins against brute force, and how many distances they make."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import metric, neighbours


def frame(spark, x, ids=None, block=None):
    rows = [(int(i), [float(v) for v in p], None if block is None else block[k]) for k, (i, p) in enumerate(zip(range(len(x)) if ids is None else ids, x, strict=True))]
    return spark.createDataFrame(rows, "id long, embedding array<double>, bin_id int")


def brute(x, ids, block, k):
    out = {}
    for a in range(len(x)):
        mine = [b for b in range(len(x)) if block is None or block[a] == block[b]]
        near = sorted((round(float(np.sqrt(((x[a] - x[b]) ** 2).sum())), 9), ids[b]) for b in mine)[:k]
        out[ids[a]] = near
    return out


def joined(df, k, block=None, tally=None):
    more = [block] if block else []
    got = metric.nearest(df.select(F.col("id").alias("q"), "embedding", *more), df.select(F.col("id").alias("p"), "embedding", *more), k, block, tally).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.q, r["rank"])):
        out.setdefault(r.q, []).append((r.distance, r.p))
        assert r["rank"] == len(out[r.q])
    return out


@pytest.fixture
def small_cells(monkeypatch):
    """Cells, rings and chunks so small that a little data fills many."""
    for name, value in (("CELL_ROWS", 12), ("RING", 5), ("CHUNK", 3)):
        monkeypatch.setattr(metric, name, value)


def test_nearest_with_ties_copies_and_clusters(spark, small_cells):
    rng = np.random.default_rng(1)
    grid = rng.integers(0, 5, (120, 2)).astype(float)  # many ties and copies
    clusters = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in (20, 40, 60)])
    x = np.concatenate([grid, clusters, np.zeros((25, 2))])
    ids = rng.permutation(10 * len(x))[: len(x)].tolist()
    df = frame(spark, x, ids).repartition(5)
    for k in (1, 4):
        assert joined(df, k) == brute(x, ids, None, k)


def test_blocks_of_all_sizes(spark, small_cells):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 3))
    block = [None if i % 8 == 7 else 0 if i < 100 else i % 5 for i in range(160)]
    df = frame(spark, x, None, block).repartition(4)
    assert joined(df, 6, "bin_id") == brute(x, list(range(160)), block, 6)


def test_dimension_and_incomplete_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (None, [0.0, 0.0]), (3, None), (4, [])], "id long, embedding array<double>")
    assert joined(df, 2) == {1: [(0.0, 1), (5.0, 2)], 2: [(0.0, 2), (5.0, 1)]}
    assert joined(df.where("false"), 2) == {}
    with pytest.raises(ValueError):
        joined(spark.createDataFrame([(1, [0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>"), 1)


def test_random_vectors_of_many_dimensions(spark, small_cells):
    """Bounds tell nothing here; the answer is the same."""
    x = np.random.default_rng(3).normal(size=(90, 40))
    assert joined(frame(spark, x), 3) == brute(x, list(range(90)), None, 3)


def test_states_take_a_small_share_of_all_distances(spark):
    n = 20_000
    x = np.random.default_rng(4).uniform(0, 100, (n, 3))
    df = frame(spark, x).repartition(4)
    tally = spark.sparkContext.accumulator(0)
    got = joined(df, 4, tally=tally)
    assert tally.value < 0.3 * n * n
    for a in range(0, n, 997):
        d = np.round(np.sqrt(((x - x[a]) ** 2).sum(1)), 9)
        assert [p for _, p in got[a]] == np.lexsort((np.arange(n), d))[:4].tolist()


def test_first_within_against_brute_force(spark, small_cells):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.uniform(0, 4, (150, 2)), np.ones((60, 2))])
    block = [0 if i % 3 else i % 2 + 1 for i in range(len(x))]
    ids = rng.permutation(len(x)).tolist()
    df = frame(spark, x, ids, block).withColumnRenamed("id", "sample_id")
    for radius in (0.05, 0.4, 3.0):
        want = {}
        for a in range(len(x)):
            near = [ids[b] for b in range(len(x)) if block[a] == block[b] and ids[b] < ids[a] and np.sqrt(((x[a] - x[b]) ** 2).sum()) < radius]
            if near:
                want[ids[a]] = min(near)
        assert {r.sample_id: r.earlier for r in neighbours.duplicates(df.repartition(3), radius).collect()} == want
    assert neighbours.duplicates(df, 0.0).count() == 0


def test_local_groups_of_small_clouds_meet_no_join(spark):
    """A cloud's centres and their nearest come from one task, with the rows that the join of larger clouds gives, ties included."""
    rng = np.random.default_rng(3)
    rows = [(c, p, *[float(x) for x in rng.integers(0, 4, 3)]) for c in range(3) for p in range(5 + 30 * c)]
    df = spark.createDataFrame(rows, "cloud_id long, pt int, x double, y double, z double")
    got = neighbours.local_groups(df, 4, 8)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(tuple, got.collect()))
    assert sorted(map(tuple, neighbours.local_groups(df, 4, 8, small=10).collect())) == want and len(want) == 4 * (5 + 8 + 8)
