"""Pair generation against a loop that goes through the candidates in order."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmark.operators import pairs


def md5(*x):
    return hashlib.md5("|".join(map(str, x)).encode()).hexdigest()


def table(spark, n=60, bins=(0, 1, 2, 5), seed=8):
    rng = np.random.default_rng(seed)
    rows = [(i * 3 + 1, bins[int(rng.integers(len(bins)))], [float(x) for x in rng.normal(size=3)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "sample_id long, bin_id int, embedding array<double>")


def orders(spark, rows, seed, minmax=False):
    """The random order of every product of places, as the operator draws it: (strategy, bin, bin): [(place, place), ...]."""
    _, bins = pairs._members(spark.createDataFrame([r[:2] for r in rows], "sample_id long, bin_id int"))
    all_pairs = pairs._bin_pairs(bins)
    blocks = pairs._crossed(bins, all_pairs, 1, seed, 1.0, F.lit("")).union(pairs._crossed(bins, all_pairs, 2, seed + 1, 1.0, F.lit(""))).union(pairs._within(bins, 4, seed + 2, 1.0))
    placed = pairs.at_rank(blocks.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("keep") - 1))))
    inside = pairs._inside(F.col("n_in"), F.col("x"), F.col("y"))
    i, j = (F.when(F.col("n_in").isNull(), F.col(c)).otherwise(v) for c, v in zip("xy", inside, strict=True))
    out = {}
    for r in placed.select("strategy", "bin_x", "bin_y", "rank", i.alias("i"), j.alias("j")).orderBy("rank").collect():
        out.setdefault((r.strategy, r.bin_x, r.bin_y), []).append((r.i, r.j))
    return out


def sampled(order, a, b, ratio):
    found = [(a[i], b[j]) if a is not b else (min(a[i], a[j]), max(a[i], a[j])) for i, j in order]
    return found[: math.ceil(len(found) * ratio)]


def ends(members, top):
    apart = [(round(math.dist(v, w), 9), a, b) for (a, v), (b, w) in itertools.combinations(members, 2)]
    near, far = sorted(apart)[:top], sorted(apart, key=lambda t: (-t[0], t[1], t[2]))[:top]
    return [t[1:] for t in near], [t[1:] for t in reversed(far)]


def loop(drawn, rows, limit, top, minmax=False, allow=False, by_tag=False):
    by_bin = {}
    for i, b, v in rows:
        by_bin.setdefault(b, []).append((i, v))
    bins, found = sorted(by_bin), []
    ids = {b: [i for i, _ in m] for b, m in by_bin.items()}
    cross = lambda s, x, y, ratio: sampled(drawn[s, x, y], ids[x], ids[y], ratio)
    if minmax:
        found += [(a, b, "cross_bin_minmax") for a, b in cross(1, bins[0], bins[-1], 0.4)]
        for x, y in itertools.pairwise(bins):
            found += [(a, b, f"neighbor_bin_{x}_{y}") for a, b in cross(2, x, y, 0.3)]
    else:
        for x, y in itertools.combinations(bins, 2):
            found += [(a, b, f"cross_bin_{x}_{y}") for a, b in cross(1, x, y, 0.4)]
        for x, y in itertools.combinations(bins, 2):
            if y - x == 1:
                found += [(a, b, f"neighbor_bin_{x}_{y}") for a, b in cross(2, x, y, 0.3)]
    for x in bins if minmax else by_bin:
        small, large = ends(by_bin[x], top)
        found += [(a, b, f"intra_bin_{x}_small") for a, b in small] + [(a, b, f"intra_bin_{x}_large") for a, b in large]
    if not minmax:
        for x in by_bin:
            if len(ids[x]) > 1:
                found += [(a, b, f"intra_bin_random_{x}") for a, b in sampled(drawn[4, x, x], ids[x], ids[x], 0.2)]
    out, seen, used = [], set(), {}
    for a, b, tag in found:
        key = (min(a, b), max(a, b), tag if by_tag else "")
        if not allow and key in seen:
            continue
        seen.add(key)
        if used.get(a, 0) < limit and used.get(b, 0) < limit:
            out.append((a, b, tag))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    return out


def filled(rows, wanted):
    """Copies as a list that grows while it is cycled over."""
    out, i = list(rows), 0
    while out and len(out) < wanted:
        a, b, tag = out[i % len(out)]
        i += 1
        out.append((a, b, f"{tag}(DUPE_{i})"))
    return out


def in_order(df):
    rows = df.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(len(rows)))
    return [(r["a"], r["b"], r["tag"]) for r in rows]


@pytest.mark.parametrize("n, stretch, small", [(30, 60, 10), (60, 100_000, 100_000)])
def test_all_pairs_in_the_order_of_strategies(spark, n, stretch, small):
    """Short stretches end inside blocks, and finish them by what members are left."""
    rows, s = table(spark, n)
    drawn = orders(spark, rows, 4)
    assert in_order(pairs.generate(s.repartition(3), seed=4, usage_limit=9, top=3, stretch=stretch, small=small)) == loop(drawn, rows, 9, 3)
    if stretch < 100:
        assert in_order(pairs.generate_padded(s, seed=4, usage_limit=4, top=3, stretch=stretch, small=small)) == loop(drawn, rows, 4, 3, minmax=True)


def test_options(spark):
    rows, s = table(spark, 24)
    drawn = orders(spark, rows, 5)
    assert in_order(pairs.generate(s, seed=5, usage_limit=70, top=2, preserve_strategy=True, strict=False)) == loop(drawn, rows, 70, 2, by_tag=True)
    whole = loop(drawn, rows, 6, 2, allow=True)
    assert in_order(pairs.generate(s, 3 * len(whole) + 5, 5, 6, 2, allow_duplicates=True)) == filled(whole, 3 * len(whole) + 5)
    want = loop(drawn, rows, 6, 2)
    assert in_order(pairs.generate(s, 40, 5, 6, 2)) == sorted(want, key=lambda p: md5(5, *p))[:40]
    assert in_order(pairs.generate(s, 10 * len(want), 5, 6, 2, preserve_strategy=True)) == want
    assert pairs.generate(s.where("false")).count() == 0 and pairs.generate_padded(s.where("false")).count() == 0


def test_random_order_is_a_permutation_both_ways(spark):
    sides = [(1, 1), (1, 9), (7, 1), (6, 35), (40, 40)]
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(sides)], "k int, n_x long, n_y long").withColumn("seed", F.xxhash64("k"))
    got = pairs.rank_at(pairs.at_rank(df.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_x") * F.col("n_y") - 1)))), rank="back").collect()
    assert all(r.rank == r.back for r in got)
    for k, (x, y) in enumerate(sides):
        mine = sorted((r.rank, r.x, r.y) for r in got if r.k == k)
        assert {p[1:] for p in mine} == {(i, j) for i in range(x) for j in range(y)}
    big = [r for r in got if r.k == 4]
    early = [r for r in sorted(big, key=lambda r: r.rank)[:800]]
    assert 330 < sum(r.x < 20 for r in early) < 470 and 330 < sum(r.y < 20 for r in early) < 470


@pytest.mark.parametrize("n", [2, 3, 8, 9])
def test_pairs_inside_a_bin_have_places(spark, n):
    _, bins = pairs._members(spark.createDataFrame([(i, 0) for i in range(n)], "sample_id long, bin_id int"))
    rows = pairs._within(bins, 4, 1, 1.0).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_x") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_y") - 1)))
    i, j = pairs._inside(F.col("n_in"), F.col("x"), F.col("y"))
    rows = rows.withColumns({"i": i, "j": j})
    x, y = pairs._inside_place(F.col("n_in"), F.col("i"), F.col("j"))
    got = rows.select("x", "y", "i", "j", x.alias("x2"), y.alias("y2")).collect()
    assert {frozenset((r.i, r.j)) for r in got} == {frozenset(p) for p in itertools.combinations(range(n), 2)} and len(got) == n * (n - 1) // 2
    assert all((r.x, r.y) == (r.x2, r.y2) for r in got)


@pytest.mark.parametrize("stretch", [90, 10_000])
def test_rounds_equal_the_fold(spark, stretch):
    rng = np.random.default_rng(3)
    hot = [(0, r, 0, int(x)) for r, x in enumerate(rng.integers(0, 40, 120))]
    rows = hot + [(g, 1000 + r, int(a), int(b)) for g in (0, 1, None) for r, (a, b) in enumerate(rng.integers(0, 12, (150, 2)))]
    df = spark.createDataFrame(rows, "environment int, rank int, a int, b int").repartition(5)
    want = []
    for g in (0, 1, None):
        used = {}
        for row in sorted(x for x in rows if x[0] == g):
            if used.get(row[2], 0) < 7 and used.get(row[3], 0) < 7:
                used[row[2]] = used.get(row[2], 0) + 1
                used[row[3]] = used.get(row[3], 0) + 1
                want.append(row)
    got = pairs._capped_in_rounds(df, 7, "environment", stretch)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert pairs._capped_in_rounds(df.where("false"), 7, "environment", stretch).count() == 0


def test_duplicate_fill_marks_every_copy(spark):
    few = [(1, 2, "t"), (3, 4, "u"), (5, 6, "v")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(few)], "rank long, a long, b long, tag string")
    assert in_order(pairs.duplicate_fill(df, 11)) == filled(few, 11)
    assert in_order(pairs.duplicate_fill(df, 2)) == few and pairs.duplicate_fill(df.where(F.lit(False)), 5).count() == 0


def test_stretches_end_where_bins_are_used_up(spark, monkeypatch):
    """Stretches of open members' candidates pass one task in order: no later stretch, however many ranks it passes, comes to rounds."""
    s = spark.createDataFrame([(i, i % 3, [float(i), 1.0]) for i in range(150)], "sample_id long, bin_id int, embedding array<float>")
    want = pairs.generate(s, None, 3, usage_limit=4, stretch=1_000_000, small=1_000_000).collect()

    def rounds(*_):
        raise AssertionError("a stretch came to rounds")

    monkeypatch.setattr(pairs, "_rounds", rounds)
    got = pairs.generate(s, None, 3, usage_limit=4, stretch=500, small=1000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_end_of_a_stretch():
    row = lambda x, y, before, keep, open_x=100, open_y=100: Row(bin_x=x, bin_y=y, before=before, keep=keep, n_x=100, n_y=100, open_x=open_x, open_y=open_y, fewer=float(open_x * open_y))
    assert pairs._stretch_end([row(0, 1, 0, 4000), row(0, 2, 4000, 4000)], 0, 3, 1_000_000) == 1200  # 2 x 3 x 200 candidates of a block
    assert pairs._stretch_end([row(0, 1, 0, 4000), row(0, 2, 4000, 4000)], 0, 10, 1_000_000) == 4000  # bins 0 and 1 are used up by then
    assert pairs._stretch_end([row(0, 1, 0, 4000), row(2, 3, 4000, 4000)], 0, 10, 1_000_000) == 8000  # bins 2 and 3 are not
    assert pairs._stretch_end([row(0, 1, 0, 4000, 10, 10)], 100, 50, 20) == 1900  # 18 candidates, of one rank in a hundred
    assert pairs._stretch_end([row(0, 1, 0, 5)], 0, 0, 0) > 0
