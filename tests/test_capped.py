"""The usage cap over neighbouring bins gives the rows of the ranked list of all pairs, of which only few become rows."""

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions import digests
from quillmark.operators import capped, pairs


def listed(samples, limit):
    near = pairs.neighbor_bin(samples)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("bin_a").orderBy(pairs.draw(42, F.col("a"), F.col("b")))))
    return pairs.usage_capped(ranked.select(F.col("bin_a").alias("environment"), "rank", "a", "b"), limit)


@pytest.mark.parametrize("a_member", [1, 16])
def test_rows_of_the_ranked_list(spark, monkeypatch, a_member):
    """Uneven bins, a gap, an id in two bins and one twice in a bin, several blocks and ranges of digests."""
    monkeypatch.setattr(capped, "BLOCK_ROWS", 32)
    monkeypatch.setattr(capped, "A_MEMBER", a_member)
    rows = [(i * 37, 0 if i < 90 else 1 if i < 210 else 2 if i < 213 else 3 if i < 260 else 7) for i in range(300)] + [(37, 1), (0, 0), (0, 0), (3700, 0)]
    s = spark.createDataFrame(rows, "sample_id long, bin_id int")
    got, want = capped.neighbors_capped(s, 3, 42), listed(s, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert capped.neighbors_capped(s.where("bin_id = 7"), 3, 42).count() == 0


def test_few_pairs_become_rows(spark, monkeypatch):
    """Of 160,000 pairs of two bins those in the first range are rows, a few for each member; all were rows before."""
    seen, fold = [], capped._folded
    monkeypatch.setattr(capped, "_folded", lambda c, *a: seen.append(c.count()) or fold(c, *a))
    s = spark.createDataFrame([(i, i % 2) for i in range(800)], "sample_id long, bin_id int")
    got = capped.neighbors_capped(s, 3, 42).collect()
    assert len(seen) > 1 and sum(seen) < 25_000 and max(r["rank"] for r in got) > 25_000
    assert sorted(map(tuple, got)) == sorted(map(tuple, listed(s, 3).collect()))


def test_digests_of_products():
    firsts, seconds = [b"", b"42|7|", b"x" * 40, "é|".encode()], [b"", b"0", b"123456", b"y" * 15, b"z" * 16, b"w" * 70]
    met = {}
    for i, j, words in digests.md5_of_products(firsts, seconds):
        met |= {(i[p], j[q]): "".join(f"{w[p, q]:08x}" for w in words) for p in range(len(i)) for q in range(len(j))}
    assert met == {(i, j): hashlib.md5(a + b).hexdigest() for i, a in enumerate(firsts) for j, b in enumerate(seconds)}
