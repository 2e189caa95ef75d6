"""Operators go on to the end of the job where an early cut would have left some out."""

from quillmark.operators import pairs


def test_pairs_beyond_the_first_block_are_taken(spark):
    """The first pairs in order share one sample and are refused; valid ones come after them."""
    rows = [(f"a{i:04d}", 0, 1 + i, "t") for i in range(300)] + [(f"b{i:04d}", 1000 + i, 2000 + i, "t") for i in range(40)]
    df = spark.createDataFrame([(0, k, a, b, t) for k, a, b, t in rows], "environment int, rank string, a long, b long, tag string")
    for small in (0, 1000):  # in rounds, and in one task
        got = pairs.usage_capped(df, 3, small=small).orderBy("rank").limit(20).collect()
        assert [(r.a, r.b) for r in got] == [(0, 1 + i) for i in range(3)] + [(1000 + i, 2000 + i) for i in range(17)]


def test_generate_on_skewed_bins(spark):
    """Three samples of one bin with 200 of the other: all that the cap allows come back."""
    s = spark.createDataFrame([(i, 0 if i < 3 else 9, [float(i), 1.0]) for i in range(203)], "sample_id long, bin_id int, embedding array<float>")
    every = pairs.generate(s, 10_000, 1, usage_limit=2, ratios=(1.0, 0.0, 0.1)).collect()
    got = pairs.generate(s, 30, 1, usage_limit=2, ratios=(1.0, 0.0, 0.1)).collect()
    assert len(every) > 30 and len(got) == 30 and {r[1:] for r in got} <= {r[1:] for r in every}  # more than asked are shuffled and cut
