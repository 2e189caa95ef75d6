"""Nearest neighbours by boxes against brute force, and how their work grows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import boxes, metric
from tests.test_metric import brute, frame, joined


@pytest.mark.parametrize("k", [1, 5])
def test_boxes_with_ties_copies_and_far_points(spark, monkeypatch, k):
    """Boxes and leaves so small that many queries go to other boxes, and some boxes have fewer points than are asked for."""
    for name, value in (("BOX_ROWS", 16), ("LEAF", 4), ("SAMPLED", 2)):
        monkeypatch.setattr(boxes, name, value)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 5, (90, 3)), rng.normal(20, 0.1, (60, 3)), np.zeros((15, 3)), [[1e4, 0, 0], [1e4, 1, 0], [-3e5, 2, 2]]]).astype(float)
    ids = rng.permutation(10 * len(x))[: len(x)].tolist()
    df = frame(spark, x, ids).repartition(5)
    assert joined(df, k) == brute(x, ids, None, k)
    few = frame(spark, x[:3], [1, 2, 3])
    assert joined(few, 5) == brute(x[:3], [1, 2, 3], None, 5)


def test_work_of_a_query_does_not_grow_with_the_points(spark, monkeypatch):
    """By pivots, of which there are a fixed number at most, four times the points gave about sixteen times the distances."""
    monkeypatch.setattr(metric, "MAX_PIVOTS", 4)
    made = []
    for n in (4_000, 16_000):
        x = np.random.default_rng(4).uniform(0, n ** (1 / 3), (n, 3))
        tally = spark.sparkContext.accumulator(0)
        df = frame(spark, x).repartition(4)
        metric.nearest(df.select(F.col("id").alias("q"), "embedding"), df.select(F.col("id").alias("p"), "embedding"), 4, None, tally).write.format("noop").mode("overwrite").save()
        made.append(tally.value / n)
    assert made[1] < 1.5 * made[0]
