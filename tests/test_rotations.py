"""The turned vectors are signed entries of the vector, not sums of products."""

import pytest
from pyspark.sql import functions as F

from quillmark.functions import maths
from quillmark.plans import files  # noqa: F401  registers its queries
from quillmark.plans import catalogue

from tests.conftest import DATA


def test_no_products_are_made(spark):
    df = catalogue.QUERIES["parallel_rotations"](spark, DATA)
    assert " * " not in df._jdf.queryExecution().optimizedPlan().toString()
    assert len({tuple(r)[1:] for r in df.where("event_id = 7").collect()}) == 24


def test_quaternions_come_from_batches(spark):
    """One task's matrices are solved together, not turn by turn in an expression; incomplete ones give null."""
    df = spark.createDataFrame([(0, [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]), (1, [[None, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]), (2, [[float("nan")] * 3] * 3)], "i int, m array<array<double>>")
    q = df.select("i", maths.quat_of_matrix([[F.col("m")[a][b] for b in range(3)] for a in range(3)]).alias("q"))
    assert "aggregate(" not in q._jdf.queryExecution().optimizedPlan().toString()
    got = {r.i: r.q for r in q.collect()}
    assert got[0] == pytest.approx([0.5**0.5, 0, 0, 0.5**0.5]) and got[1] is None and got[2] is None


def test_images_are_searched_once(spark, tmp_path):
    """The places of the colour stand once in the expression; images are drawn apart from the events, also for negative and null ids."""
    spark.createDataFrame([(5,), (-3,), (None,), (6,)], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    df = catalogue.QUERIES["colour_crop"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flatten(") == 1 and plan.count("Join ") == 1
    got = {r.event_id: tuple(r)[1:] for r in df.collect()}
    assert got[5] == (3, 3, 2) and got[6] == (3, 3, 3) and got[-3][2] == -1 and got[None][2] == -1
