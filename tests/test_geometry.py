"""Eigenvectors, boxes, mesh draws, closures and running moments against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import maths
from quillmark.operators import points, store


def matrix_columns():
    return [[F.col("m")[a][b] for b in range(3)] for a in range(3)]


def as_matrix(q):
    w, x, y, z = np.array(q) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def test_quaternions_of_rotations(spark):
    rng = np.random.default_rng(1)
    near_half = [[1e-9, 1, 0, 0], [1e-7, 0.6, 0.8, 0], [0, 0, 0, 1], [0, 1, 1, 1], [1, 0, 0, 0], [1e-4, -0.3, 0.2, 0.9]]
    mats = [as_matrix(q) for q in near_half] + [as_matrix(rng.normal(size=4)) for _ in range(40)] + [np.array(m, float) for m in maths.parallel_rotations()]
    df = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(mats)], "i int, m array<array<double>>")
    got = df.select("i", maths.quat_of_matrix(matrix_columns()).alias("q")).collect()
    for r in got:
        assert r["q"][0] >= -1e-12 and np.linalg.norm(r["q"]) == pytest.approx(1, abs=1e-12)
        assert np.allclose(as_matrix(r["q"]), mats[r["i"]], atol=1e-9)
    loose = [mats[0] + rng.normal(scale=0.02, size=(3, 3)) for _ in range(5)]
    df = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(loose)], "i int, m array<array<double>>")
    for r in df.select("i", maths.quat_of_matrix(matrix_columns()).alias("q")).collect():
        m = loose[r["i"]]
        k = np.array([
            [m[0, 0] - m[1, 1] - m[2, 2], m[0, 1] + m[1, 0], m[0, 2] + m[2, 0], m[2, 1] - m[1, 2]], [m[0, 1] + m[1, 0], m[1, 1] - m[0, 0] - m[2, 2], m[1, 2] + m[2, 1], m[0, 2] - m[2, 0]],
            [m[0, 2] + m[2, 0], m[1, 2] + m[2, 1], m[2, 2] - m[0, 0] - m[1, 1], m[1, 0] - m[0, 1]], [m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1], np.trace(m)],
        ])
        v = np.linalg.eigh(k)[1][:, -1][[3, 0, 1, 2]]
        assert abs(abs(v @ np.array(r["q"])) - 1) < 1e-9


def test_jacobi_against_numpy(spark):
    rng = np.random.default_rng(2)
    cases = [(a + a.T) / 2 for a in rng.normal(size=(10, 3, 3))] + [np.diag([1.0, 1.0, 2.0]), np.zeros((3, 3))]
    df = spark.createDataFrame([(i, a.ravel().tolist()) for i, a in enumerate(cases)], "i int, m array<double>")
    for r in df.select("i", maths.jacobi(F.col("m"), 3).alias("e")).collect():
        k, v = np.array(r["e"]["k"]).reshape(3, 3), np.array(r["e"]["v"]).reshape(3, 3)
        assert np.allclose(np.sort(np.diag(k)), np.linalg.eigvalsh(cases[r["i"]]), atol=1e-9) and np.allclose(v @ np.diag(np.diag(k)) @ v.T, cases[r["i"]], atol=1e-9)


def test_cameras_of_oriented_boxes(spark):
    rng = np.random.default_rng(3)
    turn = as_matrix([0.8, 0.2, -0.5, 0.1])
    clouds = {0: rng.normal(size=(300, 3)) * [9, 3, 1] @ turn.T + [5, -2, 7], 1: rng.uniform(-1, 1, (50, 3)) * [2, 8, 4], 2: np.array([[1.0, 2.0, 3.0]]), 3: np.array([[0.0, 0, 0], [0, 6, 8]])}
    df = spark.createDataFrame([(c, i, *map(float, p)) for c, v in clouds.items() for i, p in enumerate(v)], "cloud_id int, pt int, x double, y double, z double")
    for r in points.camera_places(df, (1.0, 2.0, 2.0), 50.0).collect():
        v = clouds[r.cloud_id]
        mean = v.mean(0)
        axes = np.linalg.eigh(np.cov(v.T, bias=True))[1] if len(v) > 1 else np.eye(3)
        along = (v - mean) @ axes
        low, high = along.min(0), along.max(0)
        away = (high - low).max() / 2 / math.tan(math.radians(25)) * 1.5
        assert r.distance == pytest.approx(away, abs=1e-7)
        assert np.allclose([r.x, r.y, r.z], mean + axes @ ((low + high) / 2) + np.array([1, 2, 2]) / 3 * away, atol=1e-6)
    with pytest.raises(ValueError):
        points.camera_places(df, (0.0, 0.0, 0.0))


def test_mesh_draws(spark):
    areas = [1.0, 3.0, 0.0, 6.0]
    faces = [(1, f, [0.0, 0.0, 0.0], [2 * a, 0.0, 0.0], [0.0, 1.0, float(f)]) for f, a in enumerate(areas)]
    flat = [(2, f, [float(f)] * 3, [float(f)] * 3, [float(f)] * 3) for f in range(3)]
    df = spark.createDataFrame(faces + flat, "mesh int, face int, p array<double>, q array<double>, r array<double>")
    true = [math.hypot(1, f) * 2 * a / 2 for f, a in enumerate(areas)]
    n = 4000
    got = points.mesh_points(df.repartition(3), n, 7).collect()
    counts = np.array([sum(r.mesh == 1 and r.face == f for r in got) for f in range(4)])
    assert counts.sum() == n and counts[2] == 0 and sorted(r.pt for r in got if r.mesh == 1) == list(range(1, n + 1))
    expected = n * np.array(true) / sum(true)
    chi = (((counts - expected) ** 2)[expected > 0] / expected[expected > 0]).sum()
    assert 0 < chi < 13.8  # two degrees of freedom, one in a thousand
    assert sum(r.mesh == 2 for r in got) == 9  # all corners of a mesh without area
    key = lambda rows: sorted(map(tuple, rows))
    assert key(points.mesh_points(df, n, 7).collect()) == key(got) and key(points.mesh_points(df, n, 8).collect()) != key(got)
    for r in got:
        if r.mesh == 1:
            t = r.y  # p + s (q - p) + t (r - p)
            assert r.z == pytest.approx(t * r.face) and -1e-12 <= r.x <= 2 * areas[r.face] * (1 - t) + 1e-9


def test_descendants_of_long_chains_cycles_and_forests(spark):
    n = 10_000
    chain = [(i, i - 1) for i in range(1, n)]
    rest = [(20_000, 20_001), (20_001, 20_000), (20_002, 20_001), (30_000, None), (30_001, 30_000), (0, None), (40_000, 5), (40_001, 40_000), (5, 4)]
    df = spark.createDataFrame(chain + rest, "body long, parent long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("closure", "closure")
    got = {r.body for r in points.descendants(spark, df, 4).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == set(range(4, n)) | {40_000, 40_001}
    print("jobs", len(tracker.getJobIdsForGroup("closure")))
    assert {r.body for r in points.descendants(spark, df, 20_000).collect()} == {20_000, 20_001, 20_002}
    assert {r.body for r in points.descendants(spark, df, 77).collect()} == set(range(77, n))
    assert {r.body for r in points.descendants(spark, df, 30_001).collect()} == {30_001}


def test_running_steps_follow_the_loop(spark):
    rng = np.random.default_rng(4)
    batches = {b: rng.normal(b, 2, int(rng.integers(2, 9))) for b in (1, 2, 3, 5, 8, 9, 20)} | {30: np.array([4.0])}
    mean, var, count, want = 0.0, 1.0, 1e-4, {}
    for b, v in batches.items():
        bm, bv, n = v.mean(), v.var(ddof=1) if len(v) > 1 else 0.0, len(v)
        delta, total = bm - mean, count + n
        m2 = var * count + bv * n + delta**2 * count * n / total
        mean, var, count = mean + delta + n / total, m2 / total, total
        want[b] = (mean, var, count)
    df = spark.createDataFrame([(b, float(x)) for b, v in batches.items() for x in v], "b int, x double").repartition(4)
    got = {r.b: (r.mean, r.variance, r.weight) for r in store.running_steps(df, "b", "x").collect()}
    assert got.keys() == want.keys() and all(got[b] == pytest.approx(want[b], abs=1e-9) for b in want)
    assert store.running_steps(df.where("false"), "b", "x").count() == 0
