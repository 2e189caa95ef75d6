"""The store that makes its own bins: batch and stream against a loop, over several binnings and a restart."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import store
from quillmark.streaming import online

POLICY = {"total": 12, "every": 9, "bins": (2, 4), "initial": 0.2, "weights": (1.0, 0.05, 0.0)}


def rows(n=150, tasks=3):
    rng = np.random.default_rng(11)
    return [(i % tasks, i, [float(x) for x in rng.normal(size=3) + 3 * (i % 4 == 1)], float(rng.normal() + i % 5)) for i in range(n)]


def loop(samples, total, every, bins, initial, weights):
    """One task, sample by sample, with plain lists."""
    count, stored, centres, n_bins, taken, out = 0, [], None, bins[0], [], []
    cap = lambda b: total // n_bins + (1 if b < total % n_bins else 0)
    limit = lambda: initial if len(taken) < 5 or np.median(taken) < 1e-9 else float(np.median(taken))
    for i, v, r in samples:
        count += 1
        if count % every == 1 and len(stored) >= total:
            x = np.array([[*s[2], 0.3 * s[3]] for s in stored])
            labels, centres = store.clusters(x, *bins)
            n_bins = len(centres)
            for s, b in zip(stored, labels, strict=True):
                s[1] = int(b)
            for b in range(n_bins):
                mine = sorted((s for s in stored if s[1] == b), key=lambda s: zlib.crc32(f"{count}|{s[0]}".encode()))
                for s in mine[: max(0, len(mine) - cap(b))]:
                    stored.remove(s)
                    out.append((s[0], "trimmed", b, None))
        b = 0 if centres is None else int(np.linalg.norm(centres - np.array([*v, 0.3 * r]), axis=1).argmin())
        if len(stored) < total:
            stored.append([i, b, v, r, count - 1.0])
            taken.append(0.0)
            out.append((i, "added", b, None))
            continue
        mine = [s for s in stored if s[1] == b]
        apart = [float(np.sqrt(weights[0] * sum((x - y) ** 2 for x, y in zip(s[2], v, strict=True)) + weights[1] * (s[3] - r) ** 2)) for s in mine]
        if mine and min(apart) < limit():
            out.append((i, "refused", b, None))
            continue
        gone = None
        if mine and len(mine) >= cap(b):
            gone = mine[int(np.argmin(apart))]
            stored.remove(gone)
        stored.append([i, b, v, r, count - 1.0])
        if mine:
            taken.append(min(apart))
        out.append((i, "added" if gone is None else "replaced", b, gone and gone[0]))
    return out


def wanted(data):
    return sorted(((t, *x) for t in {r[0] for r in data} for x in loop([r[1:] for r in data if r[0] == t], **POLICY)), key=repr)


def frame(spark, data):
    return spark.createDataFrame(data, "task long, sample_id long, embedding array<float>, reward double").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))


def as_float(data):
    return [(t, i, [float(np.float32(x)) for x in v], r) for t, i, v, r in data]


def test_batch_equals_the_loop(spark):
    data = as_float(rows())
    got = sorted(map(tuple, store.rebinned(frame(spark, data).repartition(4), "task", **POLICY).collect()), key=repr)
    assert got == wanted(data)
    assert {f for _, _, f, _, _ in got} == {"added", "refused", "replaced", "trimmed"}
    assert len({b for t, _, f, b, _ in got if f != "trimmed"}) > 2


def test_stream_equals_the_loop_with_a_restart(spark, tmp_path):
    data = as_float(rows())
    schema = frame(spark, data[:1]).schema

    def feed(part):
        frame(spark, data[50 * part : 50 * part + 50]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    got = []
    for run, parts in enumerate(([0], [1, 2])):  # the second run starts anew from the checkpoint
        for p in parts:
            feed(p)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = str(tmp_path / "out")
        q = online.rebinning_store(stream, "task", **POLICY).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    got = sorted(map(tuple, spark.read.parquet(out).select("task", "sample_id", "fate", "bin_id", "gone").collect()), key=repr)
    assert got == wanted(data)


def test_clusters_are_in_order_of_reward():
    x = np.array([[0.0, 5.0], [0.1, 5.1], [9.0, 1.0], [9.1, 1.1], [4.0, 3.0], [4.1, 3.1]])
    label, centres = store.clusters(x, 2, 4)
    assert label.tolist() == [2, 2, 0, 0, 1, 1] and (np.diff(centres[:, -1]) > 0).all()
    label, centres = store.clusters(np.zeros((4, 2)), 2, 3)
    assert len(centres) == 2 and len(label) == 4


def test_learning_rounds_see_new_steps_once(spark, tmp_path):
    steps = spark.range(23).select(F.col("id").alias("t"), (F.col("id") % 3).cast("double").alias("reward"))
    for p in range(5):
        steps.where((F.col("t") >= 5 * p) & (F.col("t") < 5 * p + 5)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rounds, asked = [], []

    def relabel(new, r):
        asked.append((r, sorted(x.t for x in new.collect())))
        return new.withColumn("reward", F.lit(float(r)))

    def run():
        stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = online.learning_loop(stream, str(tmp_path / "replay"), str(tmp_path / "ck"), 8, lambda table, r: rounds.append((r, table.count())), relabel)
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    run()  # nothing new
    assert [r for r, _ in rounds] == [0, 1] and [r for r, _ in asked] == [0, 1]
    seen = [t for _, ts in asked for t in ts]
    assert len(seen) == len(set(seen))
    assert spark.read.parquet(str(tmp_path / "replay-relabelled")).count() == len(seen)
    assert spark.read.parquet(str(tmp_path / "replay-counts/4")).first()["steps"] == 23


@pytest.mark.parametrize("replace", ["nearest", "random"])
def test_store_is_bounded(replace):
    """The first samples fill it whatever their bin, so other bins may still have room: a bin holds its capacity or what filled it."""
    s = store.TaskStore(**(POLICY | {"replace": replace}))
    for _, i, v, r in rows(120, 1):
        s.offer(i, np.array(v), r)
        assert len(s.samples) <= 2 * POLICY["total"]


def test_label_batches_come_once_and_resume(spark, tmp_path):
    cached = spark.range(50).select("id", (F.col("id") % 3 - 1).cast("int").alias("label"))
    for p in range(5):
        cached.where((F.col("id") >= 10 * p) & (F.col("id") < 10 * p + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "labels"))
    got = []

    def next_ones(n):
        stream = spark.readStream.schema(cached.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "labels"))
        return online.label_batches(stream, str(tmp_path / "cursor"), lambda df, number: got.append(sorted(r.id for r in df.collect())), n)

    assert next_ones(1) == 1 and next_ones(2) == 2
    assert [len(b) for b in got] == [10, 10, 10] and len({i for b in got for i in b}) == 30
    assert next_ones(9) == 2 and next_ones(1) == 0
    assert sorted(i for b in got for i in b) == list(range(50))
