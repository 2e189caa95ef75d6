"""The online loop as Structured Streaming: episodes, the bounded store with state, and learning rounds a micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmark.operators.store import REBINNED, Store, TaskStore

FATES = "bin_id int, sample_id long, fate string, gone long"
_STATE = "ids array<long>, vectors array<array<double>>, distances array<double>, seen long"


def bounded_store(samples: DataFrame, capacity: int, initial: float, replace: str = "nearest") -> DataFrame:
    """SP21 with given bins: the fate of each arriving sample (bin_id, sample_id, embedding); ``rebinning_store`` makes bins of its own.

    State a bin: the stored vectors, at most ``capacity``, and a number a distance taken. Within a micro-batch
    samples are taken in order of id. State lives in the query's checkpoint, so a lost executor loses nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        store, seen = Store(capacity, initial, replace), 0
        if state.exists:
            ids, vectors, distances, seen = state.get
            store.ids, store.vectors, store.distances = list(ids), [np.array(v) for v in vectors], list(distances)
            store.extras = [(0.0, 0.0)] * len(store.ids)
        rows = pd.concat(list(batches)).sort_values("sample_id")
        fate = [store.offer(int(s), np.asarray(e, float)) for s, e in zip(rows["sample_id"], rows["embedding"], strict=True)]
        state.update((store.ids, [v.tolist() for v in store.vectors], store.distances, seen + len(rows)))
        yield pd.DataFrame({"bin_id": rows["bin_id"], "sample_id": rows["sample_id"], "fate": [f for f, _ in fate], "gone": pd.array([g for _, g in fate], "Int64")})

    return samples.select("bin_id", "sample_id", "embedding").groupBy("bin_id").applyInPandasWithState(step, FATES, _STATE, "append", GroupStateTimeout.NoTimeout)


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Rebinning(StatefulProcessor):
    """A ``TaskStore`` a key: counters and centres as values, samples as a map, distances as a list that only grows."""

    def __init__(self, task: str, policy: dict):
        self.task, self.policy = task, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meta = handle.getValueState("meta", "seen long, bins int, centres array<array<double>>")
        self.samples = handle.getMapState("samples", "sample_id long", "bin int, vector array<double>, reward double, time double")
        self.distances = handle.getListState("distances", "distance double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        store = TaskStore(**self.policy)
        if self.meta.exists():
            store.seen, store.n_bins, centres = self.meta.get()
            store.centres = np.array(centres, float) if centres else None
            held = sorted(((k[0], tuple(v)) for k, v in self.samples.iterator()), key=lambda s: s[1][3])
            store.samples = {i: (b, np.asarray(v, float), r, t) for i, (b, v, r, t) in held}
            store.distances = sorted(d[0] for d in self.distances.get())
        before = set(store.samples)
        out = []
        arrived = pd.concat(list(rows)).sort_values("sample_id")
        for i, v, r in zip(arrived["sample_id"], arrived["embedding"], arrived["reward"], strict=True):
            out += [(key[0], *x) for x in store.offer(int(i), np.asarray(v, float), float(r))]
        self.meta.update((store.seen, store.n_bins, store.centres.tolist() if store.centres is not None else []))
        for i in sorted(store.touched):
            if i in store.samples:
                b, v, r, t = store.samples[i]
                self.samples.updateValue((i,), (b, v.tolist(), r, t))
            elif i in before:
                self.samples.removeKey((i,))
        if store.fresh:
            self.distances.appendList([(d,) for d in store.fresh])
        fates = pd.DataFrame(out, columns=[self.task, "sample_id", "fate", "bin_id", "gone"])
        yield fates.assign(gone=fates["gone"].astype("Int64"))

    def close(self) -> None:
        pass


def rebinning_store(samples: DataFrame, task: str, **policy) -> DataFrame:
    """SS2, SS3, SP21, AG22: the stream of ``store.rebinned``: (task, sample_id, fate, bin_id, gone) of samples as they arrive.

    State lives in RocksDB under the query's checkpoint: a restart goes on where the last batch ended, and a batch writes only the
    samples that entered, left or changed their bin. Within a micro-batch samples are taken in order of id.
    """
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # the only one for state of several kinds
    rows = samples.where("size(embedding) > 0").where(F.col(task).isNotNull()).select(task, "sample_id", F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(F.col("reward").cast("double"), F.lit(0.0)).alias("reward"))
    kind = samples.schema[task].dataType.simpleString()
    return rows.groupBy(task).transformWithStateInPandas(_Rebinning(task, policy), f"{task} {kind}, {REBINNED}", "Append", "None")


def episodes(steps: DataFrame) -> DataFrame:
    """SS4, WN6: (traj_id, t, reward, done) of finished episodes: return and length when ``done`` arrives."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n, episode = state.get if state.exists else (0.0, 0, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values("t").itertuples(index=False):
            total, n = total + row.reward, n + 1
            if row.done:
                out.append((key[0], episode, total, n))
                total, n, episode = 0.0, 0, episode + 1
        state.update((total, n, episode))
        yield pd.DataFrame(out, columns=["traj_id", "episode", "episode_return", "n_steps"])

    return steps.groupBy("traj_id").applyInPandasWithState(step, "traj_id long, episode long, episode_return double, n_steps long", "total double, n long, episode long", "append", GroupStateTimeout.NoTimeout)


def label_batches(labels: DataFrame, checkpoint: str, use: Callable[[DataFrame, int], None], n: int = 1, timeout: float = 600.0) -> int:
    """SC13: the next ``n`` batches of cached labels, each given to ``use(batch, number)`` once; how many there were.

    ``labels`` is a stream of Parquet files, one a micro-batch (``maxFilesPerTrigger`` 1), oldest first. The cursor is the stream's
    checkpoint: the next call, or a restart after a loss, goes on where the last used batch ended. A batch beyond the n-th that
    Spark has begun is not used and not committed.
    """
    used = 0

    def batch(df: DataFrame, number: int) -> None:
        nonlocal used
        if used >= n:
            raise _Enough  # the batch is not committed and comes again
        use(df, number)
        used += 1

    query = labels.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination(timeout)
    except StreamingQueryException:
        if used < n:
            raise
    finally:
        query.stop()
    return used


class _Enough(Exception):
    pass


def learning_loop(steps: DataFrame, store: str, checkpoint: str, every: int, learn: Callable[[DataFrame, int], None], relabel: Callable[[DataFrame, int], DataFrame] | None = None, **trigger):
    """SS1, SP19: appends each micro-batch of steps to the replay table ``store`` and calls ``learn(table, round)`` once for every
    ``every`` steps stored; then ``relabel(steps, round)`` gets the steps that came since the last round, and what it gives
    is kept in ``store``-relabelled.

    Steps are counted once, where their batch is written: a batch leaves the count of all steps so far and the first batch not
    yet relabelled beside its rows, and the next one reads those two numbers only. The batch id names what is written, so a
    replayed batch overwrites itself and repeats its rounds.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{store}/batch={number}")
        last = spark.read.parquet(f"{store}-counts/{number - 1}").first() if number else None
        before, unseen = (last["steps"], last["unseen"]) if last else (0, 0)
        now = before + spark.read.schema(df.schema).parquet(f"{store}/batch={number}").count()
        rounds = range(before // every, now // every)
        for r in rounds:
            learn(spark.read.parquet(store), r)
        if rounds and relabel is not None:
            new = spark.read.option("basePath", store).schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(*[f"{store}/batch={b}" for b in range(unseen, number + 1)])
            relabel(new, rounds[-1]).write.mode("overwrite").parquet(f"{store}-relabelled/upto={number}")
        kept = spark.range(1).select(F.lit(now).cast("long").alias("steps"), F.lit(number + 1 if rounds else unseen).cast("int").alias("unseen"))
        kept.write.mode("overwrite").parquet(f"{store}-counts/{number}")

    return steps.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
