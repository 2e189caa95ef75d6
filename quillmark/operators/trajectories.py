"""Transitions (traj_id, t, reward, done, ...): episodes, windows over steps, bounded stores, replay samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import vectors
from quillmark.operators.decisions import chunked
from quillmark.operators.pairs import draw


def steps_in_order() -> Window:
    """Steps of each trajectory."""
    return Window.partitionBy("traj_id").orderBy("t")


def episode_of(done: Column, order: Window) -> Column:
    """SS4: the number of episodes closed before a row."""
    return F.coalesce(F.sum(done.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def returns(steps: DataFrame, success: Column) -> DataFrame:
    """AG14: return and success (at any step) of each trajectory."""
    return steps.groupBy("traj_id").agg(F.sum("reward").alias("episode_return"), F.max(success.cast("int")).alias("success"), F.count("*").alias("n_steps"))


def success_rate(episodes: DataFrame) -> DataFrame:
    """AG14: in percent."""
    return episodes.agg(F.avg("episode_return").alias("mean_return"), (F.avg("success") * 100).alias("success_rate"), F.count("*").alias("n_episodes"))


def info_statistics(steps: DataFrame, value: str) -> DataFrame:
    """AG15: mean over steps, and mean over trajectories of the last step's value."""
    by = steps.groupBy("traj_id").agg(F.sum(value).alias("s"), F.count("*").alias("n"), F.max_by(value, "t").alias("last"))
    return by.agg((F.sum("s") / F.sum("n")).alias("mean_all"), F.avg("last").alias("mean_final"))


def moving_return(episodes: DataFrame, size: int = 10, group: str = "environment") -> DataFrame:
    """WN1: mean of the last returns. The first window starts from a 0, as before any episode."""
    order = Window.partitionBy(group).orderBy("episode")
    last = order.rowsBetween(-(size - 1), 0)
    total, n = F.sum("episode_return").over(last), F.count("*").over(last)
    seeded = F.when(F.row_number().over(order) < size, n + 1).otherwise(n)
    return episodes.withColumn("moving_return", total / seeded)


def segments(steps: DataFrame, size: int, seed: int, offset: Column | None = None) -> DataFrame:
    """WN3, SP8: one run of ``size`` rewards a trajectory from a hash-drawn start; shorter ones have none."""
    nested = steps.groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "reward"))), lambda x: x["reward"]).alias("rewards")).where(F.size("rewards") >= size)
    drawn = F.conv(F.substring(draw(seed, F.col("traj_id")), 1, 8), 16, 10).cast("long") % (F.size("rewards") - size + 1)
    return nested.withColumn("start", (offset if offset is not None else drawn).cast("int")).withColumn("segment", vectors.segment(F.col("rewards"), F.col("start"), size)).drop("rewards")


def stacked(steps: DataFrame, observation: str, goal: str) -> DataFrame:
    """WN4: current, previous (the current at the first step) and goal."""
    before = F.coalesce(F.lag(observation).over(steps_in_order()), F.col(observation))
    return steps.withColumn("stacked", vectors.joined(F.col(observation), before, F.col(goal)))


def time_limited(steps: DataFrame, horizon: int) -> DataFrame:
    """WN5: ``done_no_max`` is false where the step limit ended the episode."""
    return steps.withColumn("done_no_max", F.col("done") & (F.row_number().over(steps_in_order()) < horizon))


def running(steps: DataFrame) -> DataFrame:
    """WN6: return so far and best reward so far."""
    sofar = steps_in_order().rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumns({"return_so_far": F.sum("reward").over(sofar), "best_so_far": F.max("reward").over(sofar)})


def last_rows(rows: DataFrame, order: str, capacity: int) -> DataFrame:
    """SP16, SP17: what a ring of ``capacity`` rows holds: the last by ``order``, by top-k and no full sort."""
    return rows.orderBy(F.desc(order)).limit(capacity)


def ring_slots(rows: DataFrame, seq: str, capacity: int) -> DataFrame:
    """SP17: the slot of each kept row."""
    return last_rows(rows, seq, capacity).withColumn("slot", F.pmod(F.col(seq), F.lit(capacity)))


def last_trajectories(steps: DataFrame, most: int) -> DataFrame:
    """SP18: steps of the ``most`` greatest trajectory ids."""
    return steps.join(steps.select("traj_id").distinct().orderBy(F.desc("traj_id")).limit(most), "traj_id", "left_semi")


def whole_trajectories(steps: DataFrame) -> DataFrame:
    """PF7: without the last trajectory if it is shorter than the first."""
    sizes = steps.groupBy("traj_id").agg(F.count("*").alias("n"))
    ends = sizes.agg(F.min_by("n", "traj_id").alias("first"), F.max_by("n", "traj_id").alias("last"), F.max("traj_id").alias("last_id")).where("last < first")
    return steps.join(F.broadcast(ends.select(F.col("last_id").alias("traj_id"))), "traj_id", "left_anti")


def _drawn(n: int, seed: int, name: str, below: Column) -> Column:
    return F.conv(F.substring(draw(seed, F.lit(name), F.col("query")), 1, 12), 16, 10).cast("long") % below


def uniform_queries(spark, steps: DataFrame, n: int, seed: int) -> DataFrame:
    """SP6, SP7: n pairs of (trajectory, time), drawn with replacement; time below the shortest trajectory's length.

    Trajectories are numbered once, by ranges of their ids; draws are joined by number, not collected.
    """
    sizes = steps.groupBy("traj_id").agg(F.count("*").alias("n"))
    numbered = chunked(sizes, "traj_id", 1 << 62).withColumnRenamed("line", "number")
    limits = sizes.agg(F.count("*").alias("n_traj"), F.min("n").alias("shortest"))
    asked = spark.range(n).withColumnRenamed("id", "query").join(F.broadcast(limits))
    for side in ("1", "2"):
        asked = asked.withColumns({f"number{side}": _drawn(n, seed, f"traj{side}", F.col("n_traj")), f"t{side}": _drawn(n, seed, f"time{side}", F.col("shortest"))})
        asked = asked.join(numbered.select(F.col("number").alias(f"number{side}"), F.col("traj_id").alias(f"traj{side}")), f"number{side}")
    return asked.select("query", "traj1", "t1", "traj2", "t2")


def replay_sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """SP14: n rows without replacement, by random rank (top-k)."""
    return rows.withColumn("__draw", draw(seed, F.col(key))).orderBy("__draw").limit(n).drop("__draw")


def replay_with_states(rows: DataFrame, n: int, seed: int, key: str, state: str) -> tuple[DataFrame, DataFrame]:
    """SP15: ``n`` sampled rows, and the states of all rows, for measures of the sample against everything stored."""
    return replay_sample(rows, n, seed, key), rows.select(key, state)


def relabeled(rows: DataFrame, scorer: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """SP19: rewards replaced by the scorer's (key, prediction); rows that it leaves out keep theirs."""
    return rows.join(scorer(rows), key, "left").withColumn("reward", F.coalesce("prediction", "reward")).drop("prediction")


def split(rows: DataFrame, key: str, seed: int, share: float) -> DataFrame:
    """SP24: column ``fold``: train or validation by hash of the key."""
    u = F.conv(F.substring(draw(seed, F.col(key)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("fold", F.when(u < share, "train").otherwise("validation"))
