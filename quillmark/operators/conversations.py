"""Conversation records (id, conversations: array of struct(from, value, rewritten))."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rewrite_tasks(records: DataFrame) -> DataFrame:
    """PF8: a task for each answer that is not blank: (custom_id ``id_turn``, id, pos, value)."""
    turns = records.select("id", F.posexplode("conversations").alias("pos", "turn"))
    rows = turns.where((F.col("turn.from") == "gpt") & (F.trim("turn.value") != ""))
    return rows.select(F.concat_ws("_", "id", "pos").alias("custom_id"), "id", "pos", F.col("turn.value").alias("value"))


def capped(tasks: DataFrame, most: int) -> DataFrame:
    """SR8: the first tasks in order."""
    return tasks.orderBy("id", "pos").limit(most)


def merged_back(records: DataFrame, results: DataFrame) -> DataFrame:
    """JN7: each answer's ``rewritten`` from results (id, pos, rewritten), null where there is none; records keep their order of turns."""
    by_record = results.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "rewritten"))).alias("__new"))
    new = lambda turn, pos: F.struct(turn["from"].alias("from"), turn["value"].alias("value"), F.try_element_at("__new", pos).alias("rewritten"))
    return records.join(by_record, "id", "left").withColumn("conversations", F.transform("conversations", new)).drop("__new")
