"""Writers of the engine's outputs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.operators import decisions

URL = "/v1/chat/completions"


def _numbered(pairs: DataFrame, order: str, environment: str) -> DataFrame:
    """custom_id ``environment-N``, N from 1 in order."""
    placed = decisions.chunked(pairs, order, 1 << 40)
    return placed.withColumn("custom_id", F.concat(F.lit(f"{environment}-"), (F.col("line") + 1).cast("string"))).drop("chunk", "line")


def pair_requests(pairs: DataFrame, order: str, environment: str, model: str, system: str, parts: Column, max_tokens: int = 1024, temperature: float = 0.0) -> DataFrame:
    """SK1: (custom_id, value): JSON requests with a system message and a list of parts."""
    content = F.struct(F.lit("user").alias("role"), parts.alias("content"))
    body = F.struct(
        F.lit(model).alias("model"), F.array(F.to_json(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), F.to_json(content)).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature"),
    )
    rows = _numbered(pairs, order, environment).withColumn("__body", body)
    # messages differ in shape, so each is JSON already and is put in as it is
    whole = F.concat(
        F.lit('{"custom_id":'), F.to_json(F.struct("custom_id")).substr(F.lit(14), F.length(F.to_json(F.struct("custom_id"))) - 14), F.lit(f',"method":"POST","url":"{URL}","body":{{"model":'),
        F.lit(f'"{model}"'), F.lit(',"messages":['), F.array_join("__body.messages", ","), F.lit(f'],"max_tokens":{max_tokens},"temperature":{temperature}}}}}'),
    )
    return rows.select("custom_id", whole.alias("value"))


def prompt_requests(pairs: DataFrame, order: str, environment: str, prompt: Column) -> DataFrame:
    """SK2: one combined prompt in the dialect of contents and parts."""
    part = F.struct(F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.col("__prompt").alias("text"))).alias("parts"))).alias("contents"))
    rows = _numbered(pairs.withColumn("__prompt", prompt), order, environment)
    return rows.select("custom_id", F.to_json(F.struct("custom_id", part.alias("body"))).alias("value"))


def rewrite_requests(tasks: DataFrame, model: str, system: str) -> DataFrame:
    """SK3: a request a rewrite task (custom_id, value)."""
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(said("system", F.lit(system)), said("user", F.col("value"))).alias("messages"))
    return tasks.select("custom_id", F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit(URL).alias("url"), body.alias("body"))).alias("value"))


def write_chunks(rows: DataFrame, order: str, size: int, folder: str) -> None:
    """SK4: text files of ``size`` lines, a folder a chunk."""
    decisions.chunked(rows, order, size).select("value", "chunk").sortWithinPartitions("chunk").write.partitionBy("chunk").text(folder)


def write_merged(rows: DataFrame, folder: str) -> None:
    """SK5, SR3: JSON lines by id as text."""
    rows.orderBy("custom_id").write.json(folder)


def write_csv(table: DataFrame, folder: str) -> None:
    """SK6: with a header and the byte-order mark that spreadsheets look for."""
    first = table.columns[0]
    table.withColumnRenamed(first, "﻿" + first).write.option("header", True).csv(folder)


def write_view_pairs(pairs: DataFrame, folder: str) -> None:
    """SK7: a folder a view."""
    pairs.write.partitionBy("view").option("header", True).csv(folder)


def append_metrics(rows: DataFrame, folder: str) -> None:
    """SK8: (step, key, value, n) appended; columns come at read, by ``evaluation.meters_wide``, so new keys rewrite nothing."""
    rows.select("step", "key", "value", "n").write.mode("append").parquet(folder)


def write_samples(metas: DataFrame, folder: str) -> None:
    """SK9, SK10: sample metas as a table by bin; pixels and points stay where they are."""
    metas.write.partitionBy("bin_id").parquet(folder)


def append_prompts(rows: DataFrame, folder: str) -> None:
    """SK18: prompts with the time of writing."""
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(folder)


def ply(clouds: DataFrame) -> DataFrame:
    """SK11: (cloud_id, value): ASCII PLY text of each cloud (cloud_id, pt, x, y, z, r, g, b; colours 0 to 1)."""

    def text_of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"cloud_id": pdf["cloud_id"], "value": [_HEAD.format(len(p)) + "".join(p) for p in pdf["lines"]]})

    color = [F.least(F.greatest(F.round(F.col(c) * 255), F.lit(0)), F.lit(255)).cast("int") for c in "rgb"]
    line = F.format_string("%s %s %s %d %d %d\n", *[F.col(c).cast("string") for c in "xyz"], *color)
    rows = clouds.groupBy("cloud_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pt", line.alias("line")))), lambda s: s["line"]).alias("lines"))
    return rows.mapInPandas(text_of, "cloud_id long, value string")


_HEAD = "ply\nformat ascii 1.0\nelement vertex {}\n" + "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + "end_header\n"


def encoded(images: DataFrame) -> DataFrame:
    """SK13, SF25: (path, uri) of stored images; resizing is outside the engine."""
    return images.select("path", text.data_uri(F.col("path"), F.col("content")).alias("uri"))
