"""Readers of the engine's inputs. Every schema is explicit; broken rows are left out, never fatal."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import text

META = "sample_id STRING, reward DOUBLE, time DOUBLE, bin_id INT, embedding_dim INT, embedding ARRAY<FLOAT>, short_hash STRING, extra_filenames ARRAY<STRING>"
REQUEST = (
    "custom_id STRING, body STRUCT<model:STRING, messages:ARRAY<STRUCT<role:STRING, content:STRING>>, contents:ARRAY<STRUCT<role:STRING, parts:ARRAY<STRUCT<text:STRING>>>>>"
)
PARTS = "array<struct<type:string,text:string,image_url:struct<url:string>>>"
CHOICES = "ARRAY<STRUCT<message:STRUCT<content:STRING>>>"
RESPONSE = f"custom_id STRING, response STRUCT<body:STRUCT<choices:{CHOICES}>, choices:{CHOICES}, text:STRING, error:STRING>"
RECORD = "id STRING, point STRING, conversations ARRAY<STRUCT<`from`:STRING, value:STRING>>"


def _samples(spark: SparkSession, folder: str, names: str) -> DataFrame:
    rows = spark.read.schema(META).option("multiLine", True).option("pathGlobFilter", names).json(folder)
    rows = rows.withColumn("path", F.col("_metadata.file_path")).where("sample_id is not null")
    return rows.withColumns({
        "reward": F.coalesce("reward", F.lit(0.0)), "time": F.coalesce("time", F.lit(0.0)), "bin_id": F.coalesce("bin_id", F.lit(-1)),
        "embedding": F.coalesce("embedding", F.array().cast("array<float>")), "short_hash": F.coalesce("short_hash", F.lit("nohash")),
        "extra_filenames": F.coalesce("extra_filenames", F.array().cast("array<string>")),
    })


def samples(spark: SparkSession, folder: str, names: str = "meta_*.json") -> DataFrame:
    """SC1: sample metas; ids are whole numbers; an id taken by an earlier file gets digits of a hash of its path appended."""
    rows = _samples(spark, folder, names).withColumn("sample_id", F.col("sample_id").try_cast("long")).where("sample_id is not null")
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy("path"))
    other = F.concat(F.col("sample_id").cast("string"), F.pmod(F.xxhash64("path"), F.lit(10000)).cast("string")).cast("long")
    return rows.withColumn("rank", rank).withColumn("sample_id", F.when(F.col("rank") > 1, other).otherwise(F.col("sample_id"))).drop("rank")


def samples_last_wins(spark: SparkSession, folder: str, names: str = "meta_*.json") -> DataFrame:
    """SC2: the second dialect: ids as they are, the last file of an id counts."""
    rows = _samples(spark, folder, names)
    return rows.groupBy("sample_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "sample_id"]), "path").alias("s")).select("sample_id", "s.*")


def view_files(spark: SparkSession, folder: str) -> DataFrame:
    """SC3, SC14: (sample_id, idx, view, path) of image names; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").option("recursiveFileLookup", True).load(folder).select("path")
    name = text.base_name(F.col("path"))
    sid = F.regexp_extract(name, r"_sid(\d+)", 1).try_cast("long")
    seen = text.view_name(name)
    return files.select(F.coalesce(sid, seen.idx).alias("sample_id"), seen.idx.alias("idx"), seen.view.alias("view"), "path")


def with_views(metas: DataFrame, views: DataFrame) -> DataFrame:
    """JN3, PF1: metas with their sorted views; those without a view are left out. SR5: views sort by lower case."""
    by = views.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("path"), "path"))), lambda s: s["path"]).alias("views"))
    return metas.join(by, "sample_id")


def _position():
    """Where a row stands: by name of the file, block of it, and row. Spark's partitions follow sizes of files, not names."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("position")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"), _position())
    return rows.where("value <> ''")


def requests(spark: SparkSession, path: str) -> DataFrame:
    """SC4: (custom_id, pos, kind, text, url): parts of the second message of each readable request."""
    rows = _lines(spark, path).select("position", F.from_json("value", REQUEST).alias("r")).where("r.custom_id <> '' and size(r.body.messages) >= 2")
    content = F.col("r.body.messages")[1]["content"]
    parts = F.coalesce(F.from_json(content, PARTS), F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url"))))
    found = rows.select("r.custom_id", F.posexplode(parts).alias("pos", "part"))
    return found.select("custom_id", "pos", F.when(F.col("part.type") == "image_url", "image").otherwise("text").alias("kind"), F.col("part.text").alias("text"), F.col("part.image_url.url").alias("url"))


def requests_of_parts(spark: SparkSession, path: str) -> DataFrame:
    """SC5: the dialect of contents and parts: (custom_id, text, one, two) with the urls of both situations."""
    rows = _lines(spark, path).select(F.from_json("value", REQUEST).alias("r")).where("r.custom_id <> ''")
    said = F.array_join(F.transform(F.flatten(F.transform(F.col("r.body.contents"), lambda c: c["parts"])), lambda p: p["text"]), "\n")
    both = text.situations(text.before_objective(said))
    return rows.select("r.custom_id", said.alias("text"), both.one.alias("one"), both.two.alias("two"))


def responses(spark: SparkSession, path: str, plain_text_first: bool = False) -> DataFrame:
    """SC6: (custom_id, analysis): the last line of an id. Choices of the body, or direct ones where the body has none.
    SC7 (plain_text_first): the text, or the body's choices where it is empty. Empty contents are left out."""
    rows = _lines(spark, path).select("position", F.from_json("value", RESPONSE).alias("r")).where("r.custom_id <> ''")
    body, direct = F.col("r.response.body.choices"), F.col("r.response.choices")
    content = F.when(F.size(body) > 0, body[0]["message"]["content"]).otherwise(F.get(direct, F.lit(0))["message"]["content"])
    if plain_text_first:
        content = F.coalesce(F.nullif("r.response.text", F.lit("")), F.get(body, F.lit(0))["message"]["content"])
    found = rows.select(F.col("r.custom_id").alias("custom_id"), content.alias("analysis"), "position").where("analysis <> ''")
    return found.groupBy("custom_id").agg(F.max_by("analysis", "position").alias("analysis"))


def decisions(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """SC8: (custom_id, decision) of a JSON array, or of lines; the last of an id counts, empty ids are left out."""
    rows = spark.read.schema("custom_id STRING, analysis STRING, decision STRING").option("multiLine", array).json(path)
    rows = rows.select("custom_id", "decision", _position()).where("custom_id <> ''")
    return rows.groupBy("custom_id").agg(F.max_by("decision", "position").alias("decision"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """SC9."""
    return spark.read.schema(RECORD).option("multiLine", True).json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """SC10, ST6: stripped lines that are not blank, of one or many files."""
    return _lines(spark, path).select("value")


def judge_results(spark: SparkSession, folder: str) -> DataFrame:
    """SC11: (file_name, question_id, evaluation_result) of a folder of JSON arrays."""
    rows = spark.read.schema("question_id STRING, evaluation_result STRING").option("multiLine", True).json(folder)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("file_name"), "question_id", "evaluation_result")


def numpy_clouds(spark: SparkSession, folder: str) -> DataFrame:
    """SC12: (path, pt, x, y, z, r, g, b) of .npy arrays with 3 columns or more; pickled arrays are refused. Colours of a file
    are divided by 255 where any is over 1."""

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim != 2 or a.shape[1] < 3:
                    continue
                a = np.pad(a[:, :6].astype(float), ((0, 0), (0, max(0, 6 - a.shape[1]))))
                if a.size and a[:, 3:].max() > 1:
                    a[:, 3:] /= 255.0
                yield pd.DataFrame(a, columns=list("xyzrgb")).assign(path=path, pt=range(len(a)))[["path", "pt", *"xyzrgb"]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(folder).select("path", "content")
    return files.mapInPandas(read, "path string, pt int, x double, y double, z double, r double, g double, b double")


def cached_labels(spark: SparkSession, path: str) -> DataFrame:
    """SC13: cached label batches, in order of file; Parquet, never pickles."""
    return spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path")).orderBy("file")


def source_files(spark: SparkSession, folder: str, suffix: str = ".py") -> DataFrame:
    """SC15: each file with a header line of its path."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return rows.select(path.alias("path"), F.concat(F.lit("# file: "), path, F.lit("\n"), F.col("value")).alias("text"))


def merged_config(base: dict, new: dict) -> dict:
    """SC16: nested settings, the new ones first. Runs on the driver; settings are not data."""
    out = dict(base)
    for k, v in new.items():
        out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
