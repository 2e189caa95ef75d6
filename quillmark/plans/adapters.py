"""The driver's tables as the engine's domain tables; each rule stands once as DataFrame code and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.common import table

#: Replies that reach every rule of the parsers.
REPLIES = (
    "Conclusion: 1", "**Conclusion**: -1", "text\n**0**", "**0** then **1**", "- -1", "no digits", "1", "so\n -1 \nend", "* 0", "- '1'", "The answer is 0.",
    "first **1** last **1**", "conclusion 0\nmore\n1", "x 10 y", "**-1**", "maybe 0 or 1",
)
#: File names of the kinds in use.
NAMES = (
    "pc_005692_bin_2_r_3.56_t_6304.00_emb_e2a0ed5a_sid5692.jpg", "pc_000253_bin_2_r_4.61_t_253.00_emb_add61616_view2.jpg", "pc_000001_bin_0_r_-0.50_t_1.00_emb_aa.jpg",
    "pc_7_bin_1_r_1_t_2.5_emb_Ab9.jpg",
)


def samples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "value")
    v = table(spark, d, "embeddings")
    return v.join(e, v["vec_id"] == e["event_id"]).select(F.col("vec_id").alias("sample_id"), F.col("label").alias("bin_id"), "embedding", F.col("value").alias("reward"), F.col("vec_id").cast("double").alias("time"))


SAMPLES = "samples AS (SELECT vec_id AS sample_id, label AS bin_id, embedding, value AS reward, vec_id::DOUBLE AS time FROM embeddings JOIN events ON event_id = vec_id)"


def states(spark: SparkSession, d: str) -> DataFrame:
    """Events as states of three numbers."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.array("value", (F.col("user_id") % 97).cast("double"), minute / F.lit(20.0)).alias("embedding"))


STATES = "states AS (SELECT event_id AS id, value AS x, (user_id % 97)::DOUBLE AS y, (hour(ts) * 60 + minute(ts)) / 20.0::DOUBLE AS z FROM events)"


def transitions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = (F.row_number().over(order) - 1).alias("t")
    done = (F.lead("event_id").over(order).isNull()).alias("done")
    return e.select(F.col("user_id").alias("traj_id"), t, F.col("value").alias("reward"), done, "event_id", "event_type")


TRANSITIONS = """transitions AS (SELECT user_id AS traj_id, row_number() OVER o - 1 AS t, value AS reward,
  lead(event_id) OVER o IS NULL AS done, event_id, event_type FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _pick(values: tuple, number):
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


def _list(values: tuple) -> str:
    quoted = ["'" + v.replace("'", "''").replace("\n", "'||chr(10)||'") + "'" for v in values]
    return "[" + ", ".join(quoted) + "]"


def responses(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id")
    return e.select("event_id", F.concat(F.lit("e-"), F.col("event_id").cast("string")).alias("custom_id"), _pick(REPLIES, F.col("event_id")).alias("analysis"))


RESPONSES = f"responses AS (SELECT event_id, 'e-' || event_id AS custom_id, {_list(REPLIES)}[event_id % {len(REPLIES)} + 1] AS analysis FROM events)"


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", _pick(NAMES, F.col("event_id")).alias("name"))


FILES = f"files AS (SELECT event_id, {_list(NAMES)}[event_id % {len(NAMES)} + 1] AS name FROM events)"

DECISIONS = ("0", "1", "-1", "")


def decisions(spark: SparkSession, d: str, flipped: bool) -> DataFrame:
    e = table(spark, d, "events").select("event_id")
    number = F.expr("event_id * 7 + event_id div 5") if flipped else F.col("event_id")
    rows = e.where(F.col("event_id") % (13 if flipped else 11) != 0)
    return rows.select(F.concat(F.lit("e-"), F.col("event_id").cast("string")).alias("custom_id"), _pick(DECISIONS, number).alias("decision"))


DECISIONS_SQL = f"""b AS (SELECT 'e-' || event_id AS custom_id, {_list(DECISIONS)}[event_id % 4 + 1] AS decision FROM events WHERE event_id % 11 <> 0),
f AS (SELECT 'e-' || event_id AS custom_id, {_list(DECISIONS)}[(event_id * 7 + event_id // 5) % 4 + 1] AS decision FROM events WHERE event_id % 13 <> 0)"""

FILE_NAMES = ("llama31r1_8b_cot_think_a", "llama31r1_8b_cot_unthink_b", "llama31_8b_nocot_c", "llama31_8b_cot_think_d", "other")


def eval_results(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    rows = table(spark, d, "labels").join(docs, "doc_id")
    body = F.format_string('{"Truthfulness": {"Score": "%d", "Explanation": "x"}, "Completeness": {"Score": "%d"}, "Object Recognition": {"Score": "N/A"}}', F.col("quality") * 3 + F.col("doc_id") % 3, F.col("toxic") + F.col("doc_id") % 5)
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Result:\n```json\n"), body, F.lit("\n```\n"))).when(F.col("doc_id") % 7 == 1, "{broken").otherwise(body)
    return rows.select(F.col("doc_id").cast("string").alias("question_id"), _pick(FILE_NAMES, F.col("doc_id")).alias("file_name"), text.alias("evaluation_result"))


EVAL_RESULTS = f"""eval_results AS (SELECT doc_id::VARCHAR AS question_id, {_list(FILE_NAMES)}[doc_id % 5 + 1] AS file_name,
  CASE WHEN doc_id % 3 = 0 OR doc_id % 7 <> 1 THEN quality * 3 + doc_id % 3 END AS t, CASE WHEN doc_id % 3 = 0 OR doc_id % 7 <> 1 THEN toxic + doc_id % 5 END AS c
  FROM labels JOIN documents USING (doc_id)),
scored AS (SELECT file_name, question_id, 'Truthfulness' AS metric, t::DOUBLE AS score FROM eval_results WHERE t IS NOT NULL
  UNION ALL SELECT file_name, question_id, 'Completeness', c::DOUBLE FROM eval_results WHERE c IS NOT NULL),
stats AS (SELECT file_name, metric, avg(score) AS mean, round(stddev_pop(score), 2) AS std, count(*) AS n FROM scored GROUP BY ALL),
named AS (SELECT *, CASE WHEN file_name LIKE 'llama31r1%' THEN 'DeepSeek-R1-Distill-Llama-8B' WHEN file_name = 'other' THEN 'other' ELSE 'Llama-3.1-8B-Instruct' END AS model,
  CASE WHEN file_name LIKE '%nocot%' THEN 'No CoT' WHEN file_name LIKE '%unthink%' THEN 'Unmarked CoT' WHEN file_name = 'other' THEN '' ELSE 'Tagged CoT' END AS annotation,
  CASE WHEN file_name LIKE 'llama31r1%' THEN 'LRM' WHEN file_name = 'other' THEN 'Unknown' ELSE 'LLM' END AS category FROM stats)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return rows.select(F.col("l_suppkey").alias("cloud_id"), F.row_number().over(order).alias("pt"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))


POINTS = """points AS (SELECT l_suppkey AS cloud_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)::INT AS pt,
  l_quantity AS x, l_extendedprice AS y, l_discount AS z FROM lineitem)"""


def conversations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    who = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    turn = F.struct("turn", who.alias("from"), F.col("text").alias("value"))
    nested = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("c"))
    return nested.select(F.col("conv_id").cast("string").alias("id"), F.transform("c", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"))


TURNS = """turns AS (SELECT conv_id::VARCHAR AS id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, text) - 1)::INT AS pos,
  CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS who, text AS value FROM conversations)"""
