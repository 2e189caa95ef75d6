"""Registered queries of sources, sinks and small functions: files are written from the driver's tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.common import shared_dir, table
from quillmark.functions import maths, text, vectors
from quillmark.operators import conversations, evaluation, points, preferences, trajectories
from quillmark.plans import adapters as A
from quillmark.plans.catalogue import query
from quillmark.sources import scans, sinks


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _i(spark, d, *more):
    return table(spark, d, "events").select("event_id", *more), F.col("event_id")


# --- requests and responses


@query("""SELECT 'env-' || row_number() OVER (ORDER BY event_id) AS custom_id, 'Is ' || event_type || ' better?' AS text, 'http://x/' || event_id || '.jpg' AS url FROM events""")
def request_ids(spark, d):
    """SK1, SC4: pair requests written as lines and read again, the parts side by side."""
    e, i = _i(spark, d, "event_type")
    part = lambda kind, said, url: F.struct(F.lit(kind).alias("type"), said.alias("text"), F.struct(url.alias("url")).alias("image_url"))
    none = F.lit(None).cast("string")
    parts = F.array(part("text", F.concat(F.lit("Is "), F.col("event_type"), F.lit(" better?")), none), part("image_url", none, F.concat(F.lit("http://x/"), i.cast("string"), F.lit(".jpg"))))
    at = _folder(spark, "requests")
    sinks.pair_requests(e, "event_id", "env", "model", "You compare.", parts).select("value").write.text(at)
    rows = scans.requests(spark, at)
    return rows.groupBy("custom_id").agg(F.max(F.when(F.col("kind") == "text", F.col("text"))).alias("text"), F.max("url").alias("url"))


@query("""SELECT 'p-' || row_number() OVER (ORDER BY event_id) AS custom_id, event_id::VARCHAR || '.jpg' AS one, (event_id + 1)::VARCHAR || '.jpg' AS two FROM events""")
def prompt_request_ids(spark, d):
    """SK2, SC5, SF9, SF10: requests of one prompt, read back with the urls of both situations."""
    e, i = _i(spark, d)
    prompt = F.concat(F.lit("Situation 1: "), i.cast("string"), F.lit(".jpg Situation 2: "), (i + 1).cast("string"), F.lit(".jpg Objective: open"))
    at = _folder(spark, "prompts")
    sinks.prompt_requests(e, "event_id", "p", prompt).select("value").write.text(at)
    return scans.requests_of_parts(spark, at).select("custom_id", F.col("one")[0].alias("one"), F.col("two")[0].alias("two"))


@query("SELECT event_id // 700 AS chunk, count(*) AS n, min(event_id::VARCHAR) AS least FROM events GROUP BY ALL")
def chunk_files(spark, d):
    """SK4: files of 700 lines each, counted from what was written."""
    e, i = _i(spark, d)
    at = _folder(spark, "chunks")
    sinks.write_chunks(e.withColumn("value", i.cast("string")), "event_id", 700, at)
    return spark.read.text(at).groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n"), F.min("value").alias("least"))


@query(f"WITH {A.RESPONSES} SELECT custom_id, analysis FROM responses WHERE event_id % 5 <> 0 UNION ALL SELECT custom_id, 'direct ' || event_id FROM responses WHERE event_id % 5 = 0")
def response_scan(spark, d):
    """SC6: replies in the body's choices, or direct ones where it has none."""
    r = A.responses(spark, d)
    said = lambda c: F.array(F.struct(F.struct(c.alias("content")).alias("message")))
    direct = F.col("event_id") % 5 == 0
    body = F.struct(F.when(~direct, said(F.col("analysis"))).alias("choices"))
    answer = F.struct(body.alias("body"), F.when(direct, said(F.concat(F.lit("direct "), F.col("event_id").cast("string")))).alias("choices"))
    at = _folder(spark, "responses")
    r.select("custom_id", answer.alias("response")).write.json(at)
    return scans.responses(spark, at)


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'x' ELSE 'plain ' || event_id END AS analysis FROM events")
def response_scan_plain(spark, d):
    """SC7: the text, or the body's choices where it is empty."""
    e, i = _i(spark, d)
    body = F.struct(F.array(F.struct(F.struct(F.lit("x").alias("content")).alias("message"))).alias("choices"))
    plain = F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("plain "), i.cast("string")))
    at = _folder(spark, "responses")
    e.select(i.cast("string").alias("custom_id"), F.struct(body.alias("body"), plain.alias("text")).alias("response")).write.json(at)
    return scans.responses(spark, at, True).select(F.col("custom_id").cast("long").alias("event_id"), "analysis")


@query(f"WITH {A.DECISIONS_SQL} SELECT custom_id, decision FROM b")
def decision_scan(spark, d):
    """SK5, SC8: merged decisions written in order of id and read again."""
    at = _folder(spark, "decisions")
    sinks.write_merged(A.decisions(spark, d, False).withColumn("analysis", F.lit("why")), at)
    return scans.decisions(spark, at, array=False)


@query(f"WITH {A.TURNS} SELECT id || '_' || pos AS custom_id, value AS text FROM turns WHERE who = 'gpt' AND trim(value, ' ') <> ''")
def rewrite_request_scan(spark, d):
    """SK3, SC4: rewrite requests as lines; the second message is the turn."""
    at = _folder(spark, "rewrites")
    sinks.rewrite_requests(conversations.rewrite_tasks(A.conversations(spark, d)), "model", "Rewrite.").select("value").write.text(at)
    return scans.requests(spark, at).select("custom_id", "text")


@query("SELECT event_type || ' ' || event_id AS value FROM events WHERE event_id % 3 <> 0")
def line_scan(spark, d):
    """SC10: stripped lines, blank ones left out."""
    e, i = _i(spark, d, "event_type")
    at = _folder(spark, "lines")
    e.select(F.when(i % 3 == 0, "   ").otherwise(F.concat(F.lit("  "), F.col("event_type"), F.lit(" "), i.cast("string"), F.lit(" "))).alias("value")).write.text(at)
    return scans.text_lines(spark, at)


@query(f"WITH {A.TURNS} SELECT id, count(*) AS n FROM turns GROUP BY id")
def record_scan(spark, d):
    """SC9: conversation records as JSON."""
    at = _folder(spark, "records")
    A.conversations(spark, d).withColumn("point", F.lit("p")).write.json(at)
    return spark.read.schema(scans.RECORD).json(at).select("id", F.size("conversations").cast("long").alias("n"))


# --- tables


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def csv_report(spark, d):
    """SK6: with the mark that spreadsheets look for."""
    at = _folder(spark, "csv")
    sinks.write_csv(table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n")), at)
    back = spark.read.option("header", True).csv(at)
    return back.select(F.col(back.columns[0]).alias("kind"), F.col("n").cast("long").alias("n"))


@query("SELECT event_type AS view, event_id FROM events")
def view_pair_files(spark, d):
    """SK7: a folder a view."""
    at = _folder(spark, "views")
    sinks.write_view_pairs(table(spark, d, "events").select("event_id", F.col("event_type").alias("view")), at)
    return spark.read.option("header", True).csv(at).select("view", F.col("event_id").cast("long").alias("event_id"))


@query("SELECT date_trunc('day', ts)::DATE AS step, round(avg(value) FILTER (WHERE event_id % 2 = 0), 6) AS even, round(avg(value) FILTER (WHERE event_id % 2 = 1), 6) AS odd FROM events GROUP BY ALL")
def metric_appends(spark, d):
    """SK8: metrics appended by two writers, wide at read."""
    at = _folder(spark, "metrics")
    e = table(spark, d, "events").select(F.to_date("ts").alias("step"), "event_id", "value", F.lit(1).alias("n"))
    for left, key in ((0, "train/even"), (1, "train/odd")):
        sinks.append_metrics(e.where(F.col("event_id") % 2 == left).withColumn("key", F.lit(key)), at)
    return evaluation.meters_wide(spark.read.parquet(at), ["even", "odd"])


@query(f"WITH {A.SAMPLES} SELECT bin_id, count(*) AS n, min(sample_id) AS least FROM samples GROUP BY bin_id")
def sample_files(spark, d):
    """SK9, SK10: sample metas by bin."""
    at = _folder(spark, "samples")
    sinks.write_samples(A.samples(spark, d), at)
    return spark.read.parquet(at).groupBy("bin_id").agg(F.count("*").alias("n"), F.min("sample_id").alias("least"))


@query("""WITH s AS (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS pt, s_nationkey AS cloud_id FROM supplier)
SELECT cloud_id, 'ply' || chr(10) || 'format ascii 1.0' || chr(10) || 'element vertex ' || count(*) || chr(10) || 'property float x' || chr(10) || 'property float y' || chr(10) || 'property float z' || chr(10) || 'property uchar red' || chr(10) || 'property uchar green' || chr(10) || 'property uchar blue' || chr(10) || 'end_header' || chr(10)
  || string_agg(s_suppkey || ' ' || pt || ' 1 255 0 51' || chr(10), '' ORDER BY pt) AS value FROM s GROUP BY cloud_id""")
def ply_text(spark, d):
    """SK11: one ASCII cloud a nation."""
    order = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("cloud_id"), order.alias("pt"), F.col("s_suppkey").alias("x"))
    return sinks.ply(s.select("cloud_id", "pt", "x", F.col("pt").alias("y"), F.lit(1).alias("z"), F.lit(1.5).alias("r"), F.lit(-1.0).alias("g"), F.lit(0.2).alias("b")))


# --- expressions


@query(f"WITH {A.FILES} SELECT event_id, 'a/b/' || name AS url, name AS base, regexp_extract(name, '^pc_(\\d+)_', 1)::BIGINT AS idx, regexp_extract(name, '_view(\\w+)\\.jpg$', 1) AS view, regexp_replace(name, '_view[A-Za-z0-9]+', '', 'g') AS clean, regexp_replace(name, '_bin_\\d+', '_bin_9', 'g') AS moved, left(md5(name), 8) AS digest FROM files")
def file_name_parts(spark, d):
    """SF7, SF8, SF20, SF21."""
    f = A.files(spark, d).withColumn("url", F.concat(F.lit("a/b/"), F.col("name")))
    seen = text.view_name(F.col("name"))
    return f.select("event_id", "url", text.base_name(F.col("url")).alias("base"), seen.idx.alias("idx"), seen.view.alias("view"), text.clean_file_name(F.col("name")).alias("clean"), text.moved_to_bin(F.col("name"), F.lit(9)).alias("moved"), text.short_digest(F.col("name")).alias("digest"))


@query("SELECT conv_id, turn, string_split(text, chr(10))[1] AS first, string_split(text, chr(10))[-1] AS last FROM conversations")
def reply_lines(spark, d):
    """SF23."""
    return table(spark, d, "conversations").select("conv_id", "turn", text.first_line(F.col("text")).alias("first"), text.last_line(F.col("text")).alias("last"))


@query("SELECT event_id, 'data:image/' || CASE event_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' ELSE 'gif' END || ';base64,' || base64(event_type::BLOB) AS uri, '<geom rgba=\"1 0 0 0.3\" n=\"' || event_id || '\"/>' AS xml FROM events")
def encoded_parts(spark, d):
    """SK13, SF25, SF28."""
    e, i = _i(spark, d, "event_type")
    path = F.concat(F.lit("f."), F.when(i % 3 == 0, "png").when(i % 3 == 1, "JPG").otherwise("gif"))
    images = e.select("event_id", path.alias("path"), F.col("event_type").cast("binary").alias("content"))
    xml = F.concat(F.lit('<geom rgba="1 0 0 1" n="'), i.cast("string"), F.lit('"/>'))
    return images.select("event_id", text.data_uri(F.col("path"), F.col("content")).alias("uri"), text.with_alpha(xml, "0.3").alias("xml"))


@query("SELECT event_id, round(1 - CASE WHEN x BETWEEN 0 AND 0.3::DOUBLE THEN 1 WHEN abs(dd) < 1 THEN 1 - dd ELSE 0 END, 9) AS v FROM (SELECT *, (CASE WHEN x < 0 THEN -x ELSE x - 0.3::DOUBLE END) / 0.8::DOUBLE AS dd FROM (SELECT event_id, value / 50 - 0.5::DOUBLE AS x FROM events))")
def inverse_tolerance(spark, d):
    """MF3, with a curve that reaches zero."""
    e, _ = _i(spark, d, "value")
    return e.select("event_id", F.round(maths.inverse_tolerance(F.col("value") / 50 - 0.5, (0.0, 0.3), 0.8, "linear"), 9).alias("v"))


@query("SELECT event_id, round(least(greatest(-2 + ((event_id % 9) / 4.0::DOUBLE - 1 + 1) * 0.5 * 5, -2), 3), 6) AS action, round((event_id % 7 - event_id % 5) * 10.0::DOUBLE, 6) AS pull, 40 AS same, floor(40 * CASE WHEN s = 2000 THEN 0.01::DOUBLE ELSE (2000 - s) / 2000::DOUBLE END)::INT AS falling, floor(40 * (2000::DOUBLE / (2000 - s + 1)))::INT AS rising, greatest(0, least(40, 30000 - event_id))::INT AS within, round(value * (50 / 500::DOUBLE) * 0.1::DOUBLE, 6) AS margin FROM (SELECT *, event_id % 2001 AS s FROM events)")
def control_values(spark, d):
    """MF15, MF16, MF17."""
    e, i = _i(spark, d, "value")
    step = i % 2001
    budgets = [maths.label_budget(k, 40, step, 2000).alias(n) for k, n in enumerate(("same", "falling", "rising"))]
    return e.select("event_id", F.round(maths.scaled_action((i % 9) / 4.0 - 1, F.lit(-2.0), F.lit(3.0)), 6).alias("action"), F.round(maths.controller([i % 5], [i % 7], 10.0)[0], 6).alias("pull"), *budgets, maths.labels_left(F.lit(40), i, 30_000).cast("int").alias("within"), F.round(maths.teacher_margin(F.col("value"), 50, 500, 0.1), 6).alias("margin"))


_CAGE = """c AS (SELECT event_id, (event_id % 7) / 10.0::DOUBLE AS ox, (event_id % 11) / 20.0::DOUBLE AS oy, (event_id % 3) / 30.0::DOUBLE AS oz, (event_id % 5) / 4.0::DOUBLE AS effort FROM events),
s AS (SELECT *, abs(oy - 0.02::DOUBLE - oy) AS l, abs(oy + 0.03::DOUBLE - oy) AS r, abs(abs(oy - 0.02::DOUBLE - 0.4::DOUBLE) - 0.05::DOUBLE) AS ml, abs(abs(oy + 0.03::DOUBLE - 0.4::DOUBLE) - 0.05::DOUBLE) AS mr, sqrt(power(ox + 0.01::DOUBLE - ox, 2) + power(oz + 0.02::DOUBLE - oz, 2)) AS xz, sqrt(0.01::DOUBLE + 0.04::DOUBLE) - 0.005::DOUBLE AS mxz FROM c),
t AS (SELECT *, CASE WHEN l BETWEEN 0.013 AND 0.05 THEN 1 ELSE 1 / (9 * power((CASE WHEN l < 0.013 THEN 0.013::DOUBLE - l ELSE l - 0.05::DOUBLE END) / ml, 2) + 1) END AS a, CASE WHEN r BETWEEN 0.013 AND 0.05 THEN 1 ELSE 1 / (9 * power((CASE WHEN r < 0.013 THEN 0.013::DOUBLE - r ELSE r - 0.05::DOUBLE END) / mr, 2) + 1) END AS b,
  CASE WHEN xz <= 0.005 THEN 1 ELSE 1 / (9 * power((xz - 0.005::DOUBLE) / mxz, 2) + 1) END AS o FROM s), u AS (SELECT *, a * b / (a + b - a * b) AS y FROM t), v AS (SELECT *, y * o / (y + o - y * o) AS caged FROM u),
w AS (SELECT *, CASE WHEN caged > 0.97 THEN least(greatest(effort, 0), 1) ELSE 0 END AS grip FROM v)"""


@query(f"WITH {_CAGE} SELECT event_id, round(CASE WHEN caged + grip - caged * grip > 0 THEN caged * grip / (caged + grip - caged * grip) ELSE 0 END, 6) AS held, round(((CASE WHEN caged + grip - caged * grip > 0 THEN caged * grip / (caged + grip - caged * grip) ELSE 0 END) + caged) / 2, 6) AS dense FROM w")
def caging_reward(spark, d):
    """MF6, plain and of high density."""
    e, i = _i(spark, d)
    obj = [(i % 7) / 10.0, (i % 11) / 20.0, (i % 3) / 30.0]
    tcp = [obj[0] + 0.01, obj[1], obj[2] + 0.02]
    start, tcp_start = [F.lit(0.0), F.lit(0.4), F.lit(0.0)], [F.lit(0.1), F.lit(0.6), F.lit(0.2)]
    held = lambda density: F.round(maths.caging((i % 5) / 4.0, obj, start, (obj[1] - 0.02, obj[1] + 0.03), tcp, tcp_start, 0.013, 0.05, 0.005, density=density), 6)
    return e.select("event_id", held("").alias("held"), held("high").alias("dense"))


@query("""WITH o AS (SELECT event_id, (event_id % 7) / 10.0::DOUBLE - 0.3 AS x, (event_id % 11) / 12.0::DOUBLE AS y, (event_id % 4) / 3.0::DOUBLE AS g FROM events),
a AS (SELECT *, sqrt(9 * x * x + power(y - 0.8, 2)) AS away, sqrt(9 * power(x - 0.1, 2) + power(y - 0.6, 2)) AS margin FROM o), p AS (SELECT *, CASE WHEN away <= 0.07 THEN 1 WHEN margin = 0 THEN 0 ELSE 1 / (9 * power((away - 0.07) / margin, 2) + 1) END AS p0 FROM a),
q AS (SELECT *, CASE WHEN y > 0.8::DOUBLE - 0.1::DOUBLE AND abs(x) > 0.1 THEN least(greatest(p0 - 2 * (y - (0.8::DOUBLE - 0.1::DOUBLE)) / (1 - (0.8::DOUBLE - 0.1::DOUBLE)), 0), 1) ELSE p0 END AS placed FROM p)
SELECT event_id, round(CASE WHEN away < 0.07 THEN 10 ELSE 3 * g + 6.5 * placed END, 6) AS reward, round(placed, 6) AS placed, (sqrt(x * x + power(y - 0.8, 2)) <= 0.07)::INT::DOUBLE AS success FROM q""")
def ball_reward(spark, d):
    """MF7."""
    e, i = _i(spark, d)
    obj, target, start = [(i % 7) / 10.0 - 0.3, (i % 11) / 12.0, F.lit(0.0)], [F.lit(0.0), F.lit(0.8), F.lit(0.0)], [F.lit(0.1), F.lit(0.6), F.lit(0.0)]
    reward, _, placed, success = maths.ball_reward(obj, start, target, (i % 4) / 3.0)
    return e.select("event_id", F.round(reward, 6).alias("reward"), F.round(placed, 6).alias("placed"), success.alias("success"))


@query("""WITH o AS (SELECT event_id, (event_id % 7) / 100.0::DOUBLE AS x, (event_id % 5) / 100.0::DOUBLE AS z, event_id % 3 <> 0 AS touching, (event_id % 4) / 4.0::DOUBLE AS opened FROM events)
SELECT event_id, (sqrt(power(x - 0.02::DOUBLE, 2) + power(z - 0.01::DOUBLE, 2)) <= 0.03::DOUBLE)::INT::DOUBLE AS near, (touching AND opened > 0 AND z - 0.02::DOUBLE > 0.005::DOUBLE)::INT::DOUBLE AS grasped FROM o""")
def ball_grip(spark, d):
    """MF7, whether the ball is near and grasped."""
    e, i = _i(spark, d)
    obj, none = [(i % 7) / 100.0, F.lit(0.0), (i % 5) / 100.0], F.lit(0.0)
    near, grasped = maths.ball_grip(obj, [none, none, F.lit(0.005)], [F.lit(0.02), none, F.lit(0.01)], i % 3 != 0, (i % 4) / 4.0)
    return e.select("event_id", near.alias("near"), grasped.alias("grasped"))


@query("""WITH v AS (SELECT event_id, [event_id % 5 + 1, -(event_id % 7) - 10, event_id % 3 + 30] AS v FROM events), p AS (SELECT unnest([[1, 2, 3], [2, 3, 1], [3, 1, 2], [1, 3, 2], [3, 2, 1], [2, 1, 3]]) AS p, unnest([1, 1, 1, -1, -1, -1]) AS parity),
s AS (SELECT a, b, c FROM (SELECT unnest([1, -1]) AS a), (SELECT unnest([1, -1]) AS b), (SELECT unnest([1, -1]) AS c))
SELECT event_id, a * v[p[1]] AS x, b * v[p[2]] AS y, c * v[p[3]] AS z FROM v, p, s WHERE a * b * c = parity""")
def parallel_rotations(spark, d):
    """MF14: a vector under the 24 rotations that turn axes into axes."""
    e, i = _i(spark, d)
    v = [i % 5 + 1, -(i % 7) - 10, i % 3 + 30]
    # a row of such a matrix has one number that is not 0, and that is 1 or -1
    at = lambda row: next(v[j] if row[j] == 1 else -v[j] for j in range(3) if row[j])
    turned = F.array(*[F.struct(*[at(m[a]).alias(c) for a, c in enumerate("xyz")]) for m in maths.parallel_rotations()])
    return e.select("event_id", F.explode(turned).alias("r")).select("event_id", "r.x", "r.y", "r.z")


# --- preferences, arrays, samples


@query("SELECT event_id, 1 - event_id % 2 AS label, -(event_id % 9) / 3.0::DOUBLE AS score FROM events")
def flipped_labels(spark, d):
    """PF6."""
    e, i = _i(spark, d)
    return preferences.flipped_scores(preferences.flipped_labels(e.select("event_id", (i % 2).alias("label"), ((i % 9) / 3.0).alias("score"))))


@query("SELECT event_id, [event_id, event_id + 1] AS hand, [event_id + 2] AS grip, [event_id + 3, event_id + 4, event_id + 5] AS obj FROM events")
def observation_fields(spark, d):
    """PF15."""
    e, i = _i(spark, d)
    parts = vectors.fields(F.sequence(i, i + 5), {"hand": 2, "grip": 1, "obj": 3})
    return e.select("event_id", parts.alias("f")).select("event_id", "f.hand", "f.grip", "f.obj")


@query("SELECT event_id, [event_id * 100 + 22, event_id * 100 + 23] AS crop, event_id * 100 + 40 AS flipped, [event_id, event_id + 3] AS strided FROM events")
def image_crop(spark, d):
    """PF12: pixels are numbered by row and column."""
    e, i = _i(spark, d)
    image = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda x: i * 100 + y * 10 + x))
    crop = vectors.cropped(image, 2, 3, 2, 4)
    return e.select("event_id", crop[0].alias("crop"), vectors.upside_down(image)[0][0].alias("flipped"), vectors.every_nth(F.sequence(i, i + 5), 3).alias("strided"))


@query("SELECT event_id, 3 AS height, 3 AS width, (event_id % 4 + 1)::INT AS blank FROM events")
def colour_crop(spark, d):
    """PF16: 3 by 3 pixels around the one of the colour; pixels outside bounds are blank."""
    e, i = _i(spark, d)
    rgb = lambda r, g, b: F.struct(r.alias("r"), g.alias("g"), b.alias("b"))
    pixel = lambda x, y: F.when((y == F.col("at")) & (x == F.col("at")), rgb(F.lit(129), F.lit(132), F.lit(203))).otherwise(rgb(F.lit(1), y, x))
    image = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: pixel(x, y)))
    # there are as many images as places of the colour (of negative and null ids, none); each is drawn once, and cut for every event
    images = spark.range(-2, 6).select(F.when(F.col("id") < 5, F.col("id")).alias("at")).withColumn("image", image).withColumnRenamed("at", "shown")
    e = e.withColumn("at", i % 4 + 1).join(F.broadcast(images), F.col("at").eqNullSafe(F.col("shown"))).select("event_id", "image")
    cut = vectors.around_colour(F.col("image"), (129, 132, 203), 1, 2, 1, 2)
    kept = vectors.blanked(F.col("image"), (129, 0, 0), (129, 255, 255))
    e = e.select("event_id", cut.alias("cut"), F.transform(kept, lambda row: F.exists(row, lambda p: p["r"] > 0)).alias("kept"))
    return e.select("event_id", F.size("cut").alias("height"), F.size(F.col("cut")[0]).alias("width"), (F.array_position("kept", True) - 1).cast("int").alias("blank"))


@query("SELECT doc_id AS object_id, source AS ground_truth, 'said ' || doc_id AS model_output FROM documents JOIN labels USING (doc_id)")
def annotation_lookup(spark, d):
    """JN16."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("object_id"), F.col("source").alias("ground_truth"))
    said = table(spark, d, "labels").select(F.col("doc_id").alias("object_id"), F.concat(F.lit("said "), F.col("doc_id").cast("string")).alias("model_output"))
    return evaluation.with_truth(said, docs)


@query("""WITH s AS (SELECT event_id FROM events ORDER BY md5('7|' || event_id) LIMIT 64) SELECT (SELECT count(*) FROM s) AS n_sampled, (SELECT count(*) FROM events) AS n_states, (SELECT sum(event_id) FROM s)::BIGINT AS mark""")
def replay_with_states(spark, d):
    """SP15."""
    sample, states = trajectories.replay_with_states(table(spark, d, "events").select("event_id", "value"), 64, 7, "event_id", "value")
    n = sample.agg(F.count("*").alias("n_sampled"), F.sum("event_id").alias("mark"))
    return n.join(F.broadcast(states.agg(F.count("*").alias("n_states")))).select("n_sampled", "n_states", "mark")


@query()
def embedding_digest(spark, d):
    """SF20 over numbers."""
    return table(spark, d, "embeddings").select("vec_id", text.vector_digest(F.col("embedding")).alias("digest"))


# --- folders of metas, results, sources and prompts


def _arrays(rows, group, value, at):
    """Writes a file for each group, one JSON array in it; groups are bounded by how they are made."""
    many = rows.groupBy(F.lpad(group.cast("string"), 8, "0").alias("part")).agg(F.to_json(F.collect_list(value)).alias("value"))
    many.write.partitionBy("part").text(at)


def _metas(spark, d, part):
    """Sample metas in files of 200, as their ids come; ``part`` moves and changes them."""
    s = A.samples(spark, d).select("sample_id", "bin_id", "reward", "time")
    meta = F.struct("sample_id", (F.col("reward") + part).alias("reward"), F.when(F.col("sample_id") % 5 != 0, F.col("bin_id")).alias("bin_id"), "time")
    return s, F.floor(F.col("sample_id") / 200).cast("long") + part * 1_000_000, meta


@query(f"WITH {A.SAMPLES} SELECT sample_id, reward, time, CASE WHEN sample_id % 5 <> 0 THEN bin_id ELSE -1 END AS bin_id, 'nohash' AS short_hash FROM samples")
def sample_scan(spark, d):
    """SC1: metas in a folder of JSON files; a meta without a bin has -1."""
    at = _folder(spark, "metas")
    _arrays(*_metas(spark, d, 0), at)
    return scans.samples(spark, at, "*").select("sample_id", "reward", "time", "bin_id", "short_hash")


@query(f"WITH {A.SAMPLES} SELECT sample_id::VARCHAR AS sample_id, CASE WHEN sample_id % 3 = 0 THEN reward + 1 ELSE reward END AS reward FROM samples")
def sample_scan_last(spark, d):
    """SC2: the last file of an id counts; a third of the metas come again in a later file."""
    at = _folder(spark, "metas")
    for part in (0, 1):
        rows, group, meta = _metas(spark, d, part)
        _arrays(rows.where("sample_id % 3 = 0") if part else rows, group, meta, f"{at}/run={part}")
    found = scans.samples_last_wins(spark, at, "*")
    return found.select(F.col("sample_id").cast("string").alias("sample_id"), "reward")


@query(f"""WITH {A.SAMPLES}, v AS (SELECT sample_id, unnest(['B_view', 'a_view', 'C_view']) || (sample_id % 7) AS path, unnest([1, 2, 3]) AS k FROM samples)
SELECT s.sample_id, array_to_string(list(path ORDER BY lower(path), path), '|') AS views FROM samples s JOIN v USING (sample_id) WHERE sample_id % 4 <> 1 AND k <= sample_id % 4 + 1 GROUP BY ALL""")
def samples_with_views(spark, d):
    """JN3, PF1, SR5: samples with their views in order of lower case; those without one go."""
    s = A.samples(spark, d).select("sample_id", "bin_id")
    names = F.array(*[F.concat(F.lit(n), (F.col("sample_id") % 7).cast("string")) for n in ("B_view", "a_view", "C_view")])
    views = s.where("sample_id % 4 <> 1").select("sample_id", F.explode(F.slice(names, F.lit(1), (F.col("sample_id") % 4 + 1).cast("int"))).alias("path"))
    return scans.with_views(s, views).select("sample_id", F.array_join("views", "|").alias("views"))


@query("SELECT doc_id::VARCHAR AS question_id, 'quality ' || quality || ', toxic ' || toxic AS evaluation_result FROM labels")
def judge_scan(spark, d):
    """SC11: results of a folder of JSON arrays."""
    at = _folder(spark, "judged")
    rows = table(spark, d, "labels")
    said = F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(", toxic "), F.col("toxic").cast("string"))
    _arrays(rows, F.floor(F.col("doc_id") / 500).cast("long"), F.struct(F.col("doc_id").cast("string").alias("question_id"), said.alias("evaluation_result")), at)
    return scans.judge_results(spark, at).select("question_id", "evaluation_result")


@query("SELECT event_id // 250 AS part, count(*) + 1 AS n_lines, sum(length(event_type) + 1)::BIGINT AS n_chars FROM events GROUP BY 1")
def source_scan(spark, d):
    """SC15: whole files under a line that names them."""
    e, i = _i(spark, d, "event_type")
    at = _folder(spark, "sources")
    e.withColumn("part", F.floor(i / 250).cast("long")).repartition("part").select("part", F.col("event_type").alias("value")).write.partitionBy("part").text(at)
    lines = F.split("text", "\n")
    rows = scans.source_files(spark, at, "").select(F.regexp_extract("path", r"part=(\d+)/", 1).cast("long").alias("part"), "text", F.startswith(lines[0], F.lit("# file: ")).alias("named"), lines[0].alias("head"))
    return rows.where("named").select("part", (F.size(F.split("text", "\n")) - 1).cast("long").alias("n_lines"), (F.length("text") - F.length("head") - 1).cast("long").alias("n_chars"))


@query("SELECT event_id, 'Which is nearer to ' || event_type || '?' AS prompt FROM events")
def prompt_log(spark, d):
    """SK18: prompts with the time of writing, which is not in the future."""
    e, _ = _i(spark, d, "event_type")
    at = _folder(spark, "log")
    for part in (0, 1):
        sinks.append_prompts(e.where(F.col("event_id") % 2 == part).select("event_id", F.concat(F.lit("Which is nearer to "), F.col("event_type"), F.lit("?")).alias("prompt")), at)
    return spark.read.schema("event_id long, prompt string, logged_at timestamp").json(at).where("logged_at <= current_timestamp()").select("event_id", "prompt")


# --- preferences: contents, labels, scores


@query("""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS a, CASE WHEN vec_id % 6 = 0 THEN embedding ELSE lead(embedding) OVER (ORDER BY vec_id) END::DOUBLE[] AS b, (vec_id % 3 - 1)::INT AS label FROM embeddings)
SELECT vec_id, label FROM p WHERE b IS NOT NULL AND list_distance(a, b) >= 1e-3 AND label <> -1""")
def useful_pairs(spark, d):
    """PF3, PF4: pairs whose contents differ and that have a label."""
    v = table(spark, d, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    p = v.join(nxt, "vec_id", "left").select("vec_id", F.col("embedding").alias("a"), F.when(F.col("vec_id") % 6 == 0, F.col("embedding")).otherwise(F.col("after")).alias("b"), (F.col("vec_id") % 3 - 1).cast("int").alias("label"))
    return preferences.labelled(preferences.useful(p.where("b is not null"), "a", "b")).select("vec_id", "label")


@query("SELECT event_id, round(CASE WHEN event_id % 13 IN (4, 9) THEN NULL ELSE (event_id % 101) / 100.0::DOUBLE * 2 - 1 END, 9) AS label FROM events")
def score_labels(spark, d):
    """PF5: replies of scores from 0 to 1; words and empty replies give none."""
    e, i = _i(spark, d)
    reply = F.when(i % 13 == 4, F.concat(F.lit("score "), i.cast("string"))).when(i % 13 == 9, F.lit("")).otherwise(F.format_string("%s%.2f%s", F.when(i % 3 == 0, " ").otherwise(""), (i % 101) / 100.0, F.when(i % 5 == 0, "\n").otherwise("")))
    return e.select("event_id", F.round(preferences.score_label(F.trim(F.regexp_replace(reply, "\n", ""))), 9).alias("label"))


@query("SELECT DISTINCT event_id AS geom FROM events WHERE user_id % 4 = 1 AND user_id < 100")
def body_geoms(spark, d):
    """PF14: the geoms of some bodies."""
    e = table(spark, d, "events")
    bodies = e.where("user_id % 4 = 1 and user_id < 100").select(F.col("user_id").alias("body"))
    return points.of_bodies(e.select(F.col("event_id").alias("geom"), F.col("user_id").alias("body")), bodies)


@query("SELECT event_id, round(cos(a) * 2 - sin(a) * x + 1, 6) AS x, round(sin(a) * 2 + cos(a) * x - 1, 6) AS y, round(x + 0.5::DOUBLE, 6) AS z FROM (SELECT event_id, (event_id % 12) / 2.0::DOUBLE AS a, value / 10 AS x FROM events)")
def placed_points(spark, d):
    """VP13: places in a body's frame, seen from the world: a turn about z, then a shift."""
    e, i = _i(spark, d, "value")
    a, x = (i % 12) / 2.0, F.col("value") / 10
    turn = [[F.cos(a), -F.sin(a), F.lit(0.0)], [F.sin(a), F.cos(a), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    at = maths.placed(turn, [F.lit(2.0), x, x], [F.lit(1.0), F.lit(-1.0), F.lit(0.5)])
    return e.select("event_id", *[F.round(v, 6).alias(c) for v, c in zip(at, "xyz", strict=True)])


@query(f"WITH {A.TURNS}, t AS (SELECT id || '_' || pos AS custom_id, id, pos FROM turns WHERE who = 'gpt' AND trim(value, ' ') <> '') SELECT custom_id, id, pos FROM t ORDER BY id, pos LIMIT 50")
def rewrite_first(spark, d):
    """SR8: the first 50 rewriting tasks in order."""
    return conversations.capped(conversations.rewrite_tasks(A.conversations(spark, d)), 50).select("custom_id", "id", "pos")


@query()
def kcenter_uncertain(spark, d):
    """SP12: k-centre among the most uncertain pairs of each bin."""
    s = A.samples(spark, d)
    member = s.select(F.col("sample_id").alias("pair_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("member"))
    scores = member.withColumn("p", maths.uniform(F.lit(5), F.col("pair_id"), F.col("member")))
    return preferences.k_center_of_uncertain(scores, s.select(F.col("sample_id").alias("id"), F.col("bin_id").alias("environment"), "embedding"), 12)
