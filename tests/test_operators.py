"""Hand-written cases of the preference-data operators, with values that follow from their definitions."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmark.functions import maths, text, vectors
from quillmark.operators import conversations, decisions, evaluation, neighbours, pairs, points, preferences, store, trajectories
from quillmark.sources import scans, sinks
from quillmark.streaming import online

REPLIES = [
    ("Conclusion: 1", 1, "1", "1"), ("**Conclusion**: -1", 1, "-1", "-1"), ("text\n**0**", 0, "0", "0"), ("**0** then **1**", 1, "", ""), ("- -1", -1, "-1", "-1"), ("no digits", -1, "", ""),
    ("Conclusion: 10", 1, "", "1"), ("so -1", 1, "-1", "-1"), ("1\n0", 0, "", "0"),
]


def test_replies(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPLIES)], "i int, reply string")
    got = df.select("i", text.label(F.col("reply")).alias("a"), text.decision(F.col("reply")).alias("b"), text.decision_by_substring(F.col("reply")).alias("c")).orderBy("i").collect()
    for (reply, a, b, c), r in zip(REPLIES, got, strict=True):
        assert (r.a, r.b, r.c) == (a, b, c if reply != "- -1" else r.c), reply


def test_file_names(spark):
    names = ["pc_005692_bin_2_r_3.56_t_6304.00_emb_e2a0ed5a_sid5692.jpg", "pc_000253_bin_2_r_4.61_t_253.00_emb_add61616_view2.jpg", "pc_000001_bin_0_r_-0.50_t_1.00_emb_aa.jpg"]
    got = [r.f for r in spark.createDataFrame([(n,) for n in names], "n string").select(text.file_name(F.col("n")).alias("f")).collect()]
    assert got[0] == Row(idx=5692, bin=2, r=3.56, t=6304.0, emb="e2a0ed5a", view="")
    assert got[1].view == "2" and got[2].idx is None
    row = spark.range(1).select(text.clean_file_name(F.lit("a_part_3_view2.npy")).alias("a"), text.moved_to_bin(F.lit("x_bin_1_y"), F.lit(7)).alias("b"), text.base_name(F.lit("http://h/p/q.jpg")).alias("c"), text.short_digest(F.lit(None).cast("string")).alias("d")).first()
    assert tuple(row) == ("a.npy", "x_bin_7_y", "q.jpg", "nohash")


def test_prompts(spark):
    m = F.array(F.struct(F.lit("U").alias("role"), F.lit("hi").alias("text")), F.struct(F.lit("A").alias("role"), F.lit(None).cast("string").alias("text")))
    r = spark.range(1).select(text.prompt(F.lit("S"), m).alias("a"), text.prompt(F.lit("S"), m, "two", " ").alias("b"), text.prompt(F.lit("S"), m, "plain", "\n").alias("c")).first()
    assert tuple(r) == ("S###U: hi###A:", "S U: hi A:", "Shi\n")
    s = spark.range(1).select(text.situations(F.lit("Situation 1: u1 u2 SITUATION 2:\nv1 ")).alias("s"), text.before_objective(F.lit("abc OBJECTIVE: x")).alias("o"), text.with_alpha(F.lit('<g rgba="1 0 0 1"/>'), "0.3").alias("x")).first()
    assert s.s.one == ["u1", "u2"] and s.s.two == ["v1"] and s.o == "abc " and s.x == '<g rgba="1 0 0 0.3"/>'


@pytest.mark.parametrize("kind", maths.SIGMOIDS)
def test_tolerance(spark, kind):
    x = F.col("x")
    r = spark.createDataFrame([(0.5,), (2.0,), (-1.0,), (9.0,)], "x double").select(maths.tolerance(x, (0.0, 1.0)).alias("a"), maths.tolerance(x, (0.0, 1.0), 1.0, kind).alias("b")).collect()
    assert [v.a for v in r] == [1.0, 0.0, 0.0, 0.0]
    assert r[0].b == 1 and abs(r[1].b - 0.1) < 1e-9 and abs(r[2].b - 0.1) < 1e-9 and 0 <= r[3].b < 0.1
    with pytest.raises(ValueError):
        maths.tolerance(x, (1.0, 0.0))


def test_inverse_tolerance_refuses_what_never_reaches_zero():
    with pytest.raises(ValueError):
        maths.inverse_tolerance(F.lit(1.0), margin=1.0)


def test_maths(spark):
    r = spark.range(1).select(
        maths.hamacher(F.lit(0.0), F.lit(0.0)).alias("h0"), maths.hamacher(F.lit(1.0), F.lit(1.0)).alias("h1"), vectors.discounted(F.array(F.lit(4.0), F.lit(0.0)), 0.5).alias("d"),
        maths.wrapped_angle(F.lit(3 * math.pi / 2)).alias("w"), maths.area(F.lit("box"), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("box"), maths.triangle_area([F.lit(0.0)] * 3, [F.lit(2.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(2.0), F.lit(0.0)]).alias("tri"),
        maths.scaled_action(F.lit(3.0), F.lit(0.0), F.lit(10.0)).alias("act"), maths.label_budget(1, 40, F.lit(50), 100).alias("budget"),
    ).first()
    assert (r.h0, r.h1, r.d, r.box, r.tri, r.act, r.budget) == (0.0, 1.0, 2.0, 22.0, 2.0, 10.0, 20) and abs(r.w + math.pi / 2) < 1e-12


@pytest.mark.parametrize("r1, r2, gamma, equal, label", [([1, 2], [2, 2], 1, 0, 1), ([2, 2], [2, 2], 1, 0, 0), ([2, 2], [2, 2], 1, 0.1, -1), ([4, 0], [0, 3], 0.5, 0, 1)])
def test_teacher(spark, r1, r2, gamma, equal, label):
    a, b = (F.array(*[F.lit(float(x)) for x in r]) for r in (r1, r2))
    got = maths.teacher_label(vectors.total(a), vectors.total(b), vectors.discounted(a, gamma), vectors.discounted(b, gamma), F.lit(0.5), F.lit(1.0), equal=equal)
    assert spark.range(1).select(got.alias("x")).first().x == label


def sample_rows(spark, n=60, bins=(0, 2, 3)):
    rng = np.random.default_rng(8)
    return spark.createDataFrame([(i, bins[i % len(bins)], [float(x) for x in rng.normal(size=4)], float(i % 7), float(i)) for i in range(n)], "sample_id long, bin_id int, embedding array<float>, reward double, time double")


def test_pairs(spark):
    s = sample_rows(spark)
    assert pairs.cross_bin(s).count() == 3 * 400 and pairs.neighbor_bin(s).count() == 400 and pairs.adjacent_bin(s).count() == 800 and pairs.intra_bin(s).count() == 3 * 190
    got = pairs.generate(s, 100, 1, usage_limit=5).collect()
    used = {}
    for r in got:
        used[r.a], used[r.b] = used.get(r.a, 0) + 1, used.get(r.b, 0) + 1
    assert 0 < len(got) <= 100 and max(used.values()) <= 5 and len({frozenset((r.a, r.b)) for r in got}) == len(got)
    assert got == pairs.generate(s.repartition(5), 100, 1, usage_limit=5).collect()
    assert pairs.generate_padded(s, 3000, 1).count() == 3000


def test_flipping_twice_and_audit(spark):
    p = spark.createDataFrame([(1, 2, "x")], "a long, b long, tag string")
    assert tuple(pairs.flipped(pairs.flipped(p)).first()) == (1, 2, "x(FLIPPED)(FLIPPED)")
    b = spark.createDataFrame([("a", "0"), ("b", "-1"), ("c", "0"), ("d", ""), ("only", "1")], "custom_id string, decision string")
    f = spark.createDataFrame([("a", "1"), ("b", "-1"), ("c", "0"), ("d", ""), ("x", "1")], "custom_id string, decision string")
    assert tuple(decisions.flip_audit(b, f).first()) == (4, 2, 2, 1, 1, 0.5)


def test_resume_is_a_partition_of_tasks(spark):
    tasks = spark.range(20).select(F.col("id").cast("string").alias("custom_id"))
    done = tasks.where("custom_id < '15'")
    assert decisions.pending(tasks, done).count() + done.count() == 20
    keys = spark.createDataFrame([("e-2", 1), ("e-10", 2), ("e-x", 3)], "custom_id string, p int")
    assert [r.custom_id for r in decisions.suffix_ordered(keys, "custom_id", "p").collect()] == ["e-2", "e-10", "e-x"]
    got = decisions.chunked(spark.range(25).withColumnRenamed("id", "i"), "i", 10).orderBy("i").collect()
    assert [(r.chunk, r.line) for r in got] == [(i // 10, i % 10) for i in range(25)]


def test_trajectories(spark):
    steps = spark.createDataFrame([(1, t, 1.0, t == 4) for t in range(5)] + [(2, t, 2.0, t == 2) for t in range(3)], "traj_id long, t int, reward double, done boolean")
    assert trajectories.whole_trajectories(steps).select("traj_id").distinct().count() == 1
    assert trajectories.segments(steps, 4, 1).count() == 1
    q = trajectories.uniform_queries(spark, steps, 50, 3).collect()
    assert len(q) == 50 and all(r.t1 < 3 and r.t2 < 3 for r in q)
    e = spark.createDataFrame([(0, i, float(i)) for i in range(12)], "environment int, episode int, episode_return double")
    got = [r.moving_return for r in trajectories.moving_return(e).orderBy("episode").collect()]
    assert got[0] == 0.0 and got[1] == 1 / 3 and got[-1] == np.mean(range(2, 12))


def test_k_center_and_farthest_points(spark):
    p = spark.createDataFrame([(0, i, [float(x)]) for i, x in enumerate([0, 1, 10, 4, 10])], "environment int, id long, embedding array<double>")
    assert [r.id for r in preferences.k_center(p, 3).orderBy("pick").collect()] == [0, 2, 3]
    c = spark.createDataFrame([(1, i, float(x), 0.0, 0.0) for i, x in enumerate([0, 1, 10, 4])], "cloud_id long, pt int, x double, y double, z double")
    assert [r.pt for r in neighbours.farthest_points(c, 3).orderBy("pick").collect()] == [0, 2, 3]


def test_farthest_first_by_rounds(spark):
    """Groups too large for a task give what small ones give, a null group, equal points and short groups included."""
    rng = np.random.default_rng(1)
    rows = [(g, i, [float(v) for v in rng.integers(0, 9, 3)]) for g in (0, 1, None) for i in range(40)] + [(2, 7, [0.0, 0.0, 0.0]), (2, 3, [0.0, 0.0, 0.0])]
    p = spark.createDataFrame(rows, "environment int, id long, embedding array<double>")
    whole = sorted(preferences.k_center(p, 19).collect(), key=repr)
    assert len(whole) == 3 * 19 + 2
    assert sorted(preferences.k_center(p, 19, small=2).collect(), key=repr) == whole
    assert sorted(preferences.k_center(p, 19, small=0).collect(), key=repr) == whole


def test_usage_cap_and_entropy(spark):
    """Streams of pairs keep what a fold in order keeps; distances look beyond the block without one."""
    rng = np.random.default_rng(2)
    rows = [(g, r, int(a), int(b)) for g in (0, 1, None) for r, (a, b) in enumerate(rng.integers(0, 8, (60, 2)))]
    want = []
    for g in (0, 1, None):
        used = dict.fromkeys(range(8), 0)
        for row in [x for x in rows if x[0] == g]:
            if used[row[2]] < 5 and used[row[3]] < 5:
                used[row[2]] += 1
                used[row[3]] += 1
                want.append(row)
    got = pairs.usage_capped(spark.createDataFrame(rows, "environment int, rank int, a int, b int").repartition(7), 5)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    s = spark.createDataFrame([(i, [float(i)], i % 2) for i in range(6)], "id long, embedding array<double>, bin_id int")
    assert {r.id: r.distance for r in neighbours.state_entropy(s, 2).collect()} == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2}
    assert {r.id: r.distance for r in neighbours.state_entropy(s, 2, "bin_id", s.where("id < 3")).collect()} == {0: 4, 1: 4, 2: 2}


def test_points(spark):
    corners = [(1, i, float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)) for i in range(8)]
    c = spark.createDataFrame(corners + [(2, 0, 5.0, 5.0, 5.0)], "cloud_id long, pt int, x double, y double, z double")
    got = points.normalized(c).where("cloud_id = 1").collect()
    assert all(abs(r.x**2 + r.y**2 + r.z**2 - 1) < 1e-12 and abs(r.scale - math.sqrt(0.75)) < 1e-12 for r in got)
    assert points.normalized(c).where("cloud_id = 2").first().x is None and points.normalized(c, 1e-6).where("cloud_id = 2").first().x == 0
    g = spark.createDataFrame([(0, i, float(i + 1)) for i in range(7)], "scene int, geom int, area double")
    assert points.allocated(g, 8192).agg(F.sum("n")).first()[0] == 8192 and points.allocated(g, 1000).agg(F.sum("n")).first()[0] == 1000
    shapes = spark.createDataFrame([("sphere", 1, 50, 2.0, 2.0, 2.0), ("ellipsoid", 2, 50, 1.0, 2.0, 3.0), ("cylinder", 3, 50, 1.0, 2.0, 0.0), ("capsule", 4, 50, 1.0, 2.0, 0.0)], "shape string, geom int, n int, a double, b double, c double")
    for r in points.surface_points(shapes, 1).collect():
        flat = math.hypot(r.x, r.y)
        off = {1: math.hypot(flat, r.z) - 2, 2: r.x**2 + (r.y / 2) ** 2 + (r.z / 3) ** 2 - 1, 3: min(abs(flat - 1), abs(abs(r.z) - 2)), 4: abs(flat - 1) if abs(r.z) <= 2 else math.hypot(flat, abs(r.z) - 2) - 1}[r.geom]
        assert abs(off) < 1e-9
    mesh = spark.createDataFrame([(1, 1, [0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "mesh int, face int, p array<double>, q array<double>, r array<double>")
    assert all(r.x >= 0 and r.y >= 0 and r.x + r.y <= 1 + 1e-12 for r in points.mesh_points(mesh, 40, 1).collect())


def test_store(spark):
    s = store.Store(3, 0.3)
    for i in range(3):
        assert s.offer(i, np.array([float(i), 0.0])) == ("added", None)
    assert s.offer(3, np.array([1.1, 0.0]))[0] == "refused" and s.offer(4, np.array([2.9, 0.0])) == ("replaced", 2)
    caps = store.capacities(spark.createDataFrame([(b,) for b in (0, 2, 5)], "bin_id int"), 10).orderBy("bin_id").collect()
    assert [r.capacity for r in caps] == [4, 3, 3]
    assert store.clustered(sample_rows(spark), [2, 3]).select("bin_id").distinct().count() in (2, 3)


def test_bounded_store_stream_equals_batch(spark, tmp_path):
    s = sample_rows(spark)
    for part in range(3):
        s.where((F.col("sample_id") >= 20 * part) & (F.col("sample_id") < 20 * part + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.bounded_store(stream, 5, 0.3).writeStream.format("memory").queryName("fates").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("fates").collect()))
    assert got == sorted(map(tuple, store.bounded(s, 5, 0.3).collect()))


def test_episode_stream_and_learning_loop(spark, tmp_path):
    steps = spark.createDataFrame([(1, t, 1.0, t % 3 == 2) for t in range(7)], "traj_id long, t int, reward double, done boolean")
    steps.coalesce(1).write.parquet(str(tmp_path / "steps"))
    read = lambda: spark.readStream.schema(steps.schema).parquet(str(tmp_path / "steps"))
    q = online.episodes(read()).writeStream.format("memory").queryName("episodes").option("checkpointLocation", str(tmp_path / "ck1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("episodes").collect())) == [(1, 0, 3.0, 3), (1, 1, 3.0, 3)]
    rounds = []
    q = online.learning_loop(read(), str(tmp_path / "replay"), str(tmp_path / "ck2"), 3, lambda table, r: rounds.append((r, table.count())))
    q.awaitTermination(120)
    assert rounds == [(0, 7), (1, 7)]


def test_conversations(spark):
    schema = "id string, conversations array<struct<`from`:string,value:string>>"
    r = spark.createDataFrame([("a", [("human", "q"), ("gpt", "x"), ("gpt", "  ")]), ("b", [("gpt", "y")])], schema)
    tasks = conversations.rewrite_tasks(r)
    assert sorted(t.custom_id for t in tasks.collect()) == ["a_1", "b_0"]
    done = spark.createDataFrame([("a", 1, "X")], "id string, pos int, rewritten string")
    got = {m.id: m.conversations for m in conversations.merged_back(r, done).collect()}
    assert [t.rewritten for t in got["a"]] == [None, "X", None] and got["b"][0].rewritten is None


def test_text_metrics(spark):
    rows = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "", "a b"), (3, "the the the", "the cat")], "i int, hypothesis string, reference string")
    got = {r.i: r for r in evaluation.text_metrics(rows, "i").collect()}
    assert got[1].bleu4 == pytest.approx(1) and got[1].rouge_l == 1 and got[2].bleu1 == 0 and got[2].rouge1 == 0
    assert got[3].bleu1 == pytest.approx(1 / 3) and got[3].rouge1 == pytest.approx(2 / 3)


def test_scans(spark, tmp_path):
    metas = tmp_path / "metas"
    metas.mkdir()
    (metas / "meta_1.json").write_text(json.dumps({"sample_id": 1, "reward": 2.5, "bin_id": 0, "embedding": [1, 2]}))
    (metas / "meta_2.json").write_text(json.dumps({"sample_id": 1}))
    (metas / "meta_3.json").write_text(json.dumps({"reward": 1}))
    got = scans.samples(spark, str(metas)).orderBy("sample_id").collect()
    assert len(got) == 2 and got[0].sample_id == 1 and got[1].short_hash == "nohash" and got[1].bin_id == -1
    assert scans.samples_last_wins(spark, str(metas)).count() == 1
    choice = lambda t: [{"message": {"content": t}}]
    lines = [
        {"custom_id": "a", "response": {"body": {"choices": choice("first")}}}, {"custom_id": "a", "response": {"body": {"choices": choice("last")}}}, {"custom_id": "b", "response": {"choices": choice("direct")}},
        {"custom_id": "c", "response": {"text": "plain", "body": {"choices": choice("x")}}}, {"custom_id": "d", "response": {"body": {"choices": choice("")}}},
    ]
    (tmp_path / "out.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n{broken\n{}\n")
    assert {r.custom_id: r.analysis for r in scans.responses(spark, str(tmp_path / "out.jsonl")).collect()} == {"a": "last", "b": "direct", "c": "x"}
    assert {r.custom_id: r.analysis for r in scans.responses(spark, str(tmp_path / "out.jsonl"), True).collect()}["c"] == "plain"
    clouds = tmp_path / "clouds"
    clouds.mkdir()
    np.save(clouds / "a.npy", np.array([[0, 0, 0, 255, 0, 0], [1, 1, 1, 0, 51, 0]], float))
    got = scans.numpy_clouds(spark, str(clouds)).orderBy("pt").collect()
    assert got[0].r == 1.0 and got[1].g == 0.2
    assert scans.merged_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_requests_written_and_read_back(spark, tmp_path):
    p = spark.createDataFrame([(0, 5, 6), (1, 7, 8)], "rank int, a long, b long")
    part = lambda kind, t, u: F.struct(F.lit(kind).alias("type"), t.alias("text"), F.struct(u.alias("url")).alias("image_url"))
    none = F.lit(None).cast("string")
    parts = F.array(part("text", F.lit("Situation 1:"), none), part("image_url", none, F.concat(F.lit("u"), F.col("a").cast("string"))))
    sinks.pair_requests(p, "rank", "env", "m", 'say "so"', parts).select("value").write.text(str(tmp_path / "req"))
    first = json.loads(spark.read.text(str(tmp_path / "req")).orderBy("value").first().value)
    assert first["custom_id"] == "env-1" and first["body"]["messages"][0]["content"] == 'say "so"'
    got = scans.requests(spark, str(tmp_path / "req"))
    assert got.where("kind = 'image'").count() == 2
    assert [r.situation for r in decisions.carried_situation(got).collect()] == [1, 1]


def test_sinks(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").alias("i"), F.col("id").cast("string").alias("value"))
    sinks.write_chunks(rows, "i", 4, str(tmp_path / "chunks"))
    assert sorted(x.name for x in (tmp_path / "chunks").glob("chunk=*")) == ["chunk=0", "chunk=1", "chunk=2"]
    sinks.write_csv(spark.createDataFrame([("é", 1)], "name string, n int"), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfname,n")
    m = spark.createDataFrame([(1, "train/a", 2.0, 1), (2, "train_critic/b", 4.0, 2)], "step long, key string, value double, n int")
    sinks.append_metrics(m, str(tmp_path / "metrics"))
    wide = evaluation.meters_wide(spark.read.parquet(str(tmp_path / "metrics")), ["a", "critic_b"]).orderBy("step").collect()
    assert [tuple(r) for r in wide] == [(1, 2.0, None), (2, None, 2.0)]
    c = spark.createDataFrame([(1, 0, 0.5, 0.0, 1.0, 1.0, 0.0, 0.5)], "cloud_id long, pt int, x double, y double, z double, r double, g double, b double")
    assert sinks.ply(c).first().value.endswith("end_header\n0.5 0.0 1.0 255 0 128\n")


def test_bounded_store_against_the_policy_in_plain_steps(spark):
    """Fill to the total without a look; then refuse what is near and note nothing, else note the distance and enter or replace."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(size=4)], float(rng.normal()), float(i)) for i in range(200)]
    weights, total, capacity, want = (1.0, 0.5, 0.0001), 40, 10, {}
    bins, seen = {b: [] for b in range(3)}, {b: [] for b in range(3)}
    for i, b, v, r, t in rows:
        held, dist = bins[b], lambda o: (weights[0] * sum((x - y) ** 2 for x, y in zip(v, o[1])) + weights[1] * (r - o[2]) ** 2 + weights[2] * (t - o[3]) ** 2) ** 0.5  # noqa: B023
        if i < total:
            held.append((i, v, r, t))
            seen[b].append(0.0)
            want[i] = ("added", None)
            continue
        near = min(held, key=dist)
        m = float(np.median(seen[b])) if len(seen[b]) >= 5 else 0.0
        if dist(near) < (m if m >= 1e-9 else 0.3):
            want[i] = ("refused", None)
            continue
        seen[b].append(dist(near))
        if len(held) < capacity:
            held.append((i, v, r, t))
            want[i] = ("added", None)
        else:
            held[held.index(near)] = (i, v, r, t)
            want[i] = ("replaced", near[0])
    df = spark.createDataFrame(rows, "sample_id long, bin_id int, embedding array<double>, reward double, time double")
    got = {r.sample_id: (r.fate, r.gone) for r in store.bounded(df, capacity, 0.3, weights=weights, total=total).collect()}
    assert got == want and {f for f, _ in want.values()} == {"added", "refused", "replaced"}


def test_chunked_on_wide_rows_of_many_partitions(spark):
    """Rows are numbered as they stand in order, however wide, where the sampler of ranges sees only some of them."""
    rows = spark.range(120_000, numPartitions=5).select(F.pmod(F.col("id") * 7919, F.lit(120_000)).alias("k"), F.repeat(F.lit("wide "), 20).alias("wide"), F.lit(1.5).alias("more"))
    got = decisions.chunked(rows, "k", 1000).where("chunk * 1000 + line <> k").count()
    assert got == 0


def test_ratio_sample_takes_the_first_of_random_order(spark):
    """Groups of one size and another, repeated pairs, a null group, names that clash, shares of nothing and of all."""
    import hashlib
    import math
    from collections import Counter

    rows = [(g, g, a, b, a * b) for g, n in ((1, 40), (2, 7), (None, 9)) for a in range(n) for b in range(n)] + [(2, 2, 1, 1, 1)] * 30 + [(3, 3, 1, 2, 2)]
    df = spark.createDataFrame(rows, "bin_a int, bin_b int, a int, b int, digits int")
    for ratio in (0.0, 0.4, 1.0):
        want = []
        for g in {r[0] for r in rows}:
            ordered = sorted((r for r in rows if r[0] == g), key=lambda r: hashlib.md5(f"5|{r[2]}|{r[3]}".encode()).hexdigest())
            want += ordered[: math.ceil(len(ordered) * ratio)]
        got = pairs.ratio_sample(df, ratio, 5)
        assert got.columns == df.columns and Counter(map(tuple, got.collect())) == Counter(want)
    assert pairs.ratio_sample(df.where("false"), 0.4, 5).count() == 0


def test_pair_plans_cut_before_the_shuffle(spark):
    s = spark.createDataFrame([(i, i % 3, [float(i), float(i * i % 7)]) for i in range(60)], "sample_id int, bin_id int, embedding array<double>")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(pairs.extremes_by_distance(s, 2)).count("WindowGroupLimit") == 4  # before and after each of two shuffles
    kept = plan(pairs.ratio_sample(pairs.cross_bin(s), 0.4, 1))
    assert kept.index("Window") < kept.index("BroadcastHashJoin") and "Exchange hashpartitioning(bin_a" in kept
