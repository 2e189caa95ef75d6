"""Formulas held against plain Python."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import maths, text
from quillmark.operators import evaluation, points

REPLIES = ["85#why", "85", " 85\n", "101#x", "-1#x", "a 7#b#c", "#none", "", "Score: 85", "+5", "1_0", "100 #late", "first\n12#x\n13#y", "007#bond", "99999999999999999999#", "-5", "3.5", "　42　", "0#"]


def plain_rating(reply: str) -> int:
    found = re.search(r"(\d*#.*)", reply)
    lead = (found.group(1) if found else reply).strip().split("#")[0]
    try:
        n = int(lead)
    except ValueError:
        return -1
    return n if 0 <= n <= 100 else -1


def test_ratings(spark):
    varied = REPLIES + [f"{a}{n}{b}" for n in range(0, 130, 7) for a in ("", " ", "x", "x\n") for b in ("#why", "", "#", " #a", "\n")]
    df = spark.createDataFrame([(r,) for r in varied], "reply string")
    got = [(r["reply"], r["n"]) for r in df.select("reply", text.rating(F.col("reply")).alias("n")).collect()]
    assert len(varied) > 200 and [(r, n, plain_rating(r)) for r, n in got if n != plain_rating(r)] == []


def test_prompt_styles(spark):
    m = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).cast("string").alias("text")) for r, t in (("U", "hi"), ("A", "yo"), ("U", ""), ("A", None))])
    r = spark.range(1).select(text.prompt(F.lit("S"), m).alias("one"), text.prompt(F.lit("S"), m, "two", " ", "</s>").alias("two"), text.prompt(F.lit("S"), m, "mpt", "|").alias("mpt")).first()
    assert (r.one, r.two, r.mpt) == ("S###U: hi###A: yo###U:A:", "S U: hi A: yo</s>U:A:", "S|Uhi|Ayo|UA")


def test_natural_order_of_any_number(spark):
    names = ["a2", "a10", "a" + "9" * 24, "a1" + "0" * 24, "a02", "b1", "A3", "a", "7", "10"]
    parts = lambda s: [(0, int(t), "") if t.isdigit() else (1, 0, t.lower()) for t in re.findall(r"\d+|\D+", s)]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n")), "n").collect()]
    assert got == sorted(names, key=lambda n: (parts(n), n))


def test_budgets_margins_and_losses(spark):
    def budget(kind, step):
        if kind == 0:
            return 40
        share = ((100 - step) / 100 or 0.01) if kind == 1 else 100 / (100 - step + 1)
        return int(40 * share)

    for kind in (0, 1, 2):
        got = spark.range(101).select("id", maths.label_budget(kind, 40, F.col("id"), 100).alias("n")).collect()
        assert [r["n"] for r in got] == [budget(kind, r["id"]) for r in got]
    r = spark.range(1).select(
        maths.cross_entropy(F.lit(0.0), F.lit(800.0), F.lit(0)).alias("far"), maths.cross_entropy(F.lit(0.0), F.lit(800.0), F.lit(1)).alias("right"), maths.cross_entropy(F.lit(0.3), F.lit(-0.4), F.lit(1)).alias("near"),
        maths.teacher_margin(F.lit(300.0), 50, 500, 0.1).alias("margin"), maths.labels_left(F.lit(40), F.lit(90), 100).alias("left"),
    ).first()
    assert (r.far, r.right, r.left) == (800.0, 0.0, 10) and r.near == pytest.approx(math.log(1 + math.exp(0.7))) and r.margin == pytest.approx(3)


def test_colors_under_materials(spark):
    def plain(geom, mat, emission, reflectance, specular, shininess):
        geom = np.clip(geom, 0, 1)
        if mat is None:
            return geom
        mat = np.clip(mat, 0, 1)
        c = geom[:3] * mat[:3]
        for effect, step in ((emission, lambda c: c + emission), (reflectance, lambda c: (1 - reflectance) * c + reflectance), (specular, lambda c: c + specular), (shininess, lambda c: c * (1 - 0.5 * shininess) + 0.5 * shininess)):
            c = np.clip(step(c), 0, 1) if effect > 1e-9 else c
        return np.r_[c, geom[3] * mat[3]]

    rng = np.random.default_rng(6)
    cases = [(rng.uniform(-0.2, 1.2, 4), None if i % 5 == 0 else rng.uniform(-0.2, 1.2, 4), *(rng.choice([0.0, 1e-10, 0.3, 0.9], 4))) for i in range(60)]
    rows = [(i, [float(x) for x in g], None if m is None else [float(x) for x in m], *map(float, e)) for i, (g, m, *e) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, g array<double>, m array<double>, e double, f double, s double, h double")
    out = points.blended([F.col("g")[k] for k in range(4)], [F.col("m")[k] for k in range(4)], *[F.col(c) for c in "efsh"])
    for r in df.select("i", F.array(*out).alias("c")).collect():
        assert np.allclose(r["c"], plain(*cases[r["i"]]), atol=1e-12)


def test_rouge_counts_distinct_grams(spark):
    rows = spark.createDataFrame([(1, "the the. cat", "the cat. sat the cat")], "i int, hypothesis string, reference string")
    r = evaluation.n_gram_metrics(rows, "i").first()
    p, q = 2 / 2, 2 / 3
    assert r.rouge1 == pytest.approx(2 * p * q / (p + q + 1e-8))
    p, q = 1 / 2, 1 / 3
    assert r.rouge2 == pytest.approx(2 * p * q / (p + q + 1e-8))
    assert {x.metric: x.score for x in evaluation.overall_scores(evaluation.n_gram_metrics(rows, "i")).collect()}["rouge1"] == "80.0000"


def test_grams_are_not_shuffled(spark):
    """Rows of one key count together, keys may be null, keys without a word have no row; texts come together once, n-grams never."""
    rows = [(1, "a b a b", "a b. c"), (1, "c d", "d a"), (None, "x y", "x y x"), (2, " \t", ""), (3, None, "##"), (4, "v w", None)]
    df = spark.createDataFrame(rows, "i int, hypothesis string, reference string")
    out = evaluation.n_gram_metrics(df, "i")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate ") == 1 and "Generate" not in plan and "Join" not in plan
    got = {r.i: r for r in out.collect()}
    assert set(got) == {1, None, 3, 4}
    hyp, ref = ["a", "b", "a", "b", "c", "d"], ["a", "b.", "c", "d", "a"]
    common = sum(min(hyp.count(w), ref.count(w)) for w in set(hyp))
    assert got[1].bleu1 == pytest.approx(common / 6)
    assert got[1].rouge1 == pytest.approx(2 * (4 / 4) * (4 / 5) / (4 / 4 + 4 / 5), abs=1e-6)
    assert got[3].bleu1 == 1 and got[4].bleu1 == 0 and got[4].rouge1 == 0
