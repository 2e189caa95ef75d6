"""Near copies against brute-force Jaccard likeness of five-word shingles."""

import random

import numpy as np

import corpus_pipeline
from quillmark.common import table
from quillmark.llm import simhash

from tests.conftest import DATA

SCHEMA = "doc_id long, text string"


def brute_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """(doc_id, text) of the least row of each group."""
    rows = sorted(set(rows))
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and (a == b or (a and b and len(a & b) >= 0.8 * len(a | b))):
                x, y = max(root[i], root[j]), min(root[i], root[j])
                root = [y if r == x else r for r in root]
    return {rows[r] for r in root}


def edited(words, rng, n):
    """A copy with n words changed, far from each other."""
    out = list(words)
    for i in range(n):
        out[10 + i * 12] = f"new{rng.random()}"
    return out


def planted(seed=1):
    rng, rows = random.Random(seed), []
    for g in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(edited(words, rng, 1 + g % 4))), (10 * g + 2, " ".join(edited(words, rng, 8)))]
    return rows


def test_copies_of_likeness_080_to_097_go_and_others_stay(spark):
    rows = planted()
    got = {tuple(r) for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA), DATA).collect()}
    assert got == brute_kept(rows) and {i for i, _ in got} == {i for i, _ in rows if i % 10 != 1}


def test_large_group_of_copies(spark):
    """Copies that are near the first text but not all near each other, more than a small key holds."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(0, " ".join(words))]
    for i in range(1, 60):
        out = list(words)
        for at in rng.sample(range(5, 195), 3):
            out[at] = f"x{i}y{at}"
        rows.append((i, " ".join(out)))
    got = {tuple(r) for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA), DATA).collect()}
    assert got == brute_kept(rows)


def test_one_id_with_different_texts(spark):
    rows = [(1, "one two three four five six seven"), (1, "a text that is quite another than the first"), (1, "one two three four five six seven"), (2, None), (2, ""), (3, "short")]
    for keep in (lambda d: corpus_pipeline.near_copies(spark, d, DATA), simhash.keep_one):
        got = sorted((r.doc_id, r.text or "") for r in keep(spark.createDataFrame(rows, SCHEMA)).collect())
        assert got == sorted([(1, rows[0][1]), (1, rows[1][1]), (2, ""), (3, "short")])


def test_stage_against_brute_force_on_documents(spark):
    """At likeness 0.8 exactly: what stays is what brute force keeps."""
    rows = sorted({(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()})
    got = {(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, table(spark, DATA, "documents"), DATA).collect()}
    assert got == brute_kept(rows)


def pair_of(rng, n, shared):
    """Two texts with n shingles each, ``shared`` of them in common."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
    other = words[: shared + 4] + [f"v{rng.randrange(10**6)}" for _ in range(n - shared)]
    return " ".join(words), " ".join(other)


def test_planted_pairs_on_both_sides_of_the_bound(spark):
    """Sets of 300 shingles: nearly all pairs of 0.80 and all of 0.82 and more lose one, none of 0.795 or less does."""
    rng, rows, like = random.Random(9), [], {}
    for g in range(800):
        want = (0.80, 0.82, 0.795, 0.78)[g % 4]
        shared = {0.80: 267, 0.82: 271, 0.795: 265, 0.78: 263}[want]  # of 600: 267 / 333 is 0.802
        a, b = pair_of(rng, 300, shared)
        x, y = brute_set(a), brute_set(b)
        like[g] = len(x & y) / len(x | y)
        rows += [(2 * g, a), (2 * g + 1, b)]
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), DATA).collect()}
    assert all(2 * g in got for g in like)
    lost = {g: 2 * g + 1 not in got for g in like}
    assert not any(lost[g] for g, v in like.items() if v < 0.8)
    at = [lost[g] for g, v in like.items() if 0.8 <= v < 0.81]
    assert len(at) == 200 and sum(at) / len(at) >= 0.95
    above = [lost[g] for g, v in like.items() if v >= 0.81]
    assert len(above) == 200 and sum(above) / len(above) >= 0.98


def test_hot_keys_are_dealt_to_salts(spark):
    """Keys over ``split`` rows: every row is held against the key's pivot, and against others within its salt."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(i, " ".join(words + [f"end{i}"])) for i in range(120)] + [(1000 + i, " ".join(f"v{rng.randrange(5000)}" for _ in range(300))) for i in range(10)]
    got = {r.doc_id for r in simhash.keep_one_alike(spark.createDataFrame(rows, SCHEMA), split=16).collect()}
    assert got == {0} | set(range(1000, 1010))


def test_every_two_rows_of_a_hot_key_meet(spark):
    """Rows of one key, over ``split``, that are near each other and far from the key's least node: links join all of them."""
    rng, n = np.random.default_rng(6), 40
    base = rng.integers(0, 1 << 63, simhash.WIDE, np.uint64)
    far = ~base
    wide = [far] + [base ^ np.r_[np.uint64(0), np.uint64(1) << rng.integers(0, 60, simhash.WIDE - 1).astype(np.uint64)] for _ in range(n - 1)]
    nodes = spark.createDataFrame([(i, bytearray(w.tobytes()), int(w[:1].view(np.int64)[0])) for i, w in enumerate(wide)], "node long, wide binary, narrow long")
    keyed = nodes.selectExpr("5L as key", "node", "node as root", "narrow")
    found = simhash._links(keyed, nodes.select("node", "wide"), n, simhash.wide_bound(simhash.WIDE, deviations=-simhash.SLACK), simhash.wide_bound(simhash.WIDE), 4).collect()
    root = simhash.joined(n, np.array([r.a for r in found]), np.array([r.b for r in found]))
    assert list(root) == [0] + [1] * (n - 1)


def test_clashing_columns_long_texts_and_empty_table(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, long, 5, "a"), (2, long + " more", 6, "b"), (None, long, 7, "c"), (3, None, 8, "d"), (4, "  ", 9, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash int, rank string")
    for keep in (simhash.keep_one, simhash.keep_one_alike):
        got = sorted(keep(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
        assert [(r.doc_id, r.text_hash, r["rank"]) for r in got] == [(1, 5, "a"), (3, 8, "d"), (None, 7, "c")]
        assert keep(docs.where("false")).collect() == []
