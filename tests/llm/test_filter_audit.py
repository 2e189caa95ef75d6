from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quillmark.llm import filter_audit as fa

BIG = 2**53 + 1
ROWS = [
    (1, "a b c", "x"), (2, "a b c", "x"), (3, None, None), (4, "", ""), (5, " ".join(f"w{i}" for i in range(60)), "x"), (6, "AB " * 60, "y"), (7, "word " * 49 + "# end", "y"),
    (8, " ".join(f"Word{i}" for i in range(50)), "y"), (BIG, "a b c", "x"), (None, "a b c", "x"), (None, "only here", None), (5, " ".join(f"w{i}" for i in range(60)), "x"), (9, "x y z " * 20 + "é", "é"),
    (10, "a b c", "z"), (-(2**63), "low", "z"), (11, "low", "z"), (12, "v w " * 9000, "z"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (5, 1, 1), (5, 0, 0), (10, None, 1), (None, 1, 1), (99, 1, 1), (11, 1, None), (BIG, 1, 0)]


def brute(rows, labels):
    def words(t):
        out, w = [], ""
        for c in t + " ":
            if c in " \t\n\v\f\r":
                out, w = (out + [w] if w else out), ""
            else:
                w += c
        return out

    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, x in labels if x == 1 and k is not None}
    marked = []
    for k, t, s in rows:
        t = t or ""
        w = words(t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t)]
        fails.append(any(j is not None and (u or "") == t and (k is None or j < k) for j, u, _ in rows))
        marked.append((s or "", fails, k in good, k in toxic))
    out = {}
    for part in {m[0] for m in marked}:
        rows_, shapley = [m for m in marked if m[0] == part], dict.fromkeys("ABCDE", 0)
        got = {}
        for order in map("".join, permutations("ABCDE")):
            left = rows_
            for step, name in enumerate(order, 1):
                i = "ABCDE".index(name)
                gone = [m for m in left if m[1][i]]
                left = [m for m in left if not m[1][i]]
                shapley[name] += len(gone)
                failing = [m for m in rows_ if m[1][i]]
                got[order, step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(m[1]) == 1 for m in failing), sum(m[2] for m in gone), sum(m[3] for m in gone), name]
        out |= {(part, *k): (*v[:6], shapley[v[6]]) for k, v in got.items()}
    return out


def frames(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"part": F.lit("no"), "fails": F.lit("no"), "digest": F.lit(1), "k": F.lit(3)})
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("k", F.lit(5))


def test_audit_against_brute_force(spark):
    docs, labels = frames(spark, ROWS, LABELS)
    got = fa.audit(fa.flagged(docs.repartition(3), labels)).collect()
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in got} == brute(ROWS, LABELS)
    assert len(got) == 600 * len({s or "" for *_, s in ROWS})


def test_small_blocks_give_the_same(spark):
    docs, labels = frames(spark, ROWS * 20, LABELS)
    rows = fa.flagged(docs, labels)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(fa.counts(rows, 5, block_rows=7)) == key(fa.counts(rows, 5))


def test_empty_table_and_bounds(spark):
    docs, labels = frames(spark, [], [])
    assert fa.audit(fa.flagged(docs, labels)).count() == 0
    with pytest.raises(ValueError):
        fa.audit(fa.flagged(docs, labels), "ABCDEFGHI")


def test_chosen_orders_and_names(spark):
    docs, labels = frames(spark, ROWS, LABELS)
    got = fa.audit(fa.flagged(docs, labels), "ABC", ["CA", "B"]).where("part = 'x'").orderBy("filter_order", "step").collect()
    assert [(r["filter_order"], r["step"]) for r in got] == [("B", 1), ("CA", 1), ("CA", 2)]
