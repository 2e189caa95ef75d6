"""The pipeline's stages, each held against a plain version on its own input."""

import pytest

import corpus_pipeline
from quillmark.common import table, written
from quillmark.llm import decontaminate
from quillmark.llm.queries import ORACLES, QUERIES

from tests.conftest import DATA
from tests.llm.test_operators import brute_components, brute_fingerprint, brute_hits, brute_lines


@pytest.fixture(scope="module")
def passed(spark):
    out, docs = [], table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, DATA), name)
        out.append((before, docs))
    return out


def test_stages_keep_columns(passed):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["languages", "lines", "near_copies", "benchmark_free", "mixture"]
    for before, after in passed[:-1]:
        assert after.columns == before.columns and after.schema == before.schema


def test_clean_languages_stay(passed):
    """Null and letterless texts go, and at most one of a hundred others: those between two languages."""
    before, after = passed[0]
    lettered = before.where("text rlike '[a-zA-Z]'").count()
    assert 0.99 * lettered <= after.count() <= lettered


def test_lines_stage(passed):
    before, after = passed[1]
    want = {i: t for i, _, _, t in brute_lines([(r.doc_id, r.text, "") for r in before.collect()])}
    assert {r.doc_id: r.text for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())




def test_benchmark_stage(spark, passed):
    before, after = passed[3]
    items = [(str(r.item_id), r.text) for r in table(spark, DATA, "benchmark").collect()]
    windows = {}
    for i, t in items:
        w = decontaminate.words(t)
        for x in [tuple(w[a : a + 10]) for a in range(max(1, len(w) - 9))] if w else []:
            windows.setdefault(x[0], set()).add(x)
    def hit(text):
        w = decontaminate.words(text)
        return any(tuple(w[a : a + len(x)]) == x for a, first in enumerate(w) for x in windows.get(first, ()))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if not hit(r.text)}
    assert brute_hits(items[0][1], [items[0]])[1] > 0


def test_mixture_stage(passed):
    before, after = passed[4]
    assert after.count() == before.count()
    rows = after.collect()
    assert abs(sum(r.taken for r in rows) - sum(r.size for r in rows)) <= len({r.source for r in rows})


def test_run_gives_the_last_stage(spark, passed):
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, passed[-1][1].collect()))


def test_an_empty_table_passes_through_the_whole_pipeline(spark, tmp_path):
    for name in ("documents", "benchmark"):
        table(spark, DATA, name).where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_held_out_accuracy(spark):
    """Language and quality on rows that never trained, over a larger table."""
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", "quality").collect()}
    got = [r for r in QUERIES["op1_language_id"](spark, d).collect() if r.held_out]
    assert sum(truth[r.doc_id].lang == r.lang_pred for r in got) / len(got) > 0.98
    got = [r for r in QUERIES["op2_quality"](spark, d).collect() if r.held_out and truth[r.doc_id].quality is not None]
    assert sum(truth[r.doc_id].quality == r.predicted for r in got) / len(got) > 0.95


def test_stages_on_nulls_long_and_repeated_texts_and_clashing_columns(spark):
    """Each stage on its own: columns whose names operators use inside stay as they are, an empty table gives none."""
    real = [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, DATA, "documents").limit(60).collect()]
    long = " ".join(r[1] or "" for r in real if r[2] == "en") * 20
    rows = real + [(None, "No id here, but a text of some words in a line of its own.", "en", None), (900, None, None, "s"), (901, "", "en", "s"), (902, "  ", "en", None), (903, long, "en", "s"), (904, "the same row twice, word for word, in the table", "en", "s")]
    rows += [(904, "the same row twice, word for word, in the table", "en", "s")]
    extra = ("text_hash", "rank", "t", "i", "h", "x", "gone", "__n_lines", "__n_removed", "node", "root", "k")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *range(len(extra))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in extra))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.schema == docs.schema
        kept[name] = out.collect()
        assert all(tuple(r[c] for c in extra) == tuple(range(len(extra))) for r in kept[name])
        if name != "languages":  # it learns from its input
            assert stage(spark, docs.where("false"), DATA).count() == 0
    ids = lambda name: [r.doc_id for r in kept[name]]
    assert not {900, 901, 902} & set(ids("languages")) and {None, 903, 904} <= set(ids("languages")) and ids("languages").count(904) == 2
    assert len(ids("lines")) == len(rows) and {r.doc_id: r.text for r in kept["lines"]}[900] is None
    assert ids("near_copies").count(904) == 1 and ids("near_copies").count(None) == 1 and len({900, 901, 902} & set(ids("near_copies"))) == 1
    assert {None, 900, 901, 902, 904} <= set(ids("benchmark_free"))
    mixed = corpus_pipeline.mixture(spark, docs, DATA).collect()
    assert len(mixed) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in mixed)
    assert corpus_pipeline.mixture(spark, docs.where("false"), DATA).count() == 0
