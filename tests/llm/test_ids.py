"""Ids beyond 2^53 beside a null in one batch stay whole in every operator."""

import pytest

from quillmark.llm import decontaminate, fingerprints, language_id, line_dedup, mixing, quality, secrets, simhash, substring_dedup

IDS = [2**53 + 1, -(2**63), None, 2**63 - 1, 5]
LINE = "one line of quite some words that is repeated as it stands in the table"


def docs(spark):
    texts = [f"{LINE}\nalpha beta {i} gamma" for i in range(len(IDS))]
    return spark.createDataFrame(list(zip(IDS, texts, ["en", "de", "en", "de", None], strict=True)), "doc_id long, text string, lang string").withColumn("source", language_id.F.lit("s")).coalesce(1)


def model(spark):
    rows = spark.createDataFrame([(i, "the cat and the hat" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    return language_id.train(rows)


def scorer(spark, df):
    return quality.train(df, spark.createDataFrame([(5, 1), (2**63 - 1, 0)], "doc_id long, quality int"))


OPERATORS = {
    "op1": lambda s, d: language_id.identify(d, model(s)),
    "op2": lambda s, d: quality.score(d, scorer(s, d)),
    "op3": lambda s, d: decontaminate.decontaminate(d, s.createDataFrame([(1, LINE)], "item_id long, text string")),
    "op4": lambda s, d: secrets.scan(d),
    "op5": lambda s, d: fingerprints.fingerprint(d),
    "op6": lambda s, d: substring_dedup.dedup(d),
    "op7": lambda s, d: mixing.mix(d),
    "op8": lambda s, d: simhash.components(d),
    "op10": lambda s, d: line_dedup.deduplicate(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_stay_whole(spark, name):
    rows = OPERATORS[name](spark, docs(spark)).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted(IDS, key=str)
    if name == "op3":
        assert all(r["contaminated"] and r["n_hit"] == len(LINE.split()) for r in rows)
    if name == "op10":  # the least id keeps the line, a null id comes last
        assert {r["doc_id"]: r["n_removed"] for r in rows} == {i: 0 if i == -(2**63) else 1 for i in IDS}


def test_op8_and_pipeline_stages_keep_ids(spark):
    d = docs(spark)
    names = {r["doc_id"]: r["component_id"] for r in simhash.components(d).collect()}
    assert all(v is None or v in IDS for v in names.values())
    kept = decontaminate.drop_contaminated(d, spark.createDataFrame([(1, "alpha beta 2 gamma")], "item_id long, text string"))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i in IDS if i is not None), key=str)


def test_letterless_numerals_have_no_language(spark):
    m = model(spark)
    lang, score, _ = m.predict(["½ ²", "١٢٣", "", None, "½ a"])
    assert lang[:4] == ["und"] * 4 and (score[:4] == 0).all() and lang[4] != "und"
