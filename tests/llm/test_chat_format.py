import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quillmark.llm import chat_format as cf

BIG = 2**53 + 1


def turns_of(spark, records, layouts=cf.LAYOUTS):
    df = spark.createDataFrame([(i, json.dumps(r) if isinstance(r, dict) else r) for i, r in enumerate(records)], "key long, record string")
    return df, {i: [(t["role"], t["text"]) for t in sorted(g, key=lambda t: t["at"])] for i, g in _groups(cf.canonical(df, layouts=layouts).collect()).items()}


def _groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r["key"], []).append(r)
    return out


def test_layouts_give_canonical_turns(spark):
    records = [
        {"prompt": "p", "response": "r"}, {"completion": "c", "prompt": "p"}, {"question": "q", "answer": None}, {"instruction": "i", "output": "o"},
        {"instruction": "i", "input": "more", "output": "o", "system": "s"}, {"instruction": "i", "input": "", "output": "o"},
        {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}, {"messages": []},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}], "system": "s"}, {"dialog": [{"user": "u", "assistant": "a"}, {"user": "v", "assistant": "b"}]},
        {"unknown": 1}, "not json", None, "[1]", {"prompt": "p", "response": "r", "extra": 1},
    ]
    df, got = turns_of(spark, records)
    assert got == {
        0: [("user", "p"), ("assistant", "r")], 1: [("user", "p"), ("assistant", "c")], 2: [("user", "q"), ("assistant", "")], 3: [("user", "i"), ("assistant", "o")],
        4: [("system", "s"), ("user", "i\n\nmore"), ("assistant", "o")], 5: [("user", "i"), ("assistant", "o")], 6: [("user", "u"), ("assistant", "a")], 8: [("user", "xy")],
        9: [("system", "s"), ("user", "h"), ("assistant", "g")], 10: [("user", "u"), ("assistant", "a"), ("user", "v"), ("assistant", "b")],
    }
    left = {r["fingerprint"]: (r["n"], r["example"]) for r in cf.unknown_layouts(df).collect()}
    assert left[None][0] == 3 and left[cf.fingerprint({"unknown"})] == (1, '{"unknown": 1}') and len(left) == 3


def test_a_layout_of_ones_own(spark):
    own = cf.Layout("pair", "ask struct<text: string>, tell struct<text: string>", cf._PAIR.format("r.ask.text", "r.tell.text"))
    _, got = turns_of(spark, [{"ask": {"text": "a"}, "tell": {"text": "b"}}], (*cf.LAYOUTS, own))
    assert got == {0: [("user", "a"), ("assistant", "b")]}
    with pytest.raises(ValueError):
        turns_of(spark, [], (*cf.LAYOUTS, cf.Layout("same", "prompt string, response string", own.turns)))


def hard_text(rng):
    parts = [*cf.TEMPLATE.controls, "\\", "[", "<", "]", ">", "s>", "/s>", "INST]", " ", "\n", "é", "😀", "", "a", "[\\INST]", "<\\\\/s>"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(12)))


def brute(rows):
    groups = {}
    for k, at, role, text in rows:
        groups.setdefault(k, []).append((at is None, at, role or "", text or ""))
    out = {}
    for k, g in groups.items():
        g.sort(key=lambda t: (t[0], t[1] or 0, t[2].encode(), t[3].encode()))
        loss = "".join(t for *_, r, t in g if r == "assistant")
        out[k] = (len(g), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in g).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_reading_back_is_exact(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, BIG, -(2**63), None, 7]), rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", "system", "tool", None, "[AS]", "x [AS] y"]), rng.choice([None, "", hard_text(rng)])) for _ in range(400)]
    rows += [(50, 0, "assistant", "long [OUT] </s>" * 30_000), (50, 0, "assistant", "long [OUT] </s>" * 30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit("no"), "part": F.lit(1), "record": F.lit("{}")})
    records = df.select(F.col("conv_id").alias("key"), F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    pieces = cf.formatted(cf.canonical(records.repartition(3)))
    got = {r["key"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in cf.read_back(pieces).collect()}
    assert got == brute(rows)
    whole = cf.whole_texts(pieces).collect()
    chars = {r["key"]: r["formatted_chars"] for r in cf.read_back(pieces).collect()}
    for r in whole:
        assert len(r["text"]) == chars[r["key"]] and r["text"].count("<s>") == 1
        learnt = "".join(cf.TEMPLATE.unescaped(r["text"][s["first"] : s["end"]]) for s in r["loss"])
        assert hashlib.sha256(learnt.encode()).hexdigest() == got[r["key"]][3]
        assert len(list(cf.parsed(r["text"]))) == got[r["key"]][0]


def test_marks_of_the_text_are_only_the_templates(spark):
    df = spark.createDataFrame([(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<\\/s>")], "key long, at long, role string, text string")
    text = cf.whole_texts(cf.formatted(df)).first()["text"]
    assert text == "<s>[INST] <\\/s>[\\INST] ok [\\/INST] [/INST][OUT] <\\\\/s></s>"


def test_empty_table(spark):
    df = spark.createDataFrame([], "key long, record string")
    assert cf.read_back(cf.formatted(cf.canonical(df))).count() == 0
