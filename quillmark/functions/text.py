"""Text expressions: model replies, file names, templates, judge scores. Column in, Column out, no Python on rows.

Patterns read ASCII digits and white space.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LABEL = r"(-1|[01])"


def _last(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def label(reply: Column) -> Column:
    """SF1: 0, 1 or -1 from a reply, by the first rule that matches; -1 if none does.

    The word before a colon, the last bold label, the lowest line that is a label alone, the last list
    item, the last free-standing digit (so that " -1" alone reads as 1).
    """
    text = F.btrim(reply, F.lit(" \t\n\r\x0b\x0c"))
    stated = F.nullif(F.regexp_extract(text, r"(?i)conclusion\s*[:：]\s*([01]|-1)", 1), F.lit(""))
    bold = _last(_all(text, r"\*\*\s*([01]|-1)\s*\*\*"))

    def bare(line: Column) -> Column:
        line = F.btrim(line, F.lit(" \t\r"))
        return F.when(line.startswith("**") & line.endswith("**"), F.btrim(F.btrim(line, F.lit("*")), F.lit(" \t\r"))).otherwise(line)

    alone = _last(F.filter(F.transform(F.split(text, "\n"), bare), lambda x: x.isin("0", "1", "-1")))
    item = _last(_all(text, r"(?md)^[-*]\s+([01]|-1)\s*$"))
    digit = _last(_all(text, r"\b([01]|-1)\b"))
    return F.coalesce(stated, bold, alone, item, digit, F.lit("-1")).cast("int")


def decision(reply: Column) -> Column:
    """SF2: '0', '1', '-1', or '' where nothing matches or the first rule that matches finds two values.

    Only the text from the last "conclusion" on is read. A rule with asterisks before that word could never
    match there, so there is none.
    """
    low = F.lower(reply)
    region = F.when(F.instr(low, "conclusion") > 0, F.right(reply, F.length(F.substring_index(low, "conclusion", -1)) + 10)).otherwise(reply)
    rules = (
        rf"(?md)^\s*{_LABEL}\s*$",
        rf"\*\*\s*{_LABEL}\s*\*\*",
        rf"(?md)^\s*-\s+[\"']?\s*{_LABEL}\s*[\"']?",
        rf"(?d)(?<!\S){_LABEL}(?=$|\s|[.,;:!?])",
    )
    out = F.lit("")
    for rule in reversed(rules):
        values = F.array_distinct(_all(region, rule))
        out = F.when(F.size(values) == 1, values[0]).when(F.size(values) > 1, F.lit("")).otherwise(out)
    return out


def decision_by_substring(reply: Column) -> Column:
    """SF3: bold labels if unambiguous, then list items, new lines, blanks; 0 before 1 before -1 in each form."""
    bold = {v: reply.contains(f"**{v}**") for v in ("0", "1", "-1")}
    out = F.when(bold["0"] & ~bold["1"] & ~bold["-1"], "0").when(bold["1"] & ~bold["0"] & ~bold["-1"], "1").when(bold["-1"], "-1")
    for form in ("- '{}'", "\n{}", " {}"):
        for v in ("0", "1", "-1"):
            out = out.when(reply.contains(form.format(v)), v)
    return out.otherwise("")


def label_of_single_prompt(reply: Column) -> Column:
    """SF4: -1, 0, 1 by containment in that order, else -1."""
    return F.when(reply.contains("-1"), -1).when(reply.contains("0"), 0).when(reply.contains("1"), 1).otherwise(-1)


#: The sample file-name formats. A sign in a number is not part of them.
FILE_V1 = r"^pc_(\d+)_bin_(\d+)_r_([\d.]+)_t_([\d.]+)_emb_([a-zA-Z0-9]+)(?:_sid\d+)?(?:_view(\w+))?\.jpg$"
FILE_V2 = r"^pc_(\d+)_bin_(\d+)_r_([\d.]+)_t_([\d.]+)_emb_([a-zA-Z0-9]+)(?:_view(\w+))?\.jpg$"


def file_name(name: Column, pattern: str = FILE_V1) -> Column:
    """SF5, SF6: struct(idx, bin, r, t, emb, view); all null where the name has another form."""
    part = lambda i: F.regexp_extract(name, pattern, i)
    whole = name.rlike(pattern)
    return F.struct(
        F.when(whole, part(1).try_cast("long")).alias("idx"),
        F.when(whole, part(2).try_cast("int")).alias("bin"),
        F.when(whole, part(3).try_cast("double")).alias("r"),
        F.when(whole, part(4).try_cast("double")).alias("t"),
        F.when(whole, part(5)).alias("emb"),
        F.when(whole, part(6)).alias("view"),
    )


def view_name(name: Column) -> Column:
    """SF7: struct(idx, view) of a view's file name."""
    return F.struct(F.regexp_extract(name, r"^pc_(\d+)_", 1).try_cast("long").alias("idx"), F.regexp_extract(name, r"_view(\w+)\.jpg$", 1).alias("view"))


def base_name(url: Column) -> Column:
    """SF8."""
    return F.element_at(F.split(url, "/"), -1)


def situations(text: Column) -> Column:
    """SF9: struct of two lists of urls from "Situation 1: ... Situation 2: ..."."""
    one = F.regexp_extract(text, r"(?is)situation\s*1\s*:(.*?)situation\s*2\s*:", 1)
    two = F.regexp_extract(text, r"(?is)situation\s*2\s*:(.*)$", 1)
    urls = lambda t: F.filter(F.split(t, r"\s+"), lambda x: x != "")
    return F.struct(urls(one).alias("one"), urls(two).alias("two"))


def before_objective(text: Column) -> Column:
    """SF10: the text before "Objective:" in any case."""
    return F.substring(text, F.lit(1), F.length(F.substring_index(F.lower(text), "objective:", 1)))


def fenced_json(text: Column) -> Column:
    """SF11: the body of the first fenced block, else the whole text."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1), F.lit("")), text)


SCORES = "map<string,struct<Score:string,Explanation:string>>"


def judge_scores(text: Column) -> Column:
    """SF11: map of metric to score and explanation; null where the JSON is broken."""
    return F.from_json(fenced_json(text), SCORES)


def verdict(reply: Column) -> Column:
    """SF12: struct(accuracy, cls, reason) of "T#why"; anything else is INVALID, as is an empty reply."""
    r = F.btrim(reply, F.lit(" \t\n\r"))
    first = F.upper(F.substring(r, 1, 1))
    ok = first.isin("T", "F")
    return F.struct(
        F.when(first == "T", 1).otherwise(0).alias("accuracy"),
        F.when(ok, first).otherwise("INVALID").alias("cls"),
        F.when(ok, F.substring(r, 3, 1 << 30)).otherwise(r).alias("reason"),
    )


def closed_class(reply: Column, n_classes: int, key: Column) -> Column:
    """SF13: struct(cls, label) of "7#car#why". Out of range, NA or unreadable: a class drawn by hash of ``key``, label INVALID."""
    found = F.nullif(F.regexp_extract(reply, r"(\d+#[^#]*#.*$)", 1), F.lit(""))
    parts = F.split(F.btrim(F.coalesce(found, reply), F.lit(" \t\n\r")), "#")
    cls, name = F.get(parts, F.lit(0)).try_cast("int"), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    ok = F.coalesce(cls.between(0, n_classes - 1) & (name != "NA"), F.lit(False))
    drawn = F.conv(F.substring(F.md5(key.cast("string")), 1, 6), 16, 10).cast("int") % n_classes
    return F.struct(F.when(ok, cls).otherwise(drawn).alias("cls"), F.when(ok, name).otherwise("INVALID").alias("label"))


def rating(reply: Column) -> Column:
    """SF14: the score of "85#why" or of "85" alone, -1 unless it is a whole number of 0 to 100.

    The first line that has a # counts from the digits before it on; without any the reply as a whole.
    """
    lead = F.when(reply.contains("#"), F.regexp_extract(reply, r"(\d*)#", 1)).otherwise(F.regexp_replace(reply, r"(?U)^\s+|\s+$", ""))
    n = F.when(lead.rlike(r"^[+-]?\d+(_\d+)*$"), F.regexp_replace(lead, "_", "").try_cast("int"))
    return F.when(n.between(0, 100), n).otherwise(-1)


#: Parts of result file names and the display names they stand for, the more specific first.
MODEL_NAMES = (
    ("llama31r1_8b_cot_think", "DeepSeek-R1-Distill-Llama-8B Tagged CoT"),
    ("llama31r1_8b_cot_unthink", "DeepSeek-R1-Distill-Llama-8B Unmarked CoT"),
    ("llama31_8b_nocot", "Llama-3.1-8B-Instruct No CoT"),
    ("llama31_8b_cot_think", "Llama-3.1-8B-Instruct Tagged CoT"),
)
#: Model families and their categories.
CATEGORIES = (("Llama-3.1-8B-Instruct", "LLM"), ("DeepSeek-R1-Distill-Llama-8B", "LRM"))
#: Judged metrics and their report columns.
METRICS = {"Truthfulness": "TRU", "Completeness": "COMP", "Object Recognition": "OBJ", "Functional Reasoning": "FUNC", "Interaction Prediction": "INTER"}


def _first_contained(text: Column, table: tuple, other: Column) -> Column:
    out = None
    for part, name in table:
        out = (out.when if out is not None else F.when)(text.contains(part), name)
    return out.otherwise(other)


def display_name(file: Column) -> Column:
    """SF15."""
    return _first_contained(file, MODEL_NAMES, file)


def model_and_annotation(name: Column) -> Column:
    """SF16: struct(model, annotation); the annotation is the last two words of three or more."""
    form = r"^(.*) ([^ ]*) ([^ ]*)$"
    whole = name.rlike(form)
    return F.struct(
        F.when(whole, F.trim(F.regexp_extract(name, form, 1))).otherwise(name).alias("model"),
        F.when(whole, F.concat_ws(" ", F.regexp_extract(name, form, 2), F.regexp_extract(name, form, 3))).otherwise("").alias("annotation"),
    )


def category(model: Column) -> Column:
    """SF17."""
    return _first_contained(model, CATEGORIES, F.lit("Unknown"))


def mean_and_spread(mean: Column, spread: Column) -> Column:
    """SF18."""
    return F.when(mean.isNull() | spread.isNull(), "—").otherwise(F.format_string("%.2f ± %.2f", mean, spread))


def flips(b: Column, f: Column) -> Column:
    """SF19: whether swapping the pair swaps the decision."""
    return F.coalesce(((b == "0") & (f == "1")) | ((b == "1") & (f == "0")) | ((b == "-1") & (f == "-1")), F.lit(False))


def short_digest(text: Column) -> Column:
    """SF20 over text: 8 hex digits of MD5, 'nohash' for null."""
    return F.coalesce(F.substring(F.md5(text), 1, 8), F.lit("nohash"))


def clean_file_name(name: Column) -> Column:
    """SF21: without ``_part_N`` and ``_viewX``."""
    return F.regexp_replace(F.regexp_replace(name, r"_part_\d+", ""), r"_view[A-Za-z0-9]+", "")


def moved_to_bin(name: Column, bin_id: Column) -> Column:
    """SF21: the name with another bin."""
    return F.regexp_replace(name, F.lit(r"_bin_\d+"), F.concat(F.lit("_bin_"), bin_id.cast("string")))


def prompt(system: Column, messages: Column, style: str = "single", sep: str = "###", sep2: str = "</s>") -> Column:
    """SF22: a conversation as one string. messages: array of struct(role, text); a null or empty text leaves the role open.

    single: "role: text" and sep after each; two: sep and sep2 in turn; mpt: role and text as they are, sep after each;
    plain: texts alone, sep and sep2 in turn.
    """
    said_ = lambda m: m.text.isNotNull() & (m.text != "")
    turn = lambda i: F.when(i % 2 == 0, F.lit(sep)).otherwise(F.lit(sep2))
    if style == "single":
        said = F.transform(messages, lambda m: F.when(said_(m), F.concat(m.role, F.lit(": "), m.text, F.lit(sep))).otherwise(F.concat(m.role, F.lit(":"))))
        return F.concat(system, F.lit(sep), F.array_join(said, ""))
    if style == "two":
        said = F.transform(messages, lambda m, i: F.when(said_(m), F.concat(m.role, F.lit(": "), m.text, turn(i))).otherwise(F.concat(m.role, F.lit(":"))))
        return F.concat(system, F.lit(sep), F.array_join(said, ""))
    if style == "mpt":
        said = F.transform(messages, lambda m: F.when(said_(m), F.concat(m.role, m.text, F.lit(sep))).otherwise(m.role))
        return F.concat(system, F.lit(sep), F.array_join(said, ""))
    if style == "plain":
        return F.concat(system, F.array_join(F.transform(messages, lambda m, i: F.when(m.text.isNotNull(), F.concat(m.text, turn(i))).otherwise("")), ""))
    raise ValueError(f"no such style: {style}")


def last_line(reply: Column) -> Column:
    """SF23."""
    return F.element_at(F.split(reply, "\n"), -1)


def first_line(reply: Column) -> Column:
    """SF23."""
    return F.split(reply, "\n")[0]


def data_uri(path: Column, content: Column) -> Column:
    """SF25."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    mime = F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "png", "image/png").when(ext == "gif", "image/gif").otherwise("application/octet-stream")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def with_alpha(xml: Column, alpha: str) -> Column:
    """SF28: every ``rgba`` attribute with another fourth number."""
    return F.regexp_replace(xml, r"""(rgba=["']\s*\S+\s+\S+\s+\S+\s+)[^"'\s]+""", "$1" + alpha)


def has_keyword(text: Column, words: list[str]) -> Column:
    """SF27: whether any word is contained."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def suffix_number(key: Column, sep: str = "-") -> Column:
    """SR1, SR2: the number after the last ``sep``, 999999 if it is none."""
    return F.coalesce(F.substring_index(key, sep, -1).try_cast("long"), F.lit(999999).cast("long"))


def natural_key(name: Column) -> Column:
    """SR4: sorts runs of digits by value: each is led by how many digits it has without leading zeros, in eight places."""
    tokens = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = lambda t: F.regexp_replace(t, "^0+(?=.)", "")
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^\d"), F.concat(F.lpad(F.length(bare(t)).cast("string"), 8, "0"), F.lit("."), bare(t))).otherwise(F.lower(t))), "")


def filled(template: str, objective: Column, first: Column, second: Column) -> Column:
    """PF9: {objective} and {situationK_urlN}, N from 1; a url that is not there is ''."""
    out = F.replace(F.lit(template), F.lit("{objective}"), objective)
    for k, urls in ((1, first), (2, second)):
        for n in sorted({int(n) for n in re.findall(rf"\{{situation{k}_url([1-9]\d*)\}}", template)}):
            out = F.replace(out, F.lit(f"{{situation{k}_url{n}}}"), F.coalesce(F.get(urls, F.lit(n - 1)), F.lit("")))
    return out


def first_replaced(text: Column, mark: str, by: Column) -> Column:
    """PF10: the first occurrence only."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), by, F.substring(text, at + len(mark), F.length(text)))).otherwise(text)


def tokens(text: Column) -> Column:
    """What stands between white space."""
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))


def n_grams(words: Column, n: int) -> Column:
    """Runs of n words, space-joined."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(T.StringType())
def vector_digest(vector: pd.Series) -> pd.Series:
    """SF20 over numbers: 8 hex digits of MD5 of the little-endian float32 bytes, 'nohash' for null."""
    return vector.map(lambda v: "nohash" if v is None else hashlib.md5(np.asarray(v, "<f4").tobytes()).hexdigest()[:8])
