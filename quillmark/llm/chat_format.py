"""Chat formatting: records of any known layout become canonical turns, then one text with a loss mask that can be read back.

A record's schema fingerprint is the hash of its nested field paths. It selects a declarative mapping (``Layout``): a
record type and an SQL expression that gives the turns. One pass holds every mapping, so mixed layouts need no
scan each. The template marks turns by control strings; such strings inside texts get a backslash after their first
character, and those that have backslashes there one more, so that unescaping is exact.

A null text or role is empty. Turns of a conversation are in order of their number, unnumbered ones last, ties by role and then
text; repeated rows are turns of their own. Rows without a conversation id are one conversation. Records that are not
JSON objects, or of unknown layout, give no turns; ``unknown_layouts`` counts them. An empty table gives no rows. Long texts
stay whole: a conversation passes by turn for turn, and no task holds all of it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.common import width
from quillmark.llm._ids import mapped

TURNS = "array<struct<at: bigint, role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """``record``: the type of records, as DDL. ``turns``: SQL over the record ``r`` for an array of (at, role, text).

    Records may lack the fields named in ``optional``, and any list of theirs may be empty.
    """

    name: str
    record: str
    turns: str
    optional: tuple[str, ...] = ()

    def shapes(self) -> Iterator[str]:
        """Every fingerprint that records of this layout have."""
        fields = T.StructType.fromDDL(self.record).fields
        for n in range(len(self.optional) + 1):
            for gone in combinations(self.optional, n):
                for found in _shapes([(f.name, f.dataType) for f in fields if f.name not in gone]):
                    yield fingerprint(found)


_PAIR = "array(struct(0L AS at, 'user' AS role, {} AS text), struct(1L AS at, 'assistant' AS role, {} AS text))"
_SPEAKERS = "CASE lower(m.{0}) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE m.{0} END"

LAYOUTS = (
    Layout("turn", "conv_id bigint, turn bigint, role string, text string", "array(struct(r.turn AS at, r.role AS role, r.text AS text))", ("conv_id",)),
    Layout("prompt_response", "prompt string, response string", _PAIR.format("r.prompt", "r.response")),
    Layout("prompt_completion", "prompt string, completion string", _PAIR.format("r.prompt", "r.completion")),
    Layout("question_answer", "question string, answer string", _PAIR.format("r.question", "r.answer")),
    Layout(
        "instruction",
        "system string, instruction string, input string, output string",
        "filter(array(struct(-1L AS at, 'system' AS role, r.system AS text),"
        " struct(0L AS at, 'user' AS role, CASE WHEN r.input <> '' THEN r.instruction || '\\n\\n' || r.input ELSE r.instruction END AS text),"
        " struct(1L AS at, 'assistant' AS role, r.output AS text)), t -> t.at >= 0 OR t.text <> '')",
        ("system", "input"),
    ),
    Layout("messages", "messages array<struct<role: string, content: string>>", "transform(r.messages, (m, i) -> struct(bigint(i) AS at, m.role AS role, m.content AS text))"),
    Layout(
        "message_parts",
        "messages array<struct<role: string, content: array<struct<type: string, text: string>>>>",
        "transform(r.messages, (m, i) -> struct(bigint(i) AS at, m.role AS role, array_join(transform(filter(m.content, p -> p.type = 'text'), p -> p.text), '') AS text))",
    ),
    Layout(
        "conversations",
        "system string, conversations array<struct<`from`: string, value: string>>",
        "concat(filter(array(struct(-1L AS at, 'system' AS role, r.system AS text)), t -> t.text <> ''),"
        f" transform(r.conversations, (m, i) -> struct(bigint(i) AS at, {_SPEAKERS.format('`from`')} AS role, m.value AS text)))",
        ("system",),
    ),
    Layout(
        "exchanges",
        "dialog array<struct<user: string, assistant: string>>",
        "flatten(transform(r.dialog, (m, i) -> array(struct(bigint(2 * i) AS at, 'user' AS role, m.user AS text), struct(bigint(2 * i + 1) AS at, 'assistant' AS role, m.assistant AS text))))",
    ),
)


def _shapes(fields: list[tuple[str, T.DataType]]) -> Iterator[frozenset[str]]:
    """The sets of field paths that records with these fields can have: any list may be empty."""
    for parts in product(*[list(_field_shapes(at, kind)) for at, kind in fields]):
        yield frozenset().union(*parts)


def _field_shapes(at: str, kind: T.DataType) -> Iterator[frozenset[str]]:
    if isinstance(kind, T.StructType):
        yield from _shapes([(f"{at}.{f.name}", f.dataType) for f in kind.fields])
    elif isinstance(kind, T.ArrayType):
        yield frozenset({f"{at}[]"})
        inner = _shapes([(f"{at}[].{f.name}", f.dataType) for f in kind.elementType.fields]) if isinstance(kind.elementType, T.StructType) else [frozenset()]
        yield from (s | {f"{at}[]"} for s in inner)
    else:
        yield frozenset({at})


def paths(value: object, at: str = "") -> Iterator[str]:
    """The field paths of a parsed JSON value: ``a.b`` for objects, ``a[]`` for lists, whose elements are seen as one."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        yield f"{at}[]"
        for v in value:
            yield from paths(v, f"{at}[]")
    elif not at.endswith("[]"):
        yield at


def fingerprint(found: set[str] | frozenset[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(found)).encode("utf-8", "replace"))


def _shape(record: str | None) -> str | None:
    try:
        value = json.loads(record) if isinstance(record, str) else None
    except (ValueError, RecursionError):
        return None
    return fingerprint(set(paths(value))) if isinstance(value, dict) else None


@F.pandas_udf(T.StringType())
def shape(record: pd.Series) -> pd.Series:
    """The schema fingerprint of JSON objects; null for anything else."""
    return record.map(_shape)


def recognised(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with ``fingerprint`` and the name of the layout that it selects, null if none."""
    known = {}
    for lay in layouts:
        for s in lay.shapes():
            known.setdefault(s, lay.name)  # of layouts that differ only inside a list, the first takes the empty one
        if lay.name not in known.values():
            raise ValueError(f"records of {lay.name} have the fields of an earlier layout")
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    out = records.withColumn("fingerprint", shape(record))
    return out.withColumn("layout", F.when(F.col("fingerprint").isNotNull(), names[F.col("fingerprint")]))


def canonical(records: DataFrame, key: str = "key", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, at, role, text) of all turns of ``records`` (key, record as JSON). Rows of one key are one conversation."""
    found = recognised(records.select(F.col(key).alias("key"), F.col(record).alias("record")), "record", layouts)
    turns = F.lit(None).cast(TURNS)
    for lay in layouts:
        one = F.expr(f"flatten(transform(array(from_json(record, '{lay.record}')), r -> {lay.turns}))").cast(TURNS)
        turns = F.when(F.col("layout") == lay.name, one).otherwise(turns)
    out = found.select("key", F.explode(turns).alias("t"))
    return out.select("key", "t.at", F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def unknown_layouts(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(fingerprint, n, example) of records that no layout takes, the least of each as the example; null: no JSON object."""
    found = recognised(records, record, layouts).where("layout is null")
    return found.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min(record).alias("example"))


@dataclass(frozen=True)
class Template:
    """Control strings that mark turns: ``marks`` has an opening and a closing one a role, ``other`` those of any other role.

    No closing mark may start within another's end, which holds where each ends in a character that none begins with.
    """

    begin: str = "<s>"
    marks: tuple[tuple[str, str, str], ...] = (("system", "[SYS] ", " [/SYS]"), ("user", "[INST] ", " [/INST]"), ("assistant", "[OUT] ", "</s>"))
    other: tuple[str, str, str] = ("[TURN] ", " [AS] ", " [/TURN]")
    trained: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return sorted({x.strip() for x in (self.begin, *(m for row in self.marks for m in row[1:]), *self.other)})

    @property
    def pattern(self) -> str:
        """A control string with any number of backslashes after its first character."""
        heads = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        return f"([{heads}])(\\\\*)({'|'.join(re.escape(c[1:]) for c in self.controls)})"

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern, r"$1\\$2$3")

    def unescaped(self, text: str) -> str:
        return re.sub(self.pattern, lambda m: m[1] + m[2][1:] + m[3], text)


TEMPLATE = Template()


def formatted(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(key, part, piece, loss) of ``turns`` (key, at, role, text): the pieces of a key in order of ``part`` are its text.

    A piece is a turn with its marks, the first one with the conversation's. ``loss`` has the stretches
    (first, end) of code points of the piece that are learnt. Numbering sorts a conversation on disk where it is long.
    """
    body, role = template.escaped(F.col("text")), F.col("role")
    opening, closing = F.concat(F.lit(template.other[0]), template.escaped(role), F.lit(template.other[1])), F.lit(template.other[2])
    for name, start, end in template.marks:
        opening, closing = F.when(role == name, F.lit(start)).otherwise(opening), F.when(role == name, F.lit(end)).otherwise(closing)
    order = Window.partitionBy("key").orderBy(F.col("at").asc_nulls_last(), "role", "text")
    rows = turns.withColumns({"part": F.row_number().over(order), "body": body, "opening": opening, "closing": closing})
    rows = rows.withColumn("opening", F.when(F.col("part") == 1, F.concat(F.lit(template.begin), "opening")).otherwise(F.col("opening")))
    first = F.length("opening").cast("long")
    loss = F.when(role.isin(*template.trained), F.array(F.struct(first.alias("first"), (first + F.length("body")).alias("end")))).otherwise(F.array().cast("array<struct<first: bigint, end: bigint>>"))
    return rows.select("key", "part", F.concat("opening", "body", "closing").alias("piece"), loss.alias("loss"))


def parsed(piece: str, template: Template = TEMPLATE) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted piece, found by their marks alone."""
    at = len(template.begin) if piece.startswith(template.begin) else 0
    while at < len(piece):
        found = next(((role, start, end) for role, start, end in template.marks if piece.startswith(start, at)), None)
        if found:
            role, start, end = found
            at += len(start)
        elif piece.startswith(template.other[0], at):
            at += len(template.other[0])
            stop = piece.index(template.other[1], at)
            role, end = template.unescaped(piece[at:stop]), template.other[2]
            at = stop + len(template.other[1])
        else:
            raise ValueError("a formatted piece does not begin with a mark of the template")
        stop = piece.index(end, at)
        yield role, template.unescaped(piece[at:stop])
        at = stop + len(end)


def read_back(pieces: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation of ``formatted``.

    Pieces are dealt by key and sorted, and pass by in a stream: of an open conversation only two running digests are held.
    """

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in it:
            out = []
            for key, part, piece, loss in zip(pdf["key"], pdf["part"], pdf["piece"], pdf["loss"], strict=True):
                if part == 1:
                    if held:
                        out.append(done(held))
                    held = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parsed(piece, template):
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                for span in loss:
                    text = template.unescaped(piece[span["first"] : span["end"]])
                    held[3] += len(text)
                    held[4].update(text.encode("utf-8", "replace"))
                held[5] += len(piece)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([done(held)], columns=names)

    def done(h: list) -> tuple:
        return h[0], h[1], h[2].hexdigest(), h[3], h[4].hexdigest(), h[5]

    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = pieces.select("key", "part", "piece", "loss").repartition(width(pieces.sparkSession), "key").sortWithinPartitions("key", "part")
    return mapped(rows, read, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", "key")


def whole_texts(pieces: DataFrame) -> DataFrame:
    """(key, text, loss): conversations as one text each, with the learnt stretches in its code points. For conversations that fit a row."""
    sorted_ = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "piece", "loss"))).alias("p"))
    start = "aggregate(slice(p, 1, i), 0L, (n, x) -> n + length(x.piece))"
    loss = F.expr(f"flatten(transform(p, (x, i) -> transform(x.loss, s -> struct(s.first + {start} AS first, s.end + {start} AS end))))")
    return sorted_.select("key", F.array_join("p.piece", "").alias("text"), loss.alias("loss"))


ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, regexp_replace(t, '([<\[])(\\*)(/INST\]|/SYS\]|/TURN\]|/s>|AS\]|INST\]|OUT\]|SYS\]|TURN\]|s>)', '\1\\\2\3', 'g') e,
    regexp_replace(r, '([<\[])(\\*)(/INST\]|/SYS\]|/TURN\]|/s>|AS\]|INST\]|OUT\]|SYS\]|TURN\]|s>)', '\1\\\2\3', 'g') q FROM rows_)
SELECT conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS LAST, r, t)) turns_sha256,
  coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS LAST, r, t) FILTER (WHERE r = 'assistant'), '')) loss_sha256,
  (3 + sum(length(e) + CASE r WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 7 + length(q) + 6 + 8 END))::BIGINT formatted_chars
FROM marked GROUP BY conv_id
"""
