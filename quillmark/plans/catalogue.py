"""Every registered query of the preference-data engine, and the SQL that gives the same rows where there is any.

Queries run over their whole tables. Floating results are rounded on both sides, so that the order of
summation doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.common import table, written
from quillmark.functions import maths, text, vectors
from quillmark.operators import capped, conversations, decisions, evaluation, neighbours, pairs, points, preferences, store, trajectories
from quillmark.plans import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return put


# --- decisions

_REGION = "CASE WHEN lower(analysis) LIKE '%conclusion%' THEN right(analysis, strpos(reverse(lower(analysis)), reverse('conclusion')) + 9) ELSE analysis END"
_WIDE = "regexp_replace(region, '\\s', '  ', 'g')"
_RULES = (
    r"regexp_extract_all(region, '(?m)^\s*(-1|[01])\s*$', 1)",
    r"regexp_extract_all(region, '\*\*\s*(-1|[01])\s*\*\*', 1)",
    r"""regexp_extract_all(region, '(?m)^\s*-\s+["'']?\s*(-1|[01])\s*["'']?', 1)""",
    rf"regexp_extract_all({_WIDE}, '(?:^|\s)(-1|[01])(?:$|\s|[.,;:!?])', 1)",
)
_PARSED = f"""regions AS (SELECT *, {_REGION} AS region FROM responses),
parsed AS (SELECT event_id, custom_id, analysis, CASE {" ".join(f"WHEN len({r}) > 0 THEN CASE WHEN len(list_distinct({r})) = 1 THEN {r}[1] ELSE '' END" for r in _RULES)} ELSE '' END AS decision FROM regions)"""


@query(f"WITH {A.RESPONSES}, {_PARSED} SELECT custom_id, decision FROM parsed")
def decision_parse_v1(spark, d):
    return A.responses(spark, d).select("custom_id", text.decision(F.col("analysis")).alias("decision"))


_V2 = "CASE " + " ".join(
    ["WHEN contains(analysis, '**0**') AND NOT contains(analysis, '**1**') AND NOT contains(analysis, '**-1**') THEN '0'", "WHEN contains(analysis, '**1**') AND NOT contains(analysis, '**-1**') AND NOT contains(analysis, '**0**') THEN '1'", "WHEN contains(analysis, '**-1**') THEN '-1'"]
    + [f"WHEN contains(analysis, {a} || '{v}' || {b}) THEN '{v}'" for a, b in (("'- '''", "''''"), ("chr(10)", "''"), ("' '", "''")) for v in ("0", "1", "-1")]
) + " ELSE '' END"


@query(f"WITH {A.RESPONSES} SELECT custom_id, {_V2} AS decision FROM responses")
def decision_parse_v2(spark, d):
    return A.responses(spark, d).select("custom_id", text.decision_by_substring(F.col("analysis")).alias("decision"))


_BARE = "list_transform(string_split(t, chr(10)), lambda l: CASE WHEN starts_with(trim(l), '**') AND ends_with(trim(l), '**') THEN trim(trim(trim(l), '*')) ELSE trim(l) END)"


@query(rf"""WITH {A.RESPONSES}, s AS (SELECT custom_id, trim(analysis, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM responses)
SELECT custom_id, coalesce(nullif(regexp_extract(t, '(?i)conclusion\s*[:：]\s*([01]|-1)', 1), ''), regexp_extract_all(t, '\*\*\s*([01]|-1)\s*\*\*', 1)[-1],
  list_filter({_BARE}, lambda x: x IN ('0', '1', '-1'))[-1], regexp_extract_all(t, '(?m)^[-*]\s+([01]|-1)\s*$', 1)[-1], regexp_extract_all(t, '\b([01]|-1)\b', 1)[-1], '-1')::INT AS label FROM s""")
def label_extract(spark, d):
    return A.responses(spark, d).select("custom_id", text.label(F.col("analysis")).alias("label"))


@query(f"WITH {A.RESPONSES} SELECT custom_id, (CASE WHEN contains(analysis, '-1') THEN -1 WHEN contains(analysis, '0') THEN 0 WHEN contains(analysis, '1') THEN 1 ELSE -1 END)::INT AS label FROM responses")
def label_single_prompt(spark, d):
    return A.responses(spark, d).select("custom_id", text.label_of_single_prompt(F.col("analysis")).alias("label"))


def _file_sql(pattern: str) -> str:
    part = lambda i: f"regexp_extract(name, '{pattern}', {i})"
    whole = f"regexp_matches(name, '{pattern}')"
    cells = [("idx", "BIGINT", 1), ("bin", "INT", 2), ("r", "DOUBLE", 3), ("t", "DOUBLE", 4), ("emb", "VARCHAR", 5), ("view", "VARCHAR", 6)]
    return f"WITH {A.FILES} SELECT event_id, " + ", ".join(f"CASE WHEN {whole} THEN TRY_CAST({part(i)} AS {k}) END AS {n}" for n, k, i in cells) + " FROM files"


@query(_file_sql(text.FILE_V1))
def filename_parse(spark, d):
    return A.files(spark, d).select("event_id", text.file_name(F.col("name")).alias("p")).select("event_id", "p.*")


@query(_file_sql(text.FILE_V2))
def filename_parse_v2(spark, d):
    return A.files(spark, d).select("event_id", text.file_name(F.col("name"), text.FILE_V2).alias("p")).select("event_id", "p.*")


_REQUESTS = "requests AS (SELECT 'e-' || event_id AS custom_id FROM events)"


@query(f"WITH {A.RESPONSES}, {_PARSED}, {_REQUESTS} SELECT q.custom_id, coalesce(p.analysis, '') AS analysis, coalesce(p.decision, '') AS decision FROM requests q LEFT JOIN (SELECT * FROM parsed WHERE event_id % 7 <> 3) p ON q.custom_id = p.custom_id")
def decision_merge_left(spark, d):
    got = A.responses(spark, d)
    return decisions.merged(got.select("custom_id"), got.where("event_id % 7 <> 3"))


_FLIP = f"""WITH {A.DECISIONS_SQL}, j AS (SELECT coalesce(b.custom_id, f.custom_id) AS custom_id, b.decision AS b, f.decision AS f,
  CASE WHEN b.custom_id IS NULL THEN 'only_flipped' WHEN f.custom_id IS NULL THEN 'only_baseline'
       WHEN (b.decision = '0' AND f.decision = '1') OR (b.decision = '1' AND f.decision = '0') OR (b.decision = '-1' AND f.decision = '-1') THEN 'consistent' ELSE 'inconsistent' END AS status
  FROM b FULL JOIN f ON b.custom_id = f.custom_id)"""


@query(f"""{_FLIP} SELECT count(*) FILTER (WHERE status IN ('consistent', 'inconsistent')) AS n_common, count(*) FILTER (WHERE status = 'consistent') AS n_consistent,
  count(*) FILTER (WHERE status = 'inconsistent') AS n_inconsistent, count(*) FILTER (WHERE status = 'only_baseline') AS n_only_baseline, count(*) FILTER (WHERE status = 'only_flipped') AS n_only_flipped,
  round(count(*) FILTER (WHERE status = 'consistent') / greatest(count(*) FILTER (WHERE status IN ('consistent', 'inconsistent')), 1), 6) AS consistency FROM j""")
def flip_audit(spark, d):
    return decisions.flip_audit(A.decisions(spark, d, False), A.decisions(spark, d, True))


@query(f"{_FLIP} SELECT custom_id, b, f, status FROM j")
def flip_pairs(spark, d):
    return decisions.flip_pairs(A.decisions(spark, d, False), A.decisions(spark, d, True))


@query("SELECT 'e-' || event_id AS custom_id FROM events WHERE event_id % 5 <> 2")
def resume_pending_anti(spark, d):
    tasks = A.responses(spark, d)
    return decisions.pending(tasks.select("custom_id"), tasks.where("event_id % 5 = 2"))


@query("SELECT 'e-' || event_id AS custom_id, event_id FROM events WHERE event_id % 9 IN (0, 1, 2)")
def retry_tasks(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("e-"), F.col("event_id").cast("string")).alias("custom_id"))
    kind = F.col("event_id") % 9
    results = e.where(kind != 0).select("custom_id", F.when(kind == 1, "").otherwise("ok").alias("text"), F.when(kind == 2, "timeout").alias("error"))
    return decisions.to_retry(e, results)


@query(f"WITH {A.DECISIONS_SQL} SELECT custom_id, decision FROM f UNION ALL SELECT custom_id, decision FROM b WHERE custom_id NOT IN (SELECT custom_id FROM f)")
def upsert_latest(spark, d):
    return decisions.overlaid(A.decisions(spark, d, False), A.decisions(spark, d, True))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_per_key(spark, d):
    return decisions.latest(table(spark, d, "events"), "user_id", F.col("event_id"), "event_type")


_IDS = "ids AS (SELECT event_id, CASE WHEN event_id % 10 = 7 THEN 'e-x' ELSE 'env-e-' || event_id END AS custom_id FROM events)"


@query(f"WITH {_IDS}, s AS (SELECT *, coalesce(TRY_CAST(string_split(custom_id, '-')[-1] AS BIGINT), 999999) AS suffix FROM ids) SELECT event_id, custom_id, suffix, row_number() OVER (ORDER BY suffix, event_id) AS place FROM s")
def suffix_sort_rank(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 7, "e-x").otherwise(F.concat(F.lit("env-e-"), F.col("event_id").cast("string"))).alias("custom_id"))
    keyed = decisions.suffix_ordered(e, "custom_id", "event_id")
    placed = decisions.chunked(keyed.withColumn("k", F.struct("suffix", "event_id")), "k", 1 << 40)
    return placed.select("event_id", "custom_id", "suffix", (F.col("line") + 1).alias("place"))


@query("WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) SELECT event_id, i // 300 AS chunk, i % 300 AS line FROM n")
def chunk_assign(spark, d):
    return decisions.chunked(table(spark, d, "events").select("event_id"), "event_id", 300)


@query("SELECT event_id, 'p' || (event_id % 100) || 'img' || event_id || '.jpg' AS name, 'p' || lpad(length((event_id % 100)::VARCHAR)::VARCHAR, 8, '0') || '.' || (event_id % 100) || 'img' || lpad(length(event_id::VARCHAR)::VARCHAR, 8, '0') || '.' || event_id || '.jpg' AS key FROM events")
def natural_sort_key(spark, d):
    name = F.concat(F.lit("p"), (F.col("event_id") % 100).cast("string"), F.lit("img"), F.col("event_id").cast("string"), F.lit(".jpg"))
    return table(spark, d, "events").select("event_id", name.alias("name"), text.natural_key(name).alias("key"))


@query("""WITH p AS (SELECT user_id::VARCHAR AS custom_id, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN 'text' ELSE 'image' END AS kind, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN (event_id // 6) % 2 + 1 END AS marker FROM events),
m AS (SELECT custom_id, pos, kind, last_value(marker IGNORE NULLS) OVER (PARTITION BY custom_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS named FROM p)
SELECT custom_id, pos, coalesce(named, row_number() OVER (PARTITION BY custom_id ORDER BY pos))::INT AS situation FROM m WHERE kind = 'image'""")
def situation_carry(spark, d):
    i = F.col("event_id")
    said = F.when((i % 3 == 0) & (i % 2 == 0), F.concat(F.lit("Situation "), (F.floor(i / 6) % 2 + 1).cast("string"), F.lit(":"))).otherwise("objective")
    parts = table(spark, d, "events").select(F.col("user_id").cast("string").alias("custom_id"), i.alias("pos"), F.when(i % 3 == 0, "text").otherwise("image").alias("kind"), said.alias("text"))
    return decisions.carried_situation(parts).select("custom_id", "pos", "situation")


@query("SELECT event_id, 'Q: ' || event_type || ' {objective} A' || event_id || '  B' || (event_id + 1) AS prompt FROM events")
def template_fill(spark, d):
    i = F.col("event_id")
    urls = lambda c, n: F.array(F.concat(F.lit(c), (i + n).cast("string")))
    filled = text.filled("Q: <o> {objectiv3} {situation1_url1} {situation1_url2} {situation2_url1}", F.col("event_type"), urls("A", 0), urls("B", 1))
    whole = text.first_replaced(text.first_replaced(filled, "<o>", F.col("event_type")), "{objectiv3}", F.lit("{objective}"))
    return table(spark, d, "events").select("event_id", whole.alias("prompt"))


# --- evaluation


@query(f"WITH {A.EVAL_RESULTS} SELECT file_name, question_id, metric, score FROM scored")
def judge_json_scores(spark, d):
    return evaluation.scores(A.eval_results(spark, d))


@query(f"WITH {A.EVAL_RESULTS} SELECT file_name, metric, round(mean, 6) AS mean, std, n FROM stats")
def judge_mean_std(spark, d):
    return evaluation.by_file(evaluation.scores(A.eval_results(spark, d))).withColumn("mean", F.round("mean", 6))


@query(f"WITH {A.EVAL_RESULTS} SELECT model, annotation, metric, round(avg(mean), 6) AS mean, round(avg(std), 6) AS std FROM named GROUP BY ALL")
def judge_model_report(spark, d):
    return evaluation.by_model(evaluation.by_file(evaluation.scores(A.eval_results(spark, d))))


@query(f"WITH {A.EVAL_RESULTS} SELECT category, annotation, metric, round(avg(mean), 6) AS mean, round(avg(std), 6) AS std FROM named GROUP BY ALL")
def judge_category_report(spark, d):
    return evaluation.by_category(evaluation.by_file(evaluation.scores(A.eval_results(spark, d))))


@query(f"""WITH {A.EVAL_RESULTS}, m AS (SELECT model, annotation, metric, round(avg(mean), 6) AS mean, round(avg(std), 6) AS std FROM named GROUP BY ALL),
c AS (SELECT model, annotation, metric, printf('%.2f ± %.2f', mean, std) AS cell FROM m)
SELECT model, annotation, max(cell) FILTER (WHERE metric = 'Truthfulness') AS "TRU", max(cell) FILTER (WHERE metric = 'Completeness') AS "COMP", '—' AS "OBJ", '—' AS "FUNC", '—' AS "INTER" FROM c GROUP BY ALL""")
def judge_wide_report(spark, d):
    return evaluation.report(evaluation.by_model(evaluation.by_file(evaluation.scores(A.eval_results(spark, d)))))


_JUDGED = "judged AS (SELECT event_type, event_id, CASE event_id % 5 WHEN 0 THEN 'T#same' WHEN 1 THEN 'f#no' WHEN 2 THEN 'maybe' WHEN 3 THEN ' t' ELSE '' END AS reply FROM events)"


def _judged(spark, d):
    return table(spark, d, "events").select("event_type", "event_id", A._pick(("T#same", "f#no", "maybe", " t", ""), F.col("event_id")).alias("reply"))


@query(f"WITH {_JUDGED}, p AS (SELECT *, upper(left(trim(reply), 1)) AS c FROM judged) SELECT event_id, (c = 'T')::INT AS accuracy, CASE WHEN c IN ('T', 'F') THEN c ELSE 'INVALID' END AS cls, CASE WHEN c IN ('T', 'F') THEN substr(trim(reply), 3) ELSE trim(reply) END AS reason FROM p")
def judge_verdict(spark, d):
    return _judged(spark, d).select("event_id", text.verdict(F.col("reply")).alias("v")).select("event_id", "v.*")


@query(f"""WITH {_JUDGED}, p AS (SELECT *, upper(left(trim(reply), 1)) AS c FROM judged), q AS (SELECT event_type, c = 'T' AS good, c NOT IN ('T', 'F') AS bad FROM p)
SELECT event_type, count(*) AS n, sum(good::INT)::BIGINT AS n_correct, sum(bad::INT)::BIGINT AS n_invalid, round(sum(good::INT) * 100.0::DOUBLE / count(*), 6) AS accuracy,
  round(coalesce(sum(good::INT) * 100.0::DOUBLE / nullif(count(*) - sum(bad::INT), 0), 0), 6) AS clean_accuracy, round(coalesce(sum(good::INT) * 100.0::DOUBLE / nullif(count(*) - sum(bad::INT), 0), 0), 6) AS open_accuracy FROM q GROUP BY event_type""")
def accuracy_invalid_aware(spark, d):
    v = _judged(spark, d).select("event_type", text.verdict(F.col("reply")).alias("v"))
    return evaluation.accuracy(v.select("event_type", (F.col("v.accuracy") == 1).alias("correct"), (F.col("v.cls") == "INVALID").alias("invalid")), ["event_type"])


_CLOSED = """closed AS (SELECT event_type, event_id, event_id % 40 AS truth, CASE event_id % 5 WHEN 0 THEN (event_id % 40) || '#car#x' WHEN 1 THEN '-1#NA#Cannot infer' WHEN 2 THEN '99#x#y' WHEN 3 THEN 'say 3#b#c' ELSE 'none' END AS reply FROM events),
cut AS (SELECT *, coalesce(nullif(regexp_extract(reply, '(\\d+#[^#]*#.*$)', 1), ''), reply) AS r FROM closed),
cls AS (SELECT *, TRY_CAST(string_split(r, '#')[1] AS INT) AS k, coalesce(string_split(r, '#')[2], '') AS l FROM cut),
fin AS (SELECT *, coalesce(k BETWEEN 0 AND 39 AND l <> 'NA', false) AS ok, (('0x' || left(md5(event_id::VARCHAR), 6))::BIGINT % 40)::INT AS drawn FROM cls)"""


@query(f"WITH {_CLOSED} SELECT event_id, CASE WHEN ok THEN k ELSE drawn END AS cls, CASE WHEN ok THEN l ELSE 'INVALID' END AS label FROM fin")
def closed_class_parse(spark, d):
    return _closed(spark, d).select("event_id", "c.cls", "c.label")


def _closed(spark, d):
    i = F.col("event_id")
    reply = F.when(i % 5 == 0, F.concat((i % 40).cast("string"), F.lit("#car#x"))).when(i % 5 == 1, "-1#NA#Cannot infer").when(i % 5 == 2, "99#x#y").when(i % 5 == 3, "say 3#b#c").otherwise("none")
    return table(spark, d, "events").select("event_type", "event_id", (i % 40).alias("truth"), text.closed_class(reply, 40, i).alias("c"))


@query(f"""WITH {_CLOSED}, g AS (SELECT event_type, (CASE WHEN ok THEN k ELSE drawn END) = truth AS good, NOT ok AS bad FROM fin)
SELECT event_type, count(*) AS n, sum(good::INT)::BIGINT AS n_correct, sum(bad::INT)::BIGINT AS n_invalid, round(sum(good::INT) * 100.0::DOUBLE / count(*), 6) AS accuracy,
 round(coalesce(sum((good AND NOT bad)::INT) * 100.0::DOUBLE / nullif(count(*) - sum(bad::INT), 0), 0), 6) AS clean_accuracy, round(coalesce(sum(good::INT) * 100.0::DOUBLE / nullif(count(*) - sum(bad::INT), 0), 0), 6) AS open_accuracy FROM g GROUP BY event_type""")
def clean_accuracy(spark, d):
    rows = _closed(spark, d).select("event_type", (F.col("c.cls") == F.col("truth")).alias("correct"), (F.col("c.label") == "INVALID").alias("invalid"))
    return evaluation.accuracy(rows, ["event_type"])


@query("""WITH r AS (SELECT event_type, CASE event_id % 4 WHEN 0 THEN (event_id % 130) ELSE event_id % 101 END AS x, event_id % 9 IN (5, 7) OR event_id % 11 = 3 AND event_id % 5 = 2 AS bad FROM events),
v AS (SELECT event_type, CASE WHEN NOT bad AND x <= 100 THEN x END AS ok FROM r)
SELECT event_type, round(coalesce(avg(ok), 0), 6) AS mean_rating, count(ok) AS n_valid, count(*) - count(ok) AS n_invalid FROM v GROUP BY event_type""")
def caption_rating(spark, d):
    i = F.col("event_id")
    score = F.when(i % 4 == 0, i % 130).otherwise(i % 101).cast("string")
    lead = F.when(i % 9 == 5, "").when(i % 9 == 7, F.concat(score, F.lit(" "))).otherwise(score)
    # scores alone, with white space around, in a sentence, or before a reason
    plain = F.when(i % 9 == 5, "none").when(i % 9 == 7, F.concat(F.lit("Score: "), score)).when(i % 5 == 2, F.concat(F.lit("I say "), score)).otherwise(F.concat(F.lit(" "), score, F.lit("\n")))
    reply = F.when(i % 11 == 3, plain).otherwise(F.concat(F.when(i % 7 == 1, "My rating:\n").otherwise(""), lead, F.lit("#why"), (i % 200).cast("string")))
    return evaluation.caption_score(table(spark, d, "events").select("event_type", text.rating(reply).alias("rating")), ["event_type"])


_PRICES = (("click", 0.03, 0.06), ("view", 0.0015, 0.002), ("error", 0.01, 0.03), ("purchase", 0.005, 0.015), ("signup", 0.0005, 0.0015))


@query(f"""WITH p AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in _PRICES)}) t(model, a, b))
SELECT model, round(sum((event_id % 500) * a / 1000 + (event_id % 90) * b / 1000), 6) AS cost, count(*) AS n_calls FROM events JOIN p ON model = event_type GROUP BY model""")
def token_cost(spark, d):
    prices = spark.createDataFrame(list(_PRICES), "model string, prompt_price double, reply_price double")
    i = F.col("event_id")
    return evaluation.token_cost(table(spark, d, "events").select(F.col("event_type").alias("model"), (i % 500).alias("prompt_tokens"), (i % 90).alias("reply_tokens")), prices)


@query("SELECT source, (sum(length(text)) // 4)::BIGINT AS tokens FROM documents GROUP BY source")
def approximate_tokens(spark, d):
    return evaluation.approximate_tokens(table(spark, d, "documents"), "source")


_GRAMS = """t AS (SELECT conv_id, turn, regexp_extract_all(text, '\\S+') AS r, regexp_extract_all(coalesce(nullif(lead(text) OVER o, ''), '##'), '\\S+') AS h, lead(text) OVER o AS hyp FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT unnest([1, 2, 3, 4]) AS n), u AS (SELECT conv_id, turn, n, h, r FROM t, n WHERE hyp IS NOT NULL),
g AS (SELECT conv_id, turn, n, unnest([array_to_string(h[i : i + n - 1], ' ') FOR i IN range(1, len(h) - n + 2)]) AS g, 1 AS h, 0 AS r FROM u
  UNION ALL SELECT conv_id, turn, n, unnest([array_to_string(r[i : i + n - 1], ' ') FOR i IN range(1, len(r) - n + 2)]), 0, 1 FROM u),
c AS (SELECT conv_id, turn, n, g, sum(h) AS h, sum(r) AS r FROM g GROUP BY ALL), o AS (SELECT conv_id, turn, n, sum(least(h, r)) AS hit, sum(h) AS h, sum(r) AS r FROM c GROUP BY ALL),
w AS (SELECT conv_id, turn, """ + ", ".join(f"coalesce(max({c}) FILTER (n = {n}), 0)::DOUBLE AS {c}{n}" for n in (1, 2, 3, 4) for c in ("hit", "h", "r")) + """ FROM o GROUP BY ALL),
x AS (SELECT *, CASE WHEN h1 >= r1 THEN 1 ELSE exp(1 - r1 / h1) END AS short, """ + ", ".join(f"ln(CASE WHEN hit{n} > 0 THEN hit{n} ELSE 0.1 END / greatest(h{n}, 1)) AS p{n}" for n in (1, 2, 3, 4)) + " FROM w)"


_ROUGE = """rt AS (SELECT conv_id, turn, regexp_extract_all(replace(array_to_string(r, ' '), '.', ' '), '\\S+') AS r, regexp_extract_all(replace(array_to_string(h, ' '), '.', ' '), '\\S+') AS h FROM t WHERE hyp IS NOT NULL),
rg AS (SELECT conv_id, turn, n, list_distinct([array_to_string(h[i : i + n - 1], ' ') FOR i IN range(1, len(h) - n + 2)]) AS h, list_distinct([array_to_string(r[i : i + n - 1], ' ') FOR i IN range(1, len(r) - n + 2)]) AS r FROM rt, (SELECT unnest([1, 2]) AS n)),
rp AS (SELECT conv_id, turn, n, coalesce(len(list_intersect(h, r)) / nullif(len(h), 0)::DOUBLE, 0) AS p, coalesce(len(list_intersect(h, r)) / nullif(len(r), 0)::DOUBLE, 0) AS q FROM rg),
rf AS (SELECT conv_id, turn, max(2 * (p * q) / (p + q + 1e-8::DOUBLE)) FILTER (n = 1) AS rouge1, max(2 * (p * q) / (p + q + 1e-8::DOUBLE)) FILTER (n = 2) AS rouge2 FROM rp GROUP BY ALL)"""
_SCORES = "sc AS (SELECT conv_id, turn, " + ", ".join(f"CASE WHEN hit1 = 0 THEN 0 ELSE short * exp(({' + '.join(f'p{i}' for i in range(1, n + 1))}) * {0.33 if n == 3 else 1 / n}::DOUBLE) END AS bleu{n}" for n in (1, 2, 3, 4)) + ", rouge1, rouge2 FROM x JOIN rf USING (conv_id, turn))"
_METRICS = ("bleu1", "bleu2", "bleu3", "bleu4", "rouge1", "rouge2")


@query(f"WITH {_GRAMS}, {_ROUGE}, {_SCORES} SELECT conv_id, turn, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM sc")
def text_metrics(spark, d):
    scored = evaluation.n_gram_metrics(_replies(spark, d), "key")
    return scored.select("key.conv_id", "key.turn", *[F.round(c, 6).alias(c) for c in _METRICS])


@query(f"WITH {_GRAMS}, {_ROUGE}, {_SCORES} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, printf('%.4f', avg({m}) * 100) AS score FROM sc" for m in _METRICS))
def text_metric_means(spark, d):
    return evaluation.overall_scores(evaluation.n_gram_metrics(_replies(spark, d), "key"))


@query()
def text_rouge_l(spark, d):
    return evaluation.rouge_l(_replies(spark, d), "key").select("key.conv_id", "key.turn", F.round("rouge_l", 6).alias("rouge_l"))


def _replies(spark, d):
    after = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations")
    return c.select(F.struct("conv_id", "turn").alias("key"), F.col("text").alias("reference"), F.lead("text").over(after).alias("hypothesis")).where("hypothesis is not null")


@query("SELECT event_type AS key, date_trunc('day', ts)::DATE AS step, round(sum(value) / greatest(1, count(*)), 6) AS mean FROM events GROUP BY ALL")
def meter_mean(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("step"), F.col("event_type").alias("key"), "value", F.lit(1).alias("n"))
    return evaluation.meters(e, ["key", "step"])


_KEYS = {"click": "click", "error": "critic_error", "purchase": "purchase", "signup": "signup", "view": "view"}


@query(f"""SELECT date_trunc('day', ts)::DATE AS step, {", ".join(f"round(avg(value) FILTER (WHERE event_type = '{e}'), 6) AS {k}" for e, k in _KEYS.items())} FROM events GROUP BY ALL""")
def meter_pivot(spark, d):
    key = F.when(F.col("event_type") == "error", "train_critic/error").otherwise(F.concat(F.lit("train/"), F.col("event_type")))
    return evaluation.meters_wide(table(spark, d, "events").select(F.to_date("ts").alias("step"), key.alias("key"), "value", F.lit(1).alias("n")), list(_KEYS.values()))


@query("""WITH s AS (SELECT user_id, event_id % 7 * 10 + 5 AS w, event_id % 11 + 3 AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
n AS (SELECT user_id, count(*) AS n, sum(w)::BIGINT AS row_w, max(h) AS row_h, max(w) AS col_w, sum(h)::BIGINT AS col_h, ceil(sqrt(count(*)))::BIGINT AS cols FROM s GROUP BY user_id),
x AS (SELECT user_id, sum(w)::BIGINT AS grid_w FROM (SELECT user_id, pos % cols AS c, max(w) AS w FROM s JOIN n USING (user_id) GROUP BY ALL) GROUP BY user_id),
y AS (SELECT user_id, sum(h)::BIGINT AS grid_h FROM (SELECT user_id, pos // cols AS r, max(h) AS h FROM s JOIN n USING (user_id) GROUP BY ALL) GROUP BY user_id)
SELECT user_id, n, row_w, row_h, col_w, col_h, cols, ceil(n / cols)::BIGINT AS rows, grid_w, grid_h FROM n JOIN x USING (user_id) JOIN y USING (user_id)""")
def stitch_layout(spark, d):
    i = F.col("event_id")
    s = table(spark, d, "events").select("user_id", (i % 7 * 10 + 5).alias("w"), (i % 11 + 3).alias("h"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("pos"))
    return evaluation.stitch_layout(s, "user_id")


# --- pairs

_BINS = "bins AS (SELECT DISTINCT bin_id FROM samples)"
_CROSS = "cross_ AS (SELECT x.bin_id AS bin_a, y.bin_id AS bin_b, x.sample_id AS a, y.sample_id AS b FROM samples x JOIN samples y ON x.bin_id < y.bin_id)"


@query(f"WITH {A.SAMPLES}, {_CROSS} SELECT bin_a, bin_b, count(*) AS n, min(a) AS min_a, max(b) AS max_b, sum(a * 31 + b)::BIGINT AS mark FROM cross_ GROUP BY ALL")
def pairs_cross_bin(spark, d):
    return pairs.cross_bin(A.samples(spark, d)).groupBy("bin_a", "bin_b").agg(F.count("*").alias("n"), F.min("a").alias("min_a"), F.max("b").alias("max_b"), F.sum(F.expr("a * 31 + b")).alias("mark"))


@query(f"WITH {A.SAMPLES} SELECT x.bin_id AS bin_a, y.bin_id AS bin_b, x.sample_id AS a, y.sample_id AS b FROM samples x JOIN samples y ON y.bin_id = x.bin_id + 1")
def pairs_neighbor(spark, d):
    return pairs.neighbor_bin(A.samples(spark, d))


@query(f"""WITH {A.SAMPLES}, s AS (SELECT bin_id * bin_id AS bin_id, sample_id FROM samples), r AS (SELECT DISTINCT bin_id, dense_rank() OVER (ORDER BY bin_id) AS k FROM s)
SELECT p.bin_id AS bin_a, q.bin_id AS bin_b, x.sample_id AS a, y.sample_id AS b FROM r p JOIN r q ON q.k = p.k + 1 JOIN s x ON x.bin_id = p.bin_id JOIN s y ON y.bin_id = q.bin_id""")
def pairs_adjacent_rank(spark, d):
    """Bins numbered with gaps: the next bin is the next that there is."""
    return pairs.adjacent_bin(A.samples(spark, d).withColumn("bin_id", F.col("bin_id") * F.col("bin_id")))


_APART = "apart AS (SELECT x.bin_id, x.sample_id AS a, y.sample_id AS b, round(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS distance FROM samples x JOIN samples y ON x.bin_id = y.bin_id AND x.sample_id < y.sample_id)"


@query(f"""WITH {A.SAMPLES}, {_APART}, r AS (SELECT *, row_number() OVER (PARTITION BY bin_id ORDER BY distance, a, b) AS nr, row_number() OVER (PARTITION BY bin_id ORDER BY distance DESC, a, b) AS fr FROM apart)
SELECT bin_id, a, b, round(distance, 6) AS distance, 'intra_bin_small' AS tag FROM r WHERE nr <= 5 UNION ALL SELECT bin_id, a, b, round(distance, 6), 'intra_bin_large' FROM r WHERE fr <= 5""")
def pairs_intra_topn(spark, d):
    return pairs.extremes_by_distance(A.samples(spark, d), 5).withColumn("distance", F.round("distance", 6))


_SAMPLED = f"""{_CROSS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY bin_a, bin_b ORDER BY md5('42|' || a || '|' || b)) AS rk, count(*) OVER (PARTITION BY bin_a, bin_b) AS n FROM cross_),
kept AS (SELECT bin_a, bin_b, a, b FROM ranked WHERE rk <= ceil(n * 0.4::DOUBLE))"""


@query(f"WITH {A.SAMPLES}, {_SAMPLED} SELECT bin_a, bin_b, a, b FROM kept")
def pairs_ratio_sample(spark, d):
    return pairs.crossed_sample(A.samples(spark, d), 0.4, 42)


@query(f"""WITH {A.SAMPLES}, {_SAMPLED}, c AS (SELECT a, b, 'cross_bin' AS tag, 1 AS priority FROM kept UNION ALL SELECT y.sample_id, x.sample_id, 'neighbor_bin', 2 FROM samples x JOIN samples y ON y.bin_id = x.bin_id + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY priority, a, b) AS rk FROM c) SELECT a, b, tag FROM r WHERE rk = 1""")
def pairs_dedup_priority(spark, d):
    return pairs.sampled_or_near(A.samples(spark, d), 0.4, 42)


@query(f"WITH {A.SAMPLES} SELECT y.sample_id AS a, x.sample_id AS b, 'neighbor_bin(FLIPPED)' AS tag FROM samples x JOIN samples y ON y.bin_id = x.bin_id + 1")
def pairs_flip(spark, d):
    return pairs.flipped(pairs.tagged(pairs.neighbor_bin(A.samples(spark, d)), "neighbor_bin", 1))


@query("SELECT user_id, x.event_id AS first, y.event_id AS second FROM events x JOIN events y USING (user_id) WHERE x.event_id < y.event_id")
def pairs_choose_two(spark, d):
    return pairs.choose_two(table(spark, d, "events"), "user_id", "event_id")


@query()
def pairs_usage_cap(spark, d):
    return capped.neighbors_capped(A.samples(spark, d), 3, 42)


@query()
def pairs_generate(spark, d):
    return pairs.generate(A.samples(spark, d), 2000, 42)


@query()
def pairs_generate_padded(spark, d):
    return pairs.generate_padded(A.samples(spark, d), 30_000, 42)


@query(f"""WITH {A.SAMPLES}, n AS (SELECT sample_id AS a, lead(sample_id) OVER (PARTITION BY bin_id ORDER BY sample_id) AS b, bin_id FROM samples),
r AS (SELECT row_number() OVER (ORDER BY a) - 1 AS i, count(*) OVER () AS n, a, b, 'next_in_bin_' || bin_id AS tag FROM n WHERE b IS NOT NULL)
SELECT i + k * n AS rank, a, b, tag || list_aggregate(list_transform(range(0, k), lambda x: '(DUPE_' || (i + x * n + 1) || ')') || [''], 'string_agg', '') AS tag FROM r, range(0, 3) g(k) WHERE i + k * n < (n * 5) // 2""")
def pairs_duplicate_fill(spark, d):
    following = F.lead("sample_id").over(Window.partitionBy("bin_id").orderBy("sample_id"))
    found = A.samples(spark, d).select(F.col("sample_id").alias("a"), following.alias("b"), F.concat(F.lit("next_in_bin_"), F.col("bin_id").cast("string")).alias("tag")).where("b is not null")
    ranked = written(decisions.chunked(found, "a", 1 << 40).select(F.col("line").alias("rank"), "a", "b", "tag"), "few-pairs")
    return pairs.duplicate_fill(ranked, ranked.count() * 5 // 2)


# --- trajectories


@query(f"WITH {A.TRANSITIONS} SELECT traj_id, t, event_id, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY traj_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS episode FROM transitions")
def episode_number(spark, d):
    return A.transitions(spark, d).select("traj_id", "t", "event_id", trajectories.episode_of(F.col("event_type") == "purchase", trajectories.steps_in_order()).alias("episode"))


@query(f"WITH {A.TRANSITIONS} SELECT traj_id, round(sum(reward), 4) AS episode_return, max((event_type = 'purchase')::INT) AS success, count(*) AS n_steps FROM transitions GROUP BY traj_id")
def episode_return_success(spark, d):
    return trajectories.returns(A.transitions(spark, d), F.col("event_type") == "purchase").withColumn("episode_return", F.round("episode_return", 4))


@query(f"WITH {A.TRANSITIONS}, e AS (SELECT traj_id, sum(reward) AS r, max((event_type = 'purchase')::INT) AS s FROM transitions GROUP BY traj_id) SELECT round(avg(r), 4) AS mean_return, round(avg(s) * 100, 6) AS success_rate, count(*) AS n_episodes FROM e")
def success_rate(spark, d):
    out = trajectories.success_rate(trajectories.returns(A.transitions(spark, d), F.col("event_type") == "purchase"))
    return out.withColumns({"mean_return": F.round("mean_return", 4), "success_rate": F.round("success_rate", 6)})


@query(f"WITH {A.TRANSITIONS}, e AS (SELECT traj_id, sum(reward) AS s, count(*) AS n, arg_max(reward, t) AS l FROM transitions GROUP BY traj_id) SELECT round(sum(s) / sum(n), 6) AS mean_all, round(avg(l), 6) AS mean_final FROM e")
def info_statistics(spark, d):
    return trajectories.info_statistics(A.transitions(spark, d), "reward").select(F.round("mean_all", 6).alias("mean_all"), F.round("mean_final", 6).alias("mean_final"))


@query("""WITH e AS (SELECT event_type AS environment, user_id AS episode, round(sum(value), 4) AS episode_return FROM events GROUP BY ALL),
w AS (SELECT *, sum(episode_return) OVER o AS s, count(*) OVER o AS n, row_number() OVER (PARTITION BY environment ORDER BY episode) AS rn FROM e WINDOW o AS (PARTITION BY environment ORDER BY episode ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT environment, episode, episode_return, round(s / CASE WHEN rn < 10 THEN n + 1 ELSE n END, 4) AS moving_return FROM w""")
def moving_return_10(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("environment"), F.col("user_id").alias("episode")).agg(F.round(F.sum("value"), 4).alias("episode_return"))
    return trajectories.moving_return(e).withColumn("moving_return", F.round("moving_return", 4))


@query(f"""WITH {A.TRANSITIONS}, n AS (SELECT traj_id, count(*) AS c FROM transitions GROUP BY traj_id HAVING count(*) >= 5),
s AS (SELECT traj_id, (('0x' || left(md5('42|' || traj_id), 8))::BIGINT % (c - 4))::INT AS start FROM n)
SELECT s.traj_id, s.start, round(sum(reward * power(0.9::DOUBLE, 4 - (t - start))), 6) AS discounted, round(sum(reward), 6) AS plain FROM s JOIN transitions x ON x.traj_id = s.traj_id AND x.t BETWEEN start AND start + 4 GROUP BY ALL""")
def discounted_return(spark, d):
    s = trajectories.segments(A.transitions(spark, d), 5, 42)
    return s.select("traj_id", "start", F.round(vectors.discounted(F.col("segment"), 0.9), 6).alias("discounted"), F.round(vectors.total(F.col("segment")), 6).alias("plain"))


@query(f"WITH {A.TRANSITIONS} SELECT traj_id, t, reward AS current, coalesce(lag(reward) OVER (PARTITION BY traj_id ORDER BY t), reward) AS previous, traj_id::DOUBLE AS goal FROM transitions")
def frame_stack(spark, d):
    s = A.transitions(spark, d).select("traj_id", "t", F.array("reward").alias("obs"), F.array(F.col("traj_id").cast("double")).alias("goal"))
    return trajectories.stacked(s, "obs", "goal").select("traj_id", "t", F.col("stacked")[0].alias("current"), F.col("stacked")[1].alias("previous"), F.col("stacked")[2].alias("goal"))


@query(f"WITH {A.TRANSITIONS} SELECT traj_id, t, done, done AND t + 1 < 60 AS done_no_max FROM transitions")
def timelimit_mask(spark, d):
    return trajectories.time_limited(A.transitions(spark, d), 60).select("traj_id", "t", "done", "done_no_max")


@query(f"WITH {A.TRANSITIONS} SELECT traj_id, t, round(sum(reward) OVER w, 4) AS return_so_far, max(reward) OVER w AS best_so_far FROM transitions WINDOW w AS (PARTITION BY traj_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_episode(spark, d):
    return trajectories.running(A.transitions(spark, d)).select("traj_id", "t", F.round("return_so_far", 4).alias("return_so_far"), "best_so_far")


@query("SELECT event_id, value, event_id % 1000 AS slot FROM events ORDER BY event_id DESC LIMIT 1000")
def ring_last_n(spark, d):
    return trajectories.ring_slots(table(spark, d, "events").select("event_id", "value"), "event_id", 1000)


@query(f"WITH {A.TRANSITIONS}, k AS (SELECT DISTINCT traj_id FROM transitions ORDER BY traj_id DESC LIMIT 20) SELECT traj_id, t, reward FROM transitions JOIN k USING (traj_id)")
def fifo_trajectories(spark, d):
    return trajectories.last_trajectories(A.transitions(spark, d), 20).select("traj_id", "t", "reward")


@query(f"""WITH {A.TRANSITIONS}, s AS (SELECT traj_id, count(*) AS n FROM transitions GROUP BY traj_id), e AS (SELECT arg_min(n, traj_id) AS f, arg_max(n, traj_id) AS l, max(traj_id) AS m FROM s)
SELECT traj_id, t FROM transitions, e WHERE NOT (traj_id = m AND l < f)""")
def whole_trajectories(spark, d):
    return trajectories.whole_trajectories(A.transitions(spark, d)).select("traj_id", "t")


@query(f"""WITH {A.TRANSITIONS}, s AS (SELECT traj_id, count(*) AS n, row_number() OVER (ORDER BY traj_id) - 1 AS number FROM transitions GROUP BY traj_id), l AS (SELECT count(*) AS c, min(n) AS m FROM s),
q AS (SELECT unnest(range(0, 500)) AS query), a AS (SELECT query, ('0x' || left(md5('7|traj1|' || query), 12))::BIGINT % c AS n1, ('0x' || left(md5('7|time1|' || query), 12))::BIGINT % m AS t1,
  ('0x' || left(md5('7|traj2|' || query), 12))::BIGINT % c AS n2, ('0x' || left(md5('7|time2|' || query), 12))::BIGINT % m AS t2 FROM q, l)
SELECT query, x.traj_id AS traj1, t1, y.traj_id AS traj2, t2 FROM a JOIN s x ON x.number = n1 JOIN s y ON y.number = n2""")
def uniform_queries(spark, d):
    return trajectories.uniform_queries(spark, A.transitions(spark, d), 500, 7)


@query("SELECT event_id, value FROM events ORDER BY md5('9|' || event_id) LIMIT 200")
def replay_sample(spark, d):
    return trajectories.replay_sample(table(spark, d, "events").select("event_id", "value"), 200, 9, "event_id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value * 2 ELSE value END AS reward FROM events")
def relabel_rewards(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("value").alias("reward"))
    return trajectories.relabeled(rows, lambda r: r.where("event_id % 2 = 0").select("event_id", (F.col("reward") * 2).alias("prediction")), "event_id")


@query("SELECT event_id, CASE WHEN ('0x' || left(md5('3|' || event_id), 8))::BIGINT::DOUBLE / 4294967296 < 0.9 THEN 'train' ELSE 'validation' END AS fold FROM events")
def train_split(spark, d):
    return trajectories.split(table(spark, d, "events").select("event_id"), "event_id", 3, 0.9)


# --- preferences

_PAIRS = "prefs AS (SELECT event_id AS pair_id, value AS r1, lead(value, 1) OVER o AS r2, lead(value, 2) OVER o AS r3, lead(value, 3) OVER o AS r4 FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)), p AS (SELECT pair_id, [r1, r2] AS s1, [r3, r4] AS s2 FROM prefs WHERE r4 IS NOT NULL)"


def _prefs(spark, d):
    o = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select(F.col("event_id").alias("pair_id"), F.array("value", F.lead("value", 1).over(o)).alias("r1"), F.array(F.lead("value", 2).over(o), F.lead("value", 3).over(o)).alias("r2"))
    return e.where(F.col("r2")[1].isNotNull())


@query(f"WITH {_PAIRS} SELECT pair_id, (s1[1] * 0.5::DOUBLE + s1[2] < s2[1] * 0.5::DOUBLE + s2[2])::INT AS label FROM p")
def preference_rational(spark, d):
    r1, r2 = F.col("r1"), F.col("r2")
    label = maths.teacher_label(vectors.total(r1), vectors.total(r2), vectors.discounted(r1, 0.5), vectors.discounted(r2, 0.5), F.lit(0.5), F.lit(1.0))
    return _prefs(spark, d).select("pair_id", label.alias("label"))


@query(f"""WITH {_PAIRS}, s AS (SELECT pair_id, s1[1] + s1[2] AS a, s2[1] + s2[2] AS b FROM p WHERE greatest(s1[1] + s1[2], s2[1] + s2[2]) > 10)
SELECT pair_id, CASE WHEN abs(a - b) < 5 THEN -1 ELSE (a < b)::INT END AS label FROM s""")
def preference_equal_skip(spark, d):
    a, b = vectors.total(F.col("r1")), vectors.total(F.col("r2"))
    return preferences.kept(_prefs(spark, d), 10).select("pair_id", maths.teacher_label(a, b, a, b, F.lit(0.5), F.lit(1.0), equal=5.0).alias("label"))


@query(f"""WITH {_PAIRS}, s AS (SELECT pair_id, (s1[1] + s1[2]) / 100 AS a, (s2[1] + s2[2]) / 100 AS b FROM p), q AS (SELECT pair_id, 1 / (1 + exp(b - a)) AS x FROM s)
SELECT pair_id, round(x, 6) AS p, round(-x * ln(x) - (1 - x) * ln(1 - x), 6) AS entropy FROM q""")
def bradley_terry(spark, d):
    p = maths.preference(vectors.total(F.col("r1")) / 100, vectors.total(F.col("r2")) / 100)
    return _prefs(spark, d).select("pair_id", F.round(p, 6).alias("p"), F.round(maths.entropy(p), 6).alias("entropy"))


_SCORES = f"""{_PAIRS}, s AS (SELECT pair_id, (s1[1] + s1[2]) / 100 AS a, (s2[1] + s2[2]) / 100 AS b, m AS member FROM p, (SELECT unnest(range(0, 3)) AS m)),
sc AS (SELECT pair_id, member, round(1 / (1 + exp((b - a) * (1 + member * (pair_id % 5) / 10.0::DOUBLE))), 9) AS p FROM s)"""


def _scores(spark, d):
    a, b = vectors.total(F.col("r1")) / 100, vectors.total(F.col("r2")) / 100
    rows = _prefs(spark, d).withColumn("member", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    return rows.select("pair_id", "member", F.round(1 / (1 + F.exp((b - a) * (1 + F.col("member") * (F.col("pair_id") % 5) / 10.0))), 9).alias("p"))


@query(f"WITH {_SCORES}, e AS (SELECT pair_id, round(avg(-p * ln(p) - (1 - p) * ln(1 - p)), 9) AS h FROM sc GROUP BY pair_id) SELECT pair_id, round(h, 6) AS mean_entropy FROM e ORDER BY h DESC, pair_id LIMIT 100")
def preference_entropy_topk(spark, d):
    return preferences.uncertain(_scores(spark, d), 100).withColumn("mean_entropy", F.round("mean_entropy", 6))


@query(f"WITH {_SCORES}, e AS (SELECT pair_id, round(avg(p), 9) AS m, round(stddev_pop(p), 9) AS s FROM sc GROUP BY pair_id) SELECT pair_id, round(m, 6) AS mean_p, round(s, 6) AS std_p FROM e ORDER BY s DESC, pair_id LIMIT 100")
def ensemble_disagreement(spark, d):
    return preferences.disagreement(_scores(spark, d), 100).withColumns({"mean_p": F.round("mean_p", 6), "std_p": F.round("std_p", 6)})


@query(f"WITH {_SCORES} SELECT member, round(avg(((p < 0.5)::INT = pair_id % 2)::INT), 6) AS accuracy FROM sc WHERE pair_id % 3 <> 0 GROUP BY member")
def ensemble_accuracy(spark, d):
    label = F.when(F.col("pair_id") % 3 == 0, -1).otherwise((F.col("pair_id") % 2).cast("int"))
    return preferences.ensemble_accuracy(_scores(spark, d).withColumn("label", label)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {_PAIRS} SELECT round(avg((pair_id % 3 = pair_id % 2)::INT), 6) AS accuracy, count(*) AS n FROM p")
def label_accuracy(spark, d):
    rows = _prefs(spark, d).select((F.col("pair_id") % 3).alias("gt"), (F.col("pair_id") % 2).alias("vlm"))
    return preferences.accuracy(rows, "gt", "vlm").withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT event_id, CASE (event_id % 3) - 1 WHEN -1 THEN 0.5::DOUBLE WHEN 0 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS first, CASE (event_id % 3) - 1 WHEN -1 THEN 0.5::DOUBLE WHEN 0 THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END AS second FROM events")
def soft_targets(spark, d):
    t = maths.soft_target((F.col("event_id") % 3 - 1).cast("int"), 0.1)
    return table(spark, d, "events").select("event_id", t[0].alias("first"), t[1].alias("second"))


@query("""WITH z AS (SELECT event_id, value / 10 AS a, (event_id % 17) / 5.0::DOUBLE AS b FROM events)
SELECT event_id, round(ln(exp(a) + exp(b)) - 0.9::DOUBLE * a - 0.1::DOUBLE * b, 6) AS soft, round(ln(1 + exp(CASE WHEN event_id % 2 = 0 THEN b - a ELSE a - b END)), 6) AS hard FROM z""")
def preference_losses(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") / 10).alias("a"), ((F.col("event_id") % 17) / 5.0).alias("b"))
    soft = maths.soft_cross_entropy(F.col("a"), F.col("b"), F.array(F.lit(0.9), F.lit(0.1)))
    return e.select("event_id", F.round(soft, 6).alias("soft"), F.round(maths.cross_entropy(F.col("a"), F.col("b"), F.col("event_id") % 2), 6).alias("hard"))


# --- vectors and clouds


@query(f"""WITH {A.SAMPLES} SELECT x.sample_id AS id, round(min(round(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9), 4)[4], 6) AS distance
FROM samples x, samples y GROUP BY x.sample_id HAVING count(*) > 3""")
def knn_distance(spark, d):
    s = A.samples(spark, d).select(F.col("sample_id").alias("id"), "embedding")
    return neighbours.state_entropy(s, 3).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {A.STATES} SELECT a.id, round(min(round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 9), 6)[6], 6) AS distance
FROM states a, states b GROUP BY a.id HAVING count(*) > 5""")
def state_entropy(spark, d):
    return neighbours.state_entropy(A.states(spark, d), 5).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {A.SAMPLES}, a AS (SELECT x.vec_id AS q, y.vec_id AS p, round(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS distance FROM embeddings x JOIN embeddings y ON x.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, p) AS rank FROM a) SELECT q, p, round(distance, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 10""")
def knn_search(spark, d):
    v = table(spark, d, "embeddings")
    found = neighbours.knn(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "embedding"), v.select(F.col("vec_id").alias("p"), "embedding"), 10)
    return found.select("q", "p", F.round("distance", 6).alias("distance"), "rank")


_NEAR = f"""{A.SAMPLES}, a AS (SELECT x.bin_id, x.sample_id, y.sample_id AS o, x.reward - y.reward AS dr, x.time - y.time AS dt, round(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS l2 FROM samples x JOIN samples y ON x.bin_id = y.bin_id AND x.sample_id <> y.sample_id),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY l2, o) AS k FROM a)"""


@query(f"WITH {_NEAR} SELECT bin_id, sample_id, round(min(sqrt(l2 * l2 + 0.01::DOUBLE * dr * dr + 0.0001::DOUBLE * dt * dt)), 6) AS distance FROM r WHERE k <= 50 GROUP BY ALL")
def multi_factor_nn(spark, d):
    return neighbours.nearest_in_bin(A.samples(spark, d), 50, 1.0, 0.01, 0.0001)


@query(f"WITH {_NEAR}, m AS (SELECT round(min(l2), 6) AS distance FROM r GROUP BY sample_id) SELECT round(CASE WHEN count(*) < 5 OR median(distance) < 1e-9 THEN 0.3 ELSE median(distance) END, 6) AS threshold, count(*) AS n FROM m")
def dedup_threshold_median(spark, d):
    return neighbours.dedup_threshold(neighbours.nearest_in_bin(A.samples(spark, d), 1), 0.3)


@query(f"WITH {A.SAMPLES}, {_APART} SELECT bin_id, b AS sample_id, min(a) AS earlier FROM apart WHERE distance < 1.05::DOUBLE GROUP BY ALL")
def similarity_dedup(spark, d):
    return neighbours.duplicates(A.samples(spark, d), 1.05)


@query(f"""WITH {A.SAMPLES}, c AS (SELECT min(sample_id) AS k FROM samples GROUP BY bin_id), ce AS (SELECT sample_id AS centroid, embedding FROM samples JOIN c ON k = sample_id),
a AS (SELECT x.sample_id, centroid, round(list_distance(x.embedding::DOUBLE[], ce.embedding::DOUBLE[]), 9) AS distance FROM samples x, ce), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY distance, centroid) AS rk FROM a)
SELECT sample_id, centroid, round(distance, 6) AS distance FROM r WHERE rk = 1""")
def centroid_assign(spark, d):
    s = A.samples(spark, d)
    firsts = s.groupBy("bin_id").agg(F.min("sample_id").alias("centroid"))
    c = s.join(firsts, F.col("sample_id") == F.col("centroid")).select("centroid", "embedding")
    return neighbours.nearest_centroid(s, c).withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first FROM embeddings")
def embedding_normalize(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(e), 6).alias("norm"), F.round(vectors.normalized(e)[0], 6).alias("first"))


@query("""WITH t AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(embeddings.embedding::DOUBLE[], t.e), 6) AS score FROM embeddings, t),
p AS (SELECT x.vec_id, x.score AS a, y.score AS b FROM s x JOIN s y ON y.vec_id = x.vec_id + 1) SELECT vec_id, CASE WHEN abs(a - b) <= 0.05::DOUBLE THEN -1 WHEN a > b THEN 0 ELSE 1 END AS label FROM p""")
def cosine_compare(spark, d):
    v = table(spark, d, "embeddings")
    t = v.where("vec_id = 0").select(F.col("embedding").alias("e"))
    s = v.crossJoin(F.broadcast(t.limit(1))).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("e")), 6).alias("score"))
    nxt = s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("score").alias("b"))
    return s.join(nxt, "vec_id").select("vec_id", vectors.closer(F.col("score"), F.col("b"), 0.05).alias("label"))


@query()
def kcenter(spark, d):
    s = A.samples(spark, d).select(F.col("bin_id").alias("environment"), F.col("sample_id").alias("id"), "embedding")
    return preferences.k_center(s, 10)


@query()
def fps(spark, d):
    return neighbours.farthest_points(A.points(spark, d), 16)


@query()
def fps_groups(spark, d):
    return neighbours.local_groups(A.points(spark, d), 4, 8)


@query(f"""WITH {A.POINTS}, c AS (SELECT cloud_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM points GROUP BY cloud_id), m AS (SELECT cloud_id, pt, x - mx AS x, y - my AS y, z - mz AS z FROM points JOIN c USING (cloud_id)),
s AS (SELECT cloud_id, max(sqrt(x * x + y * y + z * z)) AS scale FROM m GROUP BY cloud_id) SELECT cloud_id, pt, round(x / scale, 6) AS x, round(y / scale, 6) AS y, round(z / scale, 6) AS z FROM m JOIN s USING (cloud_id)""")
def pc_normalize(spark, d):
    return points.normalized(A.points(spark, d)).select("cloud_id", "pt", *[F.round(c, 6).alias(c) for c in "xyz"])


_FRAME = f"""{A.POINTS}, c AS (SELECT cloud_id, median(x) AS mx, median(y) AS my, median(z) AS mz FROM points GROUP BY cloud_id),
fr AS (SELECT cloud_id, mx, my, mz, quantile_cont(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)), 0.95) AS radius FROM points JOIN c USING (cloud_id) GROUP BY ALL)"""


@query(f"WITH {_FRAME} SELECT cloud_id, round(mx, 6) AS mx, round(my, 6) AS my, round(mz, 6) AS mz, round(radius, 4) AS radius FROM fr")
def robust_radius(spark, d):
    return points.robust_frame(A.points(spark, d)).select("cloud_id", *[F.round(c, 6).alias(c) for c in ("mx", "my", "mz")], F.round("radius", 4).alias("radius"))


@query(f"WITH {_FRAME} SELECT cloud_id, round(radius * 1.2::DOUBLE / tan(radians(60) / 2), 4) AS distance FROM fr")
def camera_distance(spark, d):
    return points.robust_frame(A.points(spark, d)).select("cloud_id", F.round(maths.camera_distance(F.col("radius"), 60.0), 4).alias("distance"))


@query(f"WITH {_FRAME} SELECT cloud_id, round(least(CASE WHEN radius < 1e-9 THEN 1e-3 ELSE radius END * 1.1::DOUBLE / tan(radians(60) / 2), 30000), 4) AS distance FROM fr")
def camera_limits(spark, d):
    return points.robust_frame(A.points(spark, d)).select("cloud_id", F.round(maths.camera_distance(F.col("radius"), 60.0, 1.1, most=30_000), 4).alias("distance"))


@query()
def camera_boxes(spark, d):
    return points.camera_places(A.points(spark, d), (1.0, 0.0, 1.0)).select("cloud_id", *[F.round(c, 4).alias(c) for c in ("distance", "x", "y", "z")])


@query(f"""WITH e AS (SELECT event_id, (event_id % 23) / 11.5::DOUBLE - 1 AS x, (event_id % 17) / 8.5::DOUBLE - 1 AS y, (event_id % 13) / 6.5::DOUBLE - 1 AS z, (event_id % 5) / 4.0::DOUBLE + 0.1::DOUBLE AS w FROM events),
l AS (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS l FROM e) SELECT event_id, round(w / l, 6) AS w, round(x / l, 6) AS x, round(y / l, 6) AS y, round(z / l, 6) AS z FROM l""")
def quat_of_matrix(spark, d):
    i = F.col("event_id")
    q = [(i % 5) / 4.0 + 0.1, (i % 23) / 11.5 - 1, (i % 17) / 8.5 - 1, (i % 13) / 6.5 - 1]
    rows = table(spark, d, "events").select("event_id", F.array(*[F.array(*row) for row in maths.quat_matrix(q)]).alias("m"))
    back = maths.quat_of_matrix([[F.col("m")[a][b] for b in range(3)] for a in range(3)])
    return rows.select("event_id", back.alias("q")).select("event_id", *[F.round(F.col("q")[k], 6).alias(c) for k, c in enumerate("wxyz")])


@query(f"WITH {A.POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY round((x - 25) * (x - 25) + (y - 30000) * (y - 30000) + (z - 0) * (z - 0), 9), pt) AS rk FROM points) SELECT cloud_id, pt FROM r WHERE rk > 50")
def cloud_crop(spark, d):
    return points.cropped(A.points(spark, d), (25.0, 30000.0, 0.0), 50).select("cloud_id", "pt")


# --- store, allocation, maths


@query(f"WITH {A.SAMPLES}, b AS (SELECT DISTINCT bin_id FROM samples) SELECT bin_id, (1003 // count(*) OVER () + (row_number() OVER (ORDER BY bin_id) - 1 < 1003 % count(*) OVER ())::INT)::BIGINT AS capacity FROM b")
def bin_capacity(spark, d):
    return store.capacities(A.samples(spark, d).select("bin_id").distinct(), 1003)


@query(f"""WITH {A.SAMPLES}, r AS (SELECT bin_id, sample_id, row_number() OVER (PARTITION BY bin_id ORDER BY md5('5|' || sample_id)) AS rk FROM samples), b AS (SELECT DISTINCT bin_id FROM samples),
c AS (SELECT bin_id, 123 // count(*) OVER () + (row_number() OVER (ORDER BY bin_id) - 1 < 123 % count(*) OVER ())::INT AS capacity FROM b) SELECT bin_id, sample_id FROM r JOIN c USING (bin_id) WHERE rk <= capacity""")
def rebin_trim(spark, d):
    s = A.samples(spark, d).select("bin_id", "sample_id")
    return store.trimmed(s, store.capacities(s.select("bin_id").distinct(), 123), 5)


@query()
def bin_kmeans(spark, d):
    return store.clustered(A.samples(spark, d), [3, 5]).select("sample_id", "bin_id")


@query()
def rebinned_store(spark, d):
    return store.rebinned(A.samples(spark, d).withColumn("task", F.col("sample_id") % 7), "task", total=40, every=20, weights=(1.0, 0.01, 0.0))


@query()
def bounded_store(spark, d):
    return store.bounded(A.samples(spark, d), 20, 0.3)


@query("""WITH g AS (SELECT s_nationkey AS scene, s_suppkey AS geom, s_acctbal + 1000 AS area FROM supplier), b AS (SELECT *, count(*) OVER w AS k, sum(area) OVER w AS total FROM g WINDOW w AS (PARTITION BY scene)),
a AS (SELECT *, 300 + trunc((8192 - k * 300) * area / total)::BIGINT AS n FROM b), s AS (SELECT *, 8192 - sum(n) OVER (PARTITION BY scene) AS short, row_number() OVER (PARTITION BY scene ORDER BY geom) - 1 AS up FROM a)
SELECT scene, geom, (n + sign(short) * (abs(short) // k + (up < abs(short) % k)::INT))::BIGINT AS n FROM s""")
def allocate_points(spark, d):
    g = table(spark, d, "supplier").select(F.col("s_nationkey").alias("scene"), F.col("s_suppkey").alias("geom"), (F.col("s_acctbal") + 1000).alias("area"))
    return points.allocated(g, 8192).select("scene", "geom", "n")


@query("""WITH g AS (SELECT s_nationkey AS scene, s_suppkey AS face, s_acctbal + 1000 AS area FROM supplier), e AS (SELECT *, round(500 * area / sum(area) OVER (PARTITION BY scene), 9) AS exact FROM g),
f AS (SELECT *, floor(exact)::BIGINT AS n FROM e), r AS (SELECT *, 500 - sum(n) OVER (PARTITION BY scene) AS rest, row_number() OVER (PARTITION BY scene ORDER BY round(exact - n, 9) DESC, face) AS rk FROM f) SELECT scene, face, (n + (rk <= rest)::INT)::BIGINT AS n FROM r""")
def largest_remainder(spark, d):
    g = table(spark, d, "supplier").select(F.col("s_nationkey").alias("scene"), F.col("s_suppkey").alias("face"), (F.col("s_acctbal") + 1000).alias("area"))
    return points.largest_remainder(g, "scene", "face", "area", F.lit(500)).select("scene", "face", "n")


_X = "x AS (SELECT event_id, value / 50 - 0.5::DOUBLE AS x FROM events), dd AS (SELECT event_id, x BETWEEN 0 AND 0.3::DOUBLE AS inside, (CASE WHEN x < 0 THEN -x ELSE x - 0.3::DOUBLE END) / 0.8::DOUBLE AS d FROM x)"
_CURVES = {
    "gaussian": "exp(d * d * ln(0.1::DOUBLE))",
    "hyperbolic": "1 / cosh(d * acosh(10.0::DOUBLE))",
    "long_tail": "1 / (d * d * 9 + 1)",
    "reciprocal": "1 / (abs(d) * 9 + 1)",
    "cosine": "CASE WHEN abs(d * acos(-0.8::DOUBLE) / pi()) < 1 THEN (1 + cos(d * acos(-0.8::DOUBLE))) / 2 ELSE 0 END",
    "linear": "CASE WHEN abs(d * 0.9::DOUBLE) < 1 THEN 1 - d * 0.9::DOUBLE ELSE 0 END",
    "quadratic": "CASE WHEN abs(d * sqrt(0.9::DOUBLE)) < 1 THEN 1 - d * d * 0.9::DOUBLE ELSE 0 END",
    "tanh_squared": "1 - power(tanh(d * atanh(sqrt(0.9::DOUBLE))), 2)",
}


@query(f"WITH {_X} SELECT event_id, " + ", ".join(f"round(CASE WHEN inside THEN 1 ELSE {e} END, 9) AS {k}" for k, e in _CURVES.items()) + " FROM dd")
def tolerance_all_sigmoids(spark, d):
    x = F.col("value") / 50 - 0.5
    return table(spark, d, "events").select("event_id", *[F.round(maths.tolerance(x, (0.0, 0.3), 0.8, k), 9).alias(k) for k in maths.SIGMOIDS])


@query("WITH x AS (SELECT event_id, (event_id % 11) / 10.0::DOUBLE AS a, (event_id % 7) / 6.0::DOUBLE AS b FROM events) SELECT event_id, round(CASE WHEN a + b - a * b > 0 THEN a * b / (a + b - a * b) ELSE 0 END, 6) AS h FROM x")
def hamacher(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.round(maths.hamacher((i % 11) / 10.0, (i % 7) / 6.0), 6).alias("h"))


@query("""WITH x AS (SELECT event_id, (event_id % 13) / 6.0::DOUBLE AS a, (event_id % 5) / 4.0::DOUBLE AS b, (event_id % 3) / 2.0::DOUBLE AS c FROM events)
SELECT event_id, round(CASE WHEN a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 AND c BETWEEN 0 AND 1 THEN a * b * c ELSE 1 END, 6) AS v FROM x""")
def rect_prism(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.round(maths.rect_prism_tolerance([(i % 13) / 6.0, (i % 5) / 4.0, (i % 3) / 2.0], [0.0] * 3, [1.0] * 3), 6).alias("v"))


@query("""SELECT event_id, round(CASE event_id % 5 WHEN 0 THEN 2 * (a * b + b * c + a * c) WHEN 1 THEN 4 * pi() * a * a WHEN 2 THEN 2 * pi() * a * b + 2 * pi() * a * a WHEN 3 THEN 2 * pi() * a * b + 4 * pi() * a * a
  ELSE 4 * pi() * power((power(a * b, 1.6) + power(a * c, 1.6) + power(b * c, 1.6)) / 3, 1 / 1.6::DOUBLE) END, 4) AS area FROM (SELECT event_id, value / 10 + 1 AS a, (event_id % 9) / 3.0::DOUBLE + 1 AS b, (event_id % 4) / 2.0::DOUBLE + 1 AS c FROM events)""")
def surface_area(spark, d):
    i = F.col("event_id")
    shape = A._pick(("box", "sphere", "cylinder", "capsule", "ellipsoid"), i)
    return table(spark, d, "events").select("event_id", F.round(maths.area(shape, F.col("value") / 10 + 1, (i % 9) / 3.0 + 1, (i % 4) / 2.0 + 1), 4).alias("area"))


_TINT = "CASE WHEN h > 1e-9 THEN least(greatest(c3 * (1 - 0.5::DOUBLE * h) + 0.5::DOUBLE * h, 0), 1) ELSE c3 END"


@query(f"""WITH g AS (SELECT event_id, unnest([0, 1, 2, 3]) AS k, (event_id % 7) / 5.0::DOUBLE AS red, (event_id % 4) / 3.0::DOUBLE AS a, CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id % 9) / 8.0::DOUBLE END AS m, (event_id % 3) / 4.0::DOUBLE AS e, (event_id % 5) / 6.0::DOUBLE AS f, (event_id % 2) / 3.0::DOUBLE AS s, (event_id % 8) / 8.0::DOUBLE AS h FROM events),
c AS (SELECT *, least(greatest(CASE WHEN k = 3 THEN a ELSE red - k / 10.0::DOUBLE END, 0), 1) AS own, least(greatest(m - (CASE WHEN k = 3 THEN 0 ELSE k END) / 20.0::DOUBLE, 0), 1) AS mat FROM g),
s1 AS (SELECT *, CASE WHEN e > 1e-9 THEN least(own * mat + e, 1) ELSE own * mat END AS c1 FROM c), s2 AS (SELECT *, CASE WHEN f > 1e-9 THEN least((1 - f) * c1 + f, 1) ELSE c1 END AS c2 FROM s1), s3 AS (SELECT *, CASE WHEN s > 1e-9 THEN least(c2 + s, 1) ELSE c2 END AS c3 FROM s2)
SELECT event_id, k::INT AS channel, round(CASE WHEN m IS NULL THEN own WHEN k = 3 THEN own * mat ELSE {_TINT} END, 9) AS value FROM s3""")
def geom_colors(spark, d):
    i = F.col("event_id")
    m = F.when(i % 6 != 0, (i % 9) / 8.0)
    rgba = points.blended([(i % 7) / 5.0 - k / 10.0 for k in range(3)] + [(i % 4) / 3.0], [m - k / 20.0 for k in range(3)] + [m], (i % 3) / 4.0, (i % 5) / 6.0, (i % 2) / 3.0, (i % 8) / 8.0)
    return table(spark, d, "events").select("event_id", F.posexplode(F.array(*rgba)).alias("channel", "value")).withColumn("value", F.round("value", 9))


_ANGLES = """e AS (SELECT event_id, (event_id % 7) / 3.0::DOUBLE - 1 AS x, (event_id % 5) / 4.0::DOUBLE - 0.5 AS y, (event_id % 11) / 5.0::DOUBLE - 1 AS z FROM events)"""


@query(f"""WITH {_ANGLES}, c AS (SELECT event_id, cos(x) AS cx, sin(x) AS sx, cos(y) AS cy, sin(y) AS sy, cos(z) AS cz, sin(z) AS sz FROM e)
SELECT event_id, round(cy * cz, 6) + 0.0 AS m00, round(sx * sy * cz - cx * sz, 6) + 0.0 AS m01, round(cx * sy * cz + sx * sz, 6) + 0.0 AS m02, round(cy * sz, 6) + 0.0 AS m10, round(sx * sy * sz + cx * cz, 6) + 0.0 AS m11,
  round(cx * sy * sz - sx * cz, 6) + 0.0 AS m12, round(-sy, 6) + 0.0 AS m20, round(sx * cy, 6) + 0.0 AS m21, round(cx * cy, 6) + 0.0 AS m22 FROM c""")
def quat_matrix(spark, d):
    """The matrix of the quaternion of Euler angles is the product of the three plane rotations."""
    i = F.col("event_id")
    q = maths.quat_of_euler((i % 7) / 3.0 - 1, (i % 5) / 4.0 - 0.5, (i % 11) / 5.0 - 1)
    m = maths.quat_matrix(q)
    return table(spark, d, "events").select("event_id", *[(F.round(m[a][b], 6) + 0.0).alias(f"m{a}{b}") for a in range(3) for b in range(3)])


@query("SELECT event_id, round((event_id % 7) / 3.0::DOUBLE - 1, 6) AS x, round((event_id % 5) / 4.0::DOUBLE - 0.5, 6) AS y, round((event_id % 11) / 5.0::DOUBLE - 1, 6) AS z FROM events")
def quat_roundtrip(spark, d):
    """Euler angles through a quaternion and its matrix are the angles again."""
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_id", ((i % 7) / 3.0 - 1).alias("x"), ((i % 5) / 4.0 - 0.5).alias("y"), ((i % 11) / 5.0 - 1).alias("z"))
    back = maths.euler_of_matrix(maths.quat_matrix(maths.quat_of_euler(F.col("x"), F.col("y"), F.col("z"))))
    return e.select("event_id", *[F.round(b + 0.0, 6).alias(c) for b, c in zip(back, "xyz", strict=True)])


@query("SELECT event_id, (event_id % 19) / 3.0::DOUBLE - 3 + 0.0 AS a, 1.0::DOUBLE AS size FROM events")
def quat_rotate(spark, d):
    """A rotation undone by its conjugate gives the vector back; q times its conjugate is 1."""
    i = F.col("event_id")
    q = maths.quat_of_euler((i % 7) / 3.0, (i % 5) / 4.0, (i % 11) / 5.0)
    v = [(i % 19) / 3.0 - 3, (i % 4) * 1.0, F.lit(1.0)]
    back = maths.rotated(maths.quat_conjugate(q), maths.rotated(q, v))
    return table(spark, d, "events").select("event_id", F.when(F.abs(back[0] - v[0]) < 1e-9, v[0]).otherwise(back[0]).alias("a"), F.round(maths.quat_product(q, maths.quat_conjugate(q))[0], 9).alias("size"))


@query("SELECT event_id, round((value - avg(value) OVER ()) / (stddev_pop(value) OVER () + 1e-8), 6) AS value FROM events")
def obs_normalize(spark, d):
    return store.observation_scale(table(spark, d, "events").select("event_id", "value"), ["value"]).withColumn("value", F.round("value", 6))


@query("SELECT round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, count(value) AS n FROM events")
def running_moments(spark, d):
    return store.running_moments(table(spark, d, "events"), "value").select(F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), "n")


@query("""WITH b AS (SELECT event_id // 128 AS batch, count(value) AS n, avg(value) AS m, coalesce(var_samp(value), 0) AS v FROM events GROUP BY 1),
w AS (SELECT *, sum(n) OVER (ORDER BY batch) + 1e-4::DOUBLE AS weight FROM b), s AS (SELECT *, m + n / weight AS mean FROM w),
p AS (SELECT *, coalesce(lag(mean) OVER (ORDER BY batch), 0) AS mb, coalesce(lag(weight) OVER (ORDER BY batch), 1e-4::DOUBLE) AS wb FROM s)
SELECT batch, round(mean, 6) AS mean, round((sum(v * n + (m - mb) * (m - mb) * wb * n / weight) OVER (ORDER BY batch) + 1e-4::DOUBLE) / weight, 4) AS variance FROM p""")
def running_moments_steps(spark, d):
    rows = table(spark, d, "events").select(F.expr("event_id div 128").alias("batch"), "value")
    return store.running_steps(rows, "batch", "value").select("batch", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query("SELECT count(DISTINCT user_id) AS n_distinct, count(DISTINCT user_id) = 150 AS ok FROM events")
def distinct_goals(spark, d):
    return store.distinct_check(table(spark, d, "events"), "user_id", 150)


@query("WITH RECURSIVE below(body) AS (SELECT 1::BIGINT UNION ALL SELECT event_id FROM events JOIN below ON (event_id - 1) // 3 = body WHERE event_id > 1) SELECT DISTINCT body FROM below")
def body_descendants(spark, d):
    e = table(spark, d, "events").where("event_id > 1").select(F.col("event_id").alias("body"), F.expr("(event_id - 1) div 3").alias("parent"))
    return points.descendants(spark, e, 1)


@query("SELECT event_id, round(x + 0.02::DOUBLE * v, 6) AS x, round(v + 0.02::DOUBLE * (push - 0.05::DOUBLE * turn * cos(a) / 1.1::DOUBLE), 6) AS v, round(-abs(degrees(a)), 6) AS reward FROM (SELECT *, (9.8::DOUBLE * sin(a) - cos(a) * push) / (0.5::DOUBLE * (4.0::DOUBLE / 3.0::DOUBLE - 0.1::DOUBLE * cos(a) * cos(a) / 1.1::DOUBLE)) AS turn FROM (SELECT *, (10.0::DOUBLE + 0.05::DOUBLE * w * w * sin(a)) / 1.1::DOUBLE AS push FROM (SELECT event_id, (event_id % 5) / 4.0::DOUBLE AS x, (event_id % 3) / 2.0::DOUBLE AS v, (event_id % 9) / 20.0::DOUBLE AS a, (event_id % 4) / 3.0::DOUBLE AS w FROM events)))")
def cart_pole(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_id", ((i % 5) / 4.0).alias("x"), ((i % 3) / 2.0).alias("v"), ((i % 9) / 20.0).alias("a"), ((i % 4) / 3.0).alias("w"))
    new = maths.cart_pole_step(F.col("x"), F.col("v"), F.col("a"), F.col("w"), F.lit(10.0))
    return e.select("event_id", F.round(new[0], 6).alias("x"), F.round(new[1], 6).alias("v"), F.round(maths.cart_pole_reward(F.col("a")), 6).alias("reward"))


# --- conversations


@query(f"WITH {A.TURNS} SELECT id || '_' || pos AS custom_id, id, pos, value FROM turns WHERE who = 'gpt' AND trim(value, ' ') <> ''")
def conv_explode_tasks(spark, d):
    return conversations.rewrite_tasks(A.conversations(spark, d))


@query(f"WITH {A.TURNS} SELECT id, pos, who AS \"from\", value, CASE WHEN who = 'gpt' AND trim(value, ' ') <> '' AND pos % 3 = 1 THEN left(value, 20) END AS rewritten FROM turns")
def conv_merge_back(spark, d):
    records = A.conversations(spark, d)
    done = conversations.rewrite_tasks(records).where("pos % 3 = 1").select("id", "pos", F.left("value", F.lit(20)).alias("rewritten"))
    merged = conversations.merged_back(records, done)
    return merged.select("id", F.posexplode("conversations").alias("pos", "t")).select("id", "pos", "t.from", "t.value", "t.rewritten")


@query(f"WITH {A.TURNS} SELECT id, 'A chat.' || ' ' || string_agg(who || ': ' || value || CASE WHEN pos % 2 = 0 THEN ' ' ELSE '</s>' END, '' ORDER BY pos) AS prompt FROM turns GROUP BY id")
def conv_render_prompt(spark, d):
    messages = F.transform("conversations", lambda t: F.struct(t["from"].alias("role"), t["value"].alias("text")))
    return A.conversations(spark, d).select("id", text.prompt(F.lit("A chat."), messages, "two", " ", "</s>").alias("prompt"))
