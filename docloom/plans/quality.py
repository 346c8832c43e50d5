"""Queries of the gates and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import audit, gates
from docloom.operators.records import quality
from docloom.plans import dialect as D
from docloom.plans.registry import query
from docloom.plans.text import records
from docloom.session import table

SAID = "CASE WHEN len(turns) > 0 AND len(list_filter(turns, lambda t: t.role = 'assistant')) > 0 AND array_to_string(list_transform(list_filter(turns, lambda t: t.role = 'assistant'), lambda t: coalesce(t.content, '')), chr(10)) <> '' THEN array_to_string(list_transform(list_filter(turns, lambda t: t.role = 'assistant'), lambda t: coalesce(t.content, '')), chr(10)) ELSE coalesce(answer, '') END"
DEIXIS = gates.DEIXIS.removeprefix("(?i)")
STRUCTURAL = "length(trim(coalesce(question, ''))) >= 15 AND length(trim(coalesce(answer, ''))) >= 10 AND trim(coalesce(question, '')) <> trim(coalesce(answer, '')) AND NOT (coalesce(task, '') <> 'multiturn' AND length(coalesce(question, '')) - length(replace(coalesce(question, ''), '?', '')) > 3)"

GATES = {
    "structural": f"SELECT id, ({STRUCTURAL}) AS passed, (CASE WHEN {STRUCTURAL} THEN 1.0 ELSE 0.0 END) AS score FROM r",
    "standalone_question": f"SELECT id, NOT regexp_matches(coalesce(question, ''), '{DEIXIS}', 'i') AS passed, CASE WHEN regexp_matches(coalesce(question, ''), '{DEIXIS}', 'i') THEN 0.0 ELSE 1.0 END AS score FROM r",
    "shortcut_leakage": f"""SELECT id, NOT e AND NOT ((ratio >= 0.6 AND shared >= 4) OR short) AS passed, CASE WHEN e THEN 0.0 ELSE 1.0 - ratio END AS score FROM (
        SELECT id, e, short, shared, shared::DOUBLE / greatest(1, n) AS ratio FROM (SELECT id, len(a) = 0 AS e, len(list_intersect(dist, q)) AS shared, len(dist) AS n, short FROM (
        SELECT id, a, q, list_filter(list_distinct(a), lambda x: len(list_filter(a, lambda y: y = x)) <= 3) AS dist, short FROM (
        SELECT id, {D.terms('answer')} AS a, {D.terms('question')} AS q, length(coalesce(answer, '')) < 40 AND contains(lower(coalesce(question, '')), lower(trim(coalesce(answer, '')))) AS short FROM r))))""",
    "lexical_grounding": f"""SELECT id, len(a) > 0 AND share >= 0.25 AS passed, share AS score FROM (SELECT id, a, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, c))::DOUBLE / len(a) END AS share FROM (
        SELECT id, list_distinct({D.terms('said')}) AS a, {D.terms('context')} AS c FROM (SELECT id, context, {SAID} AS said FROM r)))""",
    "numeric_grounding": f"""SELECT id, miss = 0 AS passed, CASE WHEN n = 0 THEN 1.0 ELSE 1.0 - miss::DOUBLE / n END AS score FROM (SELECT id, len(a) AS n, len(list_filter(a, lambda x: len(list_filter(c, lambda y: abs(x - y) <= greatest(0.01, abs(y) * 0.005))) = 0)) AS miss FROM (
        SELECT id, {D.numbers('said')} AS a, list_concat({D.numbers('context')}, flatten(list_transform(list_filter(coalesce(tool_trace, []), lambda s: coalesce(s.executed_ok, false)), lambda s: {D.numbers('s.executed_observation')}))) AS c FROM (SELECT id, context, tool_trace, {SAID} AS said FROM r)))""",
    "turn_coherence": f"""SELECT id, ok AS passed, CASE WHEN ok THEN 1.0 - d::DOUBLE / greatest(1, s) * 0.5 ELSE 0.0 END AS score FROM (SELECT id, first = 'user' AND NOT empty AND NOT again AND s > 0 AND d * 2 <= s AS ok, d, s FROM (
        SELECT id, turns[1].role AS first, len(list_filter(turns, lambda t: trim(coalesce(t.content, '')) = '')) > 0 AS empty, len(list_filter(range(2, len(turns) + 1), lambda i: turns[i].role = turns[i - 1].role)) > 0 AS again,
        len(list_filter(turns, lambda t: t.role = 'assistant')) AS s,
        len(list_filter(list_transform(list_filter(turns, lambda t: t.role = 'assistant'), lambda t: list_distinct({D.terms('t.content')})), lambda a: len(a) > 0 AND len(list_intersect(a, c))::DOUBLE / len(a) < 0.12)) AS d
        FROM (SELECT id, turns, {D.terms('context')} AS c FROM r WHERE len(turns) > 0)))""",
}


def gate_query(name: str) -> str:
    return f"WITH {D.RECORDS} SELECT id, passed, round(score, 6) AS score FROM ({GATES[name]})"


def verdict(rows: DataFrame, gate) -> DataFrame:
    return rows.select("id", gate.alias("g")).select("id", "g.passed", F.round("g.score", 6).alias("score"))


@query(gate_query("structural"))
def gate_structural(spark: SparkSession, d: str) -> DataFrame:
    return verdict(records(spark, d, "question", "answer", "task"), gates.structural(F.col("question"), F.col("answer"), F.col("task")))


@query(gate_query("standalone_question"))
def gate_standalone(spark: SparkSession, d: str) -> DataFrame:
    return verdict(records(spark, d, "question"), gates.standalone_question(F.col("question")))


@query(gate_query("shortcut_leakage"))
def gate_shortcut(spark: SparkSession, d: str) -> DataFrame:
    return verdict(records(spark, d, "question", "answer"), gates.shortcut_leakage(F.col("question"), F.col("answer")))


@query(gate_query("lexical_grounding"))
def gate_lexical(spark: SparkSession, d: str) -> DataFrame:
    return verdict(records(spark, d, "turns", "answer", "context"), gates.lexical_grounding(T.generated_text(F.col("turns"), F.col("answer")), F.col("context")))


@query(gate_query("numeric_grounding"))
def gate_numeric(spark: SparkSession, d: str) -> DataFrame:
    said = T.generated_text(F.col("turns"), F.col("answer"))
    return verdict(records(spark, d, "turns", "answer", "context", "tool_trace"), gates.numeric_grounding(said, gates.supported_numbers(F.col("context"), F.col("tool_trace"))))


@query(gate_query("turn_coherence"))
def gate_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "turns", "context").where("size(turns) > 0")
    return verdict(rows, gates.turn_coherence(F.col("turns"), F.col("context")))


def all_gates() -> str:
    visual = "(SELECT id FROM r WHERE task = 'figure_qa' AND len(images) > 0)"
    parts = []
    for name, sql in GATES.items():
        skip = f" WHERE id NOT IN {visual}" if name in ("lexical_grounding", "numeric_grounding") else ""
        parts.append(f"SELECT id, '{name}' AS stage, {gates.WEIGHTS[name]} AS w, passed, score FROM ({sql}){skip}")
    return " UNION ALL ".join(parts)


@query(f"WITH {D.RECORDS}, g AS ({all_gates()}) SELECT id, round(sum(CASE WHEN passed THEN w * score ELSE 0.0 END) / sum(w), 4) AS quality, count(*) FILTER (NOT passed) AS failed FROM g GROUP BY id")
def cheap_quality(spark: SparkSession, d: str) -> DataFrame:
    """The quality score from the gates that need no model."""
    rows = gates.cheap_gates(records(spark, d, "question", "answer", "task", "context", "turns", "tool_trace", "images")).select("id", "gates")
    return rows.select("id", gates.quality_score(F.col("gates")).alias("quality"), F.size(F.filter("gates", lambda g: ~g["passed"])).cast("bigint").alias("failed"))


HARDNESS = f"""h AS (SELECT id, task, coalesce(hops, 0) AS hops, round({D.entropy('a')}, 4) AS entropy, len(q) AS q_len, len(a) AS a_len, round(1.0 - {D.jaccard('q', 'c')}, 4) AS novelty, round(len(m)::DOUBLE / greatest(1, len(a)), 4) AS numeric_density
    FROM (SELECT id, task, hops, {D.terms('question')} AS q, {D.terms('answer')} AS a, {D.terms('context')} AS c, {D.numbers('answer')} AS m FROM r)),
    b AS (SELECT *, hops * 1.5 + numeric_density * 4 + entropy / 4 + a_len / 60 + CASE WHEN task IN ('multihop', 'react') THEN 1.5 ELSE 0 END AS s FROM h),
    hard AS (SELECT id, entropy, q_len, a_len, novelty, numeric_density, hops, CASE WHEN s < 2.2 THEN 'simple' WHEN s < 4.0 THEN 'intermediate' ELSE 'complex' END AS bucket FROM b)"""


@query(f"WITH {D.RECORDS}, {HARDNESS} SELECT * FROM hard")
def hardness(spark: SparkSession, d: str) -> DataFrame:
    return gates.hardness(records(spark, d, "task", "hops", "question", "answer", "context"))


@query(f"WITH {D.RECORDS} SELECT 'difficulty' AS axis, coalesce(difficulty, 'null') AS value, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'task', coalesce(task, 'null'), count(*) FROM r GROUP BY ALL UNION ALL SELECT 'persona', coalesce(persona, 'null'), count(*) FROM r GROUP BY ALL")
def composition(spark: SparkSession, d: str) -> DataFrame:
    return audit.composition(records(spark, d, "difficulty", "task", "persona"))


QUALITY = "coalesce(scores['quality'], 0.0)"


@query(f"WITH {D.RECORDS} SELECT count(*) AS n, round(avg({QUALITY}), 4) AS quality_mean, round(min({QUALITY}), 4) AS quality_min, round(max({QUALITY}), 4) AS quality_max FROM r")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.quality_summary(records(spark, d, "scores"))


@query(f"WITH {D.RECORDS}, v AS (SELECT unnest(prov.verification) AS v FROM r) SELECT v.stage AS stage, count(*) FILTER (NOT coalesce(v.inconclusive, false) AND v.passed) AS passed, count(*) FILTER (NOT coalesce(v.inconclusive, false) AND NOT v.passed) AS failed, count(*) FILTER (coalesce(v.inconclusive, false)) AS inconclusive FROM v GROUP BY 1")
def gate_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.gate_counts(records(spark, d, "prov"))


@query(f"WITH {D.RECORDS}, f AS (SELECT unnest(flags) AS f FROM r) SELECT substr(f, 8) AS reason, count(*) AS n FROM f WHERE f LIKE 'reject:%' GROUP BY 1")
def rejections(spark: SparkSession, d: str) -> DataFrame:
    return audit.rejections(records(spark, d, "flags"))


ACCEPTED = "len(list_filter(coalesce(flags, []), lambda f: starts_with(coalesce(f, ''), 'reject:'))) = 0"


@query(f"WITH {D.RECORDS} SELECT task, count(*) AS generated, count(*) FILTER ({ACCEPTED}) AS verified, count(*) FILTER ({ACCEPTED} AND {QUALITY} >= 0.55) AS kept FROM r GROUP BY task")
def yields(spark: SparkSession, d: str) -> DataFrame:
    return audit.yields(records(spark, d, "task", "flags", "scores"))


@query(f"WITH {D.RECORDS}, f AS (SELECT task, unnest(flags) AS f FROM r), g AS (SELECT task, substr(f, 8) AS reason, count(*) AS n FROM f WHERE f LIKE 'reject:%' GROUP BY ALL) SELECT task, reason, n, row_number() OVER (PARTITION BY task ORDER BY n DESC, reason) AS rank FROM g QUALIFY rank <= 3")
def top_reasons(spark: SparkSession, d: str) -> DataFrame:
    return audit.top_reasons(records(spark, d, "task", "flags"))


@query(f"WITH {D.RECORDS} SELECT source, count(*) AS n FROM (SELECT unnest(CASE WHEN len(prov.sources) > 0 THEN prov.sources ELSE [prov.source] END) AS source FROM r WHERE prov IS NOT NULL) GROUP BY source")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.sources(records(spark, d, "prov"))


@query(f"WITH {D.RECORDS} SELECT count(*) AS n, count(*) FILTER (coalesce(rejected, '') <> '') AS with_rejected, count(*) FILTER (len(images) > 0) AS with_images, count(*) FILTER (len(tool_trace) > 0) AS with_trace, count(*) FILTER (len(turns) > 0) AS multi_turn, round(avg(length(coalesce(answer, ''))), 1) AS mean_answer_chars FROM r")
def feature_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.features(records(spark, d, "rejected", "images", "tool_trace", "turns", "answer"))


@query(f"WITH {D.RECORDS}, s AS (SELECT list_sort(list({QUALITY})) AS q FROM r) SELECT x AS share, q[1 + least(len(q) - 1, floor(x * len(q))::BIGINT)] AS value FROM s, (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS x)")
def quality_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "scores")
    return audit.element_percentiles(rows.select(quality(rows).alias("q")), "q")


PLAN = f"""p AS (SELECT source, count(*) AS n, sum(greatest(1, length(coalesce(text, '')) // 4))::BIGINT AS tokens, count(*) FILTER (len(figures) > 0) AS figs FROM c GROUP BY source),
    q AS (SELECT *, tokens // n AS mean FROM p),
    x AS (SELECT 'qa' AS stage, n AS calls, mean, 700 AS reply FROM q UNION ALL SELECT 'multiturn', least(n, 4), mean, 1200 FROM q UNION ALL SELECT 'react', least(n, 3), mean, 900 FROM q UNION ALL SELECT 'figure_qa', figs, mean, 500 FROM q UNION ALL SELECT 'verify', floor(n * 3 * 0.8)::BIGINT * 3, mean, 300 FROM q)"""


@query(f"WITH {D.CHUNKS}, {PLAN} SELECT stage, sum(calls)::BIGINT AS calls, sum(calls * (mean + 400))::BIGINT AS tokens_in, sum(calls * reply)::BIGINT AS tokens_out FROM x GROUP BY stage")
def cost_plan(spark: SparkSession, d: str) -> DataFrame:
    return audit.cost_plan(table(spark, d, "chunks").where("id is not null").dropDuplicates(["id"]))
