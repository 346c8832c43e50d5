"""Queries of the gates that ask a model. The replies are scripted: made from the records, so that SQL can say the verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.model import judges
from docloom.plans import dialect as D
from docloom.plans.quality import verdict
from docloom.plans.registry import query
from docloom.plans.text import records
from docloom.tools import replay


def n(column: str, most: int) -> F.Column:
    """A number below `most` made from a text's length."""
    return F.length(T.text_of(F.col(column))) % most


@query(f"WITH {D.RECORDS}, x AS (SELECT id, length(coalesce(question, '')) % 7 AS q, length(coalesce(answer, '')) % 11 AS a FROM r), y AS (SELECT id, q, (q / 6 + a / 10 + 0.8) / 4 AS m FROM x) SELECT id, q = 0 OR m >= 0.6 AS passed, CASE WHEN q = 0 THEN 0.0 ELSE round(m, 6) END AS score, q = 0 AS inconclusive FROM y")
def gate_clarity(spark: SparkSession, d: str) -> DataFrame:
    """Ratings by JSON in a fenced block, one of them missing; a seventh of the replies can't be read."""
    rating = F.to_json(F.struct((n("question", 7) / 6).alias("standalone"), (n("answer", 11) / 10).alias("specific"), F.lit(0.8).alias("natural")))
    reply = F.when(n("question", 7) == 0, "no rating").otherwise(F.concat(F.lit("Here it is:\n```json\n"), rating, F.lit("\n```")))
    rows = records(spark, d, "question", "answer").withColumn("reply", reply)
    return with_doubt(rows, judges.clarity(F.col("reply")))


def with_doubt(rows: DataFrame, gate: F.Column) -> DataFrame:
    return rows.select("id", gate.alias("g")).select("id", "g.passed", F.round("g.score", 6).alias("score"), "g.inconclusive")


@query(f"WITH {D.RECORDS}, x AS (SELECT id, length(coalesce(question, '')) % 3 AS q, length(coalesce(answer, '')) % 2 AS a FROM r) SELECT id, NOT (q <> 0 AND a = 1) AS passed, CASE WHEN q <> 0 AND a = 1 THEN round(1.0 - q / 4, 6) ELSE 1.0 END AS score, false AS inconclusive FROM x")
def gate_reverse(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "question", "answer")
    reply = F.to_json(F.struct((n("question", 3) != 0).alias("answerable_without_source"), (n("answer", 2) == 1).alias("matches_source_answer"), (n("question", 3) / 4).alias("confidence")))
    return with_doubt(rows.withColumn("reply", reply), judges.reverse(F.col("reply")))


@query(f"WITH {D.RECORDS}, x AS (SELECT id, length(coalesce(question, '')) % 4 AS q, (length(coalesce(answer, '')) % 11) / 10 AS s FROM r) SELECT id, q = 3 OR (q <> 0 AND s >= 0.5) AS passed, CASE WHEN q IN (0, 3) THEN 0.0 ELSE round(s, 6) END AS score, q = 3 AS inconclusive FROM x")
def gate_entailment(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "question", "answer")
    label = F.when(n("question", 4) == 0, "Contradiction").otherwise("ENTAILMENT")
    reply = F.when(n("question", 4) == 3, "I would say so.").otherwise(F.to_json(F.struct(label.alias("label"), (n("answer", 11) / 10).alias("confidence"))))
    return with_doubt(rows.withColumn("reply", reply), judges.forward(F.col("reply")))



@query(f"WITH {D.RECORDS}, x AS (SELECT id, length(coalesce(question, '')) % 5 = 0 AS refused, list_distinct({D.terms('answer')}) AS a, list_distinct({D.terms('rejected')}) AS b, list_distinct({D.terms('context')}) AS c FROM r), y AS (SELECT id, refused, ({D.jaccard('a', 'a')} + {D.jaccard('a', 'b')} + {D.jaccard('a', 'c')}) / 3 AS s FROM x) SELECT id, NOT refused AND s >= 0.3 AS passed, CASE WHEN refused THEN 0.0 ELSE round(s, 6) END AS score FROM y")
def gate_consistency(spark: SparkSession, d: str) -> DataFrame:
    """The answer, the rejected answer and the context as three answers; a fifth is refused by most."""
    rows = records(spark, d, "question", "answer", "rejected", "context")
    said = F.array(*[T.text_of(F.col(c)) for c in ("answer", "rejected", "context")])
    refused = F.array(F.lit("UNANSWERABLE"), F.lit("unanswerable."), T.text_of(F.col("answer")))
    return verdict(rows, judges.consistency(F.col("answer"), F.when(n("question", 5) == 0, refused).otherwise(said)))


@query(f"WITH {D.RECORDS} SELECT id, len(tool_trace) AS steps, TRUE AS agreed FROM r WHERE len(tool_trace) > 0")
def trace_repair_holds(spark: SparkSession, d: str) -> DataFrame:
    """Traces that were repaired and run again: every step whose tool ran agrees with what it gave before."""
    rows = records(spark, d, "context", "tool_trace", "tool_env")
    fixed = replay.repair_traces(rows).select("id", F.col("tool_trace").alias("fixed"))
    again = replay.trace_gates(rows.join(fixed, "id").withColumn("tool_trace", F.col("fixed")).drop("fixed"))
    same = F.forall("tool_trace", lambda s: ~F.coalesce(s["executed_ok"], F.lit(False)) | s["executed_observation"].isNull() | T.observations_agree(s["observation"], s["executed_observation"]))
    return again.select("id", F.size("tool_trace").alias("steps"), same.alias("agreed"))


@query(f"WITH {D.RECORDS}, s AS (SELECT id, unnest(tool_trace) AS t FROM r WHERE len(tool_trace) > 0) SELECT id, count(*) FILTER (lower(trim(coalesce(t.action, ''))) IN ('sql', 'lookup', 'python')) AS known, count(*) AS steps FROM s GROUP BY id")
def trace_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of known tools, by what a replay could run or had to skip."""
    out = replay.trace_gates(records(spark, d, "context", "tool_trace", "tool_env"), allow_python=False).where("size(tool_trace) > 0")
    known = F.filter("tool_trace", lambda s: F.lower(F.trim(T.text_of(s["action"]))).isin(*replay.TOOLS))
    return out.select("id", F.size(known).cast("bigint").alias("known"), F.size("tool_trace").cast("bigint").alias("steps"))
