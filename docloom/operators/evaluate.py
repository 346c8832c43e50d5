"""Answering and grading: grounded answers over retrieved passages, and a dataset's questions put to a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.model.client import Backend, completed
from docloom.model.synth import prompt
from docloom.operators import audit, retrieve
from docloom.session import cut


def answers(passages: DataFrame, questions: DataFrame, backend: Backend, k: int = 5, alpha: float = 0.5, least: float = 0.12) -> DataFrame:
    """(query, question, answer, citations, sources, refused): answers from the k best passages; without any the question is refused."""
    hits = retrieve.hybrid_topk(passages, questions, "id", "text", "query", "question", k, alpha, least)
    none = F.array().cast("array<string>")
    have = set(passages.columns)
    cite = T.citation(F.col("source"), F.col("pages") if "pages" in have else F.array().cast("array<int>"), F.col("anchors") if "anchors" in have else none, F.col("breadcrumb") if "breadcrumb" in have else F.lit(""))
    found = hits.join(passages.select("id", cite.alias("citation"), "source", F.col("text").alias("body")), "id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "citation", "source", "body")))
    per = found.groupBy("query").agg(ordered.alias("h"))
    rows = questions.select("query", "question").join(per, "query", "left")
    source = F.array_join(F.transform("h", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] ("), x["citation"], F.lit(") "), x["body"])), "\n\n")
    text = prompt("answer", "Answer from the passages only and cite them by number; reply UNANSWERABLE if they don't answer.", source, F.concat(F.lit("QUESTION: "), F.regexp_replace("question", r"\s+", " ")))
    asked = completed(rows.where("h is not null").withColumn("prompt", text), backend)
    said = asked.select("query", "question", F.coalesce("reply", F.lit("")).alias("answer"), F.transform("h", lambda x: x["citation"]).alias("citations"), F.transform("h", lambda x: x["source"]).alias("sources"), (T.is_refusal(F.col("reply")) | ~F.col("ok")).alias("refused"))
    empty = rows.where("h is null").select("query", "question", F.lit("No passage is relevant to that question.").alias("answer"), none.alias("citations"), none.alias("sources"), F.lit(True).alias("refused"))
    return said.unionByName(empty)


def judged_grades(rows: DataFrame, backend: Backend) -> DataFrame:
    """Adds `grade`, the verdict of a judge on `prediction`: correct, partial or wrong. A verdict of correct is partial if a number
    of the reference is missing; an empty prediction is wrong without a call, and so is one whose verdict can't be read."""
    line = lambda c: F.regexp_replace(T.text_of(F.col(c)), r"\s+", " ")
    text = prompt("grade", "Grade the candidate against the reference. Reply with JSON: verdict (correct, partial, incorrect), missing, wrong.", F.lit(""), F.concat(F.lit("QUESTION: "), line("question")), F.concat(F.lit("REFERENCE: "), line("answer")), F.concat(F.lit("CANDIDATE: "), line("prediction")))
    asked = completed(rows.where("trim(prediction) <> ''").withColumn("prompt", text), backend, role="verify", json_reply=True)
    verdict = F.lower(F.try_variant_get(T.recovered_json(F.col("reply")), "$.verdict", "string"))
    grade = F.when((verdict == "correct") & (F.col("numeric") >= 1), "correct").when(verdict.isin("correct", "partial"), "partial").otherwise("wrong")
    return asked.withColumn("grade", grade).select(*rows.columns, "grade").unionByName(rows.where("trim(prediction) = ''").withColumn("grade", F.lit("wrong")))


def evaluate(records: DataFrame, backend: Backend, mode: str = "context", passages: DataFrame | None = None, k: int = 5, judge: bool = False) -> DataFrame:
    """(id, task, prediction, f1, numeric, grade, found_source): the model's answers, graded.

    mode: context (the record's own context), closed (nothing) or retrieval (the k best of the passages; found_source tells whether
    one of them is of the record's source, and is null in the other modes). Without a judge the agreement with the reference
    decides: correct from an F1 of .6 and all numbers, partial from .3 or with numbers missing, else wrong.
    """
    if mode not in ("context", "closed", "retrieval"):
        raise ValueError("mode is context, closed or retrieval")
    if mode == "retrieval":
        if passages is None:
            raise ValueError("retrieval needs passages")
        said = answers(passages, records.select(F.col("id").alias("query"), "question"), backend, k).select(F.col("query").alias("id"), F.col("answer").alias("prediction"), "sources", "refused")
        rows = records.select("id", "task", "question", "answer", F.col("prov.source").alias("source")).join(said, "id").withColumn("prediction", F.when(F.col("refused"), "").otherwise(T.text_of(F.col("prediction"))))
        rows = rows.withColumn("found_source", F.coalesce(F.array_contains("sources", F.col("source")), F.lit(False)))
    else:
        question = F.concat(F.lit("QUESTION: "), F.regexp_replace("question", r"\s+", " "))
        source = F.col("context") if mode == "context" else F.lit("")
        asked = completed(records.select("id", "task", "question", "answer", prompt("answer", "Answer the question.", source, question).alias("prompt")), backend, role="verify")
        rows = asked.select("id", "task", "question", "answer", T.text_of(F.col("reply")).alias("prediction"), F.lit(None).cast("boolean").alias("found_source"))
    graded = audit.grades(cut(rows), "prediction", "answer")
    if judge:
        graded = judged_grades(graded, backend)
    else:
        graded = graded.withColumn("grade", F.when((F.col("f1") >= 0.6) & (F.col("numeric") >= 1), "correct").when(F.col("f1") >= 0.3, "partial").otherwise("wrong"))
    return graded.select("id", "task", "prediction", "f1", "numeric", "grade", "found_source")


def summary(graded: DataFrame) -> DataFrame:
    """(task, n, accuracy, partial, f1, numeric, recall), the last row, with a null task, for all; recall is the share of questions
    whose own source was among the passages, null without retrieval."""
    share = lambda c: F.avg(c.cast("double"))
    return graded.rollup("task").agg(F.count("*").alias("n"), share(F.col("grade") == "correct").alias("accuracy"), share(F.col("grade") == "partial").alias("partial"), F.avg("f1").alias("f1"), F.avg("numeric").alias("numeric"), share(F.col("found_source")).alias("recall"))
