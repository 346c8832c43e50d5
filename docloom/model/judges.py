"""Verification gates that ask a model, re-run code or ask a solver. Each is a column of prompts and a column of verdicts, so a
wave of gates over all records is one pass of calls."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.model.client import Backend, completed
from docloom.model.synth import prompt, windowed
from docloom.operators import gates
from docloom.tools.replay import run_python

LEAST_CLEAR, LEAST_ENTAILED, LEAST_AGREED = 0.6, 0.5, 0.3


def line(text: str | Column) -> Column:
    return F.regexp_replace(T.text_of(F.col(text) if isinstance(text, str) else text), r"\s+", " ")


def field(reply: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(T.recovered_json(reply), f"$.{path}", kind)


def is_object(reply: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(T.recovered_json(reply)), F.lit("OBJECT<")), F.lit(False)) & (F.coalesce(F.to_json(T.recovered_json(reply)), F.lit("{}")) != "{}")


def unjudged(stage: str) -> Column:
    """A reply that can't be read rejects nothing and confirms nothing."""
    return gates.gate(stage, F.lit(True), F.lit(0.0), F.lit("the reply can't be read"), F.lit(True))


def judged_as(stage: str, read: Column, verdict: Column) -> Column:
    return F.when(F.coalesce(read, F.lit(False)), verdict).otherwise(unjudged(stage))


def quantitative(answer: Column, context: Column) -> Column:
    """Whether both have numbers."""
    return (F.size(T.numbers(answer)) > 0) & (F.size(T.numbers(context)) > 0)


def forward_prompt() -> Column:
    return prompt("judge", "Does the source entail the claim? Reply with JSON: label (entailment, neutral, contradiction) and confidence.", F.col("window"), F.concat(F.lit("CLAIM: "), line("answer")))


def forward(reply: Column) -> Column:
    label, sure = F.lower(field(reply, "label", "string")), F.coalesce(field(reply, "confidence", "double"), F.lit(0.0))
    passed = (label == "entailment") & (sure >= LEAST_ENTAILED)
    return judged_as("nli_forward", label.isNotNull(), gates.gate("nli_forward", passed, F.when(label == "entailment", sure).otherwise(0.0), label))


def reverse_prompt() -> Column:
    return prompt("reverse", "Without any source: can the question be answered from general knowledge, and is that the given answer? Reply with JSON: answerable_without_source, matches_source_answer, confidence.", F.lit(""), F.concat(F.lit("QUESTION: "), line("question")), F.concat(F.lit("ANSWER: "), line("answer")))


def reverse(reply: Column) -> Column:
    """Fails if general knowledge gives the same answer, so that the source isn't needed."""
    yes = lambda name: F.coalesce(field(reply, name, "boolean"), F.lit(False))
    leaked, sure = yes("answerable_without_source") & yes("matches_source_answer"), F.coalesce(field(reply, "confidence", "double"), F.lit(0.0))
    verdict = gates.gate("nli_reverse", ~leaked, F.when(leaked, 1.0 - sure).otherwise(1.0), F.when(leaked, "general knowledge is enough").otherwise("the source is needed"))
    return judged_as("nli_reverse", is_object(reply), verdict)


def clarity_prompt() -> Column:
    return prompt("clarity", "Rate from 0 to 1 and reply with JSON: standalone, specific, natural, answer_complete.", F.lit(""), F.concat(F.lit("QUESTION: "), line("question")), F.concat(F.lit("ANSWER: "), line("answer")))


def clarity(reply: Column) -> Column:
    """The mean of four ratings; a missing one counts as 0."""
    rated = [F.coalesce(field(reply, name, "double"), F.lit(0.0)) for name in ("standalone", "specific", "natural", "answer_complete")]
    mean = (rated[0] + rated[1] + rated[2] + rated[3]) / 4
    return judged_as("clarity", is_object(reply), gates.gate("clarity", mean >= LEAST_CLEAR, mean, F.concat(F.lit("mean "), F.round(mean, 2).cast("string"))))


def consistency(answer: Column, replies: Column) -> Column:
    """Several answers from the context against the given one: mean overlap of their terms. Fails if there are none or if most
    of them say UNANSWERABLE."""
    known = F.array_distinct(T.terms(answer))
    n = F.size(replies)
    refused = F.size(F.filter(replies, lambda r: F.contains(F.upper(r), F.lit("UNANSWERABLE"))))
    overlap = T.let(known, lambda k: F.aggregate(F.transform(replies, lambda r: T.jaccard(k, F.array_distinct(T.terms(r)))), F.lit(0.0), lambda s, x: s + x)) / F.greatest(n, F.lit(1))
    verdict = gates.gate("self_consistency", overlap >= LEAST_AGREED, overlap, F.concat(F.lit("mean overlap "), F.round(overlap, 2).cast("string")))
    none = gates.gate("self_consistency", F.lit(False), F.lit(0.0), F.when(n == 0, "no answers").otherwise("most answers say it can't be answered"))
    return F.when((n == 0) | (refused * 2 > n), none).otherwise(verdict)


def visual(reply: Column, ok: Column, shown: Column) -> Column:
    """A figure's answer against the picture; without a picture, or where it can't be looked at, the gate passes."""
    label, sure = F.lower(F.coalesce(field(reply, "label", "string"), F.lit("neutral"))), F.coalesce(field(reply, "confidence", "double"), F.lit(0.0))
    seen = gates.gate("visual_grounding", label == "entailment", F.when(label == "entailment", sure).otherwise(0.0), label)
    none = gates.gate("visual_grounding", F.lit(True), F.lit(1.0), F.lit("no image"))
    return F.when(~shown, none).when(~ok, gates.gate("visual_grounding", F.lit(True), F.lit(0.5), F.lit("the image can't be judged"))).otherwise(seen)


def solver(constraints: str, timeout: float = 10.0) -> str:
    """sat, unsat, unknown or error for an SMT-LIB fragment; a worker process has one thread, so the solver's objects stay on it."""
    import z3

    try:
        s = z3.Solver()
        s.set("timeout", int(timeout * 1000))
        s.from_string(constraints.replace("(check-sat)", ""))
        return str(s.check())
    except Exception:  # noqa: BLE001 - the solver raises its own errors for what it can't read
        return "error"


def solver_installed() -> bool:
    try:
        import z3  # noqa: F401
    except ImportError:
        return False
    return True


def code_verdict(applicable: bool | None, code: str | None, allow: bool) -> tuple[bool, float, str, bool]:
    """(passed, score, detail, inconclusive) of checking code: it must print PASS and not FAIL."""
    if not applicable or not code:
        return True, 1.0, "nothing to compute", False
    if not allow:
        return True, 0.0, "execution is disabled", True
    ok, output = run_python(code)
    passed = ok and "PASS" in output and "FAIL" not in output
    return passed, float(passed), output, False


def solver_verdict(applicable: bool | None, claim: str | None, negation: str | None, solve=solver) -> tuple[bool, float, str, bool]:
    """A claim holds if its constraints can be met and those of its negation can't."""
    if not applicable or not claim:
        return True, 1.0, "nothing to solve", False
    first = solve(claim)
    if first == "error":
        return True, 0.5, "the constraints can't be read", False
    if first != "sat":
        return False, 0.0, f"the claim is {first}", False
    if not negation:
        return True, 0.7, "consistent, without a negation", False
    second = solve(negation)
    if second == "error":
        return True, 0.6, "the negation can't be read", False
    return second == "unsat", float(second == "unsat"), f"the negation is {second}", False


def computed_gates(records: DataFrame, backend: Backend, stage: str, allow_python: bool) -> DataFrame:
    """(id, gate): the gate `symbolic` (code that checks the numbers) or `z3` (a solver); records without numbers pass."""
    task, rules = {
        "symbolic": ("symbolic", "If the claim can be computed from the source, write Python code that prints PASS or FAIL. Reply with JSON: applicable, code."),
        "z3": ("solver", "If the claim has checkable structure, write SMT-LIB 2 constraints of the claim and of its negation. Reply with JSON: applicable, constraints, negation."),
    }[stage]
    rows = records.select("id", "question", "answer", "context", quantitative(F.col("answer"), F.col("context")).alias("numeric"))
    if stage == "z3" and not solver_installed():
        return rows.select("id", gates.gate(stage, F.lit(True), F.lit(1.0), F.lit("no solver is installed")).cast(gates.GATE).alias("gate"))
    plain = rows.where("not numeric").select("id", gates.gate(stage, F.lit(True), F.lit(1.0), F.lit("no numbers")).cast(gates.GATE).alias("gate"))
    text = prompt(task, rules, F.col("context"), F.concat(F.lit("QUESTION: "), line("question")), F.concat(F.lit("CLAIM: "), line("answer")))
    asked = completed(rows.where("numeric").select("id", text.alias("prompt")), backend, role="verify", json_reply=True)
    read = asked.select("id", field(F.col("reply"), "applicable", "boolean").alias("applicable"), field(F.col("reply"), "code" if stage == "symbolic" else "constraints", "string").alias("first"), field(F.col("reply"), "negation", "string").alias("second"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, applicable, first, second in frame.itertuples(index=False):
                applies = applicable is not None and bool(applicable) and applicable == applicable
                out.append((i, *(code_verdict(applies, first, allow_python) if stage == "symbolic" else solver_verdict(applies, first, second))))
            yield pd.DataFrame(out, columns=["id", "passed", "score", "detail", "inconclusive"])

    done = read.mapInPandas(work, f"id {rows.schema['id'].dataType.simpleString()}, passed boolean, score double, detail string, inconclusive boolean")
    return plain.unionByName(done.select("id", F.struct(F.lit(stage).alias("stage"), "passed", "score", "detail", "inconclusive").cast(gates.GATE).alias("gate")))


def best_window(kind: Column) -> Column:
    """Of the verdicts over the windows of one context the one with the highest score; one that could be read before others."""
    return F.max_by(kind, F.struct((~kind["inconclusive"]).alias("read"), kind["passed"].alias("passed"), kind["score"].alias("score")))


def entailment_gates(records: DataFrame, backend: Backend) -> DataFrame:
    """(id, gate) of the gate nli_forward; a long context is judged in windows, and the one that supports the answer best counts."""
    windows = windowed(records.select("id", "answer", "context"))
    asked = completed(windows.select("id", forward_prompt().alias("prompt")), backend, role="verify", json_reply=True)
    return asked.select("id", forward(F.col("reply")).cast(gates.GATE).alias("gate")).groupBy("id").agg(best_window(F.col("gate")).alias("gate"))


def question_gates(records: DataFrame, backend: Backend) -> DataFrame:
    """(id, gate) of the gates nli_reverse and clarity, two calls a record."""
    stages = F.array(F.struct(F.lit("nli_reverse").alias("stage"), reverse_prompt().alias("prompt")), F.struct(F.lit("clarity").alias("stage"), clarity_prompt().alias("prompt")))
    asked = completed(records.select("id", F.explode(stages).alias("x")).select("id", "x.*"), backend, role="verify", json_reply=True)
    return asked.select("id", F.when(F.col("stage") == "clarity", clarity(F.col("reply")).cast(gates.GATE)).otherwise(reverse(F.col("reply")).cast(gates.GATE)).alias("gate"))


def consistency_gates(records: DataFrame, backend: Backend, samples: int) -> DataFrame:
    """(id, gate): the question answered `samples` times from its context, once without and then with chance."""
    text = prompt("answer", "Answer using only this context; reply UNANSWERABLE if it does not answer.", F.col("context"), F.concat(F.lit("QUESTION: "), line("question")))
    rows = records.select("id", "answer", text.alias("prompt"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("turn"))
    first = completed(rows.where("turn = 0"), backend, role="verify")
    asked = first if samples == 1 else first.unionByName(completed(rows.where("turn > 0"), backend, temperature=0.7, role="verify"))
    per = asked.groupBy("id").agg(F.first("answer").alias("answer"), F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("turn", "reply")))), lambda x: x["reply"]).alias("said"))
    return per.select("id", consistency(F.col("answer"), F.col("said")).cast(gates.GATE).alias("gate"))


def visual_gates(records: DataFrame, backend: Backend) -> DataFrame:
    """(id, gate) of figure records; images that no worker can read count as missing."""

    def existing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(images=[[p for p in ([] if x is None else x) if p and os.path.exists(p)][:1] for x in frame["images"]])

    kind = records.schema["id"].dataType.simpleString()
    caption = F.element_at(F.split(T.text_of(F.col("context")), "\n"), 1)
    text = prompt("judge", "Does the picture show the claim? Reply with JSON: label (entailment, neutral, contradiction) and confidence.", caption, F.concat(F.lit("CLAIM: "), line("answer")))
    rows = records.select("id", "images", text.alias("prompt")).mapInPandas(existing, f"id {kind}, images array<string>, prompt string")
    asked = completed(rows.where("size(images) > 0"), backend, role="vision", images="images", json_reply=True).select("id", visual(F.col("reply"), F.col("ok"), F.lit(True)).cast(gates.GATE).alias("gate"))
    return asked.unionByName(rows.where("size(images) = 0").select("id", gates.gate("visual_grounding", F.lit(True), F.lit(1.0), F.lit("no image")).cast(gates.GATE).alias("gate")))


def added(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The records with more verdicts at the end of `gates`, in a fixed order of stages."""
    order = {name: i for i, name in enumerate(gates.WEIGHTS)}
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    per = verdicts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.try_element_at(place, F.col("gate.stage")).alias("at"), "gate"))), lambda x: x["gate"]).alias("more"))
    return records.join(per, "id", "left").withColumn("gates", F.concat("gates", F.coalesce("more", F.array().cast(f"array<{gates.GATE}>")))).drop("more")


def verified(records: DataFrame, backend: Backend, samples: int = 0, symbolic: bool = True, allow_python: bool = False, cut=lambda df: df) -> DataFrame:
    """The records (with `gates` from the gates that need no model) and the verdicts of the model's gates, in waves: a record
    that a wave rejects costs no call in the next. Figure records are judged by their picture instead of their text."""
    fine = F.forall("gates", lambda g: g["passed"])
    figure = (F.col("task") == "figure_qa") & (F.size(F.coalesce("images", F.array().cast("array<string>"))) > 0)
    passed, out = cut(records.where(fine)), records.where(~fine)
    text = passed.where(~figure)
    verdicts = question_gates(passed, backend).unionByName(entailment_gates(text, backend)).unionByName(visual_gates(passed.where(figure), backend))
    if samples > 0:
        verdicts = verdicts.unionByName(consistency_gates(text, backend, samples))
    judged = cut(added(passed, verdicts))
    for stage in ("symbolic", "z3") if symbolic else ():
        asked = judged.where(fine & ~figure)
        judged = cut(added(judged, computed_gates(asked, backend, stage, allow_python)))
    return judged.unionByName(out)
