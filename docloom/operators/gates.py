"""Verification gates without a model: each gives a struct of verdict and score, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

# Phrases that point at a text the reader of the question does not have.
DEIXIS = r"(?i)(^|[^0-9A-Za-z_])(this|the)\s+(passage|section|paper|document|text|excerpt|table above|figure above)($|[^0-9A-Za-z_])|(^|[^0-9A-Za-z_])the above($|[^0-9A-Za-z_])|(^|[^0-9A-Za-z_])as (stated|mentioned|shown) (above|here)($|[^0-9A-Za-z_])"
# The weight of each gate in the quality score.
WEIGHTS = {
    "nli_forward": 3.0, "visual_grounding": 3.0, "trace_execution": 3.0, "nli_reverse": 2.0, "clarity": 2.0, "symbolic": 2.0, "z3": 2.0,
    "turn_coherence": 2.0, "self_consistency": 1.5, "numeric_grounding": 1.5, "lexical_grounding": 1.0, "shortcut_leakage": 1.0,
    "standalone_question": 1.0, "structural": 0.5,
}
CHEAP = ("structural", "standalone_question", "shortcut_leakage", "lexical_grounding", "numeric_grounding")
GATE = "struct<stage:string,passed:boolean,score:double,detail:string,inconclusive:boolean>"


def gate(stage: str, passed: Column, score: Column, detail: Column | None = None, inconclusive: Column | None = None) -> Column:
    """One verdict. A gate that could not be judged passes, is inconclusive and does not count for the score."""
    parts = [F.lit(stage).alias("stage"), passed.cast("boolean").alias("passed"), score.cast("double").alias("score")]
    return F.struct(*parts, (detail if detail is not None else F.lit("")).cast("string").alias("detail"), (inconclusive if inconclusive is not None else F.lit(False)).alias("inconclusive"))


def structural(question: Column, answer: Column, task: Column, least_question: int = 15, least_answer: int = 10) -> Column:
    """Question and answer are long enough and different, and the question is not a list of questions."""
    q, a = F.trim(T.text_of(question)), F.trim(T.text_of(answer))
    marks = F.length(T.text_of(question)) - F.length(F.replace(T.text_of(question), F.lit("?"), F.lit("")))
    many = (T.text_of(task) != "multiturn") & (marks > 3)
    passed = (F.length(q) >= least_question) & (F.length(a) >= least_answer) & (q != a) & ~many
    return gate("structural", passed, passed.cast("double"))


def standalone_question(question: Column) -> Column:
    passed = ~F.rlike(T.text_of(question), F.lit(DEIXIS))
    return gate("standalone_question", passed, passed.cast("double"))


def shortcut_leakage(question: Column, answer: Column, most: float = 0.6, least_shared: int = 4) -> Column:
    """The question does not already hold the answer's distinctive terms (those that come at most three times)."""
    said = T.terms(answer)
    # In the sorted terms a word begins where the one before differs, and comes four times if the third one after it is the same.
    once = lambda t: F.filter(t, lambda x, i: ((i == 0) | (F.get(t, i - 1) != x)) & ~F.coalesce(F.get(t, i + 3) == x, F.lit(False)))
    distinctive = T.let(F.array_sort(said), once)
    shared = F.size(F.array_intersect(distinctive, T.terms(question)))
    ratio = shared / F.greatest(F.lit(1), F.size(distinctive))
    short = (F.length(T.text_of(answer)) < 40) & F.contains(F.lower(T.text_of(question)), F.lower(F.trim(T.text_of(answer))))
    empty = F.size(said) == 0
    leaked = ((ratio >= most) & (shared >= least_shared)) | short
    return gate("shortcut_leakage", ~empty & ~leaked, F.when(empty, 0.0).otherwise(1.0 - ratio))


def lexical_grounding(said: Column, context: Column, least: float = 0.25) -> Column:
    """Share of the distinct terms that the context has."""
    mine = F.array_distinct(T.terms(said))
    share = F.size(F.array_intersect(mine, T.terms(context))) / F.size(mine)
    share = F.when(F.size(mine) == 0, 0.0).otherwise(share)
    return gate("lexical_grounding", (F.size(mine) > 0) & (share >= least), share)


def supported_numbers(context: Column, trace: Column | None = None) -> Column:
    """Numbers of the context and of the outputs of tool calls that ran well."""
    if trace is None:
        return T.numbers(context)
    ran = F.filter(F.coalesce(trace, F.array()), lambda s: F.coalesce(s["executed_ok"], F.lit(False)))
    return F.concat(T.numbers(context), F.flatten(F.transform(ran, lambda s: T.numbers(s["executed_observation"]))))


def numeric_grounding(said: Column, supported: Column) -> Column:
    """Every number is among the supported ones, within half a per cent."""
    mine = T.numbers(said)
    missing = T.let(supported, lambda known: F.size(F.filter(mine, lambda n: ~F.exists(known, lambda c: T.near(n, c)))))
    score = F.when(F.size(mine) == 0, 1.0).otherwise(1.0 - missing / F.size(mine))
    return gate("numeric_grounding", missing == 0, score)


def turn_coherence(turns: Column, context: Column, least: float = 0.12) -> Column:
    """A dialogue opens with the user, alternates, has no empty turn, and most assistant turns share terms with the source."""
    n = F.size(turns)
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    empty = F.exists(turns, lambda t: F.trim(T.text_of(t["content"])) == "")
    repeats = F.exists(at, lambda i: (i > 0) & (F.get(turns, i)["role"] == F.get(turns, i - 1)["role"]))
    said = F.filter(turns, lambda t: t["role"] == "assistant")

    def adrift(t: Column, known: Column) -> Column:
        mine = F.array_distinct(T.terms(t["content"]))
        return (F.size(mine) > 0) & (F.size(F.array_intersect(mine, known)) / F.size(mine) < least)

    drifting = T.let(T.terms(context), lambda known: F.size(F.filter(said, lambda t: adrift(t, known))))
    passed = (turns[0]["role"] == "user") & ~empty & ~repeats & (F.size(said) > 0) & (drifting * 2 <= F.size(said))
    score = F.when(passed, 1.0 - drifting / F.greatest(F.lit(1), F.size(said)) * 0.5).otherwise(0.0)
    return gate("turn_coherence", passed, score)


def cheap_gates(records: DataFrame) -> DataFrame:
    """Adds `gates`: the verdicts of all gates that apply to a record and need no model. Figure records skip the text gates."""
    said = T.generated_text(F.col("turns"), F.col("answer"))
    visual = (F.col("task") == "figure_qa") & (F.size(F.coalesce("images", F.array().cast("array<string>"))) > 0)
    base = [structural(F.col("question"), F.col("answer"), F.col("task")), standalone_question(F.col("question")), shortcut_leakage(F.col("question"), F.col("answer"))]
    text = [lexical_grounding(said, F.col("context")), numeric_grounding(said, supported_numbers(F.col("context"), F.col("tool_trace")))]
    none = F.array().cast(f"array<{GATE}>")
    talk = F.when(F.size(F.coalesce("turns", F.array().cast("array<struct<role:string,content:string>>"))) > 0, F.array(turn_coherence(F.col("turns"), F.col("context")))).otherwise(none)
    # A trace that was run again (tools.replay.trace_gates) has its verdict already.
    trace = F.when(F.col("trace_gate").isNotNull(), F.array(F.col("trace_gate").cast(GATE))).otherwise(none) if "trace_gate" in records.columns else none
    return records.withColumn("gates", F.concat(trace, F.array(*base), F.when(visual, none).otherwise(F.array(*text)), talk)).drop("trace_gate")


def quality_score(gates: Column) -> Column:
    """Weighted mean of the judged gates; a failed gate scores 0 but keeps its weight."""
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    weight = lambda g: F.coalesce(F.try_element_at(weights, g["stage"]), F.lit(1.0))
    judged = F.filter(gates, lambda g: ~g["inconclusive"])
    top = F.aggregate(judged, F.lit(0.0), lambda s, g: s + F.when(g["passed"], weight(g) * g["score"]).otherwise(0.0))
    all_ = F.aggregate(judged, F.lit(0.0), lambda s, g: s + weight(g))
    return F.round(F.when(all_ > 0, top / all_).otherwise(0.0), 4)


def verdict_flags(gates: Column) -> Column:
    """reject:<gate> for failed gates, unverified:<gate> for those that could not be judged."""
    flagged = F.filter(gates, lambda g: g["inconclusive"] | ~g["passed"])
    return F.transform(flagged, lambda g: F.concat(F.when(g["inconclusive"], "unverified:").otherwise("reject:"), g["stage"]))


def hardness(records: DataFrame) -> DataFrame:
    """(id, entropy, q_len, a_len, novelty, numeric_density, hops, bucket): how hard a record is, and its difficulty bucket."""
    rows = records.select("id", "task", F.coalesce("hops", F.lit(0)).alias("hops"), T.terms(F.col("question")).alias("q"), T.terms(F.col("answer")).alias("a"), T.terms(F.col("context")).alias("c"), F.size(T.numbers(F.col("answer"))).alias("n"))
    out = rows.select(
        "id", "task", F.round(T.entropy(F.col("a")), 4).alias("entropy"), F.size("q").alias("q_len"), F.size("a").alias("a_len"),
        F.round(1.0 - T.jaccard(F.col("q"), F.col("c")), 4).alias("novelty"), F.round(F.col("n") / F.greatest(F.lit(1), F.size("a")), 4).alias("numeric_density"), "hops",
    )
    score = F.col("hops") * 1.5 + F.col("numeric_density") * 4 + F.col("entropy") / 4 + F.col("a_len") / 60 + F.when(F.col("task").isin("multihop", "react"), 1.5).otherwise(0.0)
    return out.withColumn("bucket", F.when(score < 2.2, "simple").when(score < 4.0, "intermediate").otherwise("complex")).drop("task")
