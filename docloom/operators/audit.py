"""Reports over records: composition, gates, rejections, yield, percentiles, cost plan, grades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.records import accepted, quality


def composition(records: DataFrame) -> DataFrame:
    """(axis, value, n): number of records by difficulty, by task and by persona; null values are named 'null'."""
    rows = records.groupingSets([[F.col("difficulty")], [F.col("task")], [F.col("persona")]], "difficulty", "task", "persona").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    axis = F.when(F.col("g") == 3, "difficulty").when(F.col("g") == 5, "task").otherwise("persona")
    value = F.when(F.col("g") == 3, F.col("difficulty")).when(F.col("g") == 5, F.col("task")).otherwise(F.col("persona"))
    return rows.select(axis.alias("axis"), F.coalesce(value, F.lit("null")).alias("value"), "n")


def quality_summary(records: DataFrame) -> DataFrame:
    q = quality(records)
    return records.agg(F.count("*").alias("n"), F.round(F.avg(q), 4).alias("quality_mean"), F.round(F.min(q), 4).alias("quality_min"), F.round(F.max(q), 4).alias("quality_max"))


def gate_counts(records: DataFrame) -> DataFrame:
    """(stage, passed, failed, inconclusive): verdicts of each gate in the verification logs; inconclusive ones are neither."""
    rows = records.select(F.explode("prov.verification").alias("v")).select("v.stage", "v.passed", F.coalesce("v.inconclusive", F.lit(False)).alias("i"))
    return rows.groupBy("stage").agg(F.count_if(~F.col("i") & F.col("passed")).alias("passed"), F.count_if(~F.col("i") & ~F.col("passed")).alias("failed"), F.count_if(F.col("i")).alias("inconclusive"))


def rejections(records: DataFrame) -> DataFrame:
    """(reason, n): how many records each gate rejected."""
    rows = records.select(F.explode("flags").alias("f")).where("f like 'reject:%'")
    return rows.groupBy(F.substring("f", 8, 1000).alias("reason")).agg(F.count("*").alias("n"))


def yields(records: DataFrame, least_quality: float = 0.55) -> DataFrame:
    """(task, generated, verified, kept): records of each task, those no gate rejected, and those of them good enough."""
    ok = accepted(F.col("flags"))
    return records.groupBy("task").agg(F.count("*").alias("generated"), F.count_if(ok).alias("verified"), F.count_if(ok & (quality(records) >= least_quality)).alias("kept"))


def top_reasons(records: DataFrame, k: int = 3) -> DataFrame:
    """(task, reason, n, rank): the k most frequent rejections of each task, ties by name."""
    from pyspark.sql.window import Window

    rows = records.select("task", F.explode("flags").alias("f")).where("f like 'reject:%'").groupBy("task", F.substring("f", 8, 1000).alias("reason")).agg(F.count("*").alias("n"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("n"), "reason"))).where(F.col("rank") <= k)


def sources(records: DataFrame) -> DataFrame:
    """(source, n): records that name each source, in `sources` if there are any, else in `source`."""
    many = F.coalesce("prov.sources", F.array().cast("array<string>"))
    named = F.when(F.size(many) > 0, many).otherwise(F.array("prov.source"))
    return records.where("prov is not null").select(F.explode(named).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def features(records: DataFrame) -> DataFrame:
    """One row: how many records have a rejected answer, images, a tool trace, turns, and the mean length of answers."""
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return records.agg(
        F.count("*").alias("n"), F.count_if(T.text_of(F.col("rejected")) != "").alias("with_rejected"), F.count_if(filled(F.col("images"))).alias("with_images"),
        F.count_if(filled(F.col("tool_trace"))).alias("with_trace"), F.count_if(filled(F.col("turns"))).alias("multi_turn"), F.round(F.avg(F.length(T.text_of(F.col("answer")))), 1).alias("mean_answer_chars"),
    )


def element_percentiles(values: DataFrame, column: str, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(share, value): the element at min(n - 1, floor(share * n)) of the sorted values, not interpolated; nulls are left out.

    Values are counted first, and the distinct values' running count tells the element, in slices of the value range: a slice
    is sorted by itself, so all rows never meet in one task.
    """
    from pyspark.sql.window import Window

    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    low, high, n = counts.agg(F.min("v"), F.max("v"), F.sum("c")).first()
    if not n:
        return values.sparkSession.createDataFrame([], "share double, value double")
    width = (high - low) / 1024 or 1.0
    sliced = counts.withColumn("s", F.floor((F.col("v") - low) / width))
    per = sliced.groupBy("s").agg(F.sum("c").alias("w"))
    before = per.select("s", (F.sum("w").over(Window.orderBy("s")) - F.col("w")).alias("b"))
    inner = F.sum("c").over(Window.partitionBy("s").orderBy("v"))
    placed = sliced.join(F.broadcast(before), "s").withColumn("hi", F.col("b") + inner).withColumn("lo", F.col("hi") - F.col("c"))
    wanted = values.sparkSession.createDataFrame([(s, min(n - 1, int(s * n))) for s in shares], "share double, at bigint")
    return placed.join(F.broadcast(wanted), (F.col("lo") <= F.col("at")) & (F.col("at") < F.col("hi"))).select("share", F.col("v").alias("value"))


#: Tokens of one prompt beyond its chunk, and of one reply, by stage.
OVERHEAD, REPLY = 400, {"qa": 700, "multiturn": 1200, "react": 900, "figure_qa": 500, "verify": 300}


def rates_from_report(report: dict) -> dict[str, float]:
    """Shares of records that reach the model's gates, the code check and the solver, by the gate counts of an earlier run; 1
    where the report says nothing, so that a plan without measurements is an upper bound."""
    ran = {g["stage"]: g["passed"] + g["failed"] + g["inconclusive"] for g in report.get("gates") or []}
    steps = [max(1, ran.get("structural", 0)), ran.get("nli_forward", 0) + ran.get("visual_grounding", 0), ran.get("symbolic", 0), ran.get("z3", 0)]
    return {name: min(1.0, there / before) if before and there else 1.0 for name, before, there in zip(("cheap", "model", "symbolic"), steps, steps[1:])}


def planned_verification(chunks: DataFrame, rates: dict[str, float], per_chunk: int = 3, samples: int = 0) -> DataFrame:
    """(source, calls): calls of the gates that ask a model, when the records thin out as an earlier run measured."""
    reach = F.count("*") * per_chunk * rates["cheap"]
    calls = reach * (3 + samples) + reach * rates["model"] * (1 + rates["symbolic"])
    return chunks.groupBy("source").agg(F.ceil(calls).alias("calls"))


def cost_plan(chunks: DataFrame, per_chunk: int = 3, cheap_pass: float = 0.8, samples: int = 0) -> DataFrame:
    """(stage, calls, tokens_in, tokens_out): planned model calls for each source and together, by stage, from chunk sizes."""
    size = T.token_estimate(F.col("text")).cast("bigint")
    per = chunks.groupBy("source").agg(F.count("*").alias("n"), F.sum(size).alias("tokens"), F.count_if(F.size(F.coalesce("figures", F.array().cast("array<string>"))) > 0).alias("figs"))
    mean = F.expr("tokens div n")
    stages = [("qa", F.col("n")), ("multiturn", F.least("n", F.lit(4))), ("react", F.least("n", F.lit(3))), ("figure_qa", F.col("figs")), ("verify", F.floor(F.col("n") * per_chunk * cheap_pass) * (3 + samples))]
    rows = per.select("source", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), c.cast("bigint").alias("calls"), (c * (mean + OVERHEAD)).cast("bigint").alias("tokens_in"), (c * REPLY[s]).cast("bigint").alias("tokens_out")) for s, c in stages])).alias("x")).select("source", "x.*")
    return rows.groupBy("stage").agg(F.sum("calls").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def grades(rows: DataFrame, answer: str, reference: str) -> DataFrame:
    """Adds f1 and numeric, the agreement of an answer with a reference in terms and in numbers."""
    a, r = F.col(answer), F.col(reference)
    return rows.withColumn("f1", F.round(T.term_f1(T.terms(a), T.terms(r)), 6)).withColumn("numeric", F.round(T.numeric_match(T.numbers(a), T.numbers(r)), 6))
