"""Records from chunks and graph seeds by model calls: prompt, complete, recover JSON, explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.model.client import Backend, completed

# How a rejected answer goes wrong.
REJECTIONS = ("number_hallucination", "unit_mismatch", "conflation", "overgeneralization", "stale_scope", "causal_inversion", "off_by_one", "unsupported_detail")
PERSONAS = ("neutral", "student", "practitioner", "reviewer", "manager", "journalist", "sceptic")
#: Characters of a context in one prompt: longer ones are asked about window by window, so none is cut off.
LONGEST = 9000


def prompt(task: str, rules: str, source: Column, *more: Column) -> Column:
    """TASK line, rules, further lines, and the source between markers."""
    return F.concat_ws("\n", F.lit(f"TASK: {task}\n{rules}"), *more, F.lit("<<<"), source, F.lit(">>>"))


def windowed(rows: DataFrame, longest: int = LONGEST) -> DataFrame:
    """The rows with `window`: the parts of their context that fit in a prompt, a row each; neighbours share a tenth."""
    step = longest - longest // 10
    n = F.greatest(F.ceil((F.length(T.text_of(F.col("context"))) - longest) / step) + 1, F.lit(1)).cast("int")
    at = F.explode(F.sequence(F.lit(0), n - 1)).alias("__at")
    return rows.select("*", at).withColumn("window", F.substr(T.text_of(F.col("context")), F.col("__at") * step + 1, F.lit(longest))).drop("__at")


def rows_of(reply: Column) -> Column:
    """The rows of a reply that holds a JSON array of questions and answers, in prose or a fenced block; none if it is broken."""
    kind = "array<struct<question:string,answer:string,hops:int>>"
    options = [F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1), reply, F.regexp_extract(reply, r"(?s)(\[.*\])", 1), F.concat(F.lit("["), F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit("]"))]
    parsed = F.coalesce(*[F.when(F.startswith(F.trim(x), F.lit("[")), F.from_json(x, kind)) for x in options])
    return F.filter(parsed, lambda r: (F.trim(T.text_of(r["question"])) != "") & (F.trim(T.text_of(r["answer"])) != ""))


def records_from(asked: DataFrame, task: str) -> DataFrame:
    """One record for each row of the replies; asked: id, source, sources, context, node_ids, breadcrumb, reply, ok."""
    rows = asked.where("ok").select("*", F.explode(rows_of(F.col("reply"))).alias("r"))
    prov = F.struct("source", "sources", "node_ids", "breadcrumb", F.lit(f"generate_{task}").alias("generator"))
    out = rows.select(T.record_id(F.col("source"), F.col("r.question"), F.col("r.answer"), None).alias("id"), F.col("r.question").alias("question"), F.col("r.answer").alias("answer"), "context", F.lit(task).alias("task"), F.lit("neutral").alias("persona"), F.coalesce("r.hops", F.lit(1)).alias("hops"), prov.alias("prov"))
    return out.dropDuplicates(["id"])


def chunk_inputs(chunks: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    refs = F.col("resolved_refs") if "resolved_refs" in chunks.columns else F.lit(None).cast("string")
    context = F.concat_ws("\n\n", "text", F.when(F.size(F.coalesce("tables", none)) > 0, F.array_join("tables", "\n")), F.when(refs != "", F.concat(F.lit("Resolved references:\n"), refs)))
    return chunks.select("id", "source", F.array("source").alias("sources"), context.alias("context"), F.coalesce("node_ids", none).alias("node_ids"), "breadcrumb")


def generate_qa(chunks: DataFrame, backend: Backend, per_chunk: int = 3) -> DataFrame:
    rows = windowed(chunk_inputs(chunks))
    text = prompt("qa", f"Write COUNT: {per_chunk} questions that the source answers, each with its answer from the source, as a JSON array of objects with question and answer.", F.col("window"))
    return records_from(completed(rows.withColumn("prompt", text), backend, temperature=0.8, json_reply=True), "qa")


def generate_pairs(pairs: DataFrame, found: DataFrame, chunks: DataFrame, backend: Backend, task: str = "multihop") -> DataFrame:
    """Records over two chunks, one for each end of a seed (a, b): the smallest chunk of a and the smallest other one of b,
    for cross_document seeds one of another source."""
    inputs = chunk_inputs(chunks).select("id", "source", "context", "breadcrumb", "node_ids")
    first = pairs.join(found.select(F.col("key").alias("a"), F.col("chunk_id").alias("ca")), "a").groupBy("a", "b").agg(F.min("ca").alias("ca"))
    x = first.join(inputs.withColumnsRenamed({"id": "ca", "source": "sx", "context": "cx", "breadcrumb": "bx", "node_ids": "nx"}), "ca")
    y = x.join(found.select(F.col("key").alias("b"), F.col("chunk_id").alias("cb")), "b").where("cb <> ca").join(inputs.withColumnsRenamed({"id": "cb", "source": "sy", "context": "cy", "breadcrumb": "by", "node_ids": "ny"}), "cb")
    if task == "cross_document":
        y = y.where("sy <> sx")
    best = y.groupBy("a", "b").agg(F.min(F.struct("cb", "ca", "sx", "sy", "cx", "cy", "bx", "nx", "ny")).alias("m")).select("a", "b", "m.*")
    context = F.concat_ws("\n\n", "cx", "cy")
    rows = best.select(F.concat_ws("+", "ca", "cb").alias("id"), F.col("sx").alias("source"), F.array_distinct(F.array("sx", "sy")).alias("sources"), context.alias("context"), F.array_distinct(F.concat("nx", "ny")).alias("node_ids"), F.col("bx").alias("breadcrumb"), "a", "b")
    text = prompt(task, "Write COUNT: 1 question that needs both parts of the source, with its answer, as a JSON array of objects with question, answer and hops.", F.col("context"), F.concat(F.lit("LINK: "), "a", F.lit(" / "), "b"))
    return records_from(completed(rows.withColumn("prompt", text).drop("a", "b"), backend, temperature=0.7), task)


def generate_dialogues(chunks: DataFrame, backend: Backend) -> DataFrame:
    """Multi-turn records; replies of fewer than two turns give nothing."""
    rows = windowed(chunk_inputs(chunks))
    text = prompt("multiturn", "Write a dialogue between a user and an assistant about the source, as a JSON array of objects with role and content.", F.col("window"))
    asked = completed(rows.withColumn("prompt", text), backend, temperature=0.8).where("ok")
    turns = F.from_json(F.regexp_extract("reply", r"(?s)(\[.*\])", 1), "array<struct<role:string,content:string>>")
    made = asked.withColumn("turns", turns).where("size(turns) >= 2")
    question = F.get("turns", F.lit(0))["content"]
    answer = F.element_at(F.filter("turns", lambda t: t["role"] == "assistant"), -1)["content"]
    prov = F.struct("source", "sources", "node_ids", "breadcrumb", F.lit("generate_multiturn").alias("generator"))
    return made.select(T.record_id(F.col("source"), question, answer, None).alias("id"), question.alias("question"), answer.alias("answer"), "context", F.lit("multiturn").alias("task"), F.lit("neutral").alias("persona"), F.lit(1).alias("hops"), "turns", prov.alias("prov")).where("answer is not null").dropDuplicates(["id"])


def chosen(key: Column, share: float, seed: int) -> Column:
    """Whether a hash of the key falls in the share: the same rows whatever the partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000


def preference_pairs(records: DataFrame, backend: Backend, share: float = 0.4, seed: int = 7) -> DataFrame:
    """Adds rejected and rejection_mode to a share of the records, the mode by hash."""
    mode = F.element_at(F.array(*[F.lit(m) for m in REJECTIONS]), (F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(len(REJECTIONS))) + 1).cast("int"))
    some = records.where(chosen(F.col("id"), share, seed)).select("id", mode.alias("rejection_mode"), prompt("reject", "Write an answer that is wrong in the given way but sounds right.", F.col("context"), F.concat(F.lit("MODE: "), mode), F.concat(F.lit("ANSWER: "), F.regexp_replace("answer", r"\s+", " "))).alias("prompt"))
    made = completed(some, backend, temperature=0.8).where("ok and trim(reply) <> ''").select("id", F.col("reply").alias("rejected"), "rejection_mode")
    return records.drop("rejected", "rejection_mode").join(made, "id", "left")


def persona_rewrites(records: DataFrame, backend: Backend, share: float = 0.3, seed: int = 7) -> DataFrame:
    """New records: a share of the questions in the words of a persona, drawn by hash."""
    persona = F.element_at(F.array(*[F.lit(p) for p in PERSONAS]), (F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(len(PERSONAS))) + 1).cast("int"))
    some = records.where(chosen(F.col("id"), share, seed + 3)).withColumn("persona", persona)
    text = prompt("rewrite", "Say the question as this person would, with the same meaning.", F.col("context"), F.concat(F.lit("PERSONA: "), "persona"), F.concat(F.lit("QUESTION: "), F.regexp_replace("question", r"\s+", " ")))
    made = completed(some.withColumn("prompt", text), backend, temperature=0.9).where("ok and trim(reply) <> ''")
    out = made.withColumn("question", F.col("reply")).withColumn("id", T.record_id(F.col("prov.source"), F.col("reply"), F.col("answer"), None))
    return out.select(*records.columns)


def one_object(reply: Column, kind: str) -> Column:
    """The object of a reply: fenced, whole, or between its outermost braces; null if there is none."""
    options = [F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1), reply, F.regexp_extract(reply, r"(?s)(\{.*\})", 1)]
    return F.coalesce(*[F.when(F.startswith(F.trim(x), F.lit("{")), F.from_json(x, kind)) for x in options])


GRIDS, TRACE_STEP = "array<array<array<string>>>", "struct<thought:string,action:string,action_input:string,observation:string>"


def table_registry(chunks: DataFrame) -> DataFrame:
    """(id, grids, captions): for each chunk the tables of its document, its own first; tables with an equal header count once,
    the first of them. The tables of a document are collected once, for its chunks that have any themselves or not."""
    none = F.array().cast("array<string>")
    own = chunks.select("id", "doc_id", F.coalesce("grids", F.array().cast(GRIDS)).alias("grids"), F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb"))
    flat = own.select("doc_id", "id", "breadcrumb", F.posexplode("grids").alias("n", "grid"))
    heads = flat.groupBy("doc_id", F.to_json(F.get("grid", F.lit(0))).alias("head")).agg(F.min(F.struct("id", "n", "grid", "breadcrumb")).alias("t"))
    per = heads.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t.id", "t.n", "t.grid", "t.breadcrumb"))), lambda t: F.struct(t["grid"].alias("grid"), t["breadcrumb"].alias("caption"))).alias("all"))
    mine = F.transform("grids", lambda g: F.struct(g.alias("grid"), F.col("breadcrumb").alias("caption")))
    heads_of = F.transform("grids", lambda g: F.to_json(F.get(g, F.lit(0))))
    rest = F.filter(F.coalesce("all", F.array().cast(f"array<struct<grid:array<array<string>>,caption:string>>")), lambda t: ~F.array_contains(F.col("heads"), F.to_json(F.get(t["grid"], F.lit(0)))))
    rows = own.withColumn("mine", mine).withColumn("heads", heads_of).join(per, "doc_id", "left").withColumn("tables", F.concat("mine", rest))
    return rows.select("id", F.transform("tables", lambda t: t["grid"]).alias("grids"), F.transform("tables", lambda t: F.coalesce(t["caption"], F.lit(""))).alias("captions")).withColumn("captions", F.coalesce("captions", none))


def schema_text(grids: Column, captions: Column) -> Column:
    """A line a table: its header and caption; tables are named t, t2, t3 and so on."""
    name = lambda i: F.when(i == 0, "t").otherwise(F.concat(F.lit("t"), (i + 1).cast("string")))
    return F.array_join(F.transform(grids, lambda g, i: F.concat(name(i), F.lit("("), F.array_join(F.get(g, F.lit(0)), ", "), F.lit(") -- "), F.coalesce(F.get(captions, i), F.lit("")))), "\n")


def generate_react(chunks: DataFrame, backend: Backend) -> DataFrame:
    """Records with a tool trace over the document's tables; replies without a question or without a step give nothing."""
    rows = chunk_inputs(chunks).join(table_registry(chunks), "id")
    text = prompt("react", "Write a question that takes tools to answer, its answer and the trace, as a JSON object with question, answer and trace: a list of thought, action (sql, python or lookup), action_input and observation.", F.col("context"), F.concat(F.lit("TABLES:\n"), schema_text(F.col("grids"), F.col("captions"))))
    asked = completed(rows.withColumn("prompt", text), backend, temperature=0.7, most=2500, json_reply=True).where("ok")
    got = asked.withColumn("r", one_object(F.col("reply"), f"question string, answer string, trace array<{TRACE_STEP}>"))
    steps = F.filter("r.trace", lambda s: T.text_of(s["action"]) != "")
    trace = F.transform(steps, lambda s: F.struct(s["thought"].alias("thought"), s["action"].alias("action"), s["action_input"].alias("action_input"), s["observation"].alias("observation"), F.lit(None).cast("string").alias("executed_observation"), F.lit(None).cast("boolean").alias("executed_ok")))
    made = got.withColumn("tool_trace", trace).where("trim(coalesce(r.question, '')) <> '' and size(tool_trace) > 0")
    prov = F.struct("source", "sources", "node_ids", "breadcrumb", F.lit("generate_react").alias("generator"))
    question, answer = F.trim("r.question"), F.trim(T.text_of(F.col("r.answer")))
    return made.select(T.record_id(F.col("source"), question, answer, None).alias("id"), question.alias("question"), answer.alias("answer"), "context", F.lit("react").alias("task"), F.lit("neutral").alias("persona"), F.lit("complex").alias("difficulty"), F.lit(1).alias("hops"), "tool_trace", F.struct("grids", "captions").alias("tool_env"), prov.alias("prov")).dropDuplicates(["id"])


def generate_figure_qa(chunks: DataFrame, figures: DataFrame, backend: Backend, per_figure: int = 2) -> DataFrame:
    """Records about pictures. figures: (chunk_id, node_id, image_path, caption, bbox); each goes to the model with its caption and
    the chunk's text. Figures without a picture give nothing; calls that fail give nothing."""
    rows = figures.where("image_path <> ''").join(chunks.select(F.col("id").alias("chunk_id"), "source", "text", F.coalesce("node_ids", F.array().cast("array<string>")).alias("own"), "breadcrumb"), "chunk_id")
    caption = F.coalesce(F.when(F.trim("caption") != "", F.col("caption")), F.lit("(no caption)"))
    text = prompt("figure_qa", f"Write COUNT: {per_figure} questions that the picture answers, as a JSON array of objects with question and answer.", F.concat_ws("\n\n", caption, "text"))
    inputs = rows.select(F.concat_ws("/", "chunk_id", "node_id").alias("id"), "source", F.array("source").alias("sources"), F.trim(F.concat_ws("\n\n", "caption", "text")).alias("context"), F.array_distinct(F.concat("own", F.array("node_id"))).alias("node_ids"), "breadcrumb", F.array("image_path").alias("images"), F.when(F.col("bbox").isNotNull(), F.array("bbox")).otherwise(F.array().cast("array<array<double>>")).alias("bboxes"), text.alias("prompt"))
    asked = completed(inputs, backend, temperature=0.7, most=1800, role="vision", images="images", json_reply=True).where("ok")
    got = asked.select("*", F.explode(rows_of(F.col("reply"))).alias("r"))
    prov = F.struct("source", "sources", "node_ids", "bboxes", "breadcrumb", F.lit("generate_figure_qa").alias("generator"))
    return got.select(T.record_id(F.col("source"), F.col("r.question"), F.col("r.answer"), None).alias("id"), F.trim("r.question").alias("question"), F.trim("r.answer").alias("answer"), "context", F.lit("figure_qa").alias("task"), F.lit("neutral").alias("persona"), F.lit("intermediate").alias("difficulty"), F.lit(1).alias("hops"), "images", prov.alias("prov")).dropDuplicates(["id"])


# Ways of making a question harder.
MUTATIONS = ("add_constraint", "counterfactual", "deepen_math", "implicit", "comparative", "multi_part", "adversarial_premise")


def evolved(records: DataFrame, backend: Backend, share: float = 0.2, seed: int = 7) -> DataFrame:
    """New records: a share of the questions made harder, the way by hash. Replies that say the change doesn't apply, or that lack
    a question or an answer, give nothing. Difficulty is complex, and the generator names the way."""
    way = F.element_at(F.array(*[F.lit(m) for m in MUTATIONS]), (F.pmod(F.xxhash64("id", F.lit(seed + 4)), F.lit(len(MUTATIONS))) + 1).cast("int"))
    some = records.where(chosen(F.col("id"), share, seed + 5)).withColumn("__way", way)
    text = prompt("evolve", "Make the question harder in the given way, still answered by the source, as a JSON object with applied, question and answer.", F.col("context"), F.concat(F.lit("MUTATION: "), "__way"), F.concat(F.lit("QUESTION: "), F.regexp_replace("question", r"\s+", " ")), F.concat(F.lit("ANSWER: "), F.regexp_replace("answer", r"\s+", " ")))
    asked = completed(some.withColumn("prompt", text), backend, temperature=0.9, most=1800, json_reply=True).where("ok")
    got = asked.withColumn("__r", one_object(F.col("reply"), "applied boolean, question string, answer string"))
    kept = got.where("coalesce(__r.applied, true) and trim(coalesce(__r.question, '')) <> '' and trim(coalesce(__r.answer, '')) <> ''")
    out = kept.withColumn("question", F.trim("__r.question")).withColumn("answer", F.trim("__r.answer")).withColumn("difficulty", F.lit("complex")).withColumn("prov", F.col("prov").withField("generator", F.concat(F.lit("evolve:"), "__way")))
    return out.withColumn("id", T.record_id(F.col("prov.source"), F.col("question"), F.col("answer"), None)).select(*records.columns)
