"""The whole run: files -> trees -> chunks -> graph -> records -> gates -> selection -> export. Every stage is a table."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import registry
from docloom.cache import Cache, content_fingerprint, fingerprint
from docloom.config import Config
from docloom.functions import text as T
from docloom.model import judges, synth
from docloom.model.client import Backend, Offline
from docloom.model.runtime import BudgetExceeded, Runtime
from docloom.operators import audit, choose, dedup, gates, graph, tree, vectors
from docloom.session import cut
from docloom.sources import files, formats
from docloom.tools import replay

log = logging.getLogger("docloom")
TURNS = "array<struct<role:string,content:string>>"
TRACE = "array<struct<thought:string,action:string,action_input:string,observation:string,executed_observation:string,executed_ok:boolean>>"
PROV = "struct<source:string,sources:array<string>,node_ids:array<string>,pages:array<int>,anchors:array<string>,bboxes:array<array<double>>,section_path:array<string>,breadcrumb:string,generator:string,generated_at:double,verification:array<struct<stage:string,passed:boolean,score:double,detail:string,inconclusive:boolean>>>"


def chunks_of(nodes: DataFrame, most: int = 900, least: int = 60) -> DataFrame:
    """Chunks of document trees: blocks packed along sections, with the breadcrumb before the text, what the blocks hold and what they refer to."""
    packed = tree.pack_sections(nodes, most, least)
    blocks = nodes.where(~F.col("kind").isin("heading", "document")).withColumn("section", F.coalesce("parent_ord", F.lit(-1)))
    inside = blocks.join(packed.select("doc_id", "section", "chunk", "first_ord", "last_ord"), ["doc_id", "section"]).where("ord between first_ord and last_ord")
    label = F.concat(F.lit("["), "node_id", F.lit("] "))
    shown = F.when(F.col("kind") == "table", F.concat(label, T.text_of(F.col("caption")), F.lit("\n"), T.text_of(F.col("text")))).when(F.col("kind") == "equation", F.concat(label, T.text_of(F.col("text")))).otherwise(T.text_of(F.col("text")))
    inside = inside.join(tree.resolved_bodies(nodes), ["doc_id", "ord"], "left")
    parts = inside.groupBy("doc_id", "section", "chunk").agg(F.array_sort(F.collect_list(F.struct("ord", shown.alias("t"), "kind", "node_id", "page", "anchor", "bbox", "tbl", F.col("equation.latex").alias("latex"), "breadcrumb", "refs"))).alias("b"))
    names = nodes.where("kind = 'document'").select("doc_id", F.col("text").alias("title"))
    heads = nodes.where("kind in ('heading', 'document')").select("doc_id", F.col("ord").alias("section"), F.col("text").alias("own"))
    rows = parts.join(heads, ["doc_id", "section"], "left").join(names, "doc_id", "left")
    trail = F.filter(F.get("b", F.lit(0))["breadcrumb"], lambda t: T.text_of(t) != "")
    rows = rows.withColumn("section_path", F.when(F.size(trail) > 0, trail).otherwise(F.array(F.coalesce("title", F.lit("Document"))))).withColumn("breadcrumb", F.array_join("section_path", " > "))
    body = F.array_join(F.filter(F.transform("b", lambda x: F.trim(x["t"])), lambda t: t != ""), "\n\n")
    text = F.concat_ws("\n\n", F.when(F.col("breadcrumb") != "", F.col("breadcrumb")), body)
    held = lambda kind, get: F.filter(F.transform(F.filter("b", lambda x: x["kind"] == kind), get), lambda v: v.isNotNull())
    refs = F.array_distinct(F.flatten(F.filter(F.transform("b", lambda x: x["refs"]), lambda r: r.isNotNull())))
    return rows.select(
        T.chunk_id(F.col("doc_id"), text, None).alias("id"), "doc_id", text.alias("text"), F.when((F.size("b") == 1) & (F.get("b", F.lit(0))["kind"] == "table"), "table").otherwise("section").alias("kind"),
        F.col("doc_id").alias("source"), "breadcrumb", "section_path", F.transform("b", lambda x: x["node_id"]).alias("node_ids"), F.array_sort(F.array_distinct(F.filter(F.transform("b", lambda x: x["page"]), lambda p: p.isNotNull()))).alias("pages"),
        F.transform("b", lambda x: x["anchor"]).alias("anchors"), F.filter(F.transform("b", lambda x: x["bbox"]), lambda x: x.isNotNull()).alias("bboxes"), held("table", lambda x: x["tbl"]["html"]).alias("tables"), held("table", lambda x: x["tbl"]["grid"]).alias("grids"), held("equation", lambda x: x["latex"]).alias("equations"),
        held("figure", lambda x: x["node_id"]).alias("figures"), F.when(F.size(refs) > 0, F.array_join(refs, "\n")).alias("resolved_refs"), T.token_estimate(text).alias("tokens"),
    )


def whole_record(records: DataFrame) -> DataFrame:
    """Every column of a record, with defaults where a generator gave none."""
    have = set(records.columns)
    prov = records.schema["prov"].dataType.fieldNames()
    full = F.struct(*[F.col(f"prov.{n}") if n in prov else F.lit(None).cast(k).alias(n) for n, k in [("source", "string"), ("sources", "array<string>"), ("node_ids", "array<string>"), ("pages", "array<int>"), ("anchors", "array<string>"), ("bboxes", "array<array<double>>"), ("section_path", "array<string>"), ("breadcrumb", "string"), ("generator", "string"), ("generated_at", "double"), ("verification", f"array<{gates.GATE}>")]])
    rows = records.withColumn("prov", full.cast(PROV))
    for name, kind in {"turns": TURNS, "rejected": "string", "rejection_mode": "string", "tool_trace": TRACE, "tool_env": "struct<grids:array<array<array<string>>>,captions:array<string>>", "images": "array<string>", "scores": "map<string,double>", "flags": "array<string>", "difficulty": "string"}.items():
        if name not in have:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    order = ["id", "question", "answer", "context", "task", "persona", "difficulty", "hops", "turns", "rejected", "rejection_mode", "tool_trace", "tool_env", "images", "scores", "flags", "prov"]
    return rows.select(*order)


def figures_of(nodes: DataFrame | None, chunks: DataFrame) -> DataFrame:
    """(chunk_id, node_id, image_path, caption, bbox): the figures of the chunks that have a picture."""
    if nodes is None:
        return chunks.sparkSession.createDataFrame([], "chunk_id string, node_id string, image_path string, caption string, bbox array<double>")
    own = chunks.select(F.col("id").alias("chunk_id"), "doc_id", F.explode(F.coalesce("figures", F.array().cast("array<string>"))).alias("node_id"))
    shown = nodes.where("kind = 'figure' and figure.src is not null").select("doc_id", "node_id", F.col("figure.src").alias("image_path"), F.coalesce("caption", "text", F.lit("")).alias("caption"), "bbox")
    return own.join(shown, ["doc_id", "node_id"]).drop("doc_id")


class Pipeline:
    """Runs the stages in order; each is cut, so that a lost executor or a second use never repeats model calls."""

    def __init__(self, spark: SparkSession, config: Config | None = None, backend: Backend | None = None) -> None:
        self.spark, self.config = spark, (config or Config()).validate()
        self.backend = backend if isinstance(backend, Runtime) else Runtime.on(spark, backend or Offline(), self.config.token_budget or None)
        registry.load_plugins(self.config.plugins, spark)
        self.cache = Cache(spark, self.config.cache) if self.config.cache else None
        self.report: dict = {}

    def stage(self, name: str, key: list, make) -> DataFrame:
        log.info("stage %s", name)
        self.spark.sparkContext.setJobDescription(f"docloom {name}")
        return self.cache.memoize(name, fingerprint(name, key), make) if self.cache else cut(make())

    def parse(self, path: str) -> tuple[DataFrame, DataFrame]:
        nodes, skipped = files.read_documents(self.spark, path, registry.PARSERS)
        # Both come from one pass over the files: parse once, then tell them apart.
        none = F.lit(None).cast("string")
        left = nodes.select(F.struct(*nodes.columns).alias("n"), none.alias("path"), none.alias("reason"))
        right = skipped.select(F.lit(None).cast(left.schema["n"].dataType).alias("n"), "path", "reason")
        both = cut(left.unionByName(right))
        return both.where("n is not null").select("n.*"), both.where("reason is not null").select("path", "reason")

    def chunk(self, nodes: DataFrame) -> DataFrame:
        c = self.config.chunking
        made = self.stage("chunks", ["refs", content_fingerprint(nodes.select("doc_id", "ord", "kind", "text", "caption", "tbl.html", "equation.number")), asdict(c)], lambda: chunks_of(nodes, c.max_tokens, c.min_tokens).dropDuplicates(["id"]))
        kept = dedup.lexical_dedup(made, "id", "text", "id", c.dedup_threshold).where("kept").select("id")
        return cut(made.join(kept, "id", "left_semi"))

    def repaired(self, records: DataFrame) -> DataFrame:
        """Traces whose claims are what the tools really give."""
        records = cut(records)
        fixed = replay.repair_traces(records, self.config.verification.allow_python).select("id", F.col("tool_trace").alias("fixed"))
        return records.join(fixed, "id", "left").withColumn("tool_trace", F.coalesce("fixed", "tool_trace")).drop("fixed")

    def synthesise(self, chunks: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
        g = self.config.generation
        found, known, edges = graph.build(chunks)
        makers = {
            "qa": lambda: synth.generate_qa(chunks, self.backend, g.qa_per_chunk),
            "multihop": lambda: synth.generate_pairs(graph.bridging_pairs(found, known, edges, g.multihop_pairs), found, chunks, self.backend, "multihop"),
            "cross_document": lambda: synth.generate_pairs(graph.cross_document(found, known, edges, g.cross_document_pairs), found, chunks, self.backend, "cross_document"),
            "multiturn": lambda: synth.generate_dialogues(chunks, self.backend),
            "react": lambda: self.repaired(synth.generate_react(chunks, self.backend)),
            "figure_qa": lambda: synth.generate_figure_qa(chunks, figures_of(nodes, chunks), self.backend),
        }
        parts, errors = [], {}
        key = content_fingerprint(chunks.select("id", "text", "resolved_refs"))
        for task in g.tasks:
            make = makers.get(task) or (lambda f=registry.TASKS.get(task): f(self.spark, chunks, found, known, edges, self.backend) if f else None)
            if task not in makers and task not in registry.TASKS:
                raise ValueError(f"unknown task {task!r}; choose from {sorted({*makers, *registry.TASKS})}")
            try:
                parts.append(self.stage(f"synth_{task}", [key, asdict(g), repr(self.backend)], lambda: whole_record(make())))
            except BudgetExceeded:
                raise
            except Exception as error:  # noqa: BLE001 - a failing plugin task is counted, the others go on
                errors[task] = str(error)[:200]
        self.report["errors"] = errors
        if not parts:
            raise ValueError(f"no task gave records: {errors}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.dropDuplicates(["id"])
        more = synth.persona_rewrites(out, self.backend, g.persona_share, self.config.seed)
        if g.evolve_share > 0:
            more = more.unionByName(synth.evolved(out, self.backend, g.evolve_share, self.config.seed))
        out = cut(out.unionByName(more).dropDuplicates(["id"]))
        return cut(whole_record(synth.preference_pairs(out, self.backend, g.preference_share, self.config.seed)))

    def verify(self, records: DataFrame) -> DataFrame:
        """Traces are run again, then the gates without a model; the model sees only what they let through."""
        v = self.config.verification
        checked = cut(gates.cheap_gates(cut(replay.trace_gates(records, v.allow_python))))
        kind = f"array<{gates.GATE}>"
        rows = cut(judges.verified(checked, self.backend, v.samples, v.symbolic, v.allow_python, cut))
        log_ = F.col("gates").cast(kind)
        rows = rows.withColumn("scores", F.map_concat(F.map_from_entries(F.transform("gates", lambda g: F.struct(g["stage"], F.round(g["score"], 4)))), F.create_map(F.lit("quality"), gates.quality_score(F.col("gates")))))
        rows = rows.withColumn("flags", gates.verdict_flags(F.col("gates"))).withColumn("prov", F.col("prov").withField("verification", log_))
        hard = gates.hardness(rows).select("id", "bucket")
        return cut(rows.drop("gates", "difficulty").join(hard.withColumnRenamed("bucket", "difficulty"), "id").select(*records.columns))

    def select(self, records: DataFrame) -> DataFrame:
        s = self.config.selection
        good = cut(records.where(~F.exists("flags", lambda f: F.startswith(f, F.lit("reject:"))) & (F.coalesce(F.try_element_at("scores", F.lit("quality")), F.lit(0.0)) >= s.min_quality)))
        for path in self.config.against:
            known = files.read_questions(self.spark, path)
            fresh = dedup.new_rows(good.select("id", "question"), known.withColumnRenamed("question", "known"), "id", "question", "known", s.lexical_threshold)
            good = cut(good.join(fresh.select("id"), "id", "left_semi"))
        kept = dedup.lexical_dedup(good, "id", "question", "id", s.lexical_threshold).where("kept").select("id")
        rows = cut(good.join(kept, "id", "left_semi"))
        texts = rows.select("id", F.concat_ws("\n", "question", "answer").alias("t"))
        q = rows.select("id", F.coalesce(F.try_element_at("scores", F.lit("quality")), F.lit(0.0)).alias("quality"))
        embedded = cut(vectors.hashed_embedding(texts, "id", "t").join(q, "id"))
        kept = vectors.semantic_dedup(embedded, "id", "vector", "quality", s.semantic_threshold).where("kept").select("id")
        rows = cut(rows.join(kept, "id", "left_semi"))
        if s.balance:
            picked = choose.balance(rows.select("id", F.col("difficulty").alias("bucket")).join(q, "id")).select("id")
            rows = rows.join(picked, "id", "left_semi")
        return cut(rows)

    def run(self, path: str, out: str) -> dict:
        nodes, skipped = self.parse(path)
        # The report names the first thousand; the file has them all.
        self.report |= {"skipped": [r.asDict() for r in skipped.limit(1000).collect()], "skipped_files": skipped.count()}
        skipped.write.mode("overwrite").json(f"{out}/skipped.jsonl")
        chunks = self.chunk(nodes)
        made = self.synthesise(chunks, nodes)
        checked = self.verify(made)
        final = self.select(checked)
        if final.isEmpty():
            raise ValueError("no record passed")
        formats.write_formats(final, out, self.config.formats, custom=registry.FORMATS)
        formats.formatted(formats.corpus(chunks), "raw").write.mode("overwrite").text(f"{out}/corpus.jsonl")
        splits = choose.split_by_source(final.select("id", F.col("prov.source").alias("source")), "id", "source", seed=self.config.seed)
        formats.write_splits(final, splits, f"{out}/splits", self.config.formats)
        self.report |= {
            "documents": nodes.select("doc_id").distinct().count(), "chunks": chunks.count(), "generated": made.count(), "final": final.count(),
            "gates": [r.asDict() for r in audit.gate_counts(checked).orderBy("stage").collect()], "yield": [r.asDict() for r in audit.yields(checked).orderBy("task").collect()],
            "rejections": [r.asDict() for r in audit.rejections(checked).orderBy("reason").collect()], "cache": self.cache.stats() if self.cache else {}, "health": self.backend.health(),
        }
        text = self.spark.createDataFrame([(json.dumps(self.report, ensure_ascii=False),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{out}/report.json")
        self.spark.createDataFrame([(formats.dataset_card(final),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/card.md")
        return self.report
