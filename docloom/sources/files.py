"""Reading document files into node tables, and exported corpora, datasets and questions into frames."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources.builder import NODE_SCHEMA
from docloom.sources.parsers import PARSERS

RECORD_SCHEMA = (
    "id string, question string, answer string, context string, task string, persona string, difficulty string, hops int, turns array<struct<role:string,content:string>>, rejected string, rejection_mode string, "
    "tool_trace array<struct<thought:string,action:string,action_input:string,observation:string,executed_observation:string,executed_ok:boolean>>, tool_env struct<grids:array<array<array<string>>>,captions:array<string>>, "
    "images array<string>, scores map<string,double>, flags array<string>, prov struct<source:string,sources:array<string>,node_ids:array<string>,pages:array<int>,anchors:array<string>,bboxes:array<array<double>>,"
    "section_path array<string>,breadcrumb:string,generator:string,generated_at:double,verification:array<struct<stage:string,passed:boolean,score:double,detail:string,inconclusive:boolean>>>"
).replace("section_path array<string>", "section_path:array<string>")
PASSAGE_SCHEMA = "id string, text string, body string, source string, breadcrumb string, pages array<int>, anchors array<string>, node_ids array<string>, images array<string>, tables array<string>, equations array<string>"


def read_documents(spark: SparkSession, path: str, parsers: dict[str, Callable] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, skipped) of all supported files under a path or glob. skipped: (path, reason), one row a file that can't be read.

    Files of zero bytes are passed over by Spark's file index; blank ones are skipped with a reason. A file is one row of the binary source and is parsed in one piece; the document's id is a hash of its path, its source the
    file name. Own parsers, by suffix, come before the built-in ones.
    """
    known = PARSERS | (parsers or {})
    globbed = "{" + ",".join(f"*{s}" for s in sorted(known)) + "}"
    reader = spark.read.format("binaryFile")
    reader = reader if any(c in path for c in "*?[") else reader.option("recursiveFileLookup", "true").option("pathGlobFilter", globbed)
    files = reader.load(path).select("path", "content")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for place, content in zip(frame["path"], frame["content"]):
                rows = parse_file(place, bytes(content), known)
                # Columns of objects: in a mixed frame missing arrays would become numbers.
                yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in [*COLUMNS, "path", "reason"]})

    parsed = files.mapInPandas(work, f"{NODE_SCHEMA}, path string, reason string")
    return parsed.where("reason is null").drop("path", "reason"), parsed.where("reason is not null").select("path", "reason")


COLUMNS = [part.strip().split(" ")[0] for part in "doc_id, ord, parent_ord, node_id, kind, text, level, page, bbox, anchor, caption, tbl, equation, figure, breadcrumb".split(",")]


def parse_file(path: str, content: bytes, known: dict[str, Callable] = PARSERS) -> list[dict]:
    """Rows of one file; what goes wrong is a row with a reason."""
    import hashlib

    source = os.path.basename(path)
    parser = known.get(os.path.splitext(source)[1].lower())
    doc_id = hashlib.sha1(path.encode()).hexdigest()[:16]
    try:
        if parser is None:
            raise ValueError(f"unknown suffix; supported are {', '.join(sorted(known))}")
        if not content.strip():
            raise ValueError("the file is empty")
        rows = parser(content, doc_id, source)
        if not any((r.get("text") or "").strip() for r in rows[1:]):
            raise ValueError("the file has no text")
        return [r | {"path": path, "reason": None} for r in rows]
    except Exception as error:  # noqa: BLE001 - any parser, also a plugin's, may fail on a broken file
        return [{"path": path, "reason": f"{type(error).__name__}: {error}"[:300]}]


def under(df: DataFrame, name: str) -> DataFrame:
    """Rows of files with the name, or below a folder with it, as Spark writes one; other files are pruned before they are read."""
    return df.where(F.col("_metadata.file_path").rlike(f"/{name}(/|$)"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Passages of exported corpora: every corpus.jsonl below the path."""
    return under(spark.read.schema(PASSAGE_SCHEMA).option("recursiveFileLookup", "true").json(path), r"corpus\.jsonl")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Records of raw exports, with all fields."""
    return under(spark.read.schema(RECORD_SCHEMA).option("recursiveFileLookup", "true").json(path), r"raw\.jsonl")


def questions_of(lines: DataFrame, column: str = "value") -> DataFrame:
    """(question): the question in each JSON line, whatever format it was exported in; malformed lines give nothing."""
    v = F.try_parse_json(F.col(column))
    text = lambda path: F.try_variant_get(v, path, "string")
    kind = F.schema_of_variant(v)
    turns = F.from_json(F.when(F.startswith(kind, F.lit("OBJECT")), F.col(column)), "messages array<struct<role:string,`from`:string,content:string,value:string>>, conversations array<struct<role:string,`from`:string,content:string,value:string>>")
    all_ = F.concat(F.coalesce(turns["messages"], F.array().cast("array<struct<role:string,from:string,content:string,value:string>>")), F.coalesce(turns["conversations"], F.array().cast("array<struct<role:string,from:string,content:string,value:string>>")))
    asked = F.get(F.filter(all_, lambda t: t["role"].isin("user") | t["from"].isin("human", "user")), F.lit(0))
    said = F.coalesce(asked["content"], asked["value"])
    # A list of parts comes as JSON text: its first text part counts.
    part = F.coalesce(*[F.when(F.try_variant_get(F.try_parse_json(said), f"$[{i}].type", "string") == "text", F.try_variant_get(F.try_parse_json(said), f"$[{i}].text", "string")) for i in range(4)])
    said = F.when(F.startswith(F.trim(said), F.lit("[")) & part.isNotNull(), part).otherwise(said)
    filled = lambda c: F.when(F.trim(T.text_of(c)) != "", c)
    question = F.coalesce(filled(text("$.question")), filled(text("$.prompt")), filled(text("$.instruction")), filled(said))
    return lines.select(question.alias("question")).where("question is not null")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return questions_of(under(spark.read.option("recursiveFileLookup", "true").text(path), r"[^/]*\.jsonl"))
