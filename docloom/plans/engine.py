"""Queries of the tools, formats, parsers, equations and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.cache import row_fingerprint
from docloom.functions.latex import validate
from docloom.operators import geometry
from docloom.plans import dialect as D
from docloom.plans.registry import query
from docloom.plans.text import chunks, records
from docloom.plans.trees import nodes
from docloom.session import table
from docloom.sources import formats
from docloom.sources.builder import Builder
from docloom.sources.parsers import feed_html
from docloom.streaming import incremental
from docloom.tools import replay, sqltool

# Messages are compared by role and by content.
MESSAGES = "CASE WHEN len(turns) > 0 THEN turns ELSE [{'role': 'user', 'content': question}, {'role': 'assistant', 'content': answer}] END"


def joined(df: DataFrame, array: str, field: str, name: str) -> "F.Column":
    return F.array_join(F.transform(array, lambda m: F.coalesce(m[field], F.lit(""))), "\x1f").alias(name)


@query(f"WITH {D.RECORDS}, x AS (SELECT id, list_concat([{{'role': 'system', 'content': '{formats.SYSTEM}'}}], {MESSAGES}) AS m FROM r) SELECT id, array_to_string(list_transform(m, lambda t: coalesce(t.role, '')), chr(31)) AS roles, array_to_string(list_transform(m, lambda t: coalesce(t.content, '')), chr(31)) AS contents FROM x")
def export_chatml(spark: SparkSession, d: str) -> DataFrame:
    rows = formats.chatml(records(spark, d, "turns", "question", "answer"))
    return rows.select("id", joined(rows, "row.messages", "role", "roles"), joined(rows, "row.messages", "content", "contents"))


@query(f"WITH {D.RECORDS}, x AS (SELECT id, {MESSAGES} AS m FROM r) SELECT id, array_to_string(list_transform(m, lambda t: CASE t.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE coalesce(t.role, '') END), chr(31)) AS speakers, array_to_string(list_transform(m, lambda t: coalesce(t.content, '')), chr(31)) AS contents FROM x")
def export_sharegpt(spark: SparkSession, d: str) -> DataFrame:
    rows = formats.sharegpt(records(spark, d, "turns", "question", "answer"))
    return rows.select("id", joined(rows, "row.conversations", "from", "speakers"), joined(rows, "row.conversations", "value", "contents"))


@query(f"WITH {D.RECORDS} SELECT id, question AS instruction, context AS input, answer AS output FROM r")
def export_alpaca(spark: SparkSession, d: str) -> DataFrame:
    return formats.alpaca(records(spark, d, "question", "context", "answer")).select("id", "row.instruction", "row.input", "row.output")


@query(f"WITH {D.RECORDS} SELECT id, question AS prompt, '{formats.SYSTEM}' AS system, answer AS chosen, rejected, rejection_mode FROM r WHERE coalesce(rejected, '') <> ''")
def export_dpo(spark: SparkSession, d: str) -> DataFrame:
    return formats.dpo(records(spark, d, "question", "answer", "rejected", "rejection_mode")).select("id", "row.*")


@query(f"WITH {D.RECORDS} SELECT id, question, answer, len(tool_trace) AS steps, array_to_string(list_transform(tool_trace, lambda s: coalesce(s.action, '') || ':' || coalesce(s.action_input, '') || ':' || coalesce(s.observation, '') || ':' || coalesce(s.executed_ok, false)::VARCHAR), chr(31)) AS trace FROM r WHERE len(tool_trace) > 0")
def export_react(spark: SparkSession, d: str) -> DataFrame:
    rows = formats.react(records(spark, d, "question", "answer", "tool_trace", "tool_env"))
    text = lambda c: F.coalesce(c, F.lit(""))
    step = F.transform("row.trace", lambda s: F.concat_ws(":", text(s["action"]), text(s["action_input"]), text(s["observation"]), s["verified"].cast("string")))
    return rows.select("id", "row.question", "row.answer", F.size("row.trace").alias("steps"), F.array_join(step, "\x1f").alias("trace"))


@query(f"WITH {D.RECORDS} SELECT id, len(images) AS n_images, images[1] AS first_image FROM r WHERE len(images) > 0")
def export_multimodal(spark: SparkSession, d: str) -> DataFrame:
    rows = formats.multimodal(records(spark, d, "images", "question", "answer"))
    return rows.select("id", F.size("row.images").alias("n_images"), F.get("row.images", F.lit(0)).alias("first_image"))


@query(f"WITH {D.RECORDS} SELECT id, task, persona, difficulty, hops, coalesce(scores['quality'], 0.0) AS quality, prov.source AS source, array_to_string(prov.node_ids, ',') AS node_ids, prov.breadcrumb AS breadcrumb FROM r")
def export_meta(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "images", "task", "persona", "difficulty", "hops", "scores", "prov")
    m = rows.select(formats.meta(rows).alias("m")).select("m.*")
    return m.select("id", "task", "persona", "difficulty", "hops", "quality", "source", F.array_join("node_ids", ",").alias("node_ids"), "breadcrumb")


@query()
def export_lines(spark: SparkSession, d: str) -> DataFrame:
    """The JSON lines of the chat format as they are written."""
    return formats.formatted(records(spark, d), "chatml")


TOOL_AGG = "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"
TOOL_JOIN = "SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment"
TOOL_WINDOW = "SELECT l_suppkey, l_orderkey, l_linenumber, rn FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) x WHERE rn <= 3"
TOOL_ANTI = "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 150000)"


def tool(spark: SparkSession, d: str, sql: str, *tables: str) -> DataFrame:
    for t in tables:
        table(spark, d, t).createOrReplaceTempView(t)
    return sqltool.query(spark, sql)


@query(TOOL_AGG)
def sql_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return tool(spark, d, TOOL_AGG, "lineitem")


@query(TOOL_JOIN)
def sql_join(spark: SparkSession, d: str) -> DataFrame:
    return tool(spark, d, TOOL_JOIN, "orders", "customer", "nation")


@query(TOOL_WINDOW)
def sql_window(spark: SparkSession, d: str) -> DataFrame:
    return tool(spark, d, TOOL_WINDOW, "lineitem")


@query(TOOL_ANTI)
def sql_anti(spark: SparkSession, d: str) -> DataFrame:
    return tool(spark, d, TOOL_ANTI, "orders", "customer")


@query()
def trace_replay(spark: SparkSession, d: str) -> DataFrame:
    """Tool traces run again."""
    return replay.replay_traces(records(spark, d, "context", "tool_trace", "tool_env"))


@query()
def trace_repair(spark: SparkSession, d: str) -> DataFrame:
    return replay.repair_traces(records(spark, d, "context", "tool_trace", "tool_env")).select("id", "repaired")


@query(f"WITH {D.CHUNKS}, t AS (SELECT id, grids, unnest(range(len(grids))) AS k FROM c WHERE len(grids) > 0 AND len(grids) = len(tables)), w AS (SELECT id, k, grids[k + 1] AS g, unnest(range(len(grids[k + 1]))) AS row FROM t WHERE len(grids[k + 1]) >= 2), y AS (SELECT id, k, row, g[row + 1] AS cells, unnest(range(len(g[row + 1]))) AS col FROM w) SELECT id, k, row, col, array_to_string(regexp_extract_all(cells[col + 1], '\\S+'), ' ') AS cell FROM y")
def html_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the chunks' HTML tables as the HTML parser reads them; the SQL has them from the grids beside."""
    rows = chunks(spark, d).where("size(grids) > 0 and size(grids) = size(tables)").select("id", F.posexplode("tables").alias("k", "html"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, k, text in zip(frame["id"], frame["k"], frame["html"]):
                builder = Builder("", "")
                feed_html(text or "", builder)
                for node in builder.rows:
                    if node["tbl"]:
                        out += [(i, k, r, c, cell) for r, row in enumerate(node["tbl"]["grid"]) for c, cell in enumerate(row)]
            yield pd.DataFrame(out, columns=["id", "k", "row", "col", "cell"])

    return rows.mapInPandas(work, "id string, k int, row int, col int, cell string")


@query(f"WITH {D.NODES} SELECT doc_id, ord, equation.balanced AS valid FROM n WHERE equation IS NOT NULL")
def equation_check(spark: SparkSession, d: str) -> DataFrame:
    """Equations parsed again: whether they are well formed; the table has what was found before."""
    rows = nodes(spark, d).where("equation is not null").select("doc_id", "ord", F.col("equation.latex").alias("latex"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ord": frame["ord"], "valid": [validate(x)["valid"] for x in frame["latex"]]})

    return rows.mapInPandas(work, "doc_id string, ord int, valid boolean")


GRID_FILLED = "len(list_filter(flatten(tbl.grid), lambda c: trim(c) <> '')) * 2 >= len(flatten(tbl.grid))"


@query(f"WITH {D.NODES} SELECT doc_id, ord, len(tbl.grid) >= 2 AND list_max(list_transform(tbl.grid, lambda r: len(r))) >= 2 AND {GRID_FILLED} AS plausible, len(list_filter(flatten(tbl.grid), lambda c: length(c) <= 30 AND len(regexp_split_to_array(trim(c), '\\s+')) <= 5)) >= 0.7 * len(flatten(tbl.grid)) AS tabular FROM n WHERE tbl IS NOT NULL")
def table_plausibility(spark: SparkSession, d: str) -> DataFrame:
    rows = nodes(spark, d).where("tbl is not null")
    return rows.select("doc_id", "ord", geometry.plausible_table(F.col("tbl.grid")).alias("plausible"), geometry.tabular_look(F.col("tbl.grid")).alias("tabular"))


@query()
def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of each page grouped to rows by their vertical spans."""
    rows = nodes(spark, d).where("bbox is not null and page is not null and size(bbox) = 4")
    flat = rows.select("doc_id", "ord", "page", F.col("bbox")[0].alias("x0"), F.col("bbox")[1].alias("y0"), F.col("bbox")[2].alias("x1"), F.col("bbox")[3].alias("y1"))
    return geometry.fragment_rows(flat).select("doc_id", "page", "ord", "row")


@query(f"WITH {D.NODES}, h AS (SELECT doc_id, page, bbox[2] AS y, ord FROM n WHERE kind = 'heading' AND bbox IS NOT NULL AND page IS NOT NULL), b AS (SELECT doc_id, page, bbox[2] AS y, ord FROM n WHERE kind IN ('paragraph', 'table') AND bbox IS NOT NULL AND page IS NOT NULL) SELECT b.doc_id, b.ord, (SELECT max_by(h.ord, (h.page, h.y, h.ord)) FROM h WHERE h.doc_id = b.doc_id AND (h.page < b.page OR (h.page = b.page AND h.y <= b.y))) AS section FROM b")
def nearest_sections(spark: SparkSession, d: str) -> DataFrame:
    """The last heading above each block by page and position: an as-of join."""
    rows = nodes(spark, d).where("bbox is not null and page is not null")
    place = rows.select("doc_id", "page", F.col("bbox")[1].alias("y0"), "ord", "kind")
    return geometry.nearest_section(place.where("kind in ('paragraph', 'table')").drop("kind"), place.where("kind = 'heading'").drop("kind")).select("doc_id", "ord", "section")


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    out = incremental.event_windows(table(spark, d, "events"))
    return out.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = incremental.user_sessions(table(spark, d, "events"))
    return out.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")


@query(f"WITH {D.CHUNKS} SELECT id, sha256(to_json({{'id': id, 'doc_id': doc_id, 'text': text, 'kind': kind, 'source': source}})::VARCHAR) AS fingerprint FROM c")
def row_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return row_fingerprint(chunks(spark, d).select("id", "doc_id", "text", "kind", "source")).select("id", "fingerprint")


LISTS = ", ".join(f"nullif(array_to_string(coalesce({c}, []), chr(10)), '')" for c in ("tables", "equations"))


@query(f"WITH {D.CHUNKS} SELECT id, length(concat_ws(chr(10) || chr(10), nullif(breadcrumb, ''), nullif(text, ''), {LISTS}, nullif(resolved_refs, ''), nullif(array_to_string(coalesce(figures, []), chr(10)), ''))) AS chars, source, breadcrumb FROM c")
def retrieval_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as passages for retrieval."""
    return formats.corpus(chunks(spark, d)).select("id", F.length("text").alias("chars"), "source", "breadcrumb")
