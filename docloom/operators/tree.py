"""Document trees as node tables (doc_id, ord, parent_ord, kind, text, ...): traversal, breadcrumbs, references, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators.records import latest
from docloom.session import cut

ATOMIC = ("table", "equation", "figure")
# References in running text and labels of blocks: (kind, pattern with one group). Letters and digits are spelled out, as \b and \w differ between engines.
REFERENCES = (
    ("citation", r"\[(\d{1,3})\]"),
    ("table", r"(?:^|[^0-9A-Za-z_])Table +(\d{1,3}[A-Za-z]?)(?:[^0-9A-Za-z_]|$)"),
    ("figure", r"(?:^|[^0-9A-Za-z_])(?:Figure +|Fig\. *)(\d{1,3}[A-Za-z]?)(?:[^0-9A-Za-z_]|$)"),
    ("equation", r"(?:^|[^0-9A-Za-z_])Eq(?:uation|\.) *\(?(\d{1,3})\)?"),
    ("section", r"(?:^|[^0-9A-Za-z_])(?:Section +(?:\d+(?:\.\d+)*)|Appendix +[A-Z])(?:[^0-9A-Za-z_]|$)"),
)


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """One row a (doc_id, ord): the one parsed last. Rows with a null key are left out."""
    return latest(nodes.where("doc_id is not null and ord is not null"), ["doc_id", "ord"], "parsed_at")


def block_kind(text: Column) -> Column:
    """Kind of a text block by its look: caption, footnote, equation or paragraph."""
    t = F.trim(T.text_of(text))
    first = F.element_at(F.split(t, "\n"), 1)
    maths = F.length(F.regexp_replace(first, r"[^=+*/^_\\{}<>|∑∫√≤≥≈±]", ""))
    caption = F.rlike(t, F.lit(r"^(Table|Figure|Fig\.) *\d")) & (F.length(t) < 400)
    return F.when(caption, "caption").when(F.rlike(t, F.lit(r"^(\*|†|\d{1,2}\)?) ?[A-Za-zÀ-ÿ]")) & (F.length(t) < 300), "footnote").when((maths >= 3) & (F.length(t) < 200), "equation").otherwise("paragraph")


def breadcrumbs(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, trail): titles of the ancestors of each node, from the root down, equal neighbours once.

    Levels of the tree are resolved from the top, one join a level; trees are a few levels deep, and a level's join is on
    (doc_id, ord), so one large document is spread like many small ones. Nodes whose parent is missing are roots.
    """
    base = nodes.select("doc_id", "ord", "parent_ord", F.when(F.col("kind").isin("document", "heading"), T.text_of(F.col("text"))).alias("title"))
    parents = base.select("doc_id", F.col("ord").alias("parent_ord"), F.col("title").alias("parent_title"))
    open_ = base.join(parents.select("doc_id", "parent_ord", F.lit(True).alias("has")), ["doc_id", "parent_ord"], "left")
    done = open_.where("has is null").select("doc_id", "ord", F.array().cast("array<string>").alias("trail"), "title")
    level, rest = done, cut(open_.where("has").select("doc_id", "ord", "parent_ord", "title"))
    while True:
        title, trail = T.text_of(F.col("title")), F.col("trail")
        below = F.when((title == "") | (F.element_at(F.concat(F.array(F.lit("")), trail), -1) == title), trail).otherwise(F.concat(trail, F.array(title)))
        up = level.select("doc_id", F.col("ord").alias("parent_ord"), below.alias("trail"))
        level = cut(rest.join(up, ["doc_id", "parent_ord"]).select("doc_id", "ord", "trail", "title"))
        if level.isEmpty():
            break
        done = done.unionByName(level)
    return done.select("doc_id", "ord", "trail")


def labels(nodes: DataFrame) -> DataFrame:
    """(doc_id, kind, key, target): what a reference of a kind and key points at; the first block counts, of sections the last."""
    probe = F.coalesce(F.col("caption"), T.text_of(F.col("text")))
    number = F.regexp_extract(probe, r"^\s*(?:Table|Figure|Fig\.) *(\d{1,3}[A-Za-z]?)", 1)
    section = F.regexp_extract(T.text_of(F.col("text")), r"^\s*(?:Appendix +)?(\d+(?:\.\d+)*|[A-Z])(?:\s|$)", 1)
    cited = F.regexp_extract(T.text_of(F.col("text")), r"^\s*\[(\d{1,3})\]", 1)
    kind = F.when((F.col("kind") == "heading") & (section != ""), "section").when(F.col("kind").isin("table", "figure") & (number != ""), F.col("kind"))
    kind = kind.when((F.col("kind") == "equation") & (T.text_of(F.col("equation.number")) != ""), "equation").when(cited != "", "citation")
    key = F.when(kind == "section", section).when(kind == "equation", F.col("equation.number")).when(kind == "citation", cited).otherwise(number)
    rows = nodes.select("doc_id", "ord", kind.alias("kind"), key.alias("key")).where("kind is not null")
    return rows.groupBy("doc_id", "kind", "key").agg(F.max("ord").alias("hi"), F.min("ord").alias("lo")).select("doc_id", "kind", "key", F.when(F.col("kind") == "section", F.col("hi")).otherwise(F.col("lo")).alias("target"))


def of_kind(kind: str):
    """Spark reads a second parameter of the function as the position, so the kind is bound here."""
    return lambda key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))


def references(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, kind, key, target, resolved): every reference in a text with the block it means; a block's reference to
    itself is none; what can't be resolved keeps a null target. Repeated references of one block count once."""
    parts = []
    for kind, pattern in REFERENCES:
        # Matches may share the character that ends one and begins the next, so only the key is consumed in the SQL twin as well.
        keys = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0 if kind == "section" else 1))
        if kind == "section":
            keys = F.transform(keys, lambda x: F.regexp_extract(x, r"(\d+(?:\.\d+)*|[A-Z])[^0-9A-Za-z]*$", 1))
        parts.append(F.transform(keys, of_kind(kind)))
    found = nodes.where("text is not null").select("doc_id", "ord", F.explode_outer(F.array_distinct(F.concat(*parts))).alias("r")).select("doc_id", "ord", "r.kind", "r.key").where("kind is not null")
    bound = found.join(labels(nodes), ["doc_id", "kind", "key"], "left")
    return bound.where("target is null or target <> ord").select("doc_id", "ord", "kind", "key", "target", F.col("target").isNotNull().alias("resolved"))


def resolved_bodies(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, refs): for each block with resolved references a line for each, with the whole body of its target."""
    filled = lambda c: F.when(T.text_of(F.col(c)) != "", F.trim(c))
    targets = nodes.select("doc_id", F.col("ord").alias("target"), "node_id", F.coalesce(filled("tbl.html"), filled("text"), filled("caption"), F.lit("")).alias("body"))
    bound = references(nodes).where("resolved").join(targets, ["doc_id", "target"])
    line = F.concat(F.lit("["), "kind", F.lit(" "), "key", F.lit(" -> "), "node_id", F.lit("] "), "body")
    return bound.groupBy("doc_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("target", "kind", "key", line.alias("line")))), lambda x: x["line"]).alias("refs"))


def pack_sections(nodes: DataFrame, most: int = 900, least: int = 60) -> DataFrame:
    """(doc_id, section, chunk, first_ord, last_ord, blocks, tokens): blocks of each section packed greedily in order.

    A section is the blocks under one heading or root. A block that would exceed `most` begins a new chunk; a table, equation
    or figure that alone exceeds it stands alone; a paragraph is never divided. A chunk under `least` joins the one before it
    if both fit. Blocks without text cost one token. Sections stream through sorted partitions one block at a time, so a
    section of any length needs constant memory.
    """
    blocks = nodes.where(~F.col("kind").isin("heading", "document")).select("doc_id", F.coalesce("parent_ord", F.lit(-1)).alias("section"), "ord", F.col("kind").isin(*ATOMIC).alias("atomic"), T.token_estimate(F.col("text")).alias("cost"))
    rows = blocks.repartition("doc_id", "section").sortWithinPartitions("doc_id", "section", "ord")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        section, out, number, closed = None, [], 0, []
        current = None  # open chunk: [first, last, blocks, cost]

        def settle(chunk: list) -> None:
            # A small chunk joins the one before it in its section.
            if closed and chunk[3] < least and closed[-1][3] + chunk[3] <= most:
                closed[-1][1], closed[-1][2], closed[-1][3] = chunk[1], closed[-1][2] + chunk[2], closed[-1][3] + chunk[3]
                return
            flush()
            closed.append(chunk)

        def flush() -> None:
            nonlocal number
            while closed:
                c = closed.pop(0)
                out.append((*section, number, c[0], c[1], c[2], c[3]))
                number += 1

        for frame in frames:
            for doc, sec, at, atomic, cost in zip(frame["doc_id"], frame["section"], frame["ord"], frame["atomic"], frame["cost"]):
                if (doc, sec) != section:
                    if current:
                        settle(current)
                    flush()
                    section, current, number = (doc, sec), None, 0
                if atomic and cost > most:
                    if current:
                        settle(current)
                        current = None
                    settle([at, at, 1, cost])
                    continue
                if current and current[3] + cost > most:
                    settle(current)
                    current = None
                if current:
                    current[1], current[2], current[3] = at, current[2] + 1, current[3] + cost
                else:
                    current = [at, at, 1, cost]
            if out:
                yield pd.DataFrame(out, columns=COLUMNS)
                out = []
        if current:
            settle(current)
        if section is not None:
            flush()
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    COLUMNS = ["doc_id", "section", "chunk", "first_ord", "last_ord", "blocks", "tokens"]
    return rows.mapInPandas(work, "doc_id string, section int, chunk int, first_ord int, last_ord int, blocks int, tokens int")


def section_text(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_id, section, text): the texts under each heading in order, joined by blank lines."""
    rows = nodes.where("text is not null and parent_ord is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n")
    out = rows.groupBy("doc_id", F.col("parent_ord").alias("section")).agg(joined.alias("text"))
    return out.withColumn("text", F.substring("text", 1, limit)) if limit else out


def table_cells(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, row, col, name, raw, number): every cell below a table's header with its column's name and, if the cell
    reads as a number without thousands separators and per cent sign, its value. Tables of fewer than two rows give nothing."""
    grids = nodes.where("kind = 'table' and size(tbl.grid) >= 2").select("doc_id", "ord", F.col("tbl.grid").alias("g"))
    rows = grids.select("doc_id", "ord", F.col("g")[0].alias("head"), F.posexplode(F.slice("g", 2, F.size("g") - 1)).alias("row", "cells"))
    cells = rows.select("doc_id", "ord", "row", "head", F.posexplode("cells").alias("col", "raw"))
    name = F.regexp_replace(F.regexp_replace(F.lower(T.text_of(F.get("head", F.col("col")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return cells.select("doc_id", "ord", "row", "col", F.when(name == "", F.concat(F.lit("col_"), F.col("col"))).otherwise(name).alias("name"), "raw", F.expr("try_cast(regexp_replace(regexp_replace(trim(raw), ',', ''), '%$', '') as double)").alias("number"))


def ranked_kinds(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, kind, nth): place of each node among those of its kind in its document."""
    return nodes.select("doc_id", "ord", "kind", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("ord")).alias("nth"))
