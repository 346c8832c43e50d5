"""Page geometry over fragments and regions, as a PDF backend delivers them: rows of text, aligned tables, clustered figures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.sources import pdf
from docloom.sources.builder import NODE_SCHEMA
from docloom.sources.files import COLUMNS as NODE_COLUMNS

#: Points: tolerance of a column's edge, margin for labels of a figure, least side of a figure.
ALIGNED, LABEL_MARGIN, LEAST_SIDE, LABEL_CHARS = 8.0, 16.0, 24.0, 40


def overlap_area(a: Column, b: Column) -> Column:
    """Area that two boxes [x0, y0, x1, y1] share."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def area(a: Column) -> Column:
    return F.greatest((a[2] - a[0]) * (a[3] - a[1]), F.lit(0.0))


def vector_regions(drawings: DataFrame, page_area: float, least: float = 3.0, most: float = 0.92) -> DataFrame:
    """Drawings that can be part of a figure: no specks, no page backgrounds."""
    b = F.col("bbox")
    return drawings.where((b[2] - b[0] >= least) & (b[3] - b[1] >= least) & (area(b) <= most * page_area))


def without_tables(figures: DataFrame, tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Figures of which no table on the same page covers more than the share."""
    t = tables.select("doc_id", "page", F.col("bbox").alias("tb"))
    covered = overlap_area(F.col("bbox"), F.col("tb")) > share * area(F.col("bbox"))
    return figures.join(t, (figures.doc_id == t.doc_id) & (figures.page == t.page) & covered, "left_anti")


def plausible_table(grid: Column) -> Column:
    """At least two rows and columns, and half of the cells filled."""
    cells = F.flatten(grid)
    return (F.size(grid) >= 2) & (F.array_max(F.transform(grid, lambda r: F.size(r))) >= 2) & (F.size(F.filter(cells, lambda c: F.trim(c) != "")) * 2 >= F.size(cells))


def tabular_look(grid: Column) -> Column:
    """At least seven tenths of the cells are short: 30 characters and five words at most."""
    cells = F.flatten(grid)
    short = F.filter(cells, lambda c: (F.length(c) <= 30) & (F.size(F.split(F.trim(c), r"\s+")) <= 5))
    return F.size(short) >= 0.7 * F.size(cells)


def cluster_gap(sizes: np.ndarray) -> float:
    """How far apart boxes of one figure may lie: 1.2 median sides, between 4 and 14 points."""
    return float(np.clip(np.median(sizes) * 1.2, 4.0, 14.0)) if len(sizes) else 4.0


def merge_boxes(boxes: np.ndarray, gap: float) -> np.ndarray:
    """Unions of boxes that lie within the gap of one another, to a fixed point."""
    boxes = boxes[np.lexsort((boxes[:, 1], boxes[:, 0]))] if len(boxes) else boxes
    while len(boxes) > 1:
        grown = boxes + np.array([-gap, -gap, gap, gap])
        near = (grown[:, None, 0] <= boxes[None, :, 2]) & (grown[:, None, 2] >= boxes[None, :, 0]) & (grown[:, None, 1] <= boxes[None, :, 3]) & (grown[:, None, 3] >= boxes[None, :, 1])
        first = near.argmax(1)
        if (first == np.arange(len(boxes))).all():
            break
        made = [[*boxes[first == k, :2].min(0), *boxes[first == k, 2:].max(0)] for k in np.unique(first)]
        boxes = np.array(made)
    return boxes


def clustered_regions(regions: DataFrame) -> DataFrame:
    """(doc_id, page, bbox): figure boxes of each page from the boxes of its drawings. A page is one group; pages are bounded."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        boxes = np.array([list(b) for b in frame["bbox"]], float)
        sides = np.minimum(boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1])
        made = merge_boxes(boxes, cluster_gap(sides))
        made = made[(made[:, 2] - made[:, 0] >= LEAST_SIDE) & (made[:, 3] - made[:, 1] >= LEAST_SIDE)]
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[0], "page": frame["page"].iloc[0], "bbox": [b.tolist() for b in made]})

    return regions.where("bbox is not null").groupBy("doc_id", "page").applyInPandas(work, "doc_id string, page int, bbox array<double>")


def absorb_labels(figures: DataFrame, texts: DataFrame) -> DataFrame:
    """Figure boxes grown over short texts that lie mostly within their margin, to a fixed point, page by page."""

    def work(f: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        labels = np.array([list(b) for b, s in zip(t["bbox"], t["text"]) if len((s or "").strip()) <= LABEL_CHARS], float).reshape(-1, 4)
        out = []
        for box in (np.array(list(b), float) for b in f["bbox"]):
            while True:
                wide = box + np.array([-LABEL_MARGIN, -LABEL_MARGIN, LABEL_MARGIN, LABEL_MARGIN])
                w = np.minimum(labels[:, 2], wide[2]) - np.maximum(labels[:, 0], wide[0])
                h = np.minimum(labels[:, 3], wide[3]) - np.maximum(labels[:, 1], wide[1])
                size = np.maximum((labels[:, 2] - labels[:, 0]) * (labels[:, 3] - labels[:, 1]), 1e-9)
                take = labels[np.clip(w, 0, None) * np.clip(h, 0, None) >= 0.6 * size]
                grown = np.array([*np.minimum(box[:2], take[:, :2].min(0)), *np.maximum(box[2:], take[:, 2:].max(0))]) if len(take) else box
                if np.array_equal(grown, box):
                    break
                box = grown
            out.append(box.tolist())
        return pd.DataFrame({"doc_id": f["doc_id"], "page": f["page"], "bbox": out})

    left, right = figures.select("doc_id", "page", "bbox"), texts.select("doc_id", "page", "bbox", "text")
    return left.groupBy("doc_id", "page").cogroup(right.groupBy("doc_id", "page")).applyInPandas(lambda f, t: work(f, t) if len(f) else f[["doc_id", "page", "bbox"]], "doc_id string, page int, bbox array<double>")


def fragment_rows(fragments: DataFrame) -> DataFrame:
    """Adds `row`: fragments of a page whose vertical spans overlap a row's running span by half are in that row."""
    schema = fragments.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", row int"

    names = fragments.columns

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, top, bottom, n, seen = None, 0.0, -1.0, -1, 0
        for frame in frames:
            rows = []
            for doc, number, y0, y1 in zip(frame["doc_id"], frame["page"], frame["y0"], frame["y1"]):
                if (doc, number) != page:
                    page, n = (doc, number), -1
                if n >= 0 and min(bottom, y1) - max(top, y0) >= 0.5 * min(bottom - top, y1 - y0):
                    top, bottom, seen = (top * seen + y0) / (seen + 1), (bottom * seen + y1) / (seen + 1), seen + 1
                else:
                    n, top, bottom, seen = n + 1, y0, y1, 1
                rows.append(n)
            yield frame[names].assign(row=rows)

    # Pages stream through sorted partitions: no task per page, and no page is held in memory.
    return fragments.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "y0", "x0").mapInPandas(work, schema)


def aligned_tables(rows: DataFrame, least_rows: int = 3) -> DataFrame:
    """(doc_id, page, first_row, last_row, n_cols): runs of consecutive rows of two or more fragments whose left or right edges
    all lie within ALIGNED of the row before. rows: the output of fragment_rows."""
    per = rows.groupBy("doc_id", "page", "row").agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("cells")).where("size(cells) >= 2")
    w = Window.partitionBy("doc_id", "page").orderBy("row")
    before, last = F.lag("cells").over(w), F.lag("row").over(w)
    edges = lambda side: F.forall(F.zip_with("cells", before, lambda a, b: F.abs(a[side] - b[side]) <= ALIGNED), lambda ok: ok)
    joins = (last == F.col("row") - 1) & (F.size(before) == F.size("cells")) & (edges("x0") | edges("x1"))
    marked = per.withColumn("start", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("start").over(w))
    return runs.groupBy("doc_id", "page", "run").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.max(F.size("cells")).alias("n_cols"), F.count("*").alias("n")).where(F.col("n") >= least_rows).drop("run", "n")


def body_size(fragments: DataFrame) -> DataFrame:
    """(doc_id, size): the font size most characters of a document have; ties go to the larger."""
    sums = fragments.groupBy("doc_id", F.round("height", 1).alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    return sums.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", "size")).alias("size"))


def document_trees(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Node rows (sources.builder.NODE_SCHEMA) of documents given as page layouts.

    blocks: (doc_id, page, n, kind, text, size, bold, bbox, image_path), kind text or image, n the reading order in a page; tables:
    (doc_id, page, bbox, grid). Blocks inside a table are the table's; headings open sections by size, number or weight; a caption
    waits for the next image; a table goes under the last heading on its page or before, with the nearest caption on its page. The
    title is the largest text of the first page. Null pages, boxes and texts of blocks make them running text without a place.
    Documents stream through sorted partitions: besides its headings and captions nothing of a document is held.
    """
    text = blocks.where("kind = 'text' and trim(coalesce(text, '')) <> ''")
    sizes = body_size(text.select("doc_id", F.col("size").alias("height"), "text")).withColumnRenamed("size", "body")
    titles = text.where("page = 0").groupBy("doc_id").agg(F.max_by("text", F.struct("size", (-F.col("n")).alias("n"))).alias("title"))
    regions = tables.groupBy("doc_id", "page").agg(F.collect_list("bbox").alias("regions"))
    slack = F.lit(pdf.SLACK)
    swallowed = F.exists("regions", lambda r: (F.col("bbox")[0] >= r[0] - slack) & (F.col("bbox")[1] >= r[1] - slack) & (F.col("bbox")[2] <= r[2] + slack) & (F.col("bbox")[3] <= r[3] + slack))
    own = blocks.join(regions, ["doc_id", "page"], "left").where((F.col("kind") == "image") | ~F.coalesce(swallowed, F.lit(False)))
    none = lambda kind: F.lit(None).cast(kind)
    left = own.select("doc_id", F.lit(0).alias("part"), "page", F.col("n").cast("bigint").alias("n"), "kind", "text", F.col("size").cast("double").alias("size"), "bold", F.col("bbox").cast("array<double>").alias("bbox"), "image_path", none("array<array<string>>").alias("grid"))
    right = tables.select("doc_id", F.lit(1).alias("part"), "page", F.lit(0).cast("bigint").alias("n"), F.lit("table").alias("kind"), none("string").alias("text"), none("double").alias("size"), none("boolean").alias("bold"), F.col("bbox").cast("array<double>").alias("bbox"), none("string").alias("image_path"), "grid")
    rows = left.unionByName(right).join(sizes, "doc_id", "left").join(titles, "doc_id", "left")
    order = rows.repartition("doc_id").sortWithinPartitions("doc_id", "part", "page", "n", F.col("bbox")[1])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, out = None, None
        for frame in frames:
            made = []
            for row in frame.itertuples(index=False):
                if out is None or row.doc_id != doc:
                    if out is not None:
                        made += out.rows[sent:]
                    doc = row.doc_id
                    title = (row.title or "").strip().split("\n")[0][:200] or doc
                    out, sent = pdf.Assembler(doc, doc, title, body=row.body if row.body == row.body and row.body else 10.0), 0
                place = {"page": None if pd.isna(row.page) else int(row.page), "bbox": None if row.bbox is None else [float(v) for v in row.bbox]}
                if row.part == 0:
                    out.layout_block({"kind": row.kind, "text": row.text, "size": 0.0 if pd.isna(row.size) else row.size, "bold": bool(row.bold) if row.bold is not None else False, "image_path": row.image_path} | place)
                elif place["bbox"] and place["page"] is not None:
                    out.layout_table({"grid": [list(r) for r in ([] if row.grid is None else row.grid)]} | place)
            made += out.rows[sent:] if out is not None else []
            sent = len(out.rows) if out is not None else 0
            yield pd.DataFrame(made, columns=NODE_COLUMNS)

    return order.mapInPandas(work, NODE_SCHEMA)


def nearest_section(blocks: DataFrame, headings: DataFrame) -> DataFrame:
    """Adds `section`: the ord of the last heading on the block's page or an earlier one, by position; an as-of join as a window."""
    h = headings.select("doc_id", "page", F.col("y0").alias("y"), F.col("ord").alias("section"), F.lit(None).alias("b"), F.lit(0).alias("t"))
    b = blocks.select("doc_id", "page", F.col("y0").alias("y"), F.lit(None).cast("int").alias("section"), F.struct(*blocks.columns).alias("b"), F.lit(1).alias("t"))
    w = Window.partitionBy("doc_id").orderBy("page", "y", "t").rowsBetween(Window.unboundedPreceding, 0)
    joined = h.withColumn("b", F.lit(None).cast(b.schema["b"].dataType)).unionByName(b)
    return joined.withColumn("section", F.last("section", ignorenulls=True).over(w)).where("t = 1").select("b.*", "section")
