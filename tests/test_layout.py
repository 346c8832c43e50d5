import pytest
from pyspark.sql import functions as F

from docloom.model.client import Offline
from docloom.operators import audit, evaluate, geometry, graph

from docloom.sources import pdf
from docloom.sources.builder import ParseError
from docloom.sources.parsers import PARSERS

BLOCK = "doc_id string, page int, n int, kind string, text string, size double, bold boolean, bbox array<double>, image_path string"
TABLE = "doc_id string, page int, bbox array<double>, grid array<array<string>>"
GRID = [["Unit", "Litres"], ["Zuka", "12"]]


def block(page, n, text, size=10.0, bold=False, box=(0, 0, 100, 10), kind="text", image=None, doc="d"):
    return (doc, page, n, kind, text, size, bold, [float(v) for v in box] if box else None, image)


ROWS = [
    block(0, 0, "A Study of Pumps", 20.0), block(0, 1, "All pumps of the plant were read in the winter. " * 5, box=(0, 20, 100, 60)), block(0, 2, "1 Results", 13.0, box=(0, 70, 100, 80)),
    block(0, 3, "Table 1: Litres by unit", box=(0, 90, 100, 100)), block(0, 4, "Zuka 12", box=(5, 112, 90, 118)), block(0, 5, "Figure 1: The pump", box=(0, 160, 100, 170)), block(0, 6, None, kind="image", box=(0, 175, 100, 260), image="p.png"),
    block(1, 0, "1.1 Limits", bold=True), block(1, 1, "The drift was not read.", box=(0, 30, 100, 40)), block(1, 2, "Outlook", bold=True, box=(0, 50, 100, 60)), block(1, 3, "More is to come.", box=None), block(1, 4, " ", box=None),
]
TABLES = [("d", 0, [0.0, 105.0, 100.0, 140.0], GRID)]


def check(rows):
    by = {}
    for r in rows:
        by.setdefault(r["kind"], []).append(r)
    assert by["document"][0]["text"] == "A Study of Pumps"
    assert [(r["text"], r["level"]) for r in by["heading"]] == [("A Study of Pumps", 1), ("1 Results", 2), ("1.1 Limits", 2), ("Outlook", 3)]
    table = by["table"][0]
    assert table["caption"] == "Table 1: Litres by unit" and table["breadcrumb"][-1] == "1 Results" and table["tbl"]["n_cols"] == 2
    assert by["figure"][0]["caption"] == "Figure 1: The pump" and by["figure"][0]["figure"]["src"] == "p.png"
    assert not any(r["text"] == "Zuka 12" for r in rows) and by["paragraph"][-1]["text"] == "More is to come."
    assert [r["ord"] for r in rows] == list(range(len(rows)))


def test_trees_from_layouts(spark):
    names = [x.split(" ")[0] for x in BLOCK.split(", ")]
    placed = [dict(zip(names, r)) for r in ROWS if r[7]] + [dict(zip(names, block(1, 9, "More is to come.")))]
    check(pdf.assembled(placed, [dict(zip(("doc_id", "page", "bbox", "grid"), t)) for t in TABLES], "d", "d.pdf"))
    blocks = spark.createDataFrame(ROWS + [block(0, i, f"Line {i} of the other file.", doc="e") for i in range(300)], BLOCK)
    out = geometry.document_trees(blocks, spark.createDataFrame(TABLES, TABLE)).cache()
    check(sorted((r.asDict(True) for r in out.where("doc_id = 'd'").collect()), key=lambda r: r["ord"]))
    assert out.where("doc_id = 'e' and kind = 'paragraph'").count() == 299 + 1
    assert geometry.document_trees(blocks.limit(0), spark.createDataFrame([], TABLE)).count() == 0


def test_headings_by_size_number_and_weight():
    assert [pdf.heading_level(*x, 10.0) for x in (("Big", 14.5, False), ("Middle", 12.0, False), ("2.3.1 Deep", 10.0, False), ("Bold line", 10.0, True), ("Bold sentence.", 10.0, True), ("plain", 10.0, False), ("x" * 161, 30.0, True), ("", 30.0, True))] == [1, 2, 3, 3, 0, 0, 0, 0]
    assert pdf.body_size([]) == 10.0


def test_pdf_without_a_backend():
    pytest.importorskip("pandas")
    try:
        import pymupdf  # noqa: F401
    except ImportError:
        with pytest.raises(ParseError):
            PARSERS[".pdf"](b"%PDF-1.4", "d", "d.pdf")


CHUNKS = [("c1", "a.md", ["Doc"], "The Sparse Network uses Adam at 5 ms.", None, None, None, None), ("c2", "b.md", ["Doc"], "and Adam beats Rival Method.", None, None, None, None)]


def test_merged_graphs_paths_and_model_pass(spark):
    chunks = spark.createDataFrame(CHUNKS, "id string, source string, section_path array<string>, text string, breadcrumb string, node_ids array<string>, tables array<string>, resolved_refs string")
    parts = [graph.build(chunks.where(f"id = '{i}'")) for i in ("c1", "c2")]
    found, known, edges = graph.merge_graphs([(p[0], p[2]) for p in parts])
    got = {r["key"]: (r["chunks"], r["sources"]) for r in known.collect()}
    assert got["adam"] == (2, 2) and got["rival method"][0] == 1
    assert edges.count() == edges.select("src", "dst", "relation").distinct().count()
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("x", "y")], "src string, dst string")
    ends = spark.createDataFrame([("a", "d"), ("a", "e"), ("a", "x"), ("a", "a")], "src string, dst string")
    paths = [("".join(r["path"]), r["rank"]) for r in graph.simple_paths(links, ends).orderBy("dst", "rank").collect()]
    assert paths == [("acd", 1), ("abcd", 2), ("acde", 1)]
    assert [r["rank"] for r in graph.simple_paths(links, ends, most=1).where("dst = 'd'").collect()] == [1]
    mentions, found_edges = graph.model_pass(chunks, Offline())
    assert mentions.where("key = 'adam'").count() == 2 and found_edges.where("src = dst").count() == 0
    twice = spark.createDataFrame([("a", "b", "r", "c2", 0.5), ("a", "b", "r", "c1", 0.4), ("a", "a", "r", "c1", 1.0)], "src string, dst string, relation string, chunk_id string, weight double")
    assert [tuple(r) for r in graph.unique_edges(twice).collect()] == [("a", "b", "r", "c1", 0.4)]


def test_grading_by_a_judge_and_recall(spark):
    passages = spark.createDataFrame([("p1", "The pump Zuka reached 12 litres in winter.", "a.md", "Zuka"), ("p2", "The valve Rima stayed at 7 bar all year.", "b.md", "Rima")], "id string, text string, source string, breadcrumb string")
    records = spark.createDataFrame([("r1", "qa", "How many litres did the pump Zuka reach?", "The pump Zuka reached 12 litres in winter.", "x", ("a.md",)), ("r2", "qa", "Which colour has the moon?", "Grey.", "x", ("z.md",))], "id string, task string, question string, answer string, context string, prov struct<source:string>")
    got = {r["id"]: r for r in evaluate.evaluate(records, Offline(), "retrieval", passages=passages, judge=True).collect()}
    assert got["r1"]["found_source"] and got["r1"]["grade"] == "correct" and not got["r2"]["found_source"]
    total = {r["task"]: r for r in evaluate.summary(evaluate.evaluate(records, Offline(), "retrieval", passages=passages)).collect()}
    assert total[None]["n"] == 2 and abs(total[None]["recall"] - 0.5) < 1e-9
    with pytest.raises(ValueError):
        evaluate.evaluate(records, Offline(), "retrieval")


def test_rates_of_a_report():
    report = {"gates": [{"stage": "structural", "passed": 80, "failed": 20, "inconclusive": 0}, {"stage": "nli_forward", "passed": 40, "failed": 5, "inconclusive": 5}, {"stage": "symbolic", "passed": 20, "failed": 5, "inconclusive": 0}, {"stage": "z3", "passed": 10, "failed": 0, "inconclusive": 0}]}
    assert audit.rates_from_report(report) == {"cheap": 0.5, "model": 0.5, "symbolic": 0.4}
    assert audit.rates_from_report({}) == {"cheap": 1.0, "model": 1.0, "symbolic": 1.0}
