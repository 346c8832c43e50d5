import io
import json
import zipfile

import pytest

from docloom.functions.latex import validate
from docloom.model import synth
from docloom.operators import tree
from docloom.pipeline import chunks_of
from docloom.sources import files
from docloom.sources.builder import ParseError
from docloom.sources.parsers import PARSERS, decoded, docx, epub, notebook

PAPER = """# A Paper

Intro that mentions Table 1 and Section 2.

## 1 Methods

Table 1: Sizes of the parts.

| part | size |
| --- | --- |
| bolt | 1,200 |
| nut | 5% |

$$ y = \\alpha x + b $$ (1)

As Eq. (1) shows, and [1] says.

## 2 Results

- one
- two

```
code | here
```
"""


def rows(content, suffix=".md"):
    return PARSERS[suffix](content if isinstance(content, bytes) else content.encode(), "d", f"x{suffix}")


def test_markdown():
    got = rows(PAPER)
    assert [r["kind"] for r in got] == ["document", "heading", "paragraph", "heading", "table", "equation", "paragraph", "heading", "list", "code"]
    table = got[4]
    assert table["caption"].startswith("Table 1") and table["tbl"]["grid"][1] == ["bolt", "1,200"] and table["breadcrumb"] == ["A Paper", "1 Methods"]
    assert got[5]["equation"]["number"] == "1" and got[5]["equation"]["balanced"]
    assert got[0]["text"] == "A Paper" and len({r["node_id"] for r in got}) == len(got)


def test_html():
    got = rows('<title>T</title><nav>no</nav><h2 id="a">Head</h2><p>Some&nbsp;<b>text</b></p><table><caption>C</caption><tr><th>x</th><th>y</th></tr><tr><td>1</td><td></td></tr></table><table><tr><td>one row</td></tr></table><pre>a\n b</pre><img src="http://x/y.png"><script>no</script>', ".html")
    assert [(r["kind"], r["text"]) for r in got[1:4]] == [("heading", "Head"), ("paragraph", "Some\xa0text"), ("table", "x | y\n1 | ")]
    assert got[1]["anchor"] == "#a" and got[3]["caption"] == "C" and got[4]["text"] == "a\n b" and got[5]["figure"]["src"] == ""


def test_latex():
    got = rows(r"\title{The Title}\begin{document}\section{One} % gone" + "\nText \\textbf{bold} 5\\% of $x$.\n\n\\begin{equation}\\label{e}a=b\\end{equation}\n\\begin{table}\\caption{Cap}\\begin{tabular}{ll}\\hline a & b \\\\ 1 & 2 \\\\ \\end{tabular}\\end{table}\\begin{verbatim}x_1\\end{verbatim}\\end{document}", ".tex")
    assert [r["kind"] for r in got] == ["document", "heading", "paragraph", "equation", "table", "code"]
    assert got[0]["text"] == "The Title" and "gone" not in str(got) and got[3]["anchor"] == "#e" and got[4]["tbl"]["grid"] == [["a", "b"], ["1", "2"]] and got[4]["caption"] == "Cap"


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as pack:
        for name, text in members.items():
            pack.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_docx_epub_notebook_csv():
    para = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    body = para("Top", "Heading1") + para("Body text") + para("Table 1: c", "Caption") + "<w:tbl>" + f"<w:tr>{cell('a')}{cell('b')}</w:tr>" * 2 + "</w:tbl>"
    got = docx(packed(word__document_dot_xml=f"<w:document {W}><w:body>{body}</w:body></w:document>"), "d", "x.docx")
    assert [r["kind"] for r in got] == ["document", "heading", "paragraph", "table"] and got[3]["caption"] == "Table 1: c"
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><metadata><dc:title xmlns:dc="http://purl.org/dc/elements/1.1/">Book</dc:title></metadata><manifest><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="c"/></spine></package>'
    got = epub(packed(content_dot_opf=opf, c_dot_xhtml="<h1>One</h1><p>Text here</p>"), "d", "x.epub")
    assert [r["text"] for r in got] == ["Book", "One", "Text here"] and got[1]["anchor"].startswith("c.xhtml#")
    got = notebook(json.dumps({"cells": [{"cell_type": "markdown", "source": ["# H\n", "words"]}, {"cell_type": "code", "source": "1+1", "outputs": [{"output_type": "stream", "text": ["2"]}]}]}).encode(), "d", "x.ipynb")
    assert [r["kind"] for r in got] == ["document", "heading", "paragraph", "code", "code"]
    assert rows("Model;Acc\nA;1\nB;2", ".csv")[1]["tbl"]["grid"] == [["Model", "Acc"], ["A", "1"], ["B", "2"]]
    assert len(rows("a,b\n" + "1,2\n" * 1201, ".csv")) == 4


@pytest.mark.parametrize("parser", [docx, epub])
def test_broken_archives(parser):
    with pytest.raises(ParseError):
        parser(b"no zip", "d", "x")


def test_decoding():
    assert decoded("﻿é".encode()) == "é" and decoded("“é”".encode("cp1252")) == "“é”"
    assert len(decoded(bytes(range(256)))) == 256


def test_equations():
    assert validate(r"\frac{a}{b} = x^2_1 \label{q}")["valid"]
    for bad in (r"\frac{a}", r"\sqrt{x", "a +", "x_", ")", r"\begin{align}x\end{equation}", r"\foo x", "", None):
        assert not validate(bad)["valid"]
    assert validate("{" * 20_000)["depth"] == 20_001


def test_reading_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in {"a.md": PAPER, "b.html": "<p>Some words are here</p>", "c.docx": "no zip", "d.csv": " \n", "e.pdf": "%PDF-1.4", "f.xyz": "ignored"}.items():
        (tmp_path / "in" / name).write_text(text)
    nodes, skipped = files.read_documents(spark, str(tmp_path / "in"))
    assert nodes.select("doc_id").distinct().count() == 2
    assert sorted(r["path"].rsplit("/", 1)[1] for r in skipped.collect()) == ["c.docx", "d.csv", "e.pdf"]


def test_references_labels_and_packing(spark, tmp_path):
    (tmp_path / "a.md").write_text(PAPER)
    nodes, _ = files.read_documents(spark, str(tmp_path / "a.md") + "*")
    nodes = nodes.cache()
    got = {(r["kind"], r["key"]): r for r in tree.references(nodes).collect()}
    kinds = {r["ord"]: r["kind"] for r in nodes.collect()}
    assert kinds[got["table", "1"]["target"]] == "table" and kinds[got["equation", "1"]["target"]] == "equation" and got["section", "2"]["resolved"] and not got["citation", "1"]["resolved"]
    chunks = tree.pack_sections(nodes, 20, 5).collect()
    blocks = [r for r in kinds.values() if r not in ("document", "heading")]
    assert sum(r["blocks"] for r in chunks) == len(blocks)
    trails = {r["ord"]: r["trail"] for r in tree.breadcrumbs(nodes).collect()}
    assert trails[4] == ["A Paper", "1 Methods"] and trails[0] == []
    cells = {(r["row"], r["name"]): r["number"] for r in tree.table_cells(nodes.withColumnRenamed("x", "y")).collect()}
    assert cells[0, "size"] == 1200.0 and cells[1, "size"] == 5.0 and cells[0, "part"] is None


@pytest.mark.parametrize("most,least", [(10, 3), (30, 10), (900, 60)])
def test_packing_equals_the_loop(spark, most, least):
    import random

    draw = random.Random(most)
    rows = [("d", i, s, draw.choice(["paragraph", "table", "figure"]), "x" * draw.randint(0, 90)) for s in range(12) for i in range(s * 20, s * 20 + draw.randint(1, 19))]
    df = spark.createDataFrame(rows, "doc_id string, ord int, parent_ord int, kind string, text string")
    expected = []
    for s in range(12):
        out, buffer = [], []
        cost = lambda t: max(1, len(t) // 4)
        for _, o, _, kind, text in sorted(r for r in rows if r[2] == s):
            c = cost(text)
            if kind in tree.ATOMIC and c > most:
                if buffer:
                    out.append(buffer)
                out.append([(o, c)])
                buffer = []
                continue
            if buffer and sum(x for _, x in buffer) + c > most:
                out.append(buffer)
                buffer = []
            buffer.append((o, c))
        if buffer:
            out.append(buffer)
        merged = []
        for b in out:
            if merged and sum(x for _, x in b) < least and sum(x for _, x in merged[-1]) + sum(x for _, x in b) <= most:
                merged[-1] = merged[-1] + b
            else:
                merged.append(b)
        expected += [(s, k, b[0][0], b[-1][0], len(b), sum(x for _, x in b)) for k, b in enumerate(merged)]
    got = tree.pack_sections(df, most, least).collect()
    assert sorted((r["section"], r["chunk"], r["first_ord"], r["last_ord"], r["blocks"], r["tokens"]) for r in got) == sorted(expected)


def test_chunks_hold_what_they_refer_to(spark, tmp_path):
    (tmp_path / "p.md").write_text(PAPER)
    (tmp_path / "plain.md").write_text("# Other\n\nNothing is mentioned here, and Table 9 is nowhere.\n")
    nodes, _ = files.read_documents(spark, str(tmp_path))
    chunks = chunks_of(nodes, 900, 1).cache()
    refs = {r["text"]: r["resolved_refs"] for r in chunks.collect()}
    intro = next(r for t, r in refs.items() if "Intro that" in t)
    assert "[table 1 -> " in intro and "<td>bolt</td><td>1,200</td>" in intro and intro.rstrip().endswith("2 Results")
    assert next(r for t, r in refs.items() if "Nothing" in t) is None
    context = next(r["context"] for r in synth.chunk_inputs(chunks).collect() if "Intro that" in r["context"])
    assert context.endswith("Resolved references:\n" + intro)
