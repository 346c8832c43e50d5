"""Parsers of single files into rows of a document tree: Markdown, HTML, LaTeX, DOCX, EPUB, notebooks, delimited text."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from docloom.sources.builder import Builder, ParseError

CAPTION = re.compile(r"(?:Table|Figure|Fig\.)\s*\d")
FOOTNOTE = re.compile(r"(?:\[\^\w+\]:|[*†‡]\s|\d{1,2}\)\s)")
MATHS = set("=+^_\\{}<>∑∫√≤≥≈±×")
ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+")


def decoded(content: bytes) -> str:
    """UTF-8 with or without a mark, else Windows-1252, else Latin-1, which reads anything."""
    for name in ("utf-8-sig", "cp1252"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            pass
    return content.decode("latin-1")


def text_kind(text: str) -> str:
    """Kind of a paragraph by its look."""
    first = text.split("\n", 1)[0]
    if CAPTION.match(text) and len(text) < 400:
        return "caption"
    if FOOTNOTE.match(text) and len(text) < 300:
        return "footnote"
    return "equation" if sum(c in MATHS for c in first) >= 3 and len(text) < 200 else "paragraph"


def pipe_cells(line: str) -> list[str]:
    return [c.strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def markdown(content: bytes, doc_id: str, source: str) -> list[dict]:
    text = decoded(content).replace("\r\n", "\n").replace("\r", "\n")
    out = Builder(doc_id, source)
    title = re.search(r"^#\s+(.+)$", text, re.M)
    out.title = out.rows[0]["text"] = title.group(1).strip() if title else ""
    lines = text.split("\n")
    held: list[str] = []

    def release() -> None:
        body = "\n".join(held).strip()
        held.clear()
        if body:
            kind = "list" if all(ITEM.match(x) or x.startswith((" ", "\t")) for x in body.split("\n")) and ITEM.match(body) else text_kind(body)
            out.block(kind, body)

    i = 0
    while i < len(lines):
        line = lines[i]
        if re.match(r"\s*(```|~~~)", line):
            release()
            fence, body = line.strip()[:3], []
            i += 1
            while i < len(lines) and not lines[i].strip().startswith(fence):
                body.append(lines[i])
                i += 1
            out.block("code", "\n".join(body))
        elif line.strip().startswith("$$"):
            release()
            body = line.strip()[2:]
            while "$$" not in body and i + 1 < len(lines):
                i += 1
                body += "\n" + lines[i]
            inside, _, rest = body.partition("$$")
            out.block("equation", f"{inside.strip()} {rest.strip()}".strip())
        elif m := re.match(r"(#{1,6})\s+(.+?)\s*#*$", line):
            release()
            out.heading(m.group(2), len(m.group(1)))
        elif line.lstrip().startswith("|") or (line.count("|") >= 2 and i + 1 < len(lines) and re.fullmatch(r"[\s|:-]+", lines[i + 1]) and "-" in lines[i + 1]):
            release()
            grid = []
            while i < len(lines) and "|" in lines[i]:
                if not re.fullmatch(r"[\s|:-]+", lines[i]):
                    grid.append(pipe_cells(lines[i]))
                i += 1
            i -= 1
            out.table(grid)
        elif m := re.fullmatch(r"\s*!\[([^\]]*)\]\(([^)\s]+)[^)]*\)\s*", line):
            release()
            out.image(m.group(2), m.group(1))
        elif not line.strip():
            release()
        else:
            if held and bool(ITEM.match(line)) != bool(ITEM.match(held[0])) and not line.startswith((" ", "\t")):
                release()
            held.append(line)
        i += 1
    release()
    return out.done()


def collapsed(text: str) -> str:
    """Runs of HTML white space as one blank; a no-break space is no such white space."""
    return re.sub("[ \t\n\r\f]+", " ", text).strip(" ")


class Page(HTMLParser):
    """A state machine over the events of an HTML page that feeds a builder."""

    SKIP = {"script", "style", "nav", "footer", "noscript", "template", "svg", "form", "aside"}
    BLOCKS = {"p", "div", "section", "article", "blockquote", "dd", "dt", "figure", "body", "main", "header", "ul", "ol", "table"}

    def __init__(self, out: Builder, images: set[str] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.images = out, images
        self.skipped, self.kind, self.level, self.anchor, self.text = 0, "paragraph", 0, "", []
        self.tables: list[dict] = []
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag in self.SKIP:
            self.skipped += 1
        if self.skipped:
            return
        if tag == "title":
            self.in_title = True
        elif self.tables and tag in ("tr", "td", "th", "caption"):
            table = self.tables[-1]
            if tag == "tr":
                table["grid"].append([])
            elif tag == "caption":
                table["cell"] = table["caption"] = []
            else:
                if not table["grid"]:
                    table["grid"].append([])
                table["cell"] = []
                table["grid"][-1].append(table["cell"])
        elif tag == "table":
            self.flush()
            self.tables.append({"grid": [], "cell": None, "caption": [], "anchor": given.get("id", "")})
        elif tag == "br":
            self.handle_data("\n")
        elif tag == "img":
            self.flush()
            src = given.get("src") or ""
            local = "" if re.match(r"(?:https?:|data:|//)", src) or (self.images is not None and src not in self.images) else src
            self.out.image(local, given.get("alt") or "", anchor=f"#{given['id']}" if given.get("id") else "")
        elif not self.tables:
            if re.fullmatch(r"h[1-6]", tag):
                self.flush()
                self.kind, self.level = "heading", int(tag[1])
            elif tag in ("li", "pre", "figcaption", "caption"):
                self.flush()
                self.kind = {"li": "list", "pre": "code"}.get(tag, "caption")
            elif tag in self.BLOCKS:
                self.flush()
            if given.get("id"):
                self.anchor = f"#{given['id']}"

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
            return
        if self.skipped:
            return
        if tag == "title":
            self.in_title = False
        elif tag == "table" and self.tables:
            table = self.tables.pop()
            grid = [[collapsed("".join(c)) for c in row] for row in table["grid"] if row]
            if len(grid) >= 2:
                self.out.table(grid, collapsed("".join(table["caption"])), f"#{table['anchor']}" if table["anchor"] else "")
        elif self.tables:
            if tag in ("td", "th", "caption"):
                self.tables[-1]["cell"] = None
        elif tag in self.BLOCKS or re.fullmatch(r"h[1-6]|li|pre|figcaption", tag):
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        if self.in_title:
            self.out.title += data
        elif self.tables:
            if self.tables[-1]["cell"] is not None:
                self.tables[-1]["cell"].append(data)
        else:
            self.text.append(data)

    def flush(self) -> None:
        raw, kind, anchor = "".join(self.text), self.kind, self.anchor
        self.text, self.kind, self.anchor = [], "paragraph", ""
        text = raw.strip("\n") if kind == "code" else collapsed(raw)
        if not text.strip():
            self.kind = kind if kind != "heading" else "paragraph"
            self.anchor = anchor
            return
        if kind == "heading":
            self.out.heading(text, self.level, anchor)
        else:
            self.out.block(text_kind(text) if kind == "paragraph" else kind, text, anchor)


def feed_html(text: str, out: Builder, images: set[str] | None = None) -> None:
    page = Page(out, images)
    page.feed(text)
    page.close()
    page.flush()
    out.title = " ".join(out.title.split())
    out.rows[0]["text"] = out.title


def html_page(content: bytes, doc_id: str, source: str) -> list[dict]:
    out = Builder(doc_id, source)
    feed_html(decoded(content), out)
    return out.done()


SECTION_LEVELS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
MATH_ENVIRONMENTS = "equation|align|gather|multline|eqnarray|displaymath"


def braced(text: str, at: int) -> tuple[str, int]:
    """The content of the braces that open at or after a position, and where they end."""
    begin = text.find("{", at)
    if begin < 0:
        return "", at
    level = 0
    for i in range(begin, len(text)):
        level += (text[i] == "{" and text[i - 1] != "\\") - (text[i] == "}" and text[i - 1] != "\\")
        if level == 0:
            return text[begin + 1 : i], i + 1
    return text[begin + 1 :], len(text)


def plain_latex(text: str) -> str:
    """Running text without commands."""
    text = re.sub(r"\\(?:label|cite[pt]?|ref|eqref|vspace|hspace|includegraphics)\*?(?:\[[^\]]*\])?\{[^}]*\}", lambda m: "" if "ref" not in m.group() else re.search(r"\{([^}]*)\}", m.group()).group(1), text)
    for _ in range(4):
        text = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\[A-Za-z]+\*?", " ", text)
    return " ".join(re.sub(r"\\([%&_#${}])", r"\1", text.replace("~", " ").replace("``", "“").replace("''", "”")).replace("{", "").replace("}", "").split())


def tabular_grid(body: str) -> list[list[str]]:
    body = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\}|cmidrule(?:\([^)]*\))?\{[^}]*\})", "", body)
    return [[plain_latex(c) for c in re.split(r"(?<!\\)&", row)] for row in re.split(r"\\\\(?:\[[^\]]*\])?", body) if row.strip()]


def latex_source(content: bytes, doc_id: str, source: str) -> list[dict]:
    text = re.sub(r"(?<!\\)%.*", "", decoded(content))
    out = Builder(doc_id, source)
    if "\\title" in text:
        out.title = out.rows[0]["text"] = plain_latex(braced(text, text.index("\\title"))[0])
    inside = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|$)", text, re.S)
    body = inside.group(1) if inside else text
    pattern = re.compile(rf"\\(?P<sec>{'|'.join(SECTION_LEVELS)})\*?\s*\{{|\\begin\{{(?P<env>{MATH_ENVIRONMENTS}|table|tabularx?|figure|verbatim|lstlisting|itemize|enumerate)(?P<star>\*?)\}}|\$\$|\\\[")
    at = 0

    def prose(part: str) -> None:
        for para in re.split(r"\n\s*\n", part):
            words = plain_latex(para)
            if words:
                out.block("caption" if CAPTION.match(words) and len(words) < 400 else "paragraph", words)

    while m := pattern.search(body, at):
        prose(body[at : m.start()])
        if m.group("sec"):
            title, at = braced(body, m.end() - 1)
            out.heading(plain_latex(title), SECTION_LEVELS[m.group("sec")])
        elif env := m.group("env"):
            closing = body.find(f"\\end{{{env}{m.group('star')}}}", m.end())
            closing = len(body) if closing < 0 else closing
            content_, at = body[m.end() : closing], closing + len(f"\\end{{{env}{m.group('star')}}}")
            caption = plain_latex(braced(content_, content_.index("\\caption"))[0]) if "\\caption" in content_ else ""
            label = re.search(r"\\label\{([^}]*)\}", content_)
            anchor = f"#{label.group(1)}" if label else ""
            if env in MATH_ENVIRONMENTS.split("|"):
                out.block("equation", re.sub(r"\\label\{[^}]*\}", "", content_).strip(), anchor)
            elif env in ("table", "tabular", "tabularx"):
                inner = re.search(r"\\begin\{tabularx?\*?\}(.*?)\\end\{tabularx?\*?\}", content_, re.S)
                cells = inner.group(1) if inner else content_
                cells = cells[braced(cells, 0)[1] :] if cells.lstrip().startswith("{") else cells
                out.table(tabular_grid(cells), caption, anchor)
            elif env == "figure":
                shown = re.search(r"\\includegraphics(?:\[[^\]]*\])?\{([^}]*)\}", content_)
                out.image(shown.group(1) if shown else "", "", caption, anchor)
            elif env in ("itemize", "enumerate"):
                out.block("list", "\n".join(f"- {plain_latex(x)}" for x in content_.split("\\item")[1:]))
            else:
                out.block("code", content_)
        else:
            end = body.find("$$" if m.group() == "$$" else "\\]", m.end())
            end = len(body) if end < 0 else end
            out.block("equation", body[m.end() : end])
            at = end + 2
    prose(body[at:])
    return out.done()


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def archive(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as error:
        raise ParseError(f"not a zip archive: {error}") from None


def xml_of(pack: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(pack.read(name))
    except (KeyError, ElementTree.ParseError) as error:
        raise ParseError(f"{name}: {error}") from None


def docx(content: bytes, doc_id: str, source: str) -> list[dict]:
    pack = archive(content)
    root = xml_of(pack, "word/document.xml")
    out = Builder(doc_id, source)
    if "docProps/core.xml" in pack.namelist():
        title = xml_of(pack, "docProps/core.xml").find("{http://purl.org/dc/elements/1.1/}title")
        out.title = out.rows[0]["text"] = (title.text or "").strip() if title is not None else ""
    body = root.find(f"{W}body")
    for element in body if body is not None else []:
        if element.tag == f"{W}tbl":
            grid = [[" ".join("".join(t.text or "" for t in cell.iter(f"{W}t")).split()) for cell in row.findall(f"{W}tc")] for row in element.findall(f"{W}tr")]
            if len(grid) >= 2:
                out.table(grid)
            continue
        if element.tag != f"{W}p":
            continue
        text = "".join((t.text or "") if t.tag == f"{W}t" else "\n" if t.tag == f"{W}br" else "" for t in element.iter()).strip()
        look = element.find(f"{W}pPr/{W}pStyle")
        style = (look.get(f"{W}val") or "").lower() if look is not None else ""
        outline = element.find(f"{W}pPr/{W}outlineLvl")
        if m := re.match(r"heading\s*(\d)", style):
            out.heading(text, int(m.group(1)))
        elif style in ("title", "subtitle"):
            out.heading(text, 1 if style == "title" else 2)
        elif outline is not None:
            out.heading(text, int(outline.get(f"{W}val") or 0) + 1)
        else:
            listed = element.find(f"{W}pPr/{W}numPr") is not None
            out.block("caption" if style == "caption" else "list" if listed else text_kind(text), text)
    return out.done()


def epub(content: bytes, doc_id: str, source: str) -> list[dict]:
    pack = archive(content)
    names = pack.namelist()
    out = Builder(doc_id, source)
    opf = next((n for n in names if n.endswith(".opf")), None)
    order: list[str] = []
    title = ""
    if opf:
        root = xml_of(pack, opf)
        items = {e.get("id"): e.get("href") for e in root.iter() if e.tag.endswith("}item")}
        base = posixpath.dirname(opf)
        order = [posixpath.normpath(posixpath.join(base, items[e.get("idref")])) for e in root.iter() if e.tag.endswith("}itemref") and items.get(e.get("idref"))]
        title = next((e.text or "" for e in root.iter() if e.tag.endswith("}title")), "").strip()
    order = [n for n in order if n in names] or sorted(n for n in names if re.search(r"\.x?html?$", n))
    if not order:
        raise ParseError("no text in the archive")
    images = {posixpath.basename(n) for n in names if re.search(r"\.(png|jpe?g|gif|svg|webp)$", n, re.I)}
    for name in order:
        out.prefix = posixpath.basename(name)
        out.title = ""
        feed_html(decoded(pack.read(name)), out, None if not images else images | {f"images/{x}" for x in images} | {f"../images/{x}" for x in images})
    out.prefix, out.title = "", title
    out.rows[0]["text"] = title
    return out.done()


def notebook(content: bytes, doc_id: str, source: str) -> list[dict]:
    try:
        cells = json.loads(decoded(content))["cells"]
    except (ValueError, KeyError, TypeError) as error:
        raise ParseError(f"no notebook: {error}") from None
    joined = lambda x: "".join(x) if isinstance(x, list) else str(x or "")
    parts = []
    for cell in cells:
        body = joined(cell.get("source"))
        if cell.get("cell_type") == "markdown":
            parts.append(body)
        elif cell.get("cell_type") == "code" and body.strip():
            parts.append(f"```\n{body}\n```")
            for shown in cell.get("outputs") or []:
                data = shown.get("data") or {}
                if "text/markdown" in data:
                    parts.append(joined(data["text/markdown"]))
                elif text := joined(shown.get("text") or data.get("text/plain") or shown.get("traceback") or shown.get("evalue")):
                    parts.append(f"```\n{text}\n```")
    return markdown("\n\n".join(parts).encode(), doc_id, source)


def delimited(content: bytes, doc_id: str, source: str, most: int = 501) -> list[dict]:
    text = decoded(content)
    out = Builder(doc_id, source)
    out.title = out.rows[0]["text"] = source
    head = "\n".join(text.splitlines()[:20])
    counts = {d: [line.count(d) for line in head.splitlines() if line.strip()] for d in ",;\t|"}
    best = max(counts, key=lambda d: (min(counts[d], default=0) > 0, min(counts[d], default=0)))
    grid = [[c.strip() for c in row] for row in csv.reader(io.StringIO(text), delimiter=best) if any(c.strip() for c in row)]
    if len(grid) >= 2 and len(grid[0]) >= 2:
        for begin in range(1, len(grid), most - 1):  # long files become several tables with the same header, none is cut off
            out.table([grid[0], *grid[begin : begin + most - 1]])
    else:
        out.block("paragraph", text)
    return out.done()


def pdf_file(content: bytes, doc_id: str, source: str) -> list[dict]:
    from docloom.sources.pdf import pdf

    return pdf(content, doc_id, source)


PARSERS = {
    ".md": markdown, ".markdown": markdown, ".txt": markdown, ".html": html_page, ".htm": html_page, ".xhtml": html_page, ".tex": latex_source, ".docx": docx, ".epub": epub,
    ".ipynb": notebook, ".csv": delimited, ".tsv": delimited, ".pdf": pdf_file,
}
