"""What all parsers share: rows of a document tree in reading order."""

from __future__ import annotations

import hashlib
import html
from dataclasses import dataclass, field

from docloom.functions.latex import equation as equation_columns

NODE_SCHEMA = (
    "doc_id string, ord int, parent_ord int, node_id string, kind string, text string, level int, page int, bbox array<double>, anchor string, caption string, "
    "tbl struct<grid:array<array<string>>,html:string,n_rows:int,n_cols:int>, "
    "equation struct<latex:string,number:string,symbols:array<string>,depth:int,balanced:boolean,issues:array<string>>, "
    "figure struct<src:string,alt:string>, breadcrumb array<string>"
)
TABLE_CAPTION, FIGURE_CAPTION = ("Table",), ("Figure", "Fig.")


class ParseError(ValueError):
    """The one error that a parser raises for a file it can't read."""


def grid_html(grid: list[list[str]]) -> str:
    rows = "".join("<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in row) + "</tr>" for row in grid)
    return f"<table>{rows}</table>"


def grid_text(grid: list[list[str]]) -> str:
    return "\n".join(" | ".join(row) for row in grid)


@dataclass
class Builder:
    """Collects blocks; headings open sections by level, a caption waits for the next table, figure or equation."""

    doc_id: str
    source: str
    title: str = ""
    prefix: str = ""
    rows: list[dict] = field(default_factory=list)
    open_: list[dict] = field(default_factory=list)
    waiting: str = ""
    counts: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._add("document", self.title, level=0)
        self.open_ = [self.rows[0]]

    def _add(self, kind: str, text: str, level: int = 0, anchor: str = "", **more) -> dict:
        nth = self.counts[kind] = self.counts.get(kind, -1) + 1
        mark = hashlib.sha1(f"{self.source}:{kind}:{nth}:{text[:64]}".encode()).hexdigest()[:10]
        trail: list[str] = []
        for node in self.open_:
            if node["text"] and (not trail or trail[-1] != node["text"]):
                trail.append(node["text"])
        row = {
            "doc_id": self.doc_id, "ord": len(self.rows), "parent_ord": self.open_[-1]["ord"] if self.open_ else None, "node_id": f"{kind[:3]}-{mark}", "kind": kind, "text": text, "level": level,
            "page": None, "bbox": None, "anchor": f"{self.prefix}{anchor or f'#b{len(self.rows)}'}", "caption": None, "tbl": None, "equation": None, "figure": None, "breadcrumb": trail,
        } | more
        self.rows.append(row)
        return row

    def heading(self, text: str, level: int, anchor: str = "") -> None:
        text = text.strip()
        if not text:
            return
        self.flush_caption()
        while len(self.open_) > 1 and self.open_[-1]["level"] >= level:
            self.open_.pop()
        self.open_.append(self._add("heading", text, level, anchor))

    def block(self, kind: str, text: str, anchor: str = "") -> None:
        text = text.strip("\n") if kind == "code" else text.strip()
        if not text:
            return
        if kind == "caption":
            self.flush_caption()
            self.waiting = text
        elif kind == "equation":
            self._add("equation", text, anchor=anchor, caption=self.take_caption(), equation=equation_columns(text.strip("$ \n")))
        else:
            self.flush_caption(keep=True)
            self._add(kind, text, anchor=anchor)

    def table(self, grid: list[list[str]], caption: str = "", anchor: str = "") -> None:
        width = max((len(r) for r in grid), default=0)
        grid = [[*r, *[""] * (width - len(r))] for r in grid]
        if not width or not any(c for r in grid for c in r):
            return
        tbl = {"grid": grid, "html": grid_html(grid), "n_rows": len(grid), "n_cols": width}
        self._add("table", grid_text(grid), anchor=anchor, caption=caption or self.take_caption(), tbl=tbl)

    def image(self, src: str, alt: str = "", caption: str = "", anchor: str = "") -> None:
        self._add("figure", alt.strip(), anchor=anchor, caption=caption or self.take_caption(), figure={"src": src, "alt": alt})

    def take_caption(self) -> str | None:
        text, self.waiting = self.waiting, ""
        return text or None

    def flush_caption(self, keep: bool = False) -> None:
        """A caption that no block took is a block of its own; one paragraph in between may pass."""
        if self.waiting and not keep:
            self._add("caption", self.waiting)
            self.waiting = ""

    def done(self) -> list[dict]:
        self.flush_caption()
        if not self.title:
            heading = next((r for r in self.rows if r["kind"] == "heading"), None) or next((r for r in self.rows[1:] if r["text"]), None)
            self.rows[0]["text"] = heading["text"].split("\n")[0][:120] if heading else self.source
        return self.rows
