"""Queries over document trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.operators import tree
from docloom.plans import dialect as D
from docloom.plans.registry import query
from docloom.session import table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return tree.unique_nodes(table(spark, d, "nodes"))


@query(f"WITH {D.NODES} SELECT doc_id, ord, kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY ord) AS nth FROM n")
def kind_ranks(spark: SparkSession, d: str) -> DataFrame:
    return tree.ranked_kinds(nodes(spark, d))


CELLS = "name, raw, TRY_CAST(regexp_replace(replace(trim(raw), ',', ''), '%$', '') AS DOUBLE) AS number"


@query(
    f"""WITH {D.NODES}, g AS (SELECT doc_id, ord, tbl.grid AS g FROM n WHERE kind = 'table' AND len(tbl.grid) >= 2),
    w AS (SELECT doc_id, ord, g, unnest(range(len(g) - 1)) AS row FROM g), x AS (SELECT doc_id, ord, row, g[1] AS head, g[row + 2] AS cells FROM w),
    y AS (SELECT doc_id, ord, row, head, cells, unnest(range(len(cells))) AS col FROM x),
    z AS (SELECT doc_id, ord, row, col, regexp_replace(regexp_replace(lower(coalesce(head[col + 1], '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS nm, cells[col + 1] AS raw FROM y),
    v AS (SELECT doc_id, ord, row, col, CASE WHEN nm = '' THEN 'col_' || col ELSE nm END AS name, raw FROM z)
    SELECT doc_id, ord, row, col, {CELLS} FROM v"""
)
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the extracted tables with typed values."""
    return tree.table_cells(nodes(spark, d))


@query(
    f"""WITH RECURSIVE {D.NODES}, k AS (SELECT doc_id, ord, parent_ord, CASE WHEN kind IN ('document', 'heading') THEN coalesce(text, '') END AS title FROM n),
    t AS (SELECT k.doc_id, k.ord, []::VARCHAR[] AS trail, k.title FROM k LEFT JOIN k p ON k.doc_id = p.doc_id AND k.parent_ord = p.ord WHERE p.ord IS NULL
    UNION ALL SELECT k.doc_id, k.ord, CASE WHEN coalesce(t.title, '') = '' OR (len(t.trail) > 0 AND t.trail[-1] = t.title) OR (len(t.trail) = 0 AND t.title = '') THEN t.trail ELSE list_append(t.trail, t.title) END, k.title FROM k JOIN t ON k.doc_id = t.doc_id AND k.parent_ord = t.ord)
    SELECT doc_id, ord, array_to_string(trail, ' > ') AS breadcrumb, len(trail) AS depth FROM t"""
)
def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    """Titles above each node."""
    return tree.breadcrumbs(nodes(spark, d)).selectExpr("doc_id", "ord", "array_join(trail, ' > ') as breadcrumb", "size(trail) as depth")


LABELS = r"""l0 AS (SELECT doc_id, ord, kind AS nk, coalesce(caption, text, '') AS probe, coalesce(text, '') AS t, coalesce(equation.number, '') AS en FROM n),
    l1 AS (SELECT doc_id, ord, nk, en, regexp_extract(probe, '^\s*(?:Table|Figure|Fig\.) *(\d{1,3}[A-Za-z]?)', 1) AS num, regexp_extract(t, '^\s*(?:Appendix +)?(\d+(?:\.\d+)*|[A-Z])(?:\s|$)', 1) AS sec, regexp_extract(t, '^\s*\[(\d{1,3})\]', 1) AS cit FROM l0),
    l2 AS (SELECT doc_id, ord, CASE WHEN nk = 'heading' AND sec <> '' THEN 'section' WHEN nk IN ('table', 'figure') AND num <> '' THEN nk WHEN nk = 'equation' AND en <> '' THEN 'equation' WHEN cit <> '' THEN 'citation' END AS kind, sec, en, cit, num FROM l1),
    l3 AS (SELECT doc_id, ord, kind, CASE kind WHEN 'section' THEN sec WHEN 'equation' THEN en WHEN 'citation' THEN cit ELSE num END AS key FROM l2 WHERE kind IS NOT NULL),
    lab AS (SELECT doc_id, kind, key, CASE WHEN kind = 'section' THEN max(ord) ELSE min(ord) END AS target FROM l3 GROUP BY doc_id, kind, key)"""


@query(f"WITH {D.NODES}, {LABELS} SELECT * FROM lab")
def labels(spark: SparkSession, d: str) -> DataFrame:
    return tree.labels(nodes(spark, d))


def reference_sql() -> str:
    parts = []
    for kind, pattern in tree.REFERENCES:
        if kind == "section":
            keys = f"list_transform(regexp_extract_all(text, '{pattern}', 0), lambda x: regexp_extract(x, '(\\d+(?:\\.\\d+)*|[A-Z])[^0-9A-Za-z]*$', 1))"
        else:
            keys = f"regexp_extract_all(text, '{pattern}', 1)"
        parts.append(f"SELECT doc_id, ord, '{kind}' AS kind, unnest({keys}) AS key FROM n WHERE text IS NOT NULL")
    return " UNION ".join(parts)


@query(f"WITH {D.NODES}, {LABELS}, ref AS ({reference_sql()}) SELECT doc_id, ord, kind, key, target, target IS NOT NULL AS resolved FROM ref LEFT JOIN lab USING (doc_id, kind, key) WHERE target IS NULL OR target <> ord")
def references(spark: SparkSession, d: str) -> DataFrame:
    """References in texts bound to the blocks they mean."""
    return tree.references(nodes(spark, d))


@query(
    f"""WITH RECURSIVE {D.NODES}, b AS (SELECT doc_id, coalesce(parent_ord, -1) AS section, ord, kind IN ('table', 'equation', 'figure') AS atomic, greatest(1, length(coalesce(text, '')) // 4)::INT AS cost FROM n WHERE kind NOT IN ('heading', 'document')),
    s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY ord) AS i FROM b),
    f AS (SELECT doc_id, section, i, ord, cost, 0 AS raw, cost AS used, (atomic AND cost > 900) AS closed FROM s WHERE i = 1
    UNION ALL SELECT s.doc_id, s.section, s.i, s.ord, s.cost, CASE WHEN f.closed OR (s.atomic AND s.cost > 900) OR f.used + s.cost > 900 THEN f.raw + 1 ELSE f.raw END,
        CASE WHEN f.closed OR (s.atomic AND s.cost > 900) OR f.used + s.cost > 900 THEN s.cost ELSE f.used + s.cost END, (s.atomic AND s.cost > 900) FROM f JOIN s ON f.doc_id = s.doc_id AND f.section = s.section AND s.i = f.i + 1),
    g AS (SELECT doc_id, section, raw, min(ord) AS first_ord, max(ord) AS last_ord, count(*)::INT AS blocks, sum(cost)::INT AS tokens FROM f GROUP BY ALL),
    m AS (SELECT doc_id, section, raw, first_ord, last_ord, blocks, tokens, 0 AS chunk, tokens AS total FROM g WHERE raw = 0
    UNION ALL SELECT g.doc_id, g.section, g.raw, g.first_ord, g.last_ord, g.blocks, g.tokens, CASE WHEN g.tokens < 60 AND m.total + g.tokens <= 900 THEN m.chunk ELSE m.chunk + 1 END, CASE WHEN g.tokens < 60 AND m.total + g.tokens <= 900 THEN m.total + g.tokens ELSE g.tokens END
        FROM m JOIN g ON m.doc_id = g.doc_id AND m.section = g.section AND g.raw = m.raw + 1)
    SELECT doc_id, section, chunk, min(first_ord) AS first_ord, max(last_ord) AS last_ord, sum(blocks)::INT AS blocks, sum(tokens)::INT AS tokens FROM m GROUP BY ALL"""
)
def packed_sections(spark: SparkSession, d: str) -> DataFrame:
    """Blocks packed into chunks along section boundaries."""
    return tree.pack_sections(nodes(spark, d))


@query(f"WITH {D.NODES} SELECT doc_id, parent_ord AS section, length(string_agg(text, chr(10) || chr(10) ORDER BY ord)) AS chars, md5(string_agg(text, chr(10) || chr(10) ORDER BY ord)) AS mark FROM n WHERE text IS NOT NULL AND parent_ord IS NOT NULL GROUP BY ALL")
def section_texts(spark: SparkSession, d: str) -> DataFrame:
    return tree.section_text(nodes(spark, d)).selectExpr("doc_id", "section", "length(text) as chars", "md5(text) as mark")
