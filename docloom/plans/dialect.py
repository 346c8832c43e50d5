"""Pieces of SQL that say the same as functions/text.py in DuckDB."""

from __future__ import annotations

from docloom.functions.text import NUMBER, STOP, TERM, WORD

RECORDS = "r AS (SELECT * FROM records WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) = 1)"
CHUNKS = "c AS (SELECT * FROM chunks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY text) = 1)"
NODES = "n AS (SELECT * FROM nodes WHERE doc_id IS NOT NULL AND ord IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, ord ORDER BY parsed_at DESC NULLS LAST) = 1)"


def terms(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in STOP)
    return f"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '{TERM}'), lambda t: lower(t)), lambda t: length(t) > 1 AND t NOT IN ({words}))"


def numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '{NUMBER}'), lambda t: replace(t, ',', '')::DOUBLE)"


def shingles(x: str, k: int = 5, ascii: bool = True) -> str:
    words = f"regexp_extract_all(lower(coalesce({x}, '')), '{'[a-z0-9]+' if ascii else WORD}')"
    return f"(list_transform([{words}], lambda w: CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(len(w) - {k - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) END))[1]"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


def entropy(x: str) -> str:
    part = f"list_transform(list_sort(list_distinct({x})), lambda u: len(list_filter({x}, lambda v: v = u))::DOUBLE / len({x}))"
    return f"coalesce(list_sum(list_transform({part}, lambda p: -p * log2(p))), 0.0)"
