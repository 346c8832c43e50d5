"""Extension points: own tasks, export formats and parsers, by decorator or from plugin modules."""

from __future__ import annotations

import importlib
import importlib.util
import os
from collections.abc import Callable

TASKS: dict[str, Callable] = {}
FORMATS: dict[str, Callable] = {}
PARSERS: dict[str, Callable] = {}
_loaded: set[str] = set()


def register_task(name: str) -> Callable:
    """fn(spark, chunks, found, entities, edges, backend) -> records frame."""
    return lambda f: TASKS.setdefault(name, f)


def register_format(name: str) -> Callable:
    """fn(records frame) -> frame with one string column `value`, a line a row."""
    return lambda f: FORMATS.setdefault(name, f)


def register_parser(*suffixes: str) -> Callable:
    """fn(content bytes, doc_id, source) -> rows of a document tree."""

    def keep(f: Callable) -> Callable:
        for s in suffixes:
            PARSERS[s if s.startswith(".") else f".{s}"] = f
        return f

    return keep


def load_plugins(names: list[str], spark=None) -> list[str]:
    """Imports modules by name or .py path, each once; files also go to the workers. Returns what was newly loaded."""
    new = []
    for name in names:
        if name in _loaded:
            continue
        if name.endswith(".py"):
            spec = importlib.util.spec_from_file_location(os.path.basename(name)[:-3], name)
            if spec is None or spec.loader is None or not os.path.exists(name):
                raise ValueError(f"no such plugin: {name}")
            spec.loader.exec_module(importlib.util.module_from_spec(spec))
            if spark is not None:
                spark.sparkContext.addPyFile(name)
        else:
            importlib.import_module(name)
        _loaded.add(name)
        new.append(name)
    return new


def clear() -> None:
    for part in (TASKS, FORMATS, PARSERS, _loaded):
        part.clear()


def summary() -> dict[str, list[str]]:
    return {"tasks": sorted(TASKS), "formats": sorted(FORMATS), "parsers": sorted(PARSERS)}


def register_functions(spark) -> list[str]:
    """SQL functions for sessions: text functions under their names as temporary SQL functions."""
    made = {
        "dl_tokens_estimate": ("(t STRING) RETURNS INT RETURN greatest(1, cast(floor(length(coalesce(t, '')) / 4) AS INT))"),
        "dl_content_id": ("(source STRING, t STRING) RETURNS STRING RETURN substring(sha1(concat_ws(chr(31), coalesce(source, ''), substring(coalesce(t, ''), 1, 512))), 1, 16)"),
        "dl_normalized": ("(n STRING) RETURNS STRING RETURN regexp_replace(lower(trim(coalesce(n, ''))), r'\\s+', ' ')"),
    }
    for name, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return sorted(made)
