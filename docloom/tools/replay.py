"""Replaying tool traces: each step runs again, and its output is compared with what the trace claims."""

from __future__ import annotations

import os
import re
import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.tools.sqltool import run_sqlite

WINDOW = 320
NUMBER = re.compile(r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?")
#: The child script: no imports but mathematics, no files, no network, bounded memory and time.
CHILD = """
import builtins, resource, sys
resource.setrlimit(resource.RLIMIT_AS, (512 << 20, 512 << 20)); resource.setrlimit(resource.RLIMIT_CPU, (10, 10)); resource.setrlimit(resource.RLIMIT_FSIZE, (0, 0))
allowed = {"math", "statistics", "fractions", "decimal", "itertools", "functools", "collections", "re"}
real = builtins.__import__
def guarded(name, *args, **kw):
    if name.split(".")[0] not in allowed and sys._getframe(1).f_globals.get("__name__") == "__task__": raise ImportError(name + " is not allowed")
    return real(name, *args, **kw)
safe = {k: v for k, v in vars(builtins).items() if k not in ("open", "exec", "eval", "compile", "input", "breakpoint", "exit", "quit", "help")}
safe["__import__"] = guarded
code = sys.stdin.read()
exec(compile(code, "<task>", "exec"), {"__builtins__": safe, "__name__": "__task__"})
"""


def lookup(term: str, context: str) -> tuple[bool, str]:
    """A window of the context around the term, or around the first longer word of it that occurs."""
    low = context.lower()
    for probe in [term.strip(), *sorted(re.findall(r"\w{4,}", term), key=len, reverse=True)]:
        at = low.find(probe.lower()) if probe else -1
        if at >= 0:
            begin = max(0, at - WINDOW // 2)
            return True, context[begin : begin + WINDOW].strip()
    return False, "not found"


def run_python(code: str, timeout: float = 10.0) -> tuple[bool, str]:
    """(ok, output) of code in an isolated child process. This hardens against accidents; it is no security boundary."""
    with tempfile.TemporaryDirectory() as folder:
        try:
            done = subprocess.run([sys.executable, "-I", "-S", "-c", CHILD], input=code, capture_output=True, text=True, timeout=timeout, cwd=folder, env={"PATH": os.defpath})
        except subprocess.TimeoutExpired:
            return False, f"stopped after {timeout:g} s"
    return done.returncode == 0, (done.stdout if done.returncode == 0 else done.stderr.strip().split("\n")[-1]).strip()[:2000]


def execute(action: str, text: str, context: str, grids: list, captions: list, allow_python: bool = False) -> tuple[bool, str]:
    """One tool call. A `sql` step whose input is no statement names a cell: its row is looked up in the tables."""
    if action == "sql":
        if re.match(r"\s*(?:select|with)\b", text or "", re.I):
            return run_sqlite(text, grids, captions)
        for grid in grids:
            for row in grid[1:]:
                if row and (row[0] or "").strip() == (text or "").strip():
                    return True, " | ".join(str(c) for c in row[1:])
        return False, "no such row"
    if action == "lookup":
        return lookup(text or "", context or "")
    if action == "python":
        return run_python(text or "") if allow_python else (False, "execution is disabled")
    return False, f"unknown tool {action!r}"


def numbers(text: str) -> list[float]:
    return [float(x.replace(",", "")) for x in NUMBER.findall(text or "")]


def agrees(claimed: str, actual: str) -> bool:
    """All claimed numbers occur in the output within one per cent; without numbers one text contains the other."""
    said, real = numbers(claimed), numbers(actual)
    if said and real:
        return all(any(abs(s - r) <= max(0.01, abs(r) * 0.01) for r in real) for s in said)
    a, b = (claimed or "").strip().lower(), (actual or "").strip().lower()
    return a in b or b in a


TOOLS = ("python", "sql", "lookup")


def with_traces(records: DataFrame) -> DataFrame:
    none = lambda kind: F.array().cast(kind)
    return records.where(F.size("tool_trace") > 0).select("id", "context", "tool_trace", F.coalesce("tool_env.grids", none("array<array<array<string>>>")).alias("grids"), F.coalesce("tool_env.captions", none("array<string>")).alias("captions"))


def run_trace(row, allow_python: bool, repair: bool) -> dict:
    """Every step of one trace run again: steps with what the tools gave, and the counts of the verdict.

    A step of a disabled tool is left as it is, with whatever was executed before, and counts as skipped. A step whose tool
    fails keeps its claim; with `repair` a claim that the output contradicts is replaced by it.
    """
    grids = [[list(r) for r in grid] for grid in row.grids]
    steps, checked, agreed, skipped, repaired, notes = [], 0, 0, 0, 0, []
    for n, step in enumerate(row.tool_trace):
        step = dict(step)
        steps.append(step)
        action = (step["action"] or "").strip().lower()
        if action not in TOOLS:
            notes.append(f"step {n}: no tool {action!r}")
            continue
        if action == "python" and not allow_python:
            skipped += 1
            continue
        ok, output = execute(action, step["action_input"], row.context, grids, list(row.captions), allow_python)
        checked += 1
        step |= {"executed_observation": output, "executed_ok": bool(ok)}
        if not ok:
            notes.append(f"step {n}: {action} failed")
        elif agrees(step["observation"], output):
            agreed += 1
        elif repair:
            step["observation"], repaired, agreed = output, repaired + 1, agreed + 1
        else:
            notes.append(f"step {n}: {action} gave something else")
    return {"steps": steps, "checked": checked, "agreed": agreed, "skipped": skipped, "repaired": repaired, "notes": "; ".join(notes)}


def replay_traces(records: DataFrame, allow_python: bool = False) -> DataFrame:
    """(id, steps, checked, agreed, passed, inconclusive): verdict of each record with a trace; steps of a disabled tool are
    not checked and make the verdict inconclusive if nothing else fails."""
    rows = with_traces(records)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                x = run_trace(r, allow_python, False)
                out.append((r.id, len(x["steps"]), x["checked"], x["agreed"], x["checked"] + x["skipped"] > 0 and x["agreed"] == x["checked"], x["skipped"] > 0))
            yield pd.DataFrame(out, columns=["id", "steps", "checked", "agreed", "passed", "inconclusive"])

    return rows.mapInPandas(work, f"id {rows.schema['id'].dataType.simpleString()}, steps int, checked int, agreed int, passed boolean, inconclusive boolean")


def trace_gates(records: DataFrame, allow_python: bool = False) -> DataFrame:
    """The records with their traces' executed outputs and a column `trace_gate`: the verdict of the gate trace_execution, null
    for records without a trace. It fails if a step's output contradicts its claim, if a tool fails or if no step can be run; it
    is inconclusive if steps of a disabled tool were left out and nothing else failed."""
    rows = with_traces(records)
    kind, key = records.schema["tool_trace"].dataType.simpleString(), records.schema["id"].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                x = run_trace(r, allow_python, False)
                fine = x["agreed"] == x["checked"] and x["checked"] + x["skipped"] > 0
                out.append((r.id, x["steps"], fine, x["agreed"] / x["checked"] if x["checked"] else 0.0, x["notes"], fine and x["skipped"] > 0))
            yield pd.DataFrame(out, columns=["id", "ran", "passed", "score", "detail", "inconclusive"])

    done = rows.mapInPandas(work, f"id {key}, ran {kind}, passed boolean, score double, detail string, inconclusive boolean")
    verdict = F.struct(F.lit("trace_execution").alias("stage"), "passed", "score", "detail", "inconclusive")
    joined = records.join(done.select("id", "ran", verdict.alias("trace_gate")), "id", "left")
    return joined.withColumn("tool_trace", F.coalesce("ran", "tool_trace")).select(*records.columns, "trace_gate")


def repair_traces(records: DataFrame, allow_python: bool = False) -> DataFrame:
    """(id, tool_trace, repaired): traces with wrong observations replaced by what the tools really gave. Steps whose tool fails
    or is disabled keep everything they have."""
    rows = with_traces(records)
    kind = rows.schema["tool_trace"].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [(r.id, run_trace(r, allow_python, True)) for r in frame.itertuples(index=False)]
            yield pd.DataFrame([(i, x["steps"], x["repaired"]) for i, x in done], columns=["id", "tool_trace", "repaired"])

    return rows.mapInPandas(work, f"id {rows.schema['id'].dataType.simpleString()}, tool_trace {kind}, repaired int")
