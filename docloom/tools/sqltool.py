"""SQL over extracted tables: interactively on Spark, in replays on SQLite inside the workers."""

from __future__ import annotations

import re
import sqlite3
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

MOST_ROWS, DEADLINE = 50, 10.0


class ReadOnlyError(ValueError):
    """The statement is no query."""


def column_names(header: list[str]) -> list[str]:
    """Names that SQL can use: letters, digits and underscores, unique, none empty."""
    out: list[str] = []
    for i, cell in enumerate(header):
        name = re.sub(r"\W+", "_", (cell or "").strip().lower(), flags=re.ASCII).strip("_") or f"col_{i}"
        name = f"c_{name}" if name[0].isdigit() else name
        unique, n = name, 2
        while unique in out:
            unique, n = f"{name}_{n}", n + 1
        out.append(unique)
    return out


def table_names(captions: list[str], n: int) -> list[str]:
    """t for the first table, then table_<number> after the caption, else t<place>."""
    out: list[str] = []
    for i in range(n):
        number = re.match(r"\s*Table\s+(\d+)", captions[i] if i < len(captions) and captions[i] else "")
        name = "t" if i == 0 else f"table_{number.group(1)}" if number else f"t{i + 1}"
        out.append(name if name not in out else f"t{i + 1}")
    return out


def cell_value(text: str | None) -> int | float | str | None:
    """A number if the cell without thousands separators and a trailing per cent sign is one; an empty cell is null."""
    plain = (text or "").strip()
    bare = plain.replace(",", "").removesuffix("%").strip()
    if not plain:
        return None
    for kind in (int, float):
        try:
            return kind(bare)
        except ValueError:
            pass
    return plain


WRITES = re.compile(r"Command|Statement|Insert|Create|Drop|Delete|Update|Merge|Set(?:Catalog|Namespace)|Truncate|Load|Cache|Alter|Rename|Analyze|Refresh")


def plan_nodes(plan) -> Iterator[str]:
    """Class names of all nodes of a parsed plan: children, and what a node keeps inside, as the bodies of a WITH."""
    open_ = [plan]
    while open_:
        node = open_.pop()
        yield node.getClass().getSimpleName()
        for group in (node.children(), node.innerChildren()):
            for i in range(group.size()):
                if hasattr(group.apply(i), "innerChildren"):
                    open_.append(group.apply(i))


def plan_is_query(spark: SparkSession, sql: str) -> None:
    """Refuses every statement whose parsed plan has a node that isn't part of a query, at any depth, and functions that call
    into the virtual machine."""
    if not re.match(r"\s*(?:select|with)\b", sql, re.I):
        raise ReadOnlyError("only SELECT and WITH are allowed")
    if re.search(r"\b(?:try_)?(?:reflect|java_method)\s*\(", sql, re.I):
        raise ReadOnlyError("functions of the virtual machine can't be called")
    for name in plan_nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)):
        if WRITES.search(name):
            raise ReadOnlyError(f"{name} is no query")


def query(spark: SparkSession, sql: str) -> DataFrame:
    """A read-only statement as a frame, without a row limit."""
    plan_is_query(spark, sql)
    return spark.sql(sql)


def run_query(spark: SparkSession, sql: str, most: int = MOST_ROWS, deadline: float = DEADLINE) -> tuple[bool, str]:
    """(ok, output) of a read-only statement for interactive use: at most `most` rows, cancelled at the deadline."""
    group = f"docloom-sql-{uuid.uuid4().hex}"
    context = spark.sparkContext
    stop = threading.Timer(deadline, context.cancelJobGroup, (group,))
    try:
        context.setJobGroup(group, "interactive SQL", interruptOnCancel=True)
        stop.start()
        rows = query(spark, sql).limit(most).collect()
        return True, rendered(rows, most)
    except Exception as error:  # noqa: BLE001 - whatever is wrong with a statement is its output
        return False, f"{type(error).__name__}: {str(error).splitlines()[0][:300]}"
    finally:
        stop.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def register_grids(spark: SparkSession, grids: list[list[list[str]]], captions: list[str] = ()) -> list[str]:
    """Temporary views of the grids with two rows or more; numbers stay numbers where a whole column is numeric."""
    names = table_names(list(captions), len(grids))
    made = []
    for name, grid in zip(names, grids):
        if len(grid) < 2:
            continue
        header = column_names(grid[0])
        rows = [[cell_value(c) for c in (row + [None] * len(header))[: len(header)]] for row in grid[1:]]
        kinds = []
        for k in range(len(header)):
            seen = [r[k] for r in rows if r[k] is not None]
            kinds.append("bigint" if seen and all(isinstance(v, int) for v in seen) else "double" if seen and all(isinstance(v, (int, float)) for v in seen) else "string")
        cast = {"bigint": int, "double": float, "string": str}
        rows = [tuple(None if v is None else cast[k](v) for v, k in zip(r, kinds)) for r in rows]
        spark.createDataFrame(rows, ", ".join(f"`{h}` {k}" for h, k in zip(header, kinds))).createOrReplaceTempView(name)
        made.append(f"{name}({', '.join(header)})")
    return made


def describe_schema(grids: list[list[list[str]]], captions: list[str] = ()) -> str:
    """One line a table: its name, columns and caption."""
    named = zip(table_names(list(captions), len(grids)), grids, [*captions, *[""] * len(grids)])
    return "\n".join(f"{name}({', '.join(column_names(list(grid[0])))})" + (f" -- {caption}" if caption else "") for name, grid, caption in named if len(grid) >= 2)


def rendered(rows: list, most: int = MOST_ROWS) -> str:
    return "\n".join(" | ".join("" if v is None else str(v) for v in row) for row in rows[:most]) or "(no rows)"


def run_sqlite(sql: str, grids: list[list[list[str]]], captions: list[str] = (), deadline: float = DEADLINE) -> tuple[bool, str]:
    """(ok, output) of a read-only statement on the grids; it is stopped at the deadline."""
    if not re.match(r"\s*(?:select|with)\b", sql or "", re.I):
        return False, "only SELECT and WITH are allowed"
    connection = sqlite3.connect(":memory:")
    try:
        for name, grid in zip(table_names(list(captions), len(grids)), grids):
            if len(grid) < 2:
                continue
            header = column_names(list(grid[0]))
            connection.execute(f"CREATE TABLE {name} ({', '.join(header)})")
            connection.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(header))})", [[cell_value(c) for c in (list(row) + [None] * len(header))[: len(header)]] for row in grid[1:]])
        connection.execute("PRAGMA query_only = ON")
        end = time.monotonic() + deadline
        connection.set_progress_handler(lambda: int(time.monotonic() > end), 10_000)
        return True, rendered(connection.execute(sql).fetchmany(MOST_ROWS))
    except sqlite3.Error as error:
        return False, f"{type(error).__name__}: {error}"
    finally:
        connection.close()
