"""Records as the engine sees them: one row an id, the latest loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import text_of


def latest(df: DataFrame, key: str | list[str], by: str) -> DataFrame:
    """One row a key, the one with the largest `by`; rows that tie are taken to be copies. Columns stay as they are."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.coalesce(F.col(by), F.lit("0001-01-01").cast("timestamp"))).alias("x")
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(best).select(*[F.col(f"`{k}`") for k in keys], "x.*")


def quality(df: DataFrame):
    """The quality score of a record, 0 without one."""
    return F.coalesce(F.try_element_at("scores", F.lit("quality")), F.lit(0.0))


def accepted(flags):
    """No flag rejects the record."""
    return ~F.exists(F.coalesce(flags, F.array().cast("array<string>")), lambda f: F.startswith(text_of(f), F.lit("reject:")))
