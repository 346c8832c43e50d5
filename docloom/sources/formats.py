"""Export formats: projections of records, and the writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.records import quality

SYSTEM = "Answer from the source material that is given, and from nothing else."
TURN = "array<struct<role:string,content:string>>"


def messages() -> Column:
    """The turns of a dialogue, else question and answer."""
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    return F.when(F.size(F.coalesce("turns", F.array().cast(TURN))) > 0, F.col("turns")).otherwise(pair)


def size_of(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0))


def chatml(records: DataFrame, system: str = SYSTEM) -> DataFrame:
    start = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return records.withColumn("row", F.struct(F.concat(start, messages()).alias("messages")))


def sharegpt(records: DataFrame, system: str = SYSTEM) -> DataFrame:
    name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    said = F.transform(messages(), lambda m: F.struct(name(m["role"]).alias("from"), m["content"].alias("value")))
    return records.withColumn("row", F.struct(said.alias("conversations")))


def alpaca(records: DataFrame, system: str = SYSTEM) -> DataFrame:
    return records.withColumn("row", F.struct(F.col("question").alias("instruction"), F.col("context").alias("input"), F.col("answer").alias("output")))


def dpo(records: DataFrame, system: str = SYSTEM) -> DataFrame:
    """Only records with a rejected answer."""
    rows = records.where(T.text_of(F.col("rejected")) != "")
    return rows.withColumn("row", F.struct(F.col("question").alias("prompt"), F.lit(system).alias("system"), F.col("answer").alias("chosen"), "rejected", "rejection_mode"))


def react(records: DataFrame, system: str = SYSTEM) -> DataFrame:
    """Only records with a tool trace."""
    steps = F.transform("tool_trace", lambda s: F.struct(s["thought"].alias("thought"), s["action"].alias("action"), s["action_input"].alias("action_input"), s["observation"].alias("observation"), F.coalesce(s["executed_ok"], F.lit(False)).alias("verified")))
    rows = records.where(size_of("tool_trace") > 0)
    return rows.withColumn("row", F.struct("question", steps.alias("trace"), "answer", F.col("tool_env.grids").alias("tables")))


def multimodal(records: DataFrame, system: str = SYSTEM) -> DataFrame:
    """Only records with images: the images, then the question."""
    part = "struct<type:string,image:string,text:string>"
    content = F.concat(F.transform("images", lambda p: F.struct(F.lit("image").alias("type"), p.alias("image"), F.lit(None).cast("string").alias("text")).cast(part)), F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"), F.col("question").alias("text")).cast(part)))
    rows = records.where(size_of("images") > 0)
    return rows.withColumn("row", F.struct(F.struct(F.struct(F.lit("user").alias("role"), content.alias("content")).alias("user"), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")).alias("assistant")).alias("messages"), "images"))


FORMATS: dict[str, Callable[..., DataFrame]] = {
    "chatml": chatml, "openai": chatml, "unsloth": chatml, "sharegpt": sharegpt, "llamafactory": sharegpt, "alpaca": alpaca, "axolotl": alpaca, "dpo": dpo, "react": react, "multimodal": multimodal,
}


def meta(records: DataFrame) -> Column:
    """What every exported row carries beside its content."""
    p = lambda c: F.col(f"prov.{c}").alias(c)
    return F.struct("id", "images", "task", "persona", "difficulty", "hops", quality(records).alias("quality"), p("source"), p("pages"), p("anchors"), p("node_ids"), p("breadcrumb"))


def formatted(records: DataFrame, name: str, system: str = SYSTEM, with_meta: bool = True, custom: dict[str, Callable] | None = None) -> DataFrame:
    """(value): the JSON lines of a format. 'raw' has all fields and no meta; own formats return (value) themselves."""
    if name == "raw":
        return records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value"))
    if name not in FORMATS:
        if name in (custom or {}):
            return custom[name](records)
        raise ValueError(f"unknown format {name!r}; choose from {sorted({*FORMATS, 'raw', *(custom or {})})}")
    rows = FORMATS[name](records, system)
    parts = ["row.*", *([meta(rows).alias("meta")] if with_meta else [])]
    whole = rows.select(*parts)
    # In the interleaved format absent keys are left out, as a text part has no image.
    keep = {"ignoreNullFields": "true" if name == "multimodal" else "false"}
    if name == "multimodal":
        whole = whole.withColumn("messages", F.array(F.to_json("messages.user"), F.to_json("messages.assistant")))
        body = F.to_json(F.struct(*[c for c in whole.columns if c != "messages"]), keep)
        return whole.select(F.concat(F.lit('{"messages":['), F.array_join("messages", ","), F.lit("],"), F.substring(body, F.lit(2), F.length(body))).alias("value"))
    return whole.select(F.to_json(F.struct(*whole.columns), keep).alias("value"))


def write_formats(records: DataFrame, path: str, names: list[str], system: str = SYSTEM, custom: dict[str, Callable] | None = None) -> dict[str, str]:
    """Writes each format as JSON lines under path/<name>.jsonl and all records as Parquet under path/dataset.parquet."""
    written = {}
    for name in names:
        written[name] = f"{path}/{name}.jsonl"
        formatted(records, name, system, custom=custom).write.mode("overwrite").text(written[name])
    written["parquet"] = f"{path}/dataset.parquet"
    records.write.mode("overwrite").parquet(written["parquet"])
    return written


def write_splits(records: DataFrame, splits: DataFrame, path: str, names: list[str]) -> None:
    """The same once a split: path/<split>/<name>.jsonl."""
    joined = records.join(splits, "id")
    for split in [r[0] for r in splits.select("split").distinct().orderBy("split").collect()]:
        write_formats(joined.where(F.col("split") == split).drop("split"), f"{path}/{split}", names)


def corpus(chunks: DataFrame) -> DataFrame:
    """Passages for retrieval: the chunk's context (breadcrumb, text, tables, equations, references), its text and provenance."""
    none = F.array().cast("array<string>")
    parts = [F.when(T.text_of(F.col(c)) != "", F.col(c)) for c in ("breadcrumb", "text")]
    lists = [F.array_join(F.coalesce(F.col(c), none), "\n") for c in ("tables", "equations")] + [T.text_of(F.col("resolved_refs")), F.array_join(F.coalesce("figures", none), "\n")]
    context = F.concat_ws("\n\n", *parts, *[F.when(x != "", x) for x in lists])
    return chunks.select("id", context.alias("text"), F.col("text").alias("body"), "source", "breadcrumb", "pages", "anchors", "node_ids", F.coalesce("figures", none).alias("images"), "tables", "equations")


def dataset_card(records: DataFrame) -> str:
    """A summary of a dataset in Markdown."""
    from docloom.operators import audit

    total = audit.quality_summary(records).first()
    lines = ["# Dataset", "", f"{total['n']} records, mean quality {total['quality_mean']}.", "", "| axis | value | records |", "| --- | --- | --- |"]
    lines += [f"| {r['axis']} | {r['value']} | {r['n']} |" for r in audit.composition(records).orderBy("axis", F.desc("n"), "value").limit(200).collect()]
    return "\n".join(lines) + "\n"
