"""Queries of choosing records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import choose, gates
from docloom.operators.records import quality
from docloom.plans import dialect as D
from docloom.plans.quality import HARDNESS, QUALITY
from docloom.plans.registry import query
from docloom.plans.text import records
from docloom.session import cut, table


@query(
    f"""WITH {D.RECORDS}, {HARDNESS}, x AS (SELECT id, bucket, {QUALITY} AS quality FROM hard JOIN r USING (id)), t AS (SELECT count(*) AS n FROM x),
    k AS (SELECT id, bucket, quality, row_number() OVER (PARTITION BY bucket ORDER BY 1.0 - quality, id) AS rn FROM x),
    f AS (SELECT id, bucket, quality FROM k, t WHERE rn <= round_even(n * CASE bucket WHEN 'simple' THEN 0.25 WHEN 'intermediate' THEN 0.45 ELSE 0.30 END, 0)),
    l AS (SELECT id, bucket, quality, row_number() OVER (ORDER BY 1.0 - quality, id) AS rn FROM x WHERE id NOT IN (SELECT id FROM f))
    SELECT id, bucket, quality FROM f UNION ALL SELECT id, bucket, quality FROM l WHERE rn <= (SELECT n FROM t) // 2 - (SELECT count(*) FROM f)""".replace("FROM k, t WHERE rn <= round_even(n * CASE", "FROM k, t WHERE rn <= round_even((n // 2) * CASE")
)
def difficulty_balance(spark: SparkSession, d: str) -> DataFrame:
    """Half of the records, balanced over recomputed difficulty, the best first."""
    rows = records(spark, d, "scores", "task", "hops", "question", "answer", "context")
    hard = gates.hardness(rows).select("id", "bucket")
    rows = cut(rows.select("id", quality(rows).alias("quality")).join(hard, "id"))
    return choose.balance(rows, total=rows.count() // 2).select("id", "bucket", "quality")


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id::VARCHAR), doc_id LIMIT 50")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty documents, the same whatever the partitioning."""
    return choose.sample(table(spark, d, "documents"), "doc_id", 50).select("doc_id")


@query(
    """WITH x AS (SELECT doc_id, coalesce(source, 'unknown') AS s FROM documents), u AS (SELECT md5('7:' || s) AS u, s, count(*) AS n FROM x GROUP BY s),
    p AS (SELECT s, sum(n) OVER (ORDER BY u) - n + n / 2 AS mid, sum(n) OVER () AS total FROM u)
    SELECT doc_id, CASE WHEN mid <= 0.8 * total THEN 'train' WHEN mid <= (0.8 + 0.1) * total THEN 'validation' ELSE 'test' END AS split FROM x JOIN p USING (s)"""
)
def source_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents split so that a collection stays together."""
    return choose.split_by_source(table(spark, d, "documents"), "doc_id", "source")


@query("WITH x AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('11:' || doc_id::VARCHAR), doc_id) AS rn FROM documents WHERE lang IS NOT NULL) SELECT lang, doc_id FROM x WHERE rn <= 20")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty documents of each language by hash."""
    rows = table(spark, d, "documents").where("lang is not null")
    mark = F.md5(F.concat(F.lit("11:"), F.col("doc_id").cast("string")))
    # The order has to begin with a number between 0 and 1: the first 13 digits of the mark.
    place = F.conv(F.substring(mark, 1, 13), 16, 10).cast("double") / float(16**13)
    langs = {r["lang"]: 20 for r in rows.select("lang").distinct().collect()}
    return choose.smallest(rows.select("lang", "doc_id", mark.alias("mark"), place.alias("place")), langs, "lang", [F.col("place"), F.col("mark"), F.col("doc_id")]).select("lang", "doc_id")
