"""Queries of the scalar functions, and of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import audit, dedup
from docloom.operators.records import latest
from docloom.plans import dialect as D
from docloom.plans.registry import query
from docloom.session import cut, table


def records(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row an id. The columns are named where a query needs few of them: what the latest row is made of is read whole."""
    rows = table(spark, d, "records").where("id is not null")
    return latest(rows.select("id", "loaded_at", *columns) if columns else rows, "id", "loaded_at")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row an id; rows that repeat an id are copies."""
    return table(spark, d, "chunks").where("id is not null").dropDuplicates(["id"])


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, round({D.entropy('t')}, 6) AS entropy FROM (SELECT doc_id, {D.terms('text')} AS t FROM documents)")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    """Terms, distinct terms and entropy of each document."""
    rows = table(spark, d, "documents").select("doc_id", T.terms(F.col("text")).alias("t"))
    # Counting by a join on (document, term) instead of inside the array keeps long documents linear.
    flat = rows.select("doc_id", F.explode_outer("t").alias("w")).where("w is not null").groupBy("doc_id", "w").agg(F.count("*").alias("c"))
    per = flat.groupBy("doc_id").agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    entropy = F.round(F.log2("n") - F.col("s") / F.col("n"), 6)
    joined = table(spark, d, "documents").select("doc_id").join(per, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_tokens"), F.coalesce("k", F.lit(0)).alias("n_distinct"), F.abs(F.coalesce(entropy, F.lit(0.0))).alias("entropy"))


@query(f"SELECT doc_id, len({D.shingles('text')}) AS n_shingles FROM documents")
def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.shingles(F.col("text"), ascii=True)).alias("n_shingles"))


@query(f"SELECT doc_id, len(x) AS n_numbers, round(coalesce(list_sum(x), 0), 4) AS total FROM (SELECT doc_id, {D.numbers('text')} AS x FROM documents)")
def numbers_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", T.numbers(F.col("text")).alias("x"))
    return rows.select("doc_id", F.size("x").alias("n_numbers"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query("SELECT doc_id, substr(sha1(coalesce(source, '') || chr(31) || substr(coalesce(text, ''), 1, 512)), 1, 16) AS id FROM documents")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identity by content."""
    return table(spark, d, "documents").select("doc_id", T.chunk_id(F.col("source"), F.col("text")).alias("id"))


@query("SELECT doc_id, min(doc_id) OVER w AS first_key, count(*) OVER w AS copies FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text)")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_recovered(spark: SparkSession, d: str) -> DataFrame:
    """A field of JSON recovered from text."""
    rows = table(spark, d, "events")
    return rows.select("event_id", F.try_variant_get(T.recovered_json(F.col("props")), "$.k", "bigint").alias("k"))


F1 = """(CASE WHEN len(a) + len(b) = 0 THEN 1.0 WHEN len(list_intersect(a, b)) = 0 THEN 0.0 ELSE
    2.0 * list_sum(list_transform(list_intersect(a, b), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) / (len(a) + len(b)) END)"""
NUMERIC = "(CASE WHEN len(v) = 0 THEN 1.0 ELSE len(list_filter(v, lambda x: len(list_filter(u, lambda y: abs(y - x) <= greatest(0.01, abs(x) * 0.005))) > 0))::DOUBLE / len(v) END)"


@query(f"WITH {D.RECORDS} SELECT id, round({F1}, 6) AS f1, round({NUMERIC}, 6) AS numeric FROM (SELECT id, {D.terms('rejected')} AS a, {D.terms('answer')} AS b, {D.numbers('rejected')} AS u, {D.numbers('answer')} AS v FROM r WHERE rejection_mode IS NOT NULL)")
def answer_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How far a rejected answer agrees with the answer, in terms and in numbers."""
    rows = records(spark, d, "rejected", "answer", "rejection_mode").where("rejection_mode is not null")
    return audit.grades(rows, "rejected", "answer").select("id", "f1", "numeric")


def link_sql(source: str, key: str, text: str, threshold: float, ascii: bool = True) -> str:
    return f"""s AS (SELECT {key} AS id, {D.shingles(text, ascii=ascii)} AS h FROM {source}),
    m AS (SELECT id, list_sort(h) AS h FROM s WHERE len(h) > 0), k AS (SELECT h, min(id) AS cls, len(h) AS n FROM m GROUP BY h),
    e AS (SELECT cls, n, unnest(h) AS g FROM k), p AS (SELECT a.cls AS a, b.cls AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.cls < b.cls GROUP BY ALL),
    l AS (SELECT a, b FROM p WHERE c::DOUBLE / (na + nb - c) >= {threshold}),
    t AS (SELECT cls, count(*) AS links FROM (SELECT a AS cls FROM l UNION ALL SELECT b FROM l) GROUP BY cls)"""


def kept_sql(rows: str, source: str, text: str, order: str, threshold: float) -> str:
    """Keep-first: the classes with links in the order of their first row, one after the other."""
    return f"""WITH RECURSIVE {rows}, {link_sql(source, 'id', text, threshold, ascii=False)}, w AS (SELECT m.id, k.cls, {source}.{order} AS o FROM m JOIN k USING (h) JOIN {source} ON m.id = {source}.id),
    d AS (SELECT cls, id, o FROM w QUALIFY row_number() OVER (PARTITION BY cls ORDER BY o NULLS FIRST, id) = 1), b AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
    v AS (SELECT d.cls, row_number() OVER (ORDER BY o NULLS FIRST, id) AS i, n.near FROM d JOIN (SELECT x, list(y) AS near FROM b GROUP BY x) n ON d.cls = n.x),
    g AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS kept UNION ALL SELECT v.i, CASE WHEN list_has_any(v.near, g.kept) THEN g.kept ELSE list_append(g.kept, v.cls) END FROM g JOIN v ON v.i = g.i + 1),
    z AS (SELECT unnest(kept) AS cls FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1))
    SELECT id FROM d WHERE cls NOT IN (SELECT x FROM b) OR cls IN (SELECT cls FROM z) UNION ALL SELECT id FROM s WHERE len(h) = 0"""


@query(f"WITH {D.CHUNKS}, {link_sql('c', 'id', 'text', 0.85)} SELECT m.id, k.cls AS first_id, count(*) OVER (PARTITION BY k.cls) AS copies, coalesce(t.links, 0) AS links FROM m JOIN k USING (h) LEFT JOIN t ON k.cls = t.cls")
def chunk_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with its class of equal shingles and the number of classes at least .85 similar."""
    return dedup.near_duplicates(chunks(spark, d), "id", "text", 0.85, ascii=True).withColumnRenamed("first_key", "first_id")


@query(f"WITH {D.RECORDS}, {link_sql('r', 'id', 'question', 0.8)} SELECT m.id, k.cls AS first_id, count(*) OVER (PARTITION BY k.cls) AS copies, coalesce(t.links, 0) AS links FROM m JOIN k USING (h) LEFT JOIN t ON k.cls = t.cls")
def question_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_duplicates(records(spark, d, "question"), "id", "question", 0.8, ascii=True).withColumnRenamed("first_key", "first_id")


@query(kept_sql(D.CHUNKS, "c", "text", "id", 0.85))
def chunks_kept(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that stay after keep-first removal of near-duplicates."""
    return dedup.lexical_dedup(chunks(spark, d), "id", "text", "id", 0.85).where("kept").select("id")


@query(kept_sql(D.RECORDS, "r", "question", "loaded_at", 0.8))
def questions_kept(spark: SparkSession, d: str) -> DataFrame:
    """Questions that stay, in the order they were loaded."""
    return dedup.lexical_dedup(records(spark, d, "question"), "id", "question", "loaded_at", 0.8).where("kept").select("id")


#: 2025-10-01 in UTC, in seconds.
SPLIT_SECOND = 1_759_276_800


@query(
    f"""WITH {D.RECORDS}, x AS (SELECT id, list_sort({D.shingles('question')}) AS h, epoch(loaded_at) >= {SPLIT_SECOND} AS fresh FROM r WHERE loaded_at IS NOT NULL),
    f AS (SELECT id, h, len(h) AS n FROM x WHERE fresh), o AS (SELECT id AS oid, h, len(h) AS m FROM x WHERE NOT fresh AND len(h) > 0),
    e AS (SELECT id, n, unnest(h) AS g FROM f), b AS (SELECT oid, m, unnest(h) AS g FROM o),
    hit AS (SELECT DISTINCT id FROM (SELECT id, oid, n, m, count(*) AS c FROM e JOIN b USING (g) GROUP BY ALL) WHERE c::DOUBLE / (n + m - c) >= 0.8)
    SELECT id FROM f WHERE id NOT IN (SELECT id FROM hit)"""
)
def new_questions(spark: SparkSession, d: str) -> DataFrame:
    """Records loaded since a date whose question is no near-duplicate of an earlier one."""
    rows = cut(records(spark, d, "question").where("loaded_at is not null").select("id", "question", (F.unix_micros("loaded_at") >= SPLIT_SECOND * 1_000_000).alias("fresh")))
    return dedup.new_rows(rows.where("fresh").select("id", "question"), rows.where("not fresh").select(F.col("question").alias("known")), "id", "question", "known", ascii=True).select("id")
