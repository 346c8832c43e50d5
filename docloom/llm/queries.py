"""The queries of this subpackage for the driver: name -> function of (spark, directory), and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import garbled, grouping, mixing, neardup, packing, pairs, repetition, sampling, splitting, variety
from docloom.llm.tokenizer import token_sizes
from docloom.session import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


WORDS = "list_distinct(list_transform(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)))"
SIMILAR = f"""t AS (SELECT DISTINCT 'question' AS item, id, list_sort({WORDS.format('question')}) AS ws FROM records WHERE id IS NOT NULL AND question IS NOT NULL
    UNION ALL SELECT DISTINCT 'chunk', id, list_sort({WORDS.format('text')}) FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL),
    m AS (SELECT DISTINCT item, id, md5(array_to_string(ws, ' ')) AS cls, len(ws) AS n, ws FROM t WHERE len(ws) > 0), c AS (SELECT DISTINCT item, cls, n, ws FROM m), o AS (SELECT item, cls, n, unnest(ws) AS w FROM c),
    l AS (SELECT a.item, a.cls AS a, b.cls AS b FROM o a JOIN o b ON a.item = b.item AND a.w = b.w AND a.cls <> b.cls AND a.n >= 0.75 * b.n AND b.n >= 0.75 * a.n GROUP BY ALL HAVING count(*) >= 0.75 * (any_value(a.n) + any_value(b.n) - count(*)))"""
LINKED = r"""k AS (SELECT id, unnest(list_concat([prov.source], coalesce(prov.sources, []))) AS name FROM records),
    p AS (SELECT id, regexp_replace(regexp_replace(url_decode(name), '^\s+|\s+$', '', 'g'), '(?i)^([a-z][a-z0-9+.-]*://[^?#]*)[?#].*$', '\1') AS x FROM k WHERE name IS NOT NULL),
    f AS (SELECT DISTINCT id, lower(regexp_replace(regexp_extract(x, '([^/\\]*)[/\\]*$', 1), '^[\s"''<]+|[\s"''>]+$', '', 'g')) AS key FROM p),
    g AS (SELECT id, key FROM f WHERE key <> ''), e AS (SELECT DISTINCT a.key AS a, b.key AS b FROM g a JOIN g b ON a.id IS NOT DISTINCT FROM b.id),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), s AS (SELECT DISTINCT source, lower(source) AS key FROM files WHERE source IS NOT NULL)"""


def budget(spark: SparkSession, d: str, purpose: str) -> tuple[int, int]:
    row = table(spark, d, "budgets").where(F.col("purpose") == purpose).first()
    return row["max_tokens"], row["overlap_tokens"]


def judged(spark: SparkSession, d: str, judge=pairs.judged_pairs) -> DataFrame:
    documents = table(spark, d, "documents").select("text", F.col("lang").alias("label"))
    return judge(table(spark, d, "records"), documents)


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs of records."""
    return judged(spark, d, pairs.defective_pairs)


@query()
def p1_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs each evidence gave."""
    return judged(spark, d).groupBy("defect", "evidence").agg(F.count("*").alias("pairs"))


@query("SELECT DISTINCT id FROM chunks WHERE greatest(1, length(text) // 4) > (SELECT max(max_tokens) FROM budgets WHERE purpose = 'chunk')")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Oversized chunks, as those that come out in pieces."""
    return p3_pieces(spark, d).where("piece = 0").select("id")


@query("SELECT id, md5(min(text)) AS text_md5, length(min(text)) AS chars, TRUE AS in_budget FROM chunks WHERE greatest(1, length(text) // 4) > (SELECT max(max_tokens) FROM budgets WHERE purpose = 'chunk') GROUP BY id")
def p3_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The oversized chunks put together again from their pieces without the shared parts."""
    most, _ = budget(spark, d, "chunk")
    parts = p3_pieces(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("piece", "begin", "end", "text"))).alias("p"), F.max("tokens").alias("t"))
    own = F.transform("p", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substr(x["text"], (F.get("p", i - 1)["end"] - x["begin"] + 1).cast("int"))))
    whole = parts.select("id", F.array_join(own, "").alias("text"), "t")
    return whole.select("id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"), (F.col("t") <= most).alias("in_budget"))


@query()
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the oversized chunks."""
    most, overlap = budget(spark, d, "chunk")
    return splitting.split_oversized(table(spark, d, "chunks"), "id", "text", most, overlap)


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with garbled text."""
    return p4_restored(spark, d).select("doc_id", "ord").distinct()


@query()
def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with garbled text and what could be restored."""
    return garbled.garbled(table(spark, d, "nodes"))


def near_texts(spark: SparkSession, d: str, item: str):
    name, column = {"question": ("records", "question"), "chunk": ("chunks", "text")}[item]
    return neardup.near_duplicates(table(spark, d, name), "id", column, 0.75, salt=item)


@query(f"WITH {SIMILAR}, x AS (SELECT DISTINCT a.item, a.id AS i, b.id AS j FROM m a JOIN m b ON a.item = b.item AND a.cls = b.cls WHERE a.id < b.id UNION SELECT l.item, least(a.id, b.id), greatest(a.id, b.id) FROM l JOIN m a ON l.item = a.item AND l.a = a.cls JOIN m b ON l.item = b.item AND l.b = b.cls WHERE a.id <> b.id) SELECT item, i AS id_a, j AS id_b FROM x")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of similar questions and of similar chunks."""
    parts = [neardup.pair_rows(*near_texts(spark, d, item)).select(F.lit(item).alias("item"), "id_a", "id_b") for item in ("question", "chunk")]
    return parts[0].unionByName(parts[1])


@query(f"WITH {SIMILAR}, z AS (SELECT item, cls, count(DISTINCT id) AS copies, min(id) AS first_id FROM m GROUP BY ALL), y AS (SELECT item, a AS cls, count(*) AS links FROM l GROUP BY ALL) SELECT DISTINCT m.item, m.id, z.first_id, z.copies, coalesce(y.links, 0) AS links FROM m JOIN z ON m.item = z.item AND m.cls = z.cls LEFT JOIN y ON m.item = y.item AND m.cls = y.cls")
def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every question and chunk with its class of equal word sets and the number of similar classes."""
    parts = [neardup.class_rows(*near_texts(spark, d, item)).select(F.lit(item).alias("item"), "id", "first_id", "copies", "links") for item in ("question", "chunk")]
    return parts[0].unionByName(parts[1]).distinct()


@query(f"WITH RECURSIVE {LINKED} SELECT DISTINCT x.source AS source_a, y.source AS source_b FROM s x JOIN r ON x.key = r.a JOIN s y ON r.b = y.key WHERE x.source < y.source")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files that must share a split."""
    return grouping.linked_files(table(spark, d, "records"), table(spark, d, "files"))


@query(f"WITH RECURSIVE {LINKED} SELECT x.source, min(y.source) AS first_source, count(DISTINCT y.source) AS files FROM s x JOIN r ON x.key = r.a JOIN s y ON r.b = y.key GROUP BY x.source")
def p7_files(spark: SparkSession, d: str) -> DataFrame:
    """Every named file with its component."""
    return grouping.file_membership(table(spark, d, "records"), table(spark, d, "files"))


@query()
def p7_split(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its split."""
    return grouping.grouped_split(table(spark, d, "records"), table(spark, d, "split_targets")).select("id", "split_name")


@query("SELECT split_name, target_share, (SELECT count(DISTINCT id) FROM records) AS records, 0 AS torn_files, TRUE AS reached FROM split_targets")
def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the split: every record is placed once, no file has records in two splits, shares within a hundredth
    and the share of the largest component."""
    records, targets = table(spark, d, "records"), table(spark, d, "split_targets")
    placed = cut(grouping.grouped_split(records, targets))
    torn = grouping.named_files(records).join(placed, "id").groupBy("key").agg(F.countDistinct("split_name").alias("n")).where("n > 1").agg(F.count("*").cast("int").alias("torn_files"))
    total = placed.groupBy("root").agg(F.count("*").alias("n")).agg(F.sum("n").alias("records"), F.max("n").alias("largest"))
    shares = placed.groupBy("split_name").agg(F.count("*").alias("n"))
    rows = targets.join(shares, "split_name", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(torn))
    return rows.select("split_name", "target_share", "records", "torn_files", (F.abs(F.coalesce("n", F.lit(0)) / F.col("records") - F.col("target_share")) <= 0.01 + F.col("largest") / F.col("records")).alias("reached"))


@query(
    """WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS ws FROM documents),
    g AS (SELECT doc_id, len(ws) AS n, unnest(range(len(ws) - 7)) AS i, ws FROM w WHERE len(ws) >= 8),
    r AS (SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, ws[i + 1:i + 8] ORDER BY i) AS k FROM g),
    c AS (SELECT doc_id, any_value(n) AS n, count(DISTINCT p) AS rep FROM (SELECT doc_id, n, unnest(range(i, i + 8)) AS p FROM r WHERE k > 1) GROUP BY doc_id)
    SELECT doc_id FROM c WHERE rep * 10 >= n * 3"""
)
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which at least 30 % of the words are repeated."""
    found = repetition.repetition(table(spark, d, "documents"))
    return found.where("n_words > 0 and repeated_words * 10 >= n_words * 3").select("doc_id").distinct()


@query(
    """WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS ws FROM documents),
    g AS (SELECT doc_id, unnest(range(len(ws) - 7)) AS i, ws FROM w WHERE len(ws) >= 8), r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, ws[i + 1:i + 8] ORDER BY i) AS k FROM g),
    c AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r WHERE k > 1) GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, coalesce(rep, 0) AS repeated_words, CASE WHEN len(ws) = 0 THEN 0.0 ELSE round(coalesce(rep, 0)::DOUBLE / len(ws), 6) END AS repeated_share FROM w LEFT JOIN c USING (doc_id)"""
)
def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its repeated words."""
    return repetition.repetition(table(spark, d, "documents")).select("doc_id", "n_words", "repeated_words", F.round("repeated_share", 6).alias("repeated_share"))


@query()
def p10_repetition(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its share of repeated words."""
    return repetition.repetition(table(spark, d, "documents"))


@query()
def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the records in the target proportions of difficulty."""
    return sampling.category_sample(table(spark, d, "records"), table(spark, d, "difficulty_targets"))[0]


@query()
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """What each difficulty wanted and got."""
    return sampling.category_sample(table(spark, d, "records"), table(spark, d, "difficulty_targets"))[1]


KEY = "nullif(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_'), '')"


@query(
    f"""WITH r AS (SELECT id, min({KEY.format('difficulty')}) AS c FROM records WHERE id IS NOT NULL GROUP BY id)
    SELECT difficulty AS category, target_share, min_rows, (SELECT count(*) FROM r WHERE c = difficulty) AS available, (SELECT round(0.2 * count(*))::BIGINT FROM r) AS size, TRUE AS minimum_kept, TRUE AS ranks_dense, TRUE AS reached_or_reported FROM difficulty_targets"""
)
def p2_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the sample: its size, the minima as far as rows exist and all of them fit in, ranks without gaps, and
    shares within a hundredth of the target unless the report says that it could not be met or the minimum is what was drawn."""
    sample, report = sampling.category_sample(table(spark, d, "records"), table(spark, d, "difficulty_targets"))
    got = sample.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("ranks"), F.max("rank").alias("last"))
    size = sample.agg(F.count("*").alias("size")).crossJoin(report.agg(F.sum(F.least("min_rows", "available")).alias("needed")))
    rows = report.join(got, "category", "left").fillna(0, ["n", "ranks", "last"]).crossJoin(F.broadcast(size))
    fair = ~F.col("met") | (F.col("n") <= F.col("min_rows")) | (F.abs(F.col("n") / F.col("size") - F.col("target_share")) <= 0.011)
    return rows.select("category", "target_share", "min_rows", "available", "size", ((F.col("n") >= F.least("min_rows", "available")) | (F.col("needed") > F.col("size"))).alias("minimum_kept"), ((F.col("n") == F.col("ranks")) & (F.col("n") == F.col("last"))).alias("ranks_dense"), fair.alias("reached_or_reported"))


@query("SELECT ceil(sqrt(count(DISTINCT id)))::BIGINT AS rows, ceil(sqrt(count(DISTINCT id)))::BIGINT AS keys, ceil(sqrt(count(DISTINCT id)))::INTEGER AS last_rank, TRUE AS gains_fall FROM records")
def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the subset: its size, different keys, ranks without gaps, gains that never rise."""
    chosen = p5_subset(spark, d)
    steps = chosen.agg(F.array_sort(F.collect_list(F.struct("rank", "gain"))).alias("s"), F.count("*").alias("rows"), F.countDistinct("id").alias("keys"), F.max("rank").alias("last_rank"))
    falls = F.forall(F.transform("s", lambda x, i: (i == 0) | (x["gain"] <= F.get("s", i - 1)["gain"] + 1e-4)), lambda b: b)
    return steps.select("rows", "keys", "last_rank", falls.alias("gains_fall"))


@query()
def p5_subset(spark: SparkSession, d: str) -> DataFrame:
    """A varied subset of the records, of the square root of their number."""
    return variety.varied_subset(table(spark, d, "records"))


def placed_documents(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    most, _ = budget(spark, d, "container")
    return packing.containers(token_sizes(table(spark, d, "documents"), "doc_id", "text"), "doc_id", most), most


@query()
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its container."""
    return placed_documents(spark, d)[0]


@query("SELECT count(DISTINCT doc_id) AS documents, 0 AS overfull, 0 AS divided, 0 AS lost, TRUE AS well_filled FROM documents WHERE text <> ''")
def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: none too full, no document divided that fits in one, no token lost, little space left."""
    most, _ = budget(spark, d, "container")
    sizes = cut(token_sizes(table(spark, d, "documents"), "doc_id", "text"))
    placed = cut(packing.containers(sizes, "doc_id", most))
    fills = placed.groupBy("container").agg(F.sum("tokens").alias("n")).agg(F.sum((F.col("n") > most).cast("int")).cast("int").alias("overfull"), (F.sum("n") / (F.count("*") * most) >= 0.98).alias("well_filled"))
    per = placed.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("parts"))
    whole = per.join(sizes.groupBy("doc_id").agg(F.max("tokens").alias("tokens")).where("tokens > 0"), "doc_id", "full")
    kept = whole.agg(F.count("*").alias("documents"), F.sum(((F.col("tokens") <= most) & (F.col("parts") > 1)).cast("int")).cast("int").alias("divided"), F.sum((~F.col("n").eqNullSafe(F.col("tokens"))).cast("int")).cast("int").alias("lost"))
    return kept.crossJoin(fills).select("documents", "overfull", "divided", "lost", "well_filled")


@query()
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(*placed_documents(spark, d))


def mixed_documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    named = [r["source"] for r in targets.select("source").distinct().limit(mixing.MOST_SOURCES + 1).collect()]
    documents = table(spark, d, "documents").where(F.col("source").isin(named))
    return mixing.mixture(token_sizes(documents, "doc_id", "text", keep=("source",)), targets)


@query()
def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture's slots and the pieces of documents in them."""
    return mixed_documents(spark, d)[0]


@query("SELECT source, round(weight / (SELECT sum(weight) FROM mix_targets), 9) AS weight, max_repeats, TRUE AS within_repeats, TRUE AS fair FROM mix_targets")
def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mixture: no source repeated too often, shares of sources that have enough as the weights, scaled by
    what the others lack, let expect of a multinomial draw: within a hundredth and four standard deviations."""
    report = cut(mixed_documents(spark, d)[1])
    short = report.where("not met").agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("s"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).crossJoin(report.agg(F.sum("drawn_tokens").alias("all")))
    rows = report.crossJoin(F.broadcast(short))
    due = F.coalesce(F.try_divide(F.col("weight") * (1 - F.col("s")), 1 - F.col("w")), F.lit(0.0))
    return rows.select("source", F.round("weight", 9).alias("weight"), "max_repeats", (F.col("repeats") <= F.col("max_repeats")).alias("within_repeats"), (~F.col("met") | (F.abs(F.col("share") - due) <= 0.01 + 4 * F.sqrt(F.greatest(due * (1 - due), F.lit(0.0)) * F.coalesce(F.try_divide(F.lit(mixing.BLOCK), F.col("all")), F.lit(1.0))))).alias("fair"))


@query()
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share that each source reached."""
    return mixed_documents(spark, d)[1]
