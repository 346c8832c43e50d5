"""Queries of the entity graph over chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.operators import graph
from docloom.plans import dialect as D
from docloom.plans.registry import query
from docloom.plans.text import chunks
from docloom.session import cut, table

NORMAL = r"regexp_replace(regexp_replace(lower(regexp_replace(name, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '^[ .,:;()\[\]]+|[ .,:;()\[\]]+$', '', 'g')"
STOP = ", ".join(f"'{w}'" for w in graph.STOP_TERMS)
MENTIONS = f"""raw AS (SELECT id, source, text, section_path FROM c),
    tn AS (SELECT id, source, unnest(list_distinct(list_concat(list_filter(regexp_extract_all(coalesce(text, ''), '{graph.TERM}'), lambda t: length(t) >= 3 AND lower(t) NOT IN ({STOP})), coalesce(section_path, [])))) AS name, 'term' AS type FROM raw
    UNION ALL SELECT id, source, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '{graph.QUANTITY}'))), 'quantity' FROM raw),
    men AS (SELECT id AS chunk_id, source, name, type, {NORMAL} AS key FROM tn), m AS (SELECT * FROM men WHERE length(key) BETWEEN 2 AND 120)"""
FOLDED = r"""cn AS (SELECT key, count(DISTINCT chunk_id) AS n, max(name = upper(name)) AS capital FROM m GROUP BY key),
    ba AS (SELECT *, regexp_replace(key, '[^a-z0-9]', '', 'g') AS b0 FROM cn), bb AS (SELECT key, n, capital, CASE WHEN length(b0) > 4 AND ends_with(b0, 's') AND NOT ends_with(b0, 'ss') THEN substr(b0, 1, length(b0) - 1) ELSE b0 END AS base FROM ba),
    bc AS (SELECT *, first_value(key) OVER (PARTITION BY base ORDER BY n DESC, length(key), key) AS dest FROM bb WHERE length(base) >= 4), fo AS (SELECT key, dest FROM bc WHERE key <> dest),
    wl AS (SELECT key AS dest, list_filter(regexp_split_to_array(key, '[\s\-]+'), lambda w: w <> '') AS w FROM cn), wi AS (SELECT array_to_string(list_transform(w, lambda x: substr(x, 1, 1)), '') AS key, min(dest) AS dest FROM wl WHERE len(w) BETWEEN 2 AND 6 GROUP BY 1),
    ac AS (SELECT cn.key, wi.dest FROM cn JOIN wi USING (key) WHERE capital AND length(cn.key) BETWEEN 2 AND 6 AND NOT contains(cn.key, ' ') AND cn.key <> wi.dest AND cn.key NOT IN (SELECT key FROM fo)),
    al AS (SELECT * FROM fo UNION ALL SELECT * FROM ac), va AS (SELECT al.key, coalesce(f2.dest, al.dest) AS dest FROM al LEFT JOIN fo f2 ON al.dest = f2.key), vb AS (SELECT * FROM va WHERE key <> dest),
    re AS (SELECT coalesce(vb.dest, m.key) AS key, chunk_id, min(type) AS type, min(name) AS name, min(source) AS source FROM m LEFT JOIN vb ON m.key = vb.key GROUP BY 1, 2),
    en AS (SELECT key, min(type) AS type, min(name) AS name, count(DISTINCT chunk_id) AS chunks, count(DISTINCT source) AS sources FROM re GROUP BY key)"""
EDGES = """sa AS (SELECT chunk_id, key FROM re JOIN en USING (key) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY CASE WHEN en.type = 'quantity' THEN 0 ELSE 1 END, chunks DESC, key) <= 12),
    ro AS (SELECT c.section_path[1] AS root, key, count(DISTINCT chunk_id) AS n FROM re JOIN c ON re.chunk_id = c.id WHERE len(c.section_path) > 0 GROUP BY ALL HAVING count(DISTINCT chunk_id) > 1),
    rp AS (SELECT root, key FROM ro QUALIFY row_number() OVER (PARTITION BY root ORDER BY key) <= 10),
    ed AS (SELECT a.key AS src, b.key AS dst, 'co_occurs' AS relation, a.chunk_id, 0.4::DOUBLE AS weight FROM sa a JOIN sa b ON a.chunk_id = b.chunk_id AND a.key < b.key
    UNION ALL SELECT DISTINCT a.key, b.key, 'same_section', '', 0.2::DOUBLE FROM rp a JOIN rp b ON a.root = b.root AND a.key < b.key)"""
GRAPH = f"{D.CHUNKS}, {MENTIONS}, {FOLDED}, {EDGES}"


@query(f"WITH {D.CHUNKS}, {MENTIONS} SELECT DISTINCT chunk_id, name, type, key FROM m")
def graph_mentions(spark: SparkSession, d: str) -> DataFrame:
    return graph.mentions(chunks(spark, d)).select("chunk_id", "name", "type", "key")


@query(f"WITH {D.CHUNKS}, {MENTIONS}, {FOLDED} SELECT key, type, name, chunks, sources FROM en")
def graph_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities after variants and acronyms are folded."""
    return graph.build(chunks(spark, d))[1]


@query(f"WITH {D.CHUNKS}, {MENTIONS}, {FOLDED} SELECT key, dest AS canonical FROM vb")
def graph_variants(spark: SparkSession, d: str) -> DataFrame:
    return graph.variants(cut(graph.mentions(chunks(spark, d)))).withColumnRenamed("to", "canonical")


@query(f"WITH {GRAPH} SELECT src, dst, relation, chunk_id, weight FROM ed")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.build(chunks(spark, d))[2]


@query(f"WITH {GRAPH} SELECT src, dst, relation, min(chunk_id) AS chunk_id FROM ed WHERE src <> dst GROUP BY ALL")
def graph_unique_edges(spark: SparkSession, d: str) -> DataFrame:
    """The first edge of each pair and relation."""
    return graph.unique_edges(graph.build(chunks(spark, d))[2]).drop("weight")


@query(f"WITH {D.CHUNKS}, {MENTIONS}, {FOLDED}, w AS (SELECT DISTINCT coalesce(vb.dest, m.key) AS key, name FROM m LEFT JOIN vb ON m.key = vb.key) SELECT key, min(name) AS name, array_to_string(list_sort(list(name))[2:], '|') AS aliases FROM w GROUP BY key")
def graph_names(spark: SparkSession, d: str) -> DataFrame:
    """Every way in which an entity is written."""
    return graph.entity_names(cut(graph.mentions(chunks(spark, d)))).select("key", "name", F.array_join("aliases", "|").alias("aliases"))


@query(f"WITH {GRAPH} SELECT key, chunks, sources FROM en")
def graph_merged(spark: SparkSession, d: str) -> DataFrame:
    """Entities of one graph made from the mentions of two halves of the files."""
    found = cut(graph.mentions(chunks(spark, d)))
    half = F.pmod(F.xxhash64("source"), F.lit(2))
    none = spark.createDataFrame([], "src string, dst string, relation string, chunk_id string, weight double")
    return graph.merge_graphs([(found.where(half == 0), none), (found.where(half.isNull() | (half == 1)), none)])[1].select("key", "chunks", "sources")


PATHS = f"""{GRAPH}, un AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed), de AS (SELECT a AS key, count(*) AS n FROM un GROUP BY a), lo AS (SELECT key, row_number() OVER (ORDER BY n, key) AS i FROM de WHERE n >= 3 ORDER BY i LIMIT 20),
    pa AS (SELECT x.key AS src, y.key AS dst FROM lo x JOIN lo y ON y.i = x.i + 1), p1 AS (SELECT pa.src, pa.dst, [pa.src, u.b] AS path FROM pa JOIN un u ON u.a = pa.src),
    p2 AS (SELECT p1.src, p1.dst, list_append(path, u.b) AS path FROM p1 JOIN un u ON u.a = path[2] WHERE path[2] <> dst AND NOT list_contains(path, u.b)),
    p3 AS (SELECT p2.src, p2.dst, list_append(path, u.b) AS path FROM p2 JOIN un u ON u.a = path[3] AND u.b = p2.dst WHERE path[3] <> dst AND NOT list_contains(path, u.b)),
    al2 AS (SELECT * FROM p1 WHERE path[2] = dst UNION ALL SELECT * FROM p2 WHERE path[3] = dst UNION ALL SELECT * FROM p3)"""


@query(f"WITH {PATHS} SELECT src, dst, array_to_string(path, '>') AS path, len(path) - 1 AS hops, row_number() OVER (PARTITION BY src, dst ORDER BY len(path), path) AS rank FROM al2 QUALIFY rank <= 16")
def graph_paths(spark: SparkSession, d: str) -> DataFrame:
    """The shortest simple paths between entities with few links."""
    edges = graph.build(chunks(spark, d))[2]
    near = cut(graph.undirected(edges))
    few = near.groupBy(F.col("a").alias("key")).agg(F.count("*").alias("n")).where("n >= 3").orderBy("n", "key").limit(20)
    low = cut(few.withColumn("i", F.row_number().over(Window.orderBy("n", "key"))))
    ends = low.select(F.col("key").alias("src"), "i").join(low.select(F.col("key").alias("dst"), (F.col("i") - 1).alias("i")), "i").select("src", "dst")
    out = graph.simple_paths(edges, ends)
    return out.select("src", "dst", F.array_join("path", ">").alias("path"), "hops", "rank")


@query(f"WITH {D.CHUNKS}, {MENTIONS}, {FOLDED} SELECT type, count(*) AS entities FROM en GROUP BY type")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.build(chunks(spark, d))[1].groupBy("type").agg(F.count("*").alias("entities"))


@query(
    f"""WITH {GRAPH}, sole AS (SELECT key AS a, key AS b, sources, chunks FROM en WHERE sources > 1), pr AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ed),
    wh AS (SELECT DISTINCT key, source FROM re WHERE source IS NOT NULL), sh AS (SELECT DISTINCT a, b FROM pr JOIN wh x ON a = x.key JOIN wh y ON b = y.key AND x.source = y.source),
    ap AS (SELECT pr.a, pr.b, ea.sources + eb.sources AS sources, ea.chunks FROM pr JOIN en ea ON pr.a = ea.key JOIN en eb ON pr.b = eb.key ANTI JOIN sh ON pr.a = sh.a AND pr.b = sh.b WHERE ea.sources > 0 AND eb.sources > 0)
    SELECT a, b, sources, chunks FROM (SELECT * FROM sole UNION ALL SELECT * FROM ap) ORDER BY sources DESC, chunks DESC, a, b LIMIT 32"""
)
def cross_document(spark: SparkSession, d: str) -> DataFrame:
    """Seeds that connect documents."""
    return graph.cross_document_seeds(table(spark, d, "chunks"))


@query(
    f"""WITH {GRAPH}, un AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed), h2 AS (SELECT DISTINCT x.a, y.b FROM un x JOIN un y ON x.b = y.a WHERE x.a < y.b),
    h3 AS (SELECT a, b FROM h2 EXCEPT SELECT a, b FROM un), sh AS (SELECT DISTINCT a, b FROM h3 JOIN re x ON h3.a = x.key JOIN re y ON h3.b = y.key AND x.chunk_id = y.chunk_id), ok AS (SELECT a, b FROM h3 EXCEPT SELECT a, b FROM sh)
    SELECT a, b, 2 AS hops, ea.chunks + eb.chunks AS support FROM ok JOIN en ea ON a = ea.key JOIN en eb ON b = eb.key ORDER BY support DESC, a, b LIMIT 64"""
)
def bridging_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Entities in different chunks that are connected over others (the SQL gives the two-hop pairs, which fill the limit)."""
    return graph.bridging_pairs(*graph.build(chunks(spark, d)))
