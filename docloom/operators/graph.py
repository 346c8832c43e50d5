"""The entity graph over chunks: extraction, resolution of variants and acronyms, links, bounded search, seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.session import cut

# Capitalised words that name nothing.
STOP_TERMS = "the this that these those we our in as for table figure section however moreover thus".split()
#: Up to four capitalised words in a row; the class is spelled out as \b differs between engines.
TERM = r"[A-Z][A-Za-z0-9]*(?:[- ][A-Z][A-Za-z0-9]*){0,3}"
QUANTITY = r"-?\d+(?:\.\d+)?(?:[eE]-?\d+)? ?(?:%|percent|ms|GB|MB|tokens?|epochs?|layers?|steps?|kWh|rpm|mm|°C|dB|kPa)"
SALIENT, CO_OCCURS, SAME_SECTION = 12, 0.4, 0.2


def mentioned():
    """The (name, type, key) of a chunk's capitalised terms, section titles and quantities, once each."""
    text = T.text_of(F.col("text"))
    terms = F.filter(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(STOP_TERMS))
    titles = F.coalesce("section_path", F.array().cast("array<string>"))
    quantities = F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(0))
    named = F.concat(F.transform(F.concat(terms, titles), lambda t: F.struct(t.alias("name"), F.lit("term").alias("type"))), F.transform(quantities, lambda t: F.struct(t.alias("name"), F.lit("quantity").alias("type"))))
    keyed = F.transform(F.array_distinct(named), lambda m: F.struct(m["name"].alias("name"), m["type"].alias("type"), T.normalized_name(m["name"]).alias("key")))
    return F.filter(keyed, lambda m: F.length(m["key"]).between(2, 120))


def mentions(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source, name, type): capitalised terms, section titles and quantities of each chunk, once each."""
    # explode would let the optimiser test the arrays' sizes first, with every regular expression run once more.
    rows = chunks.select(F.col("id").alias("chunk_id"), "source", F.explode_outer(mentioned()).alias("m"))
    return rows.select("chunk_id", "source", "m.name", "m.type", "m.key").where("key is not null")


def compact_mentions(chunks: DataFrame) -> DataFrame:
    """(chunk, source, root, m): one row a chunk, with hashes of its id, its source and its root section, and m its keys in order and
    their marks: 1 for an all-capital name, 2 for a quantity. Rows that repeat an id are copies. A row a mention would take more
    space than the chunks."""
    mark = lambda m: (F.when(m["name"] == F.upper(m["name"]), 1).otherwise(0) + F.when(m["type"] == "quantity", 2).otherwise(0)).cast("byte")
    pairs = F.array_sort(F.array_distinct(F.transform(mentioned(), lambda m: F.struct(m["key"].alias("key"), mark(m).alias("mark")))))
    apart = T.let(pairs, lambda p: F.struct(F.transform(p, lambda x: x["key"]).alias("keys"), F.transform(p, lambda x: x["mark"]).alias("marks")))
    root = F.try_element_at("section_path", F.lit(1))
    hashed = lambda c: F.when(c.isNotNull(), F.xxhash64(c))
    # Copies are left out after the texts have become keys: these are what is shuffled.
    rows = chunks.where("id is not null").select(F.xxhash64("id").alias("chunk"), hashed(F.col("source")).alias("source"), hashed(root).alias("root"), apart.alias("m"))
    return rows.groupBy("chunk").agg(*[F.first(c).alias(c) for c in ("source", "root", "m")])


def compact_rows(compact: DataFrame) -> DataFrame:
    """(chunk, source, root, key, mark, one): a row a chunk, key and mark; `one` is 1 in the first row of a chunk and key, else 0."""
    each = F.transform("m.keys", lambda k, i: F.struct(k.alias("key"), F.get("m.marks", i).alias("mark"), F.when(F.coalesce(k == F.get("m.keys", i - 1), F.lit(False)), 0).otherwise(1).alias("one")))
    return compact.select("chunk", "source", "root", F.explode_outer(each).alias("e")).where("e.key is not null").select("chunk", "source", "root", "e.key", "e.mark", "e.one")


def variants(found: DataFrame) -> DataFrame:
    """(key, to): keys that differ only in punctuation, spacing or a plural s go to the one in most chunks (then the shortest,
    then the smallest); an all-capital acronym of two to six letters goes to the first key with these initials."""
    counts = found.groupBy("key").agg(F.countDistinct("chunk_id").alias("n"), F.max(F.col("name") == F.upper("name")).alias("capital"))
    groups = counts.withColumn("base", T.collapsed_name(F.col("key"))).where("length(base) >= 4")
    best = groups.groupBy("base").agg(F.min(F.struct((-F.col("n")).alias("n"), F.length("key").alias("l"), "key")).alias("b"), F.count("*").alias("size")).where("size > 1")
    folded = groups.join(best.select("base", F.col("b.key").alias("to")), "base").where("key <> to").select("key", "to")
    return with_acronyms(folded, counts.select("key"), counts.where("capital").select("key"))


def with_acronyms(folded: DataFrame, keys: DataFrame, capital: DataFrame) -> DataFrame:
    """variants() from the folded keys (key, to), all keys and those written in capitals anywhere."""
    words = F.filter(F.split("key", r"[\s\-]+"), lambda w: w != "")
    long = keys.select(F.col("key").alias("to"), words.alias("w")).where("size(w) between 2 and 6")
    initials = long.groupBy(F.array_join(F.transform("w", lambda w: F.substring(w, 1, 1)), "").alias("key")).agg(F.min("to").alias("to"))
    short = capital.where("length(key) between 2 and 6 and key not like '% %'").select("key").distinct()
    acronyms = short.join(initials, "key").where("key <> to").join(folded, "key", "left_anti").select("key", "to")
    # A chain of two steps at most: the expansion may itself be a folded variant.
    both = folded.unionByName(acronyms)
    again = folded.select(F.col("key").alias("to"), F.col("to").alias("end"))
    return both.join(again, "to", "left").select("key", F.coalesce("end", "to").alias("to")).where("key <> to")


def resolved(found: DataFrame) -> DataFrame:
    """The mentions with variants renamed, once a chunk and key; a quantity keeps its type before a term."""
    renamed = found.join(variants(found), "key", "left").withColumn("key", F.coalesce("to", "key"))
    return renamed.groupBy("key", "chunk_id").agg(F.min("type").alias("type"), F.min("name").alias("name"), F.min("source").alias("source"))


def entities(found: DataFrame) -> DataFrame:
    """(key, type, name, chunks, sources): one row an entity."""
    # A mention is one row a chunk, so rows are chunks, and sources are the rows of the first step.
    per = found.groupBy("key", "source").agg(F.min("type").alias("type"), F.min("name").alias("name"), F.count("*").alias("n"))
    return per.groupBy("key").agg(F.min("type").alias("type"), F.min("name").alias("name"), F.sum("n").alias("chunks"), F.count("source").alias("sources"))


def entity_names(found: DataFrame) -> DataFrame:
    """(key, name, aliases, value) from mentions before they are merged: all ways in which each entity is written, and for a
    quantity its number. The smallest way is the name, the others are aliases."""
    renamed = found.join(variants(found), "key", "left").withColumn("key", F.coalesce("to", "key"))
    ways = renamed.groupBy("key", "name").agg(F.min("type").alias("type"))
    per = ways.groupBy("key").agg(F.array_sort(F.collect_list("name")).alias("names"), F.min("type").alias("type"))
    value = F.when(F.col("type") == "quantity", F.regexp_extract(F.col("names")[0], r"-?\d+(?:\.\d+)?", 0)).otherwise("")
    return per.select("key", F.col("names")[0].alias("name"), F.slice("names", 2, F.size("names")).alias("aliases"), value.alias("value"))


def unique_edges(edges: DataFrame) -> DataFrame:
    """One edge a (src, dst, relation): that of the smallest chunk; loops are left out."""
    first = edges.where("src <> dst").groupBy("src", "dst", "relation").agg(F.min(F.struct("chunk_id", "weight")).alias("e"))
    return first.select("src", "dst", "relation", "e.chunk_id", "e.weight")


def merge_graphs(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions, entities, edges) of one graph from several (mentions, edges): variants are folded over all of them, edges follow
    their ends' new keys and count once, edges without both ends are left out."""
    found, edges = (reduce(DataFrame.unionByName, [p[i] for p in parts]) for i in (0, 1))
    found = cut(found.select("key", "chunk_id", "type", "name", "source"))
    fold = cut(variants(found))
    merged = cut(found.join(fold, "key", "left").withColumn("key", F.coalesce("to", "key")).groupBy("key", "chunk_id").agg(F.min("type").alias("type"), F.min("name").alias("name"), F.min("source").alias("source")))
    known = cut(entities(merged))
    for end in ("src", "dst"):
        edges = edges.join(fold.withColumnsRenamed({"key": end, "to": "new"}), end, "left").withColumn(end, F.coalesce("new", end)).drop("new").join(known.select(F.col("key").alias(end)), end, "left_semi")
    return merged, known, cut(unique_edges(edges.select("src", "dst", "relation", "chunk_id", "weight")))


def model_pass(chunks: DataFrame, backend, longest: int = 6000) -> tuple[DataFrame, DataFrame]:
    """(mentions, edges) that a model finds: entities with a type, and relations between them whose ends are mentions too.
    Long chunks are asked about window by window; replies that can't be read give nothing."""
    from docloom.model.client import completed
    from docloom.model.synth import chunk_inputs, one_object, prompt, windowed

    rows = windowed(chunk_inputs(chunks), longest)
    text = prompt("entities", "List the entities of the source and how they are related, as a JSON object with entities (name, type) and relations (source, relation, target).", F.col("window"))
    asked = cut(completed(rows.select("id", "source", text.alias("prompt")), backend, most=1400, json_reply=True).where("ok").select("id", "source", one_object(F.col("reply"), "entities array<struct<name:string,type:string>>, relations array<struct<source:string,target:string,relation:string>>").alias("r")))
    ends = asked.select("id", "source", F.explode("r.relations").alias("x")).where("trim(x.source) <> '' and trim(x.target) <> ''")
    entity = lambda name, kind: F.struct(name.alias("name"), kind.alias("type"))
    named = asked.select("id", "source", F.explode("r.entities").alias("e")).select("id", "source", entity(F.col("e.name"), F.coalesce(F.lower("e.type"), F.lit("entity"))).alias("m"))
    sides = ends.select("id", "source", F.explode(F.array(entity(F.col("x.source"), F.lit("entity")), entity(F.col("x.target"), F.lit("entity")))).alias("m"))
    found = named.unionByName(sides).select(F.col("id").alias("chunk_id"), "source", "m.name", "m.type", T.normalized_name(F.col("m.name")).alias("key")).where("length(key) between 2 and 120")
    # A mention with a type of its own counts before one that is only the end of a relation.
    best = F.min(F.struct((F.col("type") == "entity").alias("plain"), "name", "type")).alias("m")
    found = found.groupBy("chunk_id", "source", "key").agg(best).select("chunk_id", "source", "m.name", "m.type", "key")
    edges = ends.select(T.normalized_name(F.col("x.source")).alias("src"), T.normalized_name(F.col("x.target")).alias("dst"), F.coalesce("x.relation", F.lit("related_to")).alias("relation"), F.col("id").alias("chunk_id"), F.lit(1.0).alias("weight"))
    return found, unique_edges(edges.where("length(src) between 2 and 120 and length(dst) between 2 and 120"))


def simple_paths(edges: DataFrame, ends: DataFrame, hops: int = 3, most: int = 16) -> DataFrame:
    """(src, dst, path, hops, rank): for each pair of ends the `most` shortest paths of at most `hops` edges that visit no entity
    twice, ties by the keys on the way. Steps only go to entities that are near enough to the other end."""
    near = undirected(edges)
    ends = cut(ends.select("src", "dst").where("src <> dst").distinct())
    back = within_hops(edges, ends.select(F.col("dst").alias("key")).distinct(), hops - 1).select(F.col("seed").alias("dst"), F.col("key").alias("at"), F.col("hops").alias("left"))
    back = cut(back)
    open_, done = ends.withColumn("path", F.array("src")), None
    for step in range(1, hops + 1):
        out = open_.withColumn("a", F.element_at("path", -1)).join(near, "a").where(~F.array_contains("path", F.col("b")))
        out = out.select("src", "dst", F.concat("path", F.array("b")).alias("path"), F.col("b").alias("at")).join(back.where(F.col("left") <= hops - step), ["dst", "at"])
        out = cut(out.select("src", "dst", "path", "left"))
        found = out.where("left = 0").select("src", "dst", "path", F.lit(step).alias("hops"))
        done = found if done is None else done.unionByName(found)
        open_ = out.where("left > 0").select("src", "dst", "path")
    rank = F.row_number().over(Window.partitionBy("src", "dst").orderBy("hops", "path"))
    return done.withColumn("rank", rank).where(F.col("rank") <= most)

def co_occurrence(found: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst, relation, chunk_id, weight): pairs among the SALIENT entities of each chunk: quantities first, then by chunks, then by key."""
    rows = found.select("chunk_id", "key").join(known.select("key", "type", "chunks"), "key")
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.when(F.col("type") == "quantity", 0).otherwise(1), F.desc("chunks"), "key"))
    kept = rows.withColumn("r", rank).where(F.col("r") <= SALIENT).select("chunk_id", "key", "r")
    # At most SALIENT rows a chunk, so its pairs are made inside one array, without a join.
    own = kept.groupBy("chunk_id").agg(F.array_sort(F.collect_list("key")).alias("ks"))
    pairs = F.flatten(F.transform("ks", lambda a, i: F.transform(F.slice("ks", i + 2, F.size("ks")), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    return own.select("chunk_id", F.explode(pairs).alias("p")).select("p.src", "p.dst", F.lit("co_occurs").alias("relation"), "chunk_id", F.lit(CO_OCCURS).alias("weight"))


def same_section(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(src, dst, relation, chunk_id, weight): pairs among the first ten entities (by key) that are in several chunks of one root section."""
    roots = chunks.where("size(section_path) > 0").select(F.col("id").alias("chunk_id"), F.col("section_path")[0].alias("root"))
    rows = found.join(roots, "chunk_id").groupBy("root", "key").agg(F.countDistinct("chunk_id").alias("n")).where("n > 1")
    return section_pairs(rows).select("src", "dst", F.lit("same_section").alias("relation"), F.lit("").alias("chunk_id"), F.lit(SAME_SECTION).alias("weight")).distinct()


def build(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions, entities, edges) of the chunks."""
    # The mentions are used several times while variants are found: their regular expressions shall run once.
    found = cut(resolved(cut(mentions(chunks))))
    known = cut(entities(found))
    edges = co_occurrence(found, known).unionByName(same_section(found, chunks)).where("src <> dst")
    return found, known, cut(edges)


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) both ways, once."""
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(seed, key, hops): every entity within some hops of each seed by its shortest path, the seed itself at 0."""
    near = undirected(edges)
    reached = seeds.select(F.col("key").alias("seed"), "key", F.lit(0).alias("hops"))
    frontier = reached
    for step in range(1, hops + 1):
        out = frontier.join(near, F.col("key") == F.col("a")).select("seed", F.col("b").alias("key")).distinct()
        frontier = cut(out.join(reached, ["seed", "key"], "left_anti").withColumn("hops", F.lit(step)))
        reached = reached.unionByName(frontier)
    return reached


def bridging_pairs(found: DataFrame, known: DataFrame, edges: DataFrame, limit: int = 64, first: int = 16) -> DataFrame:
    """(a, b, hops, support): pairs of entities in disjoint sets of chunks that are two or three hops apart, ordered by hops,
    then by the number of their chunks (largest first), then by keys; the first `limit`.

    Two-hop pairs come first, and the support of a pair with disjoint chunks is the sum of the two counts. So it is enough to
    search outwards from the entities with the most chunks: a pair with neither end among them has at most twice the count of
    the last of them. Once `limit` pairs are above that, no other pair can enter; until then the searched set grows fourfold.
    """
    ranked = known.select("key", "chunks").orderBy(F.desc("chunks"), "key")
    total, size = known.count(), first
    while True:
        heads = cut(ranked.limit(size))
        edge = heads.agg(F.min("chunks")).first()[0] or 0
        whole = size >= total
        spread = within_hops(edges.select("src", "dst"), heads, 2 if not whole else 3)
        far = spread.where("hops >= 2").join(known.select("key", F.col("chunks").alias("n2")), "key").join(heads.select(F.col("key").alias("seed"), F.col("chunks").alias("n1")), "seed")
        # Chunks of the heads meet the chunks of all entities once: pairs with one in common are out.
        own = found.select(F.col("key").alias("seed"), "chunk_id").join(heads.select(F.col("key").alias("seed")), "seed", "left_semi")
        shared = own.join(found.select("key", "chunk_id"), "chunk_id").select("seed", "key").distinct()
        pairs = far.join(shared, ["seed", "key"], "left_anti").select(F.least("seed", "key").alias("a"), F.greatest("seed", "key").alias("b"), "hops", (F.col("n1") + F.col("n2")).alias("support")).distinct()
        result = cut(pairs.orderBy("hops", F.desc("support"), "a", "b").limit(limit))
        sure = result.where((F.col("hops") == 2) & (F.col("support") > 2 * edge)).count()
        if whole or sure >= limit:
            return result
        size *= 4


def section_pairs(counted: DataFrame) -> DataFrame:
    """(src, dst): pairs among the first ten keys of each root of (root, key)."""
    rank = F.row_number().over(Window.partitionBy("root").orderBy("key"))
    own = counted.withColumn("r", rank).where("r <= 10").groupBy("root").agg(F.array_sort(F.collect_list("key")).alias("ks"))
    pairs = F.flatten(F.transform("ks", lambda a, i: F.transform(F.slice("ks", i + 2, F.size("ks")), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    return own.select(F.explode(pairs).alias("p")).select("p.src", "p.dst")


def cross_document_seeds(chunks: DataFrame, limit: int = 32) -> DataFrame:
    """cross_document() of the graph of the chunks, without the graph: mentions are counted by entity, source and root section, and
    links inside a chunk are made only where the chunk has no source, as others say nothing here."""
    compact = cut(compact_mentions(chunks))
    rows = compact_rows(compact)
    # Keys are counted where those with the same base meet, so that they are shuffled once.
    based = rows.select("key", "one", T.collapsed_name(F.col("key")).alias("base")).where("length(base) >= 4").repartition("base")
    best = F.first("key").over(Window.partitionBy("base").orderBy(F.desc("n"), F.length("key"), "key"))
    folded = cut(based.groupBy("base", "key").agg(F.sum("one").alias("n")).withColumn("to", best).where("key <> to").select("key", "to"))
    fold = cut(with_acronyms(folded, rows.select("key"), rows.where(F.col("mark").bitwiseAND(1) > 0).select("key")))
    # Keys that take part in a fold; a key that others go to stays, unless it goes to another one itself.
    goes = fold.select("key", F.struct(F.lit(1).alias("own"), "to").alias("x")).unionByName(fold.select(F.col("to").alias("key"), F.struct(F.lit(0).alias("own"), "to").alias("x")))
    goes = cut(goes.groupBy("key").agg(F.max("x").alias("x")).select("key", "x.to"))

    # The mentions meet their fold by key and are counted there; an entity in one chunk, of one key, is in no seed and goes no further.
    own = [F.col("key"), F.col("to"), F.when(F.col("to").isNotNull(), F.col("chunk")).alias("chunk"), F.col("source"), F.col("root")]
    once = rows.join(goes, "key", "left").groupBy(*own).agg(F.sum("one").alias("n"), F.max("mark").alias("mark"))
    once = once.withColumn("total", F.sum("n").over(Window.partitionBy("key"))).where("total > 1 or to is not null").withColumn("key", F.coalesce("to", "key"))
    # Only entities that several keys have become can be twice in a chunk.
    once = once.groupBy("key", "chunk", "source", "root").agg(F.sum("n").alias("n"), F.max("mark").alias("mark"))
    per = cut(once.groupBy("key", "source", "root").agg(F.sum(F.when(F.col("chunk").isNotNull(), 1).otherwise(F.col("n"))).alias("n"), F.max("mark").alias("mark")))
    kind = lambda c: F.when(c >= 2, "quantity").otherwise("term")
    known = cut(per.groupBy("key").agg(kind(F.max("mark")).alias("type"), F.sum("n").alias("chunks"), F.countDistinct("source").alias("sources")))
    edges = section_pairs(per.where("root is not null").groupBy("root", "key").agg(F.sum("n").alias("n")).where("n > 1")).select("src", "dst", F.lit("same_section").alias("relation"))
    bare = compact.where("source is null")
    if not bare.isEmpty():
        found = cut(compact_rows(bare).join(goes, "key", "left").groupBy(F.coalesce("to", "key").alias("key"), F.col("chunk").alias("chunk_id")).agg(F.max("mark").alias("mark")))
        ranked = found.groupBy("key").agg(F.max("mark").alias("mark")).join(known, "key", "left").select("key", F.coalesce("type", kind(F.col("mark"))).alias("type"), F.coalesce("chunks", F.lit(1)).alias("chunks"))
        edges = edges.unionByName(co_occurrence(found, ranked).select("src", "dst", "relation"))
    return cross_document(per.select("key", "source"), known, edges, limit)


def cross_document(found: DataFrame, known: DataFrame, edges: DataFrame, limit: int = 32) -> DataFrame:
    """(a, b, sources, chunks): entities of several sources with themselves, and linked entities that share no source; ordered
    by the number of sources together, then by the chunks of the first, then by keys; the first `limit`."""
    alone = cut(known.where("sources > 1").select(F.col("key").alias("a"), F.col("key").alias("b"), "sources", "chunks").orderBy(F.desc("sources"), F.desc("chunks"), "a").limit(limit))
    where = found.select("key", "source").where("source is not null").distinct()
    # Entities that occur in one chunk share its source, so their link says nothing here, unless that chunk has none.
    if found.where("source is null").isEmpty():
        edges = edges.where("relation <> 'co_occurs'")
    counts = known.select("key", "sources", "chunks")
    named = lambda end, *more: counts.select(F.col("key").alias(end), F.col("sources").alias(f"s{end}"), *more)
    linked = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    pairs = linked.join(named("a", "chunks"), "a").join(named("b"), "b").where("sa > 0 and sb > 0")
    # The entities of several sources fill the list down to some number of sources; pairs with fewer can't enter it.
    edge = alone.agg(F.count("*").alias("n"), F.min("sources").alias("least")).first()
    if edge["n"] >= limit:
        pairs = pairs.where(F.col("sa") + F.col("sb") >= edge["least"])
    # Two entities with more sources together than there are share one.
    pairs = cut(pairs.where(F.col("sa") + F.col("sb") <= where.agg(F.countDistinct("source")).first()[0]))
    # The sources of the rarer end are looked for among those of the other: a frequent entity's are not written out for each link.
    rarer = F.col("sa") <= F.col("sb")
    left = pairs.select("a", "b", F.when(rarer, F.col("a")).otherwise(F.col("b")).alias("key"), F.when(rarer, F.col("b")).otherwise(F.col("a")).alias("other")).join(where, "key")
    shared = left.select("a", "b", "other", "source").join(where.withColumnRenamed("key", "other"), ["other", "source"], "left_semi").select("a", "b").distinct()
    apart = pairs.join(shared, ["a", "b"], "left_anti").select("a", "b", (F.col("sa") + F.col("sb")).alias("sources"), "chunks")
    return alone.unionByName(apart).orderBy(F.desc("sources"), F.desc("chunks"), "a", "b").limit(limit)
