"""Splits that keep related records together: records that name a common file, directly or over other records.

Files are the vertices, and a record links the files it names. Components are found by breadth-first expansion of many seeds at
once: every vertex whose hash is the smallest among its neighbours is a seed, frontiers grow by one join a round on hash-
partitioned adjacency lists, and an edge between two seeds' territories is a collision. Collisions make a smaller graph of
seed labels, with at most half the vertices: it is finished in one task if it has at most `small` edges, else treated the same
way. Every graph goes through the frontiers first, whatever its size. Nothing of this is collected to the driver.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.session import cut

log = logging.getLogger("docloom.llm")
#: Edges of a graph of collided seeds that one task finishes.
SMALL = 200_000
#: Hash buckets over which cumulated sizes are taken in two steps.
BUCKETS = 4096
#: A component with this share of all records or more is placed by itself; there can be at most 1 / HEAVY of them.
HEAVY = 0.005


def file_key(name: Column) -> Column:
    """What the spellings of one file have in common: the lower-cased last part of the path without surrounding blanks, URL
    escapes resolved, query and fragment left out. Blank names have none."""
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(name, r"\+", "%2B")), name)
    plain = F.regexp_replace(plain, r"^\s+|\s+$", "")
    plain = F.regexp_replace(plain, r"(?i)^([a-z][a-z0-9+.-]*://[^?#]*)[?#].*$", "$1")
    last = F.lower(F.regexp_replace(F.regexp_extract(plain, r"([^/\\]*)[/\\]*$", 1), r"^[\s\"'<]+|[\s\"'>]+$", ""))
    return F.when(last != "", last)


def named_files(records: DataFrame) -> DataFrame:
    """(id, key): every file that a record names in prov.source or prov.sources, once; records without any are left out."""
    names = F.concat(F.array("prov.source"), F.coalesce("prov.sources", F.array().cast("array<string>")))
    rows = records.select("id", F.explode(F.array_distinct(F.transform(names, file_key))).alias("key"))
    return rows.where("key is not null").distinct()


def record_links(named: DataFrame) -> DataFrame:
    """(a, b), a < b: for each record its smallest file with every other one, once over all records."""
    first = named.groupBy("id").agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1").select("id", "a")
    return named.join(first, "id").where("key > a").select("a", F.col("key").alias("b")).distinct()


def one_task(edges: DataFrame) -> DataFrame:
    """(v, root) of a small graph by breadth-first search in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: dict = {}
        for frame in frames:
            for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
                near.setdefault(a, []).append(b)
                near.setdefault(b, []).append(a)
        root: dict = {}
        for seed in sorted(near):
            if seed in root:
                continue
            root[seed], frontier = seed, [seed]
            while frontier:
                frontier = [w for v in frontier for w in near[v] if w not in root and not root.__setitem__(w, seed)]
        yield pd.DataFrame({"v": pd.Series(list(root), dtype=object), "root": pd.Series(list(root.values()), dtype=object)})

    return edges.coalesce(1).mapInPandas(work, f"v {kind}, root {kind}")


def territories(edges: DataFrame) -> DataFrame:
    """(v, seed): every vertex with the seed whose frontier reached it first.

    The adjacency lists are dealt to partitions by the hash of their vertex once and stay there; only frontiers travel, and what
    a round reached is appended to what earlier rounds did, never written again.
    """
    lists = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition("a").persist(StorageLevel.DISK_ONLY)
    order = F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))
    mine = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v"))
    # Seeds have the smallest hash of their neighbourhood; the rest joins them frontier by frontier.
    least = lists.groupBy("a").agg(F.min(order).alias("m"))
    frontier = cut(least.where(mine <= F.col("m")).select(F.col("a").alias("v"), F.col("a").alias("seed")))
    rounds = []
    while not frontier.isEmpty():
        rounds.append(frontier)
        step = frontier.join(lists, F.col("v") == F.col("a")).select(F.col("b").alias("v"), "seed").groupBy("v").agg(F.min("seed").alias("seed"))
        known = reduce(DataFrame.unionByName, rounds).select("v")
        frontier = cut(step.join(known, "v", "left_anti"))
    lists.unpersist()
    log.info("components: %d frontiers", len(rounds))
    return reduce(DataFrame.unionByName, rounds) if rounds else frontier


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(v, root): every vertex of the edges (a, b) with a vertex that stands for its component. Loops, repeated and null edges
    are allowed and change nothing; a vertex only in loops is its own component. A graph of any size is expanded by frontiers;
    only what is left after that, the graph of the seeds whose territories met, is finished in one task if it has at most
    `small` edges."""
    edges = cut(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    reached = territories(edges)
    owner = reached.select(F.col("v").alias("a"), F.col("seed").alias("sa"))
    other = reached.select(F.col("v").alias("b"), F.col("seed").alias("sb"))
    collisions = edges.join(owner, "a").join(other, "b").where("sa <> sb").select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"))
    met = cut(collisions.distinct())
    left = met.count()
    log.info("components: %d collisions of seeds, finished %s", left, "in one task" if left <= small else "by frontiers again")
    if not left:
        return reached.withColumnRenamed("seed", "root")
    roots = (one_task(met) if left <= small else components(met, small)).withColumnRenamed("v", "seed")
    return reached.join(roots, "seed", "left").select("v", F.coalesce("root", "seed").alias("root"))


def file_groups(records: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(named, groups): the files of the records and (key, root) for every named file."""
    named = cut(named_files(records))
    linked = components(record_links(named), small).withColumnRenamed("v", "key")
    keys = named.select("key").distinct()
    return named, keys.join(linked, "key", "left").select("key", F.coalesce("root", "key").alias("root"))


def registered_files(records: DataFrame, files: DataFrame, small: int = SMALL) -> DataFrame:
    """(root, source): every file of the registry that a record names, with the key of a file that stands for its component."""
    _, groups = file_groups(records, small)
    registry = files.where("source is not null").select("source", file_key(F.col("source")).alias("key")).distinct()
    return registry.join(groups, "key").select("root", "source")


def file_membership(records: DataFrame, files: DataFrame, small: int = SMALL) -> DataFrame:
    """(source, first_source, files): every file of the registry that a record names, the smallest file of its component and
    how many files of the registry the component has."""
    placed = cut(registered_files(records, files, small))
    sizes = placed.groupBy("root").agg(F.min("source").alias("first_source"), F.count("*").alias("files"))
    return placed.join(sizes, "root").select("source", "first_source", "files")


#: Members of a component that one block of the join of its pairs holds, about.
BLOCK = 2000


def linked_files(records: DataFrame, files: DataFrame, small: int = SMALL, expand: int | None = None, block: int = BLOCK) -> DataFrame:
    """(source_a, source_b), source_a < source_b: every pair of files of the registry in one component. Names that are not in
    the registry link others but come out in no pair. With `expand`, a component of more files is given by the pairs of its
    smallest file with every other, from which the rest follows. Large components are joined in pairs of blocks of members."""
    placed = registered_files(records, files, small)
    sizes = placed.groupBy("root").agg(F.count("*").alias("n"), F.min("source").alias("head"))
    sized = placed.join(sizes.where("n > 1"), "root")
    few = sized if expand is None else sized.where(F.col("n") <= expand)
    blocks = F.ceil(F.col("n") / block).cast("int")
    few = few.select("root", "source", F.pmod(F.xxhash64("source"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    left = few.select("root", F.col("own").alias("i"), F.col("other").alias("j"), F.col("source").alias("source_a"))
    right = few.select("root", F.col("other").alias("i"), F.col("own").alias("j"), F.col("source").alias("source_b"))
    pairs = left.join(right, ["root", "i", "j"]).where("source_a < source_b").select("source_a", "source_b")
    if expand is None:
        return pairs
    return pairs.unionByName(sized.where((F.col("n") > expand) & (F.col("source") > F.col("head"))).select(F.col("head").alias("source_a"), F.col("source").alias("source_b")))


def running_total(sizes: DataFrame, weight: str) -> DataFrame:
    """Adds `before`, the total weight of what comes earlier in (bucket, h) order, without sorting all rows in one task."""
    per = sizes.groupBy("bucket").agg(F.sum(weight).alias("w"))
    offset = per.select("bucket", (F.sum("w").over(Window.orderBy("bucket")) - F.col("w")).alias("offset"))
    inner = F.sum(weight).over(Window.partitionBy("bucket").orderBy("h", "root").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.join(F.broadcast(offset), "bucket").withColumn("before", F.col("offset") + F.coalesce(inner, F.lit(0)))


def grouped_split(records: DataFrame, targets: DataFrame, small: int = SMALL, seed: int = 17) -> DataFrame:
    """(id, root, split_name): every record once, all records of a component in one split.

    Shares are of records. Components of at least HEAVY of all records (at most 1 / HEAVY of them) go first, largest first,
    each to the split with the most room left. The others follow in the order of their hash and fill the rest of the splits
    one after the other. A record that names no file is a component of its own. Null ids are left out, repeated ids count
    once with all files their rows name. Targets are scaled to sum to one; a null share counts as 0.
    """
    wanted = [(r["split_name"], r["target_share"] or 0.0) for r in targets.groupBy("split_name").agg(F.max("target_share").alias("target_share")).where("split_name is not null").collect()]
    total_share = sum(s for _, s in wanted)
    if total_share <= 0:
        raise ValueError("the target shares must have a positive sum")
    wanted = sorted(((n, s / total_share) for n, s in wanted), key=lambda x: (-x[1], x[0]))
    records = records.where("id is not null")
    named, groups = file_groups(records, small)
    # One file is enough: all files of a record have the same root.
    first = named.groupBy("id").agg(F.min("key").alias("key"))
    ids = records.select("id").distinct().join(first, "id", "left")
    placed = ids.join(groups, "key", "left").select("id", F.coalesce("root", F.concat(F.lit("record:"), F.col("id").cast("string"))).alias("root"))
    placed = cut(placed)
    sizes = placed.groupBy("root").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("root", F.lit(seed)))
    sizes = cut(sizes.withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    heavy = sizes.where(F.col("n") >= max(2.0, HEAVY * total)).select("root", "n").orderBy(F.desc("n"), "root").collect()
    room = {n: s * total for n, s in wanted}
    fixed = {}
    for row in heavy:
        name = max(room, key=lambda k: (room[k], k))
        fixed[row["root"]] = name
        room[name] -= row["n"]
    rest = sizes
    if heavy:
        table = sizes.sparkSession.createDataFrame(list(fixed.items()), "root string, split_name string")
        rest = sizes.join(F.broadcast(table.select("root")), "root", "left_anti")
        big = table.select("root", "split_name")
    # The remaining room of each split as an interval of the remaining records.
    open_room = {n: max(0.0, room[n]) for n, _ in wanted}
    scale = (total - sum(r["n"] for r in heavy)) / max(sum(open_room.values()), 1e-9)
    edge, choice = 0.0, F.lit(wanted[-1][0])
    bounds = []
    for n, _ in wanted:
        edge += open_room[n] * scale
        bounds.append((edge, n))
    for edge, n in reversed(bounds[:-1]):
        choice = F.when(F.col("before") + F.col("n") / 2 <= edge, n).otherwise(choice)
    light = running_total(rest, "n").select("root", choice.alias("split_name"))
    return placed.join(light.unionByName(big) if heavy else light, "root").select("id", "root", "split_name")
