"""Choosing records: balance of difficulty, deterministic samples, splits by source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.session import cut

#: Target shares of the difficulty buckets.
MIX = {"simple": 0.25, "intermediate": 0.45, "complex": 0.30}
BUCKETS = 4096


def smallest(df: DataFrame, n: dict[str, int], group: str, order: list) -> DataFrame:
    """The first n[g] rows of each group in an order that begins with a double between 0 and 1, `order[0]`.

    Rows are counted by group and slice of that double; only the one slice where a group's number ends is sorted, so a group
    of any size is never ranked in one task.
    """
    rows = df.withColumn("__slice", F.least(F.floor(order[0] * BUCKETS), F.lit(BUCKETS - 1)))
    edges, counts = [], {}
    for r in rows.groupBy(group, "__slice").count().collect():
        counts.setdefault(r[group], {})[r["__slice"]] = r["count"]
    for g, c in counts.items():
        left, last = n.get(g, 0), -1
        for b in sorted(c):
            last = b
            if c[b] >= left:
                break
            left -= c[b]
        edges.append((g, last, left))
    kind = df.schema[group].dataType.simpleString()
    edge = df.sparkSession.createDataFrame(edges, f"`{group}` {kind}, __last bigint, __left bigint")
    near = rows.join(F.broadcast(edge), group).where("__slice <= __last")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    inside = near.where("__slice = __last").withColumn("__rank", rank).where("__rank <= __left")
    return near.where("__slice < __last").select(*df.columns).unionByName(inside.select(*df.columns))


def balance(records: DataFrame, bucket: str = "bucket", quality: str = "quality", key: str = "id", mix: dict[str, float] = MIX, total: int | None = None) -> DataFrame:
    """Rows nearer to the target mix: of each bucket round(share * total) of the best quality, then the best of the rest up to
    the total, by default all rows. Ties go to the smaller key; null quality counts as 0. Quality lies between 0 and 1."""
    rows = records.withColumn(quality, F.coalesce(F.col(quality), F.lit(0.0)))
    rows = cut(rows)
    total = rows.count() if total is None else total
    order = [1.0 - F.col(quality), F.col(key)]
    first = smallest(rows, {k: round(v * total) for k, v in mix.items()}, bucket, order)
    taken = first.count()
    if taken >= total:
        return first
    rest = rows.join(first.select(key), key, "left_anti").withColumn("__all", F.lit("x"))
    return first.unionByName(smallest(rest, {"x": total - taken}, "__all", order).select(*first.columns))


def sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """The n rows whose md5 of seed and key is smallest: the same rows whatever the partitioning."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.orderBy(mark, key).limit(n)


def split_by_source(records: DataFrame, key: str = "id", source: str = "source", shares: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 7) -> DataFrame:
    """(key, split): whole sources in one split. Sources come in the order of their md5; a source goes where its middle falls
    when the sources' rows are laid end to end. Fewer than three sources are split by row in the same way. A null source is
    one source of its own."""
    rows = records.select(F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("unknown")).alias("s"))
    per = rows.groupBy("s").agg(F.count("*").alias("n"))
    few = len(per.limit(3).collect()) < 3
    unit = F.concat_ws(":", F.lit(str(seed)), F.col("key").cast("string")) if few else F.concat_ws(":", F.lit(str(seed)), F.col("s"))
    sizes = rows.withColumn("u", F.md5(unit)).groupBy("u").agg(F.count("*").alias("n")).withColumn("b", F.conv(F.substring("u", 1, 3), 16, 10).cast("int"))
    sizes = cut(sizes)
    per_bucket = sizes.groupBy("b").agg(F.sum("n").alias("w"))
    offset = per_bucket.select("b", (F.sum("w").over(Window.orderBy("b")) - F.col("w")).alias("offset"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.join(F.broadcast(offset), "b").withColumn("at", F.col("offset") + inner + F.col("n") / 2)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    a, b = shares[0] * total, (shares[0] + shares[1]) * total
    named = placed.select("u", F.when(F.col("at") <= a, "train").when(F.col("at") <= b, "validation").otherwise("test").alias("split"))
    return rows.withColumn("u", F.md5(unit)).join(named, "u").select(F.col("key").alias(key), "split")
