"""A sample whose categories have given proportions.

Categories are the leaves of a tree. The sample's size goes down the tree: a node gets what its leaves want, as far as its rows
reach, and what one child can't take goes to its siblings; what none of them can take goes, one level up, to their cousins. At
a leaf the rows with the smallest permuted dense rank are drawn. The rank is taken in two steps, by hash bucket and inside the
one bucket where the quota ends, so a category of any size is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.session import cut

#: Path of each difficulty above the leaf: siblings share the whole path, cousins its beginning.
DIFFICULTY_TREE: dict[str, tuple[str, ...]] = {
    "trivial": ("closed", "easy"),
    "simple": ("closed", "easy"),
    "intermediate": ("closed", "medium"),
    "complex": ("closed", "hard"),
    "expert": ("closed", "hard"),
    "open_ended": ("open", "free"),
}
BUCKET_BITS = 12


def category_key(value: Column) -> Column:
    """Spellings of one category: lower case, only letters and digits, words joined by underscores; blank is null."""
    key = F.regexp_replace(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.when(key != "", key)


def rounded(shares: dict[str, float], total: int) -> dict[str, int]:
    """Whole numbers in the proportion of the shares that sum to the total, by largest remainders."""
    weight = sum(shares.values())
    if weight <= 0 or total <= 0:
        return dict.fromkeys(shares, 0)
    exact = {k: total * v / weight for k, v in shares.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def wanted_rows(targets: Mapping[str, tuple[float, int]], available: Mapping[str, int], size: int) -> dict[str, int]:
    """Rows that each leaf wants: its share of the size, but at least its minimum, as far as it exists; the largest pay for it."""
    want = rounded({k: s for k, (s, _) in targets.items()}, size)
    for k, (_, least) in sorted(targets.items()):
        need = min(least, available.get(k, 0)) - want[k]
        while need > 0:
            room = {j: want[j] - max(1, targets[j][1]) for j in want if j != k}
            payer = max(room, key=lambda j: (room[j], j), default=None)
            if payer is None or room[payer] <= 0:
                break
            step = min(need, max(1, room[payer] // 2))
            want[payer] -= step
            want[k] += step
            need -= step
    return want


def allocate(want: Mapping[str, int], available: Mapping[str, int], tree: Mapping[str, tuple[str, ...]]) -> dict[str, int]:
    """Rows to draw at each leaf, top down."""
    paths = {k: (*tree.get(k, ()), k) for k in want}

    def give(leaves: list[str], depth: int, quota: int) -> dict[str, int]:
        if len(leaves) == 1:
            return {leaves[0]: min(quota, available.get(leaves[0], 0))}
        children: dict[str, list[str]] = {}
        for k in leaves:
            children.setdefault(paths[k][depth] if depth < len(paths[k]) else k, []).append(k)
        if len(children) == 1:
            return give(leaves, depth + 1, quota)
        room = {c: sum(available.get(k, 0) for k in ks) for c, ks in children.items()}
        wish = {c: sum(want[k] for k in ks) for c, ks in children.items()}
        got = {c: min(n, room[c]) for c, n in rounded({c: wish[c] or 1e-9 for c in children}, quota).items()}
        while (left := min(quota, sum(room.values())) - sum(got.values())) > 0:
            open_ = {c: max(wish[c], 1e-9) for c in children if got[c] < room[c]}
            for c, n in rounded(open_, left).items():
                got[c] += min(n, room[c] - got[c])
        out: dict[str, int] = {}
        for c, ks in children.items():
            out |= give(ks, depth + 1, got[c])
        return out

    return give(sorted(want), 0, sum(want.values())) if want else {}


def category_sample(records: DataFrame, targets: DataFrame, size: int | None = None, fraction: float = 0.2, key: str = "id", category: str = "difficulty", tree: Mapping[str, tuple[str, ...]] = DIFFICULTY_TREE, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample: (key, category, rank). report: (category, target_share, min_rows, available, wanted, drawn,
    share, met), one row a target; met tells whether a leaf got what it wanted.

    targets: (difficulty, target_share, min_rows). The size is given or a fraction of the distinct keys. Spellings of one
    category count together; keys without a category or with one that has no target are not drawn. A key that repeats counts
    once, with its smallest category; null keys are left out; null shares and minima count as 0. Equal hashes are ordered by
    key, so the draw does not depend on the partitioning.
    """
    goal = {}
    for r in targets.select(category_key(F.col("difficulty")).alias("c"), "target_share", "min_rows").where("c is not null").groupBy("c").agg(F.sum("target_share").alias("s"), F.max("min_rows").alias("m")).collect():
        goal[r["c"]] = (r["s"] or 0.0, r["m"] or 0)
    rows = records.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(F.min(category_key(F.col(f"`{category}`"))).alias("category"))
    rows = cut(rows.withColumn("h", F.xxhash64("key", F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS).cast("int")))
    if size is None:
        size = round(fraction * rows.count())
    listed = rows.where(F.col("category").isin(list(goal)))
    counts: dict[str, dict[int, int]] = {k: {} for k in goal}
    for r in listed.groupBy("category", "bucket").count().collect():
        counts[r["category"]][r["bucket"]] = r["count"]
    available = {k: sum(c.values()) for k, c in counts.items()}
    want = wanted_rows(goal, available, size)
    quota = allocate(want, available, tree)
    edges = []  # (category, bucket, rows before it, quota), up to the bucket where the quota ends
    for k, c in counts.items():
        before = 0
        for b in sorted(c):
            if before >= quota.get(k, 0):
                break
            edges.append((k, b, before, quota[k]))
            before += c[b]
    spark = records.sparkSession
    # At most one row a target and bucket.
    edge = spark.createDataFrame(edges, "category string, bucket int, before bigint, quota bigint")
    near = listed.join(F.broadcast(edge), ["category", "bucket"])
    # Keys are distinct, so the number of a row in this order is its dense rank.
    rank = F.row_number().over(Window.partitionBy("category", "bucket").orderBy("h", "key"))
    sample = near.withColumn("rank", F.col("before") + rank).where("rank <= quota").select("key", "category", "rank")
    total = max(1, sum(quota.values()))
    report = [(k, s, m, available[k], want[k], quota.get(k, 0), quota.get(k, 0) / total, quota.get(k, 0) >= want[k]) for k, (s, m) in sorted(goal.items())]
    made = spark.createDataFrame(report, "category string, target_share double, min_rows int, available bigint, wanted bigint, drawn bigint, share double, met boolean")
    return sample.withColumnsRenamed({"key": key}), made
