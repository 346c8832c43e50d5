"""Mixing sources to target weights.

Each source's documents, in the order of their hash, form one stream of tokens that is cut into blocks of fixed length. The
plan gives each source its share of the blocks to draw, no source more than its blocks times its repeats; what a source can't
give goes to the others by weight. The output is dealt in shards: a multinomial draw gives each shard its number of blocks of
each source, and a slot's position among all draws of its source is mapped to a block by a pseudorandom permutation of the
source's block numbers, one pass of the permutation after another. Slots and blocks meet in one sort-merge join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.session import cut

BLOCK, SLOTS, BUCKETS, MOST_SOURCES = 512, 8192, 4096, 10_000


def permuted(x: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size-1: four Feistel rounds over the next even number of bits, walked until inside."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & low
        for r in range(4):
            k = np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            mix = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            mix ^= mix >> np.uint64(31)
            mix *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (mix >> np.uint64(29)) & low
        return left << shift | right

    out = once(x.astype(np.uint64))
    while (outside := out >= np.uint64(size)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def blocks_of(sizes: DataFrame, block: int) -> DataFrame:
    """(source, block, doc_id, begin, tokens): the pieces of documents in each block of their source's stream."""
    rows = sizes.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    per = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("w"))
    offsets = per.select("source", "bucket", (F.sum("w").over(Window.partitionBy("source").orderBy("bucket")) - F.col("w")).alias("offset"))
    inner = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.join(offsets, ["source", "bucket"]).withColumn("at", F.col("offset") + F.coalesce(inner, F.lit(0)))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("tokens") - 1) / block)
    parts = placed.select("source", "doc_id", "at", "tokens", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * block - F.col("at"), F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("at"), F.col("tokens"))
    return parts.select("source", "block", "doc_id", begin.alias("begin"), (end - begin).alias("tokens"))


def plan(weights: dict[str, tuple[float, int]], available: dict[str, int], total: int) -> dict[str, float]:
    """Tokens to draw from each source: its weight's share of the total, at most what its repeats allow; the others take over."""
    most = {s: available.get(s, 0) * r for s, (_, r) in weights.items()}
    given = dict.fromkeys(weights, 0.0)
    open_ = {s for s in weights if most[s] > 0 and weights[s][0] > 0}
    left = float(total)
    while open_ and left > 1e-6:
        scale = left / sum(weights[s][0] for s in open_)
        tight = {s for s in open_ if given[s] + scale * weights[s][0] >= most[s]}
        for s in tight or open_:
            step = most[s] - given[s] if tight else scale * weights[s][0]
            given[s] += step
            left -= step
        open_ -= tight
        if not tight:
            break
    return given


def mixture(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK, slots: int = SLOTS, seed: int = 29) -> tuple[DataFrame, DataFrame]:
    """(rows, report). rows: (shard, slot, source, repeat, doc_id, begin, tokens), the pieces of each drawn block, begin in
    tokens of the document. report: (source, weight, max_repeats, available_tokens, drawn_tokens, share, repeats, met).

    sizes: (doc_id, source, tokens); targets: (source, weight, max_repeats), at most MOST_SOURCES rows. total_tokens is the
    size of the mixture, by default all tokens of the named sources. Weights are scaled to sum to one. No block comes more
    often than max_repeats, also where a multinomial draw asks for more: such slots go to sources with blocks left. Documents
    without tokens, null or unnamed sources give nothing; of rows that repeat a doc_id the largest counts; null weights and
    repeats count as 0; named sources without documents are in the report with share 0; met tells
    whether a source's plan reached its weight.
    """
    named = targets.where("source is not null").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).limit(MOST_SOURCES + 1).collect()
    if len(named) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    scale = sum(r["weight"] or 0 for r in named) or 1.0
    weights = {r["source"]: ((r["weight"] or 0) / scale, r["max_repeats"] or 0) for r in sorted(named, key=lambda r: r["source"])}
    spark = sizes.sparkSession
    kept = sizes.where(F.col("source").isin(list(weights)) & (F.col("tokens") > 0))
    kept = cut(kept.groupBy("doc_id").agg(F.max(F.struct(F.col("tokens").cast("bigint").alias("tokens"), "source")).alias("x")).select("doc_id", "x.source", "x.tokens"))
    available = {r["source"]: r["n"] for r in kept.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    n_blocks = {s: -(-n // block) for s, n in available.items()}
    given = plan(weights, available, total_tokens if total_tokens is not None else sum(available.values()))
    names = [s for s in weights if given[s] > 0 and s in n_blocks]
    n_slots = round(sum(given[s] for s in names) / block)
    shares = np.array([given[s] for s in names]) / max(1e-9, sum(given[s] for s in names))
    n_shards = -(-n_slots // slots) if names else 0

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"].tolist():
                n = min(slots, n_slots - shard * slots)
                counts = np.random.default_rng([seed, shard]).multinomial(n, shares)
                yield pd.DataFrame({"shard": shard, "k": range(len(names)), "n": counts, "slot": np.cumsum(counts) - counts})

    counts = cut(spark.range(n_shards).mapInPandas(draw, "shard bigint, k int, n bigint, slot bigint"))
    before = F.sum("n").over(Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("first", F.coalesce(before, F.lit(0)))
    drawn = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    # Draws beyond a source's limit continue in sources that have blocks left: (from source, first draw, count, to, draw there).
    limit = [n_blocks[s] * weights[s][1] for s in names]
    free = {k: limit[k] - drawn.get(k, 0) for k in range(len(names)) if limit[k] > drawn.get(k, 0)}
    moves = []
    for k in range(len(names)):
        over, at = drawn.get(k, 0) - limit[k], limit[k]
        while over > 0 and free:
            to = max(free, key=lambda x: (free[x], -x))
            n = min(over, free[to])
            moves.append((k, at, n, to, limit[to] - free[to]))
            free[to] -= n
            if not free[to]:
                del free[to]
            over, at = over - n, at + n
    sizes_of = [n_blocks[s] for s in names]

    def slot_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, k, n, slot, first in frame.itertuples(index=False):
                x = np.arange(first, first + n)
                source = np.full(n, k)
                valid = x < limit[k]
                for a, at, m, to, there in moves:
                    hit = (x >= at) & (x < at + m) & (a == k)
                    source[hit], x[hit] = to, x[hit] - at + there
                    valid |= hit
                slots_ = slot + np.arange(n)
                block_no, repeat = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for s in np.unique(source):
                    mine = source == s
                    repeat[mine] = x[mine] // sizes_of[s]
                    block_no[mine] = permuted(x[mine] % sizes_of[s], sizes_of[s], seed + int(s))
                # Plain objects: a filtered column of strings may be chunked, which Arrow structs refuse.
                label = np.array(names, object)[source[valid]]
                yield pd.DataFrame({"shard": np.full(len(label), shard), "slot": slots_[valid], "source": pd.Series(label, dtype=object), "block": block_no[valid], "repeat": repeat[valid]})

    drawn_slots = starts.select("shard", "k", "n", "slot", "first").mapInPandas(slot_rows, "shard bigint, slot bigint, source string, block bigint, repeat bigint")
    # The slots are made from a small table, so their number can't be estimated: without the hint they would all be broadcast.
    rows = drawn_slots.hint("merge").join(blocks_of(kept, block), ["source", "block"]).select("shard", "slot", "source", "repeat", "doc_id", "begin", "tokens")
    whole = sum(given.values())
    table = spark.createDataFrame([(s, w, r, int(available.get(s, 0)), given[s] + 1 >= w * whole and (w == 0 or given[s] > 0)) for s, (w, r) in weights.items()], "source string, weight double, max_repeats int, available_tokens bigint, met boolean")
    got = rows.groupBy("source").agg(F.sum("tokens").alias("drawn_tokens"), (F.max("repeat") + 1).alias("repeats"))
    joined = table.join(got, "source", "left").fillna(0, ["drawn_tokens", "repeats"])
    share = F.col("drawn_tokens") / F.sum("drawn_tokens").over(Window.partitionBy())
    report = joined.select("source", "weight", "max_repeats", "available_tokens", "drawn_tokens", share.alias("share"), "repeats", "met")
    return rows, report
