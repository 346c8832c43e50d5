"""Filling containers of fixed capacity with items.

Items are dealt to shards by hash; a shard holds some thousand containers' worth whatever the input's size. In a shard items
are first placed best-fit from the largest down. A local search then works on the containers that are not full: it moves an
item to a fuller container, exchanges one item for one, or two for one, whenever that increases the sum of squared fills, and
so empties the least filled ones. What still lies in poorly filled containers is dealt to fewer shards and packed again.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut

#: Containers' worth of items in a shard; rounds of packing; fill below which a container's items are packed again.
SHARD, ROUNDS, REOPEN = 1024, 3, 0.985


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Positions of the items in each container, the largest items first, each into the container with the least room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r is set if a container has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            b, r = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        room[r - size].append(b)
        mask |= 1 << (r - size)
    return bins


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int, passes: int = 8) -> list[list[int]]:
    """Local search among the containers with room; every step increases the sum of squared fills."""
    size = sizes.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    for _ in range(passes):
        changed = False
        loose = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b])
        for at, giver in enumerate(loose):
            for taker in reversed(loose[at + 1 :]):
                gap = capacity - fill[taker]
                if gap <= 0 or fill[taker] < fill[giver] or not bins[giver]:
                    continue
                give = sorted((size[i], i) for i in bins[giver])
                take = sorted((size[i], i) for i in bins[taker])
                best = (0, None, ())
                # Move, or exchange one for one: the largest gain that fits the gap.
                for s, i in give:
                    if s <= gap and s > best[0]:
                        best = (s, i, ())
                    k = bisect.bisect_left(take, (s - gap, -1))
                    if k < len(take) and 0 < s - take[k][0] <= gap and s - take[k][0] > best[0]:
                        best = (s - take[k][0], i, (take[k][1],))
                if best[0] < gap:
                    # Two for one: two small items of the fuller container for one of the other.
                    for s, i in give:
                        low, high = 0, len(take) - 1
                        while low < high:
                            gain = s - take[low][0] - take[high][0]
                            if gain > gap:
                                low += 1
                            else:
                                if gain > best[0]:
                                    best = (gain, i, (take[low][1], take[high][1]))
                                high -= 1
                gain, i, back = best
                if i is None:
                    continue
                bins[giver].remove(i)
                bins[taker].append(i)
                for j in back:
                    bins[taker].remove(j)
                    bins[giver].append(j)
                fill[giver], fill[taker], changed = fill[giver] - gain, fill[taker] + gain, True
        if not changed:
            break
    return [b for b in bins if b]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item."""
    out = np.zeros(len(sizes), np.int64)
    for n, b in enumerate(improve(best_fit(sizes, capacity), sizes, capacity)):
        out[b] = n
    return out


def in_turn(work, turn: int):
    """A function of the frame alone: Spark reads a second parameter as the group's key."""
    return lambda frame: work(frame, turn)


def containers(sizes: DataFrame, key: str, capacity: int, size: str = "tokens", shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """(container, key, part, begin, tokens): where each row's content goes.

    Only a row larger than a container is divided: into parts that fill whole containers and a rest that is placed like any
    other item; `begin` is the part's offset in tokens. Rows of size 0 or null need no container and don't come out. Of rows
    that repeat a key the largest counts; a null key is a key like any other.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    rows = sizes.groupBy(F.col(f"`{key}`").alias("key")).agg(F.max(f"`{size}`").cast("bigint").alias("n")).where("n > 0")
    whole = F.floor((F.col("n") - F.when(F.col("n") <= capacity, F.col("n")).otherwise(0)) / capacity).cast("int")
    rows = cut(rows.withColumn("whole", whole).withColumn("rest", F.col("n") - F.col("whole") * capacity))
    kind = rows.schema["key"].dataType.simpleString()
    full = rows.where("whole > 0").select("key", "n", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("part"))
    name = F.concat(F.lit("full-"), F.sha1(F.to_json(F.struct("key", "part"), {"ignoreNullFields": "false"})))
    done = [full.select(name.alias("container"), "key", "part", (F.col("part") * F.lit(capacity).cast("bigint")).alias("begin"), F.lit(capacity).cast("bigint").alias("tokens"))]
    items = rows.where("rest > 0").select("key", F.col("whole").alias("part"), (F.col("whole") * F.lit(capacity).cast("bigint")).alias("begin"), F.col("rest").alias("tokens"))
    schema = f"container string, key {kind}, part int, begin bigint, tokens bigint, fill bigint"
    for turn in range(rounds):
        total = items.agg(F.sum("tokens")).first()[0]
        if not total:
            break
        shards = max(1, round(total / (capacity * shard)))
        last = turn == rounds - 1 or shards == 1

        def work(frame: pd.DataFrame, turn: int) -> pd.DataFrame:
            frame = frame.assign(order=frame["key"].astype(str)).sort_values(["tokens", "order", "part"], ascending=[False, True, True])
            at = pack(frame["tokens"].to_numpy(), capacity)
            label = f"{turn}-{frame['shard'].iloc[0]}-"
            fill = np.bincount(at, frame["tokens"].to_numpy()).astype(np.int64)
            out = frame[["key", "part", "begin", "tokens"]].copy()
            out.insert(0, "container", [label + str(x) for x in at])
            out["fill"] = fill[at]
            return out

        dealt = items.withColumn("shard", F.pmod(F.xxhash64("key", "part", F.lit(turn)), F.lit(shards)).cast("int"))
        # A number of partitions that is asked for stays: shards are few bytes and much work, and would be merged into one task.
        packed = cut(dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(in_turn(work, turn), schema))
        close = F.lit(True) if last else F.col("fill") >= REOPEN * capacity
        done.append(packed.where(close).drop("fill"))
        if last:
            break
        items = packed.where(~close).select("key", "part", "begin", "tokens")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumnRenamed("key", key)


def fill_report(placed: DataFrame, capacity: int) -> DataFrame:
    """(containers, tokens, least_possible, fill): how full the containers are, and the number that the total would need."""
    per = placed.groupBy("container").agg(F.sum("tokens").alias("n"))
    total = F.sum("n")
    return per.agg(F.count("*").alias("containers"), total.alias("tokens"), F.ceil(total / capacity).alias("least_possible"), (total / (F.count("*") * capacity)).alias("fill"))
