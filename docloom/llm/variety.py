"""Choosing a varied subset by determinantal greedy selection.

A record is a unit vector: hashed words of its question weighted by rarity over all records, next to its difficulty and task.
The kernel of two records is a power of their cosine, and a subset's determinant grows with its variety; similar records add
next to nothing once one of them is in. Rows are dealt to parts by hash; each part's greedy choice of at least the subset's
size is its core-set; core-sets are dealt and reduced again until one part holds them, and a last greedy pass picks the
subset. Each pass updates a Cholesky factor by one column a choice.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import word_list
from docloom.llm.sampling import category_key
from docloom.session import cut

#: Word dimensions, word classes that are counted, weights of difficulty and task, least rows of a part and of a core-set.
WIDTH, CLASSES, SIDE, PART, CORE = 192, 1 << 15, (0.45, 0.35), 16_384, 256


def greedy(vectors: np.ndarray, size: int, power: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of choice and their gains; ties go to the earlier row. Stops where nothing new is left."""
    n = len(vectors)
    size = min(size, n)
    gain = np.ones(n)
    factor = np.zeros((size, n), np.float32)
    chosen, gains = [], []
    for k in range(size):
        j = int(gain.argmax())
        if gain[j] <= 1e-6:
            break
        chosen.append(j)
        gains.append(float(gain[j]))
        kernel = np.maximum(vectors @ vectors[j], 0) ** power
        column = (kernel - factor[:k, j] @ factor[:k]) / math.sqrt(gain[j])
        factor[k] = column
        gain -= column.astype(np.float64) ** 2
        gain[j] = -np.inf
    return np.array(chosen, np.int64), np.array(gains)


def vectors_of(words: list[np.ndarray], labels: list[tuple[str, str]], weight: np.ndarray) -> np.ndarray:
    """Unit vectors; words are class numbers."""
    n = len(words)
    out = np.zeros((n, WIDTH), np.float32)
    sizes = [len(w) for w in words]
    if sum(sizes):
        flat = np.concatenate([np.asarray(w, np.int64) for w in words if len(w)])
        row = np.repeat(np.arange(n), sizes)
        sign = np.where(flat // WIDTH % 2, 1.0, -1.0) * weight[flat]
        np.add.at(out, (row, flat % WIDTH), sign)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    parts = [out]
    for k, share in enumerate(SIDE):
        names = sorted({x[k] for x in labels})
        place = {x: i for i, x in enumerate(names)}
        side = np.zeros((n, len(names)), np.float32)
        side[np.arange(n), [place[x[k]] for x in labels]] = share
        parts.append(side)
    full = np.hstack(parts)
    return full / np.linalg.norm(full, axis=1, keepdims=True)


def at_most(choose, most: int):
    return lambda frame: choose(frame, most)


def varied_subset(records: DataFrame, size: int | None = None, key: str = "id", text: str = "question", difficulty: str = "difficulty", task: str = "task", part: int = PART, core: int = CORE) -> DataFrame:
    """(key, rank, gain, difficulty, task): `size` rows in the order of choice, by default the square root of the number of keys.

    Every row of the table takes part; a key that repeats counts once, null keys are left out. Null or blank texts are rows
    without words, null categories a category of their own; spellings of one category count together. If fewer rows have
    anything new, fewer come out. Every part hands on `size` rows, at least `core`, and holds `part` rows or, if that is more,
    four times what it hands on; so each pass chooses among more rows than it returns.
    """
    word_classes = F.transform(F.array_distinct(word_list(F.col(f"`{text}`"))), lambda w: F.pmod(F.xxhash64(w), F.lit(CLASSES)).cast("int"))
    rows = records.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.struct(word_classes.alias("w"), F.coalesce(category_key(F.col(f"`{difficulty}`")), F.lit("")).alias("d"), F.coalesce(category_key(F.col(f"`{task}`")), F.lit("")).alias("t")).alias("x"))
    rows = cut(rows.groupBy("key").agg(F.min("x").alias("x")).select("key", "x.w", "x.d", "x.t"))
    total = rows.count()
    size = math.ceil(math.sqrt(total)) if size is None else size
    counts = np.zeros(CLASSES)
    for r in rows.select(F.explode("w").alias("c")).groupBy("c").count().collect():
        counts[r["c"]] = r["count"]
    weight = np.log1p(max(1, total) / (1.0 + counts)).astype(np.float64)
    shared = records.sparkSession.sparkContext.broadcast(weight)
    kind = rows.schema["key"].dataType.simpleString()

    def choose(frame: pd.DataFrame, most: int) -> pd.DataFrame:
        frame = frame.assign(order=pd.util.hash_array(frame["key"].astype(str).to_numpy(object)), name=frame["key"].astype(str)).sort_values(["order", "name"])
        vectors = vectors_of(frame["w"].tolist(), list(zip(frame["d"], frame["t"])), shared.value)
        at, gains = greedy(vectors, most)
        out = frame.iloc[at][["key", "w", "d", "t"]].copy()
        out["rank"], out["gain"] = np.arange(1, len(at) + 1), gains
        return out

    schema = f"key {kind}, w array<int>, d string, t string, rank int, gain double"
    hand_on = max(size, core)
    held = max(part, 4 * hand_on)
    turn, left = 0, total
    # Parts hold four times what they hand on, so a pass leaves at most half of the rows.
    while left > held:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(math.ceil(left / held))))
        rows = cut(dealt.groupBy("part").applyInPandas(at_most(choose, hand_on), schema).select("key", "w", "d", "t"))
        left, turn = rows.count(), turn + 1
    final = rows.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(at_most(choose, size), schema)
    return final.select(F.col("key").alias(key), "rank", "gain", F.col("d").alias(difficulty), F.col("t").alias(task))
