"""Near-duplicate texts: every pair whose word sets reach a Jaccard threshold, without comparing every two texts.

The texts' word sets are the rows of a sparse incidence matrix, and the overlaps of all pairs are its product with its own
transpose. The product is formed in blocks, and only where a pair can still reach the threshold:

* Equal word sets are one row (a class); its members are joined again at the end.
* Of a set of s words only the rarest s - ceil(t*s) + SHARED are multiplied: two sets that reach t share at least SHARED of
  them. Words come in one order for all sets: rarest first by their count over the whole collection.
* A column of the product is one word, or, for words in more than `hot` sets, one pair of such words. A column of one word has
  at most `hot` rows, whatever the size of the collection.
* Inside a column a pair is dropped at once if the sizes rule it out or if the parity sketches of the two sets differ in more
  bits than two sets over the threshold can differ in words.
* The products of all columns are added up for each pair. Pairs whose sum is below what their sizes demand are discarded; the
  rest is checked exactly on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import word_list
from docloom.session import cut

#: Parity sketch of a set: bits flipped once for each word, as three numbers of 64 bits.
SKETCH = 3
#: Words of the prefixes that two sets over the threshold share at least.
SHARED = 3
#: Bits of a map of hashes for each hash in it, its most bits (32 MB), and the bits that one task packs. Beyond MOST_BITS / 4
#: hashes a join takes the map's place.
BITS_EACH, MOST_BITS, PIECE = 16, 1 << 28, 1 << 18
#: Ids of a class that one block of the join of its pairs holds, about.
BLOCK = 2000
POSTING = "sig bigint, cls bigint, n int, " + ", ".join(f"s{i} bigint" for i in range(SKETCH))


def word_sets(df: DataFrame, key: str, text: str, salt: str) -> DataFrame:
    """(id, h, copy): the key, its sorted distinct words as 64-bit hashes and a hash of its text; null rows are left out."""
    words = F.transform(word_list(F.col(f"`{text}`")), lambda w: F.xxhash64(w, F.lit(salt)))
    rows = df.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{key}`").isNotNull())
    return rows.select(F.col(f"`{key}`").cast("string").alias("id"), F.array_sort(F.array_distinct(words)).alias("h"), F.xxhash64(F.col(f"`{text}`")).alias("copy"))


class BitMap:
    """Which slots of a table of hashes are taken: a hash that is in the map always hits, another one seldom."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def hit(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes.view(np.uint64) % np.uint64(8 * len(self.bits))
        return (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bit_map(hashes: DataFrame, n: int, most: int = MOST_BITS) -> BitMap | None:
    """The map of the column `h` of n hashes, of a size by their number; none if they are too many for the largest map. Pieces
    of it are packed on the executors; the driver only puts them together."""
    if 4 * n > most:
        return None
    size = min(most, 1 << max(10, math.ceil(math.log2(BITS_EACH * n + 1))))
    piece = min(PIECE, size)

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(piece, np.uint8)
        bits[frame["slot"].to_numpy(np.int64) % piece] = 1
        return pd.DataFrame({"part": [int(frame["slot"].iloc[0]) // piece], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    # The size is a power of two, so the low bits of a hash are its slot, for signed numbers too.
    slots = hashes.select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("slot")).distinct()
    out = np.zeros(size // 8, np.uint8)
    for row in slots.groupBy(F.floor(F.col("slot") / piece).alias("at")).applyInPandas(packed, "part bigint, bits binary").collect():
        begin = row["part"] * (piece // 8)
        out[begin : begin + piece // 8] = np.frombuffer(row["bits"], np.uint8)
    return BitMap(out)


class Words(NamedTuple):
    """Hashes (sorted) and counts of the most frequent words, the least count among them, and, if there are more words in
    several sets, a map of these: None if all are listed, or if they are too many for a map."""

    known: np.ndarray
    count: np.ndarray
    least: int
    others: BitMap | None


def common_words(sets: DataFrame, most: int, most_bits: int = MOST_BITS) -> Words:
    """What comes to the driver and is broadcast has a fixed bound: `least` is the smallest count of 2 or more for which at most
    `most` words remain."""
    counts = cut(sets.select(F.explode("h").alias("w")).groupBy("w").agg(F.count("*").alias("c")).where("c > 1"))
    # Counts by powers of 2^(1/4): some two hundred rows at any size.
    levels = counts.groupBy(F.floor(F.log2("c") * 4).cast("int").alias("level")).agg(F.count("*").alias("words"), F.min("c").alias("low")).orderBy(F.desc("level")).collect()
    total, least, rest = 0, 0, sum(row.words for row in levels)
    for row in levels:
        if total + row.words > most:
            break
        total, least, rest = total + row.words, int(row.low), rest - row.words
    if not rest:
        least = 2
    elif not total:
        least = max(row.low for row in levels) * 2 if levels else 2
    kept = counts.where(F.col("c") >= least).toPandas() if total else pd.DataFrame({"w": [], "c": []})
    order = np.argsort(kept["w"].to_numpy(np.int64), kind="stable")
    others = bit_map(counts.where(F.col("c") < least).select(F.col("w").alias("h")), rest, most_bits) if rest else None
    return Words(kept["w"].to_numpy(np.int64)[order], kept["c"].to_numpy(np.int64)[order], least, others)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for two hashes."""
    x = (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.view(np.uint64) + np.uint64(0x7F4A7C15))
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def sketches(values: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """SKETCH numbers a set: bit (word mod 64*SKETCH) flips for each word."""
    bit = (values.view(np.uint64) >> np.uint64(40)) % np.uint64(64 * SKETCH)
    out = []
    for i in range(SKETCH):
        mine = np.where(bit // np.uint64(64) == np.uint64(i), np.left_shift(np.uint64(1), bit % np.uint64(64)), np.uint64(0))
        out.append(np.bitwise_xor.reduceat(mine, starts).view(np.int64))
    return out


def postings(classes: DataFrame, words: Words, threshold: float, hot: int) -> DataFrame:
    """The product's rows: for each class one row a rare word of its prefix and one a pair of hot words of its prefix.

    A word of unknown count is in fewer than `least` sets; where these may be more than `hot`, it counts as hot.
    """
    spread = classes.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, least, others = spread.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cls = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy().astype(np.int64))
            starts = np.cumsum(sizes) - sizes
            at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
            often = np.where(known[at] == values, count[at], 0) if len(known) else np.zeros(len(values), np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((values, often, row))
            v, o = values[order], often[order]
            place = np.arange(len(v)) - np.repeat(starts, sizes)
            take = np.minimum(sizes, sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + SHARED)
            # A word in no other set can't be shared.
            shared = (o > 0) | ((least > 2) if others is None else others.hit(v))
            prefix = (place < np.repeat(take, sizes)) & shared
            rare = np.where(o > 0, o, least - 1) <= hot
            single = prefix & rare
            sig, of = [v[single]], [row[single]]
            many = np.flatnonzero(prefix & ~rare)
            begin = np.searchsorted(row[many], np.arange(len(sizes)))
            stop = np.append(begin[1:], len(many))
            for width in np.unique(stop - begin):
                if width < 2:
                    continue
                rows = np.flatnonzero(stop - begin == width)
                block = np.sort(v[many[begin[rows][:, None] + np.arange(width)]], axis=1)
                i, j = np.triu_indices(width, 1)
                sig.append(mixed(block[:, i].ravel(), block[:, j].ravel()))
                of.append(np.repeat(rows, len(i)))
            sig, of = np.concatenate(sig), np.concatenate(of)
            sketch = sketches(values, starts)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(cls[of]), pa.array(sizes[of].astype(np.int32))] + [pa.array(s[of]) for s in sketch], ["sig", "cls", "n"] + [f"s{i}" for i in range(SKETCH)])

    return classes.select("cls", "h").mapInArrow(work, POSTING)


def marked(sets: DataFrame, wanted: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(cls, h, hit): hit is true for the classes that are wanted, and for a few others. A map of their hashes, of a size by
    their number, is sent to the rows, so that word sets need no shuffle where their class needs no company; for too many
    classes a join tells exactly which are wanted."""
    wanted = cut(wanted.select("cls").distinct())
    taken = bit_map(wanted.select(F.col("cls").alias("h")), wanted.count(), most_bits)
    if taken is None:
        return sets.select("cls", "h").join(wanted.withColumn("hit", F.lit(True)), "cls", "left").select("cls", "h", F.coalesce("hit", F.lit(False)).alias("hit"))
    spread = sets.sparkSession.sparkContext.broadcast(taken)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = spread.value
        for batch in batches:
            hit = have.hit(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], ["cls", "h", "hit"])

    return sets.select("cls", "h").mapInArrow(work, "cls bigint, h array<bigint>, hit boolean")


def accumulated(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, columns): the sum of the product's columns of every pair that can still reach the threshold by it.

    Two sets over the threshold share at least t / (1 + t) * (|A| + |B|) words, and of their prefixes SHARED or, if that is
    fewer, all of these. r rare and h hot words shared are r + h (h - 1) / 2 columns: at least 2 for three words, 1 for two.
    """
    left = rows.select("sig", F.struct("n", "cls").alias("x"), *[F.col(f"s{i}").alias(f"x{i}") for i in range(SKETCH)])
    right = rows.select("sig", F.struct("n", "cls").alias("y"), *[F.col(f"s{i}").alias(f"y{i}") for i in range(SKETCH)])
    apart = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))))
    small, large = F.col("x.n"), F.col("y.n")
    # |A xor B| = |A| + |B| - 2 |A and B|, and |A and B| >= t / (1 + t) * (|A| + |B|).
    allowed = (small + large) * ((1 - threshold) / (1 + threshold))
    met = left.join(right, "sig").where((F.col("x") < F.col("y")) & (small >= large * threshold - 1e-9) & (apart <= allowed + 1e-9))
    summed = met.groupBy("x", "y").agg(F.count("*").alias("columns"))
    demanded = F.least(F.lit(SHARED), F.ceil((small + large) * (threshold / (1 + threshold)) - 1e-9)) - 1
    return summed.where(F.col("columns") >= demanded).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), "columns")


def similar_classes(classes: DataFrame, threshold: float, hot: int, listed: int, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b, similarity): every pair of classes over the threshold, a < b."""
    rows = postings(classes, common_words(classes, listed, most_bits), threshold, hot)
    candidates = cut(accumulated(rows, threshold).select("a", "b"))
    full = marked(classes, candidates.select(F.explode(F.array("a", "b")).alias("cls")), most_bits).where("hit").drop("hit")
    pairs = candidates.join(full.withColumnsRenamed({"cls": "a", "h": "ha"}), "a").join(full.withColumnsRenamed({"cls": "b", "h": "hb"}), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    pairs = pairs.select("a", "b", (shared / (F.size("ha") + F.size("hb") - shared)).alias("similarity"), shared.alias("shared"), (F.size("ha") + F.size("hb") - shared).alias("joined"))
    up, down = threshold.as_integer_ratio() if math.log2(threshold.as_integer_ratio()[1]) < 20 else (round(threshold * 10000), 10000)
    kept = pairs.where(F.col("shared") * down >= F.col("joined") * up)
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def near_duplicates(df: DataFrame, key: str = "id", text: str = "text", threshold: float = 0.75, hot: int = 128, listed: int = 1 << 20, salt: str = "", most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: (id, cls, copy), every row with its class of equal word sets and a hash of its text. links:
    (a, b, similarity), every pair of different classes whose Jaccard similarity of distinct words is at least the threshold.

    The result is exact (up to equal 64-bit hashes of different words). Null and wordless texts and null keys are in no
    class; rows that repeat a key count once for each different text. `hot`, `listed` and `most_bits` change the plan, not the
    result: beyond `hot` sets a word is joined only in pairs of words, at most `listed` words' counts are broadcast, and a map
    of hashes has at most `most_bits` bits.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must be above 0.5 and at most 1")
    sets = word_sets(df, key, text, salt)
    sets = cut(sets.where(F.size("h") > 0).select("id", "h", "copy", F.xxhash64("h", F.lit(7)).alias("cls")))
    members = sets.select("id", "cls", "copy").distinct()
    # Most classes have one row; only the others are brought together.
    several = sets.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1")
    split = marked(sets, several, most_bits)
    alone = split.where("not hit").select("cls", "h")
    classes = alone.unionByName(split.where("hit").groupBy("cls").agg(F.first("h").alias("h")))
    return members, similar_classes(cut(classes), threshold, hot, listed, most_bits)


#: Copies of one text up to which their pairs are written out.
EXPAND = 1000


def pair_rows(members: DataFrame, links: DataFrame, expand: int = EXPAND, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of different ids in one class or in two linked classes.

    More than `expand` copies of one text are given by their smallest id: that id comes with every copy, and it alone stands
    for the copies in pairs with other texts, from which all their other pairs follow. Pairs of different texts are all written
    out, those of large classes block by block.
    """
    sizes = members.groupBy("cls", "copy").agg(F.count("*").alias("copies"), F.min("id").alias("head"))
    sized = members.join(sizes, ["cls", "copy"])
    many = F.col("copies") > expand
    stars = sized.where(many & (F.col("id") > F.col("head"))).select(F.col("head").alias("x"), F.col("id").alias("y"))
    stand = cut(sized.where(~many | (F.col("id") == F.col("head"))).select("id", "cls").distinct())
    blocks = stand.groupBy("cls").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = stand.join(blocks, "cls").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    inside = placed.where("n > 1")
    left = inside.select("cls", F.col("own").alias("i"), every.alias("j"), F.col("id").alias("x"))
    right = inside.select("cls", every.alias("i"), F.col("own").alias("j"), F.col("id").alias("y"))
    same = left.join(right, ["cls", "i", "j"]).where("x < y").select("x", "y")
    ends = blocks.select("cls", every.alias("at"))
    cells = links.select("a", "b").join(ends.withColumnsRenamed({"cls": "a", "at": "i"}), "a").join(ends.withColumnsRenamed({"cls": "b", "at": "j"}), "b")
    x, y = placed.select(F.col("cls").alias("a"), F.col("own").alias("i"), F.col("id").alias("x")), placed.select(F.col("cls").alias("b"), F.col("own").alias("j"), F.col("id").alias("y"))
    across = cells.join(x, ["a", "i"]).join(y, ["b", "j"]).where("x <> y").select("x", "y")
    return same.unionByName(stars).unionByName(across).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def class_rows(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row a record and class: (id, cls, first_id, copies, links): its class, the class's smallest id, the number of its ids
    and of the classes linked to it."""
    ids = members.select("id", "cls").distinct()
    ends = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("links"))
    sizes = ids.groupBy("cls").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    return ids.join(sizes, "cls").join(ends, "cls", "left").select("id", "cls", "first_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
