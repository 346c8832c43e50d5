"""Repeated content inside single documents.

Words of a batch of documents form one array in which every document has its own alphabet, so a suffix array of the batch
is a suffix array of each document. It is refined by prefix doubling: in each round only positions whose rank is still
shared are sorted again, and most are alone after two words. Neighbours' common prefixes come from the rank tables of the
rounds, highest power first. Intervals of suffixes that share at least `run` words give the repeated spans; their union is
what a document says again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower-cased after they are found."""
    if not text:
        return []
    if "İ" in text:  # its lower case holds a mark that would end the word
        return [w.lower() for w in WORDS.findall(text)]
    return WORDS.findall(text.lower())


def suffix_ranks(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks by the first 1, 2, 4, ... words of every suffix, up to the level at which no two suffixes tie.

    codes: word codes, distinct between documents. ends: for each position the end of its document. Returned are the order
    of the suffixes (ties at documents' ends broken by position) and the table of each level.
    """
    n = len(codes)
    rank = codes.astype(np.int64)
    levels = [rank]
    tied = np.flatnonzero(np.bincount(rank, minlength=1)[rank] > 1) if n else np.empty(0, np.int64)
    step = 1
    position = np.arange(n)
    while len(tied):
        # room: suffixes that end within the step are alone at this level, whatever they share
        nxt = tied + step
        inside = nxt < ends[tied]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[tied]))
        t, s, f = tied[order], second[order], rank[tied][order]
        new = np.ones(len(t), bool)
        new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1]) | (s[1:] == 0)
        # Ranks stay comparable: the group's first rank plus the offset inside the group.
        group = np.ones(len(t), bool)
        group[1:] = f[1:] != f[:-1]
        first = np.maximum.accumulate(np.where(group, np.arange(len(t)), 0))
        head = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
        fresh = rank.copy()
        fresh[t] = f + (head - first)
        levels.append(fresh)
        alone = new & np.append(new[1:], True)
        tied = np.sort(t[~alone])
        rank = fresh
        step *= 2
    return np.lexsort((position, rank)), levels


def dense_start(codes: np.ndarray) -> np.ndarray:
    """Codes as ranks that leave room for the refinement: the number of smaller positions' codes."""
    counts = np.bincount(codes)
    return (np.cumsum(counts) - counts)[codes]


def common_prefix(a: np.ndarray, b: np.ndarray, ends: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that the suffixes at a and b share, by the rank tables from the highest power down."""
    n = len(levels[0])
    got = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + got, b + got
        fits = (x + (1 << k) <= ends[a]) & (y + (1 << k) <= ends[b])
        same = fits & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        got += same * (1 << k)
    return got


def batch_repetition(texts: list[str | None], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its words, the words inside repeated runs, and the longest repeat in words."""
    lists = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    total = int(sizes.sum())
    zero = np.zeros(len(lists), np.int64)
    if total == 0:
        return sizes, zero, zero.copy()
    flat = pa.array([w for ws in lists for w in ws]).dictionary_encode()
    document = np.repeat(np.arange(len(lists)), sizes)
    word = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    codes, _ = pd.factorize(document * (int(word.max()) + 1) + word)
    starts = np.cumsum(sizes) - sizes
    ends = np.repeat(starts + sizes, sizes)
    order, levels = suffix_ranks(dense_start(codes), ends)
    a, b = order[:-1], order[1:]
    close = np.flatnonzero(levels[0][a] == levels[0][b])
    lcp = np.zeros(total, np.int64)
    lcp[close + 1] = common_prefix(a[close], b[close], ends, levels)
    longest = zero.copy()
    np.maximum.at(longest, document[order], np.where(lcp >= run, lcp, 0))
    # Intervals of neighbours that share a run; in each all but the earliest position repeat it.
    linked = lcp >= run
    interval = np.cumsum(~linked)
    member = linked | np.append(linked[1:], False)
    at, of = order[member], interval[member]
    repeated = zero
    if len(at):
        earliest = np.full(int(of.max()) + 1, total, np.int64)
        np.minimum.at(earliest, of, at)
        begins = at[at != earliest[of]]
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, begins, 1)
        np.add.at(edge, begins + run, -1)
        covered = np.cumsum(edge[:-1]) > 0
        repeated = np.bincount(document[covered], minlength=len(lists)).astype(np.int64)
    return sizes, repeated, longest


def repetition(df: DataFrame, key: str = "doc_id", text: str = "text", run: int = 8, batch_chars: int = 2_000_000) -> DataFrame:
    """Share of repeated words of each row: (key, n_words, repeated_words, repeated_share, longest_repeat).

    A word is repeated if it lies in a run of `run` words that also begins at an earlier word of the same text. Null, blank
    and wordless texts have no words and share 0. Rows are kept as they are: a key that comes twice comes out twice, a null
    key stays null. Other columns are ignored. Whole texts are read; no shuffle is needed.
    """
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            parts, begin, chars = [], 0, 0
            for i, t in enumerate(texts):
                chars += len(t or "")
                if chars >= batch_chars or i == len(texts) - 1:
                    parts.append(batch_repetition(texts[begin : i + 1], run))
                    begin, chars = i + 1, 0
            n, repeated, longest = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
            share = np.divide(repeated, n, out=np.zeros(len(n)), where=n > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(repeated), pa.array(share), pa.array(longest)], ["key", "n_words", "repeated_words", "repeated_share", "longest_repeat"])

    out = source.mapInArrow(work, f"key {kind}, n_words bigint, repeated_words bigint, repeated_share double, longest_repeat bigint")
    return out.withColumnRenamed("key", key)
