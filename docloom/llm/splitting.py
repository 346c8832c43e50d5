"""Cutting oversized texts at natural boundaries by pointer doubling.

Every possible cut of a text is a node. One sorted merge joins each node to its farthest legal successor: the best kind of
boundary (paragraph, sentence or line, clause, word, any character) that still leaves the next piece, overlap included, under
the limit. The successor table is then squared again and again, and each square doubles the known part of the chain of cuts,
so a text of n cuts takes log2(n) array operations instead of a walk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of boundary from the strongest to the weakest; a cut lies at the end of the match.
BOUNDARIES = (re.compile(r"\n[ \t]*\n\s*"), re.compile(r"\n|[.!?…][\"'”»)\]]*\s+|[。！？]"), re.compile(r"[,;:|]\s+|\s[–—-]\s+"), re.compile(r"\s+"))
#: A stronger kind is taken only if its cut fills at least this share of the piece.
LEAST_FILL = 0.5
CHARS = 4


def boundary_nodes(text: str, reach: int) -> list[np.ndarray]:
    """Sorted cut positions of each kind, the weaker kinds containing the stronger; the last kind has a node at least every
    quarter of the reach, so that a successor always exists."""
    kinds, known = [], np.zeros(0, np.int64)
    for pattern in BOUNDARIES:
        found = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        known = np.union1d(known, found[(found > 0) & (found < len(text))])
        kinds.append(known)
    grid = np.arange(max(1, reach // 4), len(text), max(1, reach // 4))
    kinds.append(np.union1d(known, grid))
    return kinds


def cut_positions(text: str, most: int, overlap: int) -> list[int]:
    """Ends of the pieces; a piece begins `overlap` characters before the end of the one before it."""
    n = len(text)
    if n <= most:
        return [n]
    reach = most - overlap
    kinds = boundary_nodes(text, reach)
    nodes = np.append(kinds[-1], n)

    def farthest(begin: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The successor of each begin: the last boundary up to the limit of the strongest kind that fills the piece."""
        best = np.full(len(begin), -1, np.int64)
        floor = begin + ((limit - begin) * LEAST_FILL).astype(np.int64)
        for level, kind in enumerate(kinds):
            at = np.searchsorted(kind, limit, side="right") - 1
            found = np.where(at >= 0, kind[np.maximum(at, 0)] if len(kind) else -1, -1)
            ok = (best < 0) & (found > (floor if level < len(kinds) - 1 else begin))
            best = np.where(ok, found, best)
        return np.where(limit >= n, n, np.where(best < 0, limit, best))

    first = farthest(np.array([0]), np.array([most]))[0]
    successor = np.searchsorted(nodes, farthest(nodes, np.minimum(nodes + reach, n)))
    successor[-1] = len(nodes) - 1
    chain = np.array([np.searchsorted(nodes, first)])
    while chain[-1] != len(nodes) - 1:
        chain = np.concatenate([chain, successor[chain]])
        successor = successor[successor]
    return nodes[np.unique(chain)].tolist()


def pieces_of(text: str, most: int, overlap_tokens: int) -> list[tuple[int, int]]:
    """(begin, end) of every piece. The shared part has exactly overlap_tokens by the estimate of four characters a token;
    among the lengths with that estimate one that begins at a word is taken if there is one."""
    least = overlap_tokens * CHARS
    ends = cut_positions(text, most, least + CHARS - 1 if least else 0)
    out, begin = [], 0
    for end in ends:
        out.append((begin, end))
        begin = max(0, end - least)
        if least:
            for back in range(least, least + CHARS):
                at = end - back
                if at > 0 and text[at - 1].isspace() and not text[at].isspace():
                    begin = at
                    break
    return out


def oversized(df: DataFrame, text: str, max_tokens: int) -> DataFrame:
    """Rows whose text has more than max_tokens by greatest(1, floor(characters / 4)), whatever any other column says."""
    return df.where(F.greatest(F.lit(1), F.floor(F.length(F.col(f"`{text}`")) / CHARS)) > max_tokens)


def split_oversized(df: DataFrame, key: str = "id", text: str = "text", max_tokens: int = 900, overlap_tokens: int = 60) -> DataFrame:
    """Pieces of the oversized rows: (key, piece, n_pieces, begin, end, tokens, text), begin and end in characters.

    A piece has at most max_tokens. Consecutive pieces share overlap_tokens; without the shared parts they make up the text.
    Rows under the limit and null texts give nothing; of rows that repeat a key the one with the smallest text counts. A
    limit that is not above twice the overlap is refused. Only oversized rows are shuffled, once, to drop repeated keys.
    """
    if max_tokens <= 2 * overlap_tokens:
        raise ValueError("max_tokens must be more than twice overlap_tokens")
    most = max_tokens * CHARS + CHARS - 1
    big = oversized(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text", max_tokens)
    big = big.groupBy("key").agg(F.min("text").alias("text"))
    kind = big.schema["key"].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame["key"], frame["text"]):
                spans = pieces_of(t, most, overlap_tokens)
                rows += [(k, i, len(spans), a, b, max(1, (b - a) // CHARS), t[a:b]) for i, (a, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["key", "piece", "n_pieces", "begin", "end", "tokens", "text"])

    out = big.mapInPandas(work, f"key {kind}, piece int, n_pieces int, begin bigint, end bigint, tokens int, text string")
    return out.withColumnRenamed("key", key)
