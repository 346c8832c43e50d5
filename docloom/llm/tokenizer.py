"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The split that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts beyond this length are counted in pieces of it that end before a space, where the split ends anyway.
PIECE = 200_000


@cache
def encoding_of(content: bytes, name: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoding(path: str):
    with open(path, "rb") as file:
        return encoding_of(file.read(), os.path.basename(path))


def count_tokens(text: str, path: str) -> int:
    return counted(text, encoding(path))


def counted(text: str, coder) -> int:
    total, at = 0, 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and not (text[end] == " " and text[end - 1].isalnum()):
            end += 1
        total += len(coder.encode_ordinary(text[at:end]))
        at = end
    return total + len(coder.encode_ordinary(text[at:]))


def token_sizes(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., tokens): the size of each row's text. Null and empty texts have 0 tokens. Rows stay as they are. The
    vocabulary file, about a megabyte, is read on the driver and broadcast, so that executors need no copy of it."""
    with open(vocabulary, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    names = [key, *keep]
    source = df.select(*[F.col(f"`{n}`") for n in names], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{n}` {source.schema[n].dataType.simpleString()}" for n in names) + ", tokens bigint"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding_of(shared.value, os.path.basename(vocabulary))
        for batch in batches:
            sizes = pa.array([counted(t, coder) for t in batch.column(len(names)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], sizes], [*names, "tokens"])

    return source.mapInArrow(work, schema)
