"""Encoding of whole texts with a byte-level BPE of public ranks, and decoding of ids from raw bytes."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = os.environ.get("TALLYFORGE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how byte_bpe_50k splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in pieces of about this many characters.
PIECE = 1 << 16
#: Fixed value: the white space of the pattern (that of Unicode, which is not quite Python's).
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: No token of the pattern reaches over the place between a character and white space after it, nor over that between a
#: letter or number and a sign after it.
SAFE = re.compile(f"(?<=[^{BLANK}])(?=[{BLANK}])|(?<=[^\\W_])(?=[^\\w{BLANK}]|_)")


@functools.lru_cache(maxsize=4)
def load(ranks: str = RANKS):
    """The encoding of a rank file, read once per Python worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(ranks), pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """text in pieces of at least `size` characters, cut where the ids of the parts are those of the whole.

    A run of letters, numbers or signs that has no such place stays whole, whatever its length.
    """
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, ranks: str = RANKS) -> list[int]:
    """Ids of a text without special tokens; text that looks like one is plain. NULL and empty text have none."""
    if not text:
        return []
    encoding = load(ranks)
    if len(text) <= PIECE:
        return encoding.encode_ordinary(text)
    return [i for piece in pieces(text) for i in encoding.encode_ordinary(piece)]


def decode(ids, ranks: str = RANKS) -> str:
    """The text of ids, from the raw bytes of all: a character may be spread over several ids."""
    return b"".join(load(ranks).decode_tokens_bytes(list(ids))).decode("utf-8", "replace")


def _encoded(batches: Iterator[pa.RecordBatch], ranks: str, ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [np.array(encode(t, ranks), dtype=np.int32) for t in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, each)])
        if ids:
            flat = np.concatenate(each) if each else np.zeros(0, np.int32)
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        else:
            out = pa.array(np.diff(ends), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), out], ["key", "out"])


def _mapped(df: DataFrame, key: str, text: str, ranks: str, ids: bool, name: str) -> DataFrame:
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(lambda batches: _encoded(batches, ranks, ids), f"key {kind}, out {'array<int>' if ids else 'bigint'}")
    return out.select(F.col("key").alias(key), F.col("out").alias(name))


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(key, ids) of every row, in one pass without a shuffle; other columns are not read.

    NULL and empty text have the empty list; rows with equal or NULL keys are all kept; an empty table gives none.
    """
    return _mapped(df, key, text, ranks, True, "ids")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(key, n_tokens) of every row: the length of its ids, 0 for NULL and empty text."""
    return _mapped(df, key, text, ranks, False, "n_tokens")


def roundtrip(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(key, n_tokens, same): whether the decoded ids of a text are the text; NULL counts as the empty text."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [encode(t, ranks) for t in texts]
            same = [decode(i, ranks) == t for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array(same)], ["key", "n_tokens", "same"])

    kind = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(check, f"key {kind}, n_tokens bigint, same boolean")
    return out.withColumnRenamed("key", key)
