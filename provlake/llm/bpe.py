"""Byte-level BPE: the tiktoken library under a local rank file.

Long texts are cut before they reach the library, at places where no match of the split pattern can reach across: after a
character that isn't white space and before one that is. A run of letters, digits or signs ends there with or without
what follows, and the pattern's only look-ahead works inside white space. The ids are those of the uncut text.

Decoding joins the ids' raw bytes, so characters whose bytes are spread over several ids come back whole.

Defined results: null and empty texts have no ids and decode to no bytes; rows are independent, so repeated rows and an
empty table need nothing special; other columns of the input are carried by encode() and decode(), but for one
with the name asked for the result (ids, bytes), which gives way to it, and dropped by round_trip().
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts beyond so many characters are cut.
CUT = 50_000
_BOUNDARY = regex.compile(r"\S(?=\s)")  # whose white space is Unicode's, as the patterns' is; Python's own has four more


@functools.lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 bytes, a space, the rank; one to a line), without special tokens."""
    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_pieces(text: str, cut: int = CUT) -> Iterator[str]:
    """The text in order, cut at the first safe boundary at or after every `cut` characters."""
    start = 0
    while len(text) - start > cut:
        m = _BOUNDARY.search(text, start + cut - 1)
        if not m:
            break
        yield text[start : m.end()]
        start = m.end()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str | None, cut: int = CUT) -> np.ndarray:
    if not text:
        return np.empty(0, np.int32)
    if len(text) <= cut:
        return np.array(enc.encode_ordinary(text), np.int32)
    return np.concatenate([np.array(enc.encode_ordinary(x), np.int32) for x in safe_pieces(text, cut)])


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the token ids of its text column. The rank file must be readable under this path on every executor."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def to_ids(texts: pd.Series) -> pd.Series:
        enc = encoding(ranks, pattern)
        return pd.Series([encode_text(enc, t) for t in texts], dtype=object)

    return docs.withColumn(ids, to_ids(text))


def decode(rows: DataFrame, ranks: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """rows with the raw bytes of its ids column."""

    @F.pandas_udf(T.BinaryType())
    def to_bytes(lists: pd.Series) -> pd.Series:
        enc = encoding(ranks, pattern)
        return pd.Series([b"" if x is None else enc.decode_bytes(x.tolist()) for x in lists], dtype=object)

    return rows.withColumn(out, to_bytes(ids))


@functools.lru_cache(maxsize=1)
def _decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


@F.pandas_udf(T.StringType())
def ids_digest(lists: pd.Series) -> pd.Series:
    """SHA-256 of the decimal ids joined by commas."""
    names = _decimals(1 << 17)
    name = lambda i: names[i] if i < len(names) else str(i)
    return pd.Series([hashlib.sha256(",".join(map(names.__getitem__ if not len(x) or x.max() < len(names) else name, x.tolist())).encode()).hexdigest() for x in lists], dtype=object)


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes that the ids decode to, for every whole text."""
    rows = decode(encode(docs.select("doc_id", "text"), ranks, pattern), ranks, pattern)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest("ids").alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
