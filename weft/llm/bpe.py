"""Byte-level BPE encoding and decoding.

Every match of the split pattern is merged on its own. A segment tree over the byte positions of
the match holds, for each live position, the rank of the pair that starts there; the root is the
leftmost pair of least rank. A merge updates the leaves of the merged position and of its live
neighbours, each in logarithmic time, so a match of n bytes costs O(n log n) however long it is.

Defined results: a null text encodes as an empty one (no ids); any other text is encoded whole;
repeated rows get equal ids; other columns are not touched.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from operator import or_

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._shared import ship

_NONE = 1 << 62
_SHIFT = 32
_MASK = (1 << _SHIFT) - 1
_LOG = 4  # a node of the tree has 2**4 children: a short match is one node
_WIDTH = 1 << _LOG


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def splitter(pattern: str) -> regex.Pattern:
    r"""``\s`` means the Unicode property White_Space, as in the library whose ids we must give."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def shifted(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Ranks in the high bits, as the tree holds them; the low bits are for a position."""
    return {token: rank << _SHIFT for token, rank in ranks.items()}


def byte_pairs(high: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Shifted rank of every pair of bytes."""
    return {(a, b): high.get(bytes((a, b)), _NONE) for a in range(256) for b in range(256)}


def merge(piece: bytes, high: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """Ids of one match of the pattern. high: ``shifted`` ranks; pairs: ``byte_pairs`` of them."""
    whole = high.get(piece)
    if whole is not None:
        return [whole >> _SHIFT]
    n = len(piece)
    get = high.get
    leaves = list(map(or_, map(pairs.__getitem__, zip(piece, piece[1:])), range(n)))
    levels = [leaves]  # each node of a level is the least of _WIDTH nodes of the level before
    while len(levels[-1]) > _WIDTH:
        low = levels[-1]
        levels.append([min(low[k : k + _WIDTH]) for k in range(0, len(low), _WIDTH)])
    roots, depths = levels[-1], range(1, len(levels))
    after, before = list(range(1, n + 1)), list(range(-1, n))  # of live positions
    while (top := min(roots)) < _NONE:
        i = top & _MASK
        j = after[i]
        end = after[j]
        after[i] = end
        # the pair at j is gone; those at i and at its left neighbour have a new right part
        if end < n:
            before[end] = i
            leaves[j] = _NONE
            leaves[i] = get(piece[i : after[end]], _NONE) | i
        else:
            leaves[i] = _NONE
            if j < n - 1:
                leaves[j] = _NONE
        p = before[i]
        if p >= 0:
            leaves[p] = get(piece[p:end], _NONE) | p
        for d in depths:
            low, here, shift = levels[d - 1], levels[d], _LOG * d
            for k in {j >> shift, i >> shift, max(p, 0) >> shift}:
                if k < len(here):
                    here[k] = min(low[k << _LOG : k + 1 << _LOG])
    out, i = [], 0
    while i < n:
        end = after[i]
        out.append(high[piece[i:end]] >> _SHIFT)
        i = end
    return out


class _Packed(dict):
    """match -> its ids as little-endian unsigned 32-bit integers; emptied when ``most`` are held."""

    def __init__(self, ranks: dict[bytes, int], most: int = 300_000):
        super().__init__()
        self.high, self.most = shifted(ranks), most
        self.pairs = byte_pairs(self.high)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = merge(piece.encode(), self.high, self.pairs)
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one rank file; built once in each Python worker."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.pattern = splitter(pattern)
        self.packed = _Packed(ranks)
        self.vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.packed.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes | None) -> bytes:
        if not ids:
            return b""
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Binary column: the ids of each text as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series([c.encode(t) for t in texts], dtype=object)

    return packed(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Binary column: the bytes that packed ids stand for."""

    @F.pandas_udf("binary")
    def unpacked(rows: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series([c.decode(r) for r in rows], dtype=object)

    return unpacked(ids)


def tokenize(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``ids`` (packed) and ``decoded`` (the bytes of these ids) of every row."""
    ship(docs.sparkSession)

    @F.pandas_udf("ids binary, decoded binary")
    def both(texts: pd.Series) -> pd.DataFrame:  # one call: the optimizer would run encode() twice under decode()
        c = codec(path, pattern)
        ids = [c.encode(t) for t in texts]
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(map(c.decode, ids), dtype=object)})

    return docs.select(F.col(id_col), both(F.col(text_col)).alias("_t")).select(id_col, "_t.ids", "_t.decoded")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``tokenize``."""
    return tokenize(docs, path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
