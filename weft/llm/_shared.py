"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.storage import cut, shared_dir

#: One word of every contract: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"

__all__ = ["WORD", "WORD_GAP", "cut", "fold", "lower_words_of", "named", "packed", "shared_dir", "shingle_hashes", "ship", "unpacked", "utf8", "words_of"]

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_MIX1 = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark application, and bound the batches that
    Python workers hold (a batch of 64 MB of text, Spark's default, is several times that in Python).

    The bound is a setting of the session, read when a plan is made, so it cannot be put back before
    the lazy result is used: it stays. A value other than Spark's default is left alone."""
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, str(8 << 20))
    sc = spark.sparkContext
    if getattr(sc, "_weft_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="weft-")) / "weft.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(to))
    sc._weft_shipped = True


def named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """Each row as one struct, ``row``, beside the given columns: whatever names the columns of
    ``df`` have, none can clash with a name that an operator uses. ``unpacked`` undoes it."""
    return df.select(F.struct(*[named(c) for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of the rows that ``packed`` made; ``changed``: new values of some of them."""
    field = lambda c: F.col("row").getField(c)
    return df.select(*[changed.get(c, field(c)).alias(c) for c in columns])


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8; ``bytes.split`` cuts at exactly the six ASCII white-space characters."""
    return text.encode().split() if text else []


def lower_words_of(text: bytes | str | None) -> list[bytes]:
    """The same with A-Z lower-cased (``bytes.lower`` touches no other character)."""
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).lower().split()


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The rows of an Arrow text column as bytes, one at a time: no batch is copied whole."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return (x.as_py() for x in column.cast(kind))


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles; fewer words are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out ^= out >> np.uint64(29)
        out *= _MIX1
        out += h[i : len(h) - n + 1 + i] * _MIX2
    out ^= out >> np.uint64(32)
    return np.unique(out)
