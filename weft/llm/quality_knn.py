"""Quality classification by nearest-neighbour voting in a latent-semantic space.

Terms of a text: pairs of neighbouring byte classes, and bins of six ratios of the whole
text (distinct words, words equal to the one before, distinct lines, marks, capitals, letters per
word). Their square-root frequencies,
weighted by inverse document frequency, are projected on the leading right singular vectors of
the labelled sample. The labelled vectors (at most ``most`` x ``dim`` floats, a fixed bound) are
broadcast; each text's cosines with all of them are computed in blocks, those that can be among its
``k`` nearest once more as sums in a fixed order, and the ``k`` nearest vote with their similarity as weight.

Defined results: null, empty and white-space texts have the zero vector and get the share of
label 1 among the labelled rows, as does every text if no label is known (share 0.5). Equal texts
get equal scores, bit for bit, whatever the texts around them. Ties among neighbours go to the lower row of the labelled matrix. The labelled
rows are those outside the held-out fold, at most ``most`` of them (smallest hash of the id), also
where ids repeat in the documents or the labels.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._shared import fold, packed, ship, unpacked

PAIRS = 64 * 64
BINS = 12
RATIOS = 6
TERMS = PAIRS + BINS * RATIOS


def _byte_classes() -> np.ndarray:
    c = np.full(256, 63, np.uint16)
    for i in range(26):
        c[97 + i] = i
        c[65 + i] = 26 + i % 4
    for i in range(10):
        c[48 + i] = 30
    for i, x in enumerate(b" \n\t.,;:!?'\"()-#*$%&|<>/@=_[]{}"):
        c[x] = 31 + i if i < 31 else 62
    return c


_CLASS = _byte_classes()
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _bins(x: float) -> np.ndarray:
    """x in 0..1 shared between its two nearest bins."""
    out = np.zeros(BINS, np.float32)
    at = min(max(x, 0.0), 1.0) * (BINS - 1)
    low = min(int(at), BINS - 2)
    out[low], out[low + 1] = 1 - (at - low), at - low
    return out


def features(text: str | None) -> np.ndarray:
    out = np.zeros(TERMS, np.float32)
    data = text.encode() if text else b""
    words = data.split()
    if not words:
        return out
    raw = np.frombuffer(data, np.uint8)
    if len(raw) > 1:
        c = _CLASS[raw]
        out[:PAIRS] = np.sqrt(np.bincount(c[:-1] * np.uint16(64) + c[1:], minlength=PAIRS) / (len(raw) - 1))
    lines = [x for x in data.split(b"\n") if x]
    solid = len(raw) - int(_SPACE[raw].sum())
    letters = int(_LETTER[raw].sum())
    seen = len(set(words)) / len(words)
    again = sum(map(eq, words, words[1:])) / len(words)
    ratios = (seen**0.5, again**0.5, len(set(lines)) / max(1, len(lines)), min(1.0, 4 * (solid - letters) / solid), int(_CAPITAL[raw].sum()) / max(1, letters), min(1.0, solid / len(words) / 16))
    for i, r in enumerate(ratios):
        out[PAIRS + i * BINS : PAIRS + (i + 1) * BINS] = _bins(r)
    return out


@dataclass
class Space:
    idf: np.ndarray
    axes: np.ndarray  # TERMS x dim, doubles
    vectors: np.ndarray  # labelled rows x dim, of length 1
    labels: np.ndarray
    prior: float


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def learn(x: np.ndarray, labels: list[int], dim: int = 48, ratio_weight: float = 0.35, seed: int = 5) -> Space:
    """x: a row of ``features`` for each labelled text."""
    x = np.array(x, np.float32).reshape(-1, TERMS)
    real = x.any(axis=1)
    x, y = x[real], np.asarray(labels, np.float64)[real] if len(labels) else np.zeros(0)
    prior = float(y.mean()) if len(y) else 0.5
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.5).astype(np.float32)
    idf[PAIRS:] = ratio_weight
    dim = min(dim, len(x), TERMS)
    if not dim:
        return Space(idf, np.zeros((TERMS, 0)), np.zeros((0, 0)), y, prior)
    weighted = x * idf
    basis = np.random.default_rng(seed).normal(size=(TERMS, dim + 8)).astype(np.float32)
    for _ in range(4):  # subspace iteration
        basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
    turn = np.linalg.svd(weighted @ basis, full_matrices=False)[2]
    axes = (basis @ turn[:dim].T).astype(np.float64)
    space = Space(idf, axes, np.zeros((0, dim)), y, prior)
    space.vectors = np.stack([vector(space, f) for f in x])
    return space


def vector(space: Space, f: np.ndarray) -> np.ndarray:
    """The unit vector of one text. A sum of the axes' rows in term order: it depends on the text
    alone, not on the texts it is computed with, as a product of whole blocks would."""
    at = np.flatnonzero(f)
    return _unit((space.axes[at] * (f[at] * space.idf[at]).astype(np.float64)[:, None]).sum(axis=0))


def vote(space: Space, texts: list[str | None], k: int = 15, block: int = 256) -> np.ndarray:
    out = np.full(len(texts), space.prior)
    n = len(space.vectors)
    if not n:
        return out
    k = min(k, n)
    for a in range(0, len(texts), block):
        terms = [features(t) for t in texts[a : a + block]]
        real = [i for i, f in enumerate(terms) if f.any()]
        if not real:
            continue
        x = np.stack([vector(space, terms[i]) for i in real])
        cosine = x @ space.vectors.T
        # the product of the block only preselects, with slack for its rounding; sums in a fixed order decide
        edge = np.partition(cosine, n - k, axis=1)[:, n - k] - 1e-12
        for i, v, row, low in zip(real, x, cosine, edge):
            near = np.flatnonzero(row >= low)
            exact = (space.vectors[near] * v).sum(axis=1)
            first = np.lexsort((near, -exact))[:k]  # ties go to the lower row
            weight = np.maximum(exact[first], 1e-6) ** 4
            out[a + i] = min(1.0, max(0.0, float((weight * space.labels[near[first]]).sum() / weight.sum())))
    return out


def pack(f: np.ndarray) -> bytes:
    """Terms of a text as positions and values: at most 6 bytes for each of ``TERMS``."""
    at = np.flatnonzero(f).astype(np.uint16)
    return at.tobytes() + f[at].tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = len(data) // 6
    out = np.zeros(TERMS, np.float32)
    out[np.frombuffer(data[: 2 * n], np.uint16)] = np.frombuffer(data[2 * n :], np.float32)
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000, parts: int = 5, held: int = 0) -> Space:
    """The space of ``most`` labelled rows at most, those with the smallest hash of the id. Terms are
    counted in the tasks: the driver gets 25 KB a row at most, whatever the texts' lengths."""
    ship(docs.sparkSession)

    @F.pandas_udf("binary")
    def terms(texts: pd.Series) -> pd.Series:
        return pd.Series([pack(features(t)) for t in texts], dtype=object)

    known = labels.filter(F.col("quality").isNotNull() & (fold(F.col("doc_id"), parts) != held)).select(F.col("doc_id").alias("of"), F.col("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("of"), "of", "quality").limit(most)
    mine = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"))
    rows = mine.join(F.broadcast(chosen), F.col("id") == F.col("of")).select("id", "quality", terms("text").alias("terms"))
    # ids may repeat in the documents: the bound holds for rows too
    rows = rows.orderBy(F.xxhash64("id"), "id", "terms", "quality").limit(most).collect()
    return learn(np.stack([unpack(bytes(r.terms)) for r in rows]) if rows else np.zeros((0, TERMS)), [int(r.quality == 1) for r in rows])


def score(text: Column, space: Space, spark) -> Column:
    ship(spark)
    shared = spark.sparkContext.broadcast(space)

    @F.pandas_udf("double")
    def votes(texts: pd.Series) -> pd.Series:
        return pd.Series(vote(shared.value, list(texts)))

    return votes(text)


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3, most: int = 4000, parts: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = docs.select("doc_id", score(F.col("text"), fit(docs, labels, most, parts, held), docs.sparkSession).alias("score"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= cutoff, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3, most: int = 4000) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the cutoff."""
    rows = packed(docs, score=score(F.col("text"), fit(docs, labels, most), docs.sparkSession))
    return unpacked(rows.filter(F.col("score") >= cutoff), docs.columns)
