"""Language identification by a byte convolutional network.

A byte is mapped to one of 64 classes (the most frequent bytes of the training texts have their
own, class 1 holds the others, class 0 pads), embedded, convolved with filters of several widths,
max-pooled over a window of fixed length and classified by softmax. The network is trained in
numpy on windows of labelled texts. A text is cut into adjacent windows that cover all of it; its
prediction is the mean of the windows' probabilities weighted by their bytes.

Defined results: a null text, and one without a letter, is ``und`` with score 0; a network that
learned no language gives ``und`` too; any other text, of one byte or of millions, gets a learned
language. Equal texts get equal results, bit for bit, whatever the texts around them. The training
rows are those with a language and a text, outside the held-out fold, at most ``per_lang`` of each language (those with the
smallest hash of the id; rows that repeat count once) and ``per_text`` windows of each; all rows are predicted, whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm._shared import cut, fold, ship

WINDOW = 256
WIDTHS = (2, 3, 4)
CLASSES = 64


@dataclass
class Net:
    langs: list[str]
    classes: np.ndarray  # byte -> class
    emb: np.ndarray  # class x d
    filters: list[np.ndarray]  # for each width: (width * d) x f
    bias: list[np.ndarray]
    out_w: np.ndarray
    out_b: np.ndarray


def windows(data: bytes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes in rows of WINDOW, and how many bytes each row has."""
    n = len(data)
    rows = max(1, -(-n // WINDOW))
    buf = np.zeros(rows * WINDOW, np.uint8)
    buf[:n] = classes[np.frombuffer(data, np.uint8)]
    lengths = np.full(rows, WINDOW)
    lengths[-1] = n - (rows - 1) * WINDOW
    return buf.reshape(rows, WINDOW), lengths


def excerpt(text: str, most: int) -> bytes:
    """What training reads of a text: all of it or, beyond ``most`` windows, as many evenly spread ones."""
    data = text.lower().encode()
    rows = -(-len(data) // WINDOW)
    if rows <= most:
        return data
    return b"".join(data[at * WINDOW : (at + 1) * WINDOW] for at in (np.arange(most) * rows // most).tolist())


def train(data: list[bytes], langs: list[str], *, dim: int = 8, filters: int = 16, steps: int = 500, batch: int = 96, rate: float = 4e-3, seed: int = 17) -> Net:
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    counts = np.bincount(np.frombuffer(b"".join(data), np.uint8), minlength=256)
    classes = np.ones(256, np.uint8)
    order = np.argsort(-counts, kind="stable")[: CLASSES - 2]
    classes[order[counts[order] > 0]] = np.arange(2, 2 + (counts[order] > 0).sum())
    k = len(names)
    emb = rng.normal(0, 0.5, (CLASSES, dim)).astype(np.float32)
    emb[0] = 0
    w = [rng.normal(0, (2 / (s * dim)) ** 0.5, (s * dim, filters)).astype(np.float32) for s in WIDTHS]
    b = [np.zeros(filters, np.float32) for _ in WIDTHS]
    ow = rng.normal(0, 0.1, (filters * len(WIDTHS), k)).astype(np.float32)
    ob = np.zeros(k, np.float32)
    if not k:
        return Net(names, classes, emb, w, b, ow, ob)
    rows = [windows(d, classes)[0] for d in data]
    by_lang = [[i for i, x in enumerate(langs) if x == name] for name in names]
    params = [emb, *w, *b, ow, ob]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(0, k, batch)  # every language equally often
        pick = [by_lang[c][rng.integers(len(by_lang[c]))] for c in y]
        x = np.stack([rows[i][rng.integers(len(rows[i]))] for i in pick])
        e = emb[x]
        pooled, where, hidden = [], [], []
        for s, wf, bf in zip(WIDTHS, w, b):
            cols = np.concatenate([e[:, i : WINDOW - s + 1 + i] for i in range(s)], axis=2)
            z = cols @ wf + bf
            at = z.argmax(axis=1)
            pooled.append(np.take_along_axis(z, at[:, None], axis=1)[:, 0])
            where.append(at)
            hidden.append(cols)
        h0 = np.concatenate(pooled, axis=1)
        h = np.maximum(h0, 0)
        logits = h @ ow + ob
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = p.copy()
        g[np.arange(batch), y] -= 1
        g /= batch
        gh = (g @ ow.T) * (h0 > 0)
        grads = [np.zeros_like(emb)]
        gw, gb = [], []
        for j, (s, wf) in enumerate(zip(WIDTHS, w)):
            gz = gh[:, j * filters : (j + 1) * filters]
            at = where[j]
            sel = np.take_along_axis(hidden[j], at[:, :, None], axis=1)  # batch x f x (s*d)
            gw.append(np.einsum("bfk,bf->kf", sel, gz))
            gb.append(gz.sum(axis=0))
            ge = gz[:, :, None] * wf.T[None]
            for i in range(s):
                np.add.at(grads[0], np.take_along_axis(x, at + i, axis=1), ge[:, :, i * dim : (i + 1) * dim])
        grads += [*gw, *gb, h.T @ g, g.sum(axis=0)]
        grads[0][0] = 0
        lr = rate * (1 - step / (steps + 1)) ** 0.5
        for par, gr, a, c in zip(params, grads, m1, m2):
            a *= 0.9
            a += 0.1 * gr
            c *= 0.99
            c += 0.01 * gr * gr
            par -= lr * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.99**step)) + 1e-8)
    return Net(names, classes, emb, w, b, ow, ob)


class Predictor:
    """The convolutions as sums of table rows: one table row for two neighbouring classes."""

    def __init__(self, net: Net, rows_at_once: int = 64):
        self.net, self.rows = net, rows_at_once
        d = net.emb.shape[1]
        one = lambda wf, i: net.emb @ wf[i * d : (i + 1) * d]  # noqa: E731  class -> its part of the sum
        two = lambda wf, i: np.ascontiguousarray((one(wf, i)[:, None] + one(wf, i + 1)[None]).reshape(CLASSES * CLASSES, -1))
        self.tables = []
        for s, wf in zip(WIDTHS, net.filters):
            self.tables.append([(i, two(wf, i)) if i + 1 < s else (i, np.ascontiguousarray(one(wf, i))) for i in range(0, s, 2)])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.net.langs)), np.float64)
        for a in range(0, len(x), self.rows):
            c = x[a : a + self.rows].astype(np.intp)
            pairs = c[:, :-1] * CLASSES + c[:, 1:]
            pooled = []
            for s, bias, tables in zip(WIDTHS, self.net.bias, self.tables):
                m = WINDOW - s + 1
                z = None
                for i, table in tables:
                    part = table.take(pairs[:, i : i + m] if len(table) > CLASSES else c[:, i : i + m], axis=0)
                    z = part if z is None else np.add(z, part, out=z)
                pooled.append(z.max(axis=1) + bias)
            h = np.maximum(np.concatenate(pooled, axis=1), 0)
            # a sum in a fixed order: a matrix product may round a row by the rows around it
            logits = (h[:, :, None].astype(np.float64) * self.net.out_w[None]).sum(axis=1) + self.net.out_b
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[a : a + self.rows] = p / p.sum(axis=1, keepdims=True)
        return out

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.net.langs:
            return langs, scores
        at, parts, lengths, held = [], [], [], 0

        def flush() -> None:
            if not at:
                return
            p = self.probabilities(np.concatenate(parts)) * np.concatenate(lengths)[:, None]
            starts = np.cumsum([0, *(len(x) for x in lengths[:-1])])
            for i, total in zip(at, np.add.reduceat(p, starts, axis=0)):
                best = int(total.argmax())
                langs[i], scores[i] = self.net.langs[best], float(min(1.0, total[best] / total.sum()))
            at.clear(), parts.clear(), lengths.clear()

        for i, t in enumerate(texts):
            if not t or not any(map(str.isalpha, t)):
                continue
            x, n = windows(t.lower().encode(), self.net.classes)
            at.append(i), parts.append(x), lengths.append(n)
            held += len(x)
            if held >= 4096:
                flush()
                held = 0
        flush()
        return langs, scores


def training_rows(docs: DataFrame, per_lang: int, parts: int = 4, held: int = 2, per_text: int = 64) -> DataFrame:
    """excerpt, lang of at most ``per_lang`` rows of each language outside the held-out fold, those
    with the smallest hash of the id; at most ``per_text`` windows of each."""
    ship(docs.sparkSession)
    mine = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.col("lang").alias("lang"), F.col("text").alias("text"))
    mine = mine.filter(fold(F.col("id"), parts) != held).withColumn("print", F.xxhash64("text"))
    keyed = mine.select("id", "lang", "print", F.xxhash64("id").alias("hash"))
    # first within small parts of a language, then within larger ones: no task ranks many rows of one language
    for salts in (256, 16, 1):
        w = Window.partitionBy("lang", F.pmod("hash", F.lit(salts))).orderBy("hash", "id", "print")
        keyed = keyed.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= per_lang).drop("rank").distinct()
    chosen = cut(keyed.select(F.col("id").alias("of"), F.col("lang").alias("lang_of"), F.col("print").alias("print_of")))
    few = chosen.count() <= 100_000  # per_lang rows a language; there may be more languages than a broadcast can take

    @F.pandas_udf("binary")
    def excerpts(texts: pd.Series) -> pd.Series:
        return pd.Series([excerpt(t, per_text) for t in texts], dtype=object)

    same = (F.col("id") == F.col("of")) & (F.col("lang") == F.col("lang_of")) & (F.col("print") == F.col("print_of"))
    found = mine.join(F.broadcast(chosen) if few else chosen, same).select("id", "lang", "print", excerpts("text").alias("excerpt"))
    return found.groupBy("id", "lang", "print").agg(F.min("excerpt").alias("excerpt")).select("excerpt", "lang")  # rows that repeat count once


def fit(docs: DataFrame, per_lang: int = 400, parts: int = 4, held: int = 2) -> Net:
    rows = sorted((bytes(r.excerpt), r.lang) for r in training_rows(docs, per_lang, parts, held).collect())
    rows = [(t, x) for t, x in rows if any(map(str.isalpha, t.decode("utf-8", "ignore")))]
    return train([t for t, _ in rows], [x for _, x in rows])


def predict(text: Column, net: Net, spark) -> Column:
    """Struct column (lang, score)."""
    ship(spark)
    shared = spark.sparkContext.broadcast(net)
    kept: list[Predictor] = []

    @F.pandas_udf("lang string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        if not kept:
            kept.append(Predictor(shared.value))
        lang, score = kept[0](list(texts))
        return pd.DataFrame({"lang": lang, "score": score})

    return guess(text)


def identify(docs: DataFrame, per_lang: int = 400, parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    out = docs.select("doc_id", predict(F.col("text"), fit(docs, per_lang, parts, held), docs.sparkSession).alias("_p"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))
