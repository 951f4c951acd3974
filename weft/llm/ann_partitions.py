"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors (smallest hash of the row, 4,096 to 16,384 of them) gives an exact
neighbour graph, which is cut into balanced parts: recursive bisection at the median of the
graph's second eigenvector, then moves that put a vector with most of its neighbours while sizes
stay within a tolerance. A small network learns, from a vector, the probabilities that its
neighbours lie in each part. Every row is indexed in its most probable part. A query visits parts
from the most probable on until their probabilities sum to ``enough``; the vectors there are all
reranked by exact inner products in double precision. ``enough`` is the least sum that finds
``recall`` of the true neighbours of the sample's validation queries by brute force over the sample:
where the network is sure, few parts are visited, where it is not, many. A query goes on to further
parts until they hold ``top`` other ids for certain.

Defined results: vectors that are null, zero, of another dimension than most of the sample, or
hold null or non-finite components take no part; an id that repeats is one candidate, at its best
score, and one query, with the least of its vectors; ties go to the smaller id; with too few
candidates all are given.

Scale: the number of parts grows with the rows, one for ``part_rows`` rows, from 32 to 512. A part is
stored in chunks of bounded size, and so are the queries that visit it, so a part that holds a third
of all rows (equal vectors) is many tasks. Only the sample and counts for each part reach the driver.
Each task returns ``top`` rows for a query; the last ranking is pruned before its shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm._shared import cut, ship


@dataclass
class PartClassifier:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    enough: float  # probability that the visited parts must sum to

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.scores(x)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def visits(self, x: np.ndarray, sizes: np.ndarray, need: int) -> list[np.ndarray]:
        """For each row the parts to visit, the most probable first: until they have enough
        probability, and ``need`` rows."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
        rows = np.cumsum(sizes[order], axis=1) - sizes[order]
        n = ((before < self.enough) | (rows < need)).sum(axis=1)
        return [o[:k].astype(np.int32) for o, k in zip(order, n)]


def neighbours(base: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray | None = None, block: int = 512) -> np.ndarray:
    """Rows of base with the largest inner products, exactly; own: the base row of each query."""
    out = np.empty((len(queries), k), np.int64)
    for a in range(0, len(queries), block):
        s = queries[a : a + block] @ base.T
        if own is not None:
            s[np.arange(len(s)), own[a : a + block]] = -np.inf
        out[a : a + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int, tolerance: float = 0.1) -> np.ndarray:
    """Part of each node of a neighbour graph (rows: neighbours)."""
    n, k = graph.shape
    heads = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()])  # both directions
    tails = np.concatenate([graph.ravel(), np.repeat(np.arange(n), k)])
    rng = np.random.default_rng(seed)
    part = np.zeros(n, np.int64)

    def bisect(nodes: np.ndarray, low: int, high: int) -> None:
        if high - low == 1 or len(nodes) < 2:
            part[nodes] = low
            return
        at = np.full(n, -1)
        at[nodes] = np.arange(len(nodes))
        inside = (at[heads] >= 0) & (at[tails] >= 0)
        h, t = at[heads[inside]], at[tails[inside]]
        degree = np.maximum(np.bincount(h, minlength=len(nodes)), 1)
        v = rng.normal(size=len(nodes))
        for _ in range(40):  # second eigenvector of the lazy random walk
            v = 0.5 * v + 0.5 * np.bincount(h, weights=v[t], minlength=len(nodes)) / degree
            v -= (v * degree).sum() / degree.sum()
            v /= max(np.linalg.norm(v), 1e-30)
        mid = (low + high) // 2
        order = np.argsort(v, kind="stable")
        first = round(len(nodes) * (mid - low) / (high - low))
        bisect(nodes[order[:first]], low, mid)
        bisect(nodes[order[first:]], mid, high)

    bisect(np.arange(n), 0, parts)
    most = int(np.ceil(n / parts * (1 + tolerance)))
    least = int(n / parts * (1 - tolerance))
    sizes = np.bincount(part, minlength=parts)
    for _ in range(6):
        votes = np.zeros((n, parts))
        np.add.at(votes, (heads, part[tails]), 1)
        gain = votes - votes[np.arange(n), part][:, None]
        best = gain.argmax(axis=1)
        moved = 0
        for i in np.argsort(-gain[np.arange(n), best], kind="stable"):
            to, was = best[i], part[i]
            if gain[i, to] <= 0:
                break
            if sizes[to] < most and sizes[was] > least:
                part[i] = to
                sizes[to] += 1
                sizes[was] -= 1
                moved += 1
        if not moved:
            break
    return part


def train(x: np.ndarray, targets: np.ndarray, hidden: int = 96, steps: int = 600, batch: int = 256, rate: float = 5e-3, seed: int = 3) -> PartClassifier:
    rng = np.random.default_rng(seed)
    d, k = x.shape[1], targets.shape[1]
    scale = 1 / max(float(np.sqrt((x * x).mean())), 1e-30)
    p = [rng.normal(0, (2 / d) ** 0.5 * scale, (d, hidden)), np.zeros(hidden), rng.normal(0, 0.05, (hidden, k)), np.zeros(k)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    rates = [rate * scale, rate, rate, rate]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(x), batch)
        xs = x[at]
        h = np.maximum(xs @ p[0] + p[1], 0)
        z = h @ p[2] + p[3]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - targets[at]) / batch
        gh = (g @ p[2].T) * (h > 0)
        for i, gr in enumerate((xs.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.99 * v[i] + 0.01 * gr * gr
            p[i] -= rates[i] * (1 - step / (steps + 1)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-12)
    return PartClassifier(*p, enough=1.0)


def fit(x: np.ndarray, parts: int, k: int, recall: float, seed: int = 11) -> PartClassifier:
    n, d = x.shape
    parts = max(1, min(parts, n // 16))
    if parts == 1:
        return PartClassifier(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0)
    near = neighbours(x, x, min(16, n - 1), np.arange(n))
    part = balanced_parts(near, parts, seed)
    targets = np.zeros((n, parts))
    np.add.at(targets, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1 / near.shape[1])
    asks = np.random.default_rng(seed).permutation(n)[: max(1, n // 5)]
    learns = np.setdiff1d(np.arange(n), asks)
    model = train(x[learns], targets[learns])
    # calibration: rows sit where the network puts them, as in the index
    home = model.scores(x).argmax(axis=1)
    k = min(k, n - 1)
    truth = home[neighbours(x, x[asks], k, asks)]
    p = model.probabilities(x[asks])
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.empty_like(p)  # probability of the parts visited before this one
    np.put_along_axis(before, order, np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1), axis=1)
    reached = np.sort(np.take_along_axis(before, truth, axis=1).ravel())
    model.enough = float(np.nextafter(reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))) - 1)], 2.0))
    return model


def usable(vectors: DataFrame) -> DataFrame:
    """_id, _v (array of doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda c: c != 0), F.lit(False))
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("_id"), v.alias("_v"))


def best(queries: np.ndarray, qids: np.ndarray, base: np.ndarray, ids: np.ndarray, top: int, block: int = 256) -> list[tuple[int, int, float]]:
    """(query, id, score) of the top ids of this base. The final scores are sums in one fixed
    order, so that equal vectors get equal scores; the fast product only preselects, with slack."""
    out = []
    sizes = np.linalg.norm(base, axis=1).max(initial=0.0)
    copies = len(ids) - len(np.unique(ids))  # rows that may stand for an id that is there already
    for a in range(0, len(queries), block):
        q = queries[a : a + block]
        s = q @ base.T
        s[qids[a : a + block][:, None] == ids[None]] = -np.inf
        k = min(top + copies, len(ids))
        edge = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        slack = 1e-12 * sizes * np.linalg.norm(q, axis=1)
        for i in range(len(q)):
            at = np.flatnonzero(s[i] >= edge[i] - slack[i]) if edge[i] > -np.inf else np.flatnonzero(s[i] > -np.inf)
            exact = (q[i] * base[at]).sum(axis=1)
            order = np.lexsort((ids[at], -exact))
            if copies:
                order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])]
            for j in order[:top]:
                out.append((int(qids[a + i]), int(ids[at[j]]), float(exact[j])))
    return out


def sampled(rows: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` different rows, those with the smallest hash, of the commonest dimension."""
    keyed = rows.withColumn("_hash", F.xxhash64("_id", "_v"))
    first = keyed.select(F.col("_hash").alias("_first")).distinct().orderBy("_first").limit(most)
    picked = keyed.join(F.broadcast(first), F.col("_hash") == F.col("_first")).groupBy("_hash").agg(F.min("_v").alias("_v")).collect()
    vectors = [r._v for r in sorted(picked, key=lambda r: r._hash)]
    dims = [len(v) for v in vectors]
    dim = max(sorted(set(dims)), key=dims.count) if dims else 0
    fit_ = [v for v in vectors if len(v) == dim]
    return np.array(fit_, np.float64).reshape(len(fit_), dim)


def n_parts(rows: int, part_rows: int, least: int = 32, most: int = 512) -> int:
    return max(least, min(most, -(-rows // part_rows)))


def search(vectors: DataFrame, every: int = 20, top: int = 20, parts: int | None = None, recall: float = 0.94, part_rows: int = 1024, sample: int | None = None, chunk: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each row whose id is divisible
    by ``every``, among all rows but its own. Parts and sample grow with the rows unless given."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    parts = parts or n_parts(rows.count(), part_rows)
    x = sampled(rows, sample or min(16_384, max(4096, 32 * parts)))
    schema = "query_id long, vec_id long, score double"
    if not len(x):
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    dim, model = x.shape[1], fit(x, parts, top, recall)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(np.stack(v)).argmax(axis=1).astype(np.int32)) if len(v) else pd.Series([], dtype=np.int32)

    placed = cut(rows.filter(F.size("_v") == dim).withColumn("_part", home("_v")))
    held = placed.groupBy("_part").agg(F.count("*").alias("n")).collect()  # one number for each part
    sizes = np.zeros(len(model.b2), np.int64)
    for h in held:
        sizes[h._part] = h.n
    # rows that only repeat an id do not count as candidates
    extra = int(sizes.sum()) - placed.agg(F.countDistinct("_id")).first()[0]
    need = top + 1 + extra

    @F.pandas_udf("array<int>")
    def visits(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.visits(np.stack(v), sizes, need), dtype=object) if len(v) else pd.Series([], dtype=object)

    asks = placed.filter(F.col("_id") % every == 0).groupBy("_id").agg(F.min("_v").alias("_v"))
    routed = cut(asks.withColumn("_visits", visits("_v")))
    want = routed.select("_id", "_v", F.explode("_visits").alias("_part"))
    visitors = {h._part: h.n for h in want.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    # chunks of vectors and of queries of each part
    plan = spark.createDataFrame([(int(p), max(1, -(-int(sizes[p]) // chunk)), max(1, -(-visitors.get(int(p), 0) // chunk))) for p in range(len(sizes)) if sizes[p]], "_p int, _pieces int, _groups int")
    base = placed.join(F.broadcast(plan), F.col("_part") == F.col("_p")).withColumn("_piece", F.pmod(F.xxhash64("_id", "_v"), F.col("_pieces")).cast("int"))
    base = base.withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).select("_id", "_v", "_part", "_piece", "_group")
    want = want.join(F.broadcast(plan), F.col("_part") == F.col("_p")).withColumn("_group", F.pmod(F.xxhash64("_id"), F.col("_groups")).cast("int"))
    want = want.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).select("_id", "_v", "_part", "_piece", "_group")
    key = ["_part", "_piece", "_group"]

    def rerank(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = best(np.stack(q["_v"]), q["_id"].to_numpy(), np.stack(b["_v"]), b["_id"].to_numpy(), top)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = want.groupBy(*key).cogroup(base.groupBy(*key)).applyInPandas(rerank, schema)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")) if extra else found
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
