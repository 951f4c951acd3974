"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are put in a seeded permutation (the MD5 of seed and id) and cut along it
into blocks of about ``block_docs`` documents. A source's target in words is met by whole passes
over its blocks and one last pass over a prefix of them; that makes an exact quota of block draws
for each source. A binary tree splits the vector of quotas among the output shards: at each node
the left half receives a multivariate-hypergeometric sample of the node's draws, so every shard
gets its exact count and no draw is given twice. A shard's draws are disjoint stretches of each
source's passes, every pass in a permutation of its own; its rows are shuffled locally by a seeded
hash. What a document contributes is what the shards draw of its block: there is no other path.

The tree is walked twice, which gives the same distribution: on the driver for groups of sources
(``GROUPS`` at most), then in tasks within each group, whose draws for each shard are then known.

Scale: documents are shuffled once, without texts, by (source, block), so a source that holds a
third of all rows is spread over its blocks. The driver holds ``GROUPS`` x shards numbers (8 MB at
most), however many sources there are; targets are found by windows over one row for each source.

Defined results: a null or empty text has size 0 and nothing is taken; the null source is a source
of its own and comes last; rows of equal id and size are interchangeable; sources without words
have target 0; an empty table gives an empty result. Reruns agree: nothing depends on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weft.llm._shared import WORD, cut, packed, ship, unpacked

_BITS = 16  # a source has 2**16 blocks at most
GROUPS, GROUP_SOURCES, SHARDS = 256, 512, 4096
_LARGE = 1_000_000_000  # draws from which the generator's own hypergeometric gives up


@dataclass(frozen=True)
class Recipe:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: int = 2
    shards: int | None = None  # None: as many as ``shard_words`` asks for, ``SHARDS`` at most
    shard_words: int = 4_000_000
    block_docs: int = 256
    seed: int = 0
    split_last: bool = True  # take a part of the document at a quota's end; else all or none of it


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"({WORD})")), F.lit(0)).cast("long")


def split(quotas: np.ndarray, shards: int, seed: tuple[int, ...], wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, draws of each source) of all shards in turn; the draws sum to the quotas. wanted:
    draws of each shard, where they are known already; else all shards get as many, to one."""
    before = None if wanted is None else np.concatenate([[0], np.cumsum(wanted)])

    def node(low: int, high: int, left: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if high - low == 1 or not left.any():
            yield from ((at, left) for at in range(low, high))
            return
        mid = (low + high) // 2
        rest = int(left.sum())
        want = round(rest * (mid - low) / (high - low)) if before is None else int(before[mid] - before[low])
        rng = np.random.default_rng([*seed, low, high])
        got = np.zeros_like(left)
        for i in np.flatnonzero(left).tolist():  # marginals of the multivariate distribution
            if not want:
                break
            x = int(left[i])
            rest -= x
            got[i] = k = hypergeometric(rng, x, rest, want)
            want -= k
        yield from node(low, mid, got)
        yield from node(mid, high, left - got)

    yield from node(0, shards, quotas.astype(np.int64))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if good + bad < _LARGE:
        return int(rng.hypergeometric(good, bad, n))
    return _by_ratios(rng, good, bad, n)


def _by_ratios(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """The same by inversion: probabilities as products of exact ratios from the mode outward, to
    20 standard deviations, beyond which less than one in 1e80 lies."""
    total = good + bad
    low, high = max(0, n - bad), min(good, n)
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    width = int(20 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5) + 20
    up = np.arange(mode, min(high, mode + width), dtype=np.float64)  # from k to k + 1
    down = np.arange(mode, max(low, mode - width), -1, dtype=np.float64)  # from k to k - 1
    ratio_up = np.log(good - up) + np.log(n - up) - np.log(up + 1) - np.log(bad - n + up + 1)
    ratio_down = np.log(down) + np.log(bad - n + down) - np.log(good - down + 1) - np.log(n - down + 1)
    logs = np.concatenate([np.cumsum(ratio_down)[::-1], [0.0], np.cumsum(ratio_up)])
    p = np.cumsum(np.exp(logs))
    return mode - len(down) + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def sized(docs: DataFrame, seed: int = 0, *, row: Column | None = None) -> DataFrame:
    """doc_id, source, size, _key (the place in the permutation) and _row, a hash of the row."""
    key = F.md5(F.concat(F.lit(f"mix{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("_key"), (F.lit(0).cast("long") if row is None else row).alias("_row"))


def goals(totals: DataFrame, r: Recipe) -> DataFrame:
    """source, words, n and _rank, _target of each source: share * all words by weight, none above
    cap * its words, the excess reshared by weight. Windows over one row for each source."""
    order = [F.col("source").isNull(), F.col("source")]
    weights = F.array(*[F.lit(w) for w in r.weights])
    ranked = totals.withColumn("_rank", F.row_number().over(Window.orderBy(*order)) - 1)
    ranked = ranked.withColumn("_weight", F.get(weights, F.col("_rank") % len(r.weights))).withColumn("_ratio", (r.cap * F.col("words")).cast("double") / F.col("_weight"))
    full = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    # the same rows as from here to the end, but a frame that runs on in one pass
    open_ = Window.orderBy(F.desc("_ratio"), F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    level = (F.lit(float(r.share)) * F.sum("words").over(every).cast("double") - F.coalesce(F.sum(r.cap * F.col("words")).over(full), F.lit(0)).cast("double")) / F.sum("_weight").over(open_).cast("double")
    ranked = ranked.withColumn("_level", level)
    # the first level that its own source can take holds for all sources above
    ranked = ranked.withColumn("_level", F.min_by(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank"))).over(every))
    target = F.least(F.coalesce(F.col("_level") * F.col("_weight"), F.lit(float("inf"))), (r.cap * F.col("words")).cast("double"))
    return ranked.select("source", "words", "n", "_rank", target.alias("target"))


def _high_bits() -> Column:
    return F.conv(F.substring("_key", 1, 4), 16, 10).cast("int")


def drawn_blocks(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """_rank, _block, _draws: of each block the shards that draw it, and in which pass.
    quotas: _rank, _bits, _full, _quota of each source; the splitting tree gives each shard its draws."""
    spark = quotas.sparkSession
    ship(spark)
    n = quotas.count()
    groups = max(1, min(GROUPS, -(-n // GROUP_SOURCES)))
    grouped = quotas.withColumn("_group", (F.col("_rank") % groups).cast("int"))
    of_group = np.zeros(groups, np.int64)
    for g in grouped.groupBy("_group").agg(F.sum("_quota").alias("q")).collect():
        of_group[g._group] = g.q
    wanted = np.zeros((groups, shards), np.int64)
    for at, draws in split(of_group, shards, (seed, 0)):
        wanted[:, at] = draws
    shared = spark.sparkContext.broadcast(wanted)

    def leaves(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_rank")
        rank, bits, full, quota = (g[c].to_numpy(np.int64) for c in ("_rank", "_bits", "_full", "_quota"))
        group = int(g["_group"].iloc[0])
        start, out = np.zeros(len(g), np.int64), []
        for at, draws in split(quota, shards, (seed, 1, group), shared.value[group]):
            i = np.flatnonzero(draws)
            if len(i):
                out.append((rank[i], bits[i], full[i], np.full(len(i), at), start[i], start[i] + draws[i]))
                start = start + draws
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 6
        return pd.DataFrame(dict(zip(("_rank", "_bits", "_full", "_shard", "_from", "_to"), cols)))

    stretches = grouped.groupBy("_group").applyInPandas(leaves, "_rank long, _bits long, _full long, _shard long, _from long, _to long")
    each = stretches.withColumn("_at", F.explode(F.sequence("_from", F.col("_to") - 1)))
    blocks = F.expr("shiftleft(1L, cast(_bits as int))")
    each = each.withColumn("_pass", F.floor(F.col("_at") / blocks).cast("long")).withColumn("_slot", F.pmod(F.col("_at"), blocks))
    # an odd factor permutes 2**bits blocks; the last pass takes a prefix of them as they are
    turned = F.pmod(F.col("_slot") * (2 * F.col("_pass") * 7919 + 1) + F.col("_pass") * 104729, blocks)
    each = each.withColumn("_block", F.when(F.col("_pass") < F.col("_full"), turned).otherwise(F.col("_slot")).cast("int"))
    # a block is drawn once in a pass: the list is as short as there are passes
    return each.groupBy("_rank", "_block").agg(F.array_sort(F.collect_list(F.struct(F.col("_pass").alias("pass"), F.col("_shard").alias("shard")))).alias("_draws"))


def mix(docs: DataFrame, recipe: Recipe = Recipe(), *, row: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and ``draws``: for each time the document is
    drawn its output shard, the words taken and its place in the shard's local order."""
    r = recipe
    rows = cut(sized(docs, r.seed, row=row))
    cells = rows.groupBy("source", _high_bits().alias("_cell")).agg(F.sum("size").alias("_words"), F.count("*").alias("_n"))
    totals = cells.groupBy("source").agg(F.sum("_words").alias("words"), F.sum("_n").alias("n"))
    plan = goals(totals, r).withColumn("_need", F.floor(F.col("target") + 0.5).cast("long"))
    full = F.when(F.col("words") > 0, F.least(F.expr("_need div words"), F.lit(r.cap).cast("long"))).otherwise(F.lit(0).cast("long"))
    blocks_of = F.greatest(F.lit(0), F.least(F.lit(_BITS), F.ceil(F.log2(F.greatest(F.lit(1.0), F.ceil(F.col("n") / r.block_docs)))))).cast("int")
    plan = plan.withColumn("_full", full).withColumn("_left", F.col("_need") - F.col("_full") * F.col("words"))
    plan = cut(plan.select(F.col("source").alias("_source"), F.col("words").alias("source_size"), "target", F.col("_rank").cast("long").alias("_rank"), "_full", "_left", blocks_of.alias("_bits")))
    n_sources, longest, words = plan.agg(F.count("*"), F.max(F.length("_source")), F.sum("source_size")).first()
    small = n_sources * ((longest or 0) * 3 + 64) < 16e6

    def with_plan(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    block = F.expr(f"shiftright(_cell, {_BITS} - _bits)").alias("_block")
    blocks = with_plan(cells).groupBy("_rank", "_left", "_full", "_bits", block).agg(F.sum("_words").alias("_words"))
    so_far = Window.partitionBy("_rank").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut(blocks.withColumn("_before", F.coalesce(F.sum("_words").over(so_far), F.lit(0))))
    last = F.coalesce(F.max(F.when(F.col("_before") < F.col("_left"), F.col("_block"))) + 1, F.lit(0))
    quotas = blocks.groupBy("_rank", "_bits", "_full").agg((F.col("_full") * F.expr("shiftleft(1L, _bits)") + last).alias("_quota"))
    quotas = cut(quotas.select("_rank", F.col("_bits").cast("long").alias("_bits"), "_full", F.col("_quota").cast("long").alias("_quota")))
    drawn = drawn_blocks(quotas, r.shards or n_shards(r, words or 0), r.seed)
    known = cut(blocks.select("_rank", "_block", "_before").join(drawn, ["_rank", "_block"], "left").select(F.col("_rank").alias("_r"), F.col("_block").alias("_b"), "_before", "_draws"))

    placed = with_plan(rows.withColumn("_cell", _high_bits())).withColumn("_block", block).drop("_cell", "_bits")
    placed = placed.join(known, (F.col("_rank") == F.col("_r")) & (F.col("_block") == F.col("_b"))).drop("_r", "_b")
    within = Window.partitionBy("_rank", "_block").orderBy("_key", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_left") - F.col("_before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    rest = F.greatest(F.lit(0), F.least(room, F.col("size"))) if r.split_last else F.when(2 * room >= F.col("size"), F.col("size")).otherwise(0)
    placed = placed.withColumn("_last", rest.cast("long"))
    given = lambda d: F.struct(d["shard"].cast("int").alias("shard"), F.when(d["pass"] < F.col("_full"), F.col("size")).otherwise(F.col("_last")).alias("words"), F.xxhash64(F.lit(r.seed), d["pass"], "_key").alias("place"))
    draws = F.coalesce(F.filter(F.transform("_draws", given), lambda d: d["words"] > 0), F.array().cast("array<struct<shard:int,words:bigint,place:bigint>>"))
    placed = placed.withColumn("draws", draws)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws", "_row")


def n_shards(r: Recipe, words: int) -> int:
    return int(min(SHARDS, max(1, -(-r.share * words // r.shard_words))))


def _hash(docs: DataFrame) -> Column:
    """Of all columns that have one (maps and variants do not)."""
    fine = [f.name for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in fine])


def mixture(docs: DataFrame, recipe: Recipe = Recipe(split_last=False)) -> DataFrame:
    """The documents of the mix, each as often as it is drawn, grouped by output shard and in the
    shard's local random order; the columns are those of ``docs``. Rows that are equal in all columns
    are drawn each on its own and come as often as all of them together."""
    mine = packed(docs, id=F.col("doc_id"), of=F.col("source"), size=n_words(F.col("text")), print=_hash(docs))
    drawn = mix(docs.select("doc_id", "source", "text", _hash(docs).alias("_print")), recipe, row=F.col("_print"))
    drawn = drawn.select(F.col("doc_id").alias("_id"), F.col("source").alias("_of"), F.col("size").alias("_size"), F.col("_row").alias("_print"), "draws")
    # rows that are equal in all columns are one row here, with the draws of all
    by = drawn.filter(F.size("draws") > 0).groupBy("_id", "_of", "_size", "_print")
    drawn = cut(by.agg(F.count("*").alias("_copies"), F.flatten(F.array_sort(F.collect_list("draws"))).alias("_draws")))
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("of").eqNullSafe(F.col("_of")) & (F.col("size") == F.col("_size")) & (F.col("print") == F.col("_print"))
    words, last, alike = drawn.agg(F.sum(F.aggregate("_draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])), F.max(F.array_max(F.transform("_draws", lambda d: d["shard"]))), F.max("_copies")).first()
    out = mine.join(drawn, same)
    if (alike or 1) > 1:
        keys = ["id", "of", "size", "print"]
        once = mine.join(drawn.filter("_copies > 1"), same).groupBy(*keys).agg(F.first("row").alias("row"), F.first("_draws").alias("_draws"))
        out = mine.join(drawn.filter("_copies = 1"), same).select("row", "_draws").unionByName(once.select("row", "_draws"))
    out = out.select("row", F.explode("_draws").alias("draw"))
    # a shard beyond SHARDS x shard_words is written in parts, by its own random order
    shards = (last or 0) + 1
    parts = max(1, -(-(words or 0) // (shards * recipe.shard_words)))
    out = out.withColumn("part", F.pmod("draw.place", F.lit(parts)))
    # one task for each part of a shard: a hash of so few numbers would put several into one
    out = out.repartitionById(int(shards * parts), (F.col("draw.shard") * F.lit(parts) + F.col("part")).cast("int")).sortWithinPartitions("draw.place", "draw.shard")
    return unpacked(out, docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, CAST(2 * size AS DOUBLE) / weight AS ratio,
             sum(2 * size) OVER (ORDER BY CAST(2 * size AS DOUBLE) / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - 2 * size AS full_before,
             sum(weight) OVER (ORDER BY CAST(2 * size AS DOUBLE) / weight DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS open_weight,
             sum(size) OVER () AS total FROM w),
l AS (SELECT *, (1.5 * CAST(total AS DOUBLE) - CAST(full_before AS DOUBLE)) / CAST(open_weight AS DOUBLE) AS level FROM o),
t AS (SELECT source, size AS source_size,
             least((SELECT level FROM l AS x WHERE x.level <= x.ratio ORDER BY x.full_before, x.ratio LIMIT 1) * weight, CAST(2 * size AS DOUBLE)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(CAST(floor(target + 0.5) AS BIGINT) // source_size, 2) END AS fully FROM t),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) - fully * source_size AS rest FROM p),
r AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.fully, q.rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(fully * size + greatest(0, least(rest - before, size)) AS BIGINT) AS taken,
       CASE WHEN size = 0 THEN 0 ELSE fully + CAST(rest > before AS BIGINT) END AS n_draws FROM r
"""
