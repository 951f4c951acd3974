"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct ``n``-word shingles (64-bit hashes). Sets are ordered by
estimated document frequency, rare first. If two sets are similar, their prefixes of length
|x| - ceil(t|x|) + l share at least l shingles, for any l. Every set chooses its own l: the
estimated cost of a prefix is the length of the posting lists it reads plus the verification of
the candidates that at least l of them yield, and the cheapest l wins; sets with frequent
shingles get longer prefixes and ask for more shared ones. A pair needs the smaller of its two l.
Pairs meet at the first shingle they share, which must leave enough shingles behind it, in both,
for the overlap; their whole prefixes are then compared, and only those that share l go on.

Frequencies come from one count table of ``SLOTS`` cells over all documents (fixed size,
broadcast). They only order shingles: any order gives the same result.

Equal sets form one class and are joined as one. In each posting list the classes are first
verified against the most typical one and along a chain, a linear number of pairs; links found so
join classes to components. Afterwards only posting lists that still hold several components are
joined with themselves, across components and under the exact conditions above, so a group of
thousands of near copies costs no quadratic work once it hangs together, and no link between
different components is lost. All candidates are verified on the whole sets.

All links of a document lie in its component, so the components, once known, tell where links are:
the whole sets of each component are compared in blocks, every class with every other, and each
document gets the number of rows it is linked with, equal sets included. No table of links is made;
its rows would grow with the square of a group. Where components alone are wanted (``keep_one``), nothing is counted.

Defined results: null, empty and white-space texts have no shingle, and link with nothing; a text
with fewer than ``n`` words is one shingle; a null id never is a component's id unless all its ids
are null, and is linked like any other; rows that repeat an id are one node only if their sets are equal.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm._shared import WORD, cut, lower_words_of, packed, shingle_hashes, ship, unpacked, utf8
from weft.llm.components import components

SLOTS = 1 << 21
_ROW = 1 << 15  # cells in a row of the count table on its way through the shuffle
_PARTS = 32  # sums of each row after the first level
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20  # classes and shingles in a block of a component, about


_KINDS = {"n_shingles": pa.int64(), "cls": pa.int64(), "more": pa.int64(), "matches": pa.int32(), "typical": pa.float64(), "cold": pa.int32(), "prefix": pa.list_(pa.int64())}
HOT = 1 << 14  # classes of a posting list that one task ranks


def _class(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def added(group: pd.DataFrame) -> pd.DataFrame:
    """One row with the sum of rows of equal number; only the sum is held beside them, however many they are."""
    total = np.zeros(_ROW, np.int64)
    for cells in group["cells"]:
        total += cells
    return pd.DataFrame({"row": [group["row"].iloc[0]], "cells": [np.minimum(total, 2**31 - 1).astype(np.int32)]})


def frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """Cell -> shingles of all documents that fall in it (counts stop at 2**31 - 1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SLOTS, np.int32)
        for batch in batches:
            for text in utf8(batch.column(0)):
                np.add.at(cells, (shingle_hashes(lower_words_of(text), n) & np.uint64(SLOTS - 1)).astype(np.intp), 1)
        if cells.any():
            for i, row in enumerate(cells.reshape(-1, _ROW)):
                yield pa.RecordBatch.from_pydict({"row": pa.array([i], pa.int64()), "cells": pa.array([row], pa.list_(pa.int32()))})

    schema = "row long, cells array<int>"
    parts = docs.select("text").mapInArrow(count, schema).withColumn("_part", F.spark_partition_id() % _PARTS)
    # two levels, so that no group gets the rows of all partitions: the last one gets _PARTS at most
    level = parts.groupBy("row", "_part").applyInPandas(added, schema)
    out = np.zeros(SLOTS, np.int32)
    for r in level.groupBy("row").applyInPandas(added, schema).toLocalIterator():
        out[r.row * _ROW : (r.row + 1) * _ROW] = r.cells
    return out


def choose(df: np.ndarray, n: int, least: int, most_matches: int, verify: float) -> int:
    """The l of least estimated cost. df: the ordered frequencies of one set."""
    best, cost = 1, None
    reads = np.cumsum(np.maximum(df[: n - least + most_matches].astype(np.float64) - 1, 0))
    for matches in range(1, min(most_matches, least) + 1):
        read = reads[n - least + matches - 1]
        now = read + verify * read / matches
        if cost is None or now < cost:
            best, cost = matches, now
    return best


def prefixes(docs: DataFrame, table: np.ndarray, n: int, percent: int, most_matches: int, verify: float) -> DataFrame:
    """doc_id, print (hash of the text), n_shingles, cls and more (128 bits of the set, null without
    shingles), matches, typical, prefix and cold: from this place on the prefix has shingles that more
    than ``HOT`` documents may hold."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for whole in batches:
            for batch in (whole.slice(at, 1024) for at in range(0, whole.num_rows, 1024)):
                out = {k: [] for k in _KINDS}
                for text in utf8(batch.column(2)):
                    s = shingle_hashes(lower_words_of(text), n)
                    size = len(s)
                    matches, prefix, typical, cold, cls, more = 0, None, 0.0, 0, None, None
                    if size:
                        df = cells[(s & np.uint64(SLOTS - 1)).astype(np.intp)]
                        order = np.argsort(df, kind="stable")  # equal frequencies stay ordered by hash
                        least = -(-percent * size // 100)
                        matches = choose(df[order], size, least, most_matches, verify)
                        at = order[: size - least + matches]
                        prefix, cold = _signed(s[at]), int(np.searchsorted(df[at], HOT, "right"))
                        typical = float(np.log(df).mean())
                        cls, more = _class(s)
                    for k, x in (("n_shingles", size), ("cls", cls), ("more", more), ("matches", matches), ("typical", typical), ("cold", cold), ("prefix", prefix)):
                        out[k].append(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(out[k], t) for k, t in _KINDS.items()]], ["doc_id", "print", *_KINDS])

    ids = docs.schema["doc_id"].dataType.simpleString()
    mine = docs.select("doc_id", F.xxhash64("text").alias("print"), "text")
    return mine.mapInArrow(work, f"doc_id {ids}, print long, n_shingles long, cls long, more long, matches int, typical double, cold int, prefix array<long>")


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with ``cls`` as one number for each different set, and the classes: cls, rep (a row
    of it, that with the least id: no id, id, print), size and rows. Two sets whose first 64 bits agree
    by chance, a handful among 1e10, get numbers of their own: that with the least second half keeps
    its own, the others take a hash of all bits."""
    by = rows.filter(F.col("cls").isNotNull()).groupBy("cls", "more")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("print").alias("print")))
    found = cut(by.agg(least.alias("rep"), F.min("n_shingles").alias("size"), F.count("*").alias("rows")))
    clash = found.groupBy(F.col("cls").alias("_c")).agg(F.min("more").alias("_least"), F.count("*").alias("_n")).filter("_n > 1").select("_c", "_least")
    other = cut(found.join(clash, F.col("cls") == F.col("_c")).filter("more <> _least").select("_c", F.col("more").alias("_m"), F.xxhash64(F.lit(1), "_c", "more").alias("_new")))
    if other.limit(1).count():
        numbered = lambda df: df.join(other, (F.col("cls") == F.col("_c")) & (F.col("more") == F.col("_m")), "left").withColumn("cls", F.coalesce("_new", "cls")).drop("_c", "_m", "_new")
        rows, found = cut(numbered(rows)), cut(numbered(found))
    return rows, found.drop("more")


def texts_of(docs: DataFrame, classes: DataFrame, repeats: bool, *columns: str) -> DataFrame:
    """cls, text of the representative of each of ``classes``, and these columns of theirs. repeats:
    whether rows may repeat a representative, id and text; one of them counts."""
    mine = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_print"), F.col("text").alias("text"))
    out = mine.join(classes, F.col("_id").eqNullSafe(F.col("rep.id")) & (F.col("_print") == F.col("rep.print"))).select("cls", "text", *columns)
    return out.dropDuplicates(["cls"]) if repeats else out


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int, repeats: bool) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar."""
    needed = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    texts = cut(texts_of(docs, classes.join(needed, "cls", "left_semi"), repeats))
    left = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[tuple[int, bytes], np.ndarray] = OrderedDict()

        def of(cls: int, text: bytes) -> np.ndarray:
            key = (cls, text)
            if key not in held:
                held[key] = shingle_hashes(lower_words_of(text), n)
                if len(held) > 64:
                    held.popitem(last=False)
            return held[key]

        for batch in batches:
            good = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), utf8(batch.column(3))):
                x, y = of(a, ta), of(b, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long").distinct()


def linked(sets: list[np.ndarray], others: list[np.ndarray], percent: int) -> Iterator[np.ndarray]:
    """For each of ``sets``, which of ``others`` are similar. All are sorted and distinct."""
    sizes = np.array([len(y) for y in others], np.int64)
    tokens = np.concatenate(others)
    owner = np.repeat(np.arange(len(others)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    for x in sets:
        low, high = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(others))
        yield 100 * both >= percent * (len(x) + sizes - both)


def link_counts(docs: DataFrame, classes: DataFrame, roots: DataFrame, n: int, percent: int, repeats: bool) -> DataFrame:
    """_l (class), _links: rows of other classes that are similar. roots: v, root of the non-roots."""
    of = roots.select(F.col("v").alias("cls"), "root").unionByName(roots.select(F.col("root").alias("cls"), "root").distinct())
    held = cut(classes.join(of, "cls"))
    wide = held.groupBy(F.col("root").alias("_r")).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("_blocks"))
    at = cut(held.join(wide, F.col("root") == F.col("_r")).drop("_r", "size").withColumn("_block", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("_blocks")).cast("int")))
    texts = texts_of(docs, at, repeats, "rows", "root", "_blocks", "_block")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in (big.slice(i, 1024) for i in range(0, big.num_rows, 1024)):
                sets = [shingle_hashes(lower_words_of(t), n) for t in utf8(batch.column(1))]
                cells = pa.array([_signed(x).tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), cells, *batch.columns[2:]], ["cls", "shingles", "rows", "root", "_blocks", "_block"])

    sets = texts.mapInArrow(whole, "cls long, shingles binary, rows long, root long, _blocks int, _block int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    cells = sets.select("cls", "shingles", "rows", "root", "_block", other).select("cls", "shingles", "rows", "root", "_block", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"))

    def count(g: pd.DataFrame) -> pd.DataFrame:
        low, high = (g[g["_block"] == k] for k in (g["_i"].iloc[0], g["_j"].iloc[0]))
        if low.empty or high.empty:
            return pd.DataFrame({"_l": [], "_links": []}, dtype="int64")
        same = g["_i"].iloc[0] == g["_j"].iloc[0]
        xs, ys = ([np.frombuffer(b, np.uint64) for b in f["shingles"]] for f in (low, high))
        rows_x, rows_y = low["rows"].to_numpy(np.int64), high["rows"].to_numpy(np.int64)
        of_x, of_y = np.zeros(len(xs), np.int64), np.zeros(len(ys), np.int64)
        for k, similar in enumerate(linked(xs, ys, percent)):
            if same:
                similar[k] = False
            of_x[k] = rows_y[similar].sum()
            of_y[similar] += rows_x[k]
        parts = [(low, of_x)] if same else [(low, of_x), (high, of_y)]
        return pd.DataFrame({"_l": np.concatenate([f["cls"] for f, _ in parts]), "_links": np.concatenate([c for _, c in parts])})

    found = cells.groupBy("root", "_i", "_j").applyInPandas(count, "_l long, _links long")
    return cut(found.groupBy("_l").agg(F.sum("_links").alias("_links")))


def components_of(docs: DataFrame, n: int, percent: int, most_matches: int, verify: float) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """The rows (doc_id, print, n_shingles, cls), the classes, the root of each class that is not one
    itself (v, root), and whether rows repeat a representative."""
    ship(docs.sparkSession)
    table = frequencies(docs, n)
    pieces = max(1, -(-int(table.max()) // HOT))
    rows, classes = classes_of(cut(prefixes(docs, table, n, percent, most_matches, verify)))
    heads = rows.filter(F.col("cls").isNotNull()).join(classes.select(F.col("cls").alias("_c"), "rep"), (F.col("cls") == F.col("_c")) & F.col("doc_id").eqNullSafe(F.col("rep.id")) & (F.col("print") == F.col("rep.print")), "left_semi")
    one = cut(heads.select("cls", F.col("n_shingles").alias("size"), "matches", "typical", "cold", "prefix"))
    repeats = one.count() != classes.count()
    if repeats:
        one = cut(one.dropDuplicates(["cls"]))
    # a shingle can be the first that a pair shares only if enough are left behind it: for partners of at most ``most``
    post = one.select("cls", "size", "typical", "cold", F.posexplode("prefix").alias("_at", "token"))
    # a long posting list is ranked in pieces, others for each of its tokens; links across pieces are found below
    hot = F.col("_at") >= F.col("cold")
    piece = F.when(hot, F.pmod(F.xxhash64("cls", "token"), F.lit(pieces))).otherwise(0).cast("int").alias("_piece")
    post = post.select("token", piece, hot.alias("_hot"), "cls", "size", "typical", F.expr(f"(size - _at) * {100 + percent} div {percent} - size").alias("most")).filter(100 * F.col("most") >= percent * F.col("size"))
    w = Window.partitionBy("token", "_piece").orderBy(F.desc("typical"), "cls")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct("cls", "size", "most")
    shared = cut(post.withColumn("_n", F.count("*").over(every)).withColumn("_first", F.first(me).over(every)).withColumn("_prev", F.lag(me).over(w)).filter("_n > 1 OR _hot").drop("_n", "_hot", "_piece", "typical"))

    def near(other: str):
        return (F.col(f"{other}.cls") != F.col("cls")) & (F.col(f"{other}.size") <= F.col("most")) & (F.col("size") <= F.col(f"{other}.most")) & (100 * F.least("size", f"{other}.size") >= percent * F.greatest("size", f"{other}.size"))

    def pairs(x: DataFrame, other: str) -> DataFrame:
        return x.filter(near(other)).select(F.col(f"{other}.cls").alias("a"), F.col("cls").alias("b"))

    def links_among(found: DataFrame) -> DataFrame:
        """Of candidate pairs, those that share enough of their prefixes and whose sets are similar."""
        heads = one.select("cls", "matches", "prefix")
        at = found.join(heads.toDF("a", "_ma", "_pa"), "a").join(heads.toDF("b", "_mb", "_pb"), "b")
        enough = cut(at.filter(F.size(F.array_intersect("_pa", "_pb")) >= F.least("_ma", "_mb")).select("a", "b"))
        return cut(verified(enough, docs, classes, n, percent, repeats))

    links = links_among(cut(pairs(shared, "_first").unionByName(pairs(shared, "_prev")).distinct()))
    roots = components(links)

    # what still holds several components
    listed = shared.drop("_first", "_prev").join(roots.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = listed.groupBy(F.col("token").alias("_t")).agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high").select("_t")
    open_ = cut(listed.join(mixed, F.col("token") == F.col("_t"), "left_semi"))
    x, y = open_.alias("x"), open_.alias("y")
    fits = (
        (F.col("x.token") == F.col("y.token")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root"))
        & (F.col("x.size") <= F.col("y.most")) & (F.col("y.size") <= F.col("x.most"))
        & (100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size"))
    )
    more = links_among(cut(x.join(y, fits).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()))
    return rows, classes, components(links.unionByName(more)), repeats


def join(docs: DataFrame, n: int = 3, percent: int = 90, most_matches: int = 4, verify: float = 8.0, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, cls, component_id of every row, and n_links: the other rows whose sets are similar."""
    rows, classes, roots, repeats = components_of(docs, n, percent, most_matches, verify)
    named = classes.join(roots.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("rep")["id"].alias("component_id"))
    of_class = named.select("cls", "root", "rows").join(least, "root").select(F.col("cls").alias("_c"), "component_id", "rows")
    if count_links:
        counts = link_counts(docs, classes, roots, n, percent, repeats)
        of_class = of_class.join(counts, F.col("_c") == F.col("_l"), "left").withColumn("n_links", F.col("rows") - 1 + F.coalesce("_links", F.lit(0))).drop("_l", "_links")
    of_class = cut(of_class.drop("rows"))
    out = rows.select("doc_id", "n_shingles", "cls").join(of_class, F.col("cls") == F.col("_c"), "left")
    links_of = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return out.select("doc_id", "n_shingles", "cls", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *links_of)


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, most_matches: int = 4, verify: float = 8.0) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one row of each component does: that with the
    least id (rows without an id last, ties to the smaller hash of the text). Rows without words are
    linked with nothing and stay."""
    _, classes, roots, repeats = components_of(docs, n, percent, most_matches, verify)
    named = classes.join(roots.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    stay = cut(named.groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.id").alias("_id"), F.col("rep.print").alias("_print")))
    mine = packed(docs, id=F.col("doc_id"), print=F.xxhash64("text"), words=F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    found = mine.filter("words").join(stay, F.col("id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")))
    if repeats:  # rows of equal id and text: one of them
        found = found.groupBy("id", "print").agg(F.min_by("row", F.xxhash64(*[F.col("row")[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])).alias("row"))
    return unpacked(found.select("row").unionByName(mine.filter("NOT words").select("row")), docs.columns)
