"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a grouped minimum (merged map-side) and an equi-join that adaptive execution may
split, so a star around one node with very many links does not land in one task. The links are cut
to the shared folder at each step and never reach the driver; only two checksums do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._shared import cut


def _step(links: DataFrame, large: bool) -> DataFrame:
    """links: v, u with u < v. Links each node's neighbours to its least neighbour or itself."""
    both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u"))) if large else links
    # cut, so that the join gets exchanges of its own and a node with very many links can be split
    least = cut(both.groupBy(F.col("v").alias("_v")).agg(F.least(F.min("u"), F.col("_v")).alias("_m")))
    joined = both.join(least, F.col("v") == F.col("_v"))
    if large:
        moved = joined.filter("u > v").select(F.col("u").alias("v"), F.col("_m").alias("u"))
    else:
        moved = joined.select(F.col("u").alias("v"), F.col("_m").alias("u")).unionByName(least.select(F.col("_v").alias("v"), F.col("_m").alias("u")))
    return moved.filter("u < v").distinct()


def components(links: DataFrame) -> DataFrame:
    """v, root for every node with a link, except the roots themselves. links: a, b (longs)."""
    now = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    seen = None
    while True:  # a number of rounds of the order of log(nodes) squared at most
        now = cut(_step(_step(now, True), False))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select("v", F.col("u").alias("root"))
        seen = mark
