"""Aggregates over records of executed operations and over response metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.catalog import Catalog
from weft.gql.syntax import Field, Inline, Operation


def coordinates(catalog: Catalog, op: Operation) -> list[str]:
    """Schema coordinates that a normal-form operation uses: fields, arguments, enum and input values."""
    out: dict[str, None] = {}

    def inputs(t, v) -> None:
        d = catalog.types.get(t.base)
        if d is None or v is None:
            return
        for x in v if isinstance(v, list) else [v]:
            if d.kind == "input" and isinstance(x, dict):
                for k, y in x.items():
                    if k in d.fields:
                        out[f"{d.name}.{k}"] = None
                        inputs(d.fields[k].type, y)
            elif d.kind == "enum":
                out[f"{d.name}.{x}"] = None

    def walk(selections: list, parent: str) -> None:
        for s in selections:
            if isinstance(s, Inline):
                walk(s.selections, s.on or parent)
                continue
            if not isinstance(s, Field) or s.name.startswith("__"):
                continue
            f = catalog.field(parent, s.name)
            out[f"{parent}.{s.name}"] = None
            for k, v in s.args.items():
                if k in f.args:
                    out[f"{parent}.{s.name}.{k}"] = None
                    inputs(f.args[k].type, v)
            walk(s.selections or [], f.type.base)

    walk(op.selections, catalog.roots[op.kind])
    return sorted(out)


def rollup(records: DataFrame, key: str, body: Column, ok: Column, at: str) -> DataFrame:
    """One row for each operation: its first body, executions and successes."""
    return records.groupBy(key).agg(F.min_by(body, F.col(at)).alias("body"), F.count("*").alias("n"), F.sum(ok.cast("long")).alias("n_ok"))


def sample_records(records: DataFrame, key: str, at: list[str], rate: float, seed: int = 0) -> DataFrame:
    """A Bernoulli sample, and the first record of each key in any case."""
    first = Window.partitionBy(key).orderBy(*at)
    hashed = F.pmod(F.xxhash64(F.lit(seed), *at), F.lit(1_000_000)) < int(rate * 1_000_000)
    return records.withColumn("_first", F.row_number().over(first) == 1).filter(F.col("_first") | hashed).drop("_first")


def coordinate_usage(records: DataFrame, coords: str, operation: str) -> DataFrame:
    """How many operations and executions used each coordinate. coords: an array column."""
    return records.select(operation, F.explode(coords).alias("coordinate")).groupBy("coordinate").agg(F.count("*").alias("n"), F.countDistinct(operation).alias("n_operations"))


def aggregate_values(records: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """``first``, ``last`` and ``append`` of values in a declared order."""
    by = F.struct(*order)
    return records.groupBy(key).agg(F.min_by(value, by).alias("first"), F.max_by(value, by).alias("last"), F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"]).alias("append"))


def cache_control(records: DataFrame, key: str, max_age: str, no_store: str, private: str) -> DataFrame:
    """The most restrictive policy wins; no-store or private poison the rest."""
    out = records.groupBy(key).agg(F.min(max_age).alias("max_age"), F.bool_or(no_store).alias("no_store"), F.bool_or(private).alias("private"))
    return out.withColumn("max_age", F.when(F.col("no_store"), F.lit(0)).otherwise(F.col("max_age")))


def histogram(records: DataFrame, value: Column, bounds: tuple[int, ...]) -> DataFrame:
    """Counts in explicit buckets, the bound included; null is the bucket above the last."""
    from weft.functions.cost import bucket

    return records.groupBy(bucket(value, bounds).alias("bucket")).agg(F.count("*").alias("n"))
