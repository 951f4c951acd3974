"""Values that an enum does not have, found in an answer that still holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.catalog import Catalog
from weft.gql.syntax import TypeRef
from weft.plans.planner import EntityPlan, RootPlan


def _flat(values: Column, d: T.DataType) -> tuple[Column, T.DataType]:
    """An array of values, and their type, with lists inside it opened and nulls left out."""
    values = F.filter(values, lambda x: x.isNotNull())
    while isinstance(d, T.ArrayType):
        values, d = F.filter(F.flatten(values), lambda x: x.isNotNull()), d.elementType
    return values, d


def invalid_values(df: DataFrame, catalog: Catalog, plan: RootPlan) -> DataFrame:
    """path, value, code, message, n."""
    found: dict[str, tuple[Column, list[str], str]] = {}

    def entity(p: EntityPlan, objects: Column, shape: T.StructType, path: str) -> None:
        for f in p.fields:
            # types that clash at an abstract position have fields of their own
            name = next((n for n in (f.key, f"{f.key}__{p.type}") if n in shape.names), None)
            if name is None or f.kind in ("typename", "empty", "null", "reentry"):
                continue
            values, d = _flat(F.transform(objects, lambda x: x[name]), shape[name].dataType)  # noqa: B023
            if f.children and isinstance(d, T.StructType):
                for child in f.children.values():
                    entity(child, values, d, f"{path}.{f.key}")
            elif not f.children:
                leaf(values, f.type, f"{path}.{f.key}")

    def leaf(values: Column, t: TypeRef, path: str) -> None:
        d = catalog.types.get(t.base)
        if d is not None and d.kind == "enum":
            allowed = list(catalog.enum_values(t.base))
            found[path] = (F.filter(values, lambda x: ~x.isin(allowed)), allowed, t.base)

    for child in plan.children.values():
        entity(child, F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns])), df.schema, plan.key)
    if not found:
        return df.sparkSession.createDataFrame([], "path string, value string, code string, message string, n long")
    told = [F.transform(v.cast("array<string>"), lambda x: F.struct(F.lit(path).alias("path"), F.lit(kind).alias("kind"), x.alias("value"))) for path, (v, _, kind) in found.items()]  # noqa: B023
    rows = df.select(F.explode(F.concat(*told)).alias("_e")).groupBy("_e.path", "_e.kind", "_e.value").agg(F.count("*").alias("n"))
    return rows.select("path", "value", F.lit("INVALID_ENUM_VALUE").alias("code"), F.concat(F.lit("not a value of "), "kind", F.lit(": "), "value").alias("message"), "n")
