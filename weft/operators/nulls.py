"""Null propagation as column expressions, built from the leaves up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.gql.syntax import TypeRef


def settle(value: Column, t: TypeRef) -> Column:
    """A null in a list whose elements must not be null makes the list null, at every level."""
    if t.of is None:
        return value
    if t.of.of is not None:
        value = F.transform(value, lambda x: settle(x, t.of))
    return F.when(F.exists(value, lambda x: x.isNull()), F.lit(None)).otherwise(value) if t.of.required else value


def build(fields: list[tuple[str, Column, TypeRef]]) -> Column:
    """An object: null if a field that must not be null is null."""
    if not fields:
        return F.struct(F.lit(True).alias("__empty"))
    out = F.struct(*[c.alias(k) for k, c, _ in fields])
    bad = None
    for _, c, t in fields:
        if t.required:
            bad = c.isNull() if bad is None else bad | c.isNull()
    return out if bad is None else F.when(~bad, out)
