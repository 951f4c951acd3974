"""Lowering of plans to lazy DataFrames.

A position in the result owns columns of the DataFrame under construction. A scan starts one, a
keyed left join widens it, an object adds the columns of its own position to the same rows, and a
list is a DataFrame of its own, grouped by the parent's key and joined once. The struct of each
object is built last, from the leaves up, with its null rules. Nothing here runs a job.
"""

from __future__ import annotations

from dataclasses import replace
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weft.catalog import Catalog
from weft.gql.syntax import GraphQLError, TypeRef
from weft.operators.nulls import build, settle
from weft.plans.planner import EntityPlan, FieldPlan, RootPlan
from weft.sources.registry import Registry

Env = dict[tuple[str, str], str]
REENTRY = 1000  # rows that a root list below the root may have
_TYPES = {"Int": T.LongType(), "Float": T.DoubleType(), "Boolean": T.BooleanType()}
_COUNTS = ("first", "limit")
_SLICES = (*_COUNTS, "last")


def _slices(args: dict[str, Any]) -> tuple[int | None, int | None]:
    """(first, last) of the arguments; with both, the last of the first."""
    n = next((args[k] for k in _COUNTS if args.get(k) is not None), None)
    last = args.get("last")
    return (None if n is None else max(0, n)), (None if last is None else max(0, last))


class Lowering:
    def __init__(self, catalog: Catalog, registry: Registry, streaming: dict[tuple[str, str], DataFrame] | None = None, guard: bool = True):
        """guard: values that an enum does not have are null; else they stay."""
        self.catalog, self.registry, self.streaming, self.guard = catalog, registry, streaming or {}, guard
        self._ids = count()
        self.before: dict[int, Any] = {}  # of a root's plan: its slice
        self.marks: dict[int, str] = {}  # of an interface object's plan: true where a row is of its type

    def _name(self, hint: str) -> str:
        return f"_{next(self._ids)}_{hint.replace('.', '_')}"

    # reads

    def _table(self, source: str, holder: str) -> DataFrame:
        return self.streaming.get((source, holder)) if (source, holder) in self.streaming else self.registry.read(source, holder)

    def scan(self, plan: EntityPlan, args: dict[str, Any], where=None) -> tuple[DataFrame, Env, str]:
        """The rows of a position's own source, its columns and a mark that is true for each row."""
        df = self._table(plan.source, plan.holder)
        if where is not None:
            df = df.filter(where(args))
        else:
            for k, v in args.items():
                if k in _SLICES:
                    continue
                c = self.registry.column(plan.source, plan.holder, k)
                df = df.filter(c.isNull() if v is None else c.isin(v) if isinstance(v, list) else c == F.lit(v))
        env = {(plan.source, c): self._name(c) for c in plan.columns}
        mark = self._name("here")
        return df.select(*[self.registry.column(plan.source, plan.holder, c).alias(n) for (_, c), n in env.items()], F.lit(True).alias(mark)), env, mark

    def hops(self, df: DataFrame, plan: EntityPlan, env: Env) -> DataFrame:
        for h in plan.hops:
            if h.holder is None:
                env |= {(h.source, p): self._find(plan, env, p) for p in h.key}
                continue
            keys = {p: self._name(p) for p in h.key}
            columns = {c: self._name(c) for c in h.columns if c not in keys}
            if not columns and not h.inner:  # nothing but the key itself: the join would change no row
                env |= {(h.source, p): self._find(plan, env, p) for p in h.key}
                continue
            right = self._table(h.source, h.holder).select(*[self.registry.column(h.source, h.holder, c).alias(n) for c, n in (keys | columns).items()])
            if not self.registry.is_unique(h.source, h.holder, set(keys)):
                right = one_each(right, list(keys.values()))
            if h.inner:
                mark = self._name("is")
                right = right.withColumn(mark, F.lit(True))
                self.marks[id(plan)] = mark
            on = None
            for p, n in keys.items():
                left = F.col(self._find(plan, env, p))
                on = (left == F.col(n)) if on is None else on & (left == F.col(n))
            df = df.join(right, on, "left")
            env |= {(h.source, c): n for c, n in (keys | columns).items()}
        return df

    def _find(self, plan: EntityPlan, env: Env, path: str) -> str:
        for s in (plan.source, *[h.source for h in plan.hops]):
            if (s, path) in env:
                return env[s, path]
        raise GraphQLError(f"{plan.type}.{path} is not at hand")

    # positions

    def entity(self, df: DataFrame, plan: EntityPlan, env: Env) -> tuple[DataFrame, Column]:
        df = self.hops(df, plan, env)
        values: list[tuple[str, Column, TypeRef]] = []
        for f in plan.fields:
            df, c = self.field(df, plan, env, f)
            values.append((f.key, c, f.type))
        value = build(values)
        return df, F.when(F.col(self.marks[id(plan)]), value) if id(plan) in self.marks else value

    def rows_of(self, children: dict[str, EntityPlan], args: dict[str, Any], where=None) -> dict[str, tuple[DataFrame, Env, Column]]:
        """type -> its rows, their columns and values. The types of an interface object come from
        one scan, whose rows stay if no type claims them: they are one branch, with a null there."""
        if not any(h.inner for c in children.values() for h in c.hops):
            out = {}
            for t, child in children.items():
                df, env, _ = self.scan(child, args, where)
                out[t] = (df, child, env)
            return {t: (*self._sliced(*x, args, len(out) == 1),) for t, x in out.items()}
        plans = list(children.values())
        every = replace(plans[0], columns=list(dict.fromkeys(c for p in plans for c in p.columns)), hops=[], fields=[])
        df, env, _ = self.scan(every, args, where)
        values: dict[str, Column] = {}
        for t, child in children.items():
            df, values[t] = self.entity(df, child, dict(env))
        wide = self.widen({t: (df, v) for t, v in values.items()})
        return {"": (df, env, F.coalesce(*[F.when(values[t].isNotNull(), w) for t, w in wide.items()]))}

    def _sliced(self, df: DataFrame, child: EntityPlan, env: Env, args: dict[str, Any], alone: bool) -> tuple[DataFrame, Env, Column]:
        before = self.before.get(id(child)) if alone else None
        df = before(df, env) if before else df  # the slice comes first, so that joins see only its rows
        df, value = self.entity(df, child, env)
        return df, env, value

    def field(self, df: DataFrame, plan: EntityPlan, env: Env, f: FieldPlan) -> tuple[DataFrame, Column]:
        if f.kind == "typename":
            return df, F.lit(plan.type)
        if f.kind == "empty":
            return df, F.lit(True)
        if f.kind == "null":
            return df, F.lit(None).cast(self.null_type(f))
        if f.kind == "leaf":
            name = env.get((f.source, f.name)) or self._find(plan, env, f.name)
            return df, self.leaf(F.col(name), f.type, f.source)
        if f.kind == "compute":
            given: dict[str, Column] = {}
            for r in f.requires:
                df, given[r.key] = self.field(df, plan, env, r)
            return df, self.leaf(self.registry.resolvers[f.source, f.of].compute(given, f.args), f.type, f.source)
        if f.kind == "reentry":
            return self.reentry(df, f)
        return self.list(df, plan, env, f) if f.kind == "list" else self.object(df, plan, env, f)

    def leaf(self, c: Column, t: TypeRef, source: str) -> Column:
        d = self.catalog.types.get(t.base)
        if d is not None and d.kind == "enum" and self.guard:
            values = self.catalog.enum_values(t.base)

            def check(x: Column, at: TypeRef) -> Column:
                return F.when(x.isin(values), x) if at.of is None else F.transform(x, lambda y: check(y, at.of))

            c = check(c, t)
        return settle(c, t)

    def null_type(self, f: FieldPlan) -> T.DataType:
        if f.children:
            fields: dict[str, T.DataType] = {}
            for p in f.children.values():
                for g in p.fields:
                    fields.setdefault(g.key, self.null_type(g))
            out: T.DataType = T.StructType([T.StructField(k, v) for k, v in fields.items()])
        else:
            out = _TYPES.get(f.type.base, T.StringType())
        t = f.type
        while t.of is not None:
            out, t = T.ArrayType(out), t.of
        return out

    def object(self, df: DataFrame, plan: EntityPlan, env: Env, f: FieldPlan) -> tuple[DataFrame, Column]:
        parts: dict[str, Column] = {}
        for concrete, child in f.children.items():
            own = {c: self._column(plan, env, f, p) for p, c in f.link.on}
            if child.holder is None:
                sub: Env = {(child.source, c): n for c, n in own.items()}
                sub |= {(child.source, c): env[f.source, p] for p, c in f.link.carries if (f.source, p) in env}
                here = None
                for n in own.values():
                    here = F.col(n).isNotNull() if here is None else here & F.col(n).isNotNull()
            else:
                right, sub, mark = self.scan(child, f.args)
                if not self.registry.is_unique(child.source, child.holder, set(own)):
                    right = one_each(right, [sub[child.source, c] for c in own])
                on = None
                for c, n in own.items():
                    same = F.col(n) == F.col(sub[child.source, c])
                    on = same if on is None else on & same
                df = df.join(right, on, "left")
                here = F.col(mark).isNotNull()
            df, value = self.entity(df, child, sub)
            if f.link.tag:
                here = here & (F.col(self._column(plan, env, f, f.link.tag)) == concrete)
            parts[concrete] = F.when(here, value)
        if len(parts) == 1 and not self.catalog.is_abstract(f.type.base):
            return df, next(iter(parts.values()))
        wide = self.widen({t: (df, v) for t, v in parts.items()})
        return df, F.coalesce(*[F.when(parts[t].isNotNull(), w) for t, w in wide.items()])

    def _column(self, plan: EntityPlan, env: Env, f: FieldPlan, name: str) -> str:
        return env.get((f.source, name)) or self._find(plan, env, name)

    def list(self, df: DataFrame, plan: EntityPlan, env: Env, f: FieldPlan) -> tuple[DataFrame, Column]:
        keys = [self._name(c) for _, c in f.link.on]
        order = [self._name(c) for c in f.link.order_by]
        branches: dict[str, tuple[DataFrame, Column]] = {}
        rows: dict[str, DataFrame] = {}
        for concrete, child in f.children.items():
            if child.holder is None:
                raise GraphQLError(f"{child.source} has no rows of {concrete} for a list")
        for concrete, (sub, cenv, value) in self.rows_of(f.children, f.args).items():
            child = f.children.get(concrete) or next(iter(f.children.values()))
            named = [F.col(cenv[child.source, c]).alias(k) for (_, c), k in zip(f.link.on, keys)] + [F.col(cenv[child.source, c]).alias(o) for c, o in zip(f.link.order_by, order)]
            rows[concrete] = sub.select(*named, value.alias("_v"))
            branches[concrete] = (rows[concrete], F.col("_v"))
        if len(rows) == 1 and ("" in rows or not self.catalog.is_abstract(f.type.base)):
            all_ = next(iter(rows.values()))
        else:
            wide = self.widen(branches)
            all_ = None
            for t, r in rows.items():
                part = r.select(*keys, *order, F.when(F.col("_v").isNotNull(), wide[t]).alias("_v"))
                all_ = part if all_ is None else all_.unionByName(part)
        n, last = _slices(f.args)
        # without an order key the slice is by value, so that reruns agree
        by = order or ([F.struct("_v")] if _sortable(all_, order) else [F.xxhash64(*keys)])
        for most, ascending in ((n, True), (last, False)):
            if most is not None:
                # pruned before rows are gathered: no parent brings more than its slice to a task
                rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.asc(o) if ascending else F.desc(o) for o in by]))
                all_ = all_.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")
        name = self._name(f.key)
        packed = F.collect_list(F.struct(*order, F.col("_v")))
        # structs keep null elements, which a bare collect_list would drop
        packed = F.array_sort(packed) if order and _sortable(all_, order) else packed
        grouped = all_.groupBy(*keys).agg(F.transform(packed, lambda x: x["_v"]).alias(name))
        on = None
        for (p, _), k in zip(f.link.on, keys):
            same = F.col(self._column(plan, env, f, p)) == F.col(k)
            on = same if on is None else on & same
        df = df.join(grouped, on, "left")
        return df, settle(F.coalesce(F.col(name), F.array().cast(grouped.schema[name].dataType)), f.type)

    def reentry(self, df: DataFrame, f: FieldPlan) -> tuple[DataFrame, Column]:
        """The root again, below a position. Its value is the same for every row, so it is made once
        and broadcast, behind a check of its size: a root list that is not sliced to ``REENTRY`` rows
        is counted, up to that number, and refused beyond it. Such a list would be one unbounded value
        repeated in every row: ask for it as a root of its own."""
        values = []
        for r in f.roots:
            name = self._name(r.key)
            sizes = [x for x in _slices(r.args) if x is not None]
            inner = self.root(r)
            if r.type.of is not None and (not sizes or min(sizes) > REENTRY) and inner.limit(REENTRY + 1).count() > REENTRY:
                raise GraphQLError(f"{f.key}.{r.key}: a root list below the root may have {REENTRY} rows: ask for a slice, or for it as a root of its own", "UNBOUNDED_REENTRY")
            # an object is its first row; rows are at most REENTRY, so the broadcast is bounded
            inner = inner if r.type.of is not None else inner.limit(1)
            spec = self.registry.roots[r.source, r.name]
            one = inner.agg(F.collect_list(F.struct(*inner.columns)).alias(name))
            if spec.order_by and _sortable(one.withColumnRenamed(name, "_v"), []):
                one = one.select(F.array_sort(name).alias(name))
            df = df.crossJoin(F.broadcast(one))
            value = F.col(name) if r.type.of is not None else F.get(F.col(name), 0)
            values.append((r.key, settle(value, r.type), r.type))
        return df, build(values)

    def widen(self, parts: dict[str, tuple[DataFrame, Column]]) -> dict[str, Column]:
        """One struct type for several concrete types: all their fields. A field whose types differ
        becomes one field for each type that has it."""
        shapes = {t: df.select(v.alias("v")).schema["v"].dataType for t, (df, v) in parts.items()}
        kinds: dict[str, dict[str, T.DataType]] = {}
        for t, s in shapes.items():
            for x in s.fields:
                kinds.setdefault(x.name, {})[t] = x.dataType
        fields: list[tuple[str, str, T.DataType, set[str]]] = []
        for k, by in kinds.items():
            if len({d.simpleString() for d in by.values()}) == 1:
                fields.append((k, k, next(iter(by.values())), set(by)))
            else:
                fields += [(f"{k}__{t}", k, d, {t}) for t, d in by.items()]
        return {t: F.struct(*[(v[k] if t in holders else F.lit(None)).cast(d).alias(out) for out, k, d, holders in fields]) for t, (_, v) in parts.items()}

    def root(self, plan: RootPlan, ordered: bool = False) -> DataFrame:
        """One row for each root entity; a column for each response key."""
        spec = self.registry.roots[plan.source, plan.name]
        order = [self._name(o) for o in spec.order_by]
        branches, rows = {}, {}
        children = {t: c for t, c in plan.children.items() if c.holder is not None}
        alone = len(plan.children) == 1 and not any(h.inner for c in children.values() for h in c.hops)
        if alone and any(x is not None for x in _slices(plan.args)):
            child = next(iter(children.values()))
            self.before[id(child)] = lambda df, env: _slice(df, [env[child.source, o] for o in spec.order_by], plan.args)
        for concrete, (df, env, value) in self.rows_of(children, plan.args, spec.where).items():
            child = children.get(concrete) or next(iter(children.values()))
            rows[concrete] = df.select(*[F.col(env[child.source, c]).alias(o) for c, o in zip(spec.order_by, order)], value.alias("_v"))
            branches[concrete] = (rows[concrete], F.col("_v"))
        if len(rows) == 1 and ("" in rows or not self.catalog.is_abstract(plan.type.base)):
            out = next(iter(rows.values()))
        else:
            wide, out = self.widen(branches), None
            for t, r in rows.items():
                part = r.select(*order, F.when(F.col("_v").isNotNull(), wide[t]).alias("_v"))
                out = part if out is None else out.unionByName(part)
        if not alone:
            out = _slice(out, order, plan.args)
        return (out.orderBy(*order) if ordered and order else out).select("_v.*")


def _slice(df: DataFrame, order: list[str], args: dict[str, Any]) -> DataFrame:
    """first and last of a root. Without an order key the order is that of all columns."""
    n, last = _slices(args)
    by = order or [c for c, t in ((f.name, f.dataType) for f in df.schema.fields) if not any(isinstance(x, T.MapType | T.VariantType) for x in _kinds(t))]
    if n is not None:
        df = df.orderBy(*[F.asc(o) for o in by]).limit(n)
    if last is not None:
        df = df.orderBy(*[F.desc(o) for o in by]).limit(last)
    return df


def one_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, the least by its other columns: a lookup answers with one entity."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    if any(isinstance(x, T.MapType | T.VariantType) for c in rest for x in _kinds(df.schema[c].dataType)):
        return df.dropDuplicates(keys)
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_one")).select(*keys, *[F.col("_one")[c].alias(c) for c in rest])


def _sortable(df: DataFrame, order: list[str]) -> bool:
    """array_sort compares whole structs: fine unless a value after the order keys has no order."""
    return not any(isinstance(x, T.MapType | T.VariantType) for x in _kinds(df.schema["_v"].dataType))


def _kinds(d: T.DataType):
    yield d
    if isinstance(d, T.StructType):
        for f in d.fields:
            yield from _kinds(f.dataType)
    elif isinstance(d, T.ArrayType):
        yield from _kinds(d.elementType)
