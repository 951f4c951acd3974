"""The engine: a catalog, the tables behind it, and operations that become lazy DataFrames."""

from __future__ import annotations

import json
from collections import Counter, OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog import Catalog, Overrides
from weft.functions import policy
from weft.functions.cost import MOST, Budget, Estimator, by_fetch, by_source, check, with_actual_cost
from weft.functions.introspect import Introspection
from weft.functions.usage import coordinates
from weft.gql.normalize import normalize, partition
from weft.gql.syntax import Document, Field, GraphQLError, Operation, document_hash, minify, parse, print_operation
from weft.gql.validate import Limits, validate
from weft.operators.invalid import invalid_values
from weft.operators.lower import Lowering
from weft.plans.partial import without
from weft.plans.planner import Planner, RootPlan, describe, reads
from weft.sources.registry import Registry, SourceExecutor
from weft.storage import cut
from weft.streaming.subscribe import Subscriptions, event_time
from weft.variables import coerce_all


@dataclass
class Options:
    overrides: Overrides = Overrides()
    user: policy.User = policy.User()
    reject_unauthorized: bool = False
    operation_filter: Callable[[str, str], bool] | None = None
    budget: Budget = Budget()
    limits: Limits = Limits()
    introspection: bool = True
    ordered: bool = False
    root_nulls: str = "row"  # or "spec": one null element of [T!] makes the whole list null


class Hooks:
    """Called at the stages of a query; each may return a replacement, or None. ``Engine.use`` adds one."""

    def on_init(self, engine: Engine) -> None: ...

    def on_params(self, variables: dict[str, Any], options: Options) -> tuple[dict[str, Any], Options] | None: ...

    def on_parse(self, text: str) -> str | None: ...

    def on_validate(self, doc: Document, errors: list[GraphQLError]) -> list[GraphQLError] | None: ...

    def on_analysis(self, op: Operation) -> Operation | None: ...

    def on_plan(self, plans: list[RootPlan]) -> list[RootPlan] | None: ...

    def on_source(self, source: str, type_name: str, df: DataFrame) -> DataFrame | None: ...

    def on_execute(self, key: str, df: DataFrame) -> DataFrame | None: ...

    def on_error(self, error: GraphQLError) -> GraphQLError | None: ...

    def on_reload(self, sdl: str) -> str | None: ...

    def on_shutdown(self) -> None: ...


@dataclass
class Result:
    """frames: root response key -> lazy DataFrame (rows of the list, or of the one object)."""

    operation: Operation
    plans: list[RootPlan]
    frames: dict[str, DataFrame]
    errors: list[GraphQLError] = field(default_factory=list)
    introspection: dict[str, Any] = field(default_factory=dict)
    estimated_cost: int = 0  # of the plan, lookups included: the sum of cost_by_source
    shape_cost: int = 0  # of the operation alone, without lookups
    cost_by_source: dict[str, int] = field(default_factory=dict)
    cost_by_fetch: dict[tuple[str, str], int] = field(default_factory=dict)
    coordinates: list[str] = field(default_factory=list)
    run: dict[str, RootPlan] = field(default_factory=dict)  # what stands behind each frame: its plan without refused reads

    @property
    def df(self) -> DataFrame:
        if len(self.frames) != 1:
            raise GraphQLError("several root fields: take them from frames")
        return next(iter(self.frames.values()))

    def json(self, key: str | None = None) -> DataFrame:
        """One JSON object for each row, nulls included."""
        df = self.frames[key] if key else self.df
        return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))

    def errors_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(".".join(map(str, e.path)), e.code, e.message) for e in self.errors], "path string, code string, message string")

    def envelope(self, spark: SparkSession, found: DataFrame | None = None) -> DataFrame:
        """The whole answer as rows (part, key, json): ``data`` rows of each root, ``errors``, and
        ``extensions`` with the cost. Rows stay apart, so that a list of any length is written by many
        tasks. found: errors in the data, of ``Engine.value_errors``."""
        dumps = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
        few = [("data", k, dumps(v)) for k, v in self.introspection.items()]
        few += [("errors", ".".join(map(str, e.path)), dumps({"code": e.code, "message": e.message, "path": list(e.path)})) for e in self.errors]
        few.append(("extensions", "cost", dumps({"bySource": self.cost_by_source, "estimated": self.estimated_cost})))
        out = spark.createDataFrame(few, "part string, key string, json string")
        for k in self.frames:
            out = out.unionByName(self.json(k).select(F.lit("data").alias("part"), F.lit(k).alias("key"), "json"))
        if found is not None:
            out = out.unionByName(found.select(F.lit("errors").alias("part"), F.col("path").alias("key"), F.to_json(F.struct("code", "message", F.split("path", r"\.").alias("path"))).alias("json")))
        return out

    def explain(self) -> str:
        return "\n".join(describe(p) for p in self.plans)

    @property
    def reads(self) -> int:
        return sum(reads(c) for p in self.plans for c in p.children.values())


class Engine:
    def __init__(self, spark: SparkSession, sdl: str | Catalog, options: Options | None = None):
        self.spark, self.options = spark, options or Options()
        self.catalog = sdl if isinstance(sdl, Catalog) else Catalog(sdl)
        self.registry = Registry(self.catalog, spark)
        self.subscriptions = Subscriptions()
        self.stored: dict[str, str] = {}
        self.rules: tuple = ()
        self.hooks: list[Hooks] = []
        self._plans: OrderedDict[tuple, tuple] = OrderedDict()
        self._frames: OrderedDict[tuple, DataFrame] = OrderedDict()  # analysed, never run
        self.version = 0
        self.counters: Counter[str] = Counter()
        self._filters: list[Callable[[str, str], bool]] = []  # operation filters seen: their place names them

    # schema and sources

    def reload(self, sdl: str) -> None:
        """A new schema: running subscriptions end, cached plans go, tables stay."""
        for h in self.hooks:
            sdl = h.on_reload(sdl) or sdl
        self.catalog = Catalog(sdl)
        self.registry.catalog = self.catalog
        self._changed()
        self.subscriptions.end_all()

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, options: Options | None = None) -> Engine:
        return cls(spark, "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()), options)

    def _changed(self) -> Engine:
        """Plans made with other sources no longer count."""
        self.version += 1
        self._plans.clear()
        self._frames.clear()
        return self

    def source(self, source: str, type_name: str, load, columns: dict[str, str] | None = None, unique: tuple[str, ...] | None = None) -> Engine:
        """unique: columns that are a key of the table. Lookups by any other columns take one row of each."""
        self.registry.add(source, type_name, load, columns, unique)
        return self._changed()

    def executor(self, source: str, executor: SourceExecutor) -> Engine:
        """Another way to read all tables of a source: a filter by tenant, a cache, a version of a table format."""
        self.registry.executors[self.catalog.source(source)] = executor
        return self._changed()

    def link(self, source: str, coordinate: str, on: dict[str, str], order_by: tuple[str, ...] = (), tag: str | None = None, carries: dict[str, str] | None = None) -> Engine:
        self.registry.link(source, coordinate, on, order_by, tag, carries)
        return self._changed()

    def root(self, source: str, name: str, order_by: tuple[str, ...] = (), where=None) -> Engine:
        self.registry.root(source, name, order_by, where)
        return self._changed()

    def resolver(self, source: str, coordinate: str) -> Callable:
        def put(compute: Callable[[dict[str, Column], dict[str, Any]], Column]):
            self.registry.resolver(source, coordinate, compute)
            self._changed()
            return compute

        return put

    def mutation(self, name: str) -> Callable:
        def put(run: Callable[..., None]):
            self.registry.mutation(name, run)
            self._changed()
            return run

        return put

    def store(self, manifest: dict[str, str] | str) -> Engine:
        """Stored operations: id -> text, or the path of such a JSON file."""
        if isinstance(manifest, str):
            manifest = json.loads("".join(r.value for r in self.spark.read.text(manifest, wholetext=True).collect()))
        self.stored |= manifest
        return self

    def use(self, hook: Hooks) -> Engine:
        hook.on_init(self)
        self.hooks.append(hook)
        return self

    def close(self) -> None:
        """Ends the subscriptions and tells the hooks, the last one first."""
        self.subscriptions.end_all("the engine was closed")
        while self.hooks:
            self.hooks.pop().on_shutdown()

    # queries

    def prepare(self, text: str | None = None, variables: dict[str, Any] | None = None, operation: str | None = None, id: str | None = None, options: Options | None = None) -> tuple[Operation, list[Field], list[RootPlan], dict]:
        """Everything before Spark: parse, validate, normalise, authorise, plan. Cached."""
        return self._prepare(text, variables, operation, id, options or self.options)[1]

    def _prepare(self, text, variables, operation, id, o: Options) -> tuple[tuple, tuple[Operation, list[Field], list[RootPlan], dict]]:
        """The key in the plan cache, and what stands there."""
        if id is not None:
            if id not in self.stored:
                raise GraphQLError(f"no stored operation {id}", "PERSISTED_DOCUMENT_NOT_FOUND")
            text = self.stored[id]
        for h in self.hooks:
            text = h.on_parse(text) or text
        # everything that decides whether, and as what, an operation is let through
        key = (self.version, text, operation, json.dumps(variables or {}, sort_keys=True, default=str), o.overrides, o.user, o.operation_filter, o.introspection, o.reject_unauthorized, o.limits, tuple(self.rules))
        if key in self._plans and not self.hooks:
            self._plans.move_to_end(key)
            self.counters["plan_cache_hits"] += 1
            return key, self._plans[key]
        self.counters["plan_cache_misses"] += 1
        doc = parse(text, o.limits.tokens)
        errors = validate(self.catalog, doc, self.rules, o.limits)
        for h in self.hooks:
            errors = h.on_validate(doc, errors) or errors
        if errors:
            raise errors[0] if len(errors) == 1 else GraphQLError("; ".join(e.message for e in errors), errors[0].code)
        chosen = next((x for x in doc.operations if operation is None or x.name == operation), None)
        if chosen is None:
            raise GraphQLError(f"no operation {operation}", "OPERATION_NOT_FOUND")
        op = normalize(self.catalog, doc, operation, coerce_all(self.catalog, chosen, variables))
        for h in self.hooks:
            op = h.on_analysis(op) or op
        refused = policy.denied(self.catalog, op, o.user, o.operation_filter)
        policy.demand(refused, o.reject_unauthorized)
        op = policy.prune(op, self.catalog, refused)
        meta, fields = partition(op)
        if meta and not o.introspection:
            raise GraphQLError("introspection is off", "INTROSPECTION_DISABLED")
        planner = Planner(self.catalog, self.registry, o.overrides, refused)
        root_type = self.catalog.roots[op.kind]
        plans = [planner.root(root_type, f) for f in fields if f.name != "__typename" and f.name not in self.registry.mutations or op.kind == "query" and f.name != "__typename"]
        for h in self.hooks:
            plans = h.on_plan(plans) or plans
        out = (op, meta, plans, refused)
        if not self.hooks:
            self._plans[key] = out
            if len(self._plans) > 1000:
                self._plans.popitem(last=False)
        return key, out

    def query(self, text: str | None = None, variables: dict[str, Any] | None = None, operation: str | None = None, id: str | None = None, options: Options | None = None) -> Result:
        o = options or self.options
        self.counters["requests"] += 1
        for h in self.hooks:
            variables, o = h.on_params(variables or {}, o) or (variables, o)
        try:
            return self._query(text, variables, operation, id, o)
        except GraphQLError as e:
            self.counters["errors"] += 1
            for h in self.hooks:
                e = h.on_error(e) or e
            raise e

    def _query(self, text, variables, operation, id, o: Options) -> Result:
        key, (op, meta, plans, refused) = self._prepare(text, variables, operation, id, o)
        root_type = self.catalog.roots[op.kind]
        errors = [GraphQLError(f"{t}.{f}", why, (t, f)) for (t, f), why in refused.items()]
        fetches, shape, total, costs, blocked = self._costs(op, meta, plans, o)
        frames: dict[str, DataFrame] = {}
        ran: dict[str, RootPlan] = {}

        def add(p: RootPlan) -> None:
            kept, left_out = without(p, blocked) if blocked else (p, [])
            for source, path in left_out:
                errors.append(GraphQLError(f"{'.'.join(path)}: {source} is over its budget", "COST_SOURCE_TOO_EXPENSIVE", path))
            if kept is not None:
                ran[p.key] = kept
                frames[p.key] = self._lowered((key, p.key, frozenset(blocked)), kept, o) if op.kind == "query" else self.lower(kept, o)

        if op.kind == "mutation":
            plans = self._mutate(op, plans, refused, o, add, frames)
        else:
            for p in plans:
                add(p)
        intro = Introspection(self.catalog)
        return Result(op, plans, frames, errors, {f.key: intro.answer(f) for f in meta}, total, shape, costs, fetches, coordinates(self.catalog, op), ran)

    def _costs(self, op: Operation, meta: list[Field], plans: list[RootPlan], o: Options) -> tuple[dict, int, int, dict[str, int], set[str]]:
        """By fetch, of the shape, in total, by source; and the sources over their budgets."""
        est = Estimator(self.catalog, o.budget.default_list_size)
        shape = est.operation(op.kind, [f for f in op.selections if f not in meta])
        fetches = est.fetches(plans, op.kind, self.catalog.roots[op.kind])
        costs = by_source(fetches)
        planned = {p.key for p in plans}
        rest = [f for f in op.selections if isinstance(f, Field) and f not in meta and f.key not in planned]  # planned once they have run
        total = min(MOST, sum(costs.values()) + est.selections(self.catalog.roots[op.kind], rest) + (10 if op.kind == "mutation" and not plans else 0))
        return fetches, shape, total, costs, check(self.catalog, o.budget, total, costs)

    def _mutate(self, op: Operation, plans: list[RootPlan], refused: dict, o: Options, add: Callable[[RootPlan], None], frames: dict[str, DataFrame]) -> list[RootPlan]:
        """Root fields one after the other: each result is fixed before the next one runs."""
        planner = Planner(self.catalog, self.registry, o.overrides, refused)
        ready, done = {p.key: p for p in plans}, []
        fields = [f for f in op.selections if isinstance(f, Field) and f.name != "__typename"]
        for f in fields:
            run = self.registry.mutations.get(f.name)
            if run is not None:
                run(**f.args)
            p = ready.get(f.key)
            if p is None and any(name == f.name for _, name in self.registry.roots):
                p = planner.root(self.catalog.roots[op.kind], f)
            if p is None:
                continue
            add(p)
            done.append(p)
            if f is not fields[-1] and f.key in frames:
                frames[f.key] = cut(frames[f.key])  # what later roots do to its sources must not show in it
        return done

    def _lowered(self, key: tuple, plan: RootPlan, o: Options) -> DataFrame:
        """``lower``, cached. A hit gives a DataFrame of its own over the analysed plan, so nothing that
        an execution leaves behind, such as shuffle files, is kept or shared."""
        if self.hooks:
            return self.lower(plan, o)
        # what analysis takes from the session
        session = tuple(self.spark.conf.get(c) for c in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.caseSensitive"))
        key = (*key, o.ordered, o.root_nulls, session)
        if key not in self._frames:
            self._frames[key] = self.lower(plan, o)
            if len(self._frames) > 256:
                self._frames.popitem(last=False)
        self._frames.move_to_end(key)
        df = self._frames[key]
        return df.select("*") if df.columns else df

    def lower(self, plan: RootPlan, o: Options | None = None, streaming: dict | None = None, guard: bool = True) -> DataFrame:
        o = o or self.options
        lowering = Lowering(self.catalog, self.registry, streaming, guard)
        if self.hooks:
            plain = lowering._table

            def table(source: str, holder: str) -> DataFrame:
                df = plain(source, holder)
                for h in self.hooks:
                    df = h.on_source(source, holder, df) or df
                return df

            lowering._table = table
        df = lowering.root(plan, o.ordered)
        t = plan.type
        if o.root_nulls == "spec" and t.of is not None and t.of.required and len(df.columns):
            gone = F.lit(True)
            for c in df.columns:
                gone = gone & F.col(f"`{c}`").isNull()
            bad = df.agg(F.coalesce(F.bool_or(gone), F.lit(False)).alias("_bad"))  # one row
            df = df.crossJoin(F.broadcast(bad)).filter(~F.col("_bad")).drop("_bad")
        for h in self.hooks:
            df = h.on_execute(plan.key, df) or df
        return df

    def actual_cost(self, result: Result, key: str) -> DataFrame:
        f = next(x for x in result.operation.selections if isinstance(x, Field) and x.key == key)
        base = self.catalog.field(self.catalog.roots[result.operation.kind], f.name).type.base
        return with_actual_cost(result.frames[key], self.catalog, base, f.selections)

    def cost_by_fetch(self, result: Result, key: str) -> DataFrame:
        """path, source, actual, estimated, delta of each read behind a root."""
        p = next(x for x in result.plans if x.key == key)
        return by_fetch(result.frames[key], self.catalog, p, result.cost_by_fetch)

    def value_errors(self, result: Result, key: str) -> DataFrame:
        """path, value, code, message, n: the values at a root's positions that their enums do not have,
        which are null in its frame, and how often each occurs. One aggregation over the answer with the
        values as they stand in the sources, merged on the map side; of a mutation, as they stand now.
        Empty where the operation asks for no enum."""
        plan = result.run[key]
        return invalid_values(self.lower(plan, replace(self.options, root_nulls="row"), guard=False), self.catalog, plan)

    def usage_record(self, text: str, result: Result, ok: bool = True) -> DataFrame:
        doc = parse(text)
        return self.spark.createDataFrame([(document_hash(doc), minify(doc), result.operation.name, result.coordinates, result.estimated_cost, ok)], "hash string, body string, name string, coordinates array<string>, estimated_cost long, ok boolean")

    # streams

    def subscribe(self, text: str, variables: dict[str, Any] | None = None, options: Options | None = None) -> DataFrame:
        """A streaming DataFrame: one row for each event of the root, enriched by keyed joins."""
        o = options or self.options
        op, meta, plans, _ = self.prepare(text, variables, options=o)
        blocked = self._costs(op, meta, plans, o)[-1]
        if op.kind != "subscription" or len(plans) != 1:
            raise GraphQLError("a subscription with one root field is needed")
        p = plans[0]
        kept, _ = without(p, blocked) if blocked else (p, [])
        if kept is None:
            raise GraphQLError(f"{p.source} is over its budget", "COST_SOURCE_TOO_EXPENSIVE", (p.key,))
        p = kept
        streams = {(c.source, c.holder): event_time(self.registry.streams[c.source, c.holder](self.spark)) for c in p.children.values() if (c.source, c.holder) in self.registry.streams}
        if not streams:
            raise GraphQLError(f"{p.source} has no stream for {p.name}")
        self.counters["subscriptions"] += 1
        return self.lower(p, o, streams)

    def fingerprint(self, text: str, variables: dict[str, Any] | None = None, options: Options | None = None) -> str:
        """What two subscriptions must have in common to share a stream: the schema and its sources,
        the operation, and everything of the user and options that its rows depend on."""
        o = options or self.options
        if o.operation_filter is not None and o.operation_filter not in self._filters:
            self._filters.append(o.operation_filter)
        who = [o.user.authenticated, sorted(o.user.scopes), None if o.operation_filter is None else self._filters.index(o.operation_filter), sorted(o.overrides.flags), o.overrides.percentage, o.reject_unauthorized, repr(o.limits), repr(o.budget), o.root_nulls]
        return f"{self.version}:{document_hash(parse(text))}:{json.dumps(variables or {}, sort_keys=True, default=str)}:{json.dumps(who)}"

    def allowed(self, text: str, variables: dict[str, Any] | None = None, options: Options | None = None) -> str:
        """The operation that is left when the refused fields are taken out, at any depth."""
        op, _, _, refused = self.prepare(text, variables, options=options)
        return print_operation(policy.rebuilt(op, self.catalog, refused))

    def print(self, text: str, variables: dict[str, Any] | None = None) -> str:
        """The normal form of an operation."""
        return print_operation(self.prepare(text, variables)[0])

