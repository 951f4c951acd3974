"""Tables, links, roots and computed fields that stand behind the sources of a catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog import Catalog
from weft.gql.syntax import GraphQLError

Loader = Callable[[SparkSession], DataFrame]


class SourceExecutor(Protocol):
    """What stands in for a source: each read of one of its tables asks it, with the table it replaces."""

    def table(self, source: str, type_name: str, plain: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Link:
    """Rows of ``field`` of a parent: child column = parent column, in a declared order."""

    on: tuple[tuple[str, str], ...]  # (parent column, child column)
    order_by: tuple[str, ...] = ()
    tag: str | None = None  # parent column with the concrete type, for abstract objects
    carries: tuple[tuple[str, str], ...] = ()  # (parent column, child field): provided fields


@dataclass(frozen=True)
class Root:
    order_by: tuple[str, ...] = ()
    where: Callable[[dict[str, Any]], Column] | None = None


@dataclass
class Table:
    load: Loader | DataFrame | str
    columns: dict[str, str] = field(default_factory=dict)
    unique: tuple[str, ...] | None = None  # columns that are declared to hold no value twice


@dataclass
class Resolver:
    compute: Callable[[dict[str, Column], dict[str, Any]], Column]


class Registry:
    def __init__(self, catalog: Catalog, spark: SparkSession):
        self.catalog, self.spark = catalog, spark
        self.tables: dict[tuple[str, str], Table] = {}
        self.streams: dict[tuple[str, str], Loader] = {}
        self.links: dict[tuple[str, str], Link] = {}
        self.roots: dict[tuple[str, str], Root] = {}
        self.resolvers: dict[tuple[str, str], Resolver] = {}
        self.mutations: dict[str, Callable[..., None]] = {}
        self._paths: dict[str, DataFrame] = {}
        self.executors: dict[str, SourceExecutor] = {}

    def add(self, source: str, type_name: str, load: Loader | DataFrame | str, columns: dict[str, str] | None = None, unique: tuple[str, ...] | None = None) -> None:
        """A table (DataFrame, loader or Parquet path). columns: field path -> SQL expression, where
        the name differs. unique: columns declared to be a key of the table; lookups by keys that
        are not declared take one row of each key. Adding again replaces the table, the override of
        a source's place; it stays unique by the same columns unless others are given."""
        at = self.catalog.source(source), type_name
        before = self.tables.get(at)
        self.tables[at] = Table(load, dict(columns or {}), tuple(unique) if unique is not None else before.unique if before else None)

    def is_unique(self, source: str, type_name: str, columns: set[str]) -> bool:
        t = self.tables.get((source, type_name))
        return t is not None and t.unique is not None and set(t.unique) <= columns

    def stream(self, source: str, type_name: str, load: Loader) -> None:
        self.streams[self.catalog.source(source), type_name] = load

    def link(self, source: str, coordinate: str, on: dict[str, str], order_by: tuple[str, ...] = (), tag: str | None = None, carries: dict[str, str] | None = None) -> None:
        self.links[self.catalog.source(source), coordinate] = Link(tuple(on.items()), tuple(order_by), tag, tuple((carries or {}).items()))

    def root(self, source: str, name: str, order_by: tuple[str, ...] = (), where=None) -> None:
        self.roots[self.catalog.source(source), name] = Root(tuple(order_by), where)

    def resolver(self, source: str, coordinate: str, compute) -> None:
        self.resolvers[self.catalog.source(source), coordinate] = Resolver(compute)

    def mutation(self, name: str, run: Callable[..., None]) -> None:
        self.mutations[name] = run

    def holder(self, source: str, type_name: str) -> str | None:
        """The name under which a source has rows of a type: its own, or an interface object's."""
        if (source, type_name) in self.tables:
            return type_name
        t = self.catalog.types[type_name]
        for i in t.interfaces if t.kind == "type" else []:
            x = self.catalog.sources_of(i).get(source)
            if x and x.interface_object and (source, i) in self.tables:
                return i
        return None

    def read(self, source: str, type_name: str) -> DataFrame:
        plain = self._plain(source, type_name)
        return self.executors[source].table(source, type_name, plain) if source in self.executors else plain

    def _plain(self, source: str, type_name: str) -> DataFrame:
        t = self.tables[source, type_name]
        if isinstance(t.load, str):  # one listing and one footer for each path
            if t.load not in self._paths:
                self._paths[t.load] = self.spark.read.parquet(t.load)
            return self._paths[t.load]
        if not isinstance(t.load, DataFrame):
            t.load = t.load(self.spark)
        return t.load

    def column(self, source: str, type_name: str, path: str) -> Column:
        t = self.tables.get((source, type_name))
        if t is None:
            raise GraphQLError(f"{source} has no table of {type_name}")
        return F.expr(t.columns[path]) if path in t.columns else F.col(".".join(f"`{p}`" for p in path.split(".")))
