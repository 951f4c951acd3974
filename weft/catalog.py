"""Which source owns which field of which type, under which keys.

Built from a composed schema (``join__*`` directives) or from a plain one, whose single source is
called ``main``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from weft.gql.syntax import Directive, Enum, FieldDef, GraphQLError, Schema, TypeDef, TypeRef, parse_schema, parse_selections

SCALARS = ("Int", "Float", "String", "Boolean", "ID")


@dataclass(frozen=True)
class Key:
    fields: tuple[str, ...]  # paths, joined by "."
    resolvable: bool = True


@dataclass
class TypeIn:
    """A type as one source sees it."""

    keys: list[Key] = field(default_factory=list)
    interface_object: bool = False
    extension: bool = False


@dataclass
class Owner:
    source: str
    requires: list | None = None
    provides: list | None = None
    external: bool = False
    override: str | None = None
    label: str | None = None
    overridden: bool = False
    type: TypeRef | None = None


@dataclass(frozen=True)
class Overrides:
    """Progressive overrides of one query: labels that are on, and its place in 0..100."""

    flags: frozenset[str] = frozenset()
    percentage: float = 0.0

    def active(self, label: str | None) -> bool:
        if label is None:
            return True
        m = re.fullmatch(r"percent\(\s*([0-9.]+)\s*\)", label)
        # whole numbers of 1e-8 percent, so that equal texts compare equal
        return round(self.percentage * 10**8) < round(float(m[1]) * 10**8) if m else label in self.flags


def paths(selections: list, prefix: str = "") -> list[str]:
    out = []
    for s in selections:
        if getattr(s, "selections", None):
            out += paths(s.selections, f"{prefix}{s.name}." if hasattr(s, "name") else prefix)
        else:
            out.append(prefix + s.name)
    return out


def directive(ds: list[Directive], name: str) -> Directive | None:
    return next((d for d in ds if d.name == name or d.name.endswith("__" + name)), None)


def _plain(v: Any) -> Any:
    return v.name if isinstance(v, Enum) else v


class Catalog:
    def __init__(self, sdl: str):
        self.schema: Schema = parse_schema(sdl)
        for s in SCALARS:
            self.schema.types.setdefault(s, TypeDef("scalar", s))
        self.roots = {k: self.schema.roots.get(k, k.capitalize()) for k in ("query", "mutation", "subscription")}
        self.roots = {k: v for k, v in self.roots.items() if v in self.schema.types}
        graphs = self.schema.types.get("join__Graph")
        self.sources: dict[str, dict[str, Any]] = {}
        self._names: dict[str, str] = {}  # name of a source -> its enum value
        if graphs:
            for g, ds in graphs.values.items():
                d = directive(ds, "graph")
                self.sources[g] = dict(d.args) if d else {}
                self._names[self.sources[g].get("name", g)] = g
        else:
            self.sources["main"] = {"name": "main"}
        self.types: dict[str, TypeDef] = self.schema.types
        self._in: dict[str, dict[str, TypeIn]] = {}
        self._possible: dict[str, list[str]] = {}
        for t in self.types.values():
            self._in[t.name] = self._sources_of(t)
            if t.kind == "union":
                self._possible[t.name] = sorted(t.members)
            elif t.kind == "interface":
                self._possible[t.name] = sorted(x.name for x in self.types.values() if x.kind == "type" and t.name in x.interfaces)
            else:
                self._possible[t.name] = [t.name]

    def _sources_of(self, t: TypeDef) -> dict[str, TypeIn]:
        out: dict[str, TypeIn] = {}
        for d in t.directives:
            if d.name != "join__type":
                continue
            x = out.setdefault(_plain(d.args["graph"]), TypeIn())
            if "key" in d.args:
                x.keys.append(Key(tuple(paths(parse_selections(d.args["key"]))), d.args.get("resolvable", True)))
            x.interface_object |= bool(d.args.get("isInterfaceObject"))
            x.extension |= bool(d.args.get("extension"))
        if not out and not t.name.startswith(("join__", "link__", "core__")):
            for s in self.sources:
                d = directive(t.directives, "key")
                out[s] = TypeIn([Key(tuple(paths(parse_selections(d.args["fields"]))))] if d else [])
        return out

    def source(self, name: str) -> str:
        """The enum value of a source, for either of its names."""
        if name in self.sources:
            return name
        if name in self._names:
            return self._names[name]
        raise GraphQLError(f"no source {name}")

    # types

    def type(self, name: str) -> TypeDef:
        if name not in self.types:
            raise GraphQLError(f"unknown type {name}", "KnownTypeNames")
        return self.types[name]

    def field(self, type_name: str, name: str) -> FieldDef | None:
        t = self.types.get(type_name)
        if name == "__typename":
            return FieldDef("__typename", TypeRef("String", required=True))
        return t.fields.get(name) if t and t.kind in ("type", "interface") else None

    def possible(self, name: str) -> list[str]:
        return self._possible.get(name, [])

    def possible_in(self, name: str, source: str) -> list[str]:
        """Concrete types that a source can give for an abstract one."""
        t = self.type(name)
        members = {_plain(d.args["member"]) for d in t.directives if d.name == "join__unionMember" and _plain(d.args["graph"]) == source}
        implementers = {x.name for x in self.types.values() for d in x.directives if d.name == "join__implements" and _plain(d.args["graph"]) == source and d.args["interface"] == name}
        known = members or implementers or {x for x in self.possible(name) if source in self._in[x]}
        return [x for x in self.possible(name) if x in known]

    def is_abstract(self, name: str) -> bool:
        return self.type(name).kind in ("interface", "union")

    def is_composite(self, name: str) -> bool:
        return name in self.types and self.types[name].kind in ("type", "interface", "union")

    def is_input(self, name: str) -> bool:
        return name in self.types and self.types[name].kind in ("scalar", "enum", "input")

    def enum_values(self, name: str, source: str | None = None) -> list[str]:
        out = []
        for v, ds in self.type(name).values.items():
            graphs = [_plain(d.args["graph"]) for d in ds if d.name == "join__enumValue"]
            if source is None or not graphs or source in graphs:
                out.append(v)
        return out

    # ownership

    def sources_of(self, type_name: str) -> dict[str, TypeIn]:
        return self._in.get(type_name, {})

    def keys(self, type_name: str, source: str) -> list[Key]:
        x = self._in.get(type_name, {}).get(source)
        return x.keys if x else []

    def entries(self, type_name: str, name: str) -> list[Owner]:
        f = self.field(type_name, name)
        if f is None:
            return []
        joins = [d for d in f.directives if d.name == "join__field"]
        if joins and all("graph" not in d.args for d in joins):
            return []  # an interface object contributes it
        if not joins:
            d = directive(f.directives, "requires")
            return [Owner(s, requires=parse_selections(d.args["fields"]) if d else None) for s in self.sources_of(type_name)]
        out = []
        for d in joins:
            if "graph" not in d.args:
                continue
            a = d.args
            out.append(
                Owner(
                    _plain(a["graph"]),
                    parse_selections(a["requires"]) if a.get("requires") else None,
                    parse_selections(a["provides"]) if a.get("provides") else None,
                    bool(a.get("external")), a.get("override"), a.get("overrideLabel"), bool(a.get("usedOverridden")),
                )
            )
        return out

    def owners(self, type_name: str, name: str, overrides: Overrides = Overrides()) -> list[Owner]:
        """Who serves a field, after overrides."""
        entries = self.entries(type_name, name)
        taken = {self._names.get(e.override, e.override) for e in entries if e.override and overrides.active(e.label)}
        waiting = {e.source for e in entries if e.override and not overrides.active(e.label)}
        out = []
        for e in entries:
            if e.external or e.source in waiting or e.source in taken:
                continue
            if e.overridden and not waiting:
                continue
            out.append(e)
        # fields that an interface object adds to all implementers
        t = self.types.get(type_name)
        if not out and t is not None and t.kind == "type":
            for i in t.interfaces:
                out += [e for e in self.entries(i, name) if self.sources_of(i).get(e.source, TypeIn()).interface_object]
        return out

    def interface_of(self, type_name: str, name: str, source: str) -> str | None:
        """The interface whose object in ``source`` serves this field of a concrete type."""
        for i in self.types[type_name].interfaces if self.types[type_name].kind == "type" else []:
            x = self.sources_of(i).get(source)
            if x and x.interface_object and any(e.source == source for e in self.entries(i, name)):
                return i
        return None

    # rules carried by the schema

    def cost(self, ds: list[Directive]) -> int | None:
        d = directive(ds, "cost")
        return int(d.args["weight"]) if d else None

    def list_size(self, f: FieldDef) -> dict[str, Any] | None:
        d = directive(f.directives, "listSize")
        return d.args if d else None

    # the schema that clients see

    def public_types(self) -> dict[str, TypeDef]:
        out = {}
        for t in self.types.values():
            if t.name.startswith(("join__", "link__", "core__")) or directive(t.directives, "inaccessible"):
                continue
            fields = {n: f for n, f in t.fields.items() if not directive(f.directives, "inaccessible")}
            values = {v: ds for v, ds in t.values.items() if not directive(ds, "inaccessible")}
            out[t.name] = TypeDef(t.kind, t.name, t.interfaces, fields, t.members, values, t.directives, t.description)
        return out
