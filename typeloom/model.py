"""Schema of typed objects: types, inheritance, attributes, relationships, rollups, state machines.

Everything here is metadata written by people (tens to hundreds of entries), so it lives on the
driver; no object data ever passes through these classes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Declared datatype -> Spark type. DOUBLE is kept exact so that sums do not depend
# on the order in which tasks finish.
DATATYPES = {
    "string": T.StringType(),
    "anyURI": T.StringType(),
    "time": T.StringType(),
    "duration": T.StringType(),
    "integer": T.LongType(),
    "long": T.LongType(),
    "decimal": T.DecimalType(38, 18),
    "double": T.DecimalType(38, 18),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "dateTime": T.TimestampType(),
}
NUMERIC = {"integer", "long", "decimal", "double"}
ORDERED = NUMERIC | {"date", "dateTime"}

# Columns every object table carries besides its properties.
ENVELOPE = {
    "id": T.StringType(),
    "tenant": T.StringType(),
    "type": T.StringType(),
    "version": T.LongType(),
    "state": T.StringType(),
    "created_at": T.TimestampType(),
    "created_by": T.StringType(),
    "updated_at": T.TimestampType(),
    "updated_by": T.StringType(),
    "deleted_at": T.TimestampType(),
}

# Columns a change row carries besides those of the object.
CHANGE_COLUMNS = ("changeset_id", "seq", "op", "expected_version", "at", "by")

# Rollup functions.
ROLLUP_FUNCTIONS = ("COUNT", "SUM", "MIN", "MAX", "AVG")


def short_name(iri: str) -> str:
    """Local name: what follows the last '#', else the last '/', else the whole string."""
    for mark in ("#", "/"):
        if mark in iri:
            return iri.rsplit(mark, 1)[1]
    return iri


@dataclass(frozen=True)
class Property:
    """An attribute, or a relationship when ``target`` names a type."""

    iri: str
    datatype: str = "string"
    min: int = 0
    max: int | None = 1
    facet: bool = False
    indexed: bool = False
    searchable: bool = False
    read_only: bool = False
    display_label: bool = False
    target: str | None = None
    inverse: str | None = None
    transitive: bool = False
    pattern: str | None = None
    min_value: str | None = None
    max_value: str | None = None
    decimal_type: tuple[int, int] | None = None

    @property
    def name(self) -> str:
        return short_name(self.iri)

    @property
    def is_ref(self) -> bool:
        return self.target is not None

    @property
    def is_list(self) -> bool:
        return self.max != 1

    @property
    def scalar_type(self) -> T.DataType:
        if self.is_ref:
            return T.StringType()
        if self.decimal_type and self.datatype in ("decimal", "double"):
            return T.DecimalType(*self.decimal_type)
        return DATATYPES[self.datatype]

    @property
    def spark_type(self) -> T.DataType:
        return T.ArrayType(self.scalar_type) if self.is_list else self.scalar_type


@dataclass(frozen=True)
class TypeDef:
    iri: str
    supers: tuple[str, ...] = ()
    abstract: bool = False
    properties: tuple[Property, ...] = ()

    @property
    def name(self) -> str:
        return short_name(self.iri)


@dataclass(frozen=True)
class Rollup:
    """Value of ``property`` on ``on_type``: ``function`` over sources whose ``via`` points here."""

    property: str
    on_type: str
    source: str
    via: str
    function: str = "COUNT"
    of: str | None = None
    where: object = ()
    materialised: bool = False


@dataclass(frozen=True)
class Action:
    """What a fired transition does: set_property, create_object, log or webhook."""

    kind: str
    property: str | None = None
    literal: object = None
    expression: str | None = None
    create_type: str | None = None
    assignments: tuple[tuple[str, str], ...] = ()
    message: str | None = None
    url: str | None = None
    method: str | None = None
    body: str | None = None


@dataclass(frozen=True)
class Transition:
    name: str
    source: str
    target: str
    trigger: str = "USER_ACTION"
    guard: str | None = None
    message: str | None = None  # what to tell where the guard does not hold
    watch: tuple[str, ...] = ()
    after: str | None = None
    signal: str | None = None
    actions: tuple[Action, ...] = ()


@dataclass(frozen=True)
class Machine:
    type: str
    initial: str
    states: tuple[str, ...]
    transitions: tuple[Transition, ...]

    def leaving(self, trigger: str | None = None) -> list[tuple[int, Transition]]:
        """Transitions with their position in the declared order, which decides ties."""
        return [(i, t) for i, t in enumerate(self.transitions) if trigger in (None, t.trigger)]


class SchemaError(ValueError):
    pass


@dataclass
class Schema:
    """Types by name with inherited properties resolved once, when the schema is built."""

    types: tuple[TypeDef, ...]
    rollups: tuple[Rollup, ...] = ()
    machines: tuple[Machine, ...] = ()
    plugins: dict[str, str] = field(default_factory=dict)  # property name -> plug-in name

    def __post_init__(self) -> None:
        self._by_key: dict[str, TypeDef] = {}
        for t in self.types:
            self._by_key[t.iri] = t
            self._by_key[t.name] = t
        self._ancestors = {t.name: self._walk_up(t) for t in self.types}
        seen: dict[str, Property] = {}
        columns: dict[str, Property] = {}
        for t in self.types:
            for p in t.properties:
                if p.iri in seen and seen[p.iri].spark_type != p.spark_type:
                    raise SchemaError(f"property {p.iri} is declared twice with different types")
                seen[p.iri] = p
                if p.name in ENVELOPE or p.name in CHANGE_COLUMNS or p.name.startswith("_"):
                    raise SchemaError(f"property name '{p.name}' is reserved")
                if not re.fullmatch(r"\w+", p.name):
                    raise SchemaError(f"property name '{p.name}' cannot name a column")
                twin = columns.setdefault(p.name.lower(), p)
                if (twin.name, twin.spark_type) != (p.name, p.spark_type):
                    raise SchemaError(f"properties {twin.iri} and {p.iri} need the same column")
        for r in self.rollups:
            if r.function not in ROLLUP_FUNCTIONS:
                raise SchemaError(f"unknown rollup function '{r.function}'")
            if r.function != "COUNT":
                of = self.lookup(r.source, r.of or "")
                if of is None or of.is_ref or of.is_list or of.datatype not in NUMERIC:
                    raise SchemaError(f"{r.function} needs a single-valued numeric property, got '{r.of}'")
        for name, plugin in self.plugins.items():
            if any(r.property == name and r.materialised for r in self.rollups):
                raise SchemaError(f"plug-in '{plugin}' cannot keep '{name}' up to date")

    def _walk_up(self, t: TypeDef) -> tuple[str, ...]:
        found: list[str] = []
        todo = [t]
        while todo:
            cur = todo.pop(0)
            if cur.name in found:
                continue
            found.append(cur.name)
            todo += [self._by_key[s] for s in cur.supers if s in self._by_key]
        return tuple(found)

    def type(self, key: str) -> TypeDef:
        if key not in self._by_key:
            raise SchemaError(f"unknown type '{key}'")
        return self._by_key[key]

    def has_type(self, key: str) -> bool:
        return key in self._by_key

    def is_subtype(self, sub: str, sup: str) -> bool:
        return self.has_type(sub) and self.has_type(sup) and self.type(sup).name in self._ancestors[self.type(sub).name]

    def concrete(self, *names: str) -> list[TypeDef]:
        """Concrete types equal to or below any of ``names``, in declaration order."""
        return [t for t in self.types if not t.abstract and any(self.is_subtype(t.name, n) for n in names)]

    def properties(self, name: str) -> list[Property]:
        """Own and inherited properties of one type."""
        out: dict[str, Property] = {}
        for a in self._ancestors[self.type(name).name]:
            for p in self._by_key[a].properties:
                out.setdefault(p.iri, p)
        return list(out.values())

    def reachable_properties(self, *names: str) -> list[Property]:
        """Properties of the named types and of everything below them."""
        out: dict[str, Property] = {}
        for n in names:
            for p in self.properties(n):
                out.setdefault(p.iri, p)
            for t in self.types:
                if self.is_subtype(t.name, n):
                    for p in self.properties(t.name):
                        out.setdefault(p.iri, p)
        return list(out.values())

    def lookup(self, name: str, token: str) -> Property | None:
        """Property by local name or IRI on a type or its subtypes."""
        for p in self.reachable_properties(name):
            if token in (p.iri, p.name):
                return p
        return None

    def label_of(self, name: str) -> Property | None:
        return next((p for p in self.properties(name) if p.display_label), None)

    def searchable(self, name: str) -> list[Property]:
        return [p for p in self.properties(name) if p.searchable]

    def rollups_on(self, name: str) -> list[Rollup]:
        return [r for r in self.rollups if self.is_subtype(name, r.on_type)]

    def derived(self, name: str) -> dict[str, Rollup | str]:
        out: dict[str, Rollup | str] = {r.property: r for r in self.rollups}
        out.update(self.plugins)
        return {k: v for k, v in out.items() if self.lookup(name, k) is not None}

    def machine(self, name: str) -> Machine | None:
        return next((m for m in self.machines if self.type(m.type).name == self.type(name).name), None)
