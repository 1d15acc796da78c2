"""Criteria over typed properties, compiled to plain Columns so that filters reach the scan."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace
from datetime import date, datetime
from decimal import Decimal, InvalidOperation, localcontext
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..model import ORDERED, Property, Schema

# Filter operators.
OPERATORS = ("eq", "ne", "in", "lt", "lte", "gt", "gte", "contains", "startsWith", "isNull", "notNull")
RANGE_OPERATORS = ("lt", "lte", "gt", "gte")
TEXT_OPERATORS = ("contains", "startsWith")
PRESENCE_OPERATORS = ("isNull", "notNull")

#: As many equalities as a parquet scan takes for a list; longer ones become relations.
SHORT_LIST = 10

# Operator words of a rollup's filter tree.
TREE_OPERATORS = {
    "is": "eq",
    "is not": "ne",
    "is in": "in",
    "is less than": "lt",
    "is less than or equal to": "lte",
    "is greater than": "gt",
    "is greater than or equal to": "gte",
    "contains": "contains",
    "starts with": "startsWith",
}
TREE_PRESENCE = {"is": "isNull", "is not": "notNull"}


@dataclass(frozen=True)
class Violation:
    property: str
    message: str


class InvalidQuery(ValueError):
    """Every problem found in a query; raised before any job starts."""

    def __init__(self, violations: list[Violation]) -> None:
        self.violations = violations
        super().__init__("; ".join(f"{v.property}: {v.message}" for v in violations))


@dataclass(frozen=True)
class Criterion:
    property: Property
    operator: str
    value: object = None
    #: Column that holds the answer already, for a list that was joined.
    mark: str | None = None

    @property
    def is_long(self) -> bool:
        return self.operator == "in" and self.mark is None and len(self.value) > SHORT_LIST

    def relation(self, spark: SparkSession) -> DataFrame:
        """The listed values a property can have, as a column ``_value`` of its type (others equal no value)."""
        kind = self.property.scalar_type
        values = self.value
        if isinstance(kind, T.DecimalType):
            step, top = Decimal(1).scaleb(-kind.scale), Decimal(10) ** (kind.precision - kind.scale)
            with localcontext() as exact:
                exact.prec = 100
                values = [q for v in values if abs(v) < top and (q := v.quantize(step)) == v]
        arrow = to_arrow_type(kind)
        return spark.createDataFrame(pa.table({"_value": pa.array(list(dict.fromkeys(values)), arrow)}))

    def column(self) -> Column:
        if self.mark is not None:
            return F.col(self.mark)
        col = F.col(self.property.name)
        dtype = self.property.scalar_type

        def lit(v: object) -> Column:
            # A decimal keeps its own scale: rounding it to the property's would change what it equals.
            return F.lit(v) if isinstance(v, Decimal) else F.lit(v).cast(dtype)

        match self.operator:
            case "eq":
                return col == lit(self.value)
            case "ne":
                return ~col.eqNullSafe(lit(self.value))
            case "in":
                # A short list, which reaches the scan; each literal keeps its own scale.
                return col.isin(*[lit(v) for v in self.value])
            case "lt":
                return col < lit(self.value)
            case "lte":
                return col <= lit(self.value)
            case "gt":
                return col > lit(self.value)
            case "gte":
                return col >= lit(self.value)
            case "contains":
                return F.lower(col).contains(str(self.value).lower())
            case "startsWith":
                return F.lower(col).startswith(str(self.value).lower())
            case "isNull":
                return col.isNull()
            case "notNull":
                return col.isNotNull()
        raise ValueError(f"unknown operator '{self.operator}'")


def conjunction(criteria: Iterable[Criterion], excluding: str | None = None) -> Column:
    """All criteria ANDed, leaving out those on one property (for multi-select facets)."""
    return reduce(lambda a, b: a & b, [c.column() for c in criteria if c.property.name != excluding], F.lit(True))


def apply_criteria(df: DataFrame, criteria: Iterable[Criterion]) -> DataFrame:
    """Rows that meet all criteria. Long lists are relations: a semi-join, whose size Spark knows."""
    criteria = list(criteria)
    out = df.where(conjunction([c for c in criteria if not c.is_long]))
    for c in criteria:
        if c.is_long:
            out = out.join(c.relation(df.sparkSession), F.col(c.property.name) == F.col("_value"), "left_semi")
    return out


def marked(df: DataFrame, criteria: list[Criterion]) -> tuple[DataFrame, list[Criterion]]:
    """Rows with a column for each long list that says whether their value is in it, and criteria that use it."""
    out = []
    for c in criteria:
        if c.is_long:
            name = next(n for n in (f"_in{k}" for k in count()) if n not in df.columns)
            listed = c.relation(df.sparkSession).withColumn(name, F.lit(True))
            df = df.join(listed, F.col(c.property.name) == F.col("_value"), "left").drop("_value")
            c = replace(c, mark=name)
        out.append(c)
    return df, out


def applicable(operator: str, p: Property) -> bool:
    if operator in RANGE_OPERATORS:
        return not p.is_ref and p.datatype in ORDERED
    if operator in TEXT_OPERATORS:
        return not p.is_ref and p.datatype == "string"
    return True


def literal(p: Property, raw: object) -> object:
    """One raw value as the property's type; raises ValueError with the reason."""
    if p.is_ref:
        try:
            return str(uuid.UUID(str(raw)))
        except ValueError:
            raise ValueError("not a UUID") from None
    text = str(raw)
    match p.datatype:
        case "integer" | "long":
            try:
                number = Decimal(text)
                whole = number.to_integral_value() if number.is_finite() else number
            except InvalidOperation:
                raise ValueError("not a whole number") from None
            if not number.is_finite() or number != whole or not -(2**63) <= whole < 2**63:
                raise ValueError("not a whole number")
            return int(whole)
        case "decimal" | "double":
            try:
                number = Decimal(text)
            except InvalidOperation:
                raise ValueError("not a number") from None
            if not number.is_finite() or number.adjusted() >= 38 or number.as_tuple().exponent < -38:
                raise ValueError("not a number")
            return number
        case "boolean":
            if text.lower() not in ("true", "false"):
                raise ValueError("neither true nor false")
            return text.lower() == "true"
        case "date":
            try:
                return date.fromisoformat(text)
            except ValueError:
                raise ValueError("not a date like 2024-02-29") from None
        case "dateTime":
            try:
                when = datetime.fromisoformat(text)
            except ValueError:
                when = None
            if when is None or when.tzinfo is None:
                raise ValueError("not an instant with an offset")
            return when
    return text


def criterion(p: Property, operator: str, raw: object, violations: list[Violation]) -> Criterion | None:
    """Check and coerce one criterion, adding every problem to ``violations``."""
    if operator not in OPERATORS:
        violations.append(Violation(p.iri, f"no operator is called {operator}"))
        return None
    if not applicable(operator, p):
        violations.append(Violation(p.iri, f"{operator} has no meaning for {p.name}"))
        return None
    if operator in PRESENCE_OPERATORS:
        return Criterion(p, operator)
    if raw is None:
        violations.append(Violation(p.iri, f"{operator} needs a value"))
        return None
    before = len(violations)
    values: list[object] = []
    many = operator == "in"
    items = ([t.strip() for t in raw.split(",")] if isinstance(raw, str) else list(raw)) if many else [raw]
    for item in items:
        if many and item == "":
            violations.append(Violation(p.iri, "an empty value in the list"))
            continue
        try:
            values.append(literal(p, item))
        except ValueError as err:
            violations.append(Violation(p.iri, str(err)))
    if len(violations) > before:
        return None
    return Criterion(p, operator, tuple(values) if many else values[0])


def from_tree(schema: Schema, source: str, node: object) -> list[Criterion]:
    """A rollup's filter: ``{"and": [...]}``, ``{"path", "op", "value"}``, or (name, op, value) tuples.

    Only AND is supported; a null value turns "is" / "is not" into a presence test.
    """
    if not node:
        return []
    if isinstance(node, (list, tuple)):
        if node and isinstance(node[0], str):
            name, op, value = (*node, None)[:3]
            p = schema.lookup(source, name)
            if p is None:
                raise InvalidQuery([Violation(name, f"no property is called {name}")])
            found: list[Violation] = []
            c = criterion(p, op, value, found)
            if found:
                raise InvalidQuery(found)
            return [c]
        return [c for child in node for c in from_tree(schema, source, child)]
    if "and" in node:
        return [c for child in node["and"] for c in from_tree(schema, source, child)]
    if "or" in node or "any" in node:
        kind = "or" if "or" in node else "any"
        raise InvalidQuery([Violation(source, f"{kind} is not known here: conditions hold all together")])
    path, op, value = node["path"], node["op"], node.get("value")
    if value is None and op in TREE_PRESENCE:
        operator = TREE_PRESENCE[op]
    elif op in TREE_OPERATORS:
        operator = TREE_OPERATORS[op]
    else:
        raise InvalidQuery([Violation(path, f"no condition is called {op}")])
    return from_tree(schema, source, (path, operator, value))
