"""Table-wide validation: every check yields violation rows (id, property, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import NUMERIC, Property
from ..session import materialise
from ..sources.store import ObjectStore

# Stages in the order in which they are checked.
STAGES = ("coercion", "structural", "shapes")

Check = tuple[str, Column, Column | str]  # property, "is violated", message


def violations(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """All row-level checks in one pass over the rows, without a shuffle."""
    if not checks:
        return rows.select("id", F.lit("").alias("property"), F.lit("").alias("message")).where(F.lit(False))
    cells = [
        F.when(
            F.coalesce(bad, F.lit(False)),
            F.struct(F.lit(name).alias("property"), (F.lit(msg) if isinstance(msg, str) else msg).alias("message")),
        )
        for name, bad, msg in checks
    ]
    return rows.select("id", F.explode(F.array_compact(F.array(*cells))).alias("v")).select("id", "v.property", "v.message")


def required(props: list[Property]) -> list[Check]:
    return [(p.name, F.col(p.name).isNull(), f"a value for {p.name} is missing") for p in props if p.min >= 1]


def cardinality(props: list[Property]) -> list[Check]:
    out: list[Check] = []
    for p in props:
        if p.max is None or not p.is_list:
            continue
        n = F.size(F.col(p.name))
        out.append((p.name, n > p.max, F.concat(F.lit(f"no more than {p.max} values fit, there are "), n.cast("string"))))
    return out


def shapes(props: list[Property]) -> list[Check]:
    """Numeric bounds, both inclusive, and patterns."""
    out: list[Check] = []
    for p in props:
        col = F.col(p.name)
        if p.datatype in NUMERIC and p.min_value is not None:
            out.append((p.name, col < F.lit(p.min_value).cast(p.scalar_type), f"below the least value {p.min_value}"))
        if p.datatype in NUMERIC and p.max_value is not None:
            out.append((p.name, col > F.lit(p.max_value).cast(p.scalar_type), f"above the greatest value {p.max_value}"))
        if p.pattern is not None:
            out.append((p.name, ~_all_match(col, p), f"does not follow {p.pattern}"))
    return out


def _all_match(col: Column, p: Property) -> Column:
    if p.is_list:
        return F.forall(col, lambda v: v.rlike(p.pattern))
    return col.rlike(p.pattern)


def abstract_types(store: ObjectStore, rows: DataFrame) -> DataFrame:
    """Rows that would create an object of an abstract type: that is their only violation."""
    names = [t.iri for t in store.schema.types if t.abstract]
    message = F.concat(F.col("type"), F.lit(" only groups other types"))
    return rows.where(F.col("type").isin(*names)).select("id", F.lit("").alias("property"), message.alias("message"))


def references(store: ObjectStore, rows: DataFrame, type_name: str) -> DataFrame:
    """Violations of reference integrity: targets that do not exist or have the wrong type.

    The distinct references are resolved, not the rows: a target named by very many rows meets
    the lookup once. Only references that the expected type does not hold are looked up among
    the other types. The few bad ones are then joined back.
    """
    parts: list[DataFrame] = []
    refs = [p for p in store.schema.properties(type_name) if p.is_ref and p.name in rows.columns]
    for target in dict.fromkeys(p.target for p in refs):
        pairs: dict[str, DataFrame] = {}
        for p in [p for p in refs if p.target == target]:
            ref = F.explode(F.array_distinct(F.col(p.name))) if p.is_list else F.col(p.name)
            pairs[p.name] = rows.select("id", ref.alias("ref")).where(F.col("ref").isNotNull())
        named = reduce(lambda a, b: a.unionByName(b), [x.select("ref") for x in pairs.values()]).distinct()
        unresolved = named.join(store.scan(target).select(F.col("id").alias("ref")), "ref", "left_anti")
        right = {t.name for t in store.schema.concrete(target)}
        others = [t.name for t in store.schema.concrete(*[t.name for t in store.schema.types]) if t.name not in right]
        found = store.scan(*others).select(F.col("id").alias("ref"), F.col("type").alias("found"))
        expected = store.schema.type(target).iri
        message = F.when(
            F.col("found").isNull(), F.concat(F.lit("nothing has the id "), F.col("ref"))
        ).otherwise(
            F.concat(
                F.col("ref"), F.lit(" is a "), F.col("found"), F.lit(f"; a {expected} was asked for")
            )
        )
        # Stored before the rows meet them, so that no task holds the look-ups and the rows at a time.
        bad = materialise(unresolved.join(found, "ref", "left").select("ref", message.alias("message")), "bad-references")
        parts += [x.join(bad, "ref").select("id", F.lit(name).alias("property"), "message") for name, x in pairs.items()]
    if not parts:
        return violations(rows, [])
    return reduce(lambda a, b: a.unionByName(b), parts)


def structural(store: ObjectStore, rows: DataFrame, type_name: str) -> DataFrame:
    """Required, maximum cardinality and references of rows of one concrete type."""
    props = [p for p in store.schema.properties(type_name) if p.name in rows.columns]
    return violations(rows, required(props) + cardinality(props)).unionByName(references(store, rows, type_name))


def first_failing_stage(staged: DataFrame) -> DataFrame:
    """Keep, per object, only the violations of the earliest stage that has any.

    ``staged`` carries a column ``stage`` with its position in ``STAGES``. The window is over the
    violations of one object, of which there are no more than its row can hold.
    """
    first = F.min("stage").over(Window.partitionBy("id"))
    return staged.withColumn("_first", first).where(F.col("stage") == F.col("_first")).drop("_first")


def validate(store: ObjectStore, rows: DataFrame, type_name: str, create: bool = True, coercion: DataFrame | None = None) -> DataFrame:
    """(id, stage, property, message): coercion, then structure, then shapes, stopping at the first that fails."""
    props = [p for p in store.schema.properties(type_name) if p.name in rows.columns]
    checked = rows
    parts = []
    if coercion is not None:
        parts.append(coercion.withColumn("stage", F.lit(0)))
    if create:
        abstract = abstract_types(store, rows)
        checked = rows.where(~F.col("type").isin(*[t.iri for t in store.schema.types if t.abstract]))
        parts.append(abstract.withColumn("stage", F.lit(1)))
    parts.append(structural(store, checked, type_name).withColumn("stage", F.lit(1)))
    parts.append(violations(checked, shapes(props)).withColumn("stage", F.lit(2)))
    staged = reduce(lambda a, b: a.unionByName(b), parts)
    name = F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("stage") + 1)
    return first_failing_stage(staged).select("id", name.alias("stage"), "property", "message")
