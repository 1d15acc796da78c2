"""Rollups: aggregates of source objects grouped by the object they point at."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Rollup, Schema
from ..session import materialise
from ..sources.store import ObjectStore
from .predicates import Criterion, apply_criteria, conjunction, from_tree, marked


def rule_criteria(schema: Schema, rule: Rollup) -> list[Criterion]:
    return from_tree(schema, rule.source, rule.where)


def pointed_at(store: ObjectStore, source: str, via: str, include_deleted: bool = False) -> DataFrame:
    """Source rows with a column ``target``: the object the relationship names.

    A relationship with several values yields one row per distinct value.
    """
    rows = store.scan(source, include_deleted=include_deleted)
    p = store.schema.lookup(source, via)
    if p is None or not p.is_ref:
        raise ValueError(f"'{via}' is not a relationship of {source}")
    if p.is_list:
        return rows.withColumn("target", F.explode(F.array_distinct(F.col(via))))
    return rows.withColumn("target", F.col(via)).where(F.col("target").isNotNull())


def _aggregate(rule: Rollup, keep: Column, dtype: T.DataType | None) -> Column:
    """One conditional aggregate; the value stays missing where no source has one."""
    if rule.function == "COUNT":
        return F.count(F.when(keep, F.lit(1)))
    value = F.when(keep, F.col(rule.of))
    match rule.function:
        case "SUM":
            return F.sum(value)
        case "MIN":
            return F.min(value)
        case "MAX":
            return F.max(value)
        case "AVG":
            # avg() of a decimal would round to four more digits, and a sum of longs could overflow.
            exact = value if isinstance(dtype, T.DecimalType) else value.cast("decimal(38,0)")
            return F.sum(exact).cast("double") / F.count(value)
    raise ValueError(rule.function)


def aggregate_rules(store: ObjectStore, rules: list[Rollup], only: DataFrame | None = None) -> DataFrame:
    """(id, one column per rule) for rules that share source and relationship: one scan, one shuffle.

    Partial aggregates are formed before the shuffle, so a target with a third of all sources is
    no bottleneck. ``only`` limits the targets (a column ``id``).
    """
    source, via = rules[0].source, rules[0].via
    compiled = [(r, rule_criteria(store.schema, r)) for r in rules]
    shared = [c for c in compiled[0][1] if all(c in cs for _, cs in compiled)]
    rows = apply_criteria(pointed_at(store, source, via), shared)
    if only is not None:
        rows = rows.join(only.withColumnRenamed("id", "target"), "target", "left_semi")
    aggs = []
    for rule, cs in compiled:
        rows, own = marked(rows, [c for c in cs if c not in shared])
        keep = F.coalesce(conjunction(own), F.lit(False))
        of = store.schema.lookup(source, rule.of) if rule.of else None
        aggs.append(_aggregate(rule, keep, of.scalar_type if of else None).alias(rule.property))
    return rows.groupBy(F.col("target").alias("id")).agg(*aggs)


def rollup(store: ObjectStore, rule: Rollup, targets: DataFrame | None = None) -> DataFrame:
    """(id, value). COUNT is dense over ``targets`` (0 where nothing points), the others sparse."""
    agg = aggregate_rules(store, [rule]).select("id", F.col(rule.property).alias("value")).where(F.col("value").isNotNull())
    if targets is None:
        return agg
    ids = targets.select("id")
    if rule.function == "COUNT":
        return ids.join(agg, "id", "left").select("id", F.coalesce("value", F.lit(0)).alias("value"))
    return ids.join(agg, "id")


# ---------------------------------------------------------------- plug-ins

PlugIn = Callable[["DerivationContext", DataFrame], DataFrame]
_PLUGINS: dict[str, PlugIn] = {}


class DerivationContext:
    """What a plug-in may use: scoped scans and rollups."""

    def __init__(self, store: ObjectStore) -> None:
        self.store = store

    def scan(self, *types: str) -> DataFrame:
        return self.store.scan(*types)

    def rollup(self, rule: Rollup, targets: DataFrame | None = None) -> DataFrame:
        return rollup(self.store, rule, targets)


def register_plugin(name: str, function: PlugIn, maintained: bool = False) -> None:
    """``function(context, targets)`` returns (id, value), once for the whole set of targets.

    Nothing tells which targets of a plug-in a change affects, so it cannot be maintained.
    """
    if maintained:
        raise ValueError(f"plug-in '{name}' cannot be maintained: its affected targets are unknown")
    _PLUGINS[name] = function


def run_plugin(store: ObjectStore, name: str, targets: DataFrame) -> DataFrame:
    if name not in _PLUGINS:
        raise KeyError(f"unknown derivation plug-in '{name}'")
    return _PLUGINS[name](DerivationContext(store), targets).select("id", "value")


# ---------------------------------------------------------------- derivation of a result set


def derive(store: ObjectStore, objects: DataFrame, *types: str, rules: list[Rollup] | None = None, one_page: bool = False) -> DataFrame:
    """Objects of ``types`` with every derived property computed afresh.

    Rules over the same source and relationship share one aggregation; each object only receives
    the properties its own type derives. Stored copies of derived values are dropped first.
    ``one_page`` says that ``objects`` is a browse page (500 rows at most): the sources are then
    cut down to those objects before they are aggregated.
    """
    only = objects.select("id") if one_page else None
    wanted = rules if rules is not None else [r for r in store.schema.rollups if any(
        store.schema.is_subtype(c.name, r.on_type) for c in store.schema.concrete(*types))]
    plugins = {} if rules is not None else {
        p: n for p, n in store.schema.plugins.items() if any(store.schema.lookup(t, p) for t in types)}
    out = objects.drop(*[r.property for r in wanted], *plugins)
    groups: dict[tuple[str, str], list[Rollup]] = defaultdict(list)
    for r in wanted:
        groups[(r.source, r.via)].append(r)
    for group in groups.values():
        out = out.join(aggregate_rules(store, group, only), "id", "left")
    for r in wanted:
        mine = [t.iri for t in store.schema.concrete(r.on_type)]
        owns = F.col("type").isin(*mine)
        value = F.coalesce(F.col(r.property), F.lit(0)) if r.function == "COUNT" else F.col(r.property)
        out = out.withColumn(r.property, F.when(owns, value))
    for prop, name in plugins.items():
        out = out.join(run_plugin(store, name, objects).withColumnRenamed("value", prop), "id", "left")
    return out


def read_derived(store: ObjectStore, ids: DataFrame, *types: str) -> DataFrame:
    """Live objects of ``ids`` with every derived property worked out."""
    return derive(store, store.read_many(ids, *types), *types)


# ---------------------------------------------------------------- maintained rollups


def affected_targets(store: ObjectStore, changes: DataFrame, rules: list[Rollup] | None = None) -> DataFrame:
    """Distinct (id, property) whose value may change.

    ``changes`` has columns ``type`` (IRI) and ``before`` / ``after``, structs with the changed
    object's properties, null for a create / delete. Both images count, so an object that moves
    from one target to another refreshes both.
    """
    parts: list[DataFrame] = []
    for r in rules if rules is not None else [r for r in store.schema.rollups if r.materialised]:
        p = store.schema.lookup(r.source, r.via)
        if r.via not in changes.schema["after"].dataType.names:
            continue
        mine = changes.where(F.col("type").isin(*[t.iri for t in store.schema.concrete(r.source)]))
        images = [F.col(f"before.{r.via}"), F.col(f"after.{r.via}")]
        refs = F.array_compact(
            F.concat(*[F.coalesce(i, F.array().cast("array<string>")) for i in images]) if p.is_list else F.array(*images)
        )
        parts.append(mine.select(F.explode(F.array_distinct(refs)).alias("id"), F.lit(r.property).alias("property")))
    if not parts:
        return store.spark.createDataFrame([], "id string, property string")
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def recompute(store: ObjectStore, affected: DataFrame, rule: Rollup) -> DataFrame:
    """(id, version, old, new) for affected live targets whose stored value differs from the fresh one.

    Sources are aggregated map-side, so that a hot target meets the join as one row for each task.
    """
    mine = materialise(affected.where(F.col("property") == rule.property).select("id"), "affected")
    fresh = aggregate_rules(store, [rule], only=mine).select("id", F.col(rule.property).alias("new"))
    stored = store.scan(rule.on_type).select("id", "version", F.col(rule.property).alias("old")).join(mine, "id", "left_semi")
    new = F.coalesce(F.col("new"), F.lit(0)) if rule.function == "COUNT" else F.col("new")
    kind = store.schema.lookup(rule.on_type, rule.property).scalar_type
    return (
        stored.join(fresh, "id", "left")
        .select("id", "version", "old", new.cast(kind).alias("new"))
        .where(~F.col("new").eqNullSafe(F.col("old")))
    )
