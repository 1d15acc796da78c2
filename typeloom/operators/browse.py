"""Browse: filter, text search, total order, page, total and facet counts over a type union."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.names import lexical
from ..model import Property, Schema
from ..session import materialise, settled
from ..sources.store import SEARCH_TEXT, ObjectStore
from .predicates import Criterion, InvalidQuery, Violation, apply_criteria, conjunction, criterion, marked
from .rollup import derive

MAX_PAGE_SIZE = 500
MAX_OFFSET = 2**31 - 1
SCORE = "score"


@dataclass(frozen=True)
class BrowseSpec:
    """A browse request in raw form: property names or IRIs, values as text."""

    types: tuple[str, ...]
    filters: tuple[tuple, ...] = ()
    text: str | None = None
    sort: tuple[str, ...] = ()  # "name" ascending, "-name" descending
    page: int = 0
    size: int = 50
    facets: tuple[str, ...] = ()
    include_deleted: bool = False


@dataclass(frozen=True)
class Browse:
    """The same request after checking."""

    types: tuple[str, ...]
    criteria: tuple[Criterion, ...] = ()
    text: str | None = None
    sorts: tuple[tuple[Property, bool], ...] = ()
    page: int = 0
    size: int = 50
    facets: tuple[Property, ...] = ()
    include_deleted: bool = False


@dataclass(frozen=True)
class BrowseResult:
    items: DataFrame
    total: DataFrame
    facets: DataFrame


def resolve(schema: Schema, spec: BrowseSpec) -> Browse:
    """Check everything and fail with all problems at once; runs no job."""
    problems: list[Violation] = []
    for t in spec.types:
        if not schema.has_type(t):
            problems.append(Violation(t, f"no type is called {t}"))
    if problems:
        raise InvalidQuery(problems)
    props = schema.reachable_properties(*spec.types)
    derived = {}
    for t in spec.types:
        derived.update(schema.derived(t))

    def find(token: str, use: str) -> Property | None:
        p = next((x for x in props if token in (x.iri, x.name)), None)
        if p is None:
            problems.append(Violation(token, f"no property is called {token}"))
            return None
        if p.is_list:
            problems.append(Violation(p.iri, f"Property '{p.name}' has several values and cannot be used to {use}"))
            return None
        rule = derived.get(p.name)
        if rule is not None and not getattr(rule, "materialised", False):
            problems.append(Violation(p.iri, f"Property '{p.name}' is derived on read and cannot be used to {use}"))
            return None
        return p

    criteria = []
    for name, op, *value in spec.filters:
        p = find(name, "filter")
        if p is not None:
            c = criterion(p, op, value[0] if value else None, problems)
            if c is not None:
                criteria.append(c)
    sorts = []
    for key in spec.sort:
        p = find(key.lstrip("-+"), "sort")
        if p is not None:
            sorts.append((p, not key.startswith("-")))
    facets = []
    for name in spec.facets:
        p = find(name, "facet")
        if p is not None and not p.facet:
            problems.append(Violation(p.iri, f"Property '{p.name}' is not a facet property"))
        elif p is not None:
            facets.append(p)
    if not 1 <= spec.size <= MAX_PAGE_SIZE:
        problems.append(Violation("size", f"page size must be between 1 and {MAX_PAGE_SIZE}"))
    if spec.page < 0 or spec.page * spec.size > MAX_OFFSET:
        problems.append(Violation("page", "page number out of range"))
    if problems:
        raise InvalidQuery(problems)
    text = spec.text if spec.text and spec.text.strip() else None
    return Browse(spec.types, tuple(criteria), text, tuple(sorts), spec.page, spec.size, tuple(facets), spec.include_deleted)


def matching(store: ObjectStore, q: Browse, criteria: tuple[Criterion, ...] | list[Criterion] | None = None) -> DataFrame:
    """Scoped rows that meet the criteria (all of the request's, unless some are given) and the text."""
    rows = store.scan(*q.types, include_deleted=q.include_deleted, with_search_text=q.text is not None)
    rows = apply_criteria(rows, q.criteria if criteria is None else criteria)
    if q.text is None:
        return rows
    # A row without the query's words as plain substrings need not be split into tokens at all.
    for word in X.query_tokens(q.text):
        rows = rows.where(F.lower(F.col(SEARCH_TEXT)).contains(word))
    toks = settled(rows.withColumn("_tokens", X.tokens(F.col(SEARCH_TEXT)))).where(X.matches(F.col("_tokens"), q.text))
    return toks.withColumn(SCORE, X.score(F.col("_tokens"), q.text)).drop("_tokens", SEARCH_TEXT)


def order(q: Browse) -> list[Column]:
    """Total order: the given keys, else relevance, else creation time; the id always decides ties.

    Missing values come last ascending and first descending.
    """
    keys = [F.col(p.name).asc_nulls_last() if asc else F.col(p.name).desc_nulls_first() for p, asc in q.sorts]
    if not keys:
        keys = ([F.col(SCORE).desc()] if q.text is not None else []) + [F.col("created_at").asc()]
    return [*keys, F.col("id").asc()]


def page(rows: DataFrame, q: Browse) -> DataFrame:
    """One page; planned as top-k, so each task keeps offset+size rows and nothing is fully sorted."""
    ordered = rows.orderBy(*order(q))
    if q.page:
        ordered = ordered.offset(q.page * q.size)
    return ordered.limit(q.size)


def page_after(rows: DataFrame, q: Browse, last: dict[str, object]) -> DataFrame:
    """The page behind a row that had the values ``last`` (by column of the order, the id among them).

    However deep it lies, a task keeps ``size`` rows only. The first key's own bound is stated by itself, so that
    it reaches the scan where that key is stored.
    """
    keys = [(p.name, asc, p.scalar_type) for p, asc in q.sorts]
    if not keys:
        keys = ([(SCORE, False, "long")] if q.text is not None else []) + [("created_at", True, "timestamp")]
    behind, level, bound = F.lit(False), F.lit(True), None
    for name, ascending, kind in [*keys, ("id", True, "string")]:
        col, value = F.col(name), F.lit(last[name]).cast(kind)
        if last[name] is None:  # last of an ascending order, first of a descending one
            further = F.lit(False) if ascending else col.isNotNull()
        else:
            further = (col > value) | col.isNull() if ascending else col < value
        if bound is None:
            bound = further | col.eqNullSafe(value)
        behind = behind | (level & further)
        level = level & col.eqNullSafe(value)
    return rows.where(bound).where(behind).orderBy(*order(q)).limit(q.size)


def fresh_values(store: ObjectStore, items: DataFrame, *types: str) -> DataFrame:
    """A page with its derived properties worked out anew, in the same order."""
    at = fresh_name("_at", items)
    held = materialise(items.withColumn(at, F.monotonically_increasing_id()), "page")
    return derive(store, held, *types, one_page=True).orderBy(at).select(*items.columns)


def fresh_name(name: str, df: DataFrame) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name


def total(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).withColumn(
        "pages", F.ceil(F.col("total") / F.lit(size)).cast("long")
    )


def labels(store: ObjectStore, p: Property) -> DataFrame:
    """(facet, ref, label) of every live object a reference property may point at.

    The label is the display label declared by the property's own target type, or the id where
    that type has none. Objects without a label value are left out.
    """
    label = store.schema.label_of(p.target)
    targets = store.scan(p.target)
    text = F.col(label.name) if label is not None else F.col("id")
    if label is not None and label.is_list:
        text = F.get(F.col(label.name), 0)
    return targets.select(F.lit(p.name).alias("facet"), F.col("id").alias("ref"), text.alias("label")).where(F.col("label").isNotNull())


def label_join(store: ObjectStore, rows: DataFrame, p: Property) -> DataFrame:
    """Rows with the label of the object they reference; rows without one are dropped."""
    return rows.join(labels(store, p).select(F.col("ref").alias(p.name), "label"), p.name)


def facets(store: ObjectStore, q: Browse) -> DataFrame:
    """(facet, value, n) for all requested facets in one pass over the rows.

    A facet ignores the criteria on its own property and obeys all others. Each row yields one
    entry per facet it counts for; counting is done map-side before anything is shuffled, and ids
    are only turned into labels after they have been counted.
    """
    if not q.facets:
        return store.spark.createDataFrame([], "facet string, value string, n long")
    names = {p.name for p in q.facets}
    rows = matching(store, q, [c for c in q.criteria if c.property.name not in names])
    rows, own = marked(rows, [c for c in q.criteria if c.property.name in names])
    cells = []
    for p in q.facets:
        value = lexical(F.col(p.name), p.scalar_type)
        keep = F.coalesce(conjunction(own, excluding=p.name), F.lit(False))
        cells.append(F.struct(F.lit(p.name).alias("facet"), F.when(keep, value).alias("value")))
    if own:
        # A row that fails two facets' own criteria counts for none of them.
        rows = rows.where(
            reduce(lambda a, b: a | b, [F.coalesce(conjunction(own, excluding=p.name), F.lit(False)) for p in q.facets])
        )
    counted = (
        rows.select(F.explode(F.array(*cells)).alias("c"))
        .select("c.facet", "c.value")
        .where(F.col("value").isNotNull())
        .groupBy("facet", "value")
        .agg(F.count("*").alias("n"))
    )
    refs = [p for p in q.facets if p.is_ref]
    if not refs:
        return counted
    table = reduce(lambda a, b: a.unionByName(b), [labels(store, p) for p in refs])
    named = counted.join(table.withColumnRenamed("ref", "value"), ["facet", "value"], "left")
    is_ref = F.col("facet").isin(*[p.name for p in refs])
    return (
        named.withColumn("value", F.when(is_ref, F.col("label")).otherwise(F.col("value")))
        .where(F.col("value").isNotNull())
        .groupBy("facet", "value")
        .agg(F.sum("n").alias("n"))
    )


def facet_order(counts: DataFrame) -> DataFrame:
    """Most frequent first; equal counts by code point of the value."""
    return counts.orderBy("facet", F.col("n").desc(), F.col("value").asc())


def browse(store: ObjectStore, spec: BrowseSpec) -> BrowseResult:
    """Page, total and facets; the page's derived properties are worked out, stored copies are not shown."""
    q = resolve(store.schema, spec)
    rows = matching(store, q)
    return BrowseResult(fresh_values(store, page(rows, q), *q.types), total(rows, q.size), facet_order(facets(store, q)))
