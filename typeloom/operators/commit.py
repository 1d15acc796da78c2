"""Change sets: optimistic checks, all-or-nothing sets, new versions and their events."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import name_uuid
from ..model import ENVELOPE
from ..session import materialise
from ..sources.store import ObjectStore
from ..sources.tagged import tagged_json
from ..sources.versions import overlay, singles

# Event kind of each operation.
EVENT_OF = {"create": "ObjectCreated", "update": "ObjectUpdated", "delete": "ObjectDeleted"}


class EmptyChangeSet(ValueError):
    pass


@dataclass(frozen=True)
class Commit:
    """Outcome of one batch of change sets."""

    tables: dict[str, DataFrame]  # every row of each touched type, after the batch
    versions: dict[str, DataFrame]  # only the rows the batch wrote: append these to a version log
    rejected: DataFrame  # (changeset_id, seq, id, status)
    deferred: DataFrame  # change rows to hand in again: they touch an object an earlier set decides
    log: DataFrame


def require_changes(mutations: int, events: int = 0) -> None:
    if mutations == 0 and events == 0:
        raise EmptyChangeSet("a change set needs at least one mutation or event")


def judge(current: DataFrame, changes: DataFrame, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """(changes with their own status, change sets that do not take effect).

    First result: changeset_id, seq, id, status. Second: changeset_id, verdict (rejected or
    deferred); all other sets are accepted.

    ``current`` holds (id, type, version, live); ``live`` is false for deleted and foreign objects.
    ``known`` are the types whose objects the batch may create: others are ``unknown_type``, and a
    change that names another type than its object has is ``wrong_type``. Changes without a set, an id or a known operation
    are ``no_changeset``, ``no_id`` and ``unknown_op``. One bad member rejects its whole set. Sets take effect in the order of ``changeset_id``: a set that
    touches an object of an earlier set still undecided is deferred, unless no outcome of the
    earlier sets could save it.

    Only the few columns that decide are moved, and they are written once. Sets are judged through
    the distinct ids of bad and waiting sets, never by gathering the members of a set, so a set of
    any size is as cheap as many small ones.
    """
    slim = changes.select("changeset_id", "seq", "id", "op", "expected_version", "type")
    now = current.select("id", F.col("version").alias("now"), (~F.col("live")).alias("gone"), F.col("type").alias("is_a"))
    doubled = slim.groupBy("changeset_id", "id").agg(F.count("*").alias("times")).where("times > 1")
    doubled = materialise(doubled, "doubled")  # rarely any: the changes then need not meet them
    c = slim.join(now, "id", "left")
    c = c.withColumn("times", F.lit(None).cast("long")) if doubled.isEmpty() else c.join(doubled, ["changeset_id", "id"], "left")
    creating, exists, twice = F.col("op") == "create", F.col("now").isNotNull(), F.col("times").isNotNull()
    foreign = creating & ~F.coalesce(F.col("type").isin(known), F.lit(False))
    other = exists & ~creating & ~F.col("type").eqNullSafe(F.col("is_a"))
    # A set without an id could never be told apart from another: its changes are turned down one by one.
    no_set, no_id = F.col("changeset_id").isNull(), F.col("id").isNull()
    no_op = ~F.coalesce(F.col("op").isin(*EVENT_OF), F.lit(False))
    status = (
        F.when(no_set, F.lit("no_changeset"))
        .when(no_id, F.lit("no_id"))
        .when(no_op, F.lit("unknown_op"))
        .when(twice, F.lit("duplicate"))
        .when(foreign, F.lit("unknown_type"))
        .when(creating & exists, F.lit("exists"))
        .when(creating, F.lit("ok"))
        .when(~exists | F.col("gone"), F.lit("not_found"))
        .when(other, F.lit("wrong_type"))
        .when(F.col("now") != F.col("expected_version"), F.lit("stale"))
        .otherwise(F.lit("ok"))
    )
    overtaken = exists & (creating | F.col("gone") | (F.col("expected_version") < F.col("now")))
    hopeless = no_id | no_op | twice | foreign | F.coalesce(other | overtaken, F.lit(False))
    rows = materialise(c.select("changeset_id", "seq", "id", status.alias("status"), hopeless.alias("hopeless")), "judged")

    named = rows.where(F.col("changeset_id").isNotNull())
    lost = named.where("hopeless").select("changeset_id").distinct()
    alive = named.join(lost, "changeset_id", "left_anti")
    contested = alive.groupBy("id").agg(F.min("changeset_id").alias("first"), F.max("changeset_id").alias("last")).where("first < last")
    waits = alive.join(contested, "id").where(F.col("changeset_id") > F.col("first")).select("changeset_id").distinct()
    bad = named.where("status <> 'ok'").select("changeset_id", "hopeless")
    marked = bad.withColumn("waits", F.lit(False)).unionByName(waits.select("changeset_id", F.lit(False).alias("hopeless"), F.lit(True).alias("waits")))
    held = F.max("waits") & ~F.max("hopeless")
    refused = marked.groupBy("changeset_id").agg(F.when(held, F.lit("deferred")).otherwise(F.lit("rejected")).alias("verdict"))
    refused = materialise(refused, "refused")
    return rows.drop("hopeless"), refused


def _created(store: ObjectStore, mine: DataFrame, props: list[str]) -> DataFrame:
    at, by = F.col("at"), F.col("by")
    out = {
        "id": F.col("id"),
        "tenant": F.lit(store.tenant),
        "type": F.col("type"),
        "version": F.lit(1).cast("long"),
        "state": F.col("state"),
        "created_at": at,
        "created_by": by,
        "updated_at": at,
        "updated_by": by,
        "deleted_at": F.lit(None).cast("timestamp"),
    }
    kept = [F.col(c) for c in _TRACE]
    return mine.where(F.col("op") == "create").select(*[out[n].alias(n) for n in ENVELOPE], *props, *kept)


def _modified(base: DataFrame, mine: DataFrame, props: list[str], how: str) -> DataFrame:
    """Rows after their update or delete. With ``how`` = left the untouched rows are kept too."""
    b, c = base.alias("b"), mine.where(F.col("op") != "create").alias("c")
    op = F.col("c.op")
    touched, updating = op.isNotNull(), op == "update"

    def pick(name: str) -> Column:
        return F.when(updating, F.col(f"c.{name}")).otherwise(F.col(f"b.{name}")).alias(name)

    out = {
        "version": F.when(touched, F.col("b.version") + 1).otherwise(F.col("b.version")),
        "state": pick("state"),
        "updated_at": F.when(touched, F.col("c.at")).otherwise(F.col("b.updated_at")),
        "updated_by": F.when(touched, F.col("c.by")).otherwise(F.col("b.updated_by")),
        "deleted_at": F.when(op == "delete", F.col("c.at")).otherwise(F.col("b.deleted_at")),
    }
    envelope = [(out[n] if n in out else F.col(f"b.{n}")).alias(n) for n in ENVELOPE]
    trace = [F.col(f"c.{n}") for n in _TRACE]
    return b.join(c, F.col("b.id") == F.col("c.id"), how).select(*envelope, *[pick(p) for p in props], *trace)


# Columns of the change that an event needs besides the row it left behind.
_TRACE = ("changeset_id", "seq", "op", "at")


def apply_changes(store: ObjectStore, changes: DataFrame, *types: str, keep: bool = False) -> Commit:
    """One round over a batch of change sets that touch objects of ``types``.

    ``changes``: changeset_id, seq, op (create, update, delete), id, type, expected_version,
    state, at, by and one column per property; an update replaces all properties. With ``keep`` the
    written rows are stored once and serve the tables, the versions and the log alike.
    """
    names = store.concrete(*types)
    live = (F.col("tenant") == store.tenant) & F.col("deleted_at").isNull()
    current = reduce(
        lambda a, b: a.unionByName(b),
        [store.table(n).select("id", "type", "version", live.alias("live")) for n in names],
    )
    judged, refused = judge(current, changes, [store.schema.type(n).iri for n in names])
    # Changes meet the verdicts once; what is accepted and what is deferred are parts of the same rows.
    ruled = materialise(changes.where(F.col("changeset_id").isNotNull()).join(refused, "changeset_id", "left"), "ruled")
    accepted = ruled.where(F.col("verdict").isNull())
    tables, written, logs = {}, {}, []
    for n in names:
        props = [p.name for p in store.schema.properties(n)]
        mine = accepted.where(F.col("type") == store.schema.type(n).iri)
        for p in store.schema.properties(n):
            if p.name not in mine.columns:
                mine = mine.withColumn(p.name, F.lit(None).cast(p.spark_type))
        # At most one accepted change per object, so both sides of the joins are unique on the id;
        # a batch that is small beside the table is broadcast and the table stays where it is.
        created = _created(store, mine, props)
        changed = _modified(store.table(n), mine, props, "inner").unionByName(created)
        if keep:
            changed = materialise(changed, f"versions-{n}")
            tables[n] = store.table(n).join(changed.select("id"), "id", "left_anti").select(*changed.columns[: -len(_TRACE)]).unionByName(changed.drop(*_TRACE))
        else:
            tables[n] = _modified(store.table(n), mine, props, "left").unionByName(created).drop(*_TRACE)
        written[n] = changed.drop(*_TRACE)
        logs.append(_events(store, n, changed))
    unnamed = judged.where(F.col("changeset_id").isNull())
    rejected = judged.join(refused.where("verdict = 'rejected'"), "changeset_id").select("changeset_id", "seq", "id", "status").unionByName(unnamed)
    deferred = ruled.where("verdict = 'deferred'").select(*changes.columns)
    return Commit(tables, written, rejected, deferred, reduce(lambda a, b: a.unionByName(b), logs))


def _events(store: ObjectStore, type_name: str, changed: DataFrame) -> DataFrame:
    """One event per written row; a delete carries the properties the object had."""
    kind = F.create_map(*[F.lit(x) for kv in EVENT_OF.items() for x in kv])
    snapshot = F.when(F.col("op") == "delete", tagged_json(store.schema, type_name))
    return changed.select(
        name_uuid(F.concat_ws("|", F.col("changeset_id").cast("string"), F.col("seq").cast("string"))).alias("entry_id"),
        "tenant",
        F.col("changeset_id").cast("string").alias("changeset_id"),
        F.col("seq").cast("int").alias("seq"),
        F.element_at(kind, F.col("op")).alias("kind"),
        F.col("id").alias("object_id"),
        "type",
        "version",
        F.lit(store.ontology_version).cast("long").alias("ontology_version"),
        F.col("at").alias("occurred_at"),
        snapshot.alias("payload"),
    )


def update_events(store: ObjectStore, type_name: str, rows: DataFrame, label: str, op: str = "update") -> DataFrame:
    """Events of row versions that were written by the library itself rather than by a change set."""
    traced = rows.select(
        "*",
        F.concat_ws("-", F.lit(label), F.col("id")).alias("changeset_id"),
        F.lit(0).alias("seq"),
        F.lit(op).alias("op"),
        F.col("updated_at").alias("at"),
    )
    return _events(store, type_name, traced)


def apply_all(store: ObjectStore, changes: DataFrame, *types: str) -> tuple[ObjectStore, DataFrame, DataFrame]:
    """Hand deferred sets in again until none is left: the outcome of running the sets one by one.

    Every round decides the earliest open set of each object, and drops all that can no longer
    succeed, so rounds are as many as the longest run of successful changes to one object.
    Only the row versions a round wrote are stored; the tables are read with them laid over.
    Returns the store after the batch, all rejected changes and the whole log.
    """
    names = store.concrete(*types)
    base = {n: store.table(n) for n in names}
    written: dict[str, DataFrame] = {}
    rejected, log, pending = None, None, materialise(changes, "changes")
    while True:
        result = apply_changes(store, pending, *types, keep=True)
        for n in names:
            rows = result.versions[n]
            written[n] = written[n].unionByName(rows) if n in written else rows
        rejected = result.rejected if rejected is None else rejected.unionByName(result.rejected)
        log = result.log if log is None else log.unionByName(result.log)
        pending = result.deferred
        for n in names:
            store = store.with_table(n, overlay(base[n], written[n], single=singles(written[n])))
        if pending.isEmpty():
            return store, rejected, log
