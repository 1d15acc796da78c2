"""Change batches, change events, dataset and three-way differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators.commit import apply_all, apply_changes
from .demo import BASE, DemoStore, ref
from .q_read import stamp
from .registry import query

_AT = "2024-07-01 12:00:00"
PROPS = ("status", "priority", "totalPrice", "orderDate", "customer", "lineCount", "openLineCount")


def order_batch(s: DemoStore) -> DataFrame:
    """One change to every order: an update, or a delete for each fifth; some are doomed to fail.

    Ten neighbouring orders share a change set, so one bad member takes nine others with it.
    """
    k = F.conv(F.substring("id", 25, 12), 16, 10).cast("long")
    rows = s.scan("Order").withColumn("k", k)
    op = F.when(F.col("k") % 5 == 2, F.lit("delete")).otherwise(F.lit("update"))
    expected = F.when(F.col("k") % 100 == 3, F.lit(2)).otherwise(F.lit(1)).cast("long")
    missing = F.col("k") % 200 == 4
    return rows.select(
        F.floor(F.col("k") / 10).alias("changeset_id"),
        (F.col("k") % 10).cast("int").alias("seq"),
        op.alias("op"),
        F.when(missing, ref("Order", F.col("k") + 10_000_000)).otherwise(F.col("id")).alias("id"),
        "type",
        expected.alias("expected_version"),
        "state",
        F.lit(_AT).cast("timestamp").alias("at"),
        F.lit("batch").alias("by"),
        "status",
        "priority",
        (F.col("totalPrice") + 1).cast("decimal(18,2)").alias("totalPrice"),
        *PROPS[3:],
    )


_BATCH = (
    "b AS (SELECT o_orderkey AS k, o_orderkey // 10 AS changeset_id, CAST(o_orderkey % 10 AS INTEGER) AS seq, "
    "CASE WHEN o_orderkey % 5 = 2 THEN 'delete' ELSE 'update' END AS op, id, "
    "CASE WHEN o_orderkey % 100 = 3 THEN 'stale' WHEN o_orderkey % 200 = 4 THEN 'not_found' ELSE 'ok' END AS own, "
    "o_orderkey % 200 = 4 AS missing FROM l_order), "
    "good AS (SELECT * FROM b WHERE changeset_id NOT IN (SELECT changeset_id FROM b WHERE own <> 'ok'))"
)


@query(
    "commit_apply",
    "SELECT o.id, CASE WHEN g.op IS NULL THEN o.version ELSE 2 END AS version, CAST(CASE WHEN g.op = 'update' THEN o.totalPrice + 1 ELSE o.totalPrice END AS DOUBLE) AS total, "
    f"CASE WHEN g.op IS NULL THEN 'loader' ELSE 'batch' END AS updated_by, CASE WHEN g.op = 'delete' THEN '{_AT}' ELSE strftime(o.deleted_at, '%Y-%m-%d %H:%M:%S') END AS deleted "
    "FROM v_order o LEFT JOIN good g ON g.id = o.id",
    _BATCH,
)
def commit_apply(s: DemoStore) -> DataFrame:
    table = apply_changes(s, order_batch(s), "Order").tables["Order"]
    return table.select("id", "version", F.col("totalPrice").cast("double").alias("total"), "updated_by", stamp("deleted_at", "deleted"))


@query(
    "commit_versions",
    "SELECT g.id, CAST(2 AS BIGINT) AS version, g.op = 'delete' AS deleted FROM good g",
    _BATCH,
)
def commit_versions(s: DemoStore) -> DataFrame:
    rows = apply_changes(s, order_batch(s), "Order").versions["Order"]
    return rows.select("id", "version", (F.col("deleted_at") == F.lit(_AT).cast("timestamp")).alias("deleted")).fillna(False)


@query(
    "commit_conflicts",
    "SELECT CASE WHEN missing THEN '00000000-0000-4000-8006-' || lpad(lower(to_hex(k + 10000000)), 12, '0') ELSE id END AS id, own AS status FROM b WHERE own <> 'ok'",
    _BATCH,
)
def commit_conflicts(s: DemoStore) -> DataFrame:
    rejected = apply_changes(s, order_batch(s), "Order").rejected
    return rejected.where(F.col("status") != "ok").select("id", "status")


@query(
    "commit_null_set",
    "SELECT CASE WHEN missing THEN '00000000-0000-4000-8006-' || lpad(lower(to_hex(k + 10000000)), 12, '0') ELSE id END AS id, "
    "CASE WHEN k % 7 = 0 THEN 'no_changeset' WHEN changeset_id IN (SELECT changeset_id FROM b WHERE own <> 'ok' AND k % 7 <> 0) THEN 'rejected: ' || own ELSE 'written' END AS outcome FROM b",
    _BATCH,
)
def commit_null_set(s: DemoStore) -> DataFrame:
    """Each seventh change has no change set: it is turned down, whatever it says, and takes nothing with it."""
    lost = F.when((F.col("changeset_id") * 10 + F.col("seq")) % 7 != 0, F.col("changeset_id"))
    out = apply_changes(s, order_batch(s).withColumn("changeset_id", lost), "Order")
    said = F.when(F.col("status") == "no_changeset", F.col("status")).otherwise(F.concat(F.lit("rejected: "), "status"))
    return out.rejected.select("id", said.alias("outcome")).unionByName(out.versions["Order"].select("id", F.lit("written").alias("outcome")))


@query(
    "commit_atomic",
    "SELECT changeset_id, count(*) AS members, max(CASE WHEN own <> 'ok' THEN 1 ELSE 0 END) = 0 AS accepted FROM b GROUP BY changeset_id",
    _BATCH,
)
def commit_atomic(s: DemoStore) -> DataFrame:
    from ..operators.commit import judge

    live = (F.col("tenant") == s.tenant) & F.col("deleted_at").isNull()
    batch = order_batch(s)
    judged, refused = judge(s.table("Order").select("id", "type", "version", live.alias("live")), batch, [BASE + "Order"])
    sets = judged.groupBy("changeset_id").agg(F.count("*").alias("members"))
    return sets.join(refused, "changeset_id", "left").select("changeset_id", "members", F.col("verdict").isNull().alias("accepted"))


@query(
    "changelog_emit",
    "SELECT o.id AS object_id, CAST(g.changeset_id AS VARCHAR) AS changeset_id, g.seq, CASE g.op WHEN 'delete' THEN 'ObjectDeleted' ELSE 'ObjectUpdated' END AS kind, "
    "CAST(2 AS BIGINT) AS version, g.op = 'delete' AS has_snapshot FROM good g JOIN v_order o ON o.id = g.id",
    _BATCH,
)
def changelog_emit(s: DemoStore) -> DataFrame:
    log = apply_changes(s, order_batch(s), "Order").log
    return log.select("object_id", "changeset_id", "seq", "kind", "version", F.col("payload").isNotNull().alias("has_snapshot"))


@query(
    "commit_serial",
    "SELECT id, CAST(CASE WHEN o_orderkey % 4 = 1 THEN 3 ELSE 2 END AS BIGINT) AS version, "
    "CAST(totalPrice + CASE WHEN o_orderkey % 4 IN (1, 3) THEN 2 ELSE 1 END AS DOUBLE) AS total FROM l_order",
)
def commit_serial(s: DemoStore) -> DataFrame:
    """Two change sets per order in one batch: for some the second builds on the first, for some the
    first is stale and only the second counts, and for the others the second is stale."""
    k = F.conv(F.substring("id", 25, 12), 16, 10).cast("long")
    rows = s.scan("Order").withColumn("k", k)
    step = F.explode(F.array(F.lit(1), F.lit(2)))
    rows = rows.withColumn("step", step)
    chained, late = F.col("k") % 4 == 1, (F.col("k") % 4 == 3) & (F.col("step") == 1)
    expected = F.when(chained, F.col("step")).when(late, F.lit(5)).otherwise(F.lit(1)).cast("long")
    changes = rows.select(
        (F.col("step") * 1_000_000_000_000 + F.col("k")).alias("changeset_id"),
        F.lit(0).alias("seq"),
        F.lit("update").alias("op"),
        "id",
        "type",
        expected.alias("expected_version"),
        "state",
        F.lit(_AT).cast("timestamp").alias("at"),
        F.lit("batch").alias("by"),
        "status",
        "priority",
        (F.col("totalPrice") + F.col("step")).cast("decimal(18,2)").alias("totalPrice"),
        *PROPS[3:],
    )
    after, _, _ = apply_all(s, changes, "Order")
    return after.scan("Order").select("id", "version", F.col("totalPrice").cast("double").alias("total"))


FIELDS = ["id", "status", "priority", "totalPrice"]


def _old_new(s: DemoStore) -> tuple[DataFrame, DataFrame]:
    k = F.conv(F.substring("id", 25, 12), 16, 10).cast("long")
    old = s.scan("Order").select("id", "status", "priority", F.col("totalPrice").cast("double").alias("totalPrice"))
    raised = F.when(k % 5 == 1, F.col("totalPrice") + 1).otherwise(F.col("totalPrice"))
    return old, old.where(k % 5 != 2).withColumn("totalPrice", raised)


_OLD = (
    "old AS (SELECT o_orderkey AS k, id, status, priority, CAST(totalPrice AS DOUBLE) AS totalPrice FROM l_order), "
    "new AS (SELECT k, id, status, priority, CASE WHEN k % 5 = 1 THEN totalPrice + 1 ELSE totalPrice END AS totalPrice FROM old WHERE k % 5 <> 2)"
)


@query(
    "dataset_diff",
    "SELECT id, status, priority, totalPrice, 'removed' AS change FROM old WHERE k % 5 IN (1, 2) UNION ALL "
    "SELECT id, status, priority, totalPrice, 'added' FROM new WHERE k % 5 = 1",
    _OLD,
)
def dataset_diff(s: DemoStore) -> DataFrame:
    old, new = _old_new(s)
    return D.dataset_diff(old, new)


@query(
    "dataset_diff_by_key",
    "SELECT status, count(CASE WHEN c = 'a' THEN 1 END) AS added, count(CASE WHEN c = 'r' THEN 1 END) AS removed FROM "
    "(SELECT status, 'r' AS c FROM old WHERE k % 5 IN (1, 2) UNION ALL SELECT status, 'a' FROM new WHERE k % 5 = 1) GROUP BY status",
    _OLD,
)
def dataset_diff_by_key(s: DemoStore) -> DataFrame:
    old, new = _old_new(s)
    return D.diff_by_key(D.dataset_diff(old, new), "status")


@query(
    "apply_delta",
    "SELECT id, status, priority, totalPrice FROM new UNION SELECT id, status, priority, totalPrice FROM old WHERE k % 15 = 2",
    _OLD,
)
def apply_delta(s: DemoStore) -> DataFrame:
    """The old rows with the difference applied; rows both removed and added stay."""
    old, new = _old_new(s)
    d = D.dataset_diff(old, new)
    added, removed = (d.where(F.col("change") == c).drop("change") for c in ("added", "removed"))
    k = F.conv(F.substring("id", 25, 12), 16, 10).cast("long")
    again = removed.where(k % 15 == 2)
    return D.apply_delta(old, added.unionByName(again), removed)


def _three(s: DemoStore) -> DataFrame:
    k = F.conv(F.substring("id", 25, 12), 16, 10).cast("long")
    base = s.scan("Order").select("id", "priority", "status", k.alias("k"))
    mine = F.when(F.col("k") % 24 == 0, F.lit("same")).when(F.col("k") % 3 == 0, F.lit("local")).otherwise(F.col("priority"))
    theirs = F.when(F.col("k") % 24 == 0, F.lit("same")).when(F.col("k") % 4 == 0, F.lit("server")).otherwise(F.col("priority"))
    local = base.withColumn("priority", mine).where(F.col("k") % 50 != 7)
    server = base.withColumn("priority", theirs)
    return D.three_way(base, local, server, "id", ["priority", "status"])


_THREE = (
    "d AS (SELECT id, 'priority' AS field, priority AS base, CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderkey % 24 = 0 THEN 'same' WHEN o_orderkey % 3 = 0 THEN 'local' ELSE priority END AS local, "
    "CASE WHEN o_orderkey % 24 = 0 THEN 'same' WHEN o_orderkey % 4 = 0 THEN 'server' ELSE priority END AS server FROM l_order "
    "UNION ALL SELECT id, 'status', status, CASE WHEN o_orderkey % 50 <> 7 THEN status END, status FROM l_order)"
)


@query(
    "three_way_diff",
    "SELECT id, field, base, local, server, local IS DISTINCT FROM base AS local_changed, server IS DISTINCT FROM base AS server_changed, "
    "(local IS DISTINCT FROM base AND server IS DISTINCT FROM base AND local IS DISTINCT FROM server) AS conflict FROM d",
    _THREE,
)
def three_way_diff(s: DemoStore) -> DataFrame:
    return _three(s)


@query(
    "three_way_merge",
    "SELECT * FROM (SELECT id, field, CASE WHEN local IS DISTINCT FROM base THEN local ELSE server END AS value FROM d) WHERE value IS NOT NULL",
    _THREE,
)
def three_way_merge(s: DemoStore) -> DataFrame:
    return D.reapply_local(_three(s))


@query(
    "commit_wrong_type",
    "SELECT o_orderkey AS changeset_id, id, CASE o_orderkey % 5 WHEN 1 THEN 'wrong_type' ELSE 'unknown_type' END AS status FROM l_order WHERE o_orderkey % 5 IN (1, 4)",
)
def commit_wrong_type(s: DemoStore) -> DataFrame:
    """A set for each order; some name another type than the order's, some create what isn't kept here."""
    k = F.conv(F.substring("id", 25, 12), 16, 10).cast("long")
    changes = s.scan("Order").withColumn("k", k).select(
        F.col("k").alias("changeset_id"),
        F.lit(0).alias("seq"),
        F.when(F.col("k") % 5 == 4, F.lit("create")).otherwise(F.lit("update")).alias("op"),
        "id",
        F.when(F.col("k") % 5 == 1, F.lit(BASE + "Customer")).when(F.col("k") % 5 == 4, F.lit(BASE + "Region")).otherwise(F.col("type")).alias("type"),
        F.lit(1).cast("long").alias("expected_version"),
        "state",
        F.lit(_AT).cast("timestamp").alias("at"),
        F.lit("batch").alias("by"),
        *PROPS,
    )
    return apply_changes(s, changes, "Order").rejected.select("changeset_id", "id", "status")
