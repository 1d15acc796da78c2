"""State machines over the orders and over the accounts behind the given events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import derived_id, keyed_id
from ..operators import lifecycle as L
from ..operators.reach import closure, edges, reachable
from .demo import ACCOUNT_MACHINE, ORDER_MACHINE, TYPE_NO, DemoStore, events
from .q_read import stamp
from .registry import query


def _key(column: str = "id"):
    return F.conv(F.substring(column, 25, 12), 16, 10).cast("long")


@query(
    "available_transitions",
    "SELECT o.id, t.transition FROM l_order o JOIN (VALUES ('Quoted', 'place'), ('Picking', 'ship'), ('Picking', 'lastLineGone'), ('Picking', 'oneLineLeft'), "
    "('Shipped', 'refuse'), ('Shipped', 'settle'), ('Shipped', 'settleUnanswered'), ('Settled', 'complain')) AS t(state, transition) ON t.state = o.state",
)
def available_transitions(s: DemoStore) -> DataFrame:
    return L.available(s.scan("Order"), ORDER_MACHINE).select("id", "transition")


@query(
    "guard_available",
    "SELECT id, transition, ok AS available, CASE WHEN NOT ok THEN coalesce(message, 'the condition of ' || transition || ' does not hold') END AS reason FROM ("
    "SELECT id, 'place' AS transition, priority IS NOT NULL AS ok, 'an order needs a priority before it is picked' AS message FROM l_order WHERE state = 'Quoted' UNION ALL "
    "SELECT id, 'settle', totalPrice < 400000, NULL FROM l_order WHERE state = 'Shipped' UNION ALL "
    "SELECT id, 'lastLineGone', openLineCount = 0, NULL FROM l_order WHERE state = 'Picking' UNION ALL "
    "SELECT id, 'oneLineLeft', openLineCount = 1, NULL FROM l_order WHERE state = 'Picking')",
)
def guard_available(s: DemoStore) -> DataFrame:
    guarded = [t.name for t in ORDER_MACHINE.transitions if t.guard]
    return L.available(s.scan("Order"), ORDER_MACHINE).where(F.col("transition").isin(*guarded))


def order_commands(s: DemoStore) -> DataFrame:
    """One user command per order, and a second, later one for every other order."""
    k = _key()
    first = F.element_at(F.array(*[F.lit(n) for n in ("place", "ship", "refuse", "settle")]), (k % 4 + 1).cast("int"))
    rows = s.scan("Order", include_deleted=True).select("id", k.alias("k"), first.alias("transition"))
    n = F.explode(F.when(F.col("k") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("*", n.alias("n")).select(
        (F.col("k") * 10 + F.col("n")).alias("command_id"),
        "id",
        F.when(F.col("n") == 2, F.lit("settle")).otherwise(F.col("transition")).alias("transition"),
        F.when(F.col("k") % 13 == 0, F.lit(7)).otherwise(F.lit(1)).cast("long").alias("expected_version"),
        F.timestamp_seconds(F.lit(1719835200) + F.col("n")).alias("at"),
    )


_COMMANDS = (
    "c AS (SELECT o_orderkey * 10 + n AS command_id, id, n, CASE WHEN n = 2 THEN 'settle' ELSE ['place', 'ship', 'refuse', 'settle'][o_orderkey % 4 + 1] END AS transition, "
    "o_orderkey % 13 = 0 AS old FROM (SELECT id, o_orderkey, unnest([1, 2]) AS n FROM v_order WHERE tenant = 'default') WHERE n = 1 OR o_orderkey % 2 = 0), "
    "j AS (SELECT c.*, o.state, CASE WHEN o.id IS NULL THEN 'not_found' WHEN old THEN 'stale' "
    "WHEN (o.state, c.transition) NOT IN (('Quoted', 'place'), ('Picking', 'ship'), ('Shipped', 'refuse'), ('Shipped', 'settle')) THEN 'unavailable' "
    "WHEN (c.transition = 'place' AND o.priority IS NULL) OR (c.transition = 'settle' AND o.totalPrice >= 400000) THEN 'guard' ELSE 'fired' END AS st "
    "FROM c LEFT JOIN l_order o ON o.id = c.id)"
)


@query(
    "fire_commands",
    "SELECT command_id, id, transition, CASE WHEN n = 2 AND st <> 'not_found' AND id IN (SELECT id FROM j WHERE n = 1 AND st = 'fired') THEN 'stale' ELSE st END AS status FROM j",
    _COMMANDS,
)
def fire_commands(s: DemoStore) -> DataFrame:
    return L.fire(s.scan("Order"), order_commands(s), ORDER_MACHINE).select("command_id", "id", "transition", "status")


@query(
    "fire_moved",
    "SELECT o.id, CASE f.transition WHEN 'place' THEN 'Picking' WHEN 'ship' THEN 'Shipped' WHEN 'refuse' THEN 'Returned' WHEN 'settle' THEN 'Settled' ELSE o.state END AS state, "
    "o.version + CAST(f.id IS NOT NULL AS BIGINT) AS version FROM l_order o LEFT JOIN (SELECT id, arg_min(transition, n) AS transition FROM j WHERE st = 'fired' GROUP BY id) f ON f.id = o.id",
    _COMMANDS,
)
def fire_moved(s: DemoStore) -> DataFrame:
    orders = s.scan("Order")
    decided = L.fire(orders, order_commands(s), ORDER_MACHINE)
    return L.moved(orders, decided.where(F.col("status") == "fired")).select("id", "state", "version")


def chained_commands(s: DemoStore) -> DataFrame:
    """Three user commands per order, each expecting the version that the one before it would leave."""
    k, n = F.col("k"), F.col("n")
    rows = s.scan("Order", include_deleted=True).select("id", _key().alias("k"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    names = F.array(*[F.lit(x) for x in ("place", "ship", "refuse", "settle")])
    return rows.select(
        (k * 10 + n).alias("command_id"),
        "id",
        F.element_at(names, ((k + n - 1) % 4 + 1).cast("int")).alias("transition"),
        F.when(k % 13 == 0, F.lit(7)).otherwise(n).cast("long").alias("expected_version"),
        F.timestamp_seconds(F.lit(1719835200) + n).alias("at"),
    )


_CHAIN = (
    "ch AS (SELECT v.id, v.o_orderkey AS k, CAST(0 AS BIGINT) AS n, o.id IS NOT NULL AS live, o.state AS was, o.state, CAST(1 AS BIGINT) AS version, o.priority, o.totalPrice, CAST(NULL AS VARCHAR) AS transition, "
    "CAST(NULL AS VARCHAR) AS status FROM v_order v LEFT JOIN l_order o ON o.id = v.id WHERE v.tenant = 'default' UNION ALL "
    "SELECT id, k, n, live, was, CASE WHEN status <> 'fired' THEN was WHEN transition = 'place' THEN 'Picking' WHEN transition = 'ship' THEN 'Shipped' WHEN transition = 'refuse' THEN 'Returned' ELSE 'Settled' END, "
    "version + CAST(status = 'fired' AS BIGINT), priority, totalPrice, transition, status FROM ("
    "SELECT *, CASE WHEN NOT live THEN 'not_found' WHEN version <> (CASE WHEN k % 13 = 0 THEN 7 ELSE n END) THEN 'stale' "
    "WHEN (was, transition) NOT IN (('Quoted', 'place'), ('Picking', 'ship'), ('Shipped', 'refuse'), ('Shipped', 'settle')) THEN 'unavailable' "
    "WHEN (transition = 'place' AND priority IS NULL) OR (transition = 'settle' AND totalPrice >= 400000) THEN 'guard' ELSE 'fired' END AS status FROM ("
    "SELECT id, k, n + 1 AS n, live, state AS was, version, priority, totalPrice, ['place', 'ship', 'refuse', 'settle'][(k + n) % 4 + 1] AS transition FROM ch WHERE n < 3) x) y)"
)


@query("fire_sequence", "SELECT k * 10 + n AS command_id, id, transition, status, CASE WHEN status = 'fired' THEN version END AS version FROM ch WHERE n > 0", _CHAIN)
def fire_sequence(s: DemoStore) -> DataFrame:
    out = L.fire_sequence(s.scan("Order"), chained_commands(s), ORDER_MACHINE)
    return out.select("command_id", "id", "transition", "status", F.when(F.col("status") == "fired", F.col("version")).alias("version"))


def account_commands(s: DemoStore) -> DataFrame:
    e = events(s.spark, s.sf_dir)
    return e.select(
        keyed_id(TYPE_NO["Account"], F.col("user_id")).alias("id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("command"), "value"
    )


_FOLD = (
    "ev AS (SELECT user_id, event_id, ts, event_type AS c, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), "
    "fold AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS was, 'Visitor' AS state FROM (SELECT DISTINCT user_id FROM events) "
    "UNION ALL SELECT f.user_id, e.rn, e.event_id, f.state, CASE WHEN f.state = 'Visitor' AND e.c = 'signup' THEN 'Member' WHEN f.state = 'Member' AND e.c = 'purchase' AND e.value < 100 THEN 'Buyer' "
    "WHEN f.state = 'Buyer' AND e.c = 'view' THEN 'Member' WHEN f.state = 'Buyer' AND e.c = 'error' THEN 'Blocked' "
    "WHEN f.state = 'Blocked' AND e.c = 'click' THEN 'Member' ELSE f.state END FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1), "
    "done AS (SELECT f.user_id, f.rn, f.event_id, f.was, f.state, e.ts, e.c, '00000000-0000-4000-8009-' || lpad(lower(to_hex(f.user_id)), 12, '0') AS id FROM fold f JOIN ev e ON e.event_id = f.event_id)"
)


def history(s: DemoStore) -> DataFrame:
    return L.fold(account_commands(s), ACCOUNT_MACHINE)


@query("lifecycle_fold", "SELECT id, event_id AS seq, was AS from_state, state AS to_state, was <> state AS fired FROM done", _FOLD)
def lifecycle_fold(s: DemoStore) -> DataFrame:
    return history(s).select("id", "seq", "from_state", "to_state", "fired")


@query(
    "lifecycle_state",
    "SELECT id, arg_max(state, rn) AS state, count(*) AS commands, sum(CASE WHEN was <> state THEN 1 ELSE 0 END)::BIGINT AS fired FROM done GROUP BY id",
    _FOLD,
)
def lifecycle_state(s: DemoStore) -> DataFrame:
    return history(s).groupBy("id").agg(
        F.max_by("to_state", F.struct("ts", "seq")).alias("state"), F.count("*").alias("commands"), F.sum(F.col("fired").cast("long")).alias("fired")
    )


@query("transition_log", "SELECT id, event_id AS seq, c AS transition, was AS from_state, state AS to_state FROM done WHERE was <> state", _FOLD)
def transition_log(s: DemoStore) -> DataFrame:
    return L.transition_log(history(s)).select("id", "seq", F.col("command").alias("transition"), "from_state", "to_state")


AS_OF = "2024-01-29 00:00:00"


@query(
    "timer_due",
    "SELECT id || '|Blocked|lapse' AS timer_key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS entered, strftime(ts + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS due FROM "
    "(SELECT id, ts, state, lead(ts) OVER (PARTITION BY id ORDER BY rn) AS nxt FROM done WHERE was <> state) "
    f"WHERE state = 'Blocked' AND (nxt IS NULL OR nxt > ts + INTERVAL 36 HOUR) AND ts + INTERVAL 36 HOUR <= TIMESTAMP '{AS_OF}'",
    _FOLD,
)
def timer_due(s: DemoStore) -> DataFrame:
    due = L.timers_due(history(s), ACCOUNT_MACHINE, F.lit(AS_OF).cast("timestamp"))
    return due.select("timer_key", stamp("entered_at", "entered"), stamp("due_at", "due"))


def line_changes(s: DemoStore) -> DataFrame:
    """Every line item as a change: two thirds written, one third deleted."""
    image = F.struct("order")
    gone = F.col("lineStatus") == "F"
    rows = s.scan("LineItem", include_deleted=True)
    return rows.select("id", "type", image.alias("before"), F.when(~gone, image).alias("after"))


@query(
    "watch_candidates",
    "SELECT DISTINCT \"order\" AS id FROM v_lineitem WHERE tenant = 'default' UNION SELECT id FROM v_lineitem WHERE tenant = 'default' AND lineStatus <> 'F'",
)
def watch_candidates(s: DemoStore) -> DataFrame:
    return L.watch_candidates(s, line_changes(s), ORDER_MACHINE)


@query(
    "onchange_fire",
    "SELECT id, CASE WHEN openLineCount = 0 THEN 'lastLineGone' ELSE 'oneLineLeft' END AS transition, CASE WHEN openLineCount = 0 THEN 'Shipped' ELSE 'Partial' END AS to_state, CAST(2 AS BIGINT) AS version "
    "FROM l_order WHERE state = 'Picking' AND openLineCount IN (0, 1) AND id IN (SELECT \"order\" FROM v_lineitem WHERE tenant = 'default')",
)
def onchange_fire(s: DemoStore) -> DataFrame:
    candidates = L.watch_candidates(s, line_changes(s), ORDER_MACHINE)
    return L.fire_on_change(s.scan("Order"), candidates, ORDER_MACHINE, F.current_timestamp()).select("id", "transition", "to_state", "version")


def order_signals(s: DemoStore) -> DataFrame:
    k = _key()
    return s.scan("Order", include_deleted=True).select(
        k.alias("signal_id"), "id", F.when(k % 3 == 0, F.lit("refund")).otherwise(F.lit("complaint")).alias("signal"), F.lit("2024-07-01").cast("timestamp").alias("at")
    )


@query(
    "signal_fire",
    "SELECT id, 'fired' AS outcome FROM l_order WHERE state = 'Settled' AND o_orderkey % 3 <> 0 UNION ALL SELECT id, 'unknown' FROM v_order WHERE tenant = 'default' AND o_orderkey % 3 = 0",
)
def signal_fire(s: DemoStore) -> DataFrame:
    fired, unknown = L.fire_signals(s.scan("Order"), order_signals(s), ORDER_MACHINE)
    return fired.select("id", F.lit("fired").alias("outcome")).unionByName(unknown.select("id", F.lit("unknown").alias("outcome")))


def fired_orders(s: DemoStore) -> DataFrame:
    decided = L.fire(s.scan("Order"), order_commands(s), ORDER_MACHINE)
    return decided.where(F.col("status") == "fired").drop("status", "command_id")


_FIRED = _COMMANDS + ", f AS (SELECT o.*, w.transition FROM l_order o JOIN (SELECT id, arg_min(transition, n) AS transition FROM j WHERE st = 'fired' GROUP BY id) w ON w.id = o.id)"


@query(
    "transition_events",
    "SELECT id AS object_id, 'TransitionFired' AS kind, transition AS name FROM f UNION ALL "
    "SELECT f.id, 'ActionRequest', a.name FROM f JOIN (VALUES ('place', '0:create_object'), ('place', '1:webhook'), ('ship', '0:set_property'), ('refuse', '0:log')) AS a(t, name) ON a.t = f.transition "
    "UNION ALL SELECT id, 'TimerScheduled', 'settleUnanswered' FROM f WHERE transition = 'ship' UNION ALL SELECT id, 'TimerCancelled', 'settleUnanswered' FROM f WHERE transition IN ('refuse', 'settle')",
    _FIRED,
)
def transition_events(s: DemoStore) -> DataFrame:
    return L.events(fired_orders(s), ORDER_MACHINE).select("object_id", "kind", "name")


@query(
    "action_set_property",
    "SELECT id, 'priority' AS property, priority AS old, '0-SENT' AS new FROM f WHERE transition = 'ship' AND priority IS DISTINCT FROM '0-SENT'",
    _FIRED,
)
def action_set_property(s: DemoStore) -> DataFrame:
    return L.set_properties(s, s.scan("Order"), fired_orders(s), ORDER_MACHINE)


@query(
    "action_create_object",
    "SELECT 'Pick list, status ' || status AS text, 'en' AS lang, CAST(1 AS BIGINT) AS version, tenant, state_is_null FROM (SELECT *, true AS state_is_null FROM f) WHERE transition = 'place'",
    _FIRED,
)
def action_create_object(s: DemoStore) -> DataFrame:
    fired = fired_orders(s)
    new = L.create_objects(s, fired, ORDER_MACHINE, F.concat_ws("/", "id", F.col("version").cast("string")))["Document"]
    return new.select("text", "lang", "version", "tenant", F.col("state").isNull().alias("state_is_null"))


@query(
    "render_message",
    "SELECT id, 'webhook' AS kind, 'PUT' AS method, 'https://stock.example/pick/' || id AS url, coalesce(priority, '') || ' ' || status AS text FROM f WHERE transition = 'place' "
    "UNION ALL SELECT id, 'log', NULL, NULL, 'refused: ' || id || ', priority ' || coalesce(priority, '') FROM f WHERE transition = 'refuse'",
    _FIRED,
)
def render_message(s: DemoStore) -> DataFrame:
    return L.messages(fired_orders(s), ORDER_MACHINE).drop("version")


_MD5 = "md5('e-' || event_id || ':' || event_id % 3)"


@query(
    "derived_id",
    f"SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || "
    "substr('89ab89ab89ab89ab', CAST(strpos('0123456789abcdef', substr(h, 17, 1)) AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id "
    f"FROM (SELECT event_id, {_MD5} AS h FROM events)",
)
def derived_ids(s: DemoStore) -> DataFrame:
    e = events(s.spark, s.sf_dir)
    return e.select("event_id", derived_id(F.concat(F.lit("e-"), F.col("event_id")), F.col("event_id") % 3).alias("id"))


@query(
    "type_closure",
    "SELECT DISTINCT src, dst FROM walk",
    "walk AS (SELECT id AS src, partOf AS dst FROM l_part WHERE partOf IS NOT NULL UNION SELECT w.src, p.partOf FROM walk w JOIN l_part p ON p.id = w.dst WHERE p.partOf IS NOT NULL)",
)
def type_closure(s: DemoStore) -> DataFrame:
    """Everything a part belongs to, directly or not."""
    return closure(edges(s, "Part", "partOf"))


@query(
    "reach_from",
    "SELECT DISTINCT src, dst FROM walk",
    "walk AS (SELECT id AS src, partOf AS dst FROM l_part WHERE partOf IS NOT NULL AND brand = 'Brand#7' UNION SELECT w.src, p.partOf FROM walk w JOIN l_part p ON p.id = w.dst WHERE p.partOf IS NOT NULL)",
)
def reach_from(s: DemoStore) -> DataFrame:
    """What the parts of one brand belong to, directly or not."""
    return reachable(edges(s, "Part", "partOf"), s.scan("Part").where(F.col("brand") == "Brand#7"))
