"""Streaming queries over the given tables read as feeds; each must equal its batch twin."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import keyed_id
from ..model import Schema
from ..operators.rollup import affected_targets, recompute
from ..session import fresh_path
from ..sources.store import SEARCH_TEXT
from ..streaming import streams as S
from ..streaming.histories import HistoryKeeper
from ..streaming.lifecycle import lifecycle_stream
from ..streaming.maintain import Maintainer
from .demo import ACCOUNT_MACHINE, BASE, TYPE_LOADERS, TYPE_NO, TYPES, DemoStore, ref
from .q_lifecycle import _FOLD
from .q_read import stamp
from .registry import query


def feed(s: DemoStore, table: str) -> DataFrame:
    """A given table as a stream. The bracket makes the path a pattern, which is needed where the
    table is one file, and equally finds a folder of files."""
    schema = s.spark.read.parquet(f"{s.sf_dir}/{table}.parquet").schema
    return S.read_feed(s.spark, f"{s.sf_dir}/[{table[0]}]{table[1:]}.parquet", schema)


def _commands(s: DemoStore) -> DataFrame:
    return feed(s, "events").select(
        keyed_id(TYPE_NO["Account"], F.col("user_id")).alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("command"),
        "value",
    )


@query("stream_dedupe", "SELECT event_id, event_type, CAST(value AS DOUBLE) AS value FROM events")
def stream_dedupe(s: DemoStore) -> DataFrame:
    """Every entry is delivered twice."""
    twice = F.explode(F.array(F.lit(1), F.lit(2)))
    doubled = feed(s, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", twice.alias("delivery"))
    path = fresh_path(s.spark, "dedupe")
    S.run_batches(doubled, "dedupe", S.once_each(path, "event_id"))
    return s.spark.read.parquet(f"{path}/entries").select("event_id", "event_type", "value")


@query("stream_late", "SELECT event_id, event_type, CAST(value AS DOUBLE) AS value FROM events")
def stream_late(s: DemoStore) -> DataFrame:
    """Three micro-batches: the late half of the time first, then all entries, then the early half again."""
    events = s.spark.read.parquet(f"{s.sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "event_type", "value", "ts")
    late = F.dayofmonth("ts") > 15
    feed_path, path = fresh_path(s.spark, "late-feed"), fresh_path(s.spark, "late")
    files = s.spark.sparkContext.defaultParallelism  # of each part, so that a micro-batch is one part
    for part in (events.where(late), events, events.where(~late)):
        part.repartition(files).write.mode("append").parquet(feed_path)
    S.run_batches(S.read_feed(s.spark, feed_path, events.schema, files), "late", S.once_each(path, "event_id"))
    return s.spark.read.parquet(f"{path}/entries").select("event_id", "event_type", "value")


@query("stream_lifecycle", "SELECT id, event_id AS seq, c AS transition, was AS from_state, state AS to_state FROM done WHERE was <> state", _FOLD)
def stream_lifecycle(s: DemoStore) -> DataFrame:
    fired = S.run_to_table(lifecycle_stream(_commands(s), ACCOUNT_MACHINE), "lifecycle")
    return fired.select("id", "seq", "transition", "from_state", "to_state")


_TIMED = (
    "ev AS (SELECT user_id, event_id, ts, event_type AS c, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), "
    "tf AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS ran_out, 'Visitor' AS met, 'Visitor' AS state, CAST(NULL AS TIMESTAMP) AS entered FROM (SELECT DISTINCT user_id FROM events) "
    "UNION ALL SELECT user_id, rn, ran_out, met, state, CASE WHEN state <> met THEN ts WHEN ran_out IS NOT NULL THEN ran_out ELSE entered END FROM ("
    "SELECT x.*, CASE WHEN met = 'Visitor' AND c = 'signup' THEN 'Member' WHEN met = 'Member' AND c = 'purchase' AND value < 100 THEN 'Buyer' WHEN met = 'Buyer' AND c = 'view' THEN 'Member' "
    "WHEN met = 'Buyer' AND c = 'error' THEN 'Blocked' WHEN met = 'Blocked' AND c = 'click' THEN 'Member' ELSE met END AS state FROM ("
    "SELECT f.user_id, e.rn, e.ts, e.c, e.value, f.entered, CASE WHEN f.state = 'Blocked' AND e.ts > f.entered + INTERVAL 36 HOUR THEN f.entered + INTERVAL 36 HOUR END AS ran_out, "
    "CASE WHEN f.state = 'Blocked' AND e.ts > f.entered + INTERVAL 36 HOUR THEN 'Visitor' ELSE f.state END AS met FROM tf f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1) x)), "
    "due AS (SELECT user_id, ran_out AS due FROM tf WHERE ran_out IS NOT NULL UNION ALL SELECT user_id, entered + INTERVAL 36 HOUR FROM "
    "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS back FROM tf) WHERE back = 1 AND state = 'Blocked' AND entered + INTERVAL 36 HOUR <= (SELECT max(ts) FROM events))"
)


@query(
    "stream_timers",
    "SELECT '00000000-0000-4000-8009-' || lpad(lower(to_hex(user_id)), 12, '0') AS id, 'Blocked' AS from_state, 'Visitor' AS to_state, strftime(due, '%Y-%m-%d %H:%M:%S') AS due FROM due",
    _TIMED,
)
def stream_timers(s: DemoStore) -> DataFrame:
    """Timers that ran out, and moved their object on, by the end of the feed."""
    fired = S.run_to_table(lifecycle_stream(_commands(s), ACCOUNT_MACHINE, timed=True, delay="0 seconds"), "timers")
    return fired.where(F.col("transition") == "lapse").select("id", "from_state", "to_state", stamp("at", "due"))


@query(
    "stream_recompute",
    "SELECT id, old, new FROM (SELECT c.id, c.openOrderCount AS old, count(o.id) AS new FROM l_customer c LEFT JOIN "
    "(SELECT * FROM l_order WHERE status IS DISTINCT FROM 'F') o ON o.customer = c.id GROUP BY c.id, c.openOrderCount) "
    "WHERE old <> new AND id IN (SELECT customer FROM v_order)",
)
def stream_recompute(s: DemoStore) -> DataFrame:
    """Each order of the feed is a change; the customers it points at are refreshed."""
    path = fresh_path(s.spark, "recompute")
    rule = next(r for r in s.schema.rollups if r.property == "openOrderCount")

    def process(batch: DataFrame, batch_id: int) -> None:
        image = F.struct(F.col("customer"))
        changes = batch.select("type", F.lit(None).cast("struct<customer:string>").alias("before"), image.alias("after"))
        S.write_batch(recompute(s, affected_targets(s, changes, [rule]), rule), path, batch_id)

    orders = feed(s, "orders").select(F.lit(BASE + "Order").alias("type"), ref("Customer", "o_custkey").alias("customer"))
    S.run_batches(orders, "recompute", process)
    return s.spark.read.parquet(path).select("id", "old", "new")


# Orders after the three micro-batches: every fifth moves to the next customer, the one after it is gone, and of
# those that moved every second one moves back and costs more.
_MAINTAINED = (
    "ends AS (SELECT id, status, totalPrice + CASE WHEN o_orderkey % 10 = 1 THEN 5 ELSE 0 END AS price, customer AS was, "
    "CASE WHEN o_orderkey % 10 = 6 THEN '00000000-0000-4000-8003-' || lpad(lower(to_hex(CAST(('0x' || right(customer, 12))::BIGINT + 1 AS BIGINT))), 12, '0') ELSE customer END AS customer, "
    "'00000000-0000-4000-8003-' || lpad(lower(to_hex(CAST(('0x' || right(customer, 12))::BIGINT + 1 AS BIGINT))), 12, '0') AS over, "
    "o_orderkey % 5 AS part FROM l_order), "
    "hit AS (SELECT was AS id FROM ends WHERE part IN (1, 2) UNION SELECT over FROM ends WHERE part = 1), "
    "sums AS (SELECT customer AS id, count(*) FILTER (WHERE status IS DISTINCT FROM 'F') AS open, sum(price) AS total, min(price) AS least, max(price) AS most, count(*) AS n, "
    "CAST(sum(price) * 100 AS HUGEINT) AS cents FROM ends WHERE part <> 2 GROUP BY customer)"
)


@query(
    "stream_maintain",
    "SELECT c.id, CASE WHEN h.id IS NULL THEN c.openOrderCount ELSE coalesce(s.open, 0) END AS open_orders, "
    "CASE WHEN h.id IS NOT NULL THEN CAST(s.total AS DOUBLE) END AS total_spend, CASE WHEN h.id IS NOT NULL THEN CAST(s.least AS DOUBLE) END AS min_order, "
    "CASE WHEN h.id IS NOT NULL THEN CAST(s.most AS DOUBLE) END AS max_order, CASE WHEN h.id IS NOT NULL THEN CAST((2 * s.cents + s.n) // (2 * s.n) AS DOUBLE) / 100 END AS avg_order "
    "FROM l_customer c LEFT JOIN hit h ON h.id = c.id LEFT JOIN sums s ON s.id = c.id",
    _MAINTAINED,
)
def stream_maintain(s: DemoStore) -> DataFrame:
    """All rollups of customers kept in step with three micro-batches of change sets to orders."""
    schema = Schema(TYPES, tuple(replace(r, materialised=True) for r in s.schema.rollups if r.on_type == "Customer"))
    base = DemoStore(s.spark, schema, {n: (lambda n=n: s.table(n)) for n in ("Customer", "Order")}, s.tenant)
    orders = s.spark.read.parquet(f"{s.sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    live = TYPE_LOADERS["Order"](lambda _: orders).where((F.col("tenant") == s.tenant) & F.col("deleted_at").isNull()).select("id")
    home, next_door = ref("Customer", "o_custkey"), ref("Customer", F.col("o_custkey") + 1)
    price = F.col("o_totalprice").cast("decimal(18,2)")

    def changes(batch: int, op: str, version: int, customer: Column, total: Column) -> DataFrame:
        return orders.select(
            (key * 3 + batch).alias("changeset_id"),
            F.lit(0).alias("seq"),
            F.lit(op).alias("op"),
            ref("Order", "o_orderkey").alias("id"),
            F.lit(BASE + "Order").alias("type"),
            F.lit(version).cast("long").alias("expected_version"),
            F.lit(None).cast("string").alias("state"),
            F.lit("2024-07-01 00:00:00").cast("timestamp").alias("at"),
            F.lit("feed").alias("by"),
            F.col("o_orderstatus").alias("status"),
            total.cast("decimal(18,2)").alias("totalPrice"),
            customer.alias("customer"),
            key.alias("_key"),
        ).join(live, "id", "left_semi")

    parts = (
        changes(0, "update", 1, next_door, price).where("_key % 5 = 1"),
        changes(1, "delete", 1, home, price).where("_key % 5 = 2"),
        changes(2, "update", 2, home, price + 5).where("_key % 10 = 1"),
    )
    feed_path, root = fresh_path(s.spark, "maintain-feed"), fresh_path(s.spark, "maintain")
    files = s.spark.sparkContext.defaultParallelism  # of each part, so that a micro-batch is one part
    for part in parts:
        # Dealt out in turn rather than by a hash, so that each part has this many files.
        part.drop("_key").repartition(files).write.mode("append").parquet(feed_path)
    keeper = Maintainer(base, ("Order", "Customer"), root)
    S.run_batches(S.read_feed(s.spark, feed_path, s.spark.read.parquet(feed_path).schema, files), "maintain", keeper.process)
    return keeper.store().scan("Customer").select(
        "id",
        F.col("openOrderCount").alias("open_orders"),
        F.col("totalSpend").cast("double").alias("total_spend"),
        F.col("minOrder").cast("double").alias("min_order"),
        F.col("maxOrder").cast("double").alias("max_order"),
        F.col("avgOrder").cast("double").alias("avg_order"),
    )


def _documents(s: DemoStore) -> DataFrame:
    """The tenant's documents as a feed of whole objects."""
    return TYPE_LOADERS["Document"](lambda name: feed(s, name)).where(F.col("tenant") == s.tenant)


@query(
    "stream_search_index",
    "SELECT token, id, count(*) AS tf FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda z: z <> '')) AS token FROM l_document) GROUP BY token, id",
)
def stream_search_index(s: DemoStore) -> DataFrame:
    path = fresh_path(s.spark, "index")
    S.run_batches(_documents(s).withColumn(SEARCH_TEXT, F.col("text")), "index", S.maintain_index(path))
    return S.read_maintained(s.spark, path).select("token", "id", "tf")


@query(
    "stream_index_rewrites",
    "SELECT token, id, count(*) AS tf FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(concat_ws(' ', source, lang, text)), '[^\\p{L}\\p{N}]+'), lambda z: z <> '')) AS token "
    "FROM v_document WHERE tenant = 'default' AND lang <> 'fr') GROUP BY token, id",
)
def stream_index_rewrites(s: DemoStore) -> DataFrame:
    """Each document comes twice in a micro-batch: as it is, then with source and language before its text, or deleted if it is French."""
    path = fresh_path(s.spark, "index")
    docs = _documents(s).withColumn("version", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    second = F.col("version") == 2
    rows = docs.select(
        "id",
        "version",
        F.when(second, F.concat_ws(" ", "source", "lang", "text")).otherwise(F.col("text")).alias(SEARCH_TEXT),
        F.when(second & (F.col("lang") == "fr"), F.lit("2024-06-01").cast("timestamp")).alias("deleted_at"),
    )
    S.run_batches(rows, "index", S.maintain_index(path))
    return S.read_maintained(s.spark, path).select("token", "id", "tf")


@query("stream_history", "SELECT id, event_id AS seq, c AS transition, was AS from_state, state AS to_state FROM done WHERE was <> state", _FOLD)
def stream_history(s: DemoStore) -> DataFrame:
    """The lifecycle again, folded batch by batch in chunks."""
    keeper = HistoryKeeper(s.spark, ACCOUNT_MACHINE, fresh_path(s.spark, "history"))
    S.run_batches(_commands(s), "history", keeper.process)
    log = s.spark.read.parquet(f"{keeper.root}/log")
    return log.select("id", "seq", F.col("command").alias("transition"), "from_state", "to_state")
