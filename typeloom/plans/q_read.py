"""Scans, reads and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import keyed_id
from ..functions.names import lexical, short_name
from ..functions.text import searchable_text
from ..sources import changelog, versions
from .demo import BASE, TYPE_NO, DemoStore
from .registry import query


def stamp(name: str, alias: str | None = None):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(alias or name)


@query("scan_scoped", "SELECT id, type, CAST(acctbal AS DOUBLE) AS acctbal FROM l_customer UNION ALL SELECT id, type, CAST(acctbal AS DOUBLE) FROM l_supplier")
def scan_scoped(s: DemoStore) -> DataFrame:
    return s.scan("Party").select("id", "type", F.col("acctbal").cast("double").alias("acctbal"))


@query(
    "scan_include_deleted",
    "SELECT id, status, deleted_at IS NOT NULL AS deleted FROM v_order WHERE tenant = 'default'",
)
def scan_include_deleted(s: DemoStore) -> DataFrame:
    return s.scan("Order", include_deleted=True).select("id", "status", F.col("deleted_at").isNotNull().alias("deleted"))


@query(
    "union_types",
    "SELECT type, count(*) AS n, count(segment) AS n_segment FROM (SELECT type, segment FROM l_customer UNION ALL "
    "SELECT type, NULL FROM l_supplier UNION ALL SELECT type, NULL FROM l_nation UNION ALL SELECT type, NULL FROM l_region) GROUP BY type",
)
def union_types(s: DemoStore) -> DataFrame:
    return s.scan("Party", "Place").groupBy("type").agg(F.count("*").alias("n"), F.count("segment").alias("n_segment"))


def _asked(s: DemoStore) -> DataFrame:
    """Ids taken from the orders' customers, shifted so that some of them do not exist."""
    key = F.col("o_custkey") + F.col("o_orderkey") % 2 * 700
    orders = s.spark.read.parquet(f"{s.sf_dir}/orders.parquet")
    return orders.select(keyed_id(TYPE_NO["Customer"], key).alias("id")).distinct()


_ASKED = (
    "asked AS (SELECT DISTINCT '00000000-0000-4000-8003-' || lpad(lower(to_hex(CAST(o_custkey + o_orderkey % 2 * 700 AS BIGINT))), 12, '0') AS id FROM orders)"
)


@query("read_by_ids", "SELECT id, name, segment FROM l_customer WHERE id IN (SELECT id FROM asked)", _ASKED)
def read_by_ids(s: DemoStore) -> DataFrame:
    return s.read_many(_asked(s), "Customer", columns=["id", "name", "segment"])


@query(
    "types_of",
    "SELECT id, type FROM (SELECT id, type FROM l_customer UNION ALL SELECT id, type FROM l_part UNION ALL SELECT id, type FROM l_order) WHERE id IN (SELECT id FROM asked) "
    "OR substr(id, 21, 3) = '005' OR substr(id, 21, 3) = '006'",
    _ASKED,
)
def types_of(s: DemoStore) -> DataFrame:
    """Ids of customers, parts and orders, looked up among all types."""
    some = s.table("Part").select("id").unionByName(s.table("Order").select("id"))
    return s.types_of(_asked(s).unionByName(some))


@query(
    "read_typed",
    "SELECT id, requested, type FROM (SELECT id, type, unnest(['Party', 'Customer', 'Supplier']) AS requested FROM l_customer) WHERE requested <> 'Supplier' "
    "UNION ALL SELECT id, requested, type FROM (SELECT id, type, unnest(['Party', 'Customer', 'Supplier']) AS requested FROM l_supplier) WHERE requested <> 'Customer'",
)
def read_typed(s: DemoStore) -> DataFrame:
    parties = s.scan("Party").select("id")
    wanted = F.explode(F.array(F.lit("Party"), F.lit("Customer"), F.lit("Supplier")))
    return s.read_typed(parties.select("id", wanted.alias("requested")), "Party")


@query(
    "object_view",
    "SELECT id, tenant, type, version, state, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, deleted_at IS NOT NULL AS deleted, "
    "name, brand, kind, CAST(size AS DOUBLE) AS size, CAST(retailPrice AS DOUBLE) AS price, array_to_string(keywords, '|') AS keywords FROM v_part WHERE tenant = 'default'",
)
def object_view(s: DemoStore) -> DataFrame:
    return s.view("Part", include_deleted=True).select(
        "id", "tenant", "type", "version", "state", stamp("created_at", "created"), "deleted", "name", "brand", "kind",
        F.col("size").cast("double").alias("size"), F.col("retailPrice").cast("double").alias("price"),
        F.array_join("keywords", "|").alias("keywords"),
    )


@query(
    "short_name",
    "SELECT page_id, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#([^#]*)$', 1) ELSE regexp_extract(url, '([^/]*)$', 1) END AS short FROM pages",
)
def short_names(s: DemoStore) -> DataFrame:
    return s.spark.read.parquet(f"{s.sf_dir}/pages.parquet").select("page_id", short_name(F.col("url")).alias("short"))


@query(
    "lexical_text",
    "SELECT id, regexp_replace(CAST(totalPrice AS VARCHAR), '\\.?0+$', '') AS price, CAST(orderDate AS VARCHAR) AS day, "
    "strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created, customer FROM l_order",
)
def lexical_text(s: DemoStore) -> DataFrame:
    rows = s.scan("Order")
    kind = {f.name: f.dataType for f in rows.schema}

    def lex(c: str, alias: str):
        return lexical(F.col(c), kind[c]).alias(alias)

    return rows.select("id", lex("totalPrice", "price"), lex("orderDate", "day"), lex("created_at", "created"), "customer")


@query("search_text", "SELECT id, concat_ws(' ', name, array_to_string(keywords, ' ')) AS search_text FROM l_part")
def search_text(s: DemoStore) -> DataFrame:
    return s.scan("Part").select("id", searchable_text(s.schema.searchable("Part")).alias("search_text"))


@query(
    "latest_version",
    "SELECT user_id, version, event_type, CAST(value AS DOUBLE) AS value FROM (SELECT user_id, event_id AS version, event_type, value, "
    "row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def latest_version(s: DemoStore) -> DataFrame:
    """Every event taken as a version of its user."""
    rows = s.spark.read.parquet(f"{s.sf_dir}/events.parquet")
    return versions.latest(rows.select("user_id", F.col("event_id").alias("version"), "event_type", "value"), ["user_id"])


@query(
    "active_version",
    "SELECT tenant, version, text_id FROM (SELECT source AS tenant, doc_id AS version, lang AS text_id, "
    "row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents WHERE doc_id % 3 <> 0) WHERE rn = 1",
)
def active_version(s: DemoStore) -> DataFrame:
    """Documents taken as schema versions of the tenant named by their source; two thirds were activated."""
    docs = s.spark.read.parquet(f"{s.sf_dir}/documents.parquet").select(
        F.col("source").alias("tenant"), F.col("doc_id").alias("version"), F.col("lang").alias("text_id"), (F.col("doc_id") % 3 != 0).alias("active")
    )
    return versions.active_documents(docs).select("tenant", "version", "text_id")


# Which change event each event type of the given table stands for.
EVENT_KINDS = {
    "signup": "ObjectCreated",
    "click": "ObjectUpdated",
    "view": "SignalReceived",
    "purchase": "TransitionFired",
    "error": "TimerScheduled",
}


def event_log(s: DemoStore) -> DataFrame:
    """The given events in the shape of the change log."""
    e = s.spark.read.parquet(f"{s.sf_dir}/events.parquet")
    kind = F.create_map(*[F.lit(x) for kv in EVENT_KINDS.items() for x in kv])
    return e.select(
        F.concat(F.lit("e-"), F.col("event_id")).alias("entry_id"),
        F.lit("default").alias("tenant"),
        F.concat(F.lit("c-"), F.floor(F.col("event_id") / 10)).alias("changeset_id"),
        (F.col("event_id") % 10).cast("int").alias("seq"),
        F.element_at(kind, F.col("event_type")).alias("kind"),
        keyed_id(TYPE_NO["Account"], F.col("user_id")).alias("object_id"),
        F.lit(BASE + "Account").alias("type"),
        (F.col("event_id") + 1).alias("version"),
        F.lit(1).cast("long").alias("ontology_version"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        F.col("props").alias("payload"),
        "value",
    )


@query(
    "changelog_read",
    "SELECT 'e-' || event_id AS entry_id, CASE event_type WHEN 'signup' THEN 'ObjectCreated' ELSE 'ObjectUpdated' END AS kind, "
    "strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_type IN ('signup', 'click') AND event_id % 4 <> 1 "
    "AND NOT (event_id % 4 = 3 AND value > 50)",
)
def changelog_read(s: DemoStore) -> DataFrame:
    log = event_log(s)
    number = F.col("version") - 1
    done = log.where(number % 4 == 1).select("entry_id")
    parked = log.where((number % 4 == 3) & (F.col("value") > 50)).select("entry_id")
    rows = changelog.unprocessed(log, ("ObjectCreated", "ObjectUpdated"), done, parked)
    return rows.select("entry_id", "kind", stamp("occurred_at", "at"))


@query(
    "dead_letter",
    "SELECT 'o-' || user_id AS entry_id, fail_count, error, fail_count >= 3 AS parked FROM (SELECT user_id, count(*) AS fail_count, "
    "arg_max(props, (ts, event_id)) AS error FROM events WHERE event_type = 'error' GROUP BY user_id)",
)
def dead_letter(s: DemoStore) -> DataFrame:
    """Every error event taken as one failed dispatch of its user's entry."""
    e = s.spark.read.parquet(f"{s.sf_dir}/events.parquet").where(F.col("event_type") == "error")
    failures = e.select(
        F.concat(F.lit("o-"), F.col("user_id")).alias("entry_id"), F.struct("ts", "event_id").alias("attempted_at"), F.col("props").alias("error")
    )
    return changelog.park_failures(failures)
