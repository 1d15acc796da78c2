"""Sorting, paging, facets and the whole browse request."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.browse import (
    BrowseSpec,
    browse,
    facets,
    label_join,
    matching,
    page,
    page_after,
    resolve,
    total,
)
from ..operators.rollup import read_derived
from .demo import DemoStore
from .registry import query


def _page(s: DemoStore, spec: BrowseSpec, *cols: str) -> DataFrame:
    """One page with the position of every row in it; a page holds at most 500 rows."""
    q = resolve(s.schema, spec)
    rows = page(matching(s, q), q).select(*cols, F.monotonically_increasing_id().alias("_at"))
    return rows.withColumn("pos", F.row_number().over(Window.orderBy("_at")).cast("long")).drop("_at")


def _page_sql(cols: str, frm: str, order: str, size: int, number: int = 0) -> str:
    return (
        f"SELECT {cols}, row_number() OVER (ORDER BY {order}) - {number * size} AS pos FROM {frm} "
        f"ORDER BY {order} LIMIT {size} OFFSET {number * size}"
    )


@query("sort_multi", _page_sql("id, status", "l_order", "status ASC NULLS LAST, totalPrice DESC NULLS FIRST, id", 100))
def sort_multi(s: DemoStore) -> DataFrame:
    return _page(s, BrowseSpec(("Order",), sort=("status", "-totalPrice"), size=100), "id", "status")


@query("sort_nulls", _page_sql("id, priority", "l_order", "priority DESC NULLS FIRST, id", 500))
def sort_nulls(s: DemoStore) -> DataFrame:
    return _page(s, BrowseSpec(("Order",), sort=("-priority",), size=500), "id", "priority")


@query("sort_reference", _page_sql("id, customer", "l_order", "customer ASC NULLS LAST, id", 200))
def sort_reference(s: DemoStore) -> DataFrame:
    return _page(s, BrowseSpec(("Order",), sort=("customer",), size=200), "id", "customer")


@query("page_default", _page_sql("id", "l_order", "created_at, id", 50))
def page_default(s: DemoStore) -> DataFrame:
    return _page(s, BrowseSpec(("Order",)), "id")


@query("page_n", _page_sql("id, status", "l_order", "totalPrice ASC NULLS LAST, id", 40, 3))
def page_n(s: DemoStore) -> DataFrame:
    return _page(s, BrowseSpec(("Order",), sort=("totalPrice",), size=40, page=3), "id", "status")


_OVERRUN = BrowseSpec(("Order",), (("status", "eq", "P"),), size=500, page=4_000_000)


@query(
    "page_overrun",
    "SELECT (SELECT count(*) FROM l_order WHERE status = 'P') AS total, "
    "(SELECT count(*) FROM (SELECT id FROM l_order WHERE status = 'P' ORDER BY id LIMIT 500 OFFSET 2000000000)) AS items",
)
def page_overrun(s: DemoStore) -> DataFrame:
    q = resolve(s.schema, _OVERRUN)
    rows = matching(s, q)
    counts = [rows.agg(F.count("*").alias("n"), F.lit("total").alias("k")), page(rows, q).agg(F.count("*").alias("n"), F.lit("items").alias("k"))]
    both = counts[0].unionByName(counts[1])
    return both.agg(F.sum(F.when(F.col("k") == "total", F.col("n"))).alias("total"), F.sum(F.when(F.col("k") == "items", F.col("n"))).alias("items"))


@query("browse_total", "SELECT count(*) AS total, CAST(ceil(count(*) / 40.0) AS BIGINT) AS pages FROM l_order WHERE status IS DISTINCT FROM 'F'")
def browse_total(s: DemoStore) -> DataFrame:
    q = resolve(s.schema, BrowseSpec(("Order",), (("status", "ne", "F"),), size=40))
    return total(matching(s, q), 40)


@query(
    "ref_label",
    "SELECT o.id, c.name AS label FROM (SELECT * FROM v_order WHERE tenant = 'default') o JOIN l_customer c ON o.customer = c.id",
)
def ref_label(s: DemoStore) -> DataFrame:
    rows = s.scan("Order", include_deleted=True).select("id", "customer")
    return label_join(s, rows, s.schema.lookup("Order", "customer")).select("id", "label")


def _facets(s: DemoStore, *names: str, filters: tuple = (), text: str | None = None, types: tuple[str, ...] = ("Order",)) -> DataFrame:
    return facets(s, resolve(s.schema, BrowseSpec(types, filters, text=text, facets=names)))


@query(
    "facet_scalar",
    "SELECT 'priority' AS facet, priority AS value, count(*) AS n FROM l_order WHERE status IS DISTINCT FROM 'F' AND priority IS NOT NULL GROUP BY priority",
)
def facet_scalar(s: DemoStore) -> DataFrame:
    return _facets(s, "priority", filters=(("status", "ne", "F"),))


@query(
    "facet_multiselect",
    "SELECT 'status' AS facet, status AS value, count(*) AS n FROM l_order WHERE totalPrice > 90000 AND status IS NOT NULL GROUP BY status",
)
def facet_multiselect(s: DemoStore) -> DataFrame:
    """The facet's own selection does not reduce its counts."""
    return _facets(s, "status", filters=(("status", "in", "O,P"), ("totalPrice", "gt", "90000")))


@query(
    "facet_reference",
    "SELECT 'customer' AS facet, c.name AS value, count(*) AS n FROM l_order o JOIN l_customer c ON o.customer = c.id WHERE o.status = 'O' GROUP BY c.name",
)
def facet_reference(s: DemoStore) -> DataFrame:
    return _facets(s, "customer", filters=(("status", "eq", "O"),))


_F = "FROM l_order WHERE totalPrice > 50000"
_FACETS_SQL = (
    f"SELECT 'status' AS facet, status AS value, count(*) AS n {_F} AND priority IN ('1-URGENT', '5-LOW') AND status IS NOT NULL GROUP BY status "
    f"UNION ALL SELECT 'priority', priority, count(*) {_F} AND status IN ('O', 'F') AND priority IS NOT NULL GROUP BY priority "
    f"UNION ALL SELECT 'customer', c.name, count(*) FROM l_order o JOIN l_customer c ON o.customer = c.id WHERE o.totalPrice > 50000 AND o.status IN ('O', 'F') "
    "AND o.priority IN ('1-URGENT', '5-LOW') GROUP BY c.name"
)
_FACET_FILTERS = (("totalPrice", "gt", "50000"), ("status", "in", "O,F"), ("priority", "in", "1-URGENT,5-LOW"))


@query("facets_all", _FACETS_SQL)
def facets_all(s: DemoStore) -> DataFrame:
    return _facets(s, "status", "priority", "customer", filters=_FACET_FILTERS)


@query(
    "facet_union_types",
    "SELECT 'nation' AS facet, n.name AS value, count(*) AS n FROM (SELECT nation FROM l_customer UNION ALL SELECT nation FROM l_supplier) p "
    "JOIN l_nation n ON p.nation = n.id GROUP BY n.name UNION ALL SELECT 'segment', segment, count(*) FROM l_customer WHERE segment IS NOT NULL GROUP BY segment",
)
def facet_union_types(s: DemoStore) -> DataFrame:
    return _facets(s, "nation", "segment", types=("Party",))


FULL = BrowseSpec(("Order",), (("status", "ne", "F"),), sort=("-totalPrice",), size=50, facets=("priority", "customer"))


def as_rows(result, size: int) -> DataFrame:
    """A whole browse answer as one table: page items with their position, totals, facet counts."""
    at = F.row_number().over(Window.orderBy("_at"))
    items = result.items.select("id", F.monotonically_increasing_id().alias("_at")).select(
        F.lit("item").alias("section"), F.lit("id").alias("name"), F.col("id").alias("value"), at.cast("long").alias("n")
    )
    totals = result.total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in ("total", "pages")])).alias("t"))
    totals = totals.select(F.lit("total").alias("section"), "t.name", F.lit("").alias("value"), "t.n")
    counts = result.facets.select(F.lit("facet").alias("section"), F.col("facet").alias("name"), "value", "n")
    return reduce(lambda a, b: a.unionByName(b), [items, totals, counts])


_FULL_SQL = (
    "SELECT 'item' AS section, 'id' AS name, id AS value, n FROM (SELECT id, row_number() OVER (ORDER BY totalPrice DESC NULLS FIRST, id) AS n "
    "FROM l_order WHERE status IS DISTINCT FROM 'F') WHERE n <= 50 "
    "UNION ALL SELECT 'total', 'total', '', count(*) FROM l_order WHERE status IS DISTINCT FROM 'F' "
    "UNION ALL SELECT 'total', 'pages', '', CAST(ceil(count(*) / 50.0) AS BIGINT) FROM l_order WHERE status IS DISTINCT FROM 'F' "
    "UNION ALL SELECT 'facet', 'priority', priority, count(*) FROM l_order WHERE status IS DISTINCT FROM 'F' AND priority IS NOT NULL GROUP BY priority "
    "UNION ALL SELECT 'facet', 'customer', c.name, count(*) FROM l_order o JOIN l_customer c ON o.customer = c.id WHERE o.status IS DISTINCT FROM 'F' GROUP BY c.name"
)


@query("browse_full", _FULL_SQL)
def browse_full(s: DemoStore) -> DataFrame:
    result = browse(s, FULL)
    # The union is a set of sections, so the order of the counts is not needed here.
    unordered = type(result)(result.items, result.total, facets(s, resolve(s.schema, FULL)))
    return as_rows(unordered, FULL.size)


@query(
    "browse_derived",
    "SELECT c.id, count(o.id) FILTER (o.status IS DISTINCT FROM 'F') AS openOrderCount, CAST(sum(o.totalPrice) AS DOUBLE) AS totalSpend, row_number() OVER (ORDER BY c.name, c.id) AS pos "
    "FROM l_customer c LEFT JOIN l_order o ON o.customer = c.id GROUP BY c.id, c.name ORDER BY c.name, c.id LIMIT 100",
)
def browse_derived(s: DemoStore) -> DataFrame:
    """Stored copies of derived values are stale here: the page shows fresh ones."""
    items = browse(s, BrowseSpec(("Customer",), sort=("name",), size=100)).items
    rows = items.select("id", "openOrderCount", F.col("totalSpend").cast("double").alias("totalSpend"), F.monotonically_increasing_id().alias("_at"))
    return rows.withColumn("pos", F.row_number().over(Window.orderBy("_at")).cast("long")).drop("_at")


@query(
    "read_derived",
    "SELECT c.id, count(o.id) FILTER (o.status IS DISTINCT FROM 'F') AS openOrderCount, CAST(sum(o.totalPrice) AS DOUBLE) AS totalSpend "
    "FROM l_customer c LEFT JOIN l_order o ON o.customer = c.id WHERE c.id IN (SELECT customer FROM v_order WHERE status = 'P') GROUP BY c.id",
)
def read_customers(s: DemoStore) -> DataFrame:
    wanted = s.table("Order").where(F.col("status") == "P").select(F.col("customer").alias("id")).distinct()
    return read_derived(s, wanted, "Customer").select("id", "openOrderCount", F.col("totalSpend").cast("double").alias("totalSpend"))


@query(
    "page_after",
    "SELECT id, status FROM l_order WHERE totalPrice > 100000 ORDER BY totalPrice, id LIMIT 200",
)
def orders_after(s: DemoStore) -> DataFrame:
    """The page behind a known row, without counting the rows before it."""
    q = resolve(s.schema, BrowseSpec(("Order",), sort=("totalPrice",), size=200))
    return page_after(matching(s, q), q, {"totalPrice": "100000.00", "id": "~"}).select("id", "status")
