"""Filters: every operator through the checked browse request, over whole types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.browse import BrowseSpec, matching, resolve
from .demo import DemoStore
from .registry import query

ORDER_COLS = ("id", "status", "priority")


def _orders(s: DemoStore, *filters: tuple) -> DataFrame:
    rows = matching(s, resolve(s.schema, BrowseSpec(("Order",), filters)))
    return rows.select(*ORDER_COLS, F.col("totalPrice").cast("double").alias("total"), F.col("orderDate").cast("string").alias("day"))


def _sql(where: str) -> str:
    return f"SELECT id, status, priority, CAST(totalPrice AS DOUBLE) AS total, CAST(orderDate AS VARCHAR) AS day FROM l_order WHERE {where}"


_CUSTOMER_7 = "00000000-0000-4000-8003-000000000007"

_CASES = {
    "filter_eq": ((("status", "eq", "O"),), "status = 'O'"),
    "filter_ref_eq": ((("customer", "eq", _CUSTOMER_7.upper()),), f"customer = '{_CUSTOMER_7}'"),
    "filter_ne": ((("priority", "ne", "5-LOW"),), "priority IS DISTINCT FROM '5-LOW'"),
    "filter_in": ((("priority", "in", "1-URGENT, 2-HIGH"),), "priority IN ('1-URGENT', '2-HIGH')"),
    "filter_range": ((("orderDate", "gte", "1996-01-01"), ("orderDate", "lt", "1997-01-01")), "orderDate >= DATE '1996-01-01' AND orderDate < DATE '1997-01-01'"),
    "filter_numeric": ((("totalPrice", "gt", "100000"), ("totalPrice", "lte", "250000.5")), "totalPrice > 100000 AND totalPrice <= 250000.5"),
    "filter_contains": ((("priority", "contains", "URG"),), "contains(lower(priority), 'urg')"),
    "filter_startswith": ((("priority", "startsWith", "2-hi"),), "starts_with(lower(priority), '2-hi')"),
    "filter_nulls": ((("priority", "isNull"), ("customer", "notNull")), "priority IS NULL AND customer IS NOT NULL"),
    "filter_conjunction": (
        (("status", "ne", "F"), ("priority", "notNull"), ("totalPrice", "gte", "50000"), ("totalPrice", "lt", "300000"), ("orderDate", "gt", "1995-06-30")),
        "status IS DISTINCT FROM 'F' AND priority IS NOT NULL AND totalPrice >= 50000 AND totalPrice < 300000 AND orderDate > DATE '1995-06-30'",
    ),
}

for _name, (_filters, _where) in _CASES.items():
    query(_name, _sql(_where))(lambda s, f=_filters: _orders(s, *f))


@query("filter_in_table", "SELECT id, customer FROM l_order WHERE customer IN (SELECT customer FROM v_order WHERE status = 'P' AND totalPrice > 400000)")
def filter_in_table(s: DemoStore) -> DataFrame:
    """IN over values held in a table rather than a list: a semi-join."""
    wanted = s.table("Order").where((F.col("status") == "P") & (F.col("totalPrice") > 400000)).select("customer").distinct()
    return s.scan("Order").join(wanted, "customer", "left_semi").select("id", "customer")


_LONG = [f"{k}.000" if k % 2 == 0 else f"{k}.005" for k in range(1, 1601)]


@query("filter_in_long", "SELECT \"order\", part, CAST(quantity AS DOUBLE) AS quantity FROM l_lineitem WHERE quantity % 2 = 0")
def filter_in_long(s: DemoStore) -> DataFrame:
    """1600 decimals of three places: those that end in zeros equal a quantity, the others none."""
    rows = matching(s, resolve(s.schema, BrowseSpec(("LineItem",), (("quantity", "in", _LONG),))))
    return rows.select("order", "part", F.col("quantity").cast("double").alias("quantity"))
