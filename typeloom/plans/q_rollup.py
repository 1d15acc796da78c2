"""Rollups, batched derivation, plug-ins and maintained values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Rollup
from ..operators.browse import BrowseSpec, matching, order, page, resolve
from ..operators.rollup import affected_targets, derive, recompute, register_plugin, rollup
from .demo import DemoStore
from .registry import query


def _num(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.col(n).cast("double"))
    return df


def supplier_workload(ctx, targets: DataFrame) -> DataFrame:
    return ctx.rollup(Rollup("workload", "Supplier", "LineItem", "supplier", "SUM", "quantity"), targets)


register_plugin("supplierWorkload", supplier_workload)

_BIG = {"path": "totalPrice", "op": "is greater than", "value": "150000"}


@query(
    "rollup_count_dense",
    "SELECT c.id, count(o.id) AS value FROM l_customer c LEFT JOIN (SELECT id, customer FROM l_order WHERE status IS DISTINCT FROM 'F' AND totalPrice > 150000) o "
    "ON o.customer = c.id GROUP BY c.id",
)
def rollup_count_dense(s: DemoStore) -> DataFrame:
    rule = Rollup("n", "Customer", "Order", "customer", where=(("status", "ne", "F"), ("totalPrice", "gt", "150000")))
    return rollup(s, rule, s.scan("Customer"))


@query(
    "rollup_sum",
    "SELECT c.id, CAST(sum(o.totalPrice) AS DOUBLE) AS value FROM l_customer c JOIN l_order o ON o.customer = c.id WHERE o.totalPrice > 150000 GROUP BY c.id",
)
def rollup_sum(s: DemoStore) -> DataFrame:
    return _num(rollup(s, Rollup("v", "Customer", "Order", "customer", "SUM", "totalPrice", _BIG), s.scan("Customer")), "value")


@query(
    "rollup_minmax",
    "SELECT customer AS id, CAST(min(totalPrice) AS DOUBLE) AS lo, CAST(max(totalPrice) AS DOUBLE) AS hi FROM l_order WHERE customer IN (SELECT id FROM l_customer) GROUP BY customer",
)
def rollup_minmax(s: DemoStore) -> DataFrame:
    rules = [Rollup(n, "Customer", "Order", "customer", f, "totalPrice") for n, f in (("lo", "MIN"), ("hi", "MAX"))]
    both = derive(s, s.scan("Customer").select("id", "type"), "Customer", rules=rules)
    return _num(both.select("id", "lo", "hi"), "lo", "hi").where(F.col("lo").isNotNull())


@query(
    "rollup_avg",
    "SELECT customer AS id, CAST(sum(totalPrice) AS DOUBLE) / count(totalPrice) AS value FROM l_order WHERE customer IN (SELECT id FROM l_customer) GROUP BY customer",
)
def rollup_avg(s: DemoStore) -> DataFrame:
    return rollup(s, Rollup("v", "Customer", "Order", "customer", "AVG", "totalPrice"), s.scan("Customer"))


@query(
    "rollup_filtered",
    "SELECT c.id, count(o.id) AS value FROM l_customer c LEFT JOIN (SELECT id, customer FROM l_order WHERE status = 'O' AND priority IS NOT NULL "
    "AND contains(lower(priority), 'high') AND totalPrice <= 300000) o ON o.customer = c.id GROUP BY c.id",
)
def rollup_filtered(s: DemoStore) -> DataFrame:
    tree = {
        "and": [
            {"path": "status", "op": "is", "value": "O"},
            {"and": [{"path": "priority", "op": "is not", "value": None}, {"path": "priority", "op": "contains", "value": "HIGH"}]},
            {"path": "totalPrice", "op": "is less than or equal to", "value": 300000},
        ]
    }
    return rollup(s, Rollup("n", "Customer", "Order", "customer", where=tree), s.scan("Customer"))


@query(
    "rollup_abstract",
    "SELECT n.id, count(p.id) AS parties, CAST(sum(p.acctbal) AS DOUBLE) AS balance FROM l_nation n LEFT JOIN "
    "(SELECT id, nation, acctbal FROM l_customer UNION ALL SELECT id, nation, acctbal FROM l_supplier) p ON p.nation = n.id GROUP BY n.id",
)
def rollup_abstract(s: DemoStore) -> DataFrame:
    rules = [Rollup("parties", "Nation", "Party", "nation"), Rollup("balance", "Nation", "Party", "nation", "SUM", "acctbal")]
    return _num(derive(s, s.scan("Nation").select("id", "type"), "Nation", rules=rules).select("id", "parties", "balance"), "balance")


@query(
    "rollup_list_via",
    "SELECT p.id, count(r.src) AS value FROM l_part p LEFT JOIN (SELECT DISTINCT id AS src, unnest(related) AS target FROM l_part) r ON r.target = p.id GROUP BY p.id",
)
def rollup_list_via(s: DemoStore) -> DataFrame:
    return rollup(s, Rollup("n", "Part", "Part", "related"), s.scan("Part"))


_DERIVE_SQL = (
    "SELECT c.id, c.name, count(CASE WHEN o.status IS DISTINCT FROM 'F' AND o.id IS NOT NULL THEN 1 END) AS openOrderCount, "
    "CAST(sum(o.totalPrice) AS DOUBLE) AS totalSpend, CAST(min(o.totalPrice) AS DOUBLE) AS minOrder, CAST(max(o.totalPrice) AS DOUBLE) AS maxOrder, "
    "CAST(sum(o.totalPrice) AS DOUBLE) / nullif(count(o.totalPrice), 0) AS avgOrder FROM l_customer c LEFT JOIN l_order o ON o.customer = c.id GROUP BY c.id, c.name"
)


@query("derive_all", _DERIVE_SQL)
def derive_all(s: DemoStore) -> DataFrame:
    d = derive(s, s.scan("Customer"), "Customer")
    return _num(d, "totalSpend", "minOrder", "maxOrder").select(
        "id", "name", "openOrderCount", "totalSpend", "minOrder", "maxOrder", "avgOrder"
    )


@query(
    "derive_mixed_types",
    "SELECT id, type, n AS openOrderCount, CAST(NULL AS DOUBLE) AS workload FROM (SELECT c.id, c.type, count(o.id) AS n FROM l_customer c LEFT JOIN "
    "(SELECT * FROM l_order WHERE status IS DISTINCT FROM 'F') o ON o.customer = c.id GROUP BY c.id, c.type) UNION ALL "
    "SELECT s.id, s.type, NULL, CAST(sum(l.quantity) AS DOUBLE) FROM l_supplier s LEFT JOIN l_lineitem l ON l.supplier = s.id GROUP BY s.id, s.type",
)
def derive_mixed_types(s: DemoStore) -> DataFrame:
    """A result set of several types: each object gets what its own type derives."""
    d = derive(s, s.scan("Party"), "Party", "Customer", "Supplier")
    return d.select("id", "type", "openOrderCount", F.col("workload").cast("double").alias("workload"))


@query(
    "derive_plugin",
    "SELECT s.id, CAST(sum(l.quantity) AS DOUBLE) AS value FROM l_supplier s JOIN l_lineitem l ON l.supplier = s.id GROUP BY s.id",
)
def derive_plugin(s: DemoStore) -> DataFrame:
    from ..operators.rollup import run_plugin

    return _num(run_plugin(s, s.schema.plugins["workload"], s.scan("Supplier")), "value")


def order_changes(s: DemoStore) -> DataFrame:
    """Every order as a change: a third moved to another customer, a third created, a third deleted."""
    rows = s.scan("Order", include_deleted=True)
    key = F.conv(F.substring("id", 25, 12), 16, 10).cast("long")
    image = F.struct("customer", "status")
    moved = F.struct(F.concat(F.substring("customer", 1, 35), F.lit("0")).alias("customer"), "status")
    return rows.select(
        "id", "type", F.when(key % 3 != 1, image).alias("before"), F.when(key % 3 == 0, moved).when(key % 3 == 1, image).alias("after")
    )


@query(
    "affected_targets",
    "SELECT DISTINCT id, 'openOrderCount' AS property FROM (SELECT customer AS id FROM v_order WHERE tenant = 'default' UNION ALL "
    "SELECT substr(customer, 1, 35) || '0' FROM v_order WHERE tenant = 'default' AND o_orderkey % 3 = 0)",
)
def affected(s: DemoStore) -> DataFrame:
    return affected_targets(s, order_changes(s))


@query(
    "recompute_diff",
    "SELECT id, old, new FROM (SELECT c.id, c.openOrderCount AS old, count(o.id) AS new FROM l_customer c LEFT JOIN "
    "(SELECT * FROM l_order WHERE status IS DISTINCT FROM 'F') o ON o.customer = c.id GROUP BY c.id, c.openOrderCount) "
    "WHERE old <> new AND id IN (SELECT customer FROM v_order WHERE tenant = 'default' UNION ALL SELECT substr(customer, 1, 35) || '0' FROM v_order WHERE tenant = 'default' AND o_orderkey % 3 = 0)",
)
def recompute_diff(s: DemoStore) -> DataFrame:
    rule = next(r for r in s.schema.rollups if r.property == "openOrderCount")
    return recompute(s, affected_targets(s, order_changes(s)), rule).select("id", "old", "new")


@query(
    "browse_materialised",
    "SELECT p.id, p.pos, count(o.id) AS openOrderCount FROM (SELECT id, row_number() OVER (ORDER BY openOrderCount DESC NULLS FIRST, id) AS pos FROM l_customer "
    "WHERE openOrderCount >= 5) p LEFT JOIN (SELECT * FROM l_order WHERE status IS DISTINCT FROM 'F') o ON o.customer = p.id WHERE p.pos <= 60 GROUP BY p.id, p.pos",
)
def browse_materialised(s: DemoStore) -> DataFrame:
    """Filter and sort by the stored value, show the fresh one."""
    from pyspark.sql import Window

    q = resolve(s.schema, BrowseSpec(("Customer",), (("openOrderCount", "gte", "5"),), sort=("-openOrderCount",), size=60))
    items = page(matching(s, q), q)
    # At most one page of rows reaches this window.
    items = items.withColumn("pos", F.row_number().over(Window.orderBy(*order(q))).cast("long"))
    rule = next(r for r in s.schema.rollups if r.property == "openOrderCount")
    return derive(s, items, "Customer", rules=[rule], one_page=True).select("id", "pos", "openOrderCount")
