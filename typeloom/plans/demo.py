"""The given tables as typed objects: a demo schema with its mapping, rules and state machines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import keyed_id
from ..model import Action, Machine, Property, Rollup, Schema, Transition, TypeDef
from ..session import prepare
from ..sources.store import ObjectStore

BASE = "https://shop.example/schema#"
TENANT = "default"
MONEY = (18, 2)

# Number of each type inside its ids.
TYPE_NO = {
    "Region": 1,
    "Nation": 2,
    "Customer": 3,
    "Supplier": 4,
    "Part": 5,
    "Order": 6,
    "LineItem": 7,
    "Document": 8,
    "Account": 9,
}


def _p(name: str, **kw: object) -> Property:
    return Property(BASE + name, **kw)


def _money(name: str, **kw: object) -> Property:
    return _p(name, datatype="decimal", decimal_type=MONEY, **kw)


NAME = _p("name", min=1, display_label=True, searchable=True)

TYPES = (
    TypeDef(BASE + "Place", abstract=True, properties=(NAME,)),
    TypeDef(BASE + "Region", (BASE + "Place",)),
    TypeDef(BASE + "Nation", (BASE + "Place",), properties=(_p("region", target="Region", facet=True),)),
    TypeDef(
        BASE + "Party",
        abstract=True,
        properties=(NAME, _p("nation", target="Nation", facet=True), _money("acctbal", min_value="-500", max_value="9000")),
    ),
    TypeDef(
        BASE + "Customer",
        (BASE + "Party",),
        properties=(
            _p("segment", facet=True, min=1),
            _p("openOrderCount", datatype="long", read_only=True),
            _money("totalSpend", read_only=True),
            _money("minOrder", read_only=True),
            _money("maxOrder", read_only=True),
            _money("avgOrder", read_only=True),
        ),
    ),
    TypeDef(BASE + "Supplier", (BASE + "Party",), properties=(_money("workload", read_only=True),)),
    TypeDef(
        BASE + "Part",
        properties=(
            NAME,
            _p("brand", facet=True, pattern="^Brand#[0-9]+$"),
            _p("kind", facet=True),
            _p("size", datatype="long", min=1),
            _money("retailPrice"),
            _p("keywords", max=None, searchable=True),
            _p("related", target="Part", max=2),
            _p("partOf", target="Part", transitive=True, inverse="parts"),
        ),
    ),
    TypeDef(
        BASE + "Order",
        properties=(
            _p("status", facet=True, indexed=True),
            _p("priority", facet=True),
            _money("totalPrice"),
            _p("orderDate", datatype="date"),
            _p("customer", target="Customer", facet=True),
            _p("lineCount", datatype="long", read_only=True),
            _p("openLineCount", datatype="long", read_only=True),
        ),
    ),
    TypeDef(
        BASE + "LineItem",
        properties=(
            _p("order", target="Order"),
            _p("part", target="Part"),
            _p("supplier", target="Supplier"),
            _money("quantity"),
            _money("extendedPrice"),
            _p("returnFlag", facet=True),
            _p("lineStatus", facet=True),
            _p("shipDate", datatype="dateTime"),
        ),
    ),
    TypeDef(
        BASE + "Document",
        properties=(
            _p("text", searchable=True),
            _p("lang", facet=True),
            _p("source", facet=True),
            _p("nChars", datatype="long"),
        ),
    ),
    TypeDef(BASE + "Account", properties=(_p("lastCommand"),)),
)

OPEN = ("status", "ne", "F")
ROLLUPS = (
    Rollup("openOrderCount", "Customer", "Order", "customer", "COUNT", where=OPEN, materialised=True),
    Rollup("totalSpend", "Customer", "Order", "customer", "SUM", "totalPrice"),
    Rollup("minOrder", "Customer", "Order", "customer", "MIN", "totalPrice"),
    Rollup("maxOrder", "Customer", "Order", "customer", "MAX", "totalPrice"),
    Rollup("avgOrder", "Customer", "Order", "customer", "AVG", "totalPrice"),
    Rollup("lineCount", "Order", "LineItem", "order", "COUNT"),
    Rollup("openLineCount", "Order", "LineItem", "order", "COUNT", where=("lineStatus", "eq", "O"), materialised=True),
)

# An order from quotation to settlement: goods leave whole or in parts, may be refused, and a delivery that
# nobody refuses counts as settled after ten days.
ORDER_MACHINE = Machine(
    "Order",
    "Quoted",
    ("Quoted", "Picking", "Partial", "Shipped", "Returned", "Settled"),
    (
        Transition(
            "place",
            "Quoted",
            "Picking",
            guard="self.priority IS NOT NULL",
            message="an order needs a priority before it is picked",
            actions=(
                Action("create_object", create_type="Document", assignments=(("text", "concat('Pick list, status ', self.status)"), ("lang", "'en'"))),
                Action("webhook", url="https://stock.example/pick/${self.id}", method="PUT", body="${self.priority} ${self.status}"),
            ),
        ),
        Transition("ship", "Picking", "Shipped", actions=(Action("set_property", property="priority", literal="0-SENT"),)),
        Transition("shipRest", "Partial", "Shipped"),
        Transition("refuse", "Shipped", "Returned", actions=(Action("log", message="refused: ${self.id}, priority ${self.priority}"),)),
        Transition("settle", "Shipped", "Settled", guard="self.totalPrice < 400000"),
        Transition("requote", "Returned", "Quoted"),
        Transition("lastLineGone", "Picking", "Shipped", "ON_CHANGE", guard="self.openLineCount = 0", watch=("order",)),
        Transition("oneLineLeft", "Picking", "Partial", "ON_CHANGE", guard="self.openLineCount = 1", watch=("order",)),
        Transition("settleUnanswered", "Shipped", "Settled", "TIMER", after="P10D"),
        Transition("complain", "Settled", "Returned", "EXTERNAL_SIGNAL", signal="complaint"),
    ),
)

# A shop account by what its user did last: errors block it, and a block that no click lifts ends after 36 hours.
ACCOUNT_MACHINE = Machine(
    "Account",
    "Visitor",
    ("Visitor", "Member", "Buyer", "Blocked"),
    (
        Transition("signup", "Visitor", "Member"),
        Transition("purchase", "Member", "Buyer", guard="self.value < 100"),
        Transition("view", "Buyer", "Member"),
        Transition("error", "Buyer", "Blocked"),
        Transition("click", "Blocked", "Member"),
        Transition("lapse", "Blocked", "Visitor", "TIMER", after="PT36H"),
    ),
)

SCHEMA = Schema(TYPES, ROLLUPS, (ORDER_MACHINE, ACCOUNT_MACHINE), {"workload": "supplierWorkload"})


def _envelope(type_name: str, key: Column, created: Column, mark: Column, state: Column | None = None) -> list[Column]:
    """Envelope columns; ``mark`` decides tenant and deletion, which must not need the full id."""
    return [
        keyed_id(TYPE_NO[type_name], key).alias("id"),
        F.when(mark % 10 == 0, F.lit("other")).otherwise(F.lit(TENANT)).alias("tenant"),
        F.lit(BASE + type_name).alias("type"),
        F.lit(1).cast("long").alias("version"),
        (state if state is not None else F.lit(None).cast("string")).alias("state"),
        created.alias("created_at"),
        F.lit("loader").alias("created_by"),
        created.alias("updated_at"),
        F.lit("loader").alias("updated_by"),
        F.when(mark % 17 == 5, F.lit("2024-06-01 00:00:00").cast("timestamp")).alias("deleted_at"),
    ]


def _minutes_after(key: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + key.cast("long") * 60)


def _keyed(type_name: str, key: Column, created: Column | None = None, state: Column | None = None) -> list[Column]:
    return _envelope(type_name, key, created if created is not None else _minutes_after(key), key, state)


def _dec(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)")


def ref(type_name: str, key: str | Column) -> Column:
    return keyed_id(TYPE_NO[type_name], F.col(key) if isinstance(key, str) else key)


def _region(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("region").select(*_keyed("Region", F.col("r_regionkey")), F.col("r_name").alias("name"))


def _nation(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("nation").select(
        *_keyed("Nation", F.col("n_nationkey")), F.col("n_name").alias("name"), ref("Region", "n_regionkey").alias("region")
    )


def _customer(t: Callable[[str], DataFrame]) -> DataFrame:
    missing = F.lit(None).cast("decimal(18,2)")
    return t("customer").select(
        *_keyed("Customer", F.col("c_custkey")),
        F.col("c_name").alias("name"),
        ref("Nation", "c_nationkey").alias("nation"),
        _dec("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"),
        (F.col("c_custkey") % 20).alias("openOrderCount"),
        *[missing.alias(n) for n in ("totalSpend", "minOrder", "maxOrder", "avgOrder")],
    )


def _supplier(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("supplier").select(
        *_keyed("Supplier", F.col("s_suppkey")),
        F.col("s_name").alias("name"),
        ref("Nation", "s_nationkey").alias("nation"),
        _dec("s_acctbal").alias("acctbal"),
        F.lit(None).cast("decimal(18,2)").alias("workload"),
    )


def _part(t: Callable[[str], DataFrame]) -> DataFrame:
    key = F.col("p_partkey")
    return t("part").select(
        *_keyed("Part", key),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("long")).alias("size"),
        _dec("p_retailprice").alias("retailPrice"),
        F.split("p_name", " ").alias("keywords"),
        F.array(ref("Part", key + 1), ref("Part", key * 2)).alias("related"),
        F.when(key > 0, ref("Part", F.floor(key / 2))).alias("partOf"),
    )


def _order(t: Callable[[str], DataFrame]) -> DataFrame:
    key = F.col("o_orderkey")
    by_status = (
        F.when(F.col("o_orderstatus") == "O", F.lit("Picking")).when(F.col("o_orderstatus") == "P", F.lit("Shipped")).otherwise(F.lit("Settled"))
    )
    return t("orders").select(
        *_keyed(
            "Order",
            key,
            F.col("o_orderdate").cast("timestamp"),
            F.when(key % 9 == 4, F.lit("Quoted")).otherwise(by_status),
        ),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("priority"),
        _dec("o_totalprice").alias("totalPrice"),
        F.col("o_orderdate").cast("date").alias("orderDate"),
        ref("Customer", "o_custkey").alias("customer"),
        F.lit(None).cast("long").alias("lineCount"),
        (key % 3).alias("openLineCount"),
    )


def _lineitem(t: Callable[[str], DataFrame]) -> DataFrame:
    # (order, line) is not unique in the given rows; the number inside a pair is only worked out
    # where a query asks for the id, since Catalyst drops an unused window.
    others = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rn = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*others))
    key = F.col("l_orderkey") * 1024 + F.col("l_linenumber") * 64 + F.col("_rn")
    return t("lineitem").withColumn("_rn", rn).select(
        *_envelope("LineItem", key, F.col("l_shipdate").cast("timestamp"), F.col("l_orderkey") * 8 + F.col("l_linenumber")),
        ref("Order", "l_orderkey").alias("order"),
        ref("Part", "l_partkey").alias("part"),
        ref("Supplier", "l_suppkey").alias("supplier"),
        _dec("l_quantity").alias("quantity"),
        _dec("l_extendedprice").alias("extendedPrice"),
        F.col("l_returnflag").alias("returnFlag"),
        F.col("l_linestatus").alias("lineStatus"),
        F.col("l_shipdate").cast("timestamp").alias("shipDate"),
    )


def _document(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("documents").select(
        *_keyed("Document", F.col("doc_id")), "text", "lang", "source", F.col("n_chars").alias("nChars")
    )


TYPE_LOADERS = {
    "Region": _region,
    "Nation": _nation,
    "Customer": _customer,
    "Supplier": _supplier,
    "Part": _part,
    "Order": _order,
    "LineItem": _lineitem,
    "Document": _document,
}


class DemoStore(ObjectStore):
    """The demo objects, with the folder of the given tables they are read from."""

    sf_dir: str = ""


def open_store(spark: SparkSession, sf_dir: str, tenant: str = TENANT) -> DemoStore:
    prepare(spark)

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    loaders = {name: (lambda f=f: f(table)) for name, f in TYPE_LOADERS.items()}
    store = DemoStore(spark, SCHEMA, loaders, tenant)
    store.sf_dir = sf_dir
    return store


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


# ---------------------------------------------------------------- the same mapping as SQL views


def _sql_id(type_name: str, key: str) -> str:
    return f"'00000000-0000-4000-8{TYPE_NO[type_name]:03x}-' || lpad(lower(to_hex(CAST({key} AS BIGINT))), 12, '0')"


def _sql_envelope(type_name: str, key: str, mark: str | None = None, created: str | None = None, state: str = "CAST(NULL AS VARCHAR)") -> str:
    mark = mark or key
    created = created or f"TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({key} AS BIGINT))"
    return (
        f"{_sql_id(type_name, key)} AS id, CASE WHEN ({mark}) % 10 = 0 THEN 'other' ELSE 'default' END AS tenant, "
        f"'{BASE}{type_name}' AS type, CAST(1 AS BIGINT) AS version, {state} AS state, {created} AS created_at, "
        f"'loader' AS created_by, {created} AS updated_at, 'loader' AS updated_by, "
        f"CASE WHEN ({mark}) % 17 = 5 THEN TIMESTAMP '2024-06-01 00:00:00' END AS deleted_at"
    )


_ORDER_STATE = (
    "CASE WHEN o_orderkey % 9 = 4 THEN 'Quoted' WHEN o_orderstatus = 'O' THEN 'Picking' "
    "WHEN o_orderstatus = 'P' THEN 'Shipped' ELSE 'Settled' END"
)

SQL_VIEWS = {
    "v_region": f"SELECT {_sql_envelope('Region', 'r_regionkey')}, r_name AS name FROM region",
    "v_nation": (
        f"SELECT {_sql_envelope('Nation', 'n_nationkey')}, n_name AS name, {_sql_id('Region', 'n_regionkey')} AS region FROM nation"
    ),
    "v_customer": (
        f"SELECT {_sql_envelope('Customer', 'c_custkey')}, c_name AS name, {_sql_id('Nation', 'c_nationkey')} AS nation, "
        "CAST(c_acctbal AS DECIMAL(18,2)) AS acctbal, c_mktsegment AS segment, c_custkey % 20 AS openOrderCount FROM customer"
    ),
    "v_supplier": (
        f"SELECT {_sql_envelope('Supplier', 's_suppkey')}, s_name AS name, {_sql_id('Nation', 's_nationkey')} AS nation, "
        "CAST(s_acctbal AS DECIMAL(18,2)) AS acctbal FROM supplier"
    ),
    "v_part": (
        f"SELECT {_sql_envelope('Part', 'p_partkey')}, p_name AS name, p_brand AS brand, p_type AS kind, "
        "CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS BIGINT) END AS size, CAST(p_retailprice AS DECIMAL(18,2)) AS retailPrice, "
        f"string_split(p_name, ' ') AS keywords, [{_sql_id('Part', 'p_partkey + 1')}, {_sql_id('Part', 'p_partkey * 2')}] AS related, "
        f"CASE WHEN p_partkey > 0 THEN {_sql_id('Part', 'p_partkey // 2')} END AS partOf FROM part"
    ),
    "v_order": (
        f"SELECT {_sql_envelope('Order', 'o_orderkey', created='o_orderdate', state=_ORDER_STATE)}, o_orderkey, o_orderstatus AS status, "
        "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS priority, "
        "CAST(o_totalprice AS DECIMAL(18,2)) AS totalPrice, CAST(o_orderdate AS DATE) AS orderDate, "
        f"{_sql_id('Customer', 'o_custkey')} AS customer, o_orderkey % 3 AS openLineCount FROM orders"
    ),
    "v_lineitem": (
        f"SELECT {_sql_envelope('LineItem', 'l_orderkey * 1024 + l_linenumber * 64 + rn', 'l_orderkey * 8 + l_linenumber', 'l_shipdate')}, "
        f"{_sql_id('Order', 'l_orderkey')} AS \"order\", {_sql_id('Part', 'l_partkey')} AS part, {_sql_id('Supplier', 'l_suppkey')} AS supplier, "
        "CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS extendedPrice, "
        "l_returnflag AS returnFlag, l_linestatus AS lineStatus, l_shipdate AS shipDate FROM ("
        "SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, "
        "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem)"
    ),
    "v_document": f"SELECT {_sql_envelope('Document', 'doc_id')}, text, lang, source, n_chars AS nChars FROM documents",
}
# Live rows of the tenant.
SQL_VIEWS |= {
    "l_" + n[2:]: f"SELECT * FROM {n} WHERE tenant = 'default' AND deleted_at IS NULL" for n in list(SQL_VIEWS)
}
