"""Validation queries: deliberate defects follow from the row's own key, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import validate as V
from ..operators.coerce import coerce
from ..sources.tagged import export_tagged, load_tagged
from .demo import BASE, DemoStore, ref
from .registry import query


@query("validate_required", "SELECT id, 'size' AS property, 'a value for size is missing' AS message FROM l_part WHERE size IS NULL")
def validate_required(s: DemoStore) -> DataFrame:
    return V.violations(s.scan("Part"), V.required(s.schema.properties("Part")))


@query(
    "validate_cardinality",
    "SELECT id, 'related' AS property, 'no more than 2 values fit, there are 3' AS message FROM l_part WHERE brand = 'Brand#7'",
)
def validate_cardinality(s: DemoStore) -> DataFrame:
    """Parts of one brand get a third related part."""
    third = F.concat("related", F.array(F.col("id")))
    rows = s.scan("Part").withColumn("related", F.when(F.col("brand") == "Brand#7", third).otherwise(F.col("related")))
    return V.violations(rows, V.cardinality(s.schema.properties("Part")))


@query(
    "validate_abstract",
    "SELECT id, '' AS property, t || ' only groups other types' AS message FROM "
    f"(SELECT id, CASE WHEN segment = 'BUILDING' THEN '{BASE}Party' ELSE type END AS t FROM l_customer) WHERE t LIKE '%Party'",
)
def validate_abstract(s: DemoStore) -> DataFrame:
    as_party = F.when(F.col("segment") == "BUILDING", F.lit(BASE + "Party")).otherwise(F.col("type"))
    return V.abstract_types(s, s.scan("Customer").withColumn("type", as_party))


def _key(column: str = "id"):
    return F.conv(F.substring(column, 25, 12), 16, 10).cast("long")


def _shifted_orders(s: DemoStore) -> DataFrame:
    """Orders whose customer is sometimes a supplier's id and sometimes one that does not exist."""
    c = _key("customer")
    wrong = F.when(c % 6 == 1, ref("Supplier", c % 7)).when(c % 6 == 2, ref("Customer", c + 10_000_000_000)).otherwise(F.col("customer"))
    return s.scan("Order").select("id", "type", wrong.alias("customer"))


_SHIFTED = (
    "o AS (SELECT id, customer AS c0, CAST('0x' || substr(customer, 25) AS BIGINT) AS c FROM l_order), "
    "r AS (SELECT id, CASE WHEN c % 6 = 1 THEN '00000000-0000-4000-8004-' || lpad(lower(to_hex(c % 7)), 12, '0') "
    "WHEN c % 6 = 2 THEN '00000000-0000-4000-8003-' || lpad(lower(to_hex(c + 10000000000)), 12, '0') ELSE c0 END AS ref FROM o)"
)


@query(
    "validate_missing_ref",
    "SELECT id, 'customer' AS property, 'nothing has the id ' || ref AS message FROM r "
    "WHERE ref NOT IN (SELECT id FROM l_customer UNION ALL SELECT id FROM l_supplier)",
    _SHIFTED,
)
def validate_missing_ref(s: DemoStore) -> DataFrame:
    v = V.references(s, _shifted_orders(s), "Order")
    return v.where(F.col("message").startswith("nothing has"))


@query(
    "validate_ref_type",
    f"SELECT id, 'customer' AS property, ref || ' is a {BASE}Supplier; a {BASE}Customer was asked for' AS message "
    "FROM r WHERE ref IN (SELECT id FROM l_supplier)",
    _SHIFTED,
)
def validate_ref_type(s: DemoStore) -> DataFrame:
    v = V.references(s, _shifted_orders(s), "Order")
    return v.where(F.col("message").contains(" is a "))


@query(
    "validate_ref_list",
    "SELECT id, 'related' AS property, 'nothing has the id ' || ref AS message FROM "
    "(SELECT DISTINCT id, unnest(related) AS ref FROM l_part) WHERE ref NOT IN (SELECT id FROM l_part)",
)
def validate_ref_list(s: DemoStore) -> DataFrame:
    return V.references(s, s.scan("Part").select("id", "type", "related"), "Part")


@query(
    "validate_shapes",
    "SELECT id, 'acctbal' AS property, 'below the least value -500' AS message FROM l_customer WHERE acctbal < -500 "
    "UNION ALL SELECT id, 'acctbal', 'above the greatest value 9000' FROM l_customer WHERE acctbal > 9000",
)
def validate_shapes(s: DemoStore) -> DataFrame:
    return V.violations(s.scan("Customer"), V.shapes(s.schema.properties("Customer")))


@query(
    "validate_pattern",
    "SELECT id, 'brand' AS property, 'does not follow ^Brand#[0-9]+$' AS message FROM l_part WHERE NOT regexp_matches(replace(brand, '#1', '-1'), '^Brand#[0-9]+$')",
)
def validate_pattern(s: DemoStore) -> DataFrame:
    rows = s.scan("Part").withColumn("brand", F.replace("brand", F.lit("#1"), F.lit("-1")))
    return V.violations(rows, V.shapes(s.schema.properties("Part")))


@query(
    "validate_staged",
    "SELECT id, 'structural' AS stage, 'size' AS property, 'a value for size is missing' AS message FROM p WHERE size IS NULL UNION ALL "
    "SELECT id, 'structural', property, 'nothing has the id ' || ref FROM r UNION ALL "
    "SELECT id, 'shapes', 'brand', 'does not follow ^Brand#[0-9]+$' FROM p WHERE contains(brand, '#1') AND size IS NOT NULL AND id NOT IN (SELECT id FROM r)",
    "p AS (SELECT id, size, brand, related, partOf FROM l_part), r AS (SELECT * FROM (SELECT DISTINCT id, 'related' AS property, unnest(related) AS ref FROM p "
    "UNION ALL SELECT id, 'partOf', partOf FROM p WHERE partOf IS NOT NULL) WHERE ref NOT IN (SELECT id FROM l_part))",
)
def validate_staged(s: DemoStore) -> DataFrame:
    rows = s.scan("Part").withColumn("brand", F.replace("brand", F.lit("#1"), F.lit("-1")))
    return V.validate(s, rows, "Part")


def raw_parts(s: DemoStore) -> DataFrame:
    """Parts as raw JSON with defects that follow from the key; one key in ten is sound."""
    k = F.col("p_partkey") % 10
    t = s.spark.read.parquet(f"{s.sf_dir}/part.parquet")
    name = F.concat(F.lit('"name": "'), F.col("p_name"), F.lit('"'))
    size = (
        F.when(k == 1, F.lit('"size": "12"'))
        .when(k == 2, F.lit('"size": 3.5'))
        .when(k == 3, F.lit('"size": 3.0'))
        .otherwise(F.concat(F.lit('"size": '), F.col("p_size")))
    )
    price = (
        F.when(k == 4, F.lit('"retailPrice": "abc"'))
        .when(k == 5, F.lit('"retailPrice": [1, 2]'))
        .otherwise(F.concat(F.lit(f'"{BASE}retailPrice": "'), F.col("p_retailprice"), F.lit('"')))
    )
    words = (
        F.when(k == 6, F.lit('"keywords": "red"'))
        .when(k == 7, F.lit('"keywords": ["red", 5, ["x"]]'))
        .otherwise(F.lit('"keywords": ["red", "blue"]'))
    )
    other = F.when(k == 8, F.lit('"colour": "red", "brand": null')).when(k == 9, F.lit('"partOf": "not-an-id"')).otherwise(F.lit('"kind": null'))
    text = F.concat(F.lit("{"), F.concat_ws(", ", name, size, price, words, other), F.lit("}"))
    return t.select(ref("Part", "p_partkey").alias("id"), text.alias("raw"))


_RAW_ID = "'00000000-0000-4000-8005-' || lpad(lower(to_hex(p_partkey)), 12, '0')"


@query(
    "coerce_records",
    f"SELECT {_RAW_ID} AS id, property, message FROM part JOIN (VALUES (1, 'size', 'not a whole number'), (2, 'size', 'not a whole number'), "
    "(4, 'retailPrice', 'not a number'), (5, 'retailPrice', 'one value is due, not a list'), "
    "(6, 'keywords', 'a list is due, not one value'), (7, 'keywords', 'element 1: not text'), "
    "(7, 'keywords', 'element 2: a list inside a list'), (8, 'colour', 'no property is called colour'), "
    "(9, 'partOf', 'not a UUID')) AS d(k, property, message) ON p_partkey % 10 = k",
)
def coerce_records(s: DemoStore) -> DataFrame:
    return coerce(s, raw_parts(s), "Part")[1]


@query(
    "coerce_good",
    f"SELECT {_RAW_ID} AS id, p_name AS name, CAST(CASE WHEN p_partkey % 10 = 3 THEN 3 ELSE p_size END AS BIGINT) AS size, p_retailprice AS price, 'red|blue' AS words "
    "FROM part WHERE p_partkey % 10 IN (0, 3)",
)
def coerce_good(s: DemoStore) -> DataFrame:
    good = coerce(s, raw_parts(s), "Part")[0]
    return good.select("id", "name", "size", F.col("retailPrice").cast("double").alias("price"), F.array_join("keywords", "|").alias("words"))


@query(
    "coerce_read_only",
    "SELECT id, property, property || ' is worked out and cannot be given' AS message "
    "FROM (SELECT id, unnest(['totalSpend', 'openOrderCount']) AS property FROM l_customer)",
)
def coerce_read_only(s: DemoStore) -> DataFrame:
    raw = F.to_json(F.struct("name", F.lit(1).alias("totalSpend"), F.col("openOrderCount")))
    return coerce(s, s.scan("Customer").select("id", raw.alias("raw")), "Customer")[1]


@query(
    "export_tagged",
    f"SELECT id, '{{\"{BASE}status\":{{\"text\":\"' || status || '\"}}' || CASE WHEN priority IS NULL THEN '' ELSE ',\"{BASE}priority\":{{\"text\":\"' || priority || '\"}}' END || "
    f"',\"{BASE}totalPrice\":{{\"decimal\":\"' || CAST(totalPrice AS VARCHAR) || '\"}},\"{BASE}orderDate\":{{\"date\":\"' || CAST(orderDate AS VARCHAR) || "
    f"'\"}},\"{BASE}customer\":{{\"ref\":\"' || customer || '\"}},\"{BASE}openLineCount\":{{\"integer\":' || openLineCount || '}}}}' AS props FROM l_order",
)
def export_orders(s: DemoStore) -> DataFrame:
    return export_tagged(s.scan("Order"), s.schema, "Order").select("id", "props")


@query(
    "load_tagged",
    "SELECT id, name, brand, CAST(size AS DOUBLE) AS size, CAST(retailPrice AS DOUBLE) AS price, array_to_string(keywords, '|') AS words, "
    "array_to_string(related, '|') AS related, partOf FROM l_part",
)
def load_parts(s: DemoStore) -> DataFrame:
    """Export and load again: nothing is lost."""
    good, _ = load_tagged(export_tagged(s.scan("Part"), s.schema, "Part"), s.schema, "Part")
    return good.select(
        "id", "name", "brand", F.col("size").cast("double").alias("size"), F.col("retailPrice").cast("double").alias("price"),
        F.array_join("keywords", "|").alias("words"), F.array_join("related", "|").alias("related"), "partOf",
    )


@query(
    "load_tagged_rejects",
    "SELECT id, CASE WHEN size = 1 THEN 'unknown tag: money' WHEN size = 2 THEN 'value does not fit: retailPrice' ELSE 'not a property map' END AS reason "
    "FROM l_part WHERE size IN (1, 2, 3)",
)
def load_rejects(s: DemoStore) -> DataFrame:
    dump = export_tagged(s.scan("Part"), s.schema, "Part").join(s.scan("Part").select("id", "size"), "id")
    size = F.col("size")
    props = (
        F.when(size == 1, F.replace("props", F.lit('"decimal"'), F.lit('"money"')))
        .when(size == 2, F.regexp_replace("props", r'"decimal":"[^"]*"', '"decimal":"much"'))
        .when(size == 3, F.lit("[1"))
        .otherwise(F.col("props"))
    )
    _, rejects = load_tagged(dump.withColumn("props", props).drop("size"), s.schema, "Part")
    return rejects.select("id", "reason")


@query(
    "coerce_exact",
    f"SELECT {_RAW_ID} AS id, property, message FROM part JOIN (VALUES (0, 'size', 'not a whole number'), (1, 'retailPrice', 'value does not fit'), "
    "(2, 'retailPrice', 'value does not fit'), (3, 'size', 'not a whole number')) AS d(k, property, message) ON p_partkey % 6 = k",
)
def coerce_exact(s: DemoStore) -> DataFrame:
    """Numbers that only rounding would make fit; zeros at the end and exponents are no reason."""
    k = F.col("p_partkey") % 6
    size = F.when(k == 0, F.lit("3.00000000000001")).when(k == 3, F.lit("2.5e0")).when(k == 4, F.lit("1.2e1")).otherwise(F.lit("7.000"))
    price = F.when(k == 1, F.lit('"1.239"')).when(k == 2, F.lit("1.001")).when(k == 5, F.lit('"12.500000"')).otherwise(F.lit("12.5"))
    raw = F.concat(F.lit('{"size": '), size, F.lit(', "retailPrice": '), price, F.lit("}"))
    t = s.spark.read.parquet(f"{s.sf_dir}/part.parquet")
    return coerce(s, t.select(ref("Part", "p_partkey").alias("id"), raw.alias("raw")), "Part")[1]


@query(
    "load_tagged_exact",
    "SELECT id, size % 3 = 1 AS rejected, CASE WHEN size % 3 = 1 THEN 'value does not fit: retailPrice' END AS reason FROM l_part WHERE size IS NOT NULL",
)
def load_tagged_exact(s: DemoStore) -> DataFrame:
    """A third of the prices has a third decimal place, another third zeros behind."""
    parts = s.scan("Part").where(F.col("size").isNotNull())
    dump = export_tagged(parts, s.schema, "Part").join(parts.select("id", "size"), "id")
    more = F.when(F.col("size") % 3 == 1, F.lit("7")).when(F.col("size") % 3 == 2, F.lit("000")).otherwise(F.lit(""))
    props = F.regexp_replace(F.col("props"), F.lit(r'"decimal":"([^"]*)"'), F.concat(F.lit('"decimal":"$1'), more, F.lit('"')))
    good, rejects = load_tagged(dump.withColumn("props", props).drop("size"), s.schema, "Part")
    return good.select("id", F.lit(False).alias("rejected"), F.lit(None).cast("string").alias("reason")).unionByName(rejects.select("id", F.lit(True).alias("rejected"), "reason"))
