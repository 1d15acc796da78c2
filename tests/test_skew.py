"""One target named by most rows: joins are split, results stay whole."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from typeloom.model import Rollup
from typeloom.operators.browse import BrowseSpec, facets, label_join, resolve
from typeloom.operators.rollup import rollup
from typeloom.operators.validate import references
from typeloom.plans.demo import open_store

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1",
}


@pytest.fixture()
def hot(spark):
    """Orders times forty, spread over files, four in five of which name one customer."""
    store = open_store(spark, SF)
    customer = store.scan("Customer").orderBy("id").first()["id"]
    many = store.scan("Order").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40)))).repartition(16)
    many = many.withColumn("id", F.md5(F.concat("id", F.col("n").cast("string")))).withColumn(
        "customer", F.when(F.col("n") % 5 != 0, F.lit(customer)).otherwise(F.col("customer"))
    ).drop("n")
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield store.with_table("Order", many), customer
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_label_join_is_split_and_whole(hot):
    store, customer = hot
    df = label_join(store, store.scan("Order").select("id", "customer"), store.schema.lookup("Order", "customer"))
    n = df.count
    rows = df.groupBy("customer").count()
    got = {r["customer"]: r["count"] for r in rows.collect()}
    assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    live = {r["id"] for r in store.scan("Customer").select("id").collect()}
    want = {r["customer"]: r["count"] for r in store.scan("Order").groupBy("customer").count().collect() if r["customer"] in live}
    assert got == want and max(got, key=got.get) == customer and n() == sum(want.values())


def test_facets_and_rollups_meet_the_hot_value_as_one_row(hot):
    store, customer = hot
    orders = store.scan("Order").where(F.col("customer") == customer).count()
    counted = rollup(store, Rollup("n", "Customer", "Order", "customer"), store.scan("Customer"))
    assert counted.where(F.col("id") == customer).first()["value"] == orders
    name = store.scan("Customer").where(F.col("id") == customer).first()["name"]
    counts = facets(store, resolve(store.schema, BrowseSpec(("Order",), facets=("customer",))))
    assert counts.where(F.col("value") == name).first()["n"] == orders
    text = counts._jdf.queryExecution().executedPlan().toString()
    assert text.index("Join") < text.rindex("partial_count")  # counted below, that is before, the join


def test_a_hot_reference_is_resolved_once(hot):
    store, customer = hot
    gone = store.with_table("Customer", store.table("Customer").where(F.col("id") != customer))
    bad = references(gone, gone.scan("Order").select("id", "type", "customer"), "Order")
    live = gone.scan("Customer").select(F.col("id").alias("customer"))
    assert bad.count() == gone.scan("Order").join(live, "customer", "left_anti").count() > 0
