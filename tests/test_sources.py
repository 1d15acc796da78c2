from datetime import datetime
from decimal import Decimal

import pytest
from conftest import SF
from domain import B, SCHEMA, make_store, oid
from pyspark.sql import functions as F

from typeloom.operators.browse import BrowseSpec, matching, resolve
from typeloom.operators.search import build_index, lookup, read_index, write_index
from typeloom.plans.demo import SCHEMA as SHOP
from typeloom.plans.demo import open_store
from typeloom.plans.q_read import event_log
from typeloom.session import work_dir
from typeloom.sources import changelog, versions
from typeloom.sources.store import ObjectStore, write_table
from typeloom.sources.tagged import export_tagged, load_tagged, write_tagged


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_parquet_scan(spark, tmp_path):
    shop = open_store(spark, SF)
    write_table(shop.table("Order"), str(tmp_path), "Order", sort_within=["status"])
    store = ObjectStore.from_parquet(spark, SHOP, str(tmp_path), "default")
    spec = BrowseSpec(("Order",), (("status", "eq", "O"), ("totalPrice", "gt", "1000"), ("customer", "eq", oid(7)), ("orderDate", "gte", "1996-01-01")))
    df = matching(store, resolve(SHOP, spec)).select("id", "status")
    text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(x for x in text.splitlines() if "PushedFilters" in x)
    for part in ("EqualTo(status,O)", "GreaterThan(totalPrice", "EqualTo(customer", "GreaterThanOrEqual(orderDate", "IsNull(deleted_at)"):
        assert part in pushed, pushed
    assert "PartitionFilters" in text and "tenant" in next(x for x in text.splitlines() if "PartitionFilters" in x)
    read = next(x for x in text.splitlines() if "ReadSchema" in x)
    assert "created_by" not in read and "priority" not in read
    assert df.count() == matching(shop, resolve(SHOP, spec)).count()


def test_line_item_ids_cost_nothing_when_unused(spark):
    from typeloom.model import Rollup
    from typeloom.operators.rollup import rollup

    assert "Window" not in plan(rollup(open_store(spark, SF), Rollup("n", "Order", "LineItem", "order")))


def test_tagged_round_trip_and_rejects(spark, tmp_path):
    st = make_store(spark, Task=[
        {"id": 1, "title": 'say "hi"\\\n', "notes": ["a", "b,\"c"], "priority": 5, "estimatedHours": Decimal("1.50"), "dueDate": datetime(2024, 2, 3).date(), "urgent": True, "assignedTo": oid(9)},
        {"id": 2, "title": "plain"},
    ])
    write_tagged(st.table("Task"), SCHEMA, "Task", str(tmp_path / "dump"))
    dump = spark.read.schema("id string, tenant string, type string, version long, props string").json(str(tmp_path / "dump"))
    good, bad = load_tagged(dump, SCHEMA, "Task")
    names = [p.name for p in SCHEMA.properties("Task")]
    key = lambda df: sorted(map(tuple, df.select("id", *names).collect()))
    assert key(good) == key(st.table("Task")) and bad.count() == 0
    assert export_tagged(st.table("Task").where(F.col("priority").isNull()), SCHEMA, "Task").first()["props"] == f'{{"{B}title":{{"text":"plain"}}}}'
    t = f"{B}title"
    raws = ["nope", f'{{"{t}":{{"money":"1"}}}}', f'{{"{t}":{{"integer":1}}}}', f'{{"{B}notes":{{"list":[{{"list":[]}}]}}}}', '{"zzz":{"text":"1"}}', f'{{"{B}priority":{{"integer":"x"}}}}']
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "id string, props string")
    good, bad = load_tagged(df, SCHEMA, "Task")
    assert good.count() == 0
    assert [r["reason"].split(":")[0] for r in bad.orderBy("id").collect()] == [
        "not a property map", "unknown tag", "value does not fit", "a list inside a list", "unknown property", "value does not fit",
    ]


def test_change_log_table(spark, store, tmp_path):
    log = event_log(store).drop("value")
    changelog.write_log(log, str(tmp_path / "log"))
    back = changelog.read_log(spark, str(tmp_path / "log"))
    want = log.where("kind = 'ObjectCreated'").count()
    rows = changelog.unprocessed(back, ("ObjectCreated",))
    assert rows.count() == want > 0
    assert "PartitionFilters: [isnotnull(kind" in plan(rows) or "PartitionFilters: [(kind" in plan(rows) or "kind#" in plan(rows)


def test_snapshots_switch_at_once(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert versions.current_snapshot(spark, root) is None
    with pytest.raises(FileNotFoundError):
        versions.read_snapshot(spark, root)
    assert versions.publish(spark.range(3), root) == 1
    spark.range(99).write.parquet(f"{root}/v=2")  # written but never published
    assert versions.read_snapshot(spark, root).count() == 3
    assert versions.publish(spark.range(5), root) == 2
    assert versions.read_snapshot(spark, root).count() == 5


def test_schema_documents(spark):
    docs = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, True)], "tenant string, version int, active boolean")
    after = versions.activate(docs, spark.createDataFrame([("a",), ("c",)], "tenant string"))
    assert sorted(map(tuple, versions.active_documents(after).collect())) == [("a", 3, True), ("b", 1, True), ("c", 1, True)]


def test_overlay(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "id string, version int")
    delta = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "id string, version int")
    assert sorted(map(tuple, versions.overlay(base, delta).collect())) == [("a", 1), ("b", 3), ("c", 1)]


def test_index_on_disk_reads_only_its_buckets(spark, store, tmp_path):
    index = build_index(store, "Document")
    write_index(index, str(tmp_path / "ix"), files_per_bucket=2)
    rows = read_index(spark, str(tmp_path / "ix"), "the is")
    assert sorted(map(tuple, lookup(rows, "the is").collect())) == sorted(map(tuple, lookup(index, "the is").collect()))
    assert rows.select("bucket").distinct().count() <= 2
    assert read_index(spark, str(tmp_path / "ix"), "!").count() == 0


class _Session:
    """Stands in for a session with given settings."""

    def __init__(self, own, core):
        self.conf = _Conf(own)
        self.sparkContext = type("Context", (), {"getConf": lambda _: _Conf(core), "master": "local[1]"})()


class _Conf(dict):
    pass


def test_work_dir_comes_from_the_session():
    assert work_dir(_Session({"spark.checkpoint.dir": "/shared/x"}, {})) == "/shared/x"
    assert work_dir(_Session({}, {"spark.checkpoint.dir": "/shared/y"})) == "/shared/y"
    assert work_dir(_Session({}, {})).endswith("typeloom-work")
