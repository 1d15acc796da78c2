from decimal import Decimal

import pytest
from domain import RULES, make_store, oid
from pyspark.sql import functions as F

from typeloom.model import Rollup
from typeloom.operators.rollup import affected_targets, derive, recompute, register_plugin, rollup, run_plugin

D = Decimal
PROJECTS = [{"id": 20, "title": "A", "openTaskCount": 7, "version": 3}, {"id": 21, "title": "B", "openTaskCount": 0}]
TASKS = [
    {"id": 1, "belongsToProject": oid(20), "status": "open", "estimatedHours": D("3"), "assignedTo": oid(30)},
    {"id": 2, "belongsToProject": oid(20), "status": None, "estimatedHours": D("4.5"), "assignedTo": oid(30)},
    {"id": 3, "belongsToProject": oid(20), "status": "done", "estimatedHours": D("1"), "assignedTo": oid(31)},
    {"id": 4, "belongsToProject": oid(20), "status": "open", "tenant": "t2", "estimatedHours": D("9")},
    {"id": 5, "belongsToProject": oid(21), "status": "done"},
]


@pytest.fixture(scope="module")
def st(spark):
    return make_store(spark, Task=TASKS, Project=PROJECTS, Person=[{"id": 30, "name": "P"}, {"id": 31, "name": "Q"}])


def got(df):
    return {int(r["id"][-4:], 16): r["value"] for r in df.collect()}


def test_count_is_dense_and_others_sparse(st):
    projects = st.scan("Project")
    assert got(rollup(st, RULES[0], projects)) == {20: 2, 21: 0}
    assert got(rollup(st, RULES[1], projects)) == {20: D("8.5")}  # 21 has a source, but no value
    for f, v in (("MIN", D(1)), ("MAX", D("4.5")), ("AVG", pytest.approx(8.5 / 3))):
        assert got(rollup(st, Rollup("x", "Project", "Task", "belongsToProject", f, "estimatedHours"), projects)) == {20: v}
    assert got(rollup(st, RULES[0], projects.limit(0))) == {}


def test_rules_over_one_relationship_share_one_scan(st):
    df = derive(st, st.scan("Project"), "Project")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
    rows = {r["title"]: (r["openTaskCount"], r["totalEstimatedHours"]) for r in df.collect()}
    assert rows == {"A": (2, D("8.5")), "B": (0, None)}


def test_plugin(st):
    register_plugin("load", lambda ctx, t: ctx.rollup(Rollup("w", "Person", "Task", "assignedTo", "SUM", "estimatedHours"), t))
    assert got(run_plugin(st, "load", st.scan("Person"))) == {30: D("7.5"), 31: D(1)}


def test_moving_a_source_affects_both_targets(spark, st):
    image = "struct<belongsToProject:string>"
    schema = f"type string, before {image}, after {image}"
    task = st.schema.type("Task").iri
    changes = spark.createDataFrame([(task, (oid(20),), (oid(21),)), (task, None, (oid(20),)), (task, (oid(22),), None)], schema)
    hit = affected_targets(st, changes)
    assert {(int(r["id"][-4:], 16), r["property"]) for r in hit.collect()} == {(n, "openTaskCount") for n in (20, 21, 22)}
    diff = recompute(st, hit, RULES[0])
    assert [(int(r["id"][-4:], 16), r["version"], r["old"], r["new"]) for r in diff.collect()] == [(20, 3, 7, 2)]


def test_hot_target_is_aggregated_before_the_shuffle(st):
    plan = rollup(st, RULES[0])._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_list_relationships_count_each_target_once(spark):
    from typeloom.plans.demo import SCHEMA as S
    from typeloom.plans.demo import open_store
    from conftest import SF

    store = open_store(spark, SF)
    twice = store.scan("Part").withColumn("related", F.array("id", "id"))
    n = rollup(store.with_table("Part", twice), Rollup("n", "Part", "Part", "related")).agg(F.max("value")).first()[0]
    assert n == 1 and S.lookup("Part", "related").is_list
