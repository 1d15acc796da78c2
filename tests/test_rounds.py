"""Rounds of change sets and row versions laid over tables: what is worked out once, and what is spared."""

from datetime import datetime

from domain import B, make_store, oid

from typeloom.operators.commit import apply_all, apply_changes
from typeloom.streaming.maintain import Maintainer

AT = datetime(2024, 3, 1)
SHAPE = (
    "changeset_id long, seq int, op string, id string, type string, expected_version long, state string, at timestamp, by string, "
    "title string, status string, belongsToProject string"
)


def change(cs, op, n, version, title="new", seq=0, where=None):
    return (cs, seq, op, oid(n), B + "Task", version, None, AT, "me", title, "open", where)


def plan(df):
    return df._jdf.queryExecution().toString()


def titles(store):
    return sorted((int(r["id"][-4:], 16), r["version"], r["title"]) for r in store.table("Task").collect())


def test_verdicts_meet_the_changes_once(spark):
    st = make_store(spark, Task=[{"id": 1, "title": "a"}, {"id": 2, "title": "b"}])
    rows = [change(1, "update", 1, 1, "x"), change(2, "update", 1, 2, "y"), change(3, "update", 2, 7, "z"), change(None, "update", 2, 1, "w")]
    r = apply_changes(st, spark.createDataFrame(rows, SHAPE), "Task", keep=True)
    assert "Join" not in plan(r.deferred)
    assert [x["changeset_id"] for x in r.deferred.collect()] == [2]
    assert sorted((x["changeset_id"] or 0, x["status"]) for x in r.rejected.collect()) == [(0, "no_changeset"), (3, "stale")]
    assert [(x["id"], x["title"]) for x in r.versions["Task"].collect()] == [(oid(1), "x")]


def test_single_versions_need_no_search_for_the_newest(spark):
    st = make_store(spark, Task=[{"id": 1, "title": "a"}, {"id": 2, "title": "b"}, {"id": 3, "title": "c"}])
    once, _, _ = apply_all(st, spark.createDataFrame([change(1, "update", 1, 1, "x"), change(2, "update", 2, 1, "y")], SHAPE), "Task")
    assert "max_by" not in plan(once.table("Task"))
    assert titles(once) == [(1, 2, "x"), (2, 2, "y"), (3, 1, "c")]
    twice, _, _ = apply_all(st, spark.createDataFrame([change(1, "update", 1, 1, "x"), change(2, "update", 1, 2, "y"), change(3, "update", 2, 1, "z")], SHAPE), "Task")
    assert titles(twice) == [(1, 3, "y"), (2, 2, "z"), (3, 1, "c")]


def test_an_object_stored_twice_has_one_newest_version(spark):
    st = make_store(spark, Task=[{"id": 1, "title": "a"}, {"id": 1, "title": "a"}, {"id": 2, "title": "b"}])
    after, _, _ = apply_all(st, spark.createDataFrame([change(1, "update", 1, 1, "x")], SHAPE), "Task")
    assert titles(after) == [(1, 2, "x"), (2, 1, "b")]


def test_maintained_tables_with_single_versions(spark, tmp_path):
    base = make_store(spark, Task=[{"id": n, "title": "t", "status": "open", "belongsToProject": oid(20)} for n in (1, 2, 3)], Project=[{"id": 20, "title": "P", "openTaskCount": 3}])
    keeper = Maintainer(base, ("Task", "Project"), str(tmp_path))
    keeper.process(spark.createDataFrame([change(1, "update", 1, 1, "x"), change(2, "delete", 2, 1)], SHAPE), 0)
    now = keeper.store()
    assert "max_by" not in plan(now.table("Task"))
    assert titles(now) == [(1, 2, "x"), (2, 2, "t"), (3, 1, "t")]
    assert [r["openTaskCount"] for r in now.scan("Project").collect()] == [1]
    keeper.process(spark.createDataFrame([change(3, "update", 1, 2, "y", where=oid(20)), change(4, "update", 3, 1, "z", where=oid(20))], SHAPE), 1)
    now = keeper.store()
    assert titles(now) == [(1, 3, "y"), (2, 2, "t"), (3, 2, "z")]
    assert [r["openTaskCount"] for r in now.scan("Project").collect()] == [2]
