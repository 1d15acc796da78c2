import random
from datetime import datetime

import pytest
from domain import B, make_store, oid
from pyspark.sql import functions as F

from typeloom.operators.commit import EmptyChangeSet, apply_all, apply_changes, require_changes

AT = datetime(2024, 3, 1)
SHAPE = "changeset_id long, seq int, op string, id string, type string, expected_version long, state string, at timestamp, by string, title string, status string"


def change(cs, seq, op, n, version=None, title="new", type_name="Task"):
    return (cs, seq, op, oid(n), B + type_name, version, None, AT, "me", title, "open")


@pytest.fixture()
def st(spark):
    return make_store(
        spark,
        Task=[{"id": 1, "title": "a"}, {"id": 2, "title": "b"}, {"id": 3, "title": "c", "deleted_at": AT}, {"id": 4, "title": "f", "tenant": "t2"}],
        Project=[{"id": 20, "title": "P", "status": "old"}],
    )


def state(store, *names):
    rows = [r for n in names for r in store.table(n).collect()]
    return {int(r["id"][-4:], 16): (r["version"], r["title"], r["deleted_at"] is not None) for r in rows}


def test_changes_without_set_id_or_operation(spark, st):
    rows = [
        change(None, 0, "update", 1, 9), change(None, 1, "update", 2, 1), (3, 0, "update", None, B + "Task", 1, None, AT, "me", "x", "open"), change(3, 1, "create", 12),
        change(4, 0, None, 2, 1), change(5, 0, "merge", 1, 1), change(6, 0, "update", 1, 1),
    ]
    r = apply_changes(st, spark.createDataFrame(rows, SHAPE), "Task", "Project")
    assert sorted((x["changeset_id"] or 0, x["seq"], x["status"]) for x in r.rejected.collect()) == [
        (0, 0, "no_changeset"), (0, 1, "no_changeset"), (3, 0, "no_id"), (3, 1, "ok"), (4, 0, "unknown_op"), (5, 0, "unknown_op"),
    ]
    assert [x["id"] for x in r.versions["Task"].collect()] == [oid(1)] and r.deferred.count() == 0


def test_operations_and_rejections(spark, st):
    c = spark.createDataFrame(
        [
            change(1, 0, "update", 1, 1),
            change(1, 1, "create", 9),
            change(2, 0, "update", 2, 5),  # stale, takes its neighbour with it
            change(2, 1, "create", 10),
            change(3, 0, "update", 3, 1),  # deleted
            change(4, 0, "delete", 4, 1),  # foreign
            change(5, 0, "create", 4),  # the id exists elsewhere
            change(6, 0, "delete", 20, 1, type_name="Project"),
            change(7, 0, "create", 11),
            change(7, 1, "update", 11, 1),  # twice in one set
        ],
        SHAPE,
    )
    for keep in (False, True):
        r = apply_changes(st, c, "Task", "Project", keep=keep)
        after = st
        for n, df in r.tables.items():
            after = after.with_table(n, df)
        assert state(after, "Task", "Project") == {
            1: (2, "new", False), 2: (1, "b", False), 3: (1, "c", True), 4: (1, "f", False), 9: (1, "new", False), 20: (2, "P", True),
        }
        assert {(x["changeset_id"], x["seq"], x["status"]) for x in r.rejected.collect()} == {
            (2, 0, "stale"), (2, 1, "ok"), (3, 0, "not_found"), (4, 0, "not_found"), (5, 0, "exists"), (7, 0, "duplicate"), (7, 1, "duplicate"),
        }
        log = {x["object_id"]: x for x in r.log.collect()}
        assert {i: x["kind"] for i, x in log.items()} == {oid(1): "ObjectUpdated", oid(9): "ObjectCreated", oid(20): "ObjectDeleted"}
        assert '"old"' in log[oid(20)]["payload"] and log[oid(1)]["payload"] is None
        assert sum(df.count() for df in r.versions.values()) == 3
        assert r.deferred.isEmpty()


def test_update_replaces_all_properties_and_keeps_creation(spark, st):
    st = make_store(spark, Task=[{"id": 1, "title": "a", "priority": 4}])
    row = apply_changes(st, spark.createDataFrame([change(1, 0, "update", 1, 1)], SHAPE), "Task").tables["Task"].first()
    assert row["priority"] is None and row["created_by"] == "x" and row["updated_by"] == "me" and row["updated_at"] == AT


def test_empty_change_set():
    with pytest.raises(EmptyChangeSet):
        require_changes(0, 0)
    require_changes(0, 1)


def serial(rows, start):
    """One set after another, in plain Python."""
    now, rejected = dict(start), set()
    sets = {}
    for r in rows:
        sets.setdefault(r[0], []).append(r)
    for cs in sorted(sets):
        ids = [r[3] for r in sets[cs]]
        ok = len(ids) == len(set(ids))
        for r in sets[cs]:
            cur = now.get(r[3])
            ok &= cur is None if r[2] == "create" else (cur is not None and not cur[1] and cur[0] == r[5])
        if not ok:
            rejected |= {(r[0], r[1]) for r in sets[cs]}
            continue
        for r in sets[cs]:
            now[r[3]] = (1, False) if r[2] == "create" else (now[r[3]][0] + 1, r[2] == "delete")
    return now, rejected


@pytest.mark.parametrize("seed", [1, 2])
def test_deferred_sets_end_like_a_serial_run(spark, seed):
    rng = random.Random(seed)
    rows = []
    for cs in range(14):
        for seq in range(rng.choice([1, 1, 2, 3])):
            n = rng.choice([1, 2, 5, 6])
            op = rng.choice(["update", "update", "update", "create", "delete"] if n > 2 else ["update", "update", "update", "delete"])
            rows.append(change(cs, seq, op, n, None if op == "create" else rng.choice([1, 1, 2, 2, 3])))
    st = make_store(spark, Task=[{"id": 1}, {"id": 2}])
    want, rejected = serial(rows, {oid(1): (1, False), oid(2): (1, False)})
    after, bad, log = apply_all(st, spark.createDataFrame(rows, SHAPE), "Task")
    got = {r["id"]: (r["version"], r["deleted_at"] is not None) for r in after.table("Task").collect()}
    assert got == want
    assert {(r["changeset_id"], r["seq"]) for r in bad.collect()} == rejected
    assert log.count() == len(rows) - len(rejected)
    assert log.agg(F.countDistinct("entry_id")).first()[0] == log.count()
