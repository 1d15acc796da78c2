from decimal import Decimal

import pytest
from domain import B, SCHEMA, make_store, oid
from pyspark.sql import functions as F

from typeloom.operators.browse import SCORE, BrowseSpec, browse, facet_order, facets, matching, order, page, page_after, resolve
from typeloom.operators.predicates import InvalidQuery, from_tree

PEOPLE = [{"id": 1, "name": "alice"}, {"id": 2, "name": "Bob"}, {"id": 3, "name": "Bob", "deleted_at": None}, {"id": 4, "name": None}]
TASKS = [
    {"id": 10, "title": "Quarterly budget", "status": "open", "priority": 2, "assignedTo": oid(1), "estimatedHours": Decimal("3")},
    {"id": 11, "title": "budget_50%", "status": "done", "priority": None, "assignedTo": oid(2), "notes": ["quarterly", "budget budget"]},
    {"id": 12, "title": "Other", "status": None, "priority": 1, "assignedTo": oid(3)},
    {"id": 13, "title": "gone", "status": "open", "priority": 9, "deleted_at": __import__("datetime").datetime(2024, 2, 2)},
    {"id": 14, "title": "foreign", "status": "open", "priority": 9, "tenant": "t2"},
    {"id": 15, "title": "Unnamed", "status": "open", "priority": 2, "assignedTo": oid(4)},
]


@pytest.fixture(scope="module")
def st(spark):
    return make_store(spark, Task=TASKS, Person=PEOPLE, Project=[{"id": 20, "title": "Plan", "status": "open"}])


def ids(st, *filters, **kw):
    spec = BrowseSpec(kw.pop("types", ("Task",)), filters, **kw)
    q = resolve(st.schema, spec)
    return [int(r["id"][-4:], 16) for r in page(matching(st, q), q).collect()]


def test_scope_and_deleted(st):
    assert ids(st) == [10, 11, 12, 15]
    assert ids(st, include_deleted=True) == [10, 11, 12, 13, 15]
    assert ids(st, types=("WorkItem",)) == [10, 11, 12, 15, 20]
    assert ids(st, types=("Task", "Person")) == [1, 2, 3, 4, 10, 11, 12, 15]


def test_missing_values_and_operators(st):
    assert ids(st, ("status", "ne", "open")) == [11, 12]
    assert ids(st, ("status", "isNull")) == [12]
    assert ids(st, ("priority", "gte", "2.0")) == [10, 15]
    assert ids(st, ("title", "contains", "T_50%")) == [11]
    assert ids(st, ("title", "contains", "_")) == [11]
    assert ids(st, ("title", "startsWith", "quart")) == [10]
    assert ids(st, ("assignedTo", "in", f"{oid(1)}, {oid(2).upper()}")) == [10, 11]
    assert ids(st, (B + "priority", "gt", "1"), ("priority", "lt", "3")) == [10, 15]


def test_order_and_pages(st):
    assert ids(st, sort=("priority",)) == [12, 10, 15, 11]
    assert ids(st, sort=("-priority",)) == [11, 10, 15, 12]
    assert ids(st, sort=("status", "-title")) == [11, 15, 10, 12]
    assert ids(st, size=2, page=1) == [12, 15]
    assert ids(st, size=2, page=9) == []


def test_search(st):
    assert ids(st, text="BUDGET, quarterly") == [11, 10]
    assert ids(st, text="budget missing") == []
    assert ids(st, text="!!!") == []
    assert ids(st, text="  ") == [10, 11, 12, 15]


def test_browse_totals_and_facets(st):
    r = browse(st, BrowseSpec(("Task",), (("status", "eq", "open"),), size=1, facets=("status", "assignedTo")))
    assert r.total.first().asDict() == {"total": 2, "pages": 2}
    got = [tuple(x) for x in r.facets.collect()]
    # The status facet ignores its own selection; people without a name are dropped.
    assert got == [("assignedTo", "alice", 1), ("status", "open", 2), ("status", "done", 1)]


def test_equal_labels_merge_and_ties_are_by_code_point(st):
    q = resolve(st.schema, BrowseSpec(("Task",), facets=("assignedTo",)))
    assert [tuple(x) for x in facet_order(facets(st, q)).collect()] == [("assignedTo", "Bob", 2), ("assignedTo", "alice", 1)]


def test_all_problems_are_reported_at_once():
    with pytest.raises(InvalidQuery) as e:
        resolve(
            SCHEMA,
            BrowseSpec(
                ("WorkItem",),
                (("nope", "eq", "1"), ("notes", "eq", "x"), ("totalEstimatedHours", "gt", "1"), ("title", "lt", "x"), ("priority", "eq", "1.5"), ("priority", "in", "1,,2"), ("dueDate", "eq", "1/2/24"), ("urgent", "eq", "maybe"), ("assignedTo", "eq", "7"), ("priority", "near", "1"), ("priority", "eq", None)),
                sort=("-badges",),
                facets=("priority",),
                size=501,
            ),
        )
    assert len(e.value.violations) == 14


def test_maintained_rollups_may_be_filtered():
    assert resolve(SCHEMA, BrowseSpec(("Project",), (("openTaskCount", "gt", "1"),))).criteria


def test_literals():
    good = {"priority": "5.0", "urgent": "TRUE", "dueDate": "2024-02-29", "estimatedHours": "1e2"}
    q = resolve(SCHEMA, BrowseSpec(("Task",), tuple((k, "eq", v) for k, v in good.items())))
    assert [str(c.value) for c in q.criteria] == ["5", "True", "2024-02-29", "1E+2"]


def test_filter_trees():
    tree = {"and": [{"path": "status", "op": "is", "value": None}, {"and": [{"path": "priority", "op": "is in", "value": [1, 2]}]}]}
    assert [(c.property.name, c.operator) for c in from_tree(SCHEMA, "Task", tree)] == [("status", "isNull"), ("priority", "in")]
    for bad in ({"or": []}, {"any": []}, {"path": "status", "op": "near", "value": 1}, {"path": "status", "op": "contains", "value": None}, {"path": "zzz", "op": "is", "value": 1}):
        with pytest.raises(InvalidQuery):
            from_tree(SCHEMA, "Task", bad)


def test_long_lists_become_joins(st):
    wanted = [oid(n) for n in range(5000)]
    q = resolve(st.schema, BrowseSpec(("Task",), (("assignedTo", "in", wanted),)))
    df = matching(st, q)
    assert "LeftSemi" in df._jdf.queryExecution().toString()
    assert df.count() == 4
    # A hundred thousand values, in rows and in facets.
    q = resolve(st.schema, BrowseSpec(("Task",), (("assignedTo", "in", [oid(n) for n in range(100_000)]),), facets=("status", "assignedTo")))
    assert matching(st, q).count() == 4
    few = resolve(st.schema, BrowseSpec(("Task",), facets=("status", "assignedTo")))
    assert len(facets(st, q).collect()) <= len(facets(st, few).collect())


def test_the_page_behind_a_row(store, tmp_path):
    q = resolve(store.schema, BrowseSpec(("Document",), text="the is", size=20))
    rows = matching(store, q)
    ordered = [r["id"] for r in rows.orderBy(*order(q)).collect()]
    last = page(rows, q).collect()[-1]
    behind = page_after(rows, q, {SCORE: last[SCORE], "created_at": last["created_at"], "id": last["id"]})
    assert [r["id"] for r in behind.collect()] == ordered[20:40] and len(ordered) > 25
    plain = resolve(store.schema, BrowseSpec(("Order",), size=5))
    rows = matching(store, plain)
    last = page(rows, plain).collect()[-1]
    behind = page_after(rows, plain, {"created_at": last["created_at"], "id": last["id"]})
    assert [r["id"] for r in behind.collect()] == [r["id"] for r in rows.orderBy("created_at", "id").collect()][5:10]
    # On a table that is stored the first key's bound reaches the scan, whichever way it is sorted.
    rows.select("id", "created_at", "totalPrice").write.parquet(str(tmp_path / "t"))
    for sort, says in ((("totalPrice",), "GreaterThan(totalPrice,500.00)"), (("-totalPrice",), "LessThan(totalPrice,500.00)")):
        q = resolve(store.schema, BrowseSpec(("Order",), sort=sort, size=5))
        plan = page_after(store.spark.read.parquet(str(tmp_path / "t")), q, {"totalPrice": "500.00", "id": "~"})._jdf.queryExecution().toString()
        assert says in plan.split("PushedFilters")[1]


def test_reads(spark, st):
    asked = spark.createDataFrame([(oid(n),) for n in (10, 13, 14, 20, 99)], "id string")
    assert {r["id"]: r["type"] for r in st.types_of(asked).collect()} == {oid(10): B + "Task", oid(20): B + "Project"}
    assert st.types_of(asked.limit(0)).count() == 0
    wants = asked.withColumn("requested", F.lit("WorkItem")).unionByName(asked.withColumn("requested", F.lit("Task")))
    assert sorted((r["id"], r["requested"]) for r in st.read_typed(wants).collect()) == [(oid(10), "Task"), (oid(10), "WorkItem"), (oid(20), "WorkItem")]


def test_decimal_literals_are_not_rounded(store):
    price = store.scan("Order").orderBy("id").first()["totalPrice"]

    def count(op, value):
        return matching(store, resolve(store.schema, BrowseSpec(("Order",), (("totalPrice", op, str(value)),)))).count()

    assert count("eq", price) >= 1 and count("eq", price - Decimal("0.004")) == 0
    assert count("gte", price - Decimal("0.004")) == count("gte", price)
    assert count("in", f"{price}, 1e37, 0.125") == count("eq", price)


def test_numbers_out_of_range_are_reported():
    for name, raw in (("priority", str(2**63)), ("priority", "NaN"), ("priority", "1e99"), ("estimatedHours", "1e40"), ("estimatedHours", "Infinity")):
        with pytest.raises(InvalidQuery):
            resolve(SCHEMA, BrowseSpec(("Task",), ((name, "eq", raw),)))
