from decimal import Decimal

import pytest
from domain import B, SCHEMA, make_store, oid
from pyspark.sql import functions as F

from typeloom.operators.coerce import coerce
from typeloom.operators.validate import validate


@pytest.fixture(scope="module")
def st(spark):
    return make_store(spark, Person=[{"id": 30, "name": "P"}], Project=[{"id": 20, "title": "X"}])


def problems(df):
    return sorted((int(r["id"][-4:], 16), r["stage"], r["property"], r["message"]) for r in df.collect())


def test_stages_stop_at_the_first_failure(spark, st):
    from domain import rows

    tasks = rows(
        spark, "Task",
        {"id": 1, "title": "ok", "assignedTo": oid(30), "estimatedHours": Decimal(1000)},
        {"id": 2, "estimatedHours": Decimal(-1)},
        {"id": 3, "title": "x", "estimatedHours": Decimal("1000.5")},
        {"id": 4, "title": "x", "assignedTo": oid(20)},
        {"id": 5, "title": "x", "assignedTo": oid(99)},
        {"id": 6, "type": B + "WorkItem"},
    )
    assert problems(validate(st, tasks, "Task")) == [
        (2, "structural", "title", "a value for title is missing"),
        (3, "shapes", "estimatedHours", "above the greatest value 1000"),
        (4, "structural", "assignedTo", f"{oid(20)} is a {B}Project; a {B}Person was asked for"),
        (5, "structural", "assignedTo", f"nothing has the id {oid(99)}"),
        (6, "structural", "", f"{B}WorkItem only groups other types"),
    ]


def test_patterns_hold_for_every_element(spark, st):
    from domain import rows

    people = rows(spark, "Person", {"id": 1, "name": "a", "badges": ["AB-0001", "nope"]}, {"id": 2, "name": "b", "badges": []}, {"id": 3, "name": "c"})
    assert [p[0] for p in problems(validate(st, people, "Person"))] == [1]


RAW = [
    ('{"title":"t","priority":5,"estimatedHours":"1.50","dueDate":"2024-02-29","urgent":true,"notes":["a"],"assignedTo":"%s"}' % oid(30).upper(), None),
    ('{"title":null,"priority":null}', None),
    ('{"title":5}', ("title", "not text")),
    ('{"priority":"5"}', ("priority", "not a whole number")),
    ('{"priority":5.0}', None),
    ('{"estimatedHours":true}', ("estimatedHours", "not a number")),
    ('{"urgent":"true"}', ("urgent", "neither true nor false")),
    ('{"dueDate":"2024-02-30"}', ("dueDate", "not a date like 2024-02-29")),
    ('{"dueDate":20240229}', ("dueDate", "a date is written as text")),
    ('{"notes":"a"}', ("notes", "a list is due, not one value")),
    ('{"title":["a"]}', ("title", "one value is due, not a list")),
    ('{"zzz":1}', ("zzz", "no property is called zzz")),
    ('{"zzz":null}', None),
    ('{"%spriority":3}' % B, None),
    ("[1]", ("", "not an object")),
    ("{", ("", "not an object")),
]


def test_coercion(spark, st):
    df = spark.createDataFrame([(str(i), r) for i, (r, _) in enumerate(RAW)], "id string, raw string")
    good, bad = coerce(st, df, "Task")
    assert {r["id"]: (r["property"], r["message"]) for r in bad.collect()} == {str(i): v for i, (_, v) in enumerate(RAW) if v}
    rows = {r["id"]: r for r in good.collect()}
    assert set(rows) == {str(i) for i, (_, v) in enumerate(RAW) if not v}
    assert (rows["0"]["priority"], rows["0"]["estimatedHours"], rows["0"]["notes"], rows["0"]["assignedTo"]) == (5, Decimal("1.5"), ["a"], oid(30))
    assert rows["4"]["priority"] == 5 and rows["13"]["priority"] == 3 and rows["1"]["title"] is None


def test_one_problem_rejects_the_whole_record(spark, st):
    df = spark.createDataFrame([("1", '{"title":"ok","openTaskCount":1,"owner":3}')], "id string, raw string")
    good, bad = coerce(st, df, "Project")
    assert good.count() == 0
    assert {(r["property"], r["message"]) for r in bad.collect()} == {
        ("openTaskCount", "openTaskCount is worked out and cannot be given"),
        ("owner", "not a UUID"),
    }


def test_read_only_without_a_rule(spark, st):
    _, bad = coerce(st, spark.createDataFrame([("1", '{"name":"x","workload":1}')], "id string, raw string"), "Person")
    assert bad.first()["message"] == "workload cannot be given"
    assert SCHEMA.derived("Person") == {} and F is not None
