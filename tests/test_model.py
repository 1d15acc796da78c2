from datetime import timedelta

import pytest
from domain import B, SCHEMA, p

from typeloom.functions.timing import parse_duration
from typeloom.model import Rollup, Schema, SchemaError, TypeDef, short_name
from typeloom.operators.rollup import register_plugin, run_plugin


def test_closure_and_inheritance():
    assert [t.name for t in SCHEMA.concrete("WorkItem")] == ["Task", "Project"]
    assert SCHEMA.is_subtype("Task", "Deliverable") and not SCHEMA.is_subtype("Person", "WorkItem")
    assert {x.name for x in SCHEMA.properties("Task")} >= {"title", "status", "priority"}
    assert SCHEMA.lookup("Task", B + "priority") is SCHEMA.lookup("Task", "priority")
    assert SCHEMA.lookup("WorkItem", "owner").target == "Person"


def test_cycles_in_supertypes_end():
    s = Schema((TypeDef("a#A", ("a#B",)), TypeDef("a#B", ("a#A",))))
    assert s.is_subtype("A", "B") and s.is_subtype("B", "A")


def test_same_property_with_two_types_is_rejected():
    with pytest.raises(SchemaError):
        Schema((TypeDef("a#A", properties=(p("x"),)), TypeDef("a#B", properties=(p("x", datatype="long"),))))


def test_aggregates_need_numbers():
    for of in ("dueDate", "title", "notes", "assignedTo", "nothing"):
        with pytest.raises(SchemaError):
            Schema(SCHEMA.types, (Rollup("x", "Project", "Task", "belongsToProject", "MIN", of),))


def test_short_names():
    assert [short_name(x) for x in ("a/b#c", "a/b", "a")] == ["c", "b", "a"]


def test_durations():
    assert parse_duration("PT72H") == timedelta(hours=72)
    assert parse_duration("P1DT2H3M4.5S") == timedelta(days=1, hours=2, minutes=3, seconds=4.5)
    for bad in ("72H", "P", "PT"):
        with pytest.raises(ValueError):
            parse_duration(bad)


def test_plugins_cannot_be_maintained_and_must_exist():
    with pytest.raises(ValueError):
        register_plugin("x", lambda c, t: t, maintained=True)
    with pytest.raises(KeyError):
        run_plugin(None, "no such plug-in", None)
    with pytest.raises(SchemaError):
        Schema(SCHEMA.types, SCHEMA.rollups, (), {"openTaskCount": "x"})


def test_column_names_must_be_usable():
    for names in (("version",), ("at",), ("a-b",), ("x", "X")):
        with pytest.raises(SchemaError):
            Schema((TypeDef("a#A", properties=tuple(p(n) for n in names)),))
