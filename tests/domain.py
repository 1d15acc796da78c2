"""A small domain of tasks, projects and people for behaviour tests."""

from __future__ import annotations

from datetime import datetime

from typeloom.model import ENVELOPE, Machine, Property, Rollup, Schema, Transition, TypeDef
from typeloom.sources.store import ObjectStore, table_schema

B = "https://work.example/schema#"


def p(name, **kw):
    return Property(B + name, **kw)


TYPES = (
    TypeDef(B + "Deliverable", abstract=True, properties=(p("title", min=1, searchable=True, display_label=True), p("notes", max=None, searchable=True))),
    TypeDef(B + "WorkItem", (B + "Deliverable",), abstract=True, properties=(p("status", facet=True, indexed=True),)),
    TypeDef(
        B + "Task",
        (B + "WorkItem",),
        properties=(
            p("priority", datatype="long"),
            p("estimatedHours", datatype="decimal", min_value="0", max_value="1000"),
            p("dueDate", datatype="date"),
            p("urgent", datatype="boolean"),
            p("assignedTo", target="Person", facet=True),
            p("belongsToProject", target="Project", inverse="hasTask"),
        ),
    ),
    TypeDef(
        B + "Project",
        (B + "WorkItem",),
        properties=(
            p("owner", target="Person"),
            p("openTaskCount", datatype="long", read_only=True),
            p("totalEstimatedHours", datatype="decimal", read_only=True),
        ),
    ),
    TypeDef(
        B + "Person",
        properties=(p("name", min=1, display_label=True), p("badges", max=None, pattern="^[A-Z]{2}-[0-9]{4}$"), p("workload", datatype="decimal", read_only=True)),
    ),
)
RULES = (
    Rollup("openTaskCount", "Project", "Task", "belongsToProject", "COUNT", where=({"path": "status", "op": "is not", "value": "done"},), materialised=True),
    Rollup("totalEstimatedHours", "Project", "Task", "belongsToProject", "SUM", "estimatedHours"),
)
# From an idea to a review that somebody has to answer within a week.
MACHINE = Machine(
    "Project",
    "Idea",
    ("Idea", "Running", "Review", "Done", "Dropped"),
    (
        Transition("begin", "Idea", "Running", guard="self.owner IS NOT NULL"),
        Transition("hand_in", "Running", "Review"),
        Transition("send_back", "Review", "Running"),
        Transition("accept", "Review", "Done"),
        Transition("nothingLeft", "Running", "Review", "ON_CHANGE", guard="self.openTaskCount = 0", watch=("belongsToProject",)),
        Transition("forgotten", "Review", "Dropped", "TIMER", after="P7D"),
        Transition("revive", "Dropped", "Idea", "EXTERNAL_SIGNAL", signal="revive"),
    ),
)
SCHEMA = Schema(TYPES, RULES, (MACHINE,))


def oid(n: int) -> str:
    return f"00000000-0000-4000-8000-{n:012x}"


def rows(spark, type_name: str, *objects: dict):
    """A table of one type from short dicts; ids are given as numbers."""
    shape = table_schema(SCHEMA, type_name)
    out = []
    for o in objects:
        n = o["id"]
        at = datetime(2024, 1, 1, 0, n % 60)
        base = {"tenant": "t1", "type": B + type_name, "version": 1, "created_at": at, "created_by": "x", "updated_at": at, "updated_by": "x"}
        full = {**{f.name: None for f in shape.fields}, **base, **o, "id": oid(n)}
        out.append(tuple(full[f.name] for f in shape.fields))
    return spark.createDataFrame(out, shape)


def make_store(spark, tenant="t1", **tables) -> ObjectStore:
    full = {n: tables.get(n, []) for n in ("Task", "Project", "Person")}
    return ObjectStore(spark, SCHEMA, {n: (lambda n=n, o=o: rows(spark, n, *o)) for n, o in full.items()}, tenant)


__all__ = ["B", "ENVELOPE", "MACHINE", "RULES", "SCHEMA", "make_store", "oid", "rows"]
