"""References: the bad ones are stored, so that rows meet one join for each property."""

from typeloom.operators import validate as V


def test_rows_meet_one_join_for_each_property(spark, store):
    found = V.references(store, store.scan("Part").select("id", "type", "related", "partOf"), "Part")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert {r["property"] for r in found.collect()} == {"related", "partOf"}
