"""Dependent rollups and reactions settle however long their chain is."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from typeloom.model import Action, Machine, Property, Rollup, Schema, Transition, TypeDef
from typeloom.sources.store import ObjectStore, table_schema
from typeloom.streaming.maintain import Maintainer, NeverSettles

B = "https://crates.example/t#"
AT = datetime(2024, 5, 1)
CRATE = TypeDef(B + "Crate", properties=(Property(B + "mark"), Property(B + "inside", target="Crate"), Property(B + "unsealed", datatype="long", read_only=True)))
RULE = Rollup("unsealed", "Crate", "Crate", "inside", "COUNT", where=("mark", "ne", "sealed"), materialised=True)
SEAL = Transition("seal", "Open", "Sealed", "ON_CHANGE", guard="self.unsealed = 0", watch=("inside",), actions=(Action("set_property", property="mark", literal="sealed"),))


def crates(spark, n, machine):
    """Crate k lies in crate k + 1; each but the first waits for the one inside."""
    schema = Schema((CRATE,), (RULE,), (machine,))
    shape = table_schema(schema, "Crate")
    rows = []
    for k in range(1, n + 1):
        own = {"id": f"c{k:02}", "tenant": "t", "type": B + "Crate", "version": 1, "state": "Open", "created_at": AT, "updated_at": AT, "mark": "loose"}
        own |= {"inside": f"c{k + 1:02}" if k < n else None, "unsealed": int(k > 1)}
        rows.append(tuple(own.get(f.name) for f in shape.fields))
    return ObjectStore(spark, schema, {"Crate": lambda: spark.createDataFrame(rows, shape)}, "t")


def change(spark, store):
    row = store.table("Crate").where("id = 'c01'")
    return row.select(
        F.lit("s1").alias("changeset_id"), F.lit(0).alias("seq"), F.lit("update").alias("op"), "id", "type", F.lit(1).cast("long").alias("expected_version"),
        F.lit("Sealed").alias("state"), F.lit(AT).alias("at"), F.lit("x").alias("by"), F.lit("sealed").alias("mark"), "inside", "unsealed",
    )


def test_nine_dependent_reactions_settle(spark, tmp_path):
    machine = Machine("Crate", "Open", ("Open", "Sealed"), (SEAL,))
    store = crates(spark, 9, machine)
    keeper = Maintainer(store, ("Crate",), str(tmp_path), (machine,))
    keeper.process(change(spark, store), 0)
    got = {r["id"]: (r["state"], r["mark"], r["unsealed"]) for r in keeper.store().scan("Crate").collect()}
    assert got == {f"c{k:02}": ("Sealed", "sealed", 0) for k in range(1, 10)}


def test_reactions_that_go_round_raise(spark, tmp_path):
    back = Transition("unseal", "Sealed", "Open", "ON_CHANGE", watch=("inside",))
    machine = Machine("Crate", "Open", ("Open", "Sealed"), (SEAL, back))
    store = crates(spark, 2, machine)
    with pytest.raises(NeverSettles):
        Maintainer(store, ("Crate",), str(tmp_path), (machine,), rounds=3).process(change(spark, store), 0)
