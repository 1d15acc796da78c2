"""Rollups moved by differences equal rollups of the tables, whatever comes, goes or moves."""

import random

from domain import make_store, oid
from pyspark.sql import functions as F

from typeloom.model import Rollup
from typeloom.streaming.deltas import SIGN, DeltaRollups

RULES = [
    Rollup("n", "Project", "Task", "belongsToProject", "COUNT", where=({"path": "status", "op": "is not", "value": "done"},)),
    Rollup("total", "Project", "Task", "belongsToProject", "SUM", "estimatedHours"),
    Rollup("least", "Project", "Task", "belongsToProject", "MIN", "priority"),
    Rollup("most", "Project", "Task", "belongsToProject", "MAX", "dueDate", where=({"path": "status", "op": "is not", "value": "done"},)),
    Rollup("mean", "Project", "Task", "belongsToProject", "AVG", "priority"),
    Rollup("load", "Person", "Task", "assignedTo", "SUM", "priority"),
]


def tables(rng, k):
    """The tasks after each of ``k`` batches; many share one project, values repeat, some are null."""
    from datetime import date
    from decimal import Decimal

    out, now = [], {}
    for _ in range(k):
        for n in rng.sample(range(40), 12):
            if n in now and rng.random() < 0.3:
                del now[n]
                continue
            now[n] = {
                "id": n, "title": "t", "status": rng.choice(["open", "done", None]), "priority": rng.choice([None, 1, 2, 3]),
                "estimatedHours": rng.choice([None, Decimal("1.50"), Decimal("2.25")]), "dueDate": rng.choice([None, date(2024, 1, rng.randint(1, 9))]),
                "belongsToProject": rng.choice([None, oid(50), oid(50), oid(50), oid(51), oid(52)]), "assignedTo": rng.choice([None, oid(60), oid(61)]),
            }
        out.append(dict(now))
    return out


def signed(old, new):
    def side(store, sign):
        return store.scan("Task").withColumn(SIGN, F.lit(sign))

    # Unchanged objects are in both images and cancel.
    return [side(old, -1).unionByName(side(new, 1))]


def plain(tasks, rule):
    """The rollup of live tasks in plain Python; targets without a value are left out."""
    groups = {}
    for t in tasks.values():
        counts = not rule.where or t["status"] != "done"
        value = 1 if rule.function == "COUNT" else t[rule.of]
        if t[rule.via] is not None and counts and value is not None:
            groups.setdefault(t[rule.via], []).append(value)
    work = {"COUNT": len, "SUM": sum, "MIN": min, "MAX": max, "AVG": lambda v: sum(v) / len(v)}[rule.function]
    return {i: work(v) for i, v in groups.items()}


def test_batches_equal_whole_tables(spark, tmp_path):
    history = tables(random.Random(7), 4)
    stores = [make_store(spark, Task=list(t.values()), Project=[{"id": 50}], Person=[]) for t in history]
    keeper = DeltaRollups(stores[0], RULES, str(tmp_path), buckets=4, compact=2)  # the third batch merges the state
    for batch, (old, new) in enumerate(zip(stores, stores[1:])):
        for _ in range(2 if batch == 1 else 1):  # one batch is handed over twice
            keeper.begin(batch)
            changed = {g: v.collect() for g, v in keeper.apply(signed(old, new), new, batch, 0).items()}
        for r in RULES:
            want = plain(history[batch + 1], r)
            for row in changed[f"{r.source}.{r.via}"]:
                assert (row[r.property] or None) == want.pop(row["id"], None), (batch, r)
            assert not want, (batch, r)  # every target of these tables is touched in each batch
    values = {g: v.collect() for g, v in keeper.values(2).items()}
    for r in RULES:
        got = {row["id"]: row[r.property] for row in values[f"{r.source}.{r.via}"] if row[r.property]}
        assert got == plain(history[-1], r), r


def test_a_step_reads_only_its_buckets(spark, tmp_path):
    tasks = [{"id": n, "title": "t", "status": "open", "belongsToProject": oid(100 + n)} for n in range(64)]
    base = make_store(spark, Task=tasks, Project=[], Person=[])
    keeper = DeltaRollups(base, [RULES[0]], str(tmp_path), buckets=16)
    keeper.begin(0)
    state = keeper._state("Task.belongsToProject", 0, 0, -1, [3])
    assert "PartitionFilters: [isnotnull(bucket" in state._jdf.queryExecution().toString()
    assert 0 < state.count() < 64


def test_nothing_pointed_at_and_no_rows(spark, tmp_path):
    empty = make_store(spark, Task=[], Project=[], Person=[])
    keeper = DeltaRollups(empty, [RULES[0]], str(tmp_path), buckets=2)
    keeper.begin(0)
    assert keeper.apply(signed(empty, empty), empty, 0, 0) == {}
    assert keeper.values(0)["Task.belongsToProject"].count() == 0
