from datetime import datetime, timedelta

import pytest
from domain import B, MACHINE, make_store, oid
from pyspark.sql import functions as F

from typeloom.functions import templates
from typeloom.functions.ids import name_uuid
from typeloom.model import Action, Machine, Transition
from typeloom.operators import lifecycle as L

AT = datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def st(spark):
    return make_store(
        spark,
        Project=[
            {"id": 1, "title": "d", "state": "Idea"},
            {"id": 2, "title": "d2", "state": "Idea", "owner": oid(30)},
            {"id": 3, "title": "a", "state": "Running", "openTaskCount": 0},
            {"id": 4, "title": "a2", "state": "Running", "openTaskCount": 2},
            {"id": 5, "title": "c", "state": "Dropped"},
            {"id": 6, "title": "none"},
        ],
    )


def n(i):
    return int(i[-4:], 16)


def test_available_transitions_and_reasons(st):
    got = {(n(r["id"]), r["transition"]): (r["available"], r["reason"]) for r in L.available(st.scan("Project"), MACHINE).collect()}
    assert got[(1, "begin")] == (False, "the condition of begin does not hold")
    assert got[(2, "begin")] == (True, None)
    assert got[(3, "nothingLeft")] == (True, None) and got[(4, "nothingLeft")][0] is False
    assert not any(k[0] == 6 for k in got)


def test_commands(spark, st):
    c = spark.createDataFrame(
        [
            (1, oid(1), "begin", 1, AT), (2, oid(2), "begin", 1, AT), (3, oid(2), "begin", 1, AT), (4, oid(3), "hand_in", 9, AT),
            (5, oid(3), "nothingLeft", 1, AT), (6, oid(4), "send_back", 1, AT), (7, oid(9), "hand_in", 1, AT), (8, oid(5), "revive", 1, AT),
        ],
        "command_id long, id string, transition string, expected_version long, at timestamp",
    )
    got = {r["command_id"]: r["status"] for r in L.fire(st.scan("Project"), c, MACHINE).collect()}
    assert got == {1: "guard", 2: "fired", 3: "stale", 4: "stale", 5: "unavailable", 6: "unavailable", 7: "not_found", 8: "unavailable"}


def test_a_command_that_fails_does_not_make_the_next_one_stale(spark, st):
    c = spark.createDataFrame([(1, oid(4), "send_back", 1, AT), (2, oid(4), "hand_in", 1, AT)], "command_id long, id string, transition string, expected_version long, at timestamp")
    assert {r["command_id"]: r["status"] for r in L.fire(st.scan("Project"), c, MACHINE).collect()} == {1: "unavailable", 2: "fired"}


def test_on_change_through_the_object_itself_and_watched_references(spark, st):
    image = "struct<belongsToProject:string>"
    changes = spark.createDataFrame(
        [(oid(50), B + "Task", (oid(9),), (oid(3),)), (oid(51), B + "Task", (oid(4),), None), (oid(5), B + "Project", None, (None,))],
        f"id string, type string, before {image}, after {image}",
    )
    cand = L.watch_candidates(st, changes, MACHINE)
    # Written objects count themselves; a deleted one only speaks for what it pointed at.
    assert {n(r["id"]) for r in cand.collect()} == {50, 3, 4, 5}
    fired = L.fire_on_change(st.scan("Project"), cand, MACHINE, F.lit(AT)).collect()
    assert [(n(r["id"]), r["transition"], r["to_state"], r["version"]) for r in fired] == [(3, "nothingLeft", "Review", 2)]


def test_first_declared_transition_wins(spark, st):
    m = Machine("Project", "Idea", ("Running", "X", "Y"), (
        Transition("one", "Running", "X", "ON_CHANGE", guard="self.openTaskCount = 2"),
        Transition("two", "Running", "Y", "ON_CHANGE"),
    ))
    fired = L.fire_on_change(st.scan("Project"), st.scan("Project").select("id"), m, F.lit(AT))
    assert {n(r["id"]): r["transition"] for r in fired.collect()} == {3: "two", 4: "one"}


def test_signals(spark, st):
    s = spark.createDataFrame([(1, oid(5), "revive", AT), (2, oid(5), "revive", AT), (3, oid(3), "revive", AT), (4, oid(3), "what", AT)], "signal_id long, id string, signal string, at timestamp")
    fired, unknown = L.fire_signals(st.scan("Project"), s, MACHINE)
    rows = fired.collect()
    assert [(n(r["id"]), r["to_state"], r["at"], r["self"]["title"]) for r in rows] == [(5, "Idea", AT, "c")]
    assert [r["signal_id"] for r in unknown.collect()] == [4]


def test_actions_see_the_object_as_it_was(spark, st):
    m = Machine("Project", "Idea", ("Idea", "Running"), (
        Transition("begin", "Idea", "Running", actions=(
            Action("set_property", property="status", expression="concat('was ', self.state)"),
            Action("create_object", create_type="Task", assignments=(("title", "concat('Plan for ', self.title)"), ("belongsToProject", "self.id"))),
            Action("log", message="${self.title}|${self.owner}|${1 + 1}"),
        )),
    ))
    c = spark.createDataFrame([(1, oid(1), "begin", 1, AT)], "command_id long, id string, transition string, expected_version long, at timestamp")
    fired = L.fire(st.scan("Project"), c, m).where("status = 'fired'")
    assert [tuple(r) for r in L.set_properties(st, st.scan("Project"), fired, m).collect()] == [(oid(1), "status", None, "was Idea")]
    entry = F.lit("11111111-2222-3333-4444-555555555555")
    task = L.create_objects(st, fired, m, entry)["Task"]
    r = task.first()
    assert (r["title"], r["belongsToProject"], r["state"], r["version"]) == ("Plan for d", oid(1), None, 1)
    assert L.create_objects(st.with_table("Task", task), fired, m, entry)["Task"].count() == 0  # running again creates nothing
    assert L.messages(fired, m).first()["text"] == "d||2"


def test_guards_that_are_not_true_are_false(spark):
    df = spark.createDataFrame([(1, "x", None)], "a int, b string, c boolean")
    for g, want in (("self.a = 1", True), ("self.c", False), ("self.b", False), ("self.a", False), ("self.c IS NULL", True), (None, True)):
        assert df.select(templates.guard(g)).first()[0] is want


def test_name_based_uuid(spark):
    import hashlib
    import uuid

    names = [f"{i}:x{i}" for i in range(200)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in names], "n string").select(name_uuid(F.col("n"))).collect()]
    assert got == [str(uuid.UUID(bytes=hashlib.md5(x.encode()).digest(), version=3)) for x in names]


def test_streamed_timers_equal_a_loop(spark, tmp_path):
    """Commands in several files; timers fire between commands and after the last one."""
    from test_ordered import commands

    from typeloom.plans.demo import ACCOUNT_MACHINE
    from typeloom.streaming.lifecycle import lifecycle_stream
    from typeloom.streaming.streams import read_feed, run_to_table

    rows = sorted(commands(9, n=400, hot=0.3, objects=6), key=lambda r: (r[1], r[2]))
    shape = "id string, ts timestamp, seq long, command string, value double"
    for i in range(4):
        spark.createDataFrame(rows[i * 100 : (i + 1) * 100], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = read_feed(spark, str(tmp_path / "feed"), shape, files_per_batch=1)
    got = run_to_table(lifecycle_stream(feed, ACCOUNT_MACHINE, timed=True, delay="0 seconds"), "timers-test")
    state, want, end = {}, [], rows[-1][1]
    hold = timedelta(hours=36)
    for who, at, seq, c, v in rows:
        s, since = state.get(who, ("Visitor", None))
        if s == "Blocked" and at > since + hold:
            want.append((who, "lapse", since + hold))
            s, since = "Visitor", since + hold
        t = next((t for t in ACCOUNT_MACHINE.transitions if t.source == s and t.name == c and (c != "purchase" or v < 100)), None)
        if t:
            want.append((who, c, at))
            s, since = t.target, at
        state[who] = (s, since)
    want += [(w, "lapse", since + hold) for w, (s, since) in state.items() if s == "Blocked" and since + hold <= end]
    assert sorted((r["id"], r["transition"], r["at"]) for r in got.collect()) == sorted(want)
