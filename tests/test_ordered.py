"""The chunked fold against a plain loop, with one object holding most of the rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from typeloom.operators.lifecycle import fold, timers_due, transition_log
from typeloom.plans.demo import ACCOUNT_MACHINE

T0 = datetime(2024, 1, 1)


def commands(seed, n=3000, hot=0.6, objects=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        who = "hot" if rng.random() < hot else f"o{rng.randrange(objects)}"
        at = T0 + timedelta(seconds=rng.randrange(5_000_000))
        out.append((who, at, i, rng.choice(["signup", "error", "click", "purchase", "view", "other"]), float(rng.randrange(200))))
    return out


def loop(rows):
    state, out = {}, {}
    for who, at, seq, c, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        was = state.get(who, "Visitor")
        step = next((t for t in ACCOUNT_MACHINE.transitions if t.source == was and t.name == c and (c != "purchase" or v < 100)), None)
        state[who] = step.target if step else was
        out[seq] = (was, state[who], step is not None)
    return out


@pytest.mark.parametrize("seed,partitions,batch", [(1, 7, 10_000), (2, 16, 10), (3, 1, 37), (4, 30, 10_000)])
def test_fold_equals_a_loop(spark, seed, partitions, batch):
    rows = commands(seed)
    df = spark.createDataFrame(rows, "id string, ts timestamp, seq long, command string, value double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = fold(df, ACCOUNT_MACHINE, partitions=partitions)
        result = {r["seq"]: (r["from_state"], r["to_state"], r["fired"]) for r in got.collect()}
        chunks = got.where("id = 'hot'").select("_chunk").distinct().count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert result == loop(rows)
    assert partitions == 1 or chunks > 1  # the hot object was really spread


def test_borders_are_scanned_like_rows(spark):
    """More chunks of one key than a single task may scan the borders of."""
    from typeloom.operators.ordered import fold_states

    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.8 else f"o{rng.randrange(9)}", i, rng.randrange(3)) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, seq long, step int")
    # Each step leads from state s to (2 s + step) mod 3.
    moves = [(2 * s + F.col("step")) % 3 for s in range(3)]
    got = fold_states(df, "id", ["seq"], ["0", "1", "2"], moves, "0", partitions=60, borders=10)
    state, want = {}, {}
    for who, i, step in rows:
        was = state.get(who, 0)
        state[who] = (2 * was + step) % 3
        want[i] = (str(was), str(state[who]))
    assert {r["seq"]: (r["from_state"], r["to_state"]) for r in got.collect()} == want


def test_timers_over_chunk_borders(spark):
    rows = commands(5)
    df = spark.createDataFrame(rows, "id string, ts timestamp, seq long, command string, value double")
    history = fold(df, ACCOUNT_MACHINE, partitions=12)
    fired = transition_log(history).orderBy("id", "ts", "seq").collect()
    as_of = T0 + timedelta(days=50)
    want = set()
    for i, r in enumerate(fired):
        nxt = fired[i + 1]["ts"] if i + 1 < len(fired) and fired[i + 1]["id"] == r["id"] else None
        due = r["ts"] + timedelta(hours=36)
        if r["to_state"] == "Blocked" and (nxt is None or nxt > due) and due <= as_of:
            want.add((f"{r['id']}|Blocked|lapse", due))
    got = timers_due(history, ACCOUNT_MACHINE, F.lit(as_of))
    assert {(r["timer_key"], r["due_at"]) for r in got.collect()} == want


def test_nothing_to_fold(spark):
    df = spark.createDataFrame([], "id string, ts timestamp, seq long, command string, value double")
    assert fold(df, ACCOUNT_MACHINE).count() == 0


def test_batches_of_a_feed_continue_each_other(spark, tmp_path):
    from typeloom.streaming.histories import HistoryKeeper

    rows = sorted(commands(8, n=600), key=lambda r: (r[1], r[2]))
    shape = "id string, ts timestamp, seq long, command string, value double"
    keeper = HistoryKeeper(spark, ACCOUNT_MACHINE, str(tmp_path))
    for i in range(3):
        keeper.process(spark.createDataFrame(rows[i * 200 : (i + 1) * 200], shape), i)
    keeper.process(spark.createDataFrame(rows[200:400], shape), 1)  # handed over again
    want = {s: (a, b) for s, (a, b, fired) in loop(rows).items() if fired}
    got = spark.read.parquet(str(tmp_path / "log"))
    assert {r["seq"]: (r["from_state"], r["to_state"]) for r in got.collect()} == want
    assert got.count() == len(want)
