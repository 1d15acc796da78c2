"""Lifecycles kept per object in the state store, with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import templates
from ..functions.timing import parse_duration
from ..model import Machine

FIRED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("transition", T.StringType()),
        T.StructField("from_state", T.StringType()),
        T.StructField("to_state", T.StringType()),
        T.StructField("at", T.TimestampType()),
    ]
)
# The operator needs this state store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "state string, entered_us long"


def _micros(ts: datetime) -> int:
    whole = ts.replace(tzinfo=timezone.utc) if ts.tzinfo is None else ts
    return round(whole.timestamp() * 1_000_000)


class _Lifecycle(StatefulProcessor):
    """Looks moves up in the machine; guards were worked out as columns before."""

    def __init__(self, initial: str, moves: dict, timers: dict) -> None:
        self.initial = initial
        self.moves = moves  # (state, command) -> [(guard column position, target, name)]
        self.timers = timers  # state -> (transition, microseconds, target)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("lifecycle", _STATE)

    def _fired(self, key, seq, name, source, target, us) -> Row:
        at = datetime.fromtimestamp(us // 1_000_000, tz=timezone.utc).replace(microsecond=us % 1_000_000, tzinfo=None)
        return Row(id=key[0], seq=seq, transition=name, from_state=source, to_state=target, at=at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.value.get() if self.value.exists() else None
        state, entered = (kept[0], kept[1]) if kept else (self.initial, 0)
        before = (state, entered)
        for us, seq, command, holds in sorted((r["us"], r["seq"], r["command"], r["holds"]) for r in rows):
            timer = self.timers.get(state)
            if timer and us > entered + timer[1]:
                # The timer ran out before this command, whatever the watermark says yet.
                due = entered + timer[1]
                yield self._fired(key, None, timer[0], state, timer[2], due)
                state, entered = timer[2], due
            for bit, target, name in self.moves.get((state, command), ()):
                if bit is None or holds >> bit & 1:
                    yield self._fired(key, seq, name, state, target, us)
                    state, entered = target, us
                    break
        if (state, entered) != before or kept is None:
            if before[0] in self.timers and kept is not None:
                self.handle.deleteTimer(self._millis(before[1] + self.timers[before[0]][1]))
            self.value.update((state, entered))
            if state in self.timers:
                self.handle.registerTimer(self._millis(entered + self.timers[state][1]))

    @staticmethod
    def _millis(us: int) -> int:
        return -(-us // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, entered = self.value.get()
        timer = self.timers.get(state)
        if timer is None or self._millis(entered + timer[1]) != expiredTimerInfo.getExpiryTimeInMs():
            return
        due = entered + timer[1]
        yield self._fired(key, None, timer[0], state, timer[2], due)
        self.value.update((timer[2], due))

    def close(self) -> None:
        pass


def lifecycle_stream(commands: DataFrame, machine: Machine, timed: bool = False, delay: str | None = None) -> DataFrame:
    """Fired transitions of a stream of commands (id, ts, seq, command and the guards' columns).

    One object's rows meet in one task per micro-batch, which the source's size limit bounds.
    Commands of one object are taken in time order inside a micro-batch and in order of arrival
    across batches. With ``timed`` the machine's timers run on event time, and commands that are later than
    ``delay`` behind the newest are dropped by the state store: it has to be named, and must cover
    the lateness of the source.
    """
    if timed and delay is None:
        raise ValueError("timers need a delay: commands later than that are lost")
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    guards: list[Column] = []
    moves: dict[tuple[str, str], list[tuple[int | None, str, str]]] = {}
    for _, t in machine.leaving():
        if t.trigger not in ("USER_ACTION", "EXTERNAL_SIGNAL"):
            continue
        bit = None
        if t.guard is not None:
            bit = len(guards)
            guards.append(F.when(templates.guard(t.guard), F.lit(1 << bit)).otherwise(F.lit(0)))
        moves.setdefault((t.source, t.name), []).append((bit, t.target, t.name))
    holds = F.lit(0)
    for g in guards:
        holds = holds + g
    timers = {}
    if timed:
        for _, t in machine.leaving("TIMER"):
            timers[t.source] = (t.name, int(parse_duration(t.after).total_seconds() * 1_000_000), t.target)
        commands = commands.withWatermark("ts", delay)
    slim = commands.select("id", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), "command", holds.cast("long").alias("holds"))
    return slim.groupBy("id").transformWithState(
        _Lifecycle(machine.initial, moves, timers), FIRED, "append", "eventTime" if timed else "none"
    )
