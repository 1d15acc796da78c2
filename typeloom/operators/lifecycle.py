"""State machines over object tables: availability, firing, history, timers, signals, actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import templates
from ..functions.ids import derived_id, name_uuid
from ..functions.timing import plus, timer_key
from ..model import ENVELOPE, Action, Machine, Transition
from ..session import materialise
from ..sources.store import ObjectStore
from .ordered import fold_states, next_in_order

FIRED_COLUMNS = ("id", "tenant", "type", "version", "transition", "from_state", "to_state", "at", "self")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def available(objects: DataFrame, machine: Machine) -> DataFrame:
    """(id, transition, available, reason) for transitions leaving each object's state.

    The machine is unrolled into the expression, so the rows are neither joined nor moved.
    """
    cells = []
    for _, t in machine.leaving():
        holds = templates.guard(t.guard)
        reason = F.when(~holds, F.lit(t.message or f"the condition of {t.name} does not hold"))
        cells.append(
            F.when(
                F.col("state") == t.source,
                F.struct(F.lit(t.name).alias("transition"), holds.alias("available"), reason.alias("reason")),
            )
        )
    rows = objects.select("id", F.explode(F.array_compact(F.array(*cells))).alias("t"))
    return rows.select("id", "t.transition", "t.available", "t.reason")


def _own(objects: DataFrame) -> Column:
    """The object as it was before the transition, for guards, actions and the history."""
    return F.struct(*objects.columns)


def _first_match(machine: Machine, trigger: str, extra=lambda t: F.lit(True)) -> Column:
    """The first transition, in declared order, that leaves the state and whose guard holds."""
    cells = [
        F.when(
            (F.col("state") == t.source) & templates.guard(t.guard) & extra(t),
            F.struct(F.lit(t.name).alias("transition"), F.lit(t.target).alias("to_state")),
        )
        for _, t in machine.leaving(trigger)
    ]
    return F.coalesce(*cells) if cells else F.lit(None).cast("struct<transition:string,to_state:string>")


def _fired(rows: DataFrame, move: Column, at: Column) -> DataFrame:
    own = _own(rows.drop("_at"))
    hit = rows.withColumn("_self", own).withColumn("_move", move).where(F.col("_move").isNotNull())
    return hit.select(
        "id",
        "tenant",
        "type",
        (F.col("version") + 1).alias("version"),
        F.col("_move.transition").alias("transition"),
        F.col("state").alias("from_state"),
        F.col("_move.to_state").alias("to_state"),
        at.alias("at"),
        F.col("_self").alias("self"),
    )


def fire(objects: DataFrame, commands: DataFrame, machine: Machine) -> DataFrame:
    """Decide user commands (command_id, id, transition, expected_version, at).

    Each command gets a status: fired, not_found, stale, unavailable (no such user transition in
    this state) or guard. Commands on one object are decided in the order (at, command_id): the
    first that can fire moves the version on, which makes later ones stale.
    """
    users = [t for _, t in machine.leaving("USER_ACTION")]
    state = F.col("state")
    leaves = _any([(state == t.source) & (F.col("transition") == t.name) for t in users])
    holds = _any([(state == t.source) & (F.col("transition") == t.name) & templates.guard(t.guard) for t in users])
    target = F.coalesce(*[F.when((state == t.source) & (F.col("transition") == t.name), F.lit(t.target)) for t in users])
    rows = commands.join(objects.withColumn("_known", F.lit(True)), "id", "left")
    status = (
        F.when(F.col("_known").isNull(), F.lit("not_found"))
        .when(F.col("version") != F.col("expected_version"), F.lit("stale"))
        .when(~F.coalesce(leaves, F.lit(False)), F.lit("unavailable"))
        .when(~F.coalesce(holds, F.lit(False)), F.lit("guard"))
        .otherwise(F.lit("fired"))
    )
    own = F.struct(*objects.columns)
    judged = rows.select(
        "command_id", "id", "transition", "at", "tenant", "type", status.alias("status"), (F.col("version") + 1).alias("version"),
        state.alias("from_state"), target.alias("to_state"), own.alias("self"),
    )
    turn = F.struct("at", "command_id")
    winners = judged.where(F.col("status") == "fired").groupBy("id").agg(F.min(turn).alias("_first"))
    late = F.col("_first").isNotNull() & (turn > F.col("_first")) & (F.col("status") != "not_found")
    return judged.join(winners, "id", "left").withColumn("status", F.when(late, F.lit("stale")).otherwise(F.col("status"))).drop("_first")


def fire_sequence(objects: DataFrame, commands: DataFrame, machine: Machine) -> DataFrame:
    """Decide user commands that may build on each other, with the columns of :func:`fire`.

    Commands on one object are decided in the order (at, command_id), each against the state and version that the
    fired ones before it have left. A round decides all commands up to the first of each object that fires;
    the later ones go on with the object as moved. So there are as many rounds as the longest run of fired commands on one object.
    """
    now, pending, parts = objects, commands, []
    turn = F.struct("at", "command_id")
    while True:
        decided = materialise(fire(now, pending, machine), "decided")
        won = decided.where(F.col("status") == "fired")
        first = won.select("id", turn.alias("_first"))
        late = decided.join(first, "id").where(turn > F.col("_first")).select("command_id")
        parts.append(decided.join(late, "command_id", "left_anti"))
        pending = materialise(pending.join(late, "command_id", "left_semi"), "pending")
        if pending.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), parts)
        # Objects without commands left need not be moved.
        waiting = now.join(pending.select("id").distinct(), "id", "left_semi")
        now = materialise(moved(waiting, won).select(*objects.columns), "moved")


def watch_candidates(store: ObjectStore, changes: DataFrame, machine: Machine) -> DataFrame:
    """Distinct ids that an ON_CHANGE transition of the machine may move.

    A live changed object is a candidate itself; so is every object it references through a
    watched relationship declared on its type. A deleted object speaks through its last values.
    """
    itself = changes.where(F.col("after").isNotNull() & F.col("id").isNotNull()).select("id")
    parts = [itself]
    watched = {w for _, t in machine.leaving("ON_CHANGE") for w in t.watch}
    fields = set(changes.schema["after"].dataType.names)
    for name in sorted(watched & fields):
        declaring = [t.iri for t in store.schema.types if any(p.name == name and p.is_ref for p in store.schema.properties(t.name))]
        p = next(p for t in store.schema.types for p in store.schema.properties(t.name) if p.name == name)
        value = F.when(F.col("after").isNotNull(), F.col(f"after.{name}")).otherwise(F.col(f"before.{name}"))
        rows = changes.where(F.col("type").isin(*declaring))
        ref = F.explode(value) if p.is_list else value
        parts.append(rows.select(ref.alias("id")).where(F.col("id").isNotNull()))
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def fire_on_change(objects: DataFrame, candidates: DataFrame, machine: Machine, at: Column) -> DataFrame:
    """At most one transition per candidate: the first declared one whose guard holds."""
    rows = objects.join(candidates.select("id"), "id", "left_semi")
    return _fired(rows, _first_match(machine, "ON_CHANGE"), at)


def fire_signals(objects: DataFrame, signals: DataFrame, machine: Machine) -> tuple[DataFrame, DataFrame]:
    """(fired, unknown). A signal no transition of the machine declares is unknown; one that the
    current state does not wait for does nothing. Signals (signal_id, id, signal, at) on one
    object: the first that matches fires."""
    declared = sorted({t.signal for _, t in machine.leaving("EXTERNAL_SIGNAL")})
    unknown = signals.where(~F.coalesce(F.col("signal").isin(*declared), F.lit(False)))
    known = signals.where(F.col("signal").isin(*declared)).select("id", "signal_id", "signal", F.col("at").alias("_at"))
    move = _first_match(machine, "EXTERNAL_SIGNAL", lambda t: F.col("signal") == t.signal)
    hits = objects.join(known, "id").withColumn("_m", move).where(F.col("_m").isNotNull())
    first = hits.groupBy("id").agg(F.min_by(F.struct("_m", "_at"), F.struct("_at", "signal_id")).alias("_hit"))
    rows = objects.join(first, "id")
    return _fired(rows.withColumn("_at", F.col("_hit._at")), F.col("_hit._m"), F.col("_at")).withColumn("self", _drop_hit("self")), unknown


def _drop_hit(column: str) -> Column:
    return F.col(column).dropFields("_hit")


# ---------------------------------------------------------------- histories


def fold(
    commands: DataFrame,
    machine: Machine,
    key: str = "id",
    order: tuple[str, ...] = ("ts", "seq"),
    partitions: int | None = None,
    start: DataFrame | None = None,
) -> DataFrame:
    """Every command with the state it met, the state it left and whether it fired.

    Commands with no matching transition, or whose guard fails, leave the state as it is. Guards
    read the command's own columns. ``start`` (key, state) holds the states to begin with where
    they are not the machine's initial one; it enters as a first command that sets the state.
    See :mod:`ordered` for how hot objects are spread.
    """
    states = list(machine.states)
    steps = [t for _, t in machine.leaving() if t.trigger in ("USER_ACTION", "EXTERNAL_SIGNAL")]

    def hits(t: Transition) -> Column:
        return F.coalesce((F.col("command") == t.name) & templates.guard(t.guard), F.lit(False))

    moves = []
    for i, s in enumerate(states):
        target = F.lit(i)
        for t in reversed([t for t in steps if t.source == s]):
            target = F.when(hits(t), F.lit(states.index(t.target))).otherwise(target)
        moves.append(target)
    rows, by = commands, list(order)
    if start is not None:
        names = F.array(*[F.lit(s) for s in states])
        known = start.join(commands.select(key).distinct(), key, "left_semi")
        first = known.select(key, (F.array_position(names, F.col("state")) - 1).cast("int").alias("_begin"))
        rows = commands.withColumn("_begin", F.lit(None).cast("int")).unionByName(first, allowMissingColumns=True)
        rows = rows.withColumn("_turn", F.col("_begin").isNull().cast("int"))
        by = ["_turn", *by]
        moves = [F.coalesce(F.col("_begin"), m) for m in moves]
    run = fold_states(rows, key, by, states, moves, machine.initial, partitions)
    if start is not None:
        run = run.where("_turn = 1").drop("_turn", "_begin")
    fired = _any([(F.col("from_state") == t.source) & hits(t) for t in steps])
    return run.withColumn("fired", fired)


def transition_log(history: DataFrame) -> DataFrame:
    """The fired commands of a folded history."""
    return history.where("fired")


def timers_due(history: DataFrame, machine: Machine, as_of: Column, key: str = "id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Timers that ran out by ``as_of``: entering a state starts its timers, leaving it stops them."""
    led = next_in_order(transition_log(history), key, list(order), "ts", "left_at")
    cells = []
    for _, t in machine.leaving("TIMER"):
        due = plus(F.col("ts"), t.after)
        cells.append(
            F.when(
                F.col("to_state") == t.source,
                F.struct(F.lit(t.name).alias("transition"), F.lit(t.source).alias("state"), due.alias("due_at"), F.lit(t.target).alias("to_state")),
            )
        )
    rows = led.select(key, F.col("ts").alias("entered_at"), "left_at", F.explode(F.array_compact(F.array(*cells))).alias("t"))
    due = rows.select(key, "entered_at", "left_at", "t.*")
    still = F.col("left_at").isNull() | (F.col("left_at") > F.col("due_at"))
    return due.where(still & (F.col("due_at") <= as_of)).select(
        key, timer_key(F.col(key), F.col("state"), F.col("transition")).alias("timer_key"), "transition", "entered_at", "due_at", F.col("state").alias("from_state"), "to_state"
    )


# ---------------------------------------------------------------- effects of fired transitions


def moved(objects: DataFrame, fired: DataFrame) -> DataFrame:
    """Objects after the fired transitions: new state, next version. One fired row per object."""
    m = fired.select("id", F.col("to_state").alias("_to"), F.col("at").alias("_at"))
    hit = F.col("_to").isNotNull()
    out = objects.join(m, "id", "left")
    return (
        out.withColumn("state", F.coalesce("_to", "state"))
        .withColumn("version", F.when(hit, F.col("version") + 1).otherwise(F.col("version")))
        .withColumn("updated_at", F.when(hit, F.col("_at")).otherwise(F.col("updated_at")))
        .select(*objects.columns)
    )


def events(fired: DataFrame, machine: Machine) -> DataFrame:
    """Log rows of fired transitions: the transition, its actions, timers stopped and started."""
    cells = [F.struct(F.lit("TransitionFired").alias("kind"), F.col("transition").alias("name"), F.lit(None).cast("timestamp").alias("due_at"))]
    for _, t in machine.leaving():
        here = (F.col("transition") == t.name) & (F.col("from_state") == t.source)
        for i, a in enumerate(t.actions):
            cells.append(F.when(here, F.struct(F.lit("ActionRequest").alias("kind"), F.lit(f"{i}:{a.kind}").alias("name"), F.lit(None).cast("timestamp").alias("due_at"))))
    for _, t in machine.leaving("TIMER"):
        cells.append(F.when(F.col("from_state") == t.source, F.struct(F.lit("TimerCancelled").alias("kind"), F.lit(t.name).alias("name"), F.lit(None).cast("timestamp").alias("due_at"))))
        cells.append(F.when(F.col("to_state") == t.source, F.struct(F.lit("TimerScheduled").alias("kind"), F.lit(t.name).alias("name"), plus(F.col("at"), t.after).alias("due_at"))))
    rows = fired.select("*", F.posexplode(F.array_compact(F.array(*cells))).alias("seq", "e"))
    return rows.select(
        name_uuid(F.concat_ws("|", "id", F.col("version").cast("string"), F.col("seq").cast("string"))).alias("entry_id"),
        F.col("id").alias("object_id"), "tenant", "type", "version", "seq", F.col("e.kind").alias("kind"), F.col("e.name").alias("name"),
        "from_state", "to_state", F.col("at").alias("occurred_at"), F.col("e.due_at").alias("due_at"),
    )


def _with_action(machine: Machine, kind: str) -> list[tuple[Column, Action, int]]:
    """(condition on a fired row, action, its position) for every action of one kind."""
    found = []
    for _, t in machine.leaving():
        here = (F.col("transition") == t.name) & (F.col("from_state") == t.source)
        found += [(here, a, i) for i, a in enumerate(t.actions) if a.kind == kind]
    return found


def _each(cells: list[Column]) -> Column:
    """One output row per cell that applies: the fired rows are read once for all actions."""
    return F.explode(F.array_compact(F.array(*cells)))


def set_properties(store: ObjectStore, objects: DataFrame, fired: DataFrame, machine: Machine) -> DataFrame:
    """(id, property, old, new) as text for every set_property action that changes a live object.

    The value comes from a literal or from an expression over the object as it was when it fired.
    """
    actions = _with_action(machine, "set_property")
    now = objects.select("id", *[F.col(n).alias(f"_now_{n}") for n in sorted({a.property for _, a, _ in actions})])
    cells = []
    for here, a, _ in actions:
        kind = store.schema.lookup(machine.type, a.property).scalar_type
        new = (F.lit(a.literal) if a.expression is None else templates.value(a.expression, "self")).cast(kind)
        old = F.col(f"_now_{a.property}")
        differs = F.struct(F.lit(a.property).alias("property"), old.cast("string").alias("old"), new.cast("string").alias("new"))
        cells.append(F.when(here & ~new.eqNullSafe(old), differs))
    return fired.join(now, "id").select("id", _each(cells).alias("c")).select("id", "c.property", "c.old", "c.new")


def with_properties(store: ObjectStore, objects: DataFrame, fired: DataFrame, machine: Machine) -> DataFrame:
    """Next versions of the objects that a set_property action changes; the others are left out.

    Several actions of one transition apply in their order. One fired row per object.
    """
    frozen = fired.select("id", "transition", "from_state", "self", F.col("at").alias("_at"))
    rows = objects.join(frozen, "id")
    new: dict[str, Column] = {}
    for here, a, _ in _with_action(machine, "set_property"):
        kind = store.schema.lookup(machine.type, a.property).scalar_type
        value = (F.lit(a.literal) if a.expression is None else templates.value(a.expression, "self")).cast(kind)
        new[a.property] = F.when(here, value).otherwise(new.get(a.property, F.col(a.property)))
    if not new:
        return objects.limit(0)
    differs = _any([~v.eqNullSafe(F.col(n)) for n, v in new.items()])
    out = {
        **{n: v for n, v in new.items()},
        "version": F.col("version") + 1,
        "updated_at": F.col("_at"),
        "updated_by": F.lit("automation"),
    }
    return rows.where(differs).select(*[out[c].alias(c) if c in out else F.col(c) for c in objects.columns])


def create_objects(store: ObjectStore, fired: DataFrame, machine: Machine, entry_id: Column) -> dict[str, DataFrame]:
    """New objects by type for create_object actions; the state stays empty.

    The id follows from the fired entry and the action's position, and objects that exist already
    are left out, so running the same rows again creates nothing twice.
    """
    actions = _with_action(machine, "create_object")
    out: dict[str, DataFrame] = {}
    for name in dict.fromkeys(store.schema.type(a.create_type).name for _, a, _ in actions):
        props = store.schema.properties(name)
        cells = []
        for here, a, i in actions:
            if store.schema.type(a.create_type).name != name:
                continue
            given = dict(a.assignments)
            values = [(templates.value(given[p.name], "self") if p.name in given else F.lit(None)).cast(p.spark_type).alias(p.name) for p in props]
            cells.append(F.when(here, F.struct(derived_id(entry_id, F.lit(i)).alias("id"), *values)))
        rows = fired.select("tenant", "at", _each(cells).alias("o"))
        envelope = {
            "id": F.col("o.id"),
            "tenant": F.col("tenant"),
            "type": F.lit(store.schema.type(name).iri),
            "version": F.lit(1).cast("long"),
            "state": F.lit(None).cast("string"),
            "created_at": F.col("at"),
            "created_by": F.lit("automation"),
            "updated_at": F.col("at"),
            "updated_by": F.lit("automation"),
            "deleted_at": F.lit(None).cast("timestamp"),
        }
        fresh = rows.select(*[envelope[n].alias(n) for n in ENVELOPE], *[F.col("o")[p.name].alias(p.name) for p in props])
        out[name] = fresh.join(store.table(name).select("id"), "id", "left_anti").select(*fresh.columns)
    return out


def messages(fired: DataFrame, machine: Machine) -> DataFrame:
    """(id, version, kind, method, url, text): log lines and web requests, rendered but not sent."""
    nothing = F.lit(None).cast("string")
    cells = []
    for kind in ("log", "webhook"):
        for here, a, _ in _with_action(machine, kind):
            text = a.message if kind == "log" else a.body
            cells.append(
                F.when(
                    here,
                    F.struct(
                        F.lit(kind).alias("kind"),
                        F.lit(a.method).cast("string").alias("method"),
                        (templates.render(a.url, "self") if a.url else nothing).alias("url"),
                        (templates.render(text, "self") if text is not None else nothing).alias("text"),
                    ),
                )
            )
    return fired.select("id", "version", _each(cells).alias("m")).select("id", "version", "m.*")
