"""Keeps tables, maintained rollups and reactions to changes in step with a feed of change sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Machine, Schema
from ..operators import lifecycle as L
from ..operators.commit import apply_changes, update_events
from ..session import materialise
from ..sources.store import ObjectStore
from ..sources.versions import latest, overlay, singles
from .deltas import SIGN, DeltaRollups


class NeverSettles(RuntimeError):
    """Rules and reactions that keep undoing each other."""


#: Far beyond any chain of dependent rules; more rounds than that can only be a cycle.
MANY_ROUNDS = 10_000


class Maintainer:
    """``process(batch, batch_id)`` for ``foreachBatch``.

    A micro-batch applies its change sets, moves the affected rollups by the differences (``DeltaRollups``), fires ON_CHANGE
    transitions with their actions, and repeats the last two for what they wrote, until nothing changes. Machines
    that move an object round and round raise an error after ``rounds``. Tables are never rewritten: each round appends row versions under its
    batch and step, and reads see the newest version. A repeated batch overwrites its own steps
    and ignores them while it runs, so the outcome is the same.
    """

    def __init__(self, base: ObjectStore, types: tuple[str, ...], root: str, machines: tuple[Machine, ...] = (), rounds: int = MANY_ROUNDS) -> None:
        self.base = base
        self.types = base.concrete(*types)
        self.root = root
        self.machines = machines
        self.rounds = rounds
        self._writes = dict.fromkeys(self.types, 0)
        self._checked: dict[str, tuple[int, tuple[int, int] | None, bool]] = {}
        kept = [r for r in self.schema.rollups if r.materialised and set(base.concrete(r.source)) & set(self.types) and set(base.concrete(r.on_type)) & set(self.types)]
        self.rollups = DeltaRollups(base, kept, f"{root}/rollups")
        for a in (a for m in machines for t in m.transitions for a in t.actions if a.create_type):
            if self.schema.type(a.create_type).name not in self.types:
                raise ValueError(f"objects of {a.create_type} are created but not kept here")

    @property
    def spark(self) -> SparkSession:
        return self.base.spark

    @property
    def schema(self) -> Schema:
        return self.base.schema

    def _delta(self, name: str) -> DataFrame | None:
        path = f"{self.root}/versions/{name}"
        steps = [T.StructField("batch", T.LongType()), T.StructField("step", T.LongType())]
        shape = T.StructType(self.base.table(name).schema.fields + steps)
        try:
            return self.spark.read.schema(shape).parquet(path)
        except Exception as err:  # nothing has been written for this type yet
            if "PATH_NOT_FOUND" in str(err):
                return None
            raise

    def store(self, before: tuple[int, int] | None = None) -> ObjectStore:
        """The tables now, or as they were before a (batch, step)."""
        out = self.base
        for name in self.types:
            delta = self._delta(name)
            if delta is None:
                continue
            if before is not None:
                batch, step = before
                delta = delta.where((F.col("batch") < batch) | ((F.col("batch") == batch) & (F.col("step") < step)))
            out = out.with_table(name, overlay(self.base.table(name), delta, single=self._single(name, delta, before)))
        return out

    def _single(self, name: str, delta: DataFrame, before: tuple[int, int] | None) -> bool:
        """Whether no object of a type has several versions yet. Once one has, it is not asked again."""
        writes, at, single = self._checked.get(name, (-1, None, True))
        if single and (writes, at) != (self._writes[name], before):
            single = singles(delta)
            self._checked[name] = (self._writes[name], before, single)
        return single

    def _write(self, name: str, rows: DataFrame, batch: int, step: int) -> DataFrame:
        path = f"{self.root}/versions/{name}/batch={batch}/step={step}"
        self._writes[name] += 1
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _log(self, rows: DataFrame, what: str, batch: int, step: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{what}/batch={batch}/step={step}")

    def process(self, changes: DataFrame, batch_id: int) -> None:
        step = 0
        self.rollups.begin(batch_id)
        written: dict[str, list[DataFrame]] = {n: [] for n in self.types}
        known = [self.schema.type(n).iri for n in self.types]
        pending = materialise(changes.where(F.col("type").isin(*known)), "feed")
        foreign = changes.where(~F.coalesce(F.col("type").isin(*known), F.lit(False)))
        self._log(foreign.select("changeset_id", "seq", "id", F.lit("unknown_type").alias("status")), "rejected", batch_id, -1)
        start = self.store((batch_id, 0))
        while True:
            now = self.store((batch_id, step))
            # Type names only: no more of them than the schema declares.
            present = {r["type"] for r in pending.select("type").distinct().collect()}
            types = [n for n in self.types if self.schema.type(n).iri in present]
            if not types:
                break
            result = apply_changes(now, pending, *types, keep=True)
            for n in types:
                written[n].append(self._write(n, result.versions[n], batch_id, step))
            self._log(result.log, "log", batch_id, step)
            self._log(result.rejected, "rejected", batch_id, step)
            step += 1
            pending = result.deferred
        touched = self._union(written, start)
        done = 0
        while not all(t.isEmpty() for t in touched.values()):
            if done == self.rounds:
                raise NeverSettles(f"batch {batch_id} still changes after {done} rounds")
            done += 1
            now = self.store((batch_id, step))
            fresh: dict[str, list[DataFrame]] = {n: [] for n in self.types}
            signed = [self._signed(start, touched[n], n) for n in self._sources()]
            values = self.rollups.apply(signed, now, batch_id, step)
            for n in self.types:
                rows = self._refresh(now, values, n)
                if rows is not None:
                    fresh[n].append(self._write_logged(now, n, rows, batch_id, step, "rollup"))
            step += 1
            after = self.store((batch_id, step))
            seen = {n: reduce(lambda a, b: a.unionByName(b), [touched[n], *fresh[n]]) for n in self.types}
            for m in self.machines:
                name = self.schema.type(m.type).name
                fired, rows = self._react(start, after, seen, m, batch_id, step)
                fresh[name].append(self._write(name, rows, batch_id, step))
                step += 1
                if any(t.actions for t in m.transitions):
                    self._act(fired, m, fresh, batch_id, step)
                    step += 2
            start, touched = now, self._union(fresh, after)

    def _union(self, parts: dict[str, list[DataFrame]], shape: ObjectStore) -> dict[str, DataFrame]:
        return {n: reduce(lambda a, b: a.unionByName(b), p) if p else shape.table(n).limit(0) for n, p in parts.items()}

    def _images(self, start: ObjectStore, touched: DataFrame, name: str) -> DataFrame:
        """(id, type, before, after) of the objects of one type written since ``start``."""
        props = [p.name for p in self.schema.properties(name)]
        image = F.struct(*props)
        ids = touched.select("id").distinct()
        old = start.table(name).join(ids, "id", "left_semi").where(F.col("deleted_at").isNull()).select("id", image.alias("before"))
        top = touched.groupBy("id").agg(F.max_by(F.struct("type", "deleted_at", *props), "version").alias("_n"))
        after = F.when(F.col("_n.deleted_at").isNull(), F.struct(*[F.col("_n")[p].alias(p) for p in props]))
        return top.select("id", F.col("_n.type").alias("type"), after.alias("after")).join(old, "id", "left")

    def _sources(self) -> list[str]:
        """Types whose objects a maintained rollup counts."""
        rules = [r for group in self.rollups.groups.values() for r in group]
        return [n for n in self.types if any(self.schema.is_subtype(n, r.source) for r in rules)]

    def _signed(self, start: ObjectStore, touched: DataFrame, name: str) -> DataFrame:
        """The live objects of one type written since ``start``: as they were with -1, as they are with 1."""
        props = [p.name for p in self.schema.properties(name)]
        old = start.scan(name).join(touched.select("id").distinct(), "id", "left_semi").select("type", *props, F.lit(-1).alias(SIGN))
        top = touched if singles(touched) else latest(touched.select("id", "version", "type", "tenant", "deleted_at", *props), ["id"])
        new = top.where((F.col("tenant") == start.tenant) & F.col("deleted_at").isNull()).select("type", *props, F.lit(1).alias(SIGN))
        return old.unionByName(new)

    def _refresh(self, now: ObjectStore, values: dict[str, DataFrame], name: str) -> DataFrame | None:
        """New versions of one type's objects whose maintained rollups changed."""
        out, hit = now.scan(name), F.lit(False)
        mine = {g: rs for g in values if (rs := [r for r in self.rollups.groups[g] if self.schema.is_subtype(name, r.on_type)])}
        if not mine:
            return None
        for k, (group, rules) in enumerate(mine.items()):
            news = values[group].select("id", *[F.col(r.property).alias(f"_new_{r.property}") for r in rules], F.lit(True).alias(f"_hit{k}"))
            out = out.join(news, "id", "left")
            for r in rules:
                new = F.col(f"_new_{r.property}").cast(self.schema.lookup(name, r.property).scalar_type)
                moved = F.coalesce(F.col(f"_hit{k}"), F.lit(False)) & ~new.eqNullSafe(F.col(r.property))
                hit = hit | moved
                out = out.withColumn(f"_new_{r.property}", F.when(F.coalesce(F.col(f"_hit{k}"), F.lit(False)), new).otherwise(F.col(r.property)))
        rows = out.where(hit)
        for r in (r for rules in mine.values() for r in rules):
            rows = rows.withColumn(r.property, F.col(f"_new_{r.property}"))
        rows = rows.withColumn("version", F.col("version") + 1).withColumn("updated_at", F.current_timestamp())
        return rows.select(*now.table(name).columns)

    def _react(self, start: ObjectStore, now: ObjectStore, touched: dict[str, DataFrame], machine: Machine, batch: int, step: int) -> tuple[DataFrame, DataFrame]:
        """Fired ON_CHANGE transitions, and new versions of the objects they move."""
        name = self.schema.type(machine.type).name
        candidates = reduce(
            lambda a, b: a.unionByName(b),
            [L.watch_candidates(now, self._images(start, touched[n], n), machine) for n in self.types],
        ).distinct()
        live = now.scan(name)
        fired = materialise(L.fire_on_change(live, candidates, machine, F.current_timestamp()), "fired")
        self._log(L.events(fired, machine), "transitions", batch, step)
        moved = L.moved(live, fired).join(fired.select("id"), "id", "left_semi")
        return fired, moved.select(*now.table(name).columns)

    def _act(self, fired: DataFrame, machine: Machine, fresh: dict[str, list[DataFrame]], batch: int, step: int) -> None:
        """What the fired transitions do: set properties, create objects, render messages."""
        now = self.store((batch, step))
        name = self.schema.type(machine.type).name
        kinds = {a.kind for t in machine.transitions for a in t.actions}
        made = L.create_objects(now, fired, machine, F.concat_ws("/", "id", F.col("version").cast("string"))) if "create_object" in kinds else {}
        for n, rows in made.items():
            fresh[n].append(self._write_logged(now, n, rows, batch, step, "action", "create"))
        own = L.with_properties(now, now.scan(name), fired, machine) if "set_property" in kinds else None
        if own is not None:
            fresh[name].append(self._write_logged(now, name, own, batch, step + 1, "action"))
        if kinds & {"log", "webhook"}:
            self._log(L.messages(fired, machine), "messages", batch, step)

    def _write_logged(self, now: ObjectStore, name: str, rows: DataFrame, batch: int, step: int, label: str, op: str = "update") -> DataFrame:
        out = self._write(name, rows.select(*now.table(name).columns), batch, step)
        self._log(update_events(now, name, out, f"{label}-{batch}-{step}", op), f"log_{name}_{op}", batch, step)
        return out


