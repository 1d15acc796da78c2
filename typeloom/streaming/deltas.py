"""Rollups kept up to date by differences: a batch costs what it changes, not what it points at."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Rollup
from ..operators.predicates import conjunction, marked
from ..operators.rollup import aggregate_rules, rule_criteria
from ..session import materialise
from ..sources.store import ObjectStore

SIGN = "_sign"
_WHOLE = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


class DeltaRollups:
    """The values of ``rules``, moved along by signed source rows.

    COUNT, SUM and AVG of exact numbers are sums of differences: each step appends the differences of the targets it
    touches. MIN and MAX take in what arrives; only targets whose extreme left without an equal one arriving are
    aggregated again from the sources. Sums of binary fractions, which differences would distort, are aggregated again
    for each touched target.

    Rules with the same source and relationship share one table, ``parts/batch=/step=/bucket=`` by the hash of the
    target, on top of ``full/upto=``, the merged state that is written anew every ``compact`` batches. A step reads
    only the buckets of its targets. Steps not before the current one are never read, so that a repeated batch gives
    the same result. Batch ids count up from 0, as those of a stream do.

    A row without a target counts nowhere; a target that no object has is kept but shows in no table.
    """

    def __init__(self, base: ObjectStore, rules: list[Rollup], root: str, buckets: int = 64, compact: int = 16) -> None:
        self.base = base
        self.root = root
        self.buckets = buckets
        self.compact = compact
        self.groups: dict[str, list[Rollup]] = defaultdict(list)
        for r in rules:
            self.groups[f"{r.source}.{r.via}"].append(r)

    @property
    def spark(self) -> SparkSession:
        return self.base.spark

    # ------------------------------------------------------------ kinds of rules

    def _kind(self, rule: Rollup) -> T.DataType | None:
        return self.base.schema.lookup(rule.source, rule.of).scalar_type if rule.of else None

    def _sum_type(self, rule: Rollup) -> T.DecimalType:
        kind = self._kind(rule)
        return T.DecimalType(38, kind.scale if isinstance(kind, T.DecimalType) else 0)

    def _adds_up(self, rule: Rollup) -> bool:
        return rule.function == "COUNT" or (rule.function in ("SUM", "AVG") and isinstance(self._kind(rule), (T.DecimalType, *_WHOLE)))

    def _best_type(self, rule: Rollup) -> T.DataType:
        return T.DoubleType() if rule.function == "AVG" else self._kind(rule)

    def _shape(self, group: str) -> list[T.StructField]:
        fields = [T.StructField("id", T.StringType())]
        for r in self.groups[group]:
            if self._adds_up(r):
                fields.append(T.StructField(f"n_{r.property}", T.LongType()))
                if r.of:
                    fields.append(T.StructField(f"s_{r.property}", self._sum_type(r)))
            else:
                fields.append(T.StructField(f"best_{r.property}", self._best_type(r)))
        return fields

    # ------------------------------------------------------------ signed rows

    def _moved(self, group: str, signed: DataFrame) -> DataFrame:
        """One row for each target of the signed rows: differences of sums, extremes that came and went."""
        rules = self.groups[group]
        schema = self.base.schema
        rows = signed.where(F.col("type").isin(*[t.iri for t in schema.concrete(rules[0].source)]))
        p = schema.lookup(rules[0].source, rules[0].via)
        rows = rows.withColumn("_target", F.explode(F.array_distinct(F.col(p.name))) if p.is_list else F.col(p.name)).where(F.col("_target").isNotNull())
        sums: list[Column] = []
        sign = F.col(SIGN)
        for r in rules:
            rows, own = marked(rows, rule_criteria(schema, r))
            keep = F.coalesce(conjunction(own), F.lit(False))
            name = r.property
            if r.function == "COUNT":
                sums.append(F.sum(F.when(keep, sign).otherwise(0)).cast("long").alias(f"n_{name}"))
            elif self._adds_up(r):
                value = F.col(r.of).cast(self._sum_type(r))
                sums.append(F.sum(F.when(keep & value.isNotNull(), sign).otherwise(0)).cast("long").alias(f"n_{name}"))
                sums.append(F.coalesce(F.sum(F.when(keep, F.when(sign > 0, value).otherwise(-value))), F.lit(0)).cast(self._sum_type(r)).alias(f"s_{name}"))
            elif r.function in ("MIN", "MAX"):
                pick = F.min if r.function == "MIN" else F.max
                sums.append(pick(F.when(keep & (sign > 0), F.col(r.of))).alias(f"in_{name}"))
                sums.append(pick(F.when(keep & (sign < 0), F.col(r.of))).alias(f"out_{name}"))
        # The bucket alone would leave no aggregate where every rule is aggregated again.
        out = rows.groupBy(F.col("_target").alias("id")).agg(F.count("*").alias("_rows"), *sums)
        return out.withColumn("bucket", self._bucket())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------ stored state

    def _write(self, group: str, rows: DataFrame, at: str) -> None:
        names = [f.name for f in self._shape(group)]
        rows.select(*names, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{group}/{at}")

    def _read(self, group: str, at: str, steps: tuple[str, ...] = ()) -> DataFrame | None:
        shape = self._shape(group) + [T.StructField(n, T.LongType()) for n in steps] + [T.StructField("bucket", T.IntegerType())]
        try:
            return self.spark.read.schema(T.StructType(shape)).parquet(f"{self.root}/{group}/{at}")
        except Exception as err:  # no step has touched this group yet
            if "PATH_NOT_FOUND" in str(err):
                return None
            raise

    def _state(self, group: str, batch: int, step: int, floor: int, buckets: list[int] | None = None) -> DataFrame:
        """Merged state before (batch, step), on top of the full state up to batch ``floor``."""
        full = self._read(group, f"full/upto={floor}").withColumn("batch", F.lit(floor).cast("long")).withColumn("step", F.lit(0).cast("long"))
        parts = self._read(group, "parts", ("batch", "step"))
        if parts is not None:
            mine = (F.col("batch") > floor) & ((F.col("batch") < batch) | ((F.col("batch") == batch) & (F.col("step") < step)))
            full = full.unionByName(parts.where(mine))
        if buckets is not None:
            full = full.where(F.col("bucket").isin(*buckets))
        merged = [
            (F.max_by(f.name, F.struct("batch", "step")) if f.name.startswith("best_") else F.sum(f.name).cast(f.dataType)).alias(f.name)
            for f in self._shape(group)[1:]
        ]
        return full.groupBy("id", "bucket").agg(*merged)

    def _floor(self, batch: int) -> int:
        return (batch // self.compact) * self.compact - 1

    def begin(self, batch: int) -> None:
        """What a batch needs before its first step: the state of the tables it starts from, merged if that is due."""
        for group in self.groups:
            if batch % self.compact == 0 and batch:
                self._write(group, self._state(group, batch, 0, self._floor(batch - 1)), f"full/upto={batch - 1}")
            elif not self._seeded(group):
                self._seed(group)

    def _seeded(self, group: str) -> bool:
        try:
            return not self.spark.read.schema("id long").parquet(f"{self.root}/{group}/seeded").isEmpty()
        except Exception as err:
            if "PATH_NOT_FOUND" in str(err):
                return False
            raise

    def _seed(self, group: str) -> None:
        source = self.groups[group][0].source
        moved = self._moved(group, self.base.scan(source).withColumn(SIGN, F.lit(1)))
        again = [r for r in self.groups[group] if not self._adds_up(r) and r.function not in ("MIN", "MAX")]
        for r in self.groups[group]:
            if r.function in ("MIN", "MAX"):
                moved = moved.withColumn(f"best_{r.property}", F.col(f"in_{r.property}"))
        if again:
            moved = moved.join(self._afresh(self.base, again), "id", "left")
        self._write(group, moved, "full/upto=-1")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.root}/{group}/seeded")

    def _afresh(self, now: ObjectStore, rules: list[Rollup], only: DataFrame | None = None) -> DataFrame:
        rows = aggregate_rules(now, rules, only)
        return rows.select("id", *[F.col(r.property).cast(self._best_type(r)).alias(f"best_{r.property}") for r in rules])

    # ------------------------------------------------------------ one step

    def apply(self, signed: list[DataFrame], now: ObjectStore, batch: int, step: int) -> dict[str, DataFrame]:
        """(id, one column per rule) of the touched targets, by group; groups without any are left out.

        ``signed`` are source rows with their properties, ``type`` and ``_sign``: -1 for what was, 1 for what is;
        ``now`` holds the sources after the change.
        """
        if not signed:
            return {}
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), signed)
        known = [g for g, rules in self.groups.items() if rules[0].via in rows.columns]
        return {g: v for g in known if (v := self._step(g, rows, now, batch, step)) is not None}

    def _step(self, group: str, signed: DataFrame, now: ObjectStore, batch: int, step: int) -> DataFrame | None:
        rules = self.groups[group]
        moved = materialise(self._moved(group, signed), "moved")
        # No more values than there are buckets.
        buckets = sorted(r["bucket"] for r in moved.select("bucket").distinct().collect())
        if not buckets:
            return None
        old = self._state(group, batch, step, self._floor(batch), buckets).drop("bucket")
        rows = moved.join(old.select("id", *[F.col(f.name).alias(f"was_{f.name}") for f in self._shape(group)[1:]]), "id", "left")
        again = [r for r in rules if not self._adds_up(r)]
        stale = F.lit(False)
        for r in again:
            name = r.property
            if r.function not in ("MIN", "MAX"):
                rows, gone = rows.withColumn(f"best_{name}", F.lit(None).cast(self._best_type(r))), F.lit(True)
            else:
                was, came, went = F.col(f"was_best_{name}"), F.col(f"in_{name}"), F.col(f"out_{name}")
                reaches = (lambda a, b: a <= b) if r.function == "MIN" else (lambda a, b: a >= b)
                lost = went.isNotNull() & F.coalesce(reaches(went, was), F.lit(True)) & ~F.coalesce(reaches(came, was), F.lit(False))
                best = (F.least if r.function == "MIN" else F.greatest)(was, came)
                rows, gone = rows.withColumn(f"best_{name}", best), lost
            rows = rows.withColumn(f"lost_{name}", gone)
            stale = stale | F.col(f"lost_{name}")
        if again:
            rows = materialise(rows, "moved-extremes")
            lost = rows.where(stale).select("id")
            if not lost.isEmpty():
                fresh = self._afresh(now, again, lost)
                rows = rows.join(fresh.select("id", *[F.col(f"best_{r.property}").alias(f"fresh_{r.property}") for r in again]), "id", "left")
                for r in again:
                    rows = rows.withColumn(f"best_{r.property}", F.when(F.col(f"lost_{r.property}"), F.col(f"fresh_{r.property}")).otherwise(F.col(f"best_{r.property}")))
        rows = materialise(rows, "moved-values")
        self._write(group, rows, f"parts/batch={batch}/step={step}")
        return rows.select("id", *[self._value(r).alias(r.property) for r in rules])

    def _value(self, rule: Rollup) -> Column:
        name = rule.property
        if not self._adds_up(rule):
            return F.col(f"best_{name}")
        n = F.coalesce(F.col(f"was_n_{name}"), F.lit(0)) + F.col(f"n_{name}")
        if rule.function == "COUNT":
            return n
        total = (F.coalesce(F.col(f"was_s_{name}"), F.lit(0).cast(self._sum_type(rule))) + F.col(f"s_{name}")).cast(self._sum_type(rule))
        return F.when(n > 0, total if rule.function == "SUM" else total.cast("double") / n)

    def values(self, batch: int) -> dict[str, DataFrame]:
        """(id, one column per rule) of all targets ever pointed at, after ``batch``, by group."""
        out = {}
        for group, rules in self.groups.items():
            state = self._state(group, batch + 1, 0, self._floor(batch))
            for f in self._shape(group)[1:]:
                if not f.name.startswith("best_"):
                    state = state.withColumn(f"was_{f.name}", F.lit(0).cast(f.dataType))
            out[group] = state.select("id", *[self._value(r).alias(r.property) for r in rules])
        return out
