"""Scoped access to typed object tables: one wide table per concrete type."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import searchable_text
from ..model import ENVELOPE, Property, Schema

SEARCH_TEXT = "search_text"


def table_schema(schema: Schema, type_name: str) -> T.StructType:
    """Explicit Spark schema of a type's table: envelope, then one column per property."""
    fields = [T.StructField(n, t) for n, t in ENVELOPE.items()]
    fields += [T.StructField(p.name, p.spark_type) for p in schema.properties(type_name)]
    return T.StructType(fields)


class ObjectStore:
    """Object tables of one tenant under one schema.

    ``tables`` maps a concrete type's name to a function that returns its DataFrame, so that a
    query only touches the types it names.
    """

    def __init__(
        self,
        spark: SparkSession,
        schema: Schema,
        tables: dict[str, Callable[[], DataFrame]],
        tenant: str,
        ontology_version: int = 1,
    ) -> None:
        self.spark = spark
        self.schema = schema
        self.tenant = tenant
        self.ontology_version = ontology_version
        self._loaders = tables
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def from_parquet(cls, spark: SparkSession, schema: Schema, root: str, tenant: str) -> ObjectStore:
        """Tables written by :func:`write_table`: ``root/<type>/tenant=<t>/…``."""

        def loader(name: str) -> Callable[[], DataFrame]:
            return lambda: spark.read.schema(table_schema(schema, name)).parquet(f"{root}/{name}")

        return cls(spark, schema, {t.name: loader(t.name) for t in schema.concrete(*[x.name for x in schema.types])}, tenant)

    def with_table(self, name: str, df: DataFrame) -> ObjectStore:
        """The same store with one type's rows replaced."""
        loaders = dict(self._loaders)
        loaders[name] = lambda: df
        return ObjectStore(self.spark, self.schema, loaders, self.tenant, self.ontology_version)

    def table(self, name: str) -> DataFrame:
        """Every stored row of one concrete type: all tenants, deleted ones too."""
        if name not in self._tables:
            self._tables[name] = self._loaders[name]()
        return self._tables[name]

    def concrete(self, *types: str) -> list[str]:
        return [t.name for t in self.schema.concrete(*types) if t.name in self._loaders]

    def properties(self, *types: str) -> list[Property]:
        return self.schema.reachable_properties(*types)

    def scan(self, *types: str, include_deleted: bool = False, with_search_text: bool = False) -> DataFrame:
        """Rows of the tenant in any concrete type at or below ``types``.

        The search text is built per type, since each type declares its own searchable properties.
        """
        parts: list[DataFrame] = []
        for name in self.concrete(*types):
            df = self.table(name).where(F.col("tenant") == self.tenant)
            if not include_deleted:
                df = df.where(F.col("deleted_at").isNull())
            if with_search_text:
                df = df.withColumn(SEARCH_TEXT, searchable_text(self.schema.searchable(name)))
            parts.append(df)
        if not parts:
            fields = [T.StructField(n, t) for n, t in ENVELOPE.items()]
            fields += [T.StructField(p.name, p.spark_type) for p in self.properties(*types)]
            if with_search_text:
                fields.append(T.StructField(SEARCH_TEXT, T.StringType()))
            return self.spark.createDataFrame([], T.StructType(fields))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def read_many(self, ids: DataFrame, *types: str, columns: list[str] | None = None) -> DataFrame:
        """Live objects whose id is in ``ids`` (a DataFrame with a column ``id``).

        Missing, deleted and foreign ids are all simply absent. Spark picks a broadcast only when
        its statistics or the finished stage show the id set to be small.
        """
        rows = self.scan(*(types or [t.name for t in self.schema.types]))
        if columns:
            rows = rows.select(*columns)
        return rows.join(ids.select("id"), "id", "left_semi")

    def types_of(self, ids: DataFrame, *types: str) -> DataFrame:
        """(id, type) for every live id of the tenant; unknown ids are absent.

        Name the types the ids can have where they are known: the other tables are then not read.
        """
        return self.read_many(ids, *types, columns=["id", "type"])

    def read_typed(self, requests: DataFrame, *types: str) -> DataFrame:
        """Objects for (id, requested type) pairs whose stored type is that type or below it."""
        pairs = [(t.name, s) for t in self.schema.types for s in [a.name for a in self.schema.types] if self.schema.is_subtype(t.name, s)]
        allowed = self.spark.createDataFrame(pairs, "stored string, requested string")
        found = self.scan(*(types or [t.name for t in self.schema.types])).select(
            "id", "type", F.substring_index("type", "#", -1).alias("stored")
        )
        # The pair table has one row per declared (type, supertype): bounded by the schema.
        return (
            requests.select("id", "requested")
            .join(found, "id")
            .join(F.broadcast(allowed), ["stored", "requested"], "left_semi")
            .select("id", "requested", "type")
        )

    def view(self, *types: str, include_deleted: bool = False) -> DataFrame:
        """Object view: envelope plus properties under their short names."""
        props = [p.name for p in self.properties(*types)]
        rows = self.scan(*types, include_deleted=include_deleted)
        return rows.select(
            *[c for c in ENVELOPE if c != "deleted_at"],
            F.col("deleted_at").isNotNull().alias("deleted"),
            *[c for c in props if c in rows.columns],
        )


def write_table(df: DataFrame, root: str, name: str, sort_within: list[str] | None = None) -> None:
    """Write one type's table partitioned by tenant.

    ``sort_within`` (usually the indexed properties) orders rows inside each file so that parquet
    statistics let a filter skip row groups.
    """
    if sort_within:
        df = df.sortWithinPartitions("tenant", *sort_within)
    df.write.mode("overwrite").partitionBy("tenant").parquet(f"{root}/{name}")
