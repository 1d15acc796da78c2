"""Differences between datasets, and three-way differences between copies of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(**frames: DataFrame) -> DataFrame:
    """Distinct rows with one flag per frame that holds them.

    Copies of a row are merged before the shuffle, so a row repeated very often costs nothing.
    """
    cols = next(iter(frames.values())).columns
    tagged = None
    for name, df in frames.items():
        part = df.select(*cols, F.lit(name).alias("_side"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy(*cols).agg(*[F.max(F.col("_side") == n).alias(f"_in_{n}") for n in frames])


def dataset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of one side only, with ``change`` = added or removed (set semantics)."""
    rows = _sides(old=old, new=new).where(F.col("_in_old") != F.col("_in_new"))
    return rows.withColumn("change", F.when(F.col("_in_new"), F.lit("added")).otherwise(F.lit("removed"))).drop("_in_old", "_in_new")


def diff_by_key(diff: DataFrame, key: str) -> DataFrame:
    return diff.groupBy(key).agg(
        F.count(F.when(F.col("change") == "added", 1)).alias("added"), F.count(F.when(F.col("change") == "removed", 1)).alias("removed")
    )


def apply_delta(base: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Take ``removed`` out, then put ``added`` in: a row in both ends up present."""
    rows = _sides(base=base, added=added, removed=removed)
    return rows.where(F.col("_in_added") | (F.col("_in_base") & ~F.col("_in_removed"))).select(*base.columns)


def three_way(base: DataFrame, local: DataFrame, server: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per key and field: values, what each copy changed, and whether the changes conflict.

    All three are unique on the key, so both outer joins share one partitioning.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, *[F.col(f).cast("string").alias(f"_{name}_{f}") for f in fields])

    rows = side(base, "base").join(side(local, "local"), key, "full_outer").join(side(server, "server"), key, "full_outer")
    cells = [
        F.struct(F.lit(f).alias("field"), *[F.col(f"_{n}_{f}").alias(n) for n in ("base", "local", "server")]) for f in fields
    ]
    d = rows.select(key, F.explode(F.array(*cells)).alias("d")).select(key, "d.*")
    local_changed = ~F.col("local").eqNullSafe(F.col("base"))
    server_changed = ~F.col("server").eqNullSafe(F.col("base"))
    conflict = local_changed & server_changed & ~F.col("local").eqNullSafe(F.col("server"))
    return d.select("*", local_changed.alias("local_changed"), server_changed.alias("server_changed"), conflict.alias("conflict"))


def reapply_local(diff: DataFrame) -> DataFrame:
    """The local value where it changed, else the server's; absent values are dropped."""
    value = F.when(F.col("local_changed"), F.col("local")).otherwise(F.col("server"))
    return diff.withColumn("value", value).where(F.col("value").isNotNull()).drop(
        "base", "local", "server", "local_changed", "server_changed", "conflict"
    )
