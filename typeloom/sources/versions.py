"""Versioned rows: newest version per object, active schema version, published snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(rows: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The row with the highest version per key.

    An aggregate rather than a ranking window: partial results are merged before the shuffle, so
    an object with very many versions costs no more than any other.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def singles(rows: DataFrame, key: str = "id") -> bool:
    """Whether no key comes twice: the rows are then their newest versions as they stand."""
    return rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty()


def overlay(base: DataFrame, delta: DataFrame, key: str = "id", single: bool = False) -> DataFrame:
    """A table with newer row versions laid over it, without rewriting the table.

    The delta is small beside the base, so Spark normally broadcasts its keys for the anti-join. ``single`` says that no
    key comes twice in it (see :func:`singles`), which spares the search for the newest.
    """
    newest = delta.select(*base.columns) if single else latest(delta.select(*base.columns), [key])
    return base.join(newest.select(key), key, "left_anti").select(*base.columns).unionByName(newest)


def active_documents(documents: DataFrame) -> DataFrame:
    """The active schema document per tenant: the one activated last."""
    return latest(documents.where(F.col("active")), ["tenant"])


def activate(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add each tenant's new document as version max+1 and make it the only active one."""
    top = documents.groupBy("tenant").agg(F.max("version").alias("_top"))
    fresh = (
        incoming.join(top, "tenant", "left")
        .withColumn("version", (F.coalesce(F.col("_top"), F.lit(0)) + 1).cast(documents.schema["version"].dataType))
        .withColumn("active", F.lit(True))
        .select(*documents.columns)
    )
    replaced = documents.join(incoming.select("tenant").distinct().withColumn("_new", F.lit(True)), "tenant", "left")
    kept = replaced.withColumn("active", F.col("active") & F.col("_new").isNull()).select(*documents.columns)
    return kept.unionByName(fresh)


_MANIFEST = T.StructType([T.StructField("snapshot", T.LongType()), T.StructField("path", T.StringType())])


def publish(df: DataFrame, root: str) -> int:
    """Write a complete snapshot, then name it in the manifest.

    Readers resolve the manifest first, so they see the old snapshot or the new one, never half of
    one. The manifest holds one tiny row per published snapshot.
    """
    spark = df.sparkSession
    number = (current_snapshot(spark, root) or 0) + 1
    path = f"{root}/v={number}"
    df.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(number, path)], _MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return number


def current_snapshot(spark: SparkSession, root: str) -> int | None:
    try:
        row = spark.read.schema(_MANIFEST).json(f"{root}/manifest").agg(F.max("snapshot")).first()
    except Exception as err:  # no snapshot has been published yet
        if "PATH_NOT_FOUND" in str(err):
            return None
        raise
    return row[0]


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    number = current_snapshot(spark, root)
    if number is None:
        raise FileNotFoundError(f"no snapshot published under {root}")
    return spark.read.parquet(f"{root}/v={number}")
