"""The append-only log of change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of change event.
KINDS = (
    "ObjectCreated",
    "ObjectUpdated",
    "ObjectDeleted",
    "TransitionFired",
    "ActionRequest",
    "TimerScheduled",
    "TimerCancelled",
    "SignalReceived",
)

# Fixed value: failed dispatches after which an entry is parked.
PARK_AFTER = 3

LOG_SCHEMA = (
    "entry_id string, tenant string, changeset_id string, seq int, kind string, object_id string, "
    "type string, version long, ontology_version int, occurred_at timestamp, payload string"
)


def unprocessed(log: DataFrame, kinds: tuple[str, ...] = KINDS, done: DataFrame | None = None, parked: DataFrame | None = None) -> DataFrame:
    """Entries of the wanted kinds that are neither done nor parked.

    Order them by ``(occurred_at, changeset_id, seq)`` when order matters to the reader.
    """
    rows = log.where(F.col("kind").isin(*kinds))
    for gone in (done, parked):
        if gone is not None:
            rows = rows.join(gone.select("entry_id").distinct(), "entry_id", "left_anti")
    return rows


def write_log(log: DataFrame, path: str) -> None:
    """Append; one directory per kind lets a reader of a few kinds skip the other files."""
    log.write.mode("append").partitionBy("kind").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def park_failures(failures: DataFrame) -> DataFrame:
    """Entries whose failures reached the limit, with the last error; the rest stay open.

    ``failures`` has one row per failed dispatch: (entry_id, attempted_at, error).
    """
    return (
        failures.groupBy("entry_id")
        .agg(F.count("*").alias("fail_count"), F.max_by("error", F.struct("attempted_at", "error")).alias("error"))
        .withColumn("parked", F.col("fail_count") >= PARK_AFTER)
    )
