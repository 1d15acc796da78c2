"""Change feeds as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.search import newest, postings
from ..session import fresh_path, materialise

def read_feed(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def once_each(path: str, entry_id: str) -> Callable[[DataFrame, int], None]:
    """Batch function that writes every entry once to ``path/entries``, however late it comes again.

    The ids that earlier batches have handled are kept as a table by their hash; a repeated batch
    writes its own part again.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([entry_id])
        if batch_id:
            seen = spark.read.parquet(f"{path}/ids").where(F.col("batch") < batch_id).select(entry_id)
            fresh = fresh.join(seen, entry_id, "left_anti")
        write_batch(fresh, f"{path}/entries", batch_id)
        write_batch(spark.read.parquet(f"{path}/entries/batch={batch_id}").select(entry_id), f"{path}/ids", batch_id)

    return process


def run_to_table(stream: DataFrame, name: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Run until the available input is used up; the appended rows as a table.

    The file sink commits each micro-batch once, so a restarted run adds nothing twice.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, name)
    checkpoint = checkpoint or fresh_path(spark, f"{name}-progress")
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, name: str, process: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Run ``process(batch, batch_id)`` over the available input.

    A batch may be handed over again after a failure: ``process`` must write under its batch id.
    """
    spark = stream.sparkSession
    query = (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint or fresh_path(spark, f"{name}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One directory per batch, overwritten when the batch is repeated."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


# ---------------------------------------------------------------- search index


def maintain_index(path: str) -> Callable[[DataFrame, int], None]:
    """Batch function that keeps postings of changed objects (columns of a scan with search text).

    An object that changes several times in a batch is indexed as its last version is.

    Each batch writes the postings of its objects and the ids it replaces; see :func:`read_maintained`.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        batch = newest(batch)
        write_batch(batch.select("id").distinct(), f"{path}/ids", batch_id)
        write_batch(postings(batch.where(F.col("deleted_at").isNull())), f"{path}/postings", batch_id)

    return process


def read_maintained(spark: SparkSession, path: str) -> DataFrame:
    """Postings of every object as its last batch left them.

    The postings meet a join only if some object came in several batches: what those replaced is stored first.
    """
    rows = spark.read.parquet(f"{path}/postings")
    ids = spark.read.parquet(f"{path}/ids")
    last = ids.groupBy("id").agg(F.max("batch").alias("last"))
    old = materialise(ids.join(last, "id").where(F.col("batch") < F.col("last")).select("id", "batch"), "replaced")
    return (rows if old.isEmpty() else rows.join(old, ["id", "batch"], "left_anti")).drop("batch")


# ---------------------------------------------------------------- rejects


def park_bad_rows(path: str, decode: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """Batch function: rows that decode go to ``path/good``, the others with a reason to ``path/rejected``."""

    def process(batch: DataFrame, batch_id: int) -> None:
        good, bad = decode(batch)
        write_batch(good, f"{path}/good", batch_id)
        write_batch(bad, f"{path}/rejected", batch_id)

    return process
