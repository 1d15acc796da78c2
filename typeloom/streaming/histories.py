"""Lifecycles over micro-batches without gathering an object's rows in one task.

The counterpart of :mod:`lifecycle` for feeds in which one object may own a large part of a
micro-batch: each batch is folded in chunks, starting from the states the last batch left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Machine
from ..operators.lifecycle import fold, transition_log


class HistoryKeeper:
    """``process(batch, batch_id)`` for ``foreachBatch``; batches arrive in time order.

    ``root/log`` collects fired transitions, ``root/states`` the state each object was left in. A
    repeated batch overwrites its own directories and only reads those of earlier batches.
    """

    def __init__(self, spark: SparkSession, machine: Machine, root: str, key: str = "id", order: tuple[str, ...] = ("ts", "seq")) -> None:
        self.spark, self.machine, self.root, self.key, self.order = spark, machine, root, key, order

    def _shape(self, commands: DataFrame) -> str:
        kind = commands.schema[self.key].dataType.simpleString()
        return f"{self.key} {kind}, state string, batch long"

    def states(self, commands: DataFrame, before: int) -> DataFrame | None:
        """(key, state) as the batches before ``before`` left them."""
        try:
            rows = self.spark.read.schema(self._shape(commands)).parquet(f"{self.root}/states")
        except Exception as err:  # this is the first batch
            if "PATH_NOT_FOUND" in str(err):
                return None
            raise
        return rows.where(F.col("batch") < before).groupBy(self.key).agg(F.max_by("state", "batch").alias("state"))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        start = self.states(batch, batch_id) if batch_id > 0 else None
        history = fold(batch, self.machine, self.key, self.order, start=start)
        log = transition_log(history).drop("_chunk", "fired")
        log.write.mode("overwrite").parquet(f"{self.root}/log/batch={batch_id}")
        left = history.groupBy(self.key).agg(F.max_by("to_state", F.struct(*self.order)).alias("state"))
        left.write.mode("overwrite").parquet(f"{self.root}/states/batch={batch_id}")
