"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join side is split even where the join's partitioning is used again further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings, all of which can be changed on a live session, and give the workers the package."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers as a zip, once per application.

    Functions that run there are known by name, and a worker has its own working directory.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="typeloom-package-")  # on the driver, which serves the file
    path = os.path.join(folder, "typeloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(package)))
    context.addPyFile(path)


class NoSharedFolder(RuntimeError):
    pass


def work_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    Only where the setting is missing and the driver is the only machine, as in local tests, is a
    folder of this machine used: on several machines the executors would each write to their own disk,
    and a later read would miss rows without an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not is_local(spark):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "typeloom-work")
    return root


def settled(df: DataFrame) -> DataFrame:
    """The same rows with every column worked out exactly once.

    A filter on a computed column is otherwise pushed into the projection below it, which repeats
    the column's whole expression in the filter; a generator's output is not pushed.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage with files that outlive any executor, and fixes values (such as partition
    numbers) that a recomputation could otherwise change.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
