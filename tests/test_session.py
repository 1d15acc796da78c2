"""Session helpers: the work folder and the package on the workers."""

import os
import subprocess
import sys

import pytest

from typeloom import session


class Far:
    """A session on several machines without a shared folder."""

    class sparkContext:
        master = "spark://somewhere:7077"

        @staticmethod
        def getConf():
            return {}

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_no_folder_of_one_machine_on_a_cluster():
    with pytest.raises(session.NoSharedFolder):
        session.work_dir(Far)


def test_package_reaches_workers_from_any_folder(tmp_path):
    """A query with Python on the workers, from a folder where the package can't be imported."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from typeloom.plans.queries import QUERIES
print("ROWS", QUERIES["lifecycle_fold"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 1000" in done.stdout, done.stderr[-1500:]
