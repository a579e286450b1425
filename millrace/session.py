"""Spark session defaults shared by tests, benchmarks and scripts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; an existing one is reused."""
    builder = SparkSession.builder.appName("millrace")
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | ({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}) | conf
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for work that costs far more than a shuffle, where its scan fills fewer tasks: a file of one row group is one task.

    Filled tasks are counted by a scan that reads no column. An input of at least
    as many row groups as there are cores is left as it is. The count runs while
    the plan is built.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    filled = df.select(F.spark_partition_id().alias("task")).distinct().count()
    return df.repartition(cores) if filled < cores else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers that don't start where it can be imported."""
    root = Path(__file__).resolve().parents[1]
    seen = [Path(p).resolve() for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()) if p]
    context = spark.sparkContext
    if root in seen or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="millrace-")  # the driver serves the file from here for as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/millrace", "zip", root, "millrace"))
