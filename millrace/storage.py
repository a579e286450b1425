"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of intermediate tables that are still there, by application.
_LEFT: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; only where it is unset (tests) a local one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is left of it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _LEFT:
        _LEFT[app] = set()
        atexit.register(_at_end, spark, app)
    _LEFT[app].add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: what follows does not depend on executors that ran before."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.millrace_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no plan reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.millrace_path)


def located(spark: SparkSession, path: str) -> tuple:
    """The file system that a path lies in, and the path there, as Hadoop resolves it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(target)


def _delete(spark: SparkSession, path: str) -> None:
    system, target = located(spark, path)
    system.delete(target, True)
    _LEFT.get(spark.sparkContext.applicationId, set()).discard(path)


def _at_end(spark: SparkSession, app: str) -> None:
    """The rest goes with the driver, unless its session has ended before."""
    if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
        for path in sorted(_LEFT.get(app, ())):
            _delete(spark, path)
