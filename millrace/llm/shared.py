"""Tables and paths in the shared folder, and how many shards the cluster is set to."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.storage import drop_written, fresh_path, shared_dir, written

__all__ = ["drop_written", "fresh_path", "partitions", "shared_dir", "written"]


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions, which the cluster sizes to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
