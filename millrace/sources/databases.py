"""Databases, the catalogue's tables, and appends to them."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import read_jdbc


def reachable(spark: SparkSession, url: str, **options: str) -> bool:
    """Whether a database answers SELECT 1."""
    try:
        return spark.read.format("jdbc").options(url=url, query="SELECT 1 AS one", **options).load().first() is not None
    except Exception as e:  # the driver's and Spark's errors share no narrower type
        if "ClassNotFound" in str(e) or "No suitable driver" in str(e):
            raise
        return False


def list_tables(spark: SparkSession, database: str | None = None) -> list[dict]:
    """Name, columns and rows of the catalogue's tables."""
    out = []
    for t in spark.catalog.listTables(database):
        name = t.name if t.isTemporary or not database else f"{database}.{t.name}"
        out.append({"name": t.name, "columns": [{"name": c.name, "type": c.dataType, "nullable": c.nullable} for c in spark.catalog.listColumns(name)], "rows": spark.table(name).count()})
    return out


def import_table(spark: SparkSession, source: DataFrame | str, target: str, url: str | None = None, limit: int | None = None) -> DataFrame:
    """A table (or a database's, by url) as CSV with a header; returns its row of the files table."""
    df = source if isinstance(source, DataFrame) else read_jdbc(spark, url, source) if url else spark.table(source)
    if limit:
        df = df.limit(limit)
    df.write.mode("overwrite").option("header", True).csv(target)
    fields = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for f in df.schema])
    return spark.read.option("header", True).csv(target).agg(F.count("*").alias("row_count")).select(F.lit(target).alias("file_path"), F.lit("csv").alias("file_type"), F.lit("completed").alias("status"), "row_count", fields.alias("field_schema"))


def append(df: DataFrame, path: str) -> None:
    """Rows added to a Parquet table, columns by name."""
    df.write.mode("append").parquet(path)


def upsert_registry(path: str, name: str, entry: dict | None) -> None:
    """Set a dataset's entry of the registry file, or delete it (None); the file is replaced as a whole."""
    entries = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            entries = json.load(f)
    entries.pop(name, None)
    if entry is not None:
        entries[name] = entry
    handle, own = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(entries, f, ensure_ascii=False, indent=2)
    os.replace(own, path)
