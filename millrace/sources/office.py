"""Office files as relations: spreadsheet grids and document paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import heading_level, style_level
from millrace.operators.tables import markdown_row
from millrace.sources.sheets import register


def read_grids(spark: SparkSession, path: str, fill_merged: bool = True) -> DataFrame:
    """path, sheet, row, col, value of spreadsheets: a task a sheet; comparisons of sheet, row and col reach the reader."""
    register(spark)
    return spark.read.format("sheet").option("merged", "fill" if fill_merged else "none").load(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, markdown of text documents: headings by style, else by outline mark; tables with a header rule."""
    register(spark)
    blocks = spark.read.format("paper").load(path)
    level = F.coalesce(F.nullif(style_level(F.col("style")), F.lit(0)), heading_level(F.col("text")))
    rows = F.transform("cells", markdown_row)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(F.element_at("cells", 1))), " | "), F.lit(" |"))
    table = F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, F.size(rows))), "\n")
    line = F.when(F.size("cells") > 0, table).when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "text")).otherwise(F.col("text"))
    lines = blocks.select("path", "position", line.alias("line")).where("line <> ''")
    return lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x.line), "\n\n").alias("markdown"))
