"""Tables: profiles of columns, repair of missing values, grids and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.functions.text import is_blank, parse_date, strip_ws
from millrace.operators.ranking import attach


def melt(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """column, position, value (text) rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.col(order).alias("position"), F.explode(cells).alias("c")).select("c.column", "position", "c.value")


def profile(df: DataFrame, columns: list[str], order: str, samples: int = 3, date_rows: int = 20) -> DataFrame:
    """column, n, n_missing, missing_rate, inferred type, mode and first samples, in one pass over the melted rows.

    A type is boolean if all values are yes or no words, numeric above 80 %,
    date if over half of the first rows are. First rows and the mode come from
    bounded or pre-aggregated states, never from a window over a column.
    """
    cells = melt(df, columns, order)
    s = strip_ws(F.col("value"))
    blank = is_blank(F.col("value"))
    number = F.regexp_replace(s, ",", "").try_cast("double")
    flag = F.lower(s).isin("true", "false", "是", "否", "yes", "no", "0", "1")
    ok = ~blank
    facts = cells.groupBy("column").agg(
        F.count("*").alias("n"), F.count_if(blank).alias("n_missing"), F.count_if(ok & flag).alias("_flag"), F.count_if(ok & number.isNotNull()).alias("_number"),
        F.count_if(ok & number.isNotNull() & (number != F.floor(number))).alias("_fraction"),
    )
    # the first rows of each column: ranked with a limit, so tasks cut before the shuffle
    first = W.Window.partitionBy("column").orderBy("position")
    head = cells.where(ok).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= date_rows)
    heads = head.groupBy("column").agg(
        F.count_if(parse_date(F.col("value")).isNotNull()).alias("_date"), F.count("*").alias("_head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= samples, F.struct("_r", "value")))), lambda x: x.value), "|").alias("samples"),
    )
    modes = cells.where(ok).groupBy("column", "value").count().groupBy("column").agg(F.max(F.struct("count")).alias("_m"), F.count("*").alias("n_distinct"))
    best = cells.where(ok).groupBy("column", "value").count().join(modes.select("column", F.col("_m.count").alias("count")), ["column", "count"]).groupBy("column").agg(F.min("value").alias("mode"))
    some = F.col("n") - F.col("n_missing")
    kind = (
        F.when(some == 0, "string").when(F.col("_flag") == some, "boolean").when(F.col("_number") > 0.8 * some, F.when(F.col("_fraction") > 0, "float").otherwise("integer"))
        .when(F.col("_date") > 0.5 * F.col("_head"), "date").otherwise("string")
    )
    out = facts.join(heads, "column", "left").join(best, "column", "left")
    return out.select("column", "n", "n_missing", F.round(F.col("n_missing") / F.col("n"), 4).alias("missing_rate"), kind.alias("type"), "mode", F.coalesce("samples", F.lit("")).alias("samples"))


def column_mode(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value that isn't blank, ties to the smallest."""
    counts = df.where(~is_blank(F.col(column))).groupBy(column).count()
    return counts.orderBy(F.desc("count"), column).limit(1).select(F.col(column).alias("_mode"))


def repair_missing(df: DataFrame, policies: list[tuple[str, str, str | None]]) -> DataFrame:
    """Policies (column, ignore | drop_row | fill_mode | fill_default, value) one after the other: a mode is that of the rows left by then."""
    for column, policy, value in policies:
        blank = is_blank(F.col(column))
        if policy == "drop_row":
            df = df.where(~blank)
        elif policy == "fill_default":
            df = df.withColumn(column, F.when(blank, F.lit(value)).otherwise(F.col(column)))
        elif policy == "fill_mode":
            df = attach(df, column_mode(df, column)).withColumn(column, F.when(blank & F.col("_mode").isNotNull(), F.col("_mode")).otherwise(F.col(column))).drop("_mode")
        elif policy != "ignore":
            raise ValueError(f"unknown policy {policy}")
    return df


def fill_forward(df: DataFrame, group: str, order: str, column: str, out: str) -> DataFrame:
    """The last value that isn't blank up to each row."""
    w = W.Window.partitionBy(group).orderBy(order).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    return df.withColumn(out, F.last(F.when(~is_blank(F.col(column)), F.col(column)), ignorenulls=True).over(w))


def markdown_cell(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r?\n", " "), F.lit("|"), F.lit("\\|"))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, markdown_cell), " | "), F.lit(" |"))


def grid_to_markdown(grid: DataFrame, sheet: str = "sheet", row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """sheet, markdown: the long grid's rows padded to the sheet's width, the first as header."""
    width = grid.groupBy(sheet).agg(F.max(col).alias("_w"))
    rows = grid.join(width, sheet).groupBy(sheet, row, "_w").agg(F.map_from_entries(F.collect_list(F.struct(col, F.coalesce(F.col(value), F.lit(""))))).alias("_c"))
    line = markdown_row(F.transform(F.sequence(F.lit(0), F.col("_w").cast("int")), lambda i: F.coalesce(F.try_element_at("_c", i), F.lit(""))))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("_w").cast("int") + 1), " | "), F.lit(" |"))
    lines = rows.select(sheet, row, line.alias("_l"), rule.alias("_r"))
    ordered = lines.groupBy(sheet).agg(F.array_sort(F.collect_list(F.struct(row, "_l"))).alias("_ls"), F.first("_r").alias("_r"))
    texts = F.transform("_ls", lambda x: x._l)
    return ordered.select(sheet, F.array_join(F.concat(F.slice(texts, 1, 1), F.array("_r"), F.slice(texts, 2, F.size("_ls"))), "\n").alias("markdown"))


def grid_to_lines(grid: DataFrame, header_rows: int, header_cols: int, sheet: str = "sheet", row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """sheet, row, line: ``header‖row header‖value`` of every filled body cell; headers of several rows run together."""
    v = F.coalesce(F.col(value), F.lit(""))
    heads = grid.where((F.col(row) < header_rows) & (F.col(col) >= header_cols)).groupBy(sheet, col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(row, v.alias("v")))), lambda x: x.v), "").alias("_h"))
    sides = grid.where((F.col(row) >= header_rows) & (F.col(col) < header_cols)).groupBy(sheet, row).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(col, v.alias("v")))), lambda x: x.v), "").alias("_s"))
    body = grid.where((F.col(row) >= header_rows) & (F.col(col) >= header_cols) & (F.trim(v) != ""))
    cells = body.join(heads, [sheet, col], "left").join(sides, [sheet, row], "left").select(sheet, row, col, F.concat_ws("‖", "_h", "_s", v).alias("_t"))
    return cells.groupBy(sheet, row).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(col, "_t"))), lambda x: x._t), "\n").alias("line"))
