"""Pages of placed characters, and the structure of grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.functions.text import strip_ws
from millrace.functions.vectors import cosine_or_zero


def page_lines(chars: DataFrame, keys: list[str], header: float = 0.05, footer: float = 0.95, tolerance: float = 3.0, top: str = "top", x: str = "x", height: str = "height", char: str = "char") -> DataFrame:
    """keys, lines: characters between header and footer, in lines whose characters lie within the tolerance of the line's first one."""
    kept = chars.where((F.col(top) >= F.col(height) * header) & (F.col(top) <= F.col(height) * footer))
    placed = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(top).cast("double").alias("t"), F.col(x).cast("double").alias("x"), F.col(char).alias("c")))).alias("_c"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<struct<n:int,x:double,c:string>>").alias("out"), F.lit(-1).alias("n"))

    def step(acc: Column, ch: Column) -> Column:
        new = acc.anchor.isNull() | (ch.t - acc.anchor > tolerance)
        n = F.when(new, acc.n + 1).otherwise(acc.n)
        return F.struct(F.when(new, ch.t).otherwise(acc.anchor).alias("anchor"), F.array_append(acc.out, F.struct(n.alias("n"), ch.x.alias("x"), ch.c.alias("c"))).alias("out"), n.alias("n"))

    numbered = placed.select(*keys, F.explode(F.aggregate("_c", start, step, lambda acc: acc.out)).alias("p"))
    lines = numbered.groupBy(*keys, F.col("p.n").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p.x", "p.c"))), lambda y: y.c), "").alias("line"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda y: y.line), "\n").alias("lines"))


def is_scanned(pages: DataFrame, doc: str, text: str, least: float = 10.0) -> DataFrame:
    """doc, scanned: fewer than ``least`` characters a page on average."""
    return pages.groupBy(doc).agg((F.avg(F.length(F.trim(F.coalesce(text, F.lit(""))))) < least).alias("scanned"))


def first_jump(df: DataFrame, group: str, order: str, value: str, least: float = 0.1) -> DataFrame:
    """group, at: the first place where the value rises or falls by more than ``least``."""
    w = W.Window.partitionBy(group).orderBy(order)
    moved = df.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(w)))
    return moved.groupBy(group).agg(F.min(F.when(F.col("_d") > least, F.col(order))).alias("at"))


def header_row(cells: Column, with_year_mark: bool = True) -> Column:
    """Whether a row of cells looks like a header: a year, a quarter or the name of a measure."""
    year = r"^\d{4}年?$" if with_year_mark else r"^\d{4}年$"
    return F.exists(cells, lambda c: c.rlike(year) | c.rlike(r"^(?i)q[1-4]$") | c.rlike("金额|数量|单价|合计|比例|增长|收入|成本|利润"))


#: What marks a third header row.
MEASURE_MARKS = ("销售额", "利润率", "指标", "数量", "金额")
_YEAR = r"^\d{4}年$"


def _filled(value: str) -> Column:
    """The stripped value, null if blank."""
    s = strip_ws(F.col(value).cast("string"))
    return F.when(s != "", s)


def grid_records(grid: DataFrame, row_header_cols: list[int] | None = None, fill: bool = True, sheet: str = "sheet", row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """CHK11: sheet, row (from 1), content: each data row of a sheet as ``name: value`` lines, row headers first.

    Header rows: one; two under a year; three if quarters and measures follow it.
    Names of several header rows carry the year and quarter to the right.
    Unless given, row headers are those of the first three columns whose data
    cells are text in over half of the rows; their blank cells take the value
    above. Of columns with one name the last value stands in the first's place.
    Sheets of a single row and rows without any value give nothing. Windows see
    one sheet's columns or one column's cells, which a sheet bounds.
    """
    cells = grid.select(F.col(sheet).alias("s"), F.col(row).alias("r"), F.col(col).alias("c"), _filled(value).alias("v"))
    at = lambda r: F.max(F.when(F.col("r") == r, F.col("v")))
    measure = F.col("v").rlike("|".join(MEASURE_MARKS))
    marked = lambda r, test: F.coalesce(F.bool_or((F.col("r") == r) & test), F.lit(False))
    sheets = cells.groupBy("s").agg(
        F.when(~marked(0, F.col("v").rlike(_YEAR)), 1).when(marked(1, F.col("v").rlike(r"^Q\d+$")) & marked(2, measure), 3).otherwise(2).alias("start"), (F.max("r") + 1).alias("rows")
    ).where("rows > 1")
    number = F.col("v").endswith("%") | F.col("v").try_cast("double").isNotNull()
    columns = cells.join(sheets, "s").groupBy("s", "c", "start", "rows").agg(at(0).alias("h0"), at(1).alias("h1"), at(2).alias("h2"), F.count_if((F.col("r") >= F.col("start")) & ~number).alias("texts"))
    w = W.Window.partitionBy("s").orderBy("c")
    carried = lambda h, shape: F.last(F.when(F.col(h).rlike(shape), F.col(h)), ignorenulls=True).over(w)
    plain = F.concat(F.lit("列"), (F.col("c") + 1).cast("string"))
    columns = columns.withColumn("year", carried("h0", _YEAR)).withColumn("quarter", carried("h1", r"^Q[1-4]$"))
    named = (
        F.when(F.col("start") == 1, F.col("h0")).when(F.col("start") == 2, F.when(F.col("h1").isNotNull(), F.concat_ws(" ", "year", "h1")).otherwise(F.col("year")))
        .otherwise(F.when(F.col("h2").isNotNull(), F.concat_ws(" ", "year", "quarter", "h2")))
    )
    own = F.coalesce(F.when(F.col("start") > 2, F.col("h2")), F.when(F.col("start") > 1, F.col("h1")), F.col("h0"))
    side = (F.col("c") < 3) & (F.col("texts") > (F.col("rows") - F.col("start")) * 0.5) if row_header_cols is None else F.col("c").isin(row_header_cols)
    place = F.col("c") if row_header_cols is None else F.array_position(F.array(*[F.lit(c) for c in row_header_cols]).cast("array<long>"), F.col("c").cast("long"))
    columns = columns.select("s", "c", "start", side.alias("side"), F.when(side, F.coalesce(own, plain)).otherwise(F.coalesce(named, plain)).alias("name"), F.when(side, place).otherwise(F.col("c")).cast("long").alias("place"))

    sides = cells.select("s", "r").distinct().join(columns.where("side"), "s").join(cells, ["s", "r", "c"], "left")
    if fill:
        above = W.Window.partitionBy("s", "c").orderBy("r").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
        sides = sides.withColumn("v", F.last("v", ignorenulls=True).over(above))
    every = sides.unionByName(cells.join(columns.where(~F.col("side")), ["s", "c"])).where("r >= start and v is not null")
    lines = every.groupBy("s", "r", "side", "name").agg(F.min("place").alias("place"), F.max_by("v", "place").alias("v"))
    parts = F.array_sort(F.collect_list(F.struct((~F.col("side")).alias("late"), "place", F.concat("name", F.lit(": "), "v").alias("line"))))
    return lines.groupBy("s", "r").agg(F.array_join(F.transform(parts, lambda x: x.line), "\n").alias("content")).select(F.col("s").alias(sheet), (F.col("r") + 1).alias(row), "content")


def table_bounds(grid: DataFrame, vector: str = "vec", most: int = 10, jump: float = 0.1, alone: float = 0.6, least: float = 0.7, sheet: str = "sheet", row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """CHK14: sheet, data_row, data_col: where a sheet's data begin, by the vectors of its cells.

    Leading blank cells of the first column and row are skipped. Of at most
    ``most`` rows, data begin where the mean cosine of neighbouring rows' cells
    rises by more than ``jump``. Of at most ``most`` columns, they begin where the
    mean cosine within a column's first five cells rises so; else at the first if it is over
    ``alone``, else at the first column over ``least``, else at the first.
    """
    cells = grid.select(F.col(sheet).alias("s"), F.col(row).alias("r"), F.col(col).alias("c"), _filled(value).alias("v"), F.col(vector).alias("x"))
    first = lambda of, other: F.coalesce(F.min(F.when((F.col(other) == 0) & F.col("v").isNotNull(), F.col(of))), F.lit(0))
    bounds = cells.groupBy("s").agg(first("r", "c").alias("r0"), first("c", "r").alias("c0"), (F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))
    block = cells.where(F.col("v").isNotNull()).join(bounds, "s").where((F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r0") + most) & (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c0") + most))
    block = block.select("s", (F.col("r") - F.col("r0")).alias("i"), (F.col("c") - F.col("c0")).alias("j"), "x")
    pairs = block.alias("a").join(block.alias("b"), (F.col("a.s") == F.col("b.s")) & (F.col("a.j") == F.col("b.j")) & (F.col("a.i") < F.col("b.i")))
    pairs = pairs.select("a.s", "a.j", F.col("a.i").alias("i"), F.col("b.i").alias("k"), cosine_or_zero(F.col("a.x"), F.col("b.x")).alias("sim"))

    def series(found: DataFrame, key: str, count: Column) -> DataFrame:
        """s, key, sim of every place below count, zero where nothing was found, and its rise."""
        places = bounds.where(count > 0).select("s", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias(key))
        w = W.Window.partitionBy("s").orderBy(key)
        return places.join(found, ["s", key], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0))).withColumn("rise", F.col("sim") - F.lag("sim").over(w))

    by_row = series(pairs.where("k = i + 1").groupBy("s", "i").agg(F.avg("sim").alias("sim")), "i", F.least(F.lit(most), F.col("rows") - F.col("r0")) - 1)
    by_col = series(pairs.where("k < 5").groupBy("s", "j").agg(F.when(F.count("*") >= 3, F.avg("sim")).alias("sim")), "j", F.least(F.lit(most), F.col("cols") - F.col("c0")))
    down = by_row.groupBy("s").agg(F.min(F.when(F.col("rise") > jump, F.col("i"))).alias("down"))
    over = F.when(F.max(F.when(F.col("j") == 0, F.col("sim"))) > alone, F.lit(0)).otherwise(F.min(F.when(F.col("sim") > least, F.col("j"))))
    right = by_col.groupBy("s").agg(F.coalesce(F.min(F.when(F.col("rise") > jump, F.col("j"))), over).alias("right"))
    begin = lambda at, move: (F.col(at) + F.coalesce(move, F.lit(0))).cast("long")
    return bounds.join(down, "s", "left").join(right, "s", "left").select(F.col("s").alias(sheet), begin("r0", "down").alias("data_row"), begin("c0", "right").alias("data_col"))


def gpu_usage(lines: Column) -> Column:
    """Index, name, used and total memory of a GPU's CSV line; busy from 90 % on."""
    row = F.from_csv(lines, "index int, name string, used double, total double", {"ignoreLeadingWhiteSpace": "true"})
    percent = F.round(row.used / row.total * 100, 1)
    return F.struct(row["index"].alias("index"), row["name"].alias("name"), percent.alias("used_percent"), (percent >= 90).alias("busy"))
