"""Exact positions without a single-task window.

Rows are counted by bucket of the order key first; running sums of the bucket
counts (few rows) give each bucket's offset, and rows are numbered within
their bucket. No task sees more than one bucket. Buckets are leading digits of
a hash, or ranges of ids between quantiles of all rows, so their number is
bounded however sparse the ids are.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Ranges of ids: each is sorted by one task.
RANGES = 1024


def with_position(df: DataFrame, bucket: Column, order: list[Column | str], within: list[str] = (), out: str = "position", total: str | None = None) -> DataFrame:
    """``out``: each row's place from 0 by (bucket, order) within the groups; ``total``: the group's rows."""
    marked = df.withColumn("_bucket", bucket)
    counts = marked.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    group = W.Window.partitionBy(*within)
    running = group.orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = counts.select(*within, "_bucket", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("_all"))
    own = W.Window.partitionBy(*within, "_bucket").orderBy(*order)
    out_df = marked.join(offsets, [*within, "_bucket"]).withColumn(out, F.row_number().over(own) - 1 + F.col("_before"))
    if total:
        out_df = out_df.withColumn(total, F.col("_all"))
    return out_df.drop("_bucket", "_before", "_all")


def shuffle_key(id_col: str, seed: int = 42) -> Column:
    """The deterministic random key of a row: md5 of seed and id."""
    return F.md5(F.concat(F.lit(str(seed)), F.col(id_col).cast("string")))


def shuffled_position(df: DataFrame, id_col: str, seed: int = 42, within: list[str] = (), out: str = "position", total: str | None = None, digits: int = 3) -> DataFrame:
    """Positions in the shuffled order; buckets are the leading hexadecimal digits of the key."""
    keyed = df.withColumn("_key", shuffle_key(id_col, seed))
    return with_position(keyed, F.substring("_key", 1, digits), ["_key", id_col], within, out, total).drop("_key")


def range_splitters(df: DataFrame, id_col: str, ranges: int = RANGES) -> list:
    """Values that cut an order key into ranges of about equal numbers of rows: a mergeable sketch over all rows, its result on the driver. Runs a job."""
    probs = [k / ranges for k in range(1, ranges)]
    found = df.select(F.percentile_approx(id_col, probs, 10 * ranges).alias("v")).first().v
    return sorted(set(found or ()))


def literal_array(values: list, kind: str) -> Column:
    """A constant array, given as one literal."""
    return F.from_json(F.lit(json.dumps(values, default=str)), f"array<{kind}>")


def range_of(value: Column, splitters: list, kind: str) -> Column:
    """How many splitters are not above value, by halving: as many steps as their number has binary digits. Null: 0."""
    steps = [1 << k for k in reversed(range(len(splitters).bit_length()))]
    if not steps:
        return F.lit(0)
    table = literal_array(splitters, kind)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.try_element_at(table, low + step) <= value, low + step).otherwise(low))


def ordered_position(df: DataFrame, id_col: str, within: list[str] = (), out: str = "position", total: str | None = None, width: int | None = None) -> DataFrame:
    """Positions in the order of an id; buckets are ranges that hold about equal numbers of rows, however dense or sparse the ids are.

    Jobs that run while the plan is built find the ranges, and without groups count
    them: a few numbers for each of ``RANGES`` on the driver, then no join and no task
    over all rows or all counts. ``width``: ranges of ids of that width instead. A
    null id comes first.
    """
    if width:
        return with_position(df, F.floor(F.col(id_col) / width), [id_col], within, out, total)
    kind = dict(df.dtypes)[id_col]
    splitters = range_splitters(df, id_col)
    bucket = range_of(F.col(id_col), splitters, kind)
    if within:
        return with_position(df, bucket, [id_col], within, out, total)
    counts = dict(df.groupBy(bucket.alias("b")).count().collect())
    before = [0]
    for k in range(len(splitters) + 1):
        before.append(before[-1] + counts.get(k, 0))
    own = W.Window.partitionBy("_bucket").orderBy(id_col)
    placed = df.withColumn("_bucket", bucket).withColumn(out, F.row_number().over(own) - 1 + F.element_at(literal_array(before, "bigint"), F.col("_bucket") + 1))
    return (placed.withColumn(total, F.lit(before[-1]).cast("long")) if total else placed).drop("_bucket")


def framed(df: DataFrame, id_col: str, within: list[str], reach: int, size: int = 4096) -> tuple[DataFrame, W.WindowSpec]:
    """df in blocks of positions, and the window over a block; each block has ``reach`` rows of its neighbours, for which ``_own`` is false.

    Frames of up to ``reach`` rows before and after are whole for the own rows,
    and no task sees more than a block, however many rows a group has.
    """
    at = lambda shift: F.floor((F.col("_p") + shift) / size)
    placed = ordered_position(df, id_col, within, "_p").withColumn("_block", F.explode(F.array_distinct(F.array(at(-reach), at(0), at(reach)))))
    return placed.withColumn("_own", F.col("_block") == at(0)), W.Window.partitionBy(*within, "_block").orderBy("_p")


def attach(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a table of at most one row, which is broadcast; nulls if it has none."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(row.limit(1).withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
