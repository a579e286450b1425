"""Joins on keys of which some may hold a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is frequent if it holds more than 1 / FREQUENT of all rows, so fewer keys than that are frequent.
FREQUENT = 2000


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], n_col: str, total: int) -> DataFrame:
    """rows with the columns of keys, of which there is one row for each key (null counts as a key) with its number of rows.

    The fewer than FREQUENT frequent keys are broadcast; what is left is shuffled
    with at most total / FREQUENT rows a key. Both inputs are read twice, so they
    should be tables. Rows whose key is missing go.
    """
    often = keys.where(F.col(n_col) * FREQUENT > total)
    rare = keys.where(F.col(n_col) * FREQUENT <= total)
    r, k = rows.alias("r"), F.broadcast(often.alias("k"))
    pick = [*(f"r.{c}" for c in rows.columns), *(f"k.{c}" for c in keys.columns if c not in on)]
    cond = reduce(lambda x, y: x & y, [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in on])
    hot = r.join(k, cond).select(*pick)
    cold = r.join(k, cond, "left_anti").alias("r").join(rare.alias("k"), cond).select(*pick)
    return hot.unionByName(cold)
