"""The relational core: filters, updates, joins, pages and summaries of catalogue tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def where_equal(df: DataFrame, **values) -> DataFrame:
    """A conjunction of equalities; null asks for null, unknown columns are ignored."""
    tests = [F.col(k).isNull() if v is None else F.col(k) == F.lit(v) for k, v in values.items() if k in df.columns]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def where_in(df: DataFrame, column: str, values: DataFrame | list) -> DataFrame:
    """A short list as an IN predicate that reaches the scan; a table as a semi-join."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(column)).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(values))


def search(df: DataFrame, keyword: str, *columns: str) -> DataFrame:
    """Rows in which some column contains the keyword, case aside."""
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(keyword.lower()), F.lit(False)) for c in columns]))


def page(df: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """One page in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def latest(df: DataFrame, key: str, order: list[str], column: list[str]) -> DataFrame:
    """The greatest row of each key by order: a pre-aggregated maximum, no sort."""
    best = df.groupBy(key).agg(F.max(F.struct(*order, *[c for c in column if c not in order])).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in column])


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Columns replaced where the condition holds at the time of the update."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def delete_cascade(parents: DataFrame, gone: DataFrame, key: str, *children: tuple[DataFrame, str, str]) -> list[DataFrame]:
    """Parents without the gone keys, and children (table, own key, parent key) of those that stay, level by level."""
    out = [parents.join(gone.select(key).distinct(), key, "left_anti")]
    lost = gone.select(F.col(key).alias("_k")).distinct()
    for table, own, parent in children:
        hit = table.join(lost, table[parent] == lost["_k"], "left_semi")
        out.append(table.join(lost, table[parent] == lost["_k"], "left_anti"))
        lost = hit.select(F.col(own).alias("_k")).distinct()
    return out


def merge_fields(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows updated by new ones of the same key, unknown keys appended."""
    names = [c for c in old.columns if c != key]
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in names])


def merge_json(old: Column, new: Column) -> Column:
    """Shallow merge of two maps; keys of the new one win."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def complete_missing(expected: DataFrame, present: DataFrame, key: str, **placeholder: Column) -> DataFrame:
    """Present rows and a placeholder for every expected key without one."""
    lost = expected.select(key).distinct().join(present.select(key), key, "left_anti")
    return present.unionByName(lost.withColumns(placeholder), allowMissingColumns=True)


def default_for(configs: DataFrame, project: str, owner: str = "project_id") -> DataFrame:
    """The project's own default, else the global one (no owner)."""
    own = configs.where((F.col("is_default") == "true") & ((F.col(owner) == project) | F.col(owner).isNull()))
    return own.orderBy(F.col(owner).isNull(), "id").limit(1)


def by_status(*conditions: tuple[str, Column]) -> list[Column]:
    """A filtered count for each name."""
    return [F.count_if(c).alias(n) for n, c in conditions]


def interleaved_pages(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("rank", F.row_number().over(W.Window.partitionBy(key).orderBy(order))).where(F.col("rank") <= n)


def manual_pairs(df: DataFrame, batch: Column, question: str = "question", answer: str = "answer", rejected: str = "rejected", kind: str = "question_type", given: str = "batch_id") -> DataFrame:
    """Rows of pairs entered by hand: preference pairs by their type or a rejected answer; the given batch, else the new one."""
    is_dpo = (F.coalesce(F.col(kind), F.lit("")) == "dpo") | (F.coalesce(F.col(rejected), F.lit("")) != "")
    own = [c for c in df.columns if c not in (question, answer, rejected, kind, given)]
    return df.select(*own, F.col(question).alias("content"), F.col(answer).alias("answer"), F.when(is_dpo, F.col(rejected)).alias("rejected_answer"), is_dpo.alias("is_dpo"), F.when(is_dpo, "dpo").otherwise("manual").alias("question_type"), F.coalesce(F.col(given), batch).alias("batch_id"), F.lit("completed").alias("answer_status"))
