"""Files to DataFrames: encodings, formats by extension, previews, counts and the dataset registry."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "gbk", "gb2312", "utf-8-sig", "latin1")
#: Reader of each extension.
READERS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text", "arrow": "arrow", "orc": "orc"}
#: Kind of document by extension.
KINDS = {"doc": "docx", "docx": "docx", "xls": "xlsx", "xlsx": "xlsx", "csv": "csv", "pdf": "pdf", "md": "md", "markdown": "md", "txt": "txt"}


def file_kind(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(table[F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))], F.lit("txt"))


def _decode(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    for encoding in ENCODINGS:
        try:
            return raw.decode("utf-8-sig" if encoding == "utf-8" else encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "ignore")


@F.pandas_udf(T.StringType())
def _decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(_decode)


def decoded(raw: Column) -> Column:
    """Bytes as text: valid UTF-8 stays in the JVM, other encodings are tried in turn."""
    text = raw.cast("string")
    valid = F.is_valid_utf8(text)
    return F.when(valid, F.regexp_replace(text, "^\ufeff", "")).otherwise(_decoded(F.when(~valid, raw)))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))


def read_csv_any(spark: SparkSession, path: str) -> DataFrame:
    """path, row, cells of CSV files in any of the encodings: each file is decoded whole, then cut into lines."""
    lines = read_texts(spark, path).select("path", F.posexplode(F.split("text", "\r?\n")).alias("row", "line")).where(F.trim("line") != "")
    cells = F.transform(F.regexp_extract_all(F.concat("line", F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,]*),'), 1), lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return lines.select("path", "row", cells.alias("cells"))


def read_csv(spark: SparkSession, path: str, header: bool = True, encoding: str = "utf-8") -> DataFrame:
    """All columns as text; types are inferred by operators.tables.profile."""
    return spark.read.option("header", header).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path)


def read_any(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of one type by extension."""
    kinds = {p.rsplit(".", 1)[-1].lower() for p in paths}
    if len(kinds) != 1 or not (kind := kinds.pop()) in READERS:
        raise ValueError(f"files must share a known type, got {sorted({p.rsplit('.', 1)[-1] for p in paths})}")
    reader = spark.read.format(READERS[kind])
    if kind == "csv":
        reader = reader.option("header", True)
    if kind == "json":
        reader = reader.option("multiLine", True)
    return reader.load(paths)


def preview(df: DataFrame, order: list[str], rows: int = 5) -> tuple[DataFrame, int]:
    """The first rows and how many there are."""
    return df.orderBy(*order).limit(rows), df.count()


def sample_count(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank, or elements of a JSON array."""
    if path.endswith(".json"):
        return spark.read.option("multiLine", True).json(path).count()
    return spark.read.text(path).where(F.trim("value") != "").count()


def sniff_format(df: DataFrame) -> str:
    return "sharegpt" if {"conversations", "messages"} & set(df.columns) else "alpaca"


def coalesced(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of these columns that is present and not empty."""
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in names if c in df.columns], F.lit(""))


#: Aliases of columns in imported question files.
QUESTION_ALIASES = ("instruction", "question", "content", "prompt", "query")
ANSWER_ALIASES = ("output", "answer", "response", "chosen")


def import_pairs(df: DataFrame) -> DataFrame:
    """question, answer, rejected, is_dpo of an imported table."""
    rejected = coalesced(df, ("rejected", "rejected_answer"))
    return df.select(coalesced(df, QUESTION_ALIASES).alias("question"), coalesced(df, ANSWER_ALIASES).alias("answer"), rejected.alias("rejected"), (rejected != "").alias("is_dpo"))


@dataclass
class Registered:
    """A registry entry: where a dataset lies and how its columns are named."""

    name: str
    source: str
    location: str
    formatting: str = "alpaca"
    ranking: bool = False
    num_samples: int | None = None
    columns: dict[str, str] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, name: str, entry: dict) -> Registered:
        """Hub before script before cloud before file."""
        for key, source in (("hf_hub_url", "hub"), ("ms_hub_url", "hub"), ("om_hub_url", "hub"), ("script_url", "script"), ("cloud_file_name", "cloud"), ("file_name", "file")):
            if key in entry:
                return cls(name, source, entry[key], entry.get("formatting", "alpaca"), entry.get("ranking", False), entry.get("num_samples"), entry.get("columns", {}), entry.get("tags", {}))
        raise ValueError(f"{name} names no place")


def read_registry(path: str) -> dict[str, Registered]:
    with open(path, encoding="utf-8") as f:
        return {k: Registered.of(k, v) for k, v in json.load(f).items()}


#: Default port of each database.
PORTS = {"mysql": 3306, "postgresql": 5432}


def jdbc_url(kind: str, host: str = "", port: int | None = None, database: str = "") -> str:
    if kind == "sqlite":
        return f"jdbc:sqlite:{database}"
    if kind not in PORTS:
        raise ValueError(f"unknown database {kind}")
    return f"jdbc:{kind}://{host}:{port or PORTS[kind]}/{database}"


def read_jdbc(spark: SparkSession, url: str, table: str, limit: int | None = None, **options: str) -> DataFrame:
    query = f"SELECT * FROM {table}" + (f" LIMIT {limit}" if limit else "")
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def key_ranges(spark: SparkSession, url: str, table: str, key: str, parts: int, buckets: int = 256, **options: str) -> tuple[list[tuple[int, int]], int]:
    """Half-open ranges of an integer key, named as the database writes it, that hold about equal numbers of rows, and how many rows have no key.

    The database counts: a histogram over the whole span, then one over each
    bucket that holds more than a quarter of a part, until none does or it is a
    single key. At most ``buckets`` rows come back from a query, whatever the
    table's size.
    """

    def ask(sql: str) -> list:
        return spark.read.format("jdbc").options(url=url, query=sql, **options).load().collect()

    low, high, n, rows = ask(f"SELECT MIN({key}) AS low, MAX({key}) AS high, COUNT({key}) AS n, COUNT(*) AS every_row FROM {table}")[0]
    if not n:
        return [], int(rows)
    low, high = int(low), int(high)
    heavy, done = [(low, high + 1, int(n))], []
    while heavy:
        a, b, count = heavy.pop()
        if count * 4 * parts <= n or b - a == 1:
            done.append((a, b, count))
            continue
        width = max(1, -(-(b - a) // buckets))
        place = f"FLOOR(({key} - ({a})) / {width}.0E0)"
        found = ask(f"SELECT b, COUNT(*) AS c FROM (SELECT {place} AS b FROM {table} WHERE {key} >= {a} AND {key} < {b}) x GROUP BY b")
        for bucket, c in ((int(r[0]), int(r[1])) for r in found):
            start = a + bucket * width
            heavy.append((start, min(b, start + width), c))
    out, held, want = [], 0, n / parts
    for a, _, count in sorted(done):
        if not out or held + count / 2 > want:
            out.append(a)
            held = 0
        held += count
    return list(zip(out, [*out[1:], high + 1], strict=True)), int(rows - n)


def read_split(spark: SparkSession, url: str, table: str, key: str, parts: int, **options: str) -> DataFrame:
    """SRC10: a database table over several connections, each a range of an integer key with about as many rows as the others; rows without a key are a part of their own."""
    ranges, without = key_ranges(spark, url, table, key, parts, **options)
    where = [f"{key} >= {a} AND {key} < {b}" for a, b in ranges]
    if without or not where:
        where = [*where, f"{key} IS NULL"]
    return spark.read.jdbc(url, table, predicates=where, properties=options)
