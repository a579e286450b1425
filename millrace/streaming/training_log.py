"""Training logs as a stream: a file source over JSON lines, whose checkpoint is the offset."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ranking import shuffled_position

SCHEMA = "current_steps long, total_steps long, loss double, eval_loss double, predict_loss double, reward double, accuracy double, lr double, epoch double, percentage double, elapsed_time string, remaining_time string, throughput double, total_tokens long"


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """New rows of the log files in a folder."""
    return spark.readStream.schema(SCHEMA).json(folder)


def follow(log: DataFrame, checkpoint: str, push: Callable[[DataFrame, int], None], every: str | None = None):
    """Hand each batch of new rows to ``push``; a query that starts again goes on where it ended.

    ``every`` (such as "2 seconds") keeps following until the query is stopped;
    without it the rows that are there are handed on and the query ends.
    """
    writer = log.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def counted(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """df, and counters over its rows that can be read once an action has run: progress without a second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counters.items()]), seen


def shuffled_batches(rows: DataFrame, id_col: str, checkpoint: str, push: Callable[[DataFrame, int], None], seed: int = 42):
    """A stream whose batches are each put in the order of a hash of the id."""
    return rows.writeStream.foreachBatch(lambda df, n: push(df.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(id_col).cast("string"))), id_col), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def buffered_shuffle(rows: DataFrame, size: int = 16_384, seed: int = 42) -> DataFrame:
    """STM4: rows of a table or stream in an order that a buffer shuffles, in each partition (of each batch).

    A row that comes takes the place of a random row of the full buffer, which
    goes out; the rest goes out in random order at the end. A task holds one
    buffer, and one that runs again on the same rows gives the same order.
    """
    if size < 1:
        raise ValueError("a buffer holds at least one row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw, held = random.Random(seed), None
        for batch in batches:
            came = pa.Table.from_batches([batch])
            room = 0 if held is None else held.num_rows
            every = came if held is None else pa.concat_tables([held, came])
            kept, gone = list(range(min(size, every.num_rows))), []
            for new in range(max(size, room), every.num_rows):
                at = draw.randrange(size)
                gone.append(kept[at])
                kept[at] = new
            held = every.take(pa.array(kept, pa.int64())).combine_chunks()
            if gone:
                yield from every.take(pa.array(gone, pa.int64())).combine_chunks().to_batches()
        if held is not None:
            left = list(range(held.num_rows))
            draw.shuffle(left)
            yield from held.take(pa.array(left, pa.int64())).combine_chunks().to_batches()

    return rows.mapInArrow(run, rows.schema)


def split_stream(rows: DataFrame, id_col: str, held_out: int, folder: str, checkpoint: str, seed: int = 42):
    """STM4: a stream's first ``held_out`` rows, each batch in shuffled order, under folder/validation, the others under folder/train.

    Each batch writes its own subfolder, so a batch that runs again replaces
    what it wrote; rows held out before are counted from the files. A fraction
    is refused, since a stream has no known length.
    """
    if not isinstance(held_out, int) or isinstance(held_out, bool) or held_out < 1:
        raise ValueError("a stream's validation rows are a whole number of at least 1")

    def push(df: DataFrame, n: int) -> None:
        spark, place = df.sparkSession, f"{folder}/validation"
        before = spark.read.parquet(place).where(F.col("batch") < n).count() if n else 0
        placed = shuffled_position(df, id_col, seed, out="_place").persist()
        first = F.col("_place") < held_out - before
        for name, part in (("validation", placed.where(first)), ("train", placed.where(~first))):
            part.drop("_place").write.mode("overwrite").parquet(f"{folder}/{name}/batch={n}")
        placed.unpersist()

    return rows.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def severity(line: Column) -> Column:
    low = F.lower(line)
    return F.when(low.rlike("error|exception|traceback|failed"), "error").when(low.rlike("warn"), "warning").otherwise("info")


def remaining_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    return F.when(done > 0, elapsed / done * (total - done))
