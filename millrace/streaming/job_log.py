"""Output of many running jobs as one stream, with a state for each job and a timer for its silence.

A job's lines come with their number. Blocks that open with a line of "{" and
close with the brace that balances it are left out, over batches too; lines that
came before are dropped, so a source that repeats itself gives no row twice; a
job ends with its first terminal status, or as stalled when the stream's time
has passed its last line by more than ``idle``; what comes after that is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.streaming.training_log import severity

TERMINAL = ("completed", "failed", "cancelled")
STALLED = "stalled"
OUT = ["job", "seq", "line", "ended"]
#: Jobs share a state and a timer by hash: a group costs milliseconds in Python, whatever it holds, and jobs are many.
SHARDS = 1024
#: States lie on disk, not in the memory of the executors.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def depth_after(depth: int, line: str) -> int:
    """Open braces after a line: outside of a block only a line of "{" opens one."""
    text = line.strip()
    if not depth:
        return int(text == "{")
    return max(0, depth - text.startswith("}") + text.endswith("{"))


def follow_shard(idle_us: int, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New lines of a shard's jobs, and the ends of those that fell silent by now.

    The state of a job: braces open, number and time of its last line, and its
    end. A shard's timer runs out when the first of its open jobs would stall.
    """
    jobs = {j[0]: tuple(j[1:]) for j in state.get[0]} if state.exists else {}
    came = [r for f in frames for r in zip(*(f[c].tolist() for c in ("job", "seq", "at", "line", "status")), strict=True)]
    found: list[tuple] = []
    for job, n, t, line, status in sorted(came, key=lambda r: r[1]):
        depth, seq, at, ended = jobs.get(job, (0, None, None, None))
        if ended or (seq is not None and n <= seq):
            continue
        if at is not None and t - at > idle_us:
            jobs[job] = (depth, seq, at, STALLED)
            found.append((job, seq, None, STALLED))
            continue
        line, shown = line or "", depth == 0
        depth = depth_after(depth, line)
        ended = status if status in TERMINAL else None
        jobs[job] = (depth, n, t, ended)
        if shown and depth == 0:
            found.append((job, n, line, None))
        if ended:
            found.append((job, n, None, ended))
    now, first = state.getCurrentWatermarkMs(), None
    for job, (depth, seq, at, ended) in jobs.items():
        if not ended:
            silent = (at + idle_us) // 1000
            if silent < now:
                jobs[job] = (depth, seq, at, STALLED)
                found.append((job, seq, None, STALLED))
            elif first is None or silent < first:
                first = silent
    state.update(([(job, *of) for job, of in jobs.items()],))
    if first is not None:
        state.setTimeoutTimestamp(max(first, 1))
    if found:
        yield pd.DataFrame(found, columns=OUT)


def job_lines(stream: DataFrame, job: str = "job", seq: str = "seq", ts: str = "ts", line: str = "line", status: str = "status", idle: str = "30 minutes", late: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """STM2, STM3: job, seq, line, severity, ended of a stream: a row for each line that is shown, and one with ``ended`` at a job's end.

    ``late``: how far behind the latest line of all jobs a line may come. A task
    sorts the lines of one shard of one batch, whose size the source bounds
    (``maxFilesPerTrigger``, ``maxBytesPerTrigger``). ``shards`` stays as it is
    for as long as a checkpoint is used.
    """
    spark = stream.sparkSession
    spark.conf.set(*STORE)
    idle_us = spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {idle}"))).first()[0]
    kind = dict(stream.dtypes)[job]
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    shard = F.pmod(F.xxhash64(F.col(job).cast("string")), F.lit(shards)).alias("shard")
    rows = timed.select(shard, F.col(job).cast("string").alias("job"), F.col(seq).cast("bigint").alias("seq"), F.col(ts), F.unix_micros(ts).alias("at"), F.col(line).alias("line"), F.col(status).alias("status"))
    state = "jobs array<struct<job string, depth int, seq bigint, at bigint, ended string>>"
    found = rows.groupBy("shard").applyInPandasWithState(partial(follow_shard, idle_us), "job string, seq bigint, line string, ended string", state, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("job", F.col("job").cast(kind)).withColumn("severity", F.when(F.col("line").isNotNull(), severity(F.col("line"))))


def follow_jobs(stream: DataFrame, folder: str, checkpoint: str, every: str | None = None, **names: str):
    """Append the lines and ends of a stream's jobs to a folder, each once, however often the query starts again; ``every`` keeps following."""
    writer = job_lines(stream, **names).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
