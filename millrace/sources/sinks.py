"""Writers for training sets, run folders and pages."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import safe_filename
from millrace.storage import located

#: What Spark escapes in the names of partition folders.
_ODD = re.compile(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
#: Rows that a task turns into Python objects at once.
_PIECE = 256


def export_splits(df: DataFrame, path: str, split: str = "split", fmt: str = "json") -> DataFrame:
    """Rows in one folder a split; returns the rows of each split."""
    df.write.mode("overwrite").partitionBy(split).format(fmt).save(path)
    return df.groupBy(split).agg(F.count("*").alias("n"))


def run_folder(pairs: DataFrame, path: str, file: str = "file_id") -> None:
    """Question and answer pairs by file, and the summary of each."""
    rows = pairs.select(file, F.to_json(F.struct([c for c in pairs.columns if c != file])).alias("value"))
    _folders(rows.sortWithinPartitions(file), f"{path}/qa_pairs", file, "json")
    pairs.groupBy(file).agg(F.count("*").alias("qa_count")).write.mode("overwrite").json(f"{path}/summary")


def page_document(pages: DataFrame, title: str, url: str, content: str) -> DataFrame:
    """filename and Markdown of pages that have content."""
    kept = pages.where(F.trim(F.coalesce(content, F.lit(""))) != "")
    return kept.select(F.concat(safe_filename(F.col(title)), F.lit(".md")).alias("filename"), F.concat(F.lit("# "), F.col(title), F.lit("\n\n> 来源: "), F.col(url), F.lit("\n\n"), F.col(content)).alias("document"))


def ready_documents(chunks: DataFrame, path: str, file: str = "file_id", order: str = "index", text: str = "content") -> DataFrame:
    """The Markdown of each file put together from its chunks, one folder a file; returns file and document."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    out = chunks.groupBy(file).agg(F.array_join(F.transform(parts, lambda p: p[text]), "\n\n").alias("document"))
    _folders(out, path, file, "txt")
    return out


def folder_name(column: str, value: str | None) -> str:
    """The folder that Spark's partitioned writer gives a value."""
    return f"{column}=" + (_ODD.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__")


def _folders(rows: DataFrame, path: str, file: str, ending: str) -> None:
    """Lines by file (the other column) in one folder a file, as ``write.partitionBy(file).text(path)`` lays them out, over what was there.

    Rows of one file that follow each other in a partition make one file. In a
    mounted folder Spark's writer starts processes for each file that it makes, to
    set permissions, and files are many; so tasks write there themselves, into a
    hidden folder that takes the old one's place once all have ended. Any other
    store gets Spark's writer.
    """
    spark = rows.sparkSession
    system, target = located(spark, path)
    if target.toUri().getScheme() != "file":
        rows.write.mode("overwrite").partitionBy(file).text(path)
        return
    hidden = f"{target.getParent().toUri().getPath()}/.{target.getName()}-{uuid.uuid4().hex}"
    staged = located(spark, f"file://{hidden}")[1]
    (value,) = (c for c in rows.columns if c != file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task that runs again makes the same files and replaces them; what a lost one leaves has a hidden name
        own, count, last, out = f"part-{TaskContext.get().partitionId():05d}", 0, None, None
        name = f".{own}-{uuid.uuid4().hex}"

        def close() -> None:
            out.close()
            os.replace(out.name, f"{os.path.dirname(out.name)}/{own}-{count:06d}.{ending}")

        for batch in batches:
            for at in range(0, batch.num_rows, _PIECE):
                for key, line in zip(*(c.to_pylist() for c in batch.slice(at, _PIECE).columns), strict=True):
                    if out is None or key != last:
                        if out is not None:
                            close()
                        folder = f"{hidden}/{folder_name(file, key)}"
                        os.makedirs(folder, exist_ok=True)
                        count, last, out = count + 1, key, open(f"{folder}/{name}", "wb")  # noqa: SIM115
                    out.write((line or "").encode() + b"\n")
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([count], pa.int64())})

    system.mkdirs(staged)
    try:
        rows.select(F.nullif(F.col(file).cast("string"), F.lit("")), value).mapInArrow(run, "files long").agg(F.sum("files")).first()
        system.create(located(spark, f"file://{hidden}/_SUCCESS")[1]).close()
        system.delete(target, True)
        if not system.rename(staged, target):
            raise OSError(f"{hidden} can't take the place of {path}")
    except BaseException:
        system.delete(staged, True)
        raise


def predictions(df: DataFrame, path: str, prompt: str = "prompt", predict: str = "predict", label: str = "label", pad: str = "<pad>") -> None:
    """Prompt, prediction and label as JSON lines; padding before a prediction goes."""
    start = F.regexp_replace(F.col(predict), "^(?:" + re.escape(pad) + ")+", "")
    df.select(F.col(prompt).alias("prompt"), start.alias("predict"), F.col(label).alias("label")).write.mode("overwrite").json(path)
