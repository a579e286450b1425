import json
import re
from pathlib import Path

import pytest

from millrace.sources import files, sinks
from millrace.streaming import training_log as log


def test_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("汉字".encode("gbk"))
    (tmp_path / "b.txt").write_bytes("﻿é".encode())
    got = {r.path[-5:]: r.text for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "汉字", "b.txt": "é"}


def test_registry_and_urls(tmp_path):
    path = tmp_path / "info.json"
    path.write_text(json.dumps({"a": {"file_name": "a.json", "ranking": True}, "b": {"hf_hub_url": "x/y", "file_name": "b.json", "formatting": "sharegpt"}}))
    got = files.read_registry(str(path))
    assert (got["a"].source, got["a"].ranking, got["b"].source, got["b"].location, got["b"].formatting) == ("file", True, "hub", "x/y", "sharegpt")
    assert files.jdbc_url("mysql", "h", None, "d") == "jdbc:mysql://h:3306/d" and files.jdbc_url("sqlite", database="/x.db") == "jdbc:sqlite:/x.db"


def test_import_and_counts(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text('{"question": "q", "answer": "a", "rejected": "r"}\n\n{"instruction": "i", "question": "z", "output": "o"}\n')
    rows = files.import_pairs(spark.read.json(str(path))).collect()
    assert sorted((r.question, r.answer, r.is_dpo) for r in rows) == [("i", "o", False), ("q", "a", True)]
    assert files.sample_count(spark, str(path)) == 2 and files.sniff_format(spark.read.json(str(path))) == "alpaca"


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], "id int, split string")
    assert {r.split: r.n for r in sinks.export_splits(df, str(tmp_path / "out")).collect()} == {"train": 2, "test": 1}
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    page = sinks.page_document(spark.createDataFrame([("a/b: c", "http://x", "text"), ("t", "u", " ")], "t string, u string, c string"), "t", "u", "c").collect()
    assert [(r.filename, r.document) for r in page] == [("a_b_ c.md", "# a/b: c\n\n> 来源: http://x\n\ntext")]


def test_log_stream_goes_on_where_it_ended(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    seen = []

    def push(df, n):
        seen.extend(r.current_steps for r in df.collect())

    for k in (1, 2):
        (folder / f"{k}.json").write_text(json.dumps({"current_steps": k, "loss": 0.5}) + "\n")
        log.follow(log.read_log(spark, str(folder)), str(tmp_path / "checkpoint"), push).awaitTermination()
    assert seen == [1, 2]


def test_stream_holds_out_its_first_rows(spark, tmp_path):
    with pytest.raises(ValueError):
        log.split_stream(None, "id", 0.1, "", "")
    folder, out = tmp_path / "rows", str(tmp_path / "out")
    folder.mkdir()
    for k, n in enumerate((3, 4, 2)):
        (folder / f"{k}.json").write_text("".join(json.dumps({"id": 10 * k + i}) + "\n" for i in range(n)))
        log.split_stream(spark.readStream.schema("id long").json(str(folder)), "id", 5, out, str(tmp_path / "checkpoint")).awaitTermination()
    held, rest = ([(r.batch, r.id) for r in spark.read.parquet(f"{out}/{name}").collect()] for name in ("validation", "train"))
    assert sorted(i for b, i in held if b == 0) == [0, 1, 2] and [b for b, _ in held].count(1) == 2 and len(held) == 5
    assert sorted(i for _, i in held + rest) == [0, 1, 2, 10, 11, 12, 13, 20, 21]


def _tree(top):
    """Folder: lines of its files, and the number of files."""
    found = {}
    for p in top.rglob("part-*"):
        lines, n = found.get(str(p.parent.relative_to(top)), ([], 0))
        found[str(p.parent.relative_to(top))] = (sorted(lines + p.read_text().split("\n")[:-1]), n + 1)
    return found


def test_a_folder_each_as_spark_lays_them_out(spark, tmp_path, monkeypatch):
    """Odd names, nulls and several rows of one file: the same folders and lines as by Spark's partitioned writer, which other stores get."""
    rows = [("a", 1, "x\ny"), ("a/b: 50%", 2, "汉字 😀"), ("", 3, None), (None, 4, ""), ("a", 5, "second"), ("q'\"[]{}^=?*\\#", 6, "z"), ("a", 7, None)]
    pairs = spark.createDataFrame(rows, "file_id string, index long, content string").coalesce(1)
    sinks.run_folder(pairs, str(tmp_path / "own"))
    sinks.ready_documents(pairs, str(tmp_path / "own" / "ready"))
    other = type("Path", (), {"toUri": lambda self: self, "getScheme": lambda self: "s3a"})
    monkeypatch.setattr(sinks, "located", lambda *_: (None, other()))
    sinks.run_folder(pairs, str(tmp_path / "spark"))
    sinks.ready_documents(pairs, str(tmp_path / "spark" / "ready"))
    own, by_spark = ({n: _tree(tmp_path / w / n) for n in ("qa_pairs", "ready")} for w in ("own", "spark"))
    assert own == by_spark and own["qa_pairs"]["file_id=a"][1] == 1 and len(own["ready"]) == 4
    back = spark.read.json(str(tmp_path / "own" / "qa_pairs"))
    assert {(r["file_id"], r["index"], r["content"]) for r in back.collect()} == {(f or None, i, c) for f, i, c in rows}


def test_folders_appear_whole_or_not_at_all(spark, tmp_path):
    from pyspark.sql import functions as F

    path = tmp_path / "ready"
    chunks = spark.createDataFrame([("a", 0, "old")], "file_id string, index long, content string")
    sinks.ready_documents(chunks, str(path))
    bad = spark.range(20, numPartitions=2).select(F.col("id").cast("string").alias("file_id"), F.col("id").alias("index"), F.when(F.col("id") == 19, F.raise_error(F.lit("stop"))).otherwise("x").alias("content"))
    with pytest.raises(Exception, match="stop"):
        sinks.ready_documents(bad, str(path))
    assert _tree(path) == {"file_id=a": (["old"], 1)} and [p.name for p in tmp_path.iterdir()] == ["ready"]
    sinks.ready_documents(chunks.withColumn("content", F.lit("new")), str(path))
    assert _tree(path) == {"file_id=a": (["new"], 1)} and (path / "_SUCCESS").exists()


def test_many_folders_start_no_process_each(spark, tmp_path):
    """Processes and threads that the machine starts while 2,000 files are written; Spark's writer started 12,066."""
    begun = lambda: int(re.search(r"^processes (\d+)", Path("/proc/stat").read_text(), re.M)[1])
    chunks = spark.range(2000, numPartitions=2).selectExpr("id AS file_id", "id AS index", "'x' AS content")
    before = begun()
    sinks.ready_documents(chunks, str(tmp_path / "ready"))
    assert begun() - before < 2000 and len(_tree(tmp_path / "ready")) == 2000
