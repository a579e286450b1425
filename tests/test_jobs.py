import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import jobs
from millrace.sources import databases


def test_prompts_carry_their_chunk(spark):
    chunks = spark.createDataFrame([("f", 1, "Chunk 1", "a" * 500), ("f", 2, "Chunk 2", "b"), ("g", 3, "Chunk 1", "c")], "file_id string, chunk_id int, name string, content string")
    rows = jobs.prompts(chunks).collect()
    assert sorted((r.file_id, r.chunk_id or 0, r.mode) for r in rows) == [("f", 0, "full_doc"), ("f", 1, "context_enhanced"), ("f", 1, "local"), ("f", 2, "context_enhanced"), ("f", 2, "local"), ("g", 0, "full_doc"), ("g", 3, "context_enhanced"), ("g", 3, "local")]
    by = {(r.chunk_id, r.mode): r for r in rows}
    assert by[1, "local"].n_questions == 2 and "After it:\nb" in by[1, "context_enhanced"].prompt and "Before" not in by[1, "context_enhanced"].prompt
    with pytest.raises(ValueError, match="modes"):
        jobs.prompts(chunks, modes=("other",))

    def client(prompt):
        return json.dumps([{"question": prompt[-1], "answer": "x"}] * 3)

    got = jobs.generate(jobs.prompts(chunks, modes=("local",)), client).collect()
    assert sorted((r.chunk_id, r.position, r.question) for r in got) == [(1, 0, "a"), (1, 1, "a"), (2, 0, "b"), (3, 0, "c")]


def test_failing_client_gives_no_pairs(spark):
    def client(prompt):
        raise TimeoutError

    rows = spark.createDataFrame([("f", 1, "local", 2, "p")], "file_id string, chunk_id int, mode string, n_questions int, prompt string")
    assert jobs.generate(rows, client).count() == 0


def test_gates_media_and_stages(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(jobs.suitable(F.lit("no json"))) and not one(jobs.suitable(F.lit('so: {"suitable": false}')))
    assert one(jobs.media_paths(F.array(F.lit("a.png"), F.lit("/b.png"), F.lit("s3://c")), "root/")) == ["root/a.png", "/b.png", "s3://c"]
    assert one(jobs.overall(F.lit(1), F.lit(None).cast("double"), F.lit(2.0))) == 1.5 and one(jobs.overall(F.lit(None))) is None
    assert jobs.rows_for("kto", False) == "feedback"
    for bad in (("sft", True), ("rm", False), ("x", False)):
        with pytest.raises(ValueError):
            jobs.rows_for(*bad)
    assert jobs.tokens_per_second(spark.createDataFrame([([1, 2],), ([3],)], "ids array<int>"), "ids", 2, 3).first()[0] == 2.0


def test_tables_and_registry(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    df.createOrReplaceTempView("people_for_test")
    assert {"name": "people_for_test", "rows": 2} == {k: v for k, v in next(t for t in databases.list_tables(spark) if t["name"] == "people_for_test").items() if k != "columns"}
    row = databases.import_table(spark, "people_for_test", str(tmp_path / "csv"), limit=1).first()
    assert row.row_count == 1 and [f.name for f in row.field_schema] == ["id", "name"]
    databases.append(df, str(tmp_path / "t"))
    databases.append(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    path = str(tmp_path / "info.json")
    databases.upsert_registry(path, "a", {"file_name": "a.json"})
    databases.upsert_registry(path, "b", {"file_name": "b.json"})
    databases.upsert_registry(path, "a", None)
    assert json.load(open(path, encoding="utf-8")) == {"b": {"file_name": "b.json"}}
