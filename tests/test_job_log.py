import json

from millrace.streaming.job_log import depth_after, follow_jobs

SCHEMA = "job string, seq long, ts timestamp, line string, status string"


def test_depth():
    walk = [("x {", 0), ("}", 0), ("{", 1), ('  "a": {', 2), ("},", 1), ('  "b": [1]', 1), ("}, {", 1), ("  }", 0), ("end", 0)]
    depth = 0
    for line, want in walk:
        depth = depth_after(depth, line)
        assert depth == want


def test_blocks_repeats_ends_and_restarts(spark, tmp_path):
    """Three runs of one query: a block stays open between two, the second repeats lines, one job ends, one falls silent, one goes on."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    at = lambda m: f"2024-05-01 10:{m:02d}:00"
    runs = [
        [("a", 1, at(0), "loading", None), ("a", 2, at(0), "{", None), ("a", 3, at(0), '  "x": {', None), ("b", 1, at(0), "hello", None), ("c", 1, at(1), "  {  ", "running")],
        [("a", 3, at(0), '  "x": {', None), ("a", 5, at(2), "}", None), ("a", 4, at(2), "  },", None), ("a", 6, at(3), "ERROR: no", None), ("c", 2, at(3), "}", None), ("c", 3, at(3), None, None), ("c", 4, at(4), "bye", "completed"), ("c", 5, at(4), "late", None)],
        [("a", 7, at(20), "going on", None), ("c", 6, at(20), "later", "failed"), ("a", 6, at(20), "ERROR: no", None)],
    ]
    for k, rows in enumerate(runs):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(dict(zip(("job", "seq", "ts", "line", "status"), r, strict=True))) + "\n" for r in rows))
        follow_jobs(spark.readStream.schema(SCHEMA).json(source), out, state, idle="18 minutes").awaitTermination()
    got = sorted(((r.job, r.seq, r.line, r.ended, r.severity) for r in spark.read.parquet(out).collect()), key=str)
    want = [
        ("a", 1, "loading", None, "info"), ("a", 6, "ERROR: no", None, "error"), ("a", 7, "going on", None, "info"), ("b", 1, "hello", None, "info"), ("b", 1, None, "stalled", None),
        ("c", 3, "", None, "info"), ("c", 4, "bye", None, "info"), ("c", 4, None, "completed", None),
    ]
    assert got == sorted(want, key=str)
    # a silence inside one batch ends the job too
    (tmp_path / "in" / "9.json").write_text("".join(json.dumps({"job": "d", "seq": k, "ts": f"2024-05-01 {h}:00:00", "line": f"l{k}", "status": None}) + "\n" for k, h in ((1, 11), (2, 12), (3, 12))))
    follow_jobs(spark.readStream.schema(SCHEMA).json(source), out, state, idle="18 minutes").awaitTermination()
    more = {(r.job, r.seq, r.line, r.ended) for r in spark.read.parquet(out).collect()} - {g[:4] for g in got}
    assert more == {("d", 1, "l1", None), ("d", 1, None, "stalled"), ("a", 7, None, "stalled")}


def test_jobs_of_one_shard_share_a_timer(spark, tmp_path):
    """Three jobs in one state: the first falls silent and then the second, each at its own time, while the third goes on; big numbers and text keys stay as they are."""
    big, source, out, state = 2**53 + 1, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    (tmp_path / "in").mkdir()
    runs = [[("a", 1, 0), ("b", 1, 5), ("c", big, 6)], [("c", big + 1, 19)], [("c", big + 2, 30)], [("a", 2, 31), ("b", 2, 31), ("c", big + 3, 31)]]
    want = set()
    for k, rows in enumerate(runs):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"job": j, "seq": n, "ts": f"2024-05-01 10:{m:02d}:00", "line": f"l{n}", "status": None}) + "\n" for j, n, m in rows))
        follow_jobs(spark.readStream.schema(SCHEMA).json(source), out, state, idle="18 minutes", shards=1).awaitTermination()
        want |= {(j, n, f"l{n}", None) for j, n, m in rows if j == "c" or n == 1} | ({("a", 1, None, "stalled")} if k >= 1 else set()) | ({("b", 1, None, "stalled")} if k >= 2 else set())
        assert sorted(((r.job, r.seq, r.line, r.ended) for r in spark.read.parquet(out).collect()), key=str) == sorted(want, key=str)


def test_ids_far_apart_at_one_time(spark, tmp_path):
    """Events copied under shifted ids: the copies' lines come at the same times, so none is late."""
    import duckdb
    from pyspark.sql import functions as F

    from millrace.plans import registry

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(3):
        events.withColumns({c: F.col(c) + k * 1_000_000 for c in ("event_id", "user_id")}).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = registry.QUERIES["job_log"](spark, str(tmp_path))
    want = db.sql(registry.ORACLES["job_log"]).fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str) and len({w[0] // 1_000_000 for w in want}) == 3
