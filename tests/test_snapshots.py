import threading

import pytest
from pyspark.sql import functions as F

from millrace.sources.snapshots import Conflict, SnapshotTable


def states(df):
    return {r.id: r.status for r in df.collect()}


def test_versions_conflicts_and_readers(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    assert t.versions() == []
    with pytest.raises(FileNotFoundError):
        t.read()
    first = spark.range(6).select("id", F.lit("new").alias("status"))
    assert t.commit(first, None) == 0
    reader = t.read()  # holds on to its version
    one, two = SnapshotTable(spark, str(tmp_path / "t")), SnapshotTable(spark, str(tmp_path / "t"))
    assert one.commit(first.withColumn("status", F.lit("one")), 0) == 1
    with pytest.raises(Conflict):
        two.commit(first.withColumn("status", F.lit("two")), 0)
    with pytest.raises(Conflict):
        two.commit(first, None)
    assert set(states(t.read()).values()) == {"one"} and set(states(reader).values()) == {"new"} and set(states(t.read(0)).values()) == {"new"}
    assert t.commit(spark.range(10, 12).select("id", F.lit("more").alias("status")), 1, append=True) == 2
    assert t.read().count() == 8 and t.versions() == [0, 1, 2]
    folders = [f for v in t.versions() for f in t.manifest(v)["folders"]]
    assert {p.name for p in (tmp_path / "t" / "data").iterdir()} == {f.split("/")[1] for f in folders}  # what lost is gone


def test_a_name_that_a_dead_writer_took(spark, tmp_path):
    import os

    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.commit(spark.range(2), None)
    mark = tmp_path / "t" / "_versions" / "1.taken"
    mark.write_text("")
    with pytest.raises(Conflict):
        t.commit(spark.range(3), 0)
    os.utime(mark, (1, 1))
    with pytest.raises(Conflict):
        t.commit(spark.range(3), 0)
    assert t.commit(spark.range(3), 0) == 1 and t.read().count() == 3


def test_guarded_updates_deletes_and_puts(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.commit(spark.range(5).select("id", F.when(F.col("id") < 4, F.lit("open")).alias("status")), None)
    open_now = F.col("status") == "open"
    assert t.claim(F.col("id") == 1, open_now, {"status": F.lit("mine")}) == 1
    assert t.claim(F.col("id") == 1, open_now, {"status": F.lit("yours")}) is None and t.claim(F.col("id").isin(1, 2), open_now, {"status": F.lit("yours")}) is None
    assert t.claim(F.col("id") == 99, open_now, {"status": F.lit("x")}) is None and t.claim(F.col("id") == 4, open_now, {"status": F.lit("x")}) is None
    assert states(t.read()) == {0: "open", 1: "mine", 2: "open", 3: "open", 4: None}
    t.update(open_now, {"status": F.upper("status")})
    t.delete(F.col("status").isNull() | (F.col("id") == 0))
    t.put(spark.createDataFrame([("put", 2), ("put", 7)], "status string, id long"), "id")
    assert states(t.read()) == {1: "mine", 2: "put", 3: "OPEN", 7: "put"}
    t.delete(F.lit(True))
    assert t.read().count() == 0 and t.read().columns == ["id", "status"]


def test_writers_at_the_same_time(spark, tmp_path):
    """Each of eight updates is applied once, and of eight claims of one row one wins."""
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.commit(spark.createDataFrame([(1, "0", None)], "id long, n string, owner string"), None)
    won, errors = [], []

    def work(k):
        try:
            own = SnapshotTable(spark, str(tmp_path / "t"))
            own.update(F.col("id") == 1, {"n": F.concat("n", F.lit(f",{k}"))})
            if own.claim(F.col("id") == 1, F.col("owner").isNull(), {"owner": F.lit(str(k))}) is not None:
                won.append(k)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(1, 5)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    row = t.read().first()
    assert not errors and sorted(row.n.split(",")) == ["0", "1", "2", "3", "4"] and len(won) == 1 and row.owner == str(won[0])
    assert t.versions() == list(range(6))
