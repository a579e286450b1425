import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.multi_index import MultiIndex, search

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asked, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, v in good:
        if asked(q):
            near = sorted((-float((w * v).sum()), i) for i, w in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    rng = np.random.RandomState(1)
    x = (rng.randn(12, 16)[rng.randint(0, 12, 3000)] + 0.6 * rng.randn(3000, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = found(search(df, df.where("vec_id % 20 = 0"), centroids=16)), brute(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want)
    hit = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hit) >= 0.9
    score = {q: {i: float((x[i].astype(float) * x[q].astype(float)).sum()) for i, _ in got[q]} for q in got}
    assert all(s == pytest.approx(score[q][i], abs=1e-12) for q in got for i, s in got[q])


def test_few_rows_ties_and_unsound_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [0.5, 2.0]), (9, [float("inf"), 0.0]), (40, [-1.0, 0.5])]
    rows += [(100 + i, [1.0, 0.0]) for i in range(1, 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k in (3, 20):
        assert found(search(df, df.where("vec_id % 20 = 0"), k=k, recall=1.0)) == brute(rows, lambda i: i % 20 == 0, k)
    few = df.where("vec_id < 50")
    assert found(search(few, few.where("vec_id % 20 = 0"))) == brute(rows[:10], lambda i: i % 20 == 0, 20)
    twice = few.unionByName(few).unionByName(few.where("vec_id = 3")).withColumn("id", F.lit("x")).withColumn("v", F.lit(None).cast("int"))
    for k in (1, 2, 20):  # repeated rows count once; other columns of any name aren't read
        assert found(search(twice, twice.where("vec_id % 20 = 0"), k=k, recall=1.0)) == brute(rows[:10], lambda i: i % 20 == 0, k)
    none = df.where("vec_id < 0")
    assert search(none, none).count() == 0


def test_heap_visits_cells_by_summed_distance():
    rng = np.random.RandomState(2)
    index = MultiIndex(rng.randn(8, 3), rng.randn(8, 3))
    q = rng.randn(6)
    order = index.probe(q, np.ones(64, np.int64), 64)
    assert np.all(np.diff(index.products(q)[order]) <= 1e-12) and sorted(order) == list(range(64))


def test_registered_query_reaches_its_recall(spark):
    """The query's own parameters over the whole table of embeddings, against brute force."""
    import numpy as np

    from millrace.llm.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in QUERIES["op1_multi_index"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [i for i in ids.tolist() if i % 20 == 0]
    assert sorted(got) == sorted(asked)
    hits = 0
    for q in asked:
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        found = {v: s for _, v, s in got[q]}
        assert len(found) == 20 and all(abs(s - score[ids == v][0]) < 1e-9 for v, s in found.items())
        hits += len(found.keys() & set(ids[order].tolist()))
    assert hits / (20 * len(asked)) >= 0.9


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    from millrace.llm import multi_index

    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0, float(i % 5)]) for i in range(300)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, multi_index.search(rows, rows, 5, centroids=4).collect()))
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 40)
    assert sorted(map(tuple, multi_index.search(rows, rows, 5, centroids=4).collect())) == whole
