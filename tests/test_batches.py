import os

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.operators import chunking, datasets, encode
from millrace.operators.batches import PIECE_BYTES, PIECE_ROWS, pieces


def test_pieces_are_bounded_and_whole():
    long = pa.array(["x" * 3000 + str(i) for i in range(10_000)])
    got = list(pieces([long]))
    assert max(sum(map(len, texts)) for (texts,) in got) <= PIECE_BYTES and [t for (texts,) in got for t in texts] == long.to_pylist()
    both = list(pieces([(pa.array([1, None, 3] * 1000), pa.array(["a", None, ""] * 1000)), (pa.array([], pa.int64()), pa.array([], pa.string()))]))
    assert max(len(a) for a, _ in both) <= PIECE_ROWS and [x for a, _ in both for x in a] == [1, None, 3] * 1000
    assert [len(t) for (t,) in pieces([pa.array(["y" * (3 * PIECE_BYTES)] * 2)])] == [1, 1]


def _peak_mb(spark, df):
    """What the Python workers of a job have held at most, by asking them after it in the same tasks."""
    df.write.format("noop").mode("overwrite").save()

    def peak(batches):
        import resource

        yield from ()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()] * batch.num_rows, "mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10] * batch.num_rows})

    return max(r.mb for r in spark.range(0, 64, 1, 8).mapInArrow(peak, "pid long, mb long").collect())


def test_a_batch_of_texts_is_cut_a_piece_at_a_time(spark):
    """10,000 rows are one batch: its chunks take far more room as objects than as Arrow."""
    text = "One sentence here. Another one there! A third, with commas? " * 20 + "中文句子。" * 4
    texts = spark.range(0, 20_000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.col("id").cast("string")).alias("text"))
    rows = chunking.chunk_rows(texts.unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")), "sentence", size=20)
    want = chunking.split_recursive(text + "17", 20, 0, chunking.LADDERS["sentence"])
    assert [r.content for r in rows.where("doc_id = 17").orderBy("index").collect()] == want
    assert rows.where("doc_id < 0").count() == 0 and rows.count() == sum(len(chunking.split_recursive(text + "0" * k, 20, 0, chunking.LADDERS["sentence"])) * n for k, n in ((1, 10), (2, 90), (3, 900), (4, 9000), (5, 10_000)))
    assert _peak_mb(spark, rows) < 400


def test_feedback_of_more_rows_than_a_piece(spark):
    rows = spark.range(0, 2 * PIECE_ROWS + 7, 1, 1).select("id", F.concat(F.lit("a bb "), F.col("id").cast("string")).alias("text"), F.lit("").alias("none"), F.lit("yes no").alias("answer"), (F.col("id") % 2 == 0).alias("good"))
    rows = datasets.align_alpaca(rows, prompt="text", query="none", response="answer", kto="good").withColumn("kl_text", F.col("text"))
    got = {r.id: r for r in encode.encode_feedback(rows, lambda t: [len(w) for w in t.split()], 48, 2).collect()}
    assert len(got) == 2 * PIECE_ROWS + 7
    for i in (0, 9, 511, 512, 1030):
        n = len(str(i))
        assert got[i].input_ids == [1, 2, n, 3, 2, 2] and got[i].labels == [-100] * 3 + [3, 2, 2] and got[i].kl_labels == [-100] * 3 + [1, 2, n, 2] and got[i].kto_tag == (i % 2 == 0)
