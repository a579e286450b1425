import random
import re

import numpy as np
from pyspark.sql import functions as F

from millrace.llm.blocks import FOLDED, hash_spans
from millrace.llm.toxicity import BITS, PASSAGE_WORDS, ToxicityModel, misspelt, passages, repeated, score_toxicity, subwords, train, trained

BAD = ("scoundrel", "blockhead", "vermin", "halfwit", "miscreant")
SYLLABLES = ("the", "ing", "er", "on", "at", "re", "nd", "ha", "es", "ti")


def text(rnd, n, bad=False, edit=False):
    words = ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3))) for _ in range(n)]
    if bad:
        for _ in range(2):
            w = rnd.choice(BAD)
            words[rnd.randrange(n)] = misspelt(w.encode(), np.random.RandomState(rnd.randrange(1 << 30))).decode() if edit else w
    return " ".join(words)


def made(seed, n, edit=False):
    rnd = random.Random(seed)
    return [(i, text(rnd, rnd.randint(12, 200), i % 5 == 0, edit), int(i % 5 == 0)) for i in range(n)]


def test_subwords_equal_brute_force():
    texts = ["The cat; a ÉTÉ x", "", "b", "ab cd", "  ", "end"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    starts, ends, word, bucket = subwords(data, off)
    words = [w for t in raw for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", t)]
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == words
    want = []
    for i, w in enumerate(words):
        wide = b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in w) + b" "
        whole = np.frombuffer(w, np.uint8)
        want.append((i, int(hash_spans(whole, np.array([0]), np.array([len(w)]), FOLDED)[0]) >> (64 - BITS)))
        for n in (3, 4, 5):
            for k in range(len(wide) - n + 1):
                code = int.from_bytes(wide[k : k + n], "big") + (n << 56)
                want.append((i, (code * 0x9E3779B97F4A7C15 % 2**64) >> (64 - BITS)))
    assert sorted(zip(word.tolist(), bucket.tolist(), strict=True)) == sorted(want)


def test_passages_cover_every_word_once():
    sizes = np.array([0, 1, 8, 9, 17, 0, 1000])
    first = passages(sizes)
    assert first[0] == 0 and (np.diff(np.append(first, sizes.sum())) <= PASSAGE_WORDS).all() and (np.diff(first) > 0).all()
    assert set(np.cumsum(sizes)[:-1][sizes[1:] > 0]) <= set(first.tolist()) | {int(sizes.sum())}
    assert repeated(np.array([5, 5, 7, 5, 7, 5]), np.array([0, 3])).tolist() == [1, 5]


def test_held_out_texts_and_misspellings_never_seen(spark):
    rows = made(1, 2500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = train(docs, labels)
    for edit, least in ((False, 0.99), (True, 0.85)):
        new = made(7, 400, edit)
        got = {r.doc_id: r.toxicity for r in score_toxicity(spark.createDataFrame([r[:2] for r in new], "doc_id long, text string"), model).collect()}
        caught = np.mean([got[i] >= 0.3 for i, _, y in new if y])
        assert caught >= least and np.mean([got[i] >= 0.3 for i, _, y in new if not y]) <= 0.01


def test_score_from_passages_written_anew():
    """One sum a passage over its distinct words, the four greatest and the length weighed by hand."""
    rnd = random.Random(3)
    weight = np.random.RandomState(1).randn(1 << BITS).astype(np.float32)
    scale = np.array([0.7, 0.4, 0.2, 0.1, -0.3, -1.0])
    model = ToxicityModel(weight, 0.5, scale, 0.1)
    texts = [text(rnd, n) + (" on on on on" if n > 8 else "") for n in (1, 7, 8, 9, 61, 20)]
    want = []
    for t in texts:
        words = t.split()
        count = -(-len(words) // PASSAGE_WORDS)
        odds = []
        for k in range(count):
            own = dict.fromkeys(words[k * len(words) // count : (k + 1) * len(words) // count])
            buckets = [b for w in own for b in subwords(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[3].tolist()]
            odds.append(weight[buckets].astype(float).sum() / max(len(buckets), 64) + 0.5)
        odds = sorted(odds, reverse=True)
        top = [odds[min(k, count - 1)] for k in range(4)]
        want.append(1 / (1 + np.exp(-(np.dot([*top, np.log(count)], scale[:-1]) + scale[-1]))))
    raw = [t.encode() for t in texts]
    got = model.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.allclose(got, want, atol=1e-9)


def test_edges(spark):
    rows = made(2, 300)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5, "x " * 30_000)] + [(None, "scoundrel")] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (0, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = train(docs, labels)
    assert abs(model.share - 61 / 301) < 1e-12
    long = text(random.Random(4), 300_000) + " " + BAD[0] + " " + text(random.Random(5), 50)
    asked = [(1, None), (2, ""), (3, " ... "), (4, long), (4, long), (None, BAD[1]), (6, BAD[1] * 50_000), (7, "é" * 10)]
    df = spark.createDataFrame(asked, "doc_id long, text string").withColumn("toxicity", F.lit("x")).withColumn("score", F.lit(None).cast("int"))
    got = score_toxicity(df, model).collect()
    by = {r.doc_id: r.toxicity for r in got}
    assert len(got) == len(asked) and by[1] == by[2] == by[3] == model.share and by[4] >= 0.3 and by[None] >= 0.3 and 0 <= by[6] <= 1 and by[7] < 0.3
    assert score_toxicity(df.where("doc_id > 100"), model).count() == 0
    one_class = train(docs, labels.where("toxic = 1"))
    assert {r.toxicity for r in score_toxicity(df, one_class).collect()} == {1.0}
    assert {r.toxicity for r in score_toxicity(df, train(docs, labels.where("toxic > 5"))).collect()} == {0.0}
    assert trained(["a b", ""], np.array([0, 1]), 0.5).score(np.zeros(0, np.uint8), np.array([0, 0])).tolist() == [0.5]


def test_registered_query_on_held_out_documents(spark):
    from millrace.llm.registry import QUERIES

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    found = QUERIES["op11_toxicity"](spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = found.join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert np.mean([r.predicted for r in rows if r.toxic]) >= 0.9 and np.mean([r.predicted for r in rows if not r.toxic]) <= 0.01
