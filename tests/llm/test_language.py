import random
import zlib

import numpy as np

from millrace.llm.language import LanguageModel, folded, identify

SYLLABLES = {"aa": ("the", "ing", "wh", "st"), "bb": ("é", "eau", "que", "ou"), "cc": ("ü", "sch", "ei", "ung")}


def text(lang, n, rnd):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def made():
    rnd = random.Random(1)
    return [(i, text(lang, rnd.randint(5, 60), rnd), lang) for i in range(300) for lang in [rnd.choice(list(SYLLABLES))]]


def test_held_out_accuracy(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = LanguageModel.train(docs.where(~folded()))
    out = {r.doc_id: r for r in identify(docs, model).withColumn("held", folded()).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(out[i].held == (i in set(held)) for i, _, _ in rows)
    assert np.mean([out[i].lang_pred == rows[i][2] for i in held]) > 0.95


def test_mixture_and_edges(spark):
    docs = spark.createDataFrame(made(), "doc_id long, text string, lang string")
    model = LanguageModel.train(docs)
    rnd = random.Random(2)
    mixed = text("aa", 300, rnd) + "\n" + text("bb", 100, rnd)
    rows = [(1, mixed), (2, None), (3, ""), (4, "123 ... €"), (5, "the thing"), (5, "the thing"), (6, "the " * 100_000), (7, "漢字"), (None, "eau que")]
    got = identify(spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, lang_pred string"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].lang_pred == "aa" and set(by[1].lang_mix) == {"aa", "bb"} and abs(by[1].lang_score - 0.75) < 0.1
    assert all(by[i].lang_pred == "und" and by[i].lang_score == 0 for i in (2, 3, 4))
    assert by[5].lang_pred == by[6].lang_pred == "aa" and set(by[6].lang_mix) == {"aa"} and by[7].lang_pred in model.names and by[None].lang_pred == "bb"
    assert identify(docs.where("doc_id < 0"), model).count() == 0


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify(docs, LanguageModel.train(docs)).collect()} == {"und"}


def test_proportions_maximise_the_likelihood(spark):
    model = LanguageModel.train(spark.createDataFrame(made(), "doc_id long, text string, lang string"))
    rnd = random.Random(4)
    raw = (text("aa", 120, rnd) + " " + text("cc", 60, rnd)).encode()
    logs, first = model.units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    share, value = model.mixture(logs, first, np.ones((1, 3)), 60)
    like = np.exp(logs - logs.max(axis=1, keepdims=True))
    for other in np.random.RandomState(1).dirichlet(np.ones(3), 300):
        assert np.log(like @ other).sum() <= np.log(like @ share[0] + 1e-30).sum() + 1e-3
