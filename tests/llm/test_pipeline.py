"""Each stage against a version written down anew over all rows: no index, no seeds, no dynamic programme."""

import math
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm.decontaminate import smith_waterman
from millrace.llm.language import LanguageModel, folded, identify
from millrace.llm.registry import ORACLES, QUERIES
from millrace.llm.secrets import WORDS, cardinality, vocabulary_words
from tests.llm.test_decontaminate import hashed
from tests.llm.test_jaccard import brute
from tests.llm.test_secrets import base, part_cost

SF = "/root/testdata/sf0.001"
CONTEXT = r"""(?i)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?|bearer)["']?\x20*(?:=>|[:=])\x20*(?:"([^"\r\n]+)"|'([^'\r\n]+)'|([^\s"',;]+))"""
EXTRA = [
    (9001, "1234 5678 90", "en", "x", 12), (9002, "", "en", "x", 0), (9003, None, "en", "x", None), (9004, "the password: elephant is in use; token=\"kQ#7 vL2x!\" and auth: disabled", "en", "x", 70),
    (9005, "secret = Zk8!qPw2#e password => aaaaaaaaaaaa", "en", "x", 45),
]


def priced(value, ranks, longest=30):
    best, each = [0.0], math.log10(cardinality(value))
    for j in range(1, len(value) + 1):
        best.append(min([best[j - 1] + each, *(best[i] + part_cost(value[i:j], ranks) + 0.3 for i in range(max(0, j - longest), j))]))
    return best[-1]


def masked(text, ranks):
    spans = [tuple(map(int, s.split(":")[1:])) for s in base(text).split(",") if s]
    for m in re.finditer(CONTEXT, text, re.ASCII):
        if len(m[m.lastindex]) >= 6 and priced(m[m.lastindex], ranks) >= 8.0:
            spans.append(m.span(m.lastindex))
    joined = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    for a, b in reversed(joined):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontaminate", "secrets", "encode"]
    docs = docs.unionByName(spark.createDataFrame(EXTRA, docs.schema)).cache()
    every = {r.doc_id: r for r in docs.collect()}

    found = {r.doc_id: r for r in identify(docs, LanguageModel.train(docs.where(~folded()))).collect()}
    docs = stages["language"](spark, docs, SF).cache()
    before = {r.doc_id: r for r in docs.collect()}
    letters = {i for i, r in every.items() if re.search(r"[^\W\d_]", r.text or "")}
    assert docs.columns == names and set(every) - letters == {9001, 9002, 9003}
    assert set(before) == {i for i in letters if found[i].lang_score >= corpus_pipeline.LEAST_LANGUAGE} and set(before) >= set(range(200))

    docs = stages["near_duplicates"](spark, docs, SF).cache()
    kept = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == names and set(kept) == {i for i, (_, c) in brute([(i, r.text) for i, r in before.items()]).items() if i == c}

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    a, order = hashed(items), sorted(kept)
    b = hashed([kept[i].text for i in order])
    dirty = set()
    for i, words in zip(order, b, strict=True):  # every item with every whole document
        if len(words):
            score, _ = smith_waterman(a, [words] * len(a))
            if any(s >= len(x) for s, x in zip(score.tolist(), a, strict=True)):
                dirty.add(i)
    docs = stages["decontaminate"](spark, docs, SF).cache()
    clean = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == names and set(clean) == set(kept) - dirty and dirty

    ranks = {}
    for w in (*WORDS, *vocabulary_words(public_tokenizers.path("byte_bpe_50k.json"))):
        if len(w) >= 3:
            ranks.setdefault(w, len(ranks) + 1)
    docs = stages["secrets"](spark, docs, SF).cache()
    last = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == names and set(last) == set(clean)
    for i, r in last.items():
        assert r.text == masked(clean[i].text, ranks) and r.n_chars == len(r.text)
    # a base span goes whatever it costs; values in wider context only where they are hard to guess
    assert last[9004].text == 'the [SECRET] is in use; token="[SECRET]" and auth: disabled' and last[9005].text == "[SECRET]!qPw2#e password => aaaaaaaaaaaa".replace("[SECRET]!qPw2#e", last[9005].text.split(" password")[0])
    assert "Zk8" not in last[9005].text

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = stages["encode"](spark, docs, SF).collect()
    assert len(out) == len(last) and all(r.n_tokens == len(library.encode(last[r.doc_id].text, add_special_tokens=False).ids) for r in out)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables_null_ids_and_clashing_columns(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs.where("doc_id < 0"), SF).count() == 0
    odd = docs.limit(20).unionByName(spark.createDataFrame([(None, "a text without an id, in plain words", "en", "x", 5), (None, None, None, None, None)], docs.schema))
    odd = odd.selectExpr("*", "7 as _lang", "8 as _score", "9 as _mix", "10 as _secrets")
    out = stage(spark, odd, SF)
    if name != "encode":
        assert out.columns == odd.columns
        assert all((r._lang, r._score, r._mix, r._secrets) == (7, 8, 9, 10) for r in out.collect())
    assert out.where("doc_id is null").count() >= 1


def test_registry():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(ORACLES) <= set(QUERIES)


def test_secrets_of_a_table_without_lengths(spark):
    stage = dict(corpus_pipeline.STAGES)["secrets"]
    docs = spark.createDataFrame([(1, 'password = "hunter2hunter2"'), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in stage(spark, docs, SF).collect()}
    assert "[SECRET]" in out[1] and out[2] is None
