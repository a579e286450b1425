import functools
import itertools
import math
import random

from pyspark.sql import functions as F

from millrace.operators.metrics import smoothed_bleu, training_scores
from millrace.operators.segment import Segmenter, count_words
from millrace.plans import registry


def probability(words, counts):
    total = math.log(sum(counts.values()))
    return sum(math.log(counts.get(w, 1 if len(w) == 1 else 0) or 1e-300) - total for w in words)


def test_paths_against_all_cuts():
    rnd = random.Random(1)
    alphabet = "研究生命起源"
    counts = {"".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 4))): rnd.randint(1, 50) for _ in range(60)}
    cut = Segmenter(counts)
    for n in range(1, 11):
        for _ in range(12):
            text = "".join(rnd.choice(alphabet) for _ in range(n))
            every = [[text[a:b] for a, b in itertools.pairwise((0, *c, n))] for k in range(n) for c in itertools.combinations(range(1, n), k)]
            best = max(probability(w, counts) for w in every)
            got = cut(text)
            assert "".join(got) == text and abs(probability(got, counts) - best) < 1e-9


def test_known_sentences_and_mixed_scripts():
    counts = {"研究": 50, "研究生": 20, "生命": 40, "命": 5, "起源": 30, "的": 100, "人工": 20, "智能": 20, "人工智能": 60}
    cut = Segmenter(counts)
    assert cut("研究生命的起源") == ["研究", "生命", "的", "起源"] and cut("人工智能") == ["人工智能"]
    assert cut("GPT4 研究，v2.0") == ["GPT4", " ", "研究", "，", "v2", ".", "0"] and cut("") == [] and cut("鑫鑫") == ["鑫", "鑫"]
    assert Segmenter({})("命运") == ["命", "运"]
    assert Segmenter({"the": 9, "then": 2, "night": 5, "nig": 1}, everywhere=True)("thenight") == ["the", "night"]


def test_counts_come_from_spark(spark):
    df = spark.createDataFrame([(["研究", "生命"],), (["研究", None, " "],), (None,)], "w array<string>")
    assert count_words(df, "w") == {"研究": 2, "生命": 1} and count_words(df, "w", most=1) == {"研究": 2}


def plain_rouge(a, b, n):
    x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a, b))
    return round(200 * len(x & y) / (len(x) + len(y)), 4) if x & y else 0.0


def plain_lcs(a, b):
    @functools.cache
    def go(i, j):
        return 0 if i == len(a) or j == len(b) else 1 + go(i + 1, j + 1) if a[i] == b[j] else max(go(i + 1, j), go(i, j + 1))

    return go(0, 0)


def test_scores_of_pairs_without_blanks(spark):
    counts = {"研究": 50, "生命": 40, "起源": 30, "的": 100, "很": 20, "重要": 25}
    cut = Segmenter(counts)
    pairs = [("研究生命的起源", "研究的起源很重要"), ("生命", "生命"), ("", "生命"), ("abc def", "abc xyz def"), ("很重要", None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, r string")
    got = {x.i: x for x in training_scores(df, "p", "r", cut).collect()}
    for i, (p, r) in enumerate(pairs):
        a, b = (" ".join(cut(t or "")).split() for t in (p, r))
        assert (got[i].rouge_1, got[i].rouge_2) == (plain_rouge(a, b, 1), plain_rouge(a, b, 2))
        common = plain_lcs(tuple(a), tuple(b))
        assert got[i].rouge_l == (round(200 * common / (len(a) + len(b)), 4) if common else 0.0)
        assert got[i].bleu_4 == round(100 * smoothed_bleu(list(p), list(r or "")), 4)
    assert got[1].rouge_1 == 100.0


def test_registered_query_against_a_walk_from_the_left(spark):
    """Every message of the table: the query's words and scores, by another form of the path search."""
    sf = "/root/testdata/sf0.001"
    rows = registry.QUERIES["segmented_scores"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.split(F.lower("text"), r"\s+").alias("w"))
    counts = count_words(docs, "w")
    total, longest = math.log(sum(counts.values())), max(map(len, counts))

    @functools.cache
    def best(text):
        options = [(math.log(counts.get(text[:j], 1)) - total, j) for j in range(1, min(len(text), longest) + 1) if j == 1 or text[:j] in counts]
        return max(((v + best(text[j:])[0], j) for v, j in options)) if text else (0.0, 0)

    import re

    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    assert len(rows) == len([t for t in texts.values() if t is not None])
    for r in rows:
        joined = re.sub(r"\s+", "", texts[r.conv_id, r.turn].lower())
        words = []
        for block in re.findall(r"[^\W_]+|\S", joined):
            while block:
                j = best(block)[1] if block[0].isalnum() else len(block)
                words.append(block[:j])
                block = block[j:]
        want = probability([w for w in words if w[0].isalnum()], counts)
        assert abs(r.log_probability - round(want, 6)) < 1e-5 and r.n_words == len(words)


def test_words_given_as_columns_are_scored_alike(spark):
    """The query cuts each message once and hands its words over."""
    from pyspark.sql import functions as F

    from millrace.operators.metrics import training_scores

    cut = Segmenter({"the": 5, "cat": 3, "sat": 2, "thecat": 1, "on": 4}, everywhere=True)
    rows = [(1, "thecatsat", "thecat"), (2, "onthe\xa0cat", None), (3, "", "sat"), (4, "xyz", "xyzonthe"), (5, "a" * 700, "a" * 650)] * 300
    df = spark.createDataFrame(rows, "i int, p string, r string").coalesce(1)
    words = F.udf(lambda t: None if t is None else cut(t), "array<string>")
    own = training_scores(df, "p", "r", cut).distinct()
    given = training_scores(df.withColumn("a", words("p")).withColumn("b", words("r")), "p", "r", words=("a", "b")).select(*own.columns).distinct()
    assert sorted(map(str, own.collect())) == sorted(map(str, given.collect())) and own.count() == 5
    assert cut("thecatsat") == ["the", "cat", "sat"] or cut("thecatsat") == ["thecat", "sat"]
    assert cut.path("zz") == ["z", "z"] and Segmenter({}).path("ab") == ["a", "b"]
