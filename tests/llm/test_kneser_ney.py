import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm.blocks import hash_spans
from millrace.llm.kneser_ney import BEGIN, END, KneserNey, discounts, train_and_score
from tests.llm.test_jaccard import made


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows):
    train = [words(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    uni, bi = Counter(), Counter()
    for w in train:
        seq = ["<s>", *w, "</s>"]
        uni.update(seq[1:])
        bi.update(zip(seq, seq[1:], strict=False))
    n, v = sum(uni.values()), len(uni)
    d2 = discounts([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)])
    follow = Counter(w for _, w in bi)
    d1 = discounts([sum(c == k for c in follow.values()) for k in (1, 2, 3, 4)])
    types = len(bi)
    total, kinds = Counter(), {}
    for (h, _), c in bi.items():
        total[h] += c
        kinds.setdefault(h, [0, 0, 0])[min(c, 3) - 1] += 1
    rest = sum(d1[min(c, 3) - 1] for c in follow.values()) / types

    def p1(w):
        c = follow[w]
        return (c - (d1[min(c, 3) - 1] if c else 0)) / types + rest / (v + 1)

    def p(w, h):
        if not total[h]:
            return p1(w)
        c = bi[h, w]
        weight = sum(d * k for d, k in zip(d2, kinds[h], strict=True)) / total[h]
        return (c - (d2[min(c, 3) - 1] if c else 0)) / total[h] + weight * p1(w)

    out = {}
    for i, t in rows:
        seq = ["<s>", *words(t), "</s>"]
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(seq) - 1, sum(uni[w] > 0 for w in seq[1:]), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in seq[1:]), sum(math.log10(p(w, h)) for h, w in zip(seq, seq[1:], strict=False)))
    return out


def brute_of_order(rows, n):
    """The textbook's recursion over dictionaries: id, log10 probability."""
    grams = {k: Counter() for k in range(1, n + 1)}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            seq = ["<s>"] * (n - 1) + [*words(t), "</s>"]
            for at in range(n - 1, len(seq)):
                for k in range(1, n + 1):
                    grams[k][tuple(seq[at - k + 1 : at + 1])] += 1
    counts = {n: grams[n]}
    for k in range(n - 1, 0, -1):
        before = Counter(g[1:] for g in grams[k + 1])
        counts[k] = {g: grams[k][g] if g[0] == "<s>" else before[g] for g in grams[k]}
    known = {k: discounts([sum(c == x for c in counts[k].values()) for x in (1, 2, 3, 4)]) for k in counts}
    total, lost = Counter(), Counter()
    for k in counts:
        for g, c in counts[k].items():
            total[k, g[:-1]] += c
            lost[k, g[:-1]] += known[k][min(c, 3) - 1]

    def p(history, w):
        k = len(history) + 1
        below = p(history[1:], w) if history else 1 / (len(counts[1]) + 1)
        if not total[k, history]:
            return below
        c = counts[k].get((*history, w), 0)
        return (c - (known[k][min(c, 3) - 1] if c else 0) + lost[k, history] * below) / total[k, history]

    out = {}
    for i, t in rows:
        seq = ["<s>"] * (n - 1) + [*words(t), "</s>"]
        out[i] = sum(math.log10(p(tuple(seq[at - n + 1 : at]), seq[at])) for at in range(n - 1, len(seq)))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_orders_match_the_recursion(spark, order):
    rows = [*made(6, 80), (10_001, ""), (10_002, None), (10_003, "one"), (10_004, "one two"), (10_005, "one two three four five")]
    want = brute_of_order(rows, order)
    got = {r.doc_id: r.score for r in train_and_score(spark.createDataFrame(rows, "doc_id long, text string"), order=order).collect()}
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i]) for i in want)


def test_orders_below_two_are_refused(spark):
    with pytest.raises(ValueError, match="order"):
        KneserNey.train(spark.createDataFrame([], "doc_id long, text string"), order=1)


def test_scores_match_brute_force(spark):
    rows = made(3)
    want = brute(rows)
    got = {r.doc_id: r for r in train_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(want)
    for i, (held, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_probabilities_sum_to_one(spark):
    rows = made(4, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, third = KneserNey.train(docs), KneserNey.train(docs, order=3)
    vocabulary = sorted({w for _, t in rows for w in words(t)}) + ["never seen"]
    raw = "".join(vocabulary).encode()
    size = np.cumsum([0, *[len(w.encode()) for w in vocabulary]])
    every = np.append(hash_spans(np.frombuffer(raw, np.uint8), size[:-1], size[1:]), END)
    for h in (BEGIN, every[0], every[5], every[-2]):
        p, _ = model.opened().probabilities(np.full(len(every), h), every)
        assert p.sum() == pytest.approx(1)
        for before in (BEGIN, every[0], every[3]):
            p, _ = third.opened().probabilities(np.full(len(every), before), np.full(len(every), h), every)
            assert p.sum() == pytest.approx(1)


def test_edges(spark):
    assert train_and_score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = train_and_score(spark.createDataFrame([(None, "a"), (1, None), (1, None)], "doc_id long, text string")).collect()
    assert len(got) == 3 and all(math.isfinite(r.score) for r in got)


def test_a_lost_file_is_an_error(spark):
    import os
    from urllib.parse import urlparse

    docs = spark.createDataFrame(made(5, 40), "doc_id long, text string")
    model = KneserNey.train(docs)
    assert model.files
    assert model.score(docs).count() == 40
    lost = sorted(model.files)[0]
    os.remove(f"{urlparse(model.uri).path}/{lost}")
    with pytest.raises(Exception, match=lost):
        model.score(docs).collect()


def test_very_long_words_and_clashing_columns(spark):
    rows = [(1, "w" * 200_000 + " end", 1), (2, "a b " * 50_000, 2), (3, "a b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {r.doc_id: r for r in train_and_score(docs).collect()}
    want = brute([(i, t) for i, t, _ in rows])
    assert all(got[i].score == pytest.approx(w[5]) and got[i].n_tokens == w[1] for i, w in want.items())
