import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm.blocks import string_buffers
from millrace.llm.decontaminate import drop_contaminated, find_contamination, smith_waterman, word_hashes


def brute(a, b):
    best = 0
    last = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b, 1):
            now.append(max(0, last[j - 1] + (2 if x == y else -1), last[j] - 1, now[-1] - 1))
        best = max(best, *now)
        last = now
    return best


def test_alignment_matches_brute_force():
    rnd = np.random.RandomState(1)
    items = [rnd.randint(1, 6, rnd.randint(1, 14)).astype(np.uint64) for _ in range(200)]
    texts = [rnd.randint(1, 6, rnd.randint(1, 20)).astype(np.uint64) for _ in range(200)]
    got, _ = smith_waterman(items, texts)
    assert got.tolist() == [brute(a.tolist(), b.tolist()) for a, b in zip(items, texts, strict=True)]


def made():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(("th", "on", "er", "in", "re", "ou", "é")) for _ in range(rnd.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(15, 50)))) for i in range(20)] + [(20, None), (21, ""), (22, "two words")]
    rows, hit = [], set()
    for i in range(160):
        parts = [word() for _ in range(rnd.randint(30, 200))]
        if i % 5 == 0:
            k = rnd.randrange(20)
            w = items[k][1].split()
            for _ in range(int(len(w) * rnd.choice((0, 0, 0.1, 0.15)))):
                w[rnd.randrange(len(w))] = word()
            if rnd.random() < 0.3:
                del w[rnd.randrange(len(w))]
            at = rnd.randrange(len(parts))
            parts[at:at] = [x.upper() if i % 2 else x + "," for x in w]
            hit.add((i, k))
        rows.append((i, " ".join(parts)))
    return rows, items, hit


def test_copies_are_found_and_clean_documents_stay(spark):
    rows, items, hit = made()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_contamination(docs, bench).where("item_id < 20").collect()}
    assert got == hit
    kept = {r.doc_id for r in drop_contaminated(docs, bench.where("item_id < 20")).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in hit}


def test_edges(spark):
    bench = spark.createDataFrame([(1, "Two words"), (2, "one short test item here"), (None, "one short test item here")], "item_id long, text string")
    rows = [(1, "say TWO, words now", 1), (2, None, 1), (3, "", 1), (4, "x " * 100_000 + "one short test item here", 1), (4, "nothing", 2), (None, "one short test item here", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = sorted(((r.doc_id, r.item_id) for r in find_contamination(docs, bench).collect()), key=str)
    assert got == sorted([(1, 1), (4, 2), (4, None), (None, 2), (None, None)], key=str)
    assert sorted(r.text or "" for r in drop_contaminated(docs, bench).collect()) == ["", "", "nothing"]
    none = docs.where("doc_id < 0")
    assert find_contamination(none, bench).count() == 0 and find_contamination(docs, bench.where("item_id < 0")).count() == 0 and drop_contaminated(docs, bench.where("item_id < 0")).count() == 6


def test_long_insertions_score_as_a_whole(spark):
    rnd = random.Random(9)
    items, rows, want = [], [], {}
    for k, (n, every, more) in enumerate(((40, 10, 20), (40, 20, 25), (60, 0, 55), (60, 0, 61), (30, 15, 20), (40, 20, 12), (40, 0, 44), (40, 4, 20))):
        item = [f"item{k}w{i}" for i in range(n)]
        copy = [f"other{k}w{i}" if every and i % every == every - 1 else w for i, w in enumerate(item)]
        cuts = [n // 2] if k % 2 == 0 else [n // 3, 2 * n // 3]
        for j, c in reversed(list(enumerate(cuts))):
            copy[c:c] = [f"in{k}w{j}w{i}" for i in range(more // len(cuts))]
        before, after = ([f"{x}{k}w{i}" for i in range(rnd.randint(0, 90))] for x in ("before", "after"))
        items.append((k, " ".join(item)))
        rows.append((k, " ".join(before + copy + after)))
        score = brute(item, copy) / (2 * n)
        if score >= 0.5:
            want[k, k] = round(score, 6)
    assert {(0, 0), (1, 1), (2, 2)} <= set(want) and len(want) < len(rows)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): round(r.score, 6) for r in find_contamination(docs, bench).collect()} == want
    assert {r.doc_id for r in drop_contaminated(docs, bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def hashed(texts):
    off, data = string_buffers(pa.array(texts, pa.large_string()))
    words, doc = word_hashes(data, off)
    return [words[doc == i] for i in range(len(texts))]


def test_every_item_aligned_with_every_whole_document(spark):
    """The query without seeds or regions: all pairs by the alignment that brute force has checked above."""
    rows, items, _ = made()
    items = [(i, t) for i, t in items if i < 20]
    a, b = hashed([t for _, t in items]), hashed([t for _, t in rows])
    pairs = [(i, j) for i in range(len(a)) for j in range(len(b))]
    score, _ = smith_waterman([a[i] for i, _ in pairs], [b[j] for _, j in pairs])
    want = {(rows[j][0], items[i][0]): s / (2 * len(a[i])) for (i, j), s in zip(pairs, score.tolist(), strict=True) if s / (2 * len(a[i])) >= 0.5}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in find_contamination(docs, bench).collect()}
    assert got == pytest.approx(want)


def test_slices_and_kinds_of_ids_change_nothing(spark):
    rows, items, _ = made()
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    want = None
    for kind, cast in (("int", int), ("long", int), ("string", str), ("short", int)):
        bench = spark.createDataFrame([(cast(i), t) for i, t in items[:12]], f"item_id {kind}, text string")
        for size in (1, 500, 8 << 20) if kind == "long" else (8 << 20,):
            found = find_contamination(docs, bench, slice_bytes=size)
            assert found.dtypes[:2] == [("doc_id", "int"), ("item_id", dict(bench.dtypes)["item_id"])]
            got = sorted((r.doc_id, int(r.item_id), r.score) for r in found.collect()), sorted(r.doc_id for r in drop_contaminated(docs, bench, slice_bytes=size).collect())
            want = want or got
            assert got == want and set(got[1]) == {i for i, _ in rows} - {d for d, _, _ in got[0]}
    none = spark.createDataFrame([(1, "no such words at all")], "item_id int, text string")
    assert find_contamination(docs, none).count() == 0


def test_copies_of_half_an_item_in_a_single_document(spark):
    """Most of an item's n-grams occur nowhere, or the copied ones are the more frequent; whatever reaches the score is found."""
    items, rows = [], []
    for k in range(6):
        item = [f"item{k}w{i}" for i in range(36)]
        items.append((k, " ".join(item)))
        copies = (item[:18] + item[19::2], item[:18], item[9:28], item[18:], item[:19], [w if i % 6 < 4 else f"x{k}w{i}" for i, w in enumerate(item)])
        rows.append((k, f"before {k} " + " ".join(copies[k]) + f" after {k}"))
    # the other half of each item is rarer than the copied one
    others = [(100 + 10 * k + j, " ".join(f"item{k}w{i}" for i in range(6 * j, 6 * j + 6))) for k in range(6) for j in range(6)]
    for docs in (rows, rows + others):
        want = {(i, k) for i, t in docs for k, item in items if brute(item.split(), t.split()) >= len(item.split())}
        assert {(k, k) for k in range(6)} <= want
        got = {(r.doc_id, r.item_id) for r in find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
        assert got == want


@pytest.mark.parametrize("least", [0.5, 0.8, 0.9, 1.0])
def test_fewer_seeds_at_higher_scores_lose_nothing(spark, least):
    """Items with random edits, against the alignment of all pairs; only pairs with three words in a row count."""
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefghijklmnop") * rnd.randint(1, 2)
    items = [[word() for _ in range(rnd.randint(5, 40))] for _ in range(8)]
    rows = []
    for i in range(120):
        w = list(rnd.choice(items))
        for _ in range(rnd.randint(0, max(1, int(len(w) * (1.1 - least))))):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = [word() for _ in range(rnd.randint(0, 1))] or []
            w = w or ["a"]
        rows.append((i, " ".join([word() for _ in range(10)] + w + [word() for _ in range(10)])))
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    want = {(i, k) for i, t in rows for k, item in enumerate(items) if brute(item, t.split()) / (2 * len(item)) >= least and grams(item) & grams(t.split())}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    assert want and {(r.doc_id, r.item_id) for r in find_contamination(docs, bench, least=least).collect()} == want


def test_very_long_text_that_repeats_a_seed(spark):
    """One region over the whole text is cut into pieces; a copy across a border of pieces is found."""
    item = [f"w{i}" for i in range(30)]
    text = ["w0", "w1", "w2"] * 30_000
    for at in (65_530, 80_000):
        text[at:at] = item[:25]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(["w0", "w1", "w2"] * 60_000))], "doc_id long, text string")
    got = find_contamination(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)] and got[0].score == 25 / 30
