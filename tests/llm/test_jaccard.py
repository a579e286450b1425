import random
import re

import pytest

from millrace.llm.jaccard import jaccard_classes


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    seen = set()
    for members in by.values():
        for k, a in enumerate(members):
            for b in members[:k]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    inter = len(sets[a] & sets[b])
                    if 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                        a_, b_ = root(a), root(b)
                        parent[max(a_, b_)] = min(a_, b_)
    return {i: (len(sets[i]), root(i)) for i in sets}


def made(seed, n=260):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("xyzéß") + str(rnd.randint(0, 30))
    line = [word() for _ in range(9)]
    bases = [[word() for _ in range(rnd.choice((3, 4, 5, 6, 12, 40, 90)))] for _ in range(12)]
    rows = [(i, t) for i, t in enumerate([None, "", " \n\t ", "One two", "one  TWO", "one two three four five", "ONE two\nthree four five", "É a", "é a"])]
    for i in range(len(rows), n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 3, 5))):
            w[rnd.randrange(len(w))] = word()
        if rnd.random() < 0.4:
            w[rnd.randrange(len(w)) : 0] = line
        rows.append((i, rnd.choice((" ", "\n", "\t ")).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_match_brute_force(spark, seed):
    rows = made(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_near_copies_in_one_large_group(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 900)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(120)] = f"e{rnd.randint(0, 99)}"
        rows.append((1000 - i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_edges(spark):
    assert jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b", 7, "x"), (1, "a b", 7, "x"), (None, "a b", 7, "x"), (2, "A b", None, None)]
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string, tokens int, n string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 1, 1), (2, 1, 1)]


def test_very_long_text(spark):
    text = " ".join(str(i % 7919) for i in range(200_000))
    got = jaccard_classes(spark.createDataFrame([(1, text), (2, text + " x"), (3, "y" * 200_000)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}
