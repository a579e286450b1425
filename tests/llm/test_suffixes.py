import random

from millrace.llm.suffixes import repeated_bytes


def brute(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            g = t[s : s + length]
            if g in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(g)
        runs = [(a, b) for a, b in _runs(gone)]
        out[i] = (len(t), runs, bytes(c for c, d in zip(t, gone, strict=True) if not d))
    return out


def _runs(gone):
    a = None
    for i, g in enumerate([*gone, 0]):
        if g and a is None:
            a = i
        if not g and a is not None:
            yield a, i
            a = None


def made(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ñ") for _ in range(rnd.randint(1, 9)))
    shared = [" ".join(word() for _ in range(n)) for n in (14, 18, 25, 60, 200)]
    rows = [(0, None), (1, ""), (2, "a" * 99), (3, "a" * 100), (4, "a" * 101), (5, "ab" * 300), (6, "ba" * 90), (7, "é" * 75)]
    for i in range(8, 90):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 30)))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a, b = sorted((rnd.randrange(len(s)), rnd.randrange(len(s)))) if rnd.random() < 0.5 else (0, len(s))
            s = list(s[a:b])
            if s and rnd.random() < 0.4:
                s[rnd.randrange(len(s))] = "#"
            parts += ["".join(s), word()]
        rows.append((i * 7 % 101 + 10, "".join(parts)))
    return rows


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, [(x.start, x.end) for x in r.removed], bytes(r.kept)) for r in repeated_bytes(docs, **options).collect()}
    assert got == brute(rows)


def test_matches_brute_force(spark):
    check(spark, made(1))
    check(spark, made(2))


def test_edges(spark):
    assert repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "x y" * 80, 1), (1, "x y" * 80, 1), (None, "x y" * 80, 2)]
    assert [(r.doc_id, r.n_bytes) for r in repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect()] == [(1, 240)]


def test_repeated_rows_count_once(spark):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    own, shared = text(400), text(150)
    rows = [(1, own), (2, text(80) + shared), (3, text(90) + shared), (4, "short")]
    want = brute(rows)
    assert want[1] == (400, [], own.encode()) and [b - a for a, b in want[3][1]] == [150]
    for copies in (2, 3):
        docs = spark.createDataFrame(rows * copies, "doc_id long, text string")
        got = {r.doc_id: (r.n_bytes, [(x.start, x.end) for x in r.removed], bytes(r.kept)) for r in repeated_bytes(docs).collect()}
        assert got == want


def test_split_buckets_give_the_same(spark):
    """Buckets of many entries are dealt string by string; one line stands between different texts."""
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    line, near = "licensed to you under the terms that stand in the file beside this one.", [text(60) for _ in range(3)]
    rows = made(3) + [(1000 + i, text(rnd.randint(0, 90)) + rnd.choice([*near, text(30)]) + line + rnd.choice([*near, text(40), ""]) + text(rnd.randint(0, 90))) for i in range(150)]
    assert any(runs for _, runs, _ in brute(rows[-150:]).values())
    for hot_rows in (1, 20):
        check(spark, rows, hot_rows=hot_rows)
