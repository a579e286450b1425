import hashlib
from math import floor, isfinite

import numpy as np
from pyspark.sql import functions as F

from millrace.llm.skew import join_counted
from millrace.llm.vector_codes import assign, compress, largest_component, screened

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds, scale=1024):
    """The rounds in Python's integers; rows of one length."""
    kept = [(i, [floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and None not in v and all(map(isfinite, v))]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1])
    cuts = [d * p // parts for p in range(parts + 1)]
    piece = lambda r, p: r[1][cuts[p] : cuts[p + 1]]
    books = [[piece(r, p) for r in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda r, p: min((far(piece(r, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for r in kept:
                groups.setdefault(best(r, p)[1], []).append(piece(r, p))
            new.append([[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(books[p])])
        books = new
    found = [[best(r, p) for p in range(parts)] for r in kept]
    error = [sum(d for d, _ in f) for f in found]
    label = {}
    for r, e in zip(kept, error, strict=True):
        label[r[2]] = label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(r[0]), [k for _, k in f], e, label[r[2]], digest) for r, f, e in zip(kept, found, error, strict=True))


def got(df):
    return sorted((str(r.id), r.codes, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_equals_brute_force_with_ties_and_repeats(spark):
    rng = np.random.RandomState(3)
    x = rng.randint(-3, 4, (90, 8)) / 1024.0  # small integers: many ties
    rows = [(i, v.tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(x)]
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (None, rows[3][1], None), (12, [5.0] * 8, None)]
    for entries, parts in ((16, 4), (200, 4), (7, 3)):
        assert got(compress(spark.createDataFrame(rows, SCHEMA), parts, entries, 3)) == brute(rows, parts, entries, 3)


def test_unsound_rows_clashing_columns_and_empty_tables(spark):
    good = [(i, [i / 7, -i / 3, 0.5, i % 5 / 9], i % 2) for i in range(20)]
    bad = [(90, None, 1), (91, [None, 1.0, 1.0, 1.0], 1), (92, [float("nan"), 0.0, 0.0, 0.0], 1), (93, [float("-inf"), 0.0, 0.0, 0.0], 0), (94, [1.0], 0), (95, [], 0), (96, [-3e38, 0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(good + bad, SCHEMA).select("*", *(F.lit("x").alias(c) for c in ("id", "v", "k0", "n", "codes", "error")))
    assert got(compress(df, 2, 8, 2)) == brute(good, 2, 8, 2)
    assert compress(df.where("vec_id < 0"), 2, 8, 2).count() == 0
    assert got(compress(spark.createDataFrame(bad[:1] + bad[5:6], SCHEMA), 4, 8, 2)) == brute([(95, [], 0)], 4, 8, 2)


def test_interval_holds_the_exact_nearest():
    """Components up to the bound, entries that differ by one: float32 alone takes a wrong one, the interval never loses the right one."""
    rng = np.random.RandomState(5)
    top = largest_component(64)
    wrong = 0
    for size in (3, 2000, 1 << 20, top):
        base = rng.randint(-size, size + 1, 16)
        entries = np.clip(base + rng.randint(-2, 3, (64, 16)), -top, top)
        x = np.clip(base + rng.randint(-2, 3, (300, 16)), -top, top)
        exact = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        index, least = assign(x, entries)
        assert (index == exact.argmin(axis=1)).all() and (least == exact.min(axis=1)).all()
        plain = (entries.astype(np.float32) ** 2).sum(axis=1) - 2 * x.astype(np.float32) @ entries.astype(np.float32).T
        wrong += (plain.argmin(axis=1) != exact.argmin(axis=1)).sum()
    assert wrong > 100
    row, _ = screened(rng.randint(-400, 400, (2000, 16)), rng.randint(-400, 400, (256, 16)))
    assert len(row) < 2100  # at the usual sizes nearly every row has one candidate


def test_frequent_keys_join_apart(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") < 3000, F.lit(1)).otherwise(F.col("id")).cast("long").alias("k"))
    keys = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = join_counted(rows, keys, ["k"], "n", 6000).groupBy("k").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    assert out.where("c <> n").count() == 0 and out.agg(F.sum("c")).first()[0] == 6000
