import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.conversation_trie import century, end_digests, powers, prefix_trie, within

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, graft=True):
    """Every prefix as a tuple, every subtree walked."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if graft else 0
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children.get(node, [])]
        own_saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        sums[node] = (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))
        ends = ",".join(str(c) for c in sorted(members[node]) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children.get(node, [])), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def conversations(seed, n, words=("a", "b", "", "éß", "a b")):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rnd.choice([rnd.randint(0, 40), 100 + rnd.randint(0, 30), 200 + rnd.randint(1, 9)])
        rows += [(c, rnd.choice([None, 1, 2, 3]), rnd.choice(["user", "assistant", None]), rnd.choice([*words, None])) for _ in range(rnd.randint(1, 3))]
    return rows


def test_equals_brute_force(spark):
    rows = conversations(1, 90) + [(300 + i, 0, "user", "same") for i in range(50)] + [(None, 0, "user", "x")] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(prefix_trie(df, century, 5)) == brute(rows)
    assert got(prefix_trie(df)) == brute(rows, graft=False)


def test_collisions_of_keys_and_fingerprints_are_split(spark):
    rows = conversations(2, 60)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("print", F.lit(1)).withColumn("chars", F.lit("x")).withColumn("n", F.lit(None).cast("int"))
    assert got(prefix_trie(df, century, 5, key_bits=2, print_bits=3)) == brute(rows)


def test_one_conversation_of_most_rows(spark):
    """It lies in several parts of the sort; two others share its beginning."""
    text = lambda i: "x" * (i % 5)
    rows = [(c, i, "user", text(i)) for c, n in ((2, 3000), (5, 1500), (7, 1600)) for i in range(n)] + [(9, 0, None, None)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        found = got(prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    chars = np.cumsum([len(text(i)) for i in range(3000)])
    upto = lambda n: int(chars[n - 1]) if n else 0
    by = {(r[0], r[1]): r for r in found}
    assert len(found) == 3000 + 2
    for d in range(1, 3001):
        saved = max(0, upto(1500) - upto(d - 1)) + max(0, upto(1600) - upto(d - 1))
        assert by[2, d][3:7] == (1 + (d <= 1500) + (d <= 1600), int(d < 3000), 1, saved)
    assert by[2, 0][2:6] == (None, 4, 2, 2) and by[9, 1][2] == 2


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(101, 1, "user", "x")], [(7, None, None, None)], [(8, 1, "user", "long " * 300_000), (9, 1, "user", "long " * 300_000)]])
def test_edges(spark, rows):
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA), century, 5)) == brute(rows)


def test_running_sums_and_powers():
    starts, values = np.array([1, 0, 1, 0, 0], bool), np.array([1, 2, 3, 4, 5], np.uint64)
    assert within(starts, values, np.uint64(10)).tolist() == [11, 13, 3, 7, 12]
    assert [int(p) for p in powers(np.array([0, 1, 5, 1000]))] == [pow(0x9E3779B97F4A7C17, k, 2**64) for k in (0, 1, 5, 1000)]


def test_digests_of_many_ids(spark):
    """More ids at one end than a block holds, over several parts."""
    ids = spark.range(150_000).select(F.lit(1).cast("long").alias("depth"), F.lit(5).cast("long").alias("print"), F.col("id").alias("conv_id"))
    (row,) = end_digests(ids.unionByName(ids.where("conv_id < 0"))).collect()
    assert row.sha == hashlib.sha256(",".join(map(str, range(150_000))).encode()).hexdigest()
