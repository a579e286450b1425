"""The trie of conversations that begin alike, by rolling prefix fingerprints.

A conversation is a sequence of turns; a node is a distinct sequence of first
turns. Turns are sorted over the cluster by conversation and place, so that one
long conversation lies in many tasks; numpy scans each part, and the few sums
that cross a part's border are carried by the driver, two rows a part. The
fingerprint of a prefix is the polynomial sum of its turns' keys modulo 2^64.
Rows of equal depth and fingerprint are candidates of one node. A turn's key
stands for its role and text: texts of one key are compared with each other and
told apart. A node is sound if every member has its representative's parent
fingerprint and last turn, which over all depths makes every member equal to it
turn by turn; members that differ get another fingerprint from there on, until
none differs. Sums over subtrees come from the members' own paths, without a
step for each level. Actions run while the plan is built.

Rows: a null role or text is empty; rows without a conversation id are left
out; turns are ordered nulls first, equal ones by role, then text, and repeated
rows are turns of their own. Extra columns are not read. An empty table has no
node. Texts of any length move once for sorting and, where distinct, once for
comparison. The ids that end at one node are hashed in order by one task, which
reads them as compressed blocks and holds one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.blocks import mix
from millrace.llm.shared import drop_written, partitions, written
from millrace.llm.skew import join_counted

_BASE = np.uint64(0x9E3779B97F4A7C17)
#: Ids in one block of those that end at a node.
BLOCK_IDS = 1 << 16

#: From conversation ids: the conversation whose first turns replace the own ones, and how many.
Graft = Callable[[Column], tuple[Column, Column]]


def powers(exponents: np.ndarray) -> np.ndarray:
    """The base to each power, modulo 2^64."""
    out, square = np.ones(len(exponents), np.uint64), _BASE
    left = exponents.astype(np.uint64)
    while left.any():
        np.multiply(out, square, out=out, where=(left & np.uint64(1)).astype(bool))
        left >>= np.uint64(1)
        square = np.multiply(square, square, dtype=np.uint64)
    return out


def within(starts: np.ndarray, values: np.ndarray, carried: np.generic) -> np.ndarray:
    """Running sums that begin anew at each start; the first run goes on from the carried sum."""
    total = np.cumsum(values, dtype=values.dtype)
    run = np.cumsum(starts) - 1
    before = np.where(np.flatnonzero(starts) > 0, total[np.flatnonzero(starts) - 1], values.dtype.type(0))
    before[:1] -= carried
    return total - before[run]


def scanned(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """conv_id, turn, chars with the place (from 1), fingerprint and characters of the prefix as far as the row's part shows, the part, and whether the conversation ends there."""
    fields = "part int, conv_id bigint, turn bigint, chars bigint, place bigint, print bigint, upto bigint, last boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, conv, place, fp, upto = None, None, np.int64(0), np.uint64(0), np.int64(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, turns, chars = (np.asarray(batch.column(i)) for i in range(3))
            starts = np.concatenate(([True], ids[1:] != ids[:-1]))
            if held is not None:
                held[-1][-1] = ids[0] != conv
                yield _batch(part, *held)
            if conv is None or ids[0] != conv:
                place, fp, upto = np.int64(0), np.uint64(0), np.int64(0)
            places = within(starts, np.ones(len(ids), np.int64), place)
            prints = within(starts, mix(turns.view(np.uint64)) * powers(places - 1), fp)
            uptos = within(starts, chars, upto)
            last = np.concatenate((starts[1:], [True]))
            held = [ids, turns, chars, places, prints.view(np.int64), uptos, last]
            conv, place, fp, upto = ids[-1], places[-1], prints[-1], uptos[-1]
        if held is not None:
            yield _batch(part, *held)

    count = partitions(rows.sparkSession)
    laid = rows.repartitionByRange(count, "conv_id", *order).sortWithinPartitions("conv_id", *order).select("conv_id", "turn", "chars")
    return written(laid.mapInArrow(run, fields), name)


def _batch(part: int, *columns: np.ndarray) -> pa.RecordBatch:
    names = ["part", "conv_id", "turn", "chars", "place", "print", "upto", "last"]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), part, np.int32)), *(pa.array(c) for c in columns)], names)


def joined(rows: DataFrame) -> DataFrame:
    """The scanned rows with places, fingerprints and characters over all parts, and the parent's fingerprint."""
    edges = rows.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    ends = rows.where("last").join(F.broadcast(edges), "part").where("conv_id = low or conv_id = high")  # two rows a part
    found: dict[int, dict[int, tuple]] = {}
    for r in ends.select("part", "conv_id", "place", "print", "upto").collect():
        found.setdefault(r.part, {})[r.conv_id] = (r.place, r.print % 2**64, r.upto)
    carry: dict[int, tuple] = {}
    conv, state, before = None, (0, 0, 0), None
    base = int(_BASE)
    for part in sorted(found):
        low, high = min(found[part]), max(found[part])
        start = state if low == conv else (0, 0, 0)
        if low == conv:
            carry[before] = (*carry[before][:-1], True)
        carry[part] = (low, *start, high, False)
        n, fp, upto = found[part][high]
        state = (start[0] + n, (start[1] + pow(base, start[0], 2**64) * fp) % 2**64, start[2] + upto) if low == high else (n, fp, upto)
        conv, before = high, part
    fields = "conv_id bigint, depth bigint, print bigint, parent bigint, turn bigint, chars bigint, upto bigint, ends boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, ids, turns, chars, places, prints, uptos, last = (np.asarray(c) for c in batch.columns)
            prints, last, places, uptos = prints.view(np.uint64).copy(), np.array(last, bool), places.copy(), uptos.copy()
            for p in np.unique(part).tolist():
                low, n, fp, upto, high, more = carry[p]
                own = np.flatnonzero((part == p) & (ids == low))
                prints[own] = np.uint64(fp) + powers(np.full(1, n))[0] * prints[own]
                places[own] += n
                uptos[own] += upto
                if more:
                    last[(part == p) & (ids == high)] = False
            parent = prints - mix(turns.view(np.uint64)) * powers(places - 1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, places, prints.view(np.int64), parent.view(np.int64), turns, chars, uptos, last)], ["conv_id", "depth", "print", "parent", "turn", "chars", "upto", "ends"])

    return rows.mapInArrow(run, fields)


def turn_keys(turns: DataFrame, bits: int = 64) -> DataFrame:
    """turns with a key that only rows of equal role and text share."""
    key = F.xxhash64("role", "text")
    keyed = turns.withColumn("turn", key if bits == 64 else key.bitwiseAND((1 << bits) - 1))
    for seed in range(1, 100):
        texts = keyed.select("turn", "role", "text").distinct()
        shared = texts.groupBy("turn").agg(F.count("*").alias("n"), F.min(F.struct("role", "text")).alias("first")).where("n > 1").select("turn", "first")
        shared = written(shared, "turn_keys")
        if shared.isEmpty():
            drop_written(shared)
            return keyed
        new = F.when(F.struct("role", "text") != F.col("first"), F.xxhash64(F.lit(seed), "role", "text")).otherwise(F.col("turn"))
        keyed = keyed.join(shared, "turn", "left").withColumn("turn", new).drop("first")
    raise RuntimeError("turns of one key did not settle")


def grafted(turns: DataFrame, graft: Graft | None, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of rebuilt conversations (conv_id, place, turn, chars), and all conversations."""
    order = [F.col("ord").asc_nulls_first(), F.col("role"), F.col("text")]
    own = scanned(turns, order, "turns")
    rows = joined(own).select("conv_id", (F.col("depth") - 1).alias("place"), "turn", "chars")
    rows = written(rows, "places")
    drop_written(own)
    convs = rows.where("place = 0").select("conv_id")
    if graft is None:
        return rows, convs
    base, n = graft(F.col("conv_id"))
    heads = rows.where(F.col("place") < most).select(F.col("conv_id").alias("base"), F.col("place").alias("at"), "turn", "chars")
    taken = convs.select("conv_id", base.alias("base"), n.alias("n")).where("n > 0").join(heads, "base").where("at < n")
    return taken.select("conv_id", (F.col("at") - most).alias("place"), "turn", "chars").unionByName(rows.where(F.col("place") >= n)), convs


def told_apart(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths whose candidates of one depth and fingerprint are equal prefixes, and their nodes."""
    for seed in range(100):
        alike = [F.min("parent").alias("p0"), F.max("parent").alias("p1"), F.min("turn").alias("t0"), F.max("turn").alias("t1")]
        nodes = paths.groupBy("depth", "print").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(F.struct("conv_id", "parent", "turn")).alias("first"), *alike)
        nodes = written(nodes, "nodes")
        mixed = nodes.where("p0 <> p1 or t0 <> t1")
        if mixed.isEmpty():
            return paths, nodes.select("depth", "print", "conv_id", "n_convs", F.col("p0").alias("parent"))
        other = paths.join(mixed.select("depth", "print", F.col("first.parent").alias("fp"), F.col("first.turn").alias("ft")), ["depth", "print"]).where("parent <> fp or turn <> ft")
        begin = other.groupBy("conv_id").agg(F.min(F.struct("depth", "parent", "turn")).alias("at"))
        renewed = lambda c: F.xxhash64(F.lit(seed), F.col(c), "at.parent", "at.turn")
        moved = paths.join(begin, "conv_id", "left")
        old, paths = paths, written(moved.select(
            "conv_id", "depth", F.when(F.col("depth") >= F.col("at.depth"), renewed("print")).otherwise(F.col("print")).alias("print"),
            F.when(F.col("depth") > F.col("at.depth"), renewed("parent")).otherwise(F.col("parent")).alias("parent"), "turn", "chars", "upto", "ends",
        ), "paths")
        drop_written(nodes, old)
    raise RuntimeError("prefixes of one fingerprint did not settle")


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, print, sha: SHA-256 of the ids of each group in ascending order, comma-joined."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            depth, fp, ids = (np.asarray(c) for c in batch.columns)
            cut = np.flatnonzero((depth[1:] != depth[:-1]) | (fp[1:] != fp[:-1])) + 1
            bounds = np.unique(np.concatenate(([0], cut, np.arange(0, len(ids), BLOCK_IDS), [len(ids)])).astype(np.int64))
            joined_ids = [",".join(map(str, ids[a:b].tolist())).encode() for a, b in zip(bounds, bounds[1:], strict=False)]
            texts = [zstandard.compress(t, 1) if len(t) > 1000 else t for t in joined_ids]
            at = bounds[:-1]
            small = [len(t) <= 1000 for t in joined_ids]
            nths = np.arange(nth, nth + len(at))
            nth += len(at)
            yield pa.RecordBatch.from_arrays([pa.array(depth[at]), pa.array(fp[at]), pa.array(np.full(len(at), part, np.int32)), pa.array(nths), pa.array(small), pa.array(texts, pa.binary())], ["depth", "print", "part", "nth", "plain", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for depth, fp, _, _, plain, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = ids if plain else zstandard.decompress(ids)
                if (depth, fp) == now:
                    state.update(b"," + raw)
                    continue
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = (depth, fp), hashlib.sha256(raw)
            yield _digests(out)
        if now:
            yield _digests([(*now, state.hexdigest())])

    count = partitions(ends.sparkSession)
    key = ["depth", "print"]
    laid = ends.repartitionByRange(count, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    packed = laid.mapInArrow(pack, "depth bigint, print bigint, part int, nth bigint, plain boolean, ids binary")
    return packed.repartition(count, *key).sortWithinPartitions(*key, "part", "nth").mapInArrow(hashed, "depth bigint, print bigint, sha string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["depth", "print", "sha"])


def prefix_trie(conversations: DataFrame, graft: Graft | None = None, most: int = 0, key_bits: int = 64, print_bits: int = 64) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    graft names a conversation whose first turns, at most ``most``, replace as
    many own ones. Fewer bits of keys and fingerprints only make more collisions
    to be told apart.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("ord"), text("role").alias("role"), text("text").alias("text"))
    turns = turn_keys(turns, key_bits).withColumn("chars", F.length("text").cast("bigint"))
    rows, convs = grafted(turns, graft, most)
    every = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("low")).first()
    own = scanned(rows, [F.col("place")], "rebuilt")
    paths = joined(own)
    if print_bits < 64:
        narrow = lambda c: F.col(c).bitwiseAND((1 << print_bits) - 1)
        paths = paths.withColumn("print", narrow("print")).withColumn("parent", F.when(F.col("depth") > 1, narrow("parent")).otherwise(F.lit(0)))
    paths = written(paths, "paths")
    drop_written(own)
    paths, nodes = told_apart(paths)
    total, n_nodes = paths.count(), nodes.count()
    children = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("print")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, ["depth", "print"], "left").fillna(0, ["n_children"]), "counted")
    placed = join_counted(paths, nodes.select("depth", "print", F.col("conv_id").alias("first"), "n_convs", "n_children"), ["depth", "print"], "n_convs", total)
    shared, leaf = F.col("conv_id") != F.col("first"), F.col("ends") & (F.col("n_children") == 0) & (F.col("conv_id") == F.col("first"))
    of_conv = placed.groupBy("conv_id").agg(F.coalesce(F.max(F.when(shared, F.col("upto"))), F.lit(0)).alias("saved"), F.max(F.when(leaf, 1).otherwise(0)).alias("leaf"), F.count("*").alias("n"))
    of_conv = written(of_conv, "of_conv")
    less = F.greatest(F.col("saved") - (F.col("upto") - F.col("chars")), F.lit(0))
    sums = join_counted(paths, of_conv, ["conv_id"], "n", total).groupBy("depth", "print").agg(F.sum("leaf").alias("n_leaves"), F.sum(less).alias("saved_tokens"))
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("print").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    deep = join_counted(nodes.where("depth > 1").drop("n_children"), parents, ["depth", "parent"], "n_children", n_nodes).select("depth", "print", "parent_conv_id")
    flat = nodes.where("depth = 1").select("depth", "print", F.lit(every.low).cast("bigint").alias("parent_conv_id"))
    turnless = convs.join(paths.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("print"), "conv_id")
    digests = end_digests(paths.where("ends").select("depth", "print", "conv_id").unionByName(turnless))
    tops = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    branches = nodes.where("depth = 1").agg(F.count("*").alias("n_children"))
    down = of_conv.agg(F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    one = lambda df: df.withColumn("one", F.lit(1))
    root = one(tops).join(one(branches), "one").join(one(down), "one").select(
        "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("print"), F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens",
    )
    key = ["depth", "print"]
    below = nodes.join(deep.unionByName(flat), key).join(sums, key).select(*root.columns)
    out = below.unionByName(root).join(digests, key, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def century(conv: Column) -> tuple[Column, Column]:
    """The graft of the registered query: up to five first turns of the conversation that begins the hundred."""
    return conv - conv % 100, F.crc32(conv.cast("string")) % 6


def oracle() -> str:
    """The DuckDB statement of the registered query: prefixes as lists of turns."""
    crc = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda a, x: list_reduce(range(8), lambda b, k: xor(b >> 1, (b & 1) * 3988292384), xor(a, x)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""
    return f"""WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN t ON t.conv_id = c.base AND i < h UNION ALL SELECT conv_id, 1, i, role, text FROM c JOIN t USING (conv_id) WHERE i >= h),
s AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth FROM r),
p AS (SELECT conv_id, depth, length(text) AS chars, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS prefix FROM s
  UNION ALL SELECT conv_id, 0, 0, [] FROM c),
m AS (SELECT conv_id, depth, chars, dense_rank() OVER (ORDER BY depth, prefix) AS id, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT id, min(depth) AS depth, min(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY id),
up AS (SELECT n.id, q.id AS parent, a.conv_id AS parent_conv_id FROM n JOIN m q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1 JOIN n a ON a.id = q.id),
kids AS (SELECT parent AS id, count(*) AS n_children FROM up GROUP BY parent),
above AS (SELECT n.id AS low, m.id AS id, (n.n_convs - 1) * n.chars AS spared, NOT EXISTS (FROM kids WHERE kids.id = n.id) AS leaf FROM n JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth),
sums AS (SELECT id, sum(spared) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM above GROUP BY id)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM n LEFT JOIN up USING (id) LEFT JOIN kids USING (id) JOIN sums USING (id)"""
