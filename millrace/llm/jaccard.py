"""N-gram Jaccard join with set relations: exact links at a similarity, as one class for each document.

1. Every distinct shingle of every text goes once, as sorted compressed
   arrays, to the shard of its hash, which counts the documents that hold it.
   Shingles of one document only can't link; the others return to their
   documents, which order them by count: rarest first.
2. Documents with equal sets are one class from here on.
3. The index lists hold each set's prefix, with size and position, cut into
   blocks by size. A probe skips blocks whose size, and pairs whose position,
   rules the similarity out.
4. Each block is first answered from one pivot set. Sets that link to it share
   its component, and what is still to be tested is derived from the
   distances to pivots that are already known: Jaccard distance is a metric,
   so a set near its pivot lets all that is far from the pivot go.
   The remaining pairs of different components are verified one by one.

Rows: a null or blank text has the empty set (n_shingles 0) and links with
nothing; shorter texts than n words are one shingle; whole texts are read. Rows
without an id are left out; rows that repeat an id must be equal and count
once. Extra columns are not read; an empty table gives an empty result.
Actions run while the plan is built; intermediate tables are dropped once
nothing reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.blocks import MULTIPLIER, blocks, hash_spans, mix, owner, pack, pack_sorted, shingles, spans, unpack, unpack_sorted
from millrace.llm.components import components
from millrace.llm.shared import drop_written, partitions, written

#: Entries that a task gathers before it sorts and sends them.
FLUSH = 1_000_000
#: Bytes of text whose shingles it makes at a time.
PIECE_BYTES = 1 << 20
#: Rows of one class of equal sets are dealt to this many tasks.
SALT = 32
_SENT = "shard int, kind int, ids binary, a binary, b binary, c binary"


def document_shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles: hashes and documents, by document."""
    start, end = spans(data, off)
    words = hash_spans(data, start, end)
    doc = owner(off, start)
    h = shingles(words, n)
    own = doc[: len(h)]
    inside = own == doc[n - 1 :] if len(h) else np.zeros(0, bool)
    h, own = h[inside], own[inside]
    count = np.bincount(doc, minlength=len(off) - 1)
    first = np.concatenate(([0], np.cumsum(count)))
    for k in range(1, n):  # whole sequences of fewer words
        short = np.flatnonzero(count == k)
        if len(short):
            at = first[short]
            g = words[at].copy()
            for i in range(1, k):
                g = g * MULTIPLIER + words[at + i]
            h, own = np.concatenate((h, mix(g + np.uint64(k)))), np.concatenate((own, short))
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[keep], own[keep]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards by range of the hash: sorted hashes give sorted shards."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _slices(keys: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(n + 1))


def shingle_sets(docs: DataFrame, n: int = 5, numerator: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, two signature words of the set, n_unique, and tokens: its shingles that other documents hold too, rarest first (empty where too few for any link)."""
    shards = partitions(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = turn = 0

        def flush() -> pa.RecordBatch:
            nonlocal turn
            ids = np.concatenate([x[0] for x in held])
            base = np.cumsum([0] + [len(x[0]) for x in held])
            h = np.concatenate([x[1] for x in held])
            own = np.concatenate([x[2] + b for x, b in zip(held, base, strict=False)])
            count = np.bincount(own, minlength=len(ids))
            first = np.concatenate(([0], np.cumsum(count)[:-1]))
            total = np.concatenate((h, np.zeros(1, np.uint64)))
            some = count > 0
            sums = [np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)]
            if some.any():
                sums[0][some] = np.add.reduceat(mix(total[:-1] + np.uint64(1)), first[some])
                sums[1][some] = np.add.reduceat(mix(total[:-1] ^ MULTIPLIER), first[some])
            order = np.argsort(h, kind="stable")
            h, own = h[order], own[order].astype(np.uint32)
            cut = _slices(shard_of(h, shards), shards)
            rows = []
            for s in range(shards):
                a, b = cut[s], cut[s + 1]
                if a < b:
                    near, d = np.unique(own[a:b], return_inverse=True)
                    rows.append((s, 0, pack(ids[near]), pack_sorted(h[a:b]), pack(d.astype(np.uint16 if len(near) <= 65536 else np.uint32)), b"2" if len(near) <= 65536 else b"4"))
            block = np.array(mix(ids.astype(np.uint64)) % np.uint64(shards), np.int64)
            order = np.argsort(block, kind="stable")
            cut = _slices(block[order], shards)
            turn += 1
            for s in range(shards):  # facts of a document travel by way of its own block's number
                if cut[s] < cut[s + 1]:
                    at = order[cut[s] : cut[s + 1]]
                    rows.append((s, 1, pack(ids[at]), pack(count[at].astype(np.int64)), pack(sums[0][at]), pack(sums[1][at])))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["shard", "kind", "ids", "a", "b", "c"])

        for block in blocks(batches, id_col, text_col, PIECE_BYTES):
            h, own = document_shingles(block.data, block.off, n)
            held.append((block.ids.astype(np.int64), h, own))
            size += len(h) + len(block.ids)
            if size >= FLUSH:
                yield flush()
                size = 0
        if held:
            yield flush()

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        out, docs_, hashes = [], [], []
        for r in rows.to_pylist():
            if r["kind"] == 1:
                out.append((key[0].as_py(), 1, r["ids"], r["a"], r["b"], r["c"]))
            else:
                docs_.append(unpack(r["ids"], np.int64)[unpack(r["b"], np.uint16 if r["c"] == b"2" else np.uint32)])
                hashes.append(unpack_sorted(r["a"]))
        if docs_:
            doc, h = np.concatenate(docs_), np.concatenate(hashes)
            del docs_, hashes
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            df = np.diff(np.concatenate((first, [len(h)])))
            more = np.repeat(df > 1, df)
            h, doc, df = h[more], doc[more], np.repeat(df, df)[more]
            block = np.array(mix(doc.astype(np.uint64)) % np.uint64(shards), np.int64)
            order = np.lexsort((doc, block))
            h, doc, df, block = h[order], doc[order], df[order], block[order]
            cut = _slices(block, shards)
            for s in range(shards):
                a, b = cut[s], cut[s + 1]
                if a < b:
                    out.append((s, 0, pack(np.diff(doc[a:b], prepend=0)), pack(h[a:b]), pack(df[a:b].astype(np.uint32)), b""))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["shard", "kind", "ids", "a", "b", "c"])

    def gather(rows: pa.Table) -> pa.Table:
        facts, doc, h, df = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for r in rows.to_pylist():
            if r["kind"] == 1:
                facts.append((unpack(r["ids"], np.int64), unpack(r["a"], np.int64), unpack(r["b"], np.uint64), unpack(r["c"], np.uint64)))
            else:
                doc.append(np.cumsum(unpack(r["ids"], np.int64)))
                h.append(unpack(r["a"], np.uint64))
                df.append(unpack(r["b"], np.uint32))
        ids, size, one, two = (np.concatenate(x) for x in zip(*facts, strict=True))
        ids, at = np.unique(ids, return_index=True)
        size, one, two = size[at], one[at], two[at]
        doc, h, df = np.concatenate(doc), np.concatenate(h), np.concatenate(df)
        order = np.lexsort((h, df, doc))
        doc, h = doc[order], h[order]
        keep = np.ones(len(doc), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[keep], h[keep]
        cut = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
        shared = cut[1] - cut[0]
        able = (shared * 100 >= size * numerator) & (size > 0)
        length = np.where(able, shared, 0)
        tokens = h[np.repeat(able, shared)]
        offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
        return pa.table([pa.array(ids), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(size - shared), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.view(np.int64)))], ["doc_id", "n_shingles", "sig_a", "sig_b", "n_unique", "tokens"])

    sent = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).where(F.col(id_col).isNotNull()).mapInArrow(send, _SENT)
    counted = sent.groupBy("shard").applyInArrow(count, _SENT)
    return counted.groupBy("shard").applyInArrow(gather, "doc_id bigint, n_shingles bigint, sig_a bigint, sig_b bigint, n_unique bigint, tokens array<bigint>")


def _linked(inter: Column | str, a: str, b: str, numerator: int) -> Column:
    inter = F.col(inter) if isinstance(inter, str) else inter
    return 100 * inter >= numerator * (F.col(a) + F.col(b) - inter)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y, nx, ny and the exact overlap of each pair's sets."""
    left = sets.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    right = sets.select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    return pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "nx", "ny", F.size(F.array_intersect("tx", "ty")).cast("long").alias("inter"))


def jaccard_classes(docs: DataFrame, n: int = 5, numerator: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_id (least document with an equal set), component_id (least document reachable by links of similarity >= numerator / 100)."""
    sets = written(shingle_sets(docs, n, numerator, id_col, text_col), "sets")
    equal = ["sig_a", "sig_b", "n_shingles"]
    classes = sets.where("n_shingles > 0").groupBy(*equal).agg(F.min("doc_id").alias("set_id"), F.count("*").alias("members"))
    able = sets.where(F.size("tokens") > 0)
    heads = able.join(classes.select("set_id"), able.doc_id == F.col("set_id"), "left_semi").select("doc_id", F.col("n_shingles").alias("n"), "n_unique", "tokens")
    heads = written(heads, "heads")

    prefix = F.col("n") - F.ceil(F.col("n") * numerator / F.lit(100)) + 1 - F.col("n_unique")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / numerator))).cast("int")
    postings = (
        heads.select("doc_id", "n", "n_unique", band.alias("band"), F.posexplode(F.slice("tokens", 1, F.least(F.size("tokens"), prefix.cast("int")))).alias("i", "token"))
        .select("doc_id", "n", "token", (F.col("n_unique") + F.col("i")).alias("pos"), "i", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    )
    lists = postings.groupBy("token", "band").agg(F.min(F.struct("n", "doc_id")).alias("low"), F.max(F.struct("n", "doc_id")).alias("high"), F.count("*").alias("size")).where("size > 1")
    index = written(postings.join(lists, ["token", "band"]), "index")

    near = lambda a, b: (100 * F.least(a, b) >= numerator * F.greatest(a, b))

    def pivots(end: str) -> DataFrame:
        return index.where(F.col("doc_id") != F.col(f"{end}.doc_id")).where(near(F.col("n"), F.col(f"{end}.n"))).select(F.greatest("doc_id", f"{end}.doc_id").alias("x"), F.least("doc_id", f"{end}.doc_id").alias("y"))

    first = seen = written(verify(pivots("low").unionByName(pivots("high")).distinct(), heads), "pivots")
    links = seen.where(_linked("inter", "nx", "ny", numerator)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    label = components(links)

    def unsettled(label: DataFrame) -> DataFrame:
        """Rows of the blocks whose sets aren't all of one component yet."""
        member = index.select("token", "band", "doc_id", "n", "pos", "i").join(label, index.doc_id == label.node, "left").withColumn("c", F.coalesce("component", "doc_id")).drop("node", "component")
        ends = member.groupBy("token", "band").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1")
        return member.join(ends, ["token", "band"])

    # each set against one member of other components, another one in each block
    rest = open_ = written(unsettled(label), "unsettled")
    some = rest.where("c = c0 or c = c1").groupBy("token", "band", "c").agg(F.min_by(F.struct("doc_id", "n"), F.xxhash64("doc_id", "token")).alias("r")).withColumnRenamed("c", "rc")
    pairs = (
        rest.join(some, ["token", "band"]).where("c <> rc").where(near(F.col("n"), F.col("r.n")))
        .select(F.greatest("doc_id", "r.doc_id").alias("x"), F.least("doc_id", "r.doc_id").alias("y")).distinct().join(seen.select("x", "y"), ["x", "y"], "left_anti")
    )
    again = written(verify(pairs, heads), "pivots")
    seen = seen.unionByName(again)
    links = links.unionByName(again.where(_linked("inter", "nx", "ny", numerator)).select(F.col("x").alias("a"), F.col("y").alias("b")))
    label = components(links)

    # what is still open, pair by pair: each pair in the block of its first common token, and not if a common pivot rules it out
    far = lambda: 1 - F.col("inter") / (F.col("nx") + F.col("ny") - F.col("inter"))
    known = seen.select(F.col("x").alias("d"), F.col("y").alias("p"), far().alias("far")).unionByName(seen.select(F.col("y").alias("d"), F.col("x").alias("p"), far().alias("far")))
    best = known.groupBy("d").agg(F.min(F.struct("far", "p")).alias("near"), F.min(F.struct("p", "far")).alias("hub"))
    limit = 1 - numerator / 100 + 1e-9
    rest = unsettled(label).join(best, F.col("doc_id") == F.col("d"), "left").drop("d")
    rest = rest.join(heads.select("doc_id", "tokens"), "doc_id").withColumn("before", F.slice("tokens", 1, F.col("i"))).drop("tokens")
    a, b = rest.alias("a"), rest.alias("b")
    both = F.col("a.n") + F.col("b.n")
    apart = lambda e: F.coalesce((F.col(f"a.{e}.p") == F.col(f"b.{e}.p")) & (F.abs(F.col(f"a.{e}.far") - F.col(f"b.{e}.far")) > limit), F.lit(False))
    pairs = (
        a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.doc_id") > F.col("b.doc_id")) & (F.col("a.c") != F.col("b.c"))
               & near(F.col("a.n"), F.col("b.n"))
               & ((100 + numerator) * F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= numerator * both)
               & ~apart("near") & ~apart("hub") & ~F.arrays_overlap("a.before", "b.before"))
        .select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y")).distinct().join(seen.select("x", "y"), ["x", "y"], "left_anti")
    )
    # answers derived from a highly similar set: by the triangle inequality over a pivot that both were tested with
    at = lambda d, p, out: known.select(F.col("d").alias(d), F.col("p").alias(p), F.col("far").alias(out))
    nearest = lambda d, p, out: best.select(F.col("d").alias(d), F.col("near.p").alias(p), F.col("near.far").alias(out))
    tested = (
        pairs.join(nearest("x", "px", "xp"), "x", "left").join(at("y", "px", "yq"), ["y", "px"], "left")
        .join(nearest("y", "py", "yp"), "y", "left").join(at("x", "py", "xq"), ["x", "py"], "left")
        .where(~F.coalesce(F.abs(F.col("yq") - F.col("xp")) > limit, F.lit(False)) & ~F.coalesce(F.abs(F.col("xq") - F.col("yp")) > limit, F.lit(False)))
    )
    more = written(verify(tested, heads).where(_linked("inter", "nx", "ny", numerator)).select(F.col("x").alias("a"), F.col("y").alias("b")), "links")
    if not more.isEmpty():
        label = components(links.unionByName(more))

    drop_written(heads, index, first, open_, again, more)

    # a class's rows are dealt by class and salt; sets of one document need no class, and their label comes by the document
    many = classes.where("members > 1").join(label, F.col("set_id") == F.col("node"), "left").select(*equal, "set_id", F.col("component").alias("of_class"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    found = sets.select("doc_id", *equal, F.pmod("doc_id", F.lit(SALT)).cast("int").alias("salt")).join(many, [*equal, "salt"], "left")
    found = found.join(label, found.doc_id == label.node, "left")
    return found.select("doc_id", "n_shingles", F.coalesce("set_id", "doc_id").alias("set_id"), F.coalesce("of_class", "component", "set_id", "doc_id").alias("component_id"))


def oracle(source: str = "documents") -> str:
    """The same classes in DuckDB's SQL, by the join of all shingles: for small tables."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^ \t\n\x0B\f\r]+') AS w FROM {source}),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y, c = nx.n AND c = ny.n AS same FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node), t AS (SELECT y, min(x) AS x FROM l WHERE same GROUP BY y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(t.x, d.doc_id) AS set_id, coalesce(c.component_id, d.doc_id) AS component_id
FROM {source} d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.y = d.doc_id LEFT JOIN c ON c.node = d.doc_id"""
