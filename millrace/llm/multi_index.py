"""Approximate nearest neighbours by an inverted multi-index.

Two codebooks quantise the halves of each vector; a cell is a pair of
centroids. The codebooks, and the part of all rows that a query must probe to
reach the wanted recall, are fitted on a bounded sample; every row is indexed.
A query walks centroid pairs by summed distance with a heap until its cells
hold that part, and the entries are reranked by their inner product. Cells go
to shards of bounded size; one that is larger is split. A task holds one shard
and one block of queries. Actions run while the plan is built.

Rows: vectors that are null, zero, hold null or non-finite components, or
differ in length from the most frequent length take no part as query or
candidate. Of rows with equal vectors only the k + 1 of least id can be among
k nearest, so no more are indexed; ties go to the smaller id. Rows that repeat
an id must be equal and count once. Extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.llm.shared import partitions

#: Rows that codebooks are fitted on, and those of them that recall is calibrated with.
SAMPLE_ROWS, CALIBRATION_QUERIES = 20_000, 256
SHARD_ROWS = 20_000
#: Queries that one task holds; a shard meets each block of queries in a task of its own.
QUERY_BLOCK = 65_536


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced distinct rows."""
    distinct = np.unique(x, axis=0)
    distinct = distinct[np.random.RandomState(7).permutation(len(distinct))]
    centroids = distinct[:k].copy()
    for _ in range(rounds):
        own = nearest(x, centroids)
        size = np.bincount(own, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


class MultiIndex:
    """Codebooks of both halves, and the part of rows to probe."""

    def __init__(self, one: np.ndarray, two: np.ndarray, part: float = 1.0):
        self.one, self.two, self.part = one, two, part

    @classmethod
    def fit(cls, x: np.ndarray, k: int, recall: float, near: int) -> MultiIndex:
        half = x.shape[1] // 2
        index = cls(kmeans(x[:, :half], k), kmeans(x[:, half:], k))
        cells = index.cells(x)
        size = np.bincount(cells, minlength=index.n_cells)
        needed = []
        for q in x[:CALIBRATION_QUERIES]:
            top = np.argsort(-(x @ q), kind="stable")[1 : near + 1]
            order = np.argsort(-index.products(q), kind="stable")
            before = np.empty(index.n_cells)
            before[order] = np.cumsum(size[order])
            needed.append(before[cells[top]] / len(x))
        index.part = float(np.quantile(np.concatenate(needed), recall)) if needed and len(x) > near else 1.0
        return index

    @property
    def n_cells(self) -> int:
        return len(self.one) * len(self.two)

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = x.shape[1] // 2
        return nearest(x[:, :half], self.one) * len(self.two) + nearest(x[:, half:], self.two)

    def products(self, q: np.ndarray) -> np.ndarray:
        half = len(q) // 2
        return ((self.one @ q[:half])[:, None] + (self.two @ q[half:])[None]).ravel()

    def probe(self, q: np.ndarray, size: np.ndarray, least: int) -> list[int]:
        """Cells by summed distance of their halves (how far each falls short of the best inner product) until they hold ``least`` rows."""
        half = len(q) // 2
        a, b = self.one @ q[:half], self.two @ q[half:]
        i_order, j_order = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        da, db = (a.max() - a).tolist(), (b.max() - b).tolist()
        heap, seen, out, held = [(0.0, 0, 0)], {(0, 0)}, [], 0
        while heap and held < least:
            _, i, j = heapq.heappop(heap)
            cell = i_order[i] * len(j_order) + j_order[j]
            if size[cell]:
                out.append(cell)
                held += int(size[cell])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(i_order) and y < len(j_order) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (da[i_order[x]] + db[j_order[y]], x, y))
        return out


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (doubles) of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    out = rows.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(sound)
    common = out.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return out.where(F.size("v") == (common.d if common else 0))


def search(candidates: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = 64, recall: float = 0.96) -> DataFrame:
    """query_id, rank (from 1), id, score of each query's k nearest candidates found, a query's own row left out."""
    spark = candidates.sparkSession
    rows, asked = valid_vectors(candidates, id_col, vector_col), valid_vectors(queries, id_col, vector_col).distinct()
    asked = asked.repartition(partitions(spark), "id")  # walking cells costs time, not bytes: small partitions must not be joined
    least = W.Window.partitionBy("v").orderBy("id")
    rows = rows.withColumn("nth", F.dense_rank().over(least)).where(F.col("nth") <= k + 1).drop("nth").distinct()  # dealt by vector already
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    schema = "query_id bigint, rank int, id bigint, score double"
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    index = spark.sparkContext.broadcast(MultiIndex.fit(matrix(sample.column("v")), centroids, recall, k))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index.value.cells(matrix(b.column(1))))], ["id", "v", "cell"])

    celled = rows.mapInArrow(assign, "id bigint, v array<double>, cell bigint")
    size = np.zeros(index.value.n_cells, np.int64)
    for r in celled.groupBy("cell").count().collect():  # at most centroids ** 2 rows
        size[r.cell] = r["count"]
    parts = np.maximum(1, -(-size // SHARD_ROWS))
    first, at, held = np.zeros(len(size), np.int64), 0, 0
    for c in range(len(size)):  # runs of cells share a shard; a large cell has shards of its own
        if held and held + size[c] > SHARD_ROWS:
            at, held = at + 1, 0
        first[c] = at
        if parts[c] > 1:
            at, held = at + int(parts[c]), 0
        else:
            held += size[c]
    plan = spark.sparkContext.broadcast((size, first, parts))
    enough = max(k + 1, int(np.ceil(index.value.part * size.sum())))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, start, split = plan.value
        for b in batches:
            cell, ids = np.asarray(b.column(2)), np.asarray(b.column(0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start[cell] + ids % split[cell])], ["id", "v", "cell", "shard"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, start, split = plan.value
        for b in batches:
            ids, out = np.asarray(b.column(0)), []
            x = matrix(b.column(1)) if b.num_rows else None
            for n in range(b.num_rows):
                cells = np.array(index.value.probe(x[n], count, enough), np.int64)
                which = np.repeat(cells, split[cells])
                shard = np.repeat(start[cells], split[cells]) + np.arange(len(which)) - np.repeat(np.cumsum(split[cells]) - split[cells], split[cells])
                order = np.argsort(shard, kind="stable")
                edge = np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) > 0)))
                out += [(int(shard[order[e]]), ids[n], n, np.sort(part)) for e, part in zip(edge, np.split(which[order], edge[1:]), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[1] for o in out], pa.int64()), b.column(1).take(pa.array([o[2] for o in out])), pa.array([o[3] for o in out], pa.list_(pa.int64())), pa.array([o[0] for o in out], pa.int64())],
                    ["id", "v", "cells", "shard"],
                )

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, cell, x = left.column("id").to_numpy(), left.column("cell").to_numpy(), matrix(left.column("v"))
            order = np.argsort(ids, kind="stable")
            ids, cell, x = ids[order], cell[order], x[order]
            asked_ids, cells = right.column("id").to_numpy(), right.column("cells").to_pylist()
            q = matrix(right.column("v"))
            for a in range(0, len(q), 64):
                scores = q[a : a + 64] @ x.T
                for n, row in enumerate(scores, a):
                    row = np.where(np.isin(cell, cells[n]) & (ids != asked_ids[n]), row, -np.inf)
                    cut = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    near = np.flatnonzero((row >= cut - 1e-9 * max(1.0, abs(cut))) & (row > -np.inf)) if cut > -np.inf else np.flatnonzero(row > -np.inf)
                    exact = (x[near] * q[n]).sum(axis=1)
                    best = np.lexsort((ids[near], -exact))[:k]
                    out += zip([asked_ids[n]] * len(best), ids[near][best], exact[best], strict=True)
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "id", "score"])

    stored, sent = celled.mapInArrow(place, "id bigint, v array<double>, cell bigint, shard bigint"), asked.mapInArrow(route, "id bigint, v array<double>, cells array<bigint>, shard bigint")
    stored = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    sent = sent.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    found = stored.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(rerank, "query_id bigint, id bigint, score double")
    best = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
