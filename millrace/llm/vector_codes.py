"""Product codes of vectors, fitted by Lloyd's rounds in integers, every assignment exact.

A component x becomes floor(scale * x). The distances of a block of parts to
the codebook come from one float32 matrix product; each has an interval that
rounding can't leave, and only the entries whose interval overlaps the best one
are computed again in int64, ties by index. Spark adds up sums and counts by
entry; the driver holds the codebooks, which are bounded by entries x length.
Actions run while the plan is built.

Rows: vectors that are null, hold null or non-finite components, or differ in
length from the most frequent length (ties: the shorter) are dropped; so are
those with a component so large that squared distances could leave int64
(for 64 components, 131,072 at a scale of 1,024). Lengths that parts don't
divide are cut at floor(length * i / parts). Ids that repeat are rows of their
own; the first codebook goes by id (nulls last), then by components. With fewer
rows than entries, the codebook is as small. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import written
from millrace.llm.skew import join_counted

#: Rows whose distances to one codebook a worker holds at a time.
BLOCK_ROWS = 4096
#: Pairs of row and entry evaluated again at a time.
EXACT_PAIRS = 1 << 16
#: Half the distance from 1 to the next float32, and to the next float64.
U32, U64 = 2.0**-24, 2.0**-53


def largest_component(length: int) -> int:
    """The greatest size of an integer component for which sums of squared differences stay below 2^62."""
    return int((2**60 / max(length, 1)) ** 0.5)


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of equally long lists of numbers, and which rows are small enough to keep."""
    values = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    whole = np.floor(values * scale)
    kept = (np.abs(whole) <= largest_component(whole.shape[1])).all(axis=1)
    return whole[kept].astype(np.int64), kept


def screened(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and entry of every pair whose distance may be the least of its row, by row, then entry.

    A product of n factors, its factors rounded to float32, is off by at most
    g * |x| * |c| with g = (n + 2) u / (1 - (n + 2) u), in whatever order it is
    added; the rest is done in float64, whose rounding is added to the margin.
    Integers can't underflow.
    """
    n = x.shape[1] + 2
    g = n * U32 / (1 - n * U32)
    product = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 4 * n * U64)
    square = (entries**2).sum(axis=1)  # exact: components are bounded
    far = np.sqrt(square.astype(np.float64)) * (1 + 4 * n * U64)
    score = square.astype(np.float64)[None] - 2 * product
    margin = 2 * g * norm[:, None] * far[None]
    margin += 8 * U64 * (square[None] + 2 * norm[:, None] * far[None])
    margin *= 1 + 8 * U64
    best = (score + margin).min(axis=1)
    return np.nonzero(score - margin <= best[:, None] * (1 + np.sign(best[:, None]) * 4 * U64))


def assign(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry."""
    index, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), BLOCK_ROWS):
        block = x[at : at + BLOCK_ROWS]
        row, entry = screened(block, entries)
        exact = np.empty(len(row), np.int64)
        for i in range(0, len(row), EXACT_PAIRS):
            one, two = row[i : i + EXACT_PAIRS], entry[i : i + EXACT_PAIRS]
            exact[i : i + EXACT_PAIRS] = ((block[one] - entries[two]) ** 2).sum(axis=1)
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        least[at : at + len(block)] = np.minimum.reduceat(exact, starts)
        hit = np.flatnonzero(exact == least[at : at + len(block)][row])
        first = hit[np.unique(row[hit], return_index=True)[1]]
        index[at : at + len(block)] = entry[first]
    return index, least


class VectorCodes:
    """One codebook (entries x length of the part, int64) for each part."""

    def __init__(self, books: list[np.ndarray], cuts: list[int], scale: int):
        self.books, self.cuts, self.scale = books, cuts, scale

    @classmethod
    def fit(cls, rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorCodes | None:
        """Codebooks of the rows that take part; None if there are none."""
        sound = sound_vectors(rows, id_col, vector_col, scale)
        first = sound.orderBy(F.col("id").asc_nulls_last(), F.transform("v", lambda v: F.floor(v.cast("double") * scale))).limit(entries).toArrow()
        if not first.num_rows:
            return None
        start, _ = integers(first.column("v").combine_chunks(), scale)
        cuts = [start.shape[1] * i // parts for i in range(parts + 1)]
        codes = cls([start[:, a:b].copy() for a, b in zip(cuts, cuts[1:], strict=False)], cuts, scale)
        for _ in range(rounds):
            codes.books = codes._replaced(sound)
        return codes

    def _replaced(self, sound: DataFrame) -> list[np.ndarray]:
        """Every entry that is used becomes the floor of its parts' mean."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = [np.zeros_like(b) for b in self.books], [np.zeros(len(b), np.int64) for b in self.books]
            for x in self._blocks(batches):
                for i, (index, _, part) in enumerate(self._assigned(x)):
                    np.add.at(sums[i], index, part)
                    counts[i] += np.bincount(index, minlength=len(counts[i]))
            for i, (total, count) in enumerate(zip(sums, counts, strict=True)):
                used = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i, np.int32)), pa.array(used.astype(np.int32)), pa.array([[int(c), *map(int, t)] for c, t in zip(count[used], total[used], strict=True)], pa.list_(pa.int64()))], ["part", "entry", "sums"])

        partial = sound.select("v").mapInArrow(run, "part int, entry int, sums array<bigint>")
        total = partial.select("part", "entry", F.posexplode("sums").alias("at", "n")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n")).toArrow()
        part, entry, at, n = (total.column(c).to_numpy() for c in ("part", "entry", "at", "n"))
        books = []
        for i, old in enumerate(self.books):
            table = np.zeros((len(old), old.shape[1] + 1), np.int64)
            own = part == i
            table[entry[own], at[own]] = n[own]
            count = table[:, :1]
            books.append(np.where(count > 0, table[:, 1:] // np.maximum(count, 1), old))
        return books

    def _blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            if batch.num_rows:
                yield integers(batch.column(batch.schema.get_field_index("v")), self.scale)[0]

    def _assigned(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False):
            part = x[:, a:b]
            yield (*assign(part, book), part)

    def digest(self) -> str:
        """SHA-256 of all components in order."""
        return hashlib.sha256(",".join(str(v) for book in self.books for v in book.ravel().tolist()).encode()).hexdigest()

    def encode(self, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
        """id, code (one index for each part) and error of every row that takes part, with the columns to keep."""
        sound = sound_vectors(rows, id_col, vector_col, self.scale, keep, self.cuts[-1])
        fields = ", ".join(f"`{c}` {t}" for c, t in sound.drop("v").dtypes) + ", `codes` array<int>, `error` bigint"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = batch.schema.get_field_index("v")
                x, small = integers(batch.column(at), self.scale)
                found = list(self._assigned(x))
                index = np.stack([f[0] for f in found], axis=1).astype(np.int32)
                other = batch.drop_columns(["v"]).filter(pa.array(small))
                codes = pa.ListArray.from_arrays(pa.array(np.arange(0, index.size + 1, len(found)).astype(np.int32)), pa.array(index.ravel()))
                yield pa.RecordBatch.from_arrays([*other.columns, codes, pa.array(sum(f[1] for f in found))], names=[*other.schema.names, "codes", "error"])

        return sound.mapInArrow(run, fields)


def sound_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int, keep: tuple[str, ...] = (), length: int | None = None) -> DataFrame:
    """id, v and the columns to keep (k0, k1, ...) of the rows that take part."""
    all_finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))).where(F.col("v").isNotNull()).where(all_finite)
    if length is None:
        common = out.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        length = common.d if common else 0
    small = F.forall("v", lambda x: F.abs(x.cast("double") * scale) <= largest_component(length))
    return out.where(F.size("v") == length).where(small)


def compress(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, codes, error, the error summed over equal labels (nulls together; null if it leaves a long) and the digest of the codebooks."""
    codes = VectorCodes.fit(rows, parts, entries, rounds, scale, id_col, vector_col)
    if codes is None:
        return rows.sparkSession.createDataFrame([], f"id {dict(rows.dtypes)[id_col]}, codes array<int>, error bigint, label_error bigint, codebooks_sha256 string")
    coded = written(codes.encode(rows, id_col, vector_col, (label_col,)), "codes")
    total = coded.groupBy("k0").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), F.count("*").alias("n"))
    joined = join_counted(coded, written(total, "label_errors"), ["k0"], "n", coded.count())
    return joined.select("id", "codes", "error", F.expr("try_cast(label_error as bigint)").alias("label_error"), F.lit(codes.digest()).alias("codebooks_sha256"))


def oracle() -> str:
    """The DuckDB statement of the registered query: rounds as a chain of tables."""
    books, steps = "b0", []
    for k in range(1, 6):
        steps.append(
            f"""a{k} AS (SELECT id, p, entry, d FROM (SELECT x.id, x.p, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
  row_number() OVER (PARTITION BY x.id, x.p ORDER BY list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry) AS rn
  FROM x JOIN {books} b USING (p)) WHERE rn = 1)"""
        )
        if k < 5:
            steps.append(
                f"""m{k} AS (SELECT p, entry, j, CAST(floor(sum(x.v[j]) / count(*)) AS BIGINT) AS low, sum(x.v[j]) AS s, count(*) AS n FROM a{k} JOIN x USING (id, p), (SELECT unnest(generate_series(1, 16)) AS j) g GROUP BY ALL),
f{k} AS (SELECT p, entry, list(CAST(CASE WHEN low * n > s THEN low - 1 WHEN (low + 1) * n <= s THEN low + 1 ELSE low END AS BIGINT) ORDER BY j) AS v FROM m{k} GROUP BY ALL),
b{k} AS (SELECT o.p, o.entry, coalesce(f.v, o.v) AS v FROM {books} o LEFT JOIN f{k} f USING (p, entry))"""
            )
            books = f"b{k}"
    chain = ",\n".join(steps)
    return f"""WITH kept AS (SELECT vec_id AS id, label, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS (SELECT id, p, w[16 * p + 1 : 16 * p + 16] AS v FROM kept, (SELECT unnest(generate_series(0, 3)) AS p) g),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY id) - 1 AS entry, v FROM x QUALIFY entry < 256),
{chain},
coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a5 GROUP BY id),
digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, entry, j)) AS codebooks_sha256 FROM (SELECT p, entry, unnest(v) AS c, generate_subscripts(v, 1) AS j FROM {books}))
SELECT r.id AS vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.codebooks_sha256
FROM coded r JOIN kept k USING (id) CROSS JOIN digest d"""
