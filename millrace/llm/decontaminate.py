"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

The benchmark is the stated query set: it is taken in slices of bounded size,
and each slice is sent to the tasks that scan the documents. A first scan
counts in how many documents each n-gram of the slice occurs. Of those that
occur at all, each item's rarest are its seeds, as many as the least score
needs: an alignment that reaches it keeps some n-grams whole, however its errors
lie, and all but one fewer may be left out. At scores of up to three quarters
that is every n-gram that occurs; what has no three of an item's words in a row
is not found. A second scan aligns every item with the region around its seeds'
diagonals, word by word, many alignments at a time.

Rows: null and blank texts and items match nothing; an item of fewer words than
a seed is its own seed; texts are read whole; each repeated row is scored;
extra columns are not read; empty tables give an empty result. Rows of
documents without an id carry a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.blocks import ALNUM_BYTES, Block, blocks, hash_spans, owner, shingles, spans, string_buffers

SEED_WORDS = 3
#: Part of the greatest score that an item's alignment must reach.
LEAST_SCORE = 0.5
#: Bytes of item text in one slice: bounds what is sent to every executor.
SLICE_BYTES = 8 << 20
MATCH, MISMATCH, GAP = 2, -1, 1
#: Words of text that one alignment looks at; wider regions are cut into pieces that overlap by a whole alignment.
PIECE_WORDS = 1 << 16


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words of letters and digits, case aside, and the document of each."""
    capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    if len(capital):  # the Latin capitals of two bytes
        data = data.copy()
        data[capital] += 0x20
    start, end = spans(data, off, ALNUM_BYTES)
    return hash_spans(data, start, end), owner(off, start)


def grams(words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The n-gram at each word, and 0 where it would cross a document's end."""
    out = np.zeros(len(words), np.uint64)
    h = shingles(words, n)
    inside = doc[: len(h)] == doc[n - 1 :] if len(h) else np.zeros(0, bool)
    out[: len(h)][inside] = h[inside]
    return out


@dataclass
class Slice:
    """Items: their ids and words, and their n-grams as hash, item, place and words, sorted by hash."""

    ids: pa.Array
    words: list[np.ndarray]
    hash: np.ndarray
    item: np.ndarray
    place: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, texts: list[str]) -> Slice:
        off, data = string_buffers(pa.array(texts, pa.large_string()))
        words, doc = word_hashes(data, off)
        each = [words[doc == i] for i in range(len(ids))]
        count = np.bincount(doc, minlength=len(ids))
        place = np.arange(len(words)) - np.concatenate(([0], np.cumsum(count)))[:-1][doc]
        parts = []
        for n in range(1, SEED_WORDS + 1):
            own = np.flatnonzero((grams(words, doc, n) != 0) & ((count[doc] == n) if n < SEED_WORDS else True))
            parts.append((grams(words, doc, n)[own], doc[own], place[own], np.full(len(own), n)))
        h, item, at, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        return cls(ids, each, h[order], item[order], at[order], length[order])

    def rarest(self, df: np.ndarray, least: float) -> Slice:
        """Only the n-grams that are seeds; df counts the documents that hold each.

        Of an item of n words, an alignment with m of them in place and e errors scores
        2m - e, so e is at most 2 (m - least n); each error breaks at most two more
        n-grams than its own word, and so (4 least - 3) n - 2 stay whole at least.
        """
        some = np.flatnonzero(df)
        order = some[np.lexsort((self.hash[some], df[some], self.item[some]))]
        first = np.searchsorted(self.item[order], np.arange(len(self.ids) + 1))
        nth = np.arange(len(order)) - first[self.item[order]]
        words = np.array([len(w) for w in self.words], np.int64)
        whole = np.maximum(np.floor((4 * least - 3) * words).astype(np.int64) - 2, 1)
        keep = np.sort(order[nth < (np.diff(first) - whole + 1)[self.item[order]]])
        return Slice(self.ids, self.words, self.hash[keep], self.item[keep], self.place[keep], self.length[keep])

    def lookup(self) -> np.ndarray:
        """A table by the top bits of a hash that lets most words go at once."""
        table = np.zeros(1 << 20, bool)
        table[(self.hash >> np.uint64(44)).astype(np.int64)] = True
        return table

    def hits(self, words: np.ndarray, doc: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions and n-gram numbers of all occurrences."""
        at, gram = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in np.unique(self.length):
            own = self.length == n
            h = grams(words, doc, int(n))
            some = np.flatnonzero(table[(h >> np.uint64(44)).astype(np.int64)] & (h != 0))
            low, high = np.searchsorted(self.hash, h[some]), np.searchsorted(self.hash, h[some], "right")
            size = high - low
            which = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            where = np.repeat(some, size)
            keep = own[which]
            at.append(where[keep])
            gram.append(which[keep])
        return np.concatenate(at), np.concatenate(gram)


def smith_waterman(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The best local score of each pair and where in the text it ends; pairs are padded and advance together."""
    n, rows, width = len(items), max(map(len, items)), max(map(len, texts))
    a = np.zeros((rows, n), np.uint64)
    b = np.zeros((n, width), np.uint64)
    real = np.zeros((rows, n), bool)
    for i, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[: len(x), i], real[: len(x), i], b[i, : len(y)] = x, True, y
    filled = np.arange(width) < np.array([len(y) for y in texts])[:, None]
    slope = np.arange(width, dtype=np.int32) * GAP
    last = np.zeros((n, width), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(rows):
        score = np.where((b == a[i][:, None]) & filled, MATCH, MISMATCH).astype(np.int32)
        score[:, 1:] += last[:, :-1]
        now = np.maximum(np.maximum(score, last - GAP), 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope  # gaps along the text
        now[~real[i]] = 0
        top = now.argmax(axis=1)
        value = now[np.arange(n), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top, end)
        last = now
    return best, end


def align(block: Block, seeds: Slice, table: np.ndarray, least: float = LEAST_SCORE, cells: int = 1 << 20) -> list[np.ndarray]:
    """document, item, score, seeds hit and last word of each document and item that share a seed: the best region of each.

    Regions and the joining of diagonals reach as far as the gaps of an
    alignment that still scores ``least``, so none of its parts stand alone.
    """
    words, doc = word_hashes(block.data, block.off)
    at, gram = seeds.hits(words, doc, table)
    if not len(at):
        return [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] + [np.zeros(0, np.int64)] * 2
    item, own = seeds.item[gram], doc[at]
    length = np.array([len(w) for w in seeds.words])
    slack = np.maximum(length[item] // 4 + 3, np.ceil(MATCH * length[item] * (1 - least) / GAP).astype(np.int64))
    diagonal = at - seeds.place[gram]
    order = np.lexsort((diagonal, item, own))
    own, item, diagonal, slack = own[order], item[order], diagonal[order], slack[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(own)])) - 1
    bounds = np.searchsorted(doc, np.arange(len(block.off)))
    low = np.maximum(diagonal[first] - slack[first], bounds[own[first]])
    high = np.minimum(diagonal[last] + length[item[first]] + slack[first], bounds[own[first] + 1])
    hits = last - first + 1
    # a passing alignment lies within its item's length and slack, so pieces that overlap by both lose none
    overlap = length[item[first]] + slack[first]
    pieces = np.maximum(-(-(high - low - overlap) // PIECE_WORDS), 1)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first, hits, overlap, top = (np.repeat(x, pieces) for x in (first, hits, overlap, high))
    low = np.repeat(low, pieces) + nth * PIECE_WORDS
    high = np.minimum(low + PIECE_WORDS + overlap, top)
    score, end = np.zeros(len(first)), np.zeros(len(first), np.int64)
    by = np.lexsort((high - low, length[item[first]]))
    k = 0
    while k < len(by):
        j, width = k, 0
        while j < len(by) and (j == k or max(width, high[by[j]] - low[by[j]]) * (j - k + 1) <= cells):
            width = max(width, high[by[j]] - low[by[j]])
            j += 1
        part = by[k:j]
        value, stop = smith_waterman([seeds.words[item[first[r]]] for r in part], [words[low[r] : high[r]] for r in part])
        score[part] = value / (MATCH * length[item[first[part]]])
        end[part] = low[part] + stop - bounds[own[first[part]]]
        k = j
    order = np.lexsort((end, -score, item[first], own[first]))
    d, i = own[first][order], item[first][order]
    best = order[np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1])))]
    return [own[first][best], item[first][best], score[best], hits[best], end[best]]


def slices(benchmark: DataFrame, id_col: str, text_col: str, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The benchmark in slices of bounded size, read row by row; the driver holds one slice."""
    rows = benchmark.select(id_col, text_col)
    kind = rows.limit(0).toArrow().schema.field(0).type
    ids, texts, size = [], [], 0
    for row in rows.where(F.col(text_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1].encode())
        if size >= most:
            yield Slice.of(pa.array(ids, kind), texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Slice.of(pa.array(ids, kind), texts)


def choose_seeds(docs: DataFrame, part: Slice, text_col: str, least: float) -> Slice:
    """Seeds by the number of documents, over all of them, that hold each n-gram."""
    sent = docs.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        table, total = own.lookup(), np.zeros(len(own.hash), np.int64)
        for block in blocks(batches, None, text_col):
            words, doc = word_hashes(block.data, block.off)
            at, gram = own.hits(words, doc, table)
            pair = np.unique(gram * np.int64(len(block.off)) + doc[at])
            total += np.bincount(pair // len(block.off), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    found = docs.select(text_col).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(part.hash), np.int64)
    df[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return part.rarest(df, least)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST_SCORE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, item_id, score (1: every word of the item aligned), n_seeds, end_word of each document and item that reach ``least``."""
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"doc_id {kind}, item_id {item_kind}, score double, n_seeds bigint, end_word bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for part in slices(benchmark, item_col, item_text, slice_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(choose_seeds(docs, part, text_col, least))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seeds = sent.value
            table = seeds.lookup()
            for block in blocks(batches, None, text_col):
                doc, item, score, hits, end = align(block, seeds, table, least)
                keep = score >= least
                ids = block.batch.column(0).take(pa.array(doc[keep] + block.rows.start))
                yield pa.RecordBatch.from_arrays([ids, seeds.ids.take(pa.array(item[keep])), pa.array(score[keep]), pa.array(hits[keep]), pa.array(end[keep])], ["doc_id", "item_id", "score", "n_seeds", "end_word"])

        out = out.unionByName(docs.select(id_col, text_col).mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST_SCORE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs without those in which some item's alignment reaches ``least``; rows keep their partitions, nothing is shuffled.

    Seeds of every slice are counted over all of docs, as find_contamination
    counts them, so the same documents go at any size of slice.
    """
    left = docs
    for part in slices(benchmark, item_col, item_text, slice_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(choose_seeds(docs, part, text_col, least))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seeds = sent.value
            table = seeds.lookup()
            for block in blocks(batches, None, text_col):
                doc, _, score, _, _ = align(block, seeds, table, least)
                keep = np.ones(len(block.off) - 1, bool)
                keep[doc[score >= least]] = False
                yield block.batch.slice(block.rows.start, len(keep)).filter(pa.array(keep))

        left = left.mapInArrow(run, docs.schema)
    return left
