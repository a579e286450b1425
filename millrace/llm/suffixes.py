"""Suffix-array deduplication: bytes covered by a string of fixed length that also starts earlier.

Suffixes are compared to that length only, and sorted bucket by bucket:

* Every suffix start belongs to the bucket of its anchor, the least-hashed
  piece of half the length inside the string; equal strings have equal anchors
  at equal distances, so they meet in one bucket wherever they stand.
* Anchors are counted first (hashes only). Strings whose anchor occurs once
  are unique; only suffixes of repeated anchors are sent, with the bytes around
  the anchor, and equal surroundings within a block of documents go once.
* A task sorts one group of buckets at a time. Long ties are resolved by ranks
  that are computed beforehand for the positions of a difference cover only:
  two cover ranks stand for all but the first and last few bytes of a string,
  which bounds the memory of a bucket.
* A bucket of more than HOT_ROWS entries is split: its different surroundings
  are dealt string by string, by two hashes of the whole string (128 bits), so
  that only equal strings meet, at most one from each slice of a block.

Rows: null text counts as empty; texts are read whole, as UTF-8 bytes; ties of
equal strings go to the least (doc_id, start). Rows without an id are left
out; rows that repeat an id must be equal and count once. Extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.blocks import _CHUNK, EXACT, blocks, mix, pack, pack_sorted, powers, string_buffers, unpack, unpack_sorted
from millrace.llm.jaccard import _slices, shard_of
from millrace.llm.shared import partitions

FLUSH = 500_000
#: Bytes of text that anchors are sought in at a time, and rows whose surroundings are hashed at a time.
PIECE_BYTES, HASH_ROWS, AROUND_ROWS = 1 << 20, 4096, 100_000
#: A perfect difference cover: every distance modulo 13 is a difference of two of these.
COVER_MODULUS, COVER = 13, (0, 1, 3, 9)
#: Bytes that one cover rank stands for.
RANKED = 64
#: Rows of a group of buckets that are sorted at a time.
GROUP_ROWS = 20_000
#: Entries of a bucket beyond which its strings are dealt one by one, and rows that this is done for at a time.
HOT_ROWS, STRING_ROWS = 100_000, 10_000
#: Odd weights of the columns of a row in two hashes.
WEIGHTS = np.random.RandomState(20240301).randint(0, 1 << 62, (2, 512)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at each position."""
    n = len(data) - k + 1
    out = np.empty(max(n, 0), np.uint64)
    up, down = powers()
    for a in range(0, n, _CHUNK):
        b = min(n, a + _CHUNK)
        piece = data[a : b + k - 1]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(EXACT[piece] * up[: len(piece)], out=total[1:])
        out[a:b] = (total[k:] - total[:-k]) * down[: b - a]
    return mix(out)


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Hash, position, first and last string start of every anchor. data: under 2**24 bytes."""
    k = length // 2
    width = length - k + 1
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    h = rolling(data, k)
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    step = np.zeros(len(data) + 2, np.int32)
    stop = np.maximum(off[1:] - length + 1, off[:-1])
    np.add.at(step, off[:-1], 1)
    np.add.at(step, stop, -1)
    start = np.flatnonzero(np.cumsum(step)[:n] > 0)
    at = (low[start] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    last = np.concatenate((new[1:], [len(at)])) - 1 if len(at) else new
    # an anchor's hash is small, being the least of many; mixed again it deals evenly
    return mix(h[at[new]]), at[new], start[new], start[last]


def all_anchors(data: np.ndarray, off: np.ndarray, length: int, most: int = 8 << 20) -> tuple[np.ndarray, ...]:
    """anchors() for blocks of any size; a longer document is taken in overlapping pieces of string starts."""
    if len(data) < 1 << 24:
        return anchors(data, off, length)
    parts = []
    for i in range(len(off) - 1):
        for a in range(int(off[i]), max(int(off[i]) + 1, int(off[i + 1]) - length + 1), most):
            b = min(int(off[i + 1]), a + most + length - 1)
            h, p, lo, hi = anchors(data[a:b], np.array([0, b - a]), length)
            parts.append((h, p + a, lo + a, hi + a))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def cover_ranks(text: np.ndarray, bucket: np.ndarray) -> dict[int, np.ndarray]:
    """Ranks, within its bucket, of the RANKED bytes of each row at every column of the cover."""
    wide = text.shape[1]
    out = {}
    for c in range(wide - RANKED + 1):
        if c % COVER_MODULUS in COVER:
            words = np.ascontiguousarray(text[:, c : c + RANKED]).view(">u8")
            order = np.lexsort((*words.T[::-1], bucket))
            new = np.ones(len(order), bool)
            w, b = words[order], bucket[order]
            new[1:] = (w[1:] != w[:-1]).any(axis=1) | (b[1:] != b[:-1])
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(new) - 1
            out[c] = rank
    return out


def _word(text: np.ndarray, a: int, b: int) -> list[np.ndarray]:
    """Bytes a to b of each row as big-endian integers."""
    out = []
    for c in range(a, b, 8):
        wide = np.zeros((len(text), 8), np.uint8)
        wide[:, : min(b, c + 8) - c] = text[:, c : min(b, c + 8)]
        out.append(wide.view(">u8")[:, 0].astype(np.uint64))
    return out


def repeated_starts(text: np.ndarray, bucket: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """rows x columns: string starts that an earlier row of the bucket holds too.

    Rows are in order of occurrence; the anchor stands at column ``length -
    length // 2`` and starts left..right of each row are its own.
    """
    anchor = length - length // 2
    out = np.zeros((len(text), anchor + 1), bool)
    ranks = cover_ranks(text, bucket)
    for s in range(anchor + 1):
        rows = np.flatnonzero((left <= s) & (right >= s))
        if len(rows) < 2:
            continue
        first = min(c for c in ranks if c >= s)
        last = max(c for c in ranks if c <= s + length - RANKED)
        own = text[rows]
        keys = [*_word(own, last + RANKED, s + length), *_word(own, s, first), ranks[last][rows], ranks[first][rows], bucket[rows]]
        order = np.lexsort(keys)
        same = np.ones(len(order) - 1, bool)
        for key in keys:
            key = key[order]
            same &= key[1:] == key[:-1]
        out[rows[order[1:][same]], s] = True
    return out


def string_hashes(body: np.ndarray, length: int) -> list[np.ndarray]:
    """Two 64-bit hashes of the string at every column of each row; strings of one column are compared."""
    column = np.arange(body.shape[1] - length + 1, dtype=np.uint64) * EXACT[0]
    values = EXACT[body]
    out = []
    for weights in WEIGHTS:
        total = np.zeros((len(body), body.shape[1] + 1), np.uint64)
        np.cumsum(values * weights[: body.shape[1]], axis=1, out=total[:, 1:])
        out.append(mix(total[:, length:] - total[:, : body.shape[1] - length + 1] + column))
    return out


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], [n for n, _ in schema])


_FIELDS = [("key", pa.int32()), *[(c, pa.binary()) for c in ("ids", "doc", "pos", "lo", "hi", "hash", "text")], ("hot", pa.bool_())]
_SENT = "key int, ids binary, doc binary, pos binary, lo binary, hi binary, hash binary, text binary, hot boolean"


def _block_of(ids: np.ndarray, n: int) -> np.ndarray:
    return np.array(mix(ids.astype(np.uint64)) % np.uint64(n), np.int64)


def _rows(key: np.ndarray, n: int, ids: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, h: np.ndarray, text: np.ndarray | None = None, hot: bool = False) -> list[tuple]:
    """One packed row for each key; entries are sorted by key, and by hash or (ids, pos) within it."""
    cut, out = _slices(key, n), []
    for k in range(n):
        a, b = cut[k], cut[k + 1]
        if a < b:
            near, d = np.unique(ids[a:b], return_inverse=True)
            body = zstandard.ZstdCompressor(level=3).compress(text[a:b].tobytes()) if text is not None else b""
            out.append((k, pack(np.diff(near, prepend=0)), pack(d.astype(np.uint32)), pack(pos[a:b]), pack(lo[a:b].astype(np.uint8)), pack(hi[a:b].astype(np.uint8)), pack_sorted(h[a:b]) if len(h) else b"", body, hot))
    return out


def _entries(rows: pa.Table) -> tuple[np.ndarray, ...]:
    got = [
        (np.cumsum(unpack(r["ids"], np.int64))[unpack(r["doc"], np.uint32)], unpack(r["pos"], np.int64), unpack(r["lo"], np.uint8).astype(np.int64), unpack(r["hi"], np.uint8).astype(np.int64), unpack_sorted(r["hash"]) if r["hash"] else np.zeros(0, np.uint64))
        for r in rows.to_pylist()
    ]
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64))


def repeated_bytes(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, removed array<struct<start, end>> (maximal runs, end exclusive), kept (the other bytes).

    ``hot_rows`` changes how much a task holds, not the result.
    """
    if length < RANKED + COVER_MODULUS or length > 255:
        raise ValueError(f"length must lie between {RANKED + COVER_MODULUS} and 255")
    n = partitions(docs.sparkSession)
    half = length // 2
    anchor, wide = length - half, 2 * length - half
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")

    def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            ids, pos, lo, hi, h = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h, kind="stable")
            h = h[order]
            return _table(_rows(shard_of(h, n), n, ids[order], pos[order], lo[order], hi[order], h), _FIELDS)

        for b in blocks(batches, limit=PIECE_BYTES):
            h, p, lo, hi = all_anchors(b.data, b.off, length)
            d = np.searchsorted(b.off, p, "right") - 1
            held.append((b.ids[d].astype(np.int64), p - b.off[d], p - lo, hi - lo, h))
            size += len(h)
            if size >= FLUSH:
                yield flush()
                size = 0
        if size:
            yield flush()

    def answer(rows: pa.Table) -> pa.Table:
        """Anchors that occur more than once, back to the blocks of their documents."""
        ids, pos, lo, hi, h = _entries(rows)
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1]))) if len(h) else np.zeros(0, int)
        size = np.diff(np.concatenate((first, [len(h)])))
        keep = order[np.repeat(size > 1, size)]
        # a row that repeats an id brings every entry again: equal ones count once
        keep = keep[np.lexsort((hi[keep], lo[keep], pos[keep], ids[keep], h[keep]))]
        same = np.zeros(len(keep), bool)
        if len(keep):
            same[1:] = np.logical_and.reduce([x[keep[1:]] == x[keep[:-1]] for x in (h, ids, pos, lo, hi)])
        keep = keep[~same]
        _, bucket, size = np.unique(h[keep], return_inverse=True, return_counts=True)
        size = size[bucket]
        keep, size = keep[size > 1], size[size > 1]
        order = np.lexsort((pos[keep], ids[keep], _block_of(ids[keep], n)))
        keep, size = keep[order], size[order]
        out: list[tuple] = []
        for hot, at in ((False, keep[size <= hot_rows]), (True, keep[size > hot_rows])):
            out += _rows(_block_of(ids[at], n), n, ids[at], pos[at], lo[at], hi[at], h[:0], hot=hot)
        return pa.Table.from_batches([_table(out, _FIELDS)])

    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts for the blocks of their documents, compressed before they are shuffled."""
        for batch in batches:
            ids = np.asarray(batch.column(0))
            off, data = string_buffers(batch.column(1))
            block = _block_of(ids, n)
            order = np.argsort(block, kind="stable")
            cut, rows = _slices(block[order], n), []
            for k in range(n):
                at = order[cut[k] : cut[k + 1]]
                if len(at):
                    body = zstandard.ZstdCompressor(level=3).compress(b"".join(data[off[i] : off[i + 1]].tobytes() for i in at))
                    rows.append((k, pack(ids[at].astype(np.int64)), pack((off[at + 1] - off[at]).astype(np.int64)), body))
            yield _table(rows, [("key", pa.int32()), ("ids", pa.binary()), ("size", pa.binary()), ("body", pa.binary())])

    def texts(rows: pa.Table) -> dict[int, np.ndarray]:
        out = {}
        for r in rows.to_pylist():
            data, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["body"]), np.uint8) if r["body"] else np.zeros(0, np.uint8), 0
            for i, size in zip(unpack(r["ids"], np.int64).tolist(), unpack(r["size"], np.int64).tolist(), strict=True):
                out[i] = data[at : at + size]
                at += size
        return out

    def surroundings(left: pa.Table, right: pa.Table) -> pa.Table:
        """The bytes around each repeated anchor, to its bucket. Equal ones go once; the later are repeats whatever else there is."""
        cold, hot = (_entries(right.filter(f)) for f in (pc.invert(right["hot"]), right["hot"]))
        ids, pos, lo, hi = (np.concatenate(x) for x in zip(cold[:4], hot[:4], strict=True))
        many = np.arange(len(ids)) >= len(cold[0])
        order = np.lexsort((pos, ids))
        ids, pos, lo, hi, many = ids[order], pos[order], lo[order], hi[order], many[order]
        own = texts(left)
        out: list[tuple] = []
        for a in range(0, len(ids), AROUND_ROWS):
            i, p, q, r = ids[a : a + AROUND_ROWS], pos[a : a + AROUND_ROWS], lo[a : a + AROUND_ROWS], hi[a : a + AROUND_ROWS]
            body = np.zeros((len(i), wide), np.uint8)
            edge = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1], [True])))
            for b, e in zip(edge[:-1], edge[1:], strict=True):
                data = np.concatenate((np.zeros(anchor, np.uint8), own[int(i[b])], np.zeros(length, np.uint8)))
                body[b:e] = np.lib.stride_tricks.sliding_window_view(data, wide)[p[b:e]]
            h = mix(mix(hash_rows(body[:, anchor : anchor + half])))
            every = np.concatenate((body, q.astype(np.uint8)[:, None], r.astype(np.uint8)[:, None]), axis=1)
            whole = hash_rows(every)
            order = np.lexsort((p, i, whole, h))
            same = np.zeros(len(order), bool)
            same[1:] = (every[order[1:]] == every[order[:-1]]).all(axis=1)
            key = shard_of(h[order], n)
            split = many[a : a + AROUND_ROWS][order]
            # order is by hash, and by (document, position) among equals
            kept = ~same & ~split
            at = order[kept]
            out += _rows(key[kept], n, i[at], p[at], q[at], r[at], h[at], body[at])
            at = order[same]
            out += _rows(key[same], n, i[at], p[at], q[at], r[at], h[:0])
            at = order[~same & split]
            for b in range(0, len(at), STRING_ROWS):
                x = at[b : b + STRING_ROWS]
                out += strings(i[x], p[x], q[x], r[x], body[x])
        return pa.Table.from_batches([_table(out, _FIELDS)])

    def strings(i: np.ndarray, p: np.ndarray, q: np.ndarray, r: np.ndarray, body: np.ndarray) -> list[tuple]:
        """Every string of these rows under its own hash; of equal ones the first, the others as repeats."""
        left = (anchor - q)[:, None]
        column = np.arange(anchor + 1)
        row, s = np.nonzero((column >= left) & (column <= left + r[:, None]))
        h, h2 = (x[row, s] for x in string_hashes(body, length))
        i, start = i[row], p[row] - anchor + s
        order = np.lexsort((start, i, h2, h))
        i, start, h, h2 = i[order], start[order], h[order], h2[order]
        same = np.zeros(len(order), bool)
        same[1:] = (h[1:] == h[:-1]) & (h2[1:] == h2[:-1])
        key, none = shard_of(h, n), np.zeros(len(order), np.int64)
        out = _rows(key[~same], n, i[~same], start[~same], none[~same], none[~same], h[~same], h2[~same], hot=True)
        return out + _rows(key[same], n, i[same], start[same], none[same], none[same], h[:0])

    def sort_buckets(rows: pa.Table) -> pa.Table:
        """String starts that repeat an earlier string, back to the blocks of their documents."""
        own, done, alone = [], [], []
        for r in rows.to_pylist():
            ids, pos, lo, hi, h = _entries(pa.Table.from_pylist([r], rows.schema))
            if r["hot"]:
                alone.append((ids, pos, h, np.frombuffer(zstandard.ZstdDecompressor().decompress(r["text"]), np.uint64)))
            elif r["text"]:
                own.append((ids, pos, lo, hi, h, np.frombuffer(zstandard.ZstdDecompressor().decompress(r["text"]), np.uint8).reshape(-1, wide)))
            else:
                done.append((ids, pos - lo, hi))
        if alone:
            ids, start, h, h2 = (np.concatenate(x) for x in zip(*alone, strict=True))
            del alone
            order = np.lexsort((start, ids, h2, h))
            again = order[1:][(h[order[1:]] == h[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])]
            done.append((ids[again], start[again], np.zeros(len(again), np.int64)))
        if own:
            ids, pos, lo, hi, h, text = (np.concatenate(x) for x in zip(*own, strict=True))
            del own
            order = np.lexsort((pos, ids, h))
            bucket = np.cumsum(np.concatenate(([True], h[order][1:] != h[order][:-1])))
            size = np.bincount(bucket)[bucket]
            order, bucket = order[size > 1], bucket[size > 1]
            a = 0
            while a < len(order):  # one group of buckets at a time; a bucket is never cut
                b = len(order) if a + GROUP_ROWS >= len(order) else int(np.searchsorted(bucket, bucket[a + GROUP_ROWS], "left"))
                if b <= a:
                    b = int(np.searchsorted(bucket, bucket[a], "right"))
                at = order[a:b]
                left = anchor - lo[at]
                hit = repeated_starts(text[at], bucket[a:b], left, left + hi[at], length)
                step = np.diff(hit.astype(np.int8), axis=1, prepend=0, append=0)
                row, first = np.nonzero(step == 1)
                _, stop = np.nonzero(step == -1)
                done.append((ids[at][row], pos[at][row] - anchor + first, stop - 1 - first))
                a = b
        ids, start, more = (np.concatenate(x) for x in zip(*done, strict=True)) if done else [np.zeros(0, np.int64)] * 3
        order = np.lexsort((start, ids, _block_of(ids, n)))
        ids, start, more = ids[order], start[order], more[order]
        return pa.Table.from_batches([_table(_rows(_block_of(ids, n), n, ids, start, more, more, np.zeros(0, np.uint64)), _FIELDS)])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, start, more, _, _ = _entries(right)
        end = start + more + length
        order = np.lexsort((end, start, ids))
        ids, start, end = ids[order], start[order], end[order]
        names, sizes, runs, kept = [], [], [], []
        own = texts(left)
        for i in sorted(own):
            data = own[i]
            a, b = np.searchsorted(ids, i), np.searchsorted(ids, i, "right")
            gone = np.zeros(len(data) + 1, np.int32)
            np.add.at(gone, start[a:b], 1)
            np.add.at(gone, end[a:b], -1)
            covered = np.cumsum(gone[:-1]) > 0
            edge = np.flatnonzero(np.diff(covered, prepend=False, append=False))
            names.append(i)
            sizes.append(len(data))
            runs.append([{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
            kept.append(data[~covered].tobytes())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    packed = docs.mapInArrow(pack_texts, "key int, ids binary, size binary, body binary")
    counted = docs.mapInArrow(count_anchors, _SENT).groupBy("key").applyInArrow(answer, _SENT)
    around = packed.groupBy("key").cogroup(counted.groupBy("key")).applyInArrow(surroundings, _SENT)
    found = around.groupBy("key").applyInArrow(sort_buckets, _SENT)
    return packed.groupBy("key").cogroup(found.groupBy("key")).applyInArrow(cut, "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")


def hash_rows(body: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    up, _ = powers()
    parts = [(EXACT[body[a : a + HASH_ROWS]] * up[: body.shape[1]]).sum(axis=1, dtype=np.uint64) for a in range(0, len(body), HASH_ROWS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)
