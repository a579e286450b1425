"""Vectorised helpers over the UTF-8 buffers of Arrow string columns.

A block is a run of whole documents whose bytes lie in one numpy array. All
functions here work on a bounded block inside one task; moving rows between
tasks is left to Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

BLOCK_BYTES = 4 << 20
#: Spans longer than this are hashed one at a time.
LONG_SPAN = 64 << 10
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 3
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)

WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words [^\x20\x09-\x0D]+.
WORD_BYTES = ~WHITE_SPACE
#: Letters and digits; every byte of a non-ASCII character counts as a letter.
ALNUM_BYTES = np.array([chr(c).isalnum() or c >= 0x80 for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_VALUES = np.random.RandomState(20240229).randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: A 64-bit value for each byte, alike for A-Z and a-z.
FOLDED = _VALUES[LOWER]
EXACT = _VALUES


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, long enough for one chunk and a long span."""
    if not _TABLES:
        n = _CHUNK + LONG_SPAN + 2
        _TABLES.extend((_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)))
    return _TABLES[0], _TABLES[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Block:
    """Whole documents: ids, their bytes end to end, and n + 1 offsets. rows: their places in the batch."""

    ids: np.ndarray
    data: np.ndarray
    off: np.ndarray
    rows: slice
    batch: pa.RecordBatch

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def string_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without copying; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    if array.type not in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        array = array.cast(pa.string())
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    width = np.int32 if array.type in (pa.string(), pa.binary()) else np.int64
    _, offsets, values = array.buffers()
    if offsets is None or len(array) == 0:
        return np.zeros(len(array) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, width)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def blocks(batches: Iterable[pa.RecordBatch], id_col: str | None = "doc_id", text_col: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of at most ``limit`` bytes; a longer document is a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(batch.schema.get_field_index(id_col)) if id_col else pa.nulls(batch.num_rows, pa.int8())
        ids = np.asarray(ids.fill_null(-1) if ids.null_count and id_col else ids)
        off, data = string_buffers(batch.column(batch.schema.get_field_index(text_col)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield Block(ids[i:j], data[off[i] : off[j]], off[i : j + 1] - off[i], slice(i, j), batch)
            i = j


def spans(data: np.ndarray, off: np.ndarray, members: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes; none crosses a document's end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = members[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[:-1][off[:-1] < n]
    first[edge] |= inside[edge]
    edge = off[1:][off[1:] > 0] - 1
    last[edge] |= inside[edge]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def owner(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The document in which each byte position lies."""
    return np.searchsorted(off, at, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of each span's bytes, alike wherever the span stands."""
    out = np.empty(len(starts), np.uint64)
    length = ends - starts
    long = np.flatnonzero(length > LONG_SPAN)
    keep = np.flatnonzero(length <= LONG_SPAN) if len(long) else None
    s, e = (starts[keep], ends[keep]) if len(long) else (starts, ends)
    got = out if keep is None else np.empty(len(s), np.uint64)
    up, down = powers()
    k, n = 0, len(s)
    while k < n:
        a = s[k]
        j = int(np.searchsorted(s, a + _CHUNK, "left"))
        piece = data[a : e[j - 1]]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * up[: len(piece)], out=total[1:])
        at = s[k:j] - a
        got[k:j] = (total[e[k:j] - a] - total[at]) * down[at]
        k = j
    got += (e - s).astype(np.uint64) * MULTIPLIER
    got[:] = mix(got)
    if keep is not None:
        out[keep] = got
        folded = values is FOLDED
        for i in long:
            piece = data[starts[i] : ends[i]]
            out[i] = np.frombuffer(hashlib.blake2b((LOWER[piece] if folded else piece).tobytes(), digest_size=8).digest(), np.uint64)[0]
    return out


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n words that follow one another; the caller drops those across documents."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h *= MULTIPLIER
        h += words[k : len(words) - n + 1 + k]
    return mix(h)


def pack(a: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.zeros((1, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype) if len(raw) else np.zeros(0, dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """A sorted unsigned array as differences."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(data: bytes, dtype: type = np.uint64) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)
