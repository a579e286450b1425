"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

For each pre-token the tree's leaves hold ``rank * width + position`` of the
pair that starts there, and each inner node the smaller of its children. The
root is thus the leftmost lowest-rank merge; a merge changes at most three
leaves, each a logarithmic update. Pre-tokens of like width are stacked and
their trees advance together in numpy; wide ones take a scalar tree.

Rows: null text counts as empty and gives no tokens; extra columns pass
through unread; an empty table gives an empty result; equal rows give equal
results. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pre-token pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int64).max
#: Marks that end a word and are pre-tokens of their own.
ENDS = frozenset(".,;:!?")
#: Pre-tokens over this many bytes take the scalar tree.
WIDE = 256
#: The mark of an empty leaf in a stacked tree, and the cells in one stack.
FULL = np.iinfo(np.int32).max
STACK = 1 << 15
#: Most pre-tokens kept between batches in one worker, and the most characters of each: together they bound the bytes.
CACHE, KEPT = 500_000, 64


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and tokens of a byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        own, model, symbols = spec.get("pre_tokenizer") or {}, spec["model"], byte_symbols()
        if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or own.get("type") != "ByteLevel" or own.get("add_prefix_space") or not own.get("use_regex", True):
            raise ValueError("only byte-level BPE files without a normalizer or a prefix space are encoded")
        if any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word")) or any(model.get(flag) for flag in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("dropout, affixes and stripping added tokens are not supported")
        ids: dict[str, int] = model["vocab"]
        back = {c: b for b, c in symbols.items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = {text: np.array([i], "<u4").tobytes() for text, i in added.items()}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.bytes: list[bytes] = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in added.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.array([ids[symbols[b]] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = len(self.bytes)
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.pattern = regex.compile(PATTERN)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, NONE if it doesn't merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    # One wide pre-token ------------------------------------------------------

    def encode_wide(self, piece: bytes) -> list[int]:
        """The scalar segment tree."""
        n = len(piece)
        sym = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        width = 1 << max(1, (n - 1).bit_length())
        get, size = self.rank_of.get, self.size
        tree = [NONE] * (2 * width)
        for i in range(n - 1):
            if (r := get(sym[i] * size + sym[i + 1])) is not None:
                tree[width + i] = r * width + i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = [*range(1, n + 1)], [*range(-1, n)]

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def leaf(i: int, j: int) -> int:
            r = get(sym[i] * size + sym[j]) if j < n else None
            return NONE if r is None else r * width + i

        while (root := tree[1]) != NONE:
            rank, i = divmod(root, width)
            j = after[i]
            sym[i] = int(self.merged[rank])
            k = after[i] = after[j]
            before[k] = i
            put(j, NONE)
            put(i, leaf(i, k))
            if (p := before[i]) >= 0:
                put(p, leaf(p, i))
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = after[i]
        return out

    # Many pre-tokens of one width ----------------------------------------------

    def encode_stack(self, raw: bytes, length: np.ndarray) -> list[bytes]:
        """Trees of pre-tokens whose widths round up to one power of two; raw: their bytes end to end."""
        count = len(length)
        width = 1 << max(1, int(length.max() - 1).bit_length())
        cells = np.arange(width, dtype=np.int32)
        used = cells < length[:, None]
        sym = np.full((count, width + 1), -1, np.int32)
        sym[:, :width][used] = self.of_byte[np.frombuffer(raw, np.uint8)]
        paired = cells[:-1] + 1 < length[:, None]
        tree = np.full((count, 2 * width), FULL, np.int32)
        rank = self.rank(sym[:, : width - 1][paired], sym[:, 1:width][paired])
        at = np.broadcast_to(cells[:-1], paired.shape)[paired]
        tree[:, width : 2 * width - 1][paired] = np.where(rank == NONE, FULL, rank * width + at)
        k = width
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (count, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int32), (count, 1))
        alive = used
        row = np.flatnonzero(tree[:, 1] != FULL)
        while len(row):
            rank, i = np.divmod(tree[row, 1], width)
            j = after[row, i]
            k = after[row, j]
            merged = self.merged[rank]
            sym[row, i] = merged
            after[row, i] = k
            before[row, k] = i  # the cell past the end is never read
            alive[row, j] = False
            tree[row, width + j] = FULL
            got = self.rank(merged, np.where(k < length[row], sym[row, k], -1))
            tree[row, width + i] = np.where(got == NONE, FULL, got * width + i)
            p = before[row, i]
            left = np.flatnonzero(p >= 0)
            r, q = row[left], p[left]
            got = self.rank(sym[r, q], merged[left])
            tree[r, width + q] = np.where(got == NONE, FULL, got * width + q)
            for who, leaf in ((row, j), (row, i), (r, q)):
                node = (width + leaf) >> 1
                while node.size and node[0] >= 1:
                    tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
                    node = node >> 1
            row = row[tree[row, 1] != FULL]
        out = sym[:, :width][alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive.sum(axis=1)) * 4).tolist()
        return [out[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Little-endian ids of each pre-token."""
        texts = list(pieces)
        raw = [t.encode() for t in texts]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        out: dict[str, bytes] = {}
        for i in np.flatnonzero(length > WIDE).tolist():
            out[texts[i]] = np.array(self.encode_wide(raw[i]), "<u4").tobytes()
        low = 0
        for high in (1, 2, *(1 << k for k in range(2, WIDE.bit_length()))):
            members = np.flatnonzero((length > low) & (length <= high)).tolist()
            low = high
            most = max(1, STACK // high)
            for k in range(0, len(members), most):
                part = members[k : k + most]
                out.update(zip([texts[i] for i in part], self.encode_stack(b"".join([raw[i] for i in part]), length[part]), strict=True))
        return out

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of a text, in order."""
        if self.split and any(s in text for s in self.special):
            return [p for part in self.split.split(text) if part for p in ([part] if part in self.special else self.pattern.findall(part))]
        return self.pattern.findall(text)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


class Encoder:
    """A vocabulary and bounded caches.

    A single space between two characters that aren't white space always opens
    a pre-token, so texts are first cut there, and a chunk (the space and what
    follows it) is looked up whole. A text in which some space stands beside
    other white space is cut by the pattern alone.
    """

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        self.vocabulary, self.most = vocabulary, cache
        self.pieces: dict[str, bytes] = dict(vocabulary.special)
        self.chunks: dict[str, bytes | None] = {}
        self.again: set[str] = set()
        self.wide: list[str] = []

    def _forget_wide(self) -> None:
        """Pre-tokens and chunks that are too wide to keep go at a batch's end."""
        for w in self.wide:
            self.pieces.pop(w, None)
            self.chunks.pop(w, None)
        self.wide = []

    def _learn(self, need: set[str]) -> None:
        new = need.difference(self.pieces)
        if len(self.pieces) + len(new) > self.most:
            self.pieces = {k: self.pieces[k] for k in need - new} | self.vocabulary.special
        self.pieces |= self.vocabulary.encode_pieces(new)
        self.wide += [w for w in new if len(w) > KEPT]

    def _by_pieces(self, split: list[list[str]]) -> list[bytes]:
        self._learn(set().union(*split))
        get = self.pieces.__getitem__
        return [b"".join(map(get, p)) for p in split]

    def _chunks(self, words: set[str]) -> None:
        """Encode the chunks of these words; None marks those that stand beside white space."""
        old = words.intersection(self.chunks)
        self.again |= old
        words -= old
        if len(self.chunks) + len(words) > self.most:
            keep = self.again if len(self.again) < self.most // 2 else old
            self.chunks, self.again = {k: self.chunks[k] for k in keep}, set()
        self.wide += [w for w in words if len(w) > KEPT]
        plain = [w for w in words if w.isalpha()]
        ended = [w for w in words if w[-1:] in ENDS and w[:-1].isalpha()]
        rest = words.difference(plain, ended)
        cut = [w for w in rest if w and not w[0].isspace() and not w[-1].isspace()]
        self.chunks |= dict.fromkeys(rest)
        find = self.vocabulary.pattern.findall
        self.chunks |= zip(cut, self._by_pieces([find(" " + w) for w in cut]), strict=True)
        heads = [" " + w for w in plain] + [" " + w[:-1] for w in ended]
        self._learn({*heads, *ENDS})
        get = self.pieces.__getitem__
        self.chunks |= zip(plain, map(get, heads), strict=False)
        self.chunks |= zip(ended, [get(h) + get(w[-1]) for h, w in zip(heads[len(plain) :], ended, strict=True)], strict=True)

    def encode(self, texts: list[str]) -> list[bytes]:
        special = self.vocabulary.special
        out: list[bytes | None] = [None] * len(texts)
        split = [None if any(s in t for s in special) else t.split(" ") for t in texts]
        self._chunks(set().union(*[w[1:] for w in split if w]))
        find, get = self.vocabulary.pattern.findall, self.chunks.__getitem__
        whole, heads = [], []
        for i, words in enumerate(split):
            if words and (len(words) == 1 or words[0] and not words[0][-1].isspace()):
                try:
                    out[i] = b"".join(map(get, words[1:]))
                    heads.append(i)
                    continue
                except TypeError:
                    pass  # a chunk beside other white space
            whole.append(i)
        for i, head in zip(heads, self._by_pieces([find(split[i][0]) for i in heads]), strict=True):
            out[i] = head + out[i]
        for i in whole:
            out[i] = self._by_pieces([self.vocabulary.pieces(texts[i])])[0]
        self._forget_wide()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, digests: bool = False, batch_bytes: int = 1 << 20) -> DataFrame:
    """Each document's token ids, their count and the decoded text; ``digests`` gives their SHA-256 in place of both.

    ``vocabulary`` is the path of the file on every executor. The scan stays
    where it is: no shuffle, and a worker holds one batch and a bounded cache.
    """
    columns = f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else ("ids array<int>, " if keep_ids else "") + "decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < batch_bytes):
                    size += len(texts[j] or "")
                    j += 1
                coded = coder.encode([t or "" for t in texts[i:j]])
                arrays = [np.frombuffer(c, "<u4") for c in coded]
                decoded = [coder.vocabulary.decode(a) for a in arrays]
                out = [batch.column(0).slice(i, j - i), pa.array([len(a) for a in arrays], pa.int64())]
                if digests:
                    out += [pa.array([hashlib.sha256(c).hexdigest() for c in coded]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])]
                else:
                    out += ([pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32()))] if keep_ids else []) + [pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(out, [c.split(" ")[0] for c in columns.split(", ")])
                i = j

    return docs.select(id_col, text_col).mapInArrow(run, columns)
