"""Interpolated modified Kneser-Ney model of any order from 2: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

Counting: tasks add up the n-grams of bounded runs of text and send them packed
to shards; a frequent history is spread over SALT shards by the following
word. Each shard writes the sorted hashes and counts of its n-grams to the
shared folder and sends on partial sums: of the histories, and of the n-grams
without their first word, whose counts in the next lower order are the distinct
words before them (as they stand where a document begins). The last step is the
words. Only count-of-count totals reach the driver.

Scoring: a worker maps the arrays and looks up the distinct words and bigrams
of a block of documents in sorted order. Nothing is shuffled.

Rows: null text is the empty text, whose one token is the end; texts are read
whole; repeated rows count and are scored each; rows without an id don't
train; an empty table trains a uniform model and scores nothing. Extra columns
are not read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.blocks import MULTIPLIER, blocks, hash_spans, mix, owner, pack, pack_sorted, spans, unpack, unpack_sorted
from millrace.llm.jaccard import _slices, shard_of
from millrace.llm.shared import fresh_path, partitions

BEGIN, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
SALT = 16
FLUSH = 2_000_000
_SENT = "key int, kind int, words binary, a binary, b binary, c binary"
_FIELDS = [("key", pa.int32()), ("kind", pa.int32()), *[(x, pa.binary()) for x in ("words", "a", "b", "c")]]


def tokens(data: np.ndarray, off: np.ndarray, order: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-gram that ends in each token, as ``order`` arrays, and the first token of each document (n + 1). A document ends in one end token; before its first word stand begin marks."""
    start, end = spans(data, off)
    doc = owner(off, start)
    n = len(off) - 1
    count = np.bincount(doc, minlength=n) + 1
    first = np.concatenate(([0], np.cumsum(count)))
    word = np.full(first[-1], END, np.uint64)
    word[np.arange(len(start)) + doc] = hash_spans(data, start, end)
    grams = [word]
    for back in range(1, order):
        before = np.full_like(word, BEGIN)
        before[back:] = word[:-back]
        for k in range(back):
            before[first[:-1][count > k] + k] = BEGIN
        grams.insert(0, before)
    return grams, first


def sequence_hash(words: list[np.ndarray]) -> np.ndarray:
    """One hash of the words of a history; of one word it is the word's."""
    h = words[0]
    for w in words[1:]:
        h = pair_key(h, w)
    return h


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def pair_shard(h: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    """A history's bigrams lie in at most SALT shards, however frequent it is."""
    return (mix(h) + mix(w) % np.uint64(SALT)) % np.uint64(shards)


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * MULTIPLIER + w)


# Files in the shared folder ------------------------------------------------------


def _local(uri: str) -> str | None:
    part = urlparse(uri)
    return part.path if part.scheme in ("", "file") else None


def write_arrays(uri: str, *arrays: np.ndarray) -> None:
    """Arrays of one length, end to end; the file appears whole or not at all, and a task that runs again writes the same."""
    body = [np.array([len(arrays[0])], np.uint64), *arrays]
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            for a in body:
                f.write(np.ascontiguousarray(a).data)
        os.replace(own, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        for a in body:
            f.write(np.ascontiguousarray(a).data)
    store.move(own, path)


def map_arrays(uri: str, *types: type) -> list[np.ndarray]:
    """The arrays of a file, mapped; from a store that can't be mapped, by way of an unnamed local copy."""
    if (path := _local(uri)) is not None:
        raw = np.memmap(path, np.uint8, "r")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))
        with tempfile.TemporaryFile() as copy, store.open_input_stream(path) as f:
            while piece := f.read(1 << 22):
                copy.write(piece)
            copy.flush()
            raw = np.memmap(copy, np.uint8, "r")
    n, at, out = int(raw[:8].view(np.uint64)[0]), 8, []
    for t in types:
        size = n * np.dtype(t).itemsize
        out.append(raw[at : at + size].view(t))
        at += size
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key, -1 if there is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


# The model ----------------------------------------------------------------------


def _merged(names: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names, sorted, and the sums of their facts."""
    name, at = np.unique(np.concatenate(names), return_inverse=True)
    every = np.concatenate(sums, axis=1)
    total = np.zeros((len(every), len(name)), np.uint64)
    for row, x in zip(total, every, strict=True):
        np.add.at(row, at, x)
    return name, total


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ of Chen and Goodman from the numbers of types seen 1 to 4 times; where these give none between 0 and the count, half the count, so that nothing unseen has probability 0."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    out = [k - (k + 1) * y * more / now if now else 0.0 for k, now, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([d if 0 < d <= k else k / 2 for k, d in enumerate(out, 1)])


class KneserNey:
    """A trained model: its order, where its arrays lie, their shards, and its totals."""

    def __init__(self, uri: str, shards: int, order: int, totals: np.ndarray, files: frozenset[str] = frozenset()):
        self.uri, self.shards, self.order, self.files = uri, shards, order, files
        self.discounts = [discounts(totals[4 * k : 4 * k + 4]) for k in range(order)]  # by length of n-gram, words first
        rest = totals[4 * order :]
        self.types, self.tokens, self.vocabulary = rest[:3].tolist()
        self.lower = rest[3:6]  # words that follow 1, 2, 3 or more distinct histories

    @classmethod
    def train(cls, docs: DataFrame, text_col: str = "text", order: int = 2) -> KneserNey:
        if order < 2:
            raise ValueError("the order is 2 or more")
        spark = docs.sparkSession
        shards, uri = partitions(spark), fresh_path(spark, "kneser-ney")
        width = 4 * order + 6
        table = lambda rows: [pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(_FIELDS), _FIELDS, strict=True)]
        fields = [n for n, _ in _FIELDS]

        def packed(shard: int, columns: list[np.ndarray], *sums: np.ndarray) -> tuple:
            """n-grams sorted by their columns: names, and places among them."""
            names, at = np.unique(np.concatenate(columns), return_inverse=True)
            at, n = at.astype(np.uint32), len(columns[0])
            return shard, 0, pack_sorted(names), pack(np.diff(at[:n], prepend=np.uint32(0))), pack(at[n:]), pack(np.concatenate(sums))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def flush() -> pa.RecordBatch:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                held.clear()
                key = pair_shard(sequence_hash(columns[:-1]), columns[-1], shards)
                by = np.lexsort((*columns[::-1], key))
                columns, key = [c[by] for c in columns], key[by]
                new = _starts(columns)  # equal n-grams have one key
                c = np.diff(np.concatenate((new, [len(key)]))).astype(np.uint32)
                columns = [x[new] for x in columns]
                cut = _slices(key[new].astype(np.int64), shards)
                return pa.RecordBatch.from_arrays(table([packed(s, [x[a:b] for x in columns], c[a:b]) for s, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]), fields)

            for b in blocks(batches, None, text_col):
                grams, _ = tokens(b.data, b.off, order)
                held.append(grams)
                size += len(grams[0])
                if size >= FLUSH:
                    yield flush()
                    size = 0
            if size:
                yield flush()

        def level(k: int):
            """n-grams of k words: summed and written; what the next lower order needs goes on."""

            def run(key: tuple, rows: pa.Table) -> pa.Table:
                shard = key[0].as_py()
                grams, counts, raws, names, sums, totals, files = [], [], [], [], [], np.zeros(width, np.uint64), []
                for r in rows.to_pylist():
                    if r["kind"] == 0:
                        word = unpack_sorted(r["words"])
                        own = np.cumsum(unpack(r["a"], np.uint32), dtype=np.uint32)
                        others = unpack(r["b"], np.uint32).reshape(k - 1, -1)
                        grams.append([word[own], *(word[x] for x in others)])
                        c = unpack(r["c"], np.uint32 if k == order else np.uint64).astype(np.uint64).reshape(-1, len(own))
                        counts.append(c[0])
                        raws.append(c[-1])
                    elif r["kind"] == 1:
                        totals += unpack(r["a"], np.uint64)
                        files += r["words"].decode().split()
                    else:
                        names.append(unpack_sorted(r["words"]))
                        sums.append(unpack(r["a"], np.uint64).reshape(4, -1))
                out = []
                if names:  # histories of the order above, which come from several shards
                    name, total = _merged(names, sums)
                    files.append(f"contexts{k + 1}-{shard:06d}")
                    write_arrays(f"{uri}/{files[-1]}", name, total[3], *(x.astype(np.uint32) for x in total[:3]))
                if grams:
                    columns = [np.concatenate(x) for x in zip(*grams, strict=True)]
                    c = np.concatenate(counts)
                    raw = c if k == order else np.concatenate(raws)
                    del grams, counts, raws
                    by = np.lexsort(columns[::-1])
                    columns, c, raw = [x[by] for x in columns], c[by], raw[by]
                    new = _starts(columns)
                    columns, c, raw = [x[new] for x in columns], np.add.reduceat(c, new), np.add.reduceat(raw, new)
                    if k < order:  # nothing stands before a begin mark
                        c = np.where(columns[0] == BEGIN, raw, c)
                    history, w = sequence_hash(columns[:-1]), columns[-1]
                    keys = pair_key(history, w)
                    by = np.argsort(keys)
                    files.append(f"grams{k}-{shard:06d}")
                    write_arrays(f"{uri}/{files[-1]}", keys[by], np.minimum(c[by], 0xFFFFFFFF).astype(np.uint32))
                    totals[4 * k - 4 : 4 * k] += np.array([(c == x).sum() for x in (1, 2, 3, 4)], np.uint64)
                    place = np.concatenate((history, w)) if k == 2 else history  # a word is the history of its bigrams
                    name, at = np.unique(place, return_inverse=True)
                    before, size = at[: len(w)], len(name)
                    whole = lambda at, x: np.bincount(at, weights=x.astype(float), minlength=size).astype(np.uint64)
                    facts = [*(whole(before, pick) for pick in (c == 1, c == 2, c >= 3)), whole(before, c)]
                    if k == 2:
                        facts += [whole(at[len(w) :], np.ones(len(w))), whole(at[len(w) :], raw)]
                    cut = _slices(shard_of(name, shards), shards)
                    out += [(s, 0 if k == 2 else 2, pack_sorted(name[a:b]), pack(np.concatenate([x[a:b] for x in facts])), b"", b"") for s, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
                    if k > 2:
                        columns = columns[1:]
                        to = pair_shard(sequence_hash(columns[:-1]), w, shards)
                        by = np.lexsort((*columns[::-1], to))
                        columns, to, raw = [x[by] for x in columns], to[by], raw[by]
                        new = _starts(columns)
                        distinct, raw = np.diff(np.concatenate((new, [len(to)]))).astype(np.uint64), np.add.reduceat(raw, new)
                        columns, cut = [x[new] for x in columns], _slices(to[new].astype(np.int64), shards)
                        out += [packed(s, [x[a:b] for x in columns], distinct[a:b], raw[a:b]) for s, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
                out.append((shard, 1, " ".join(files).encode(), pack(totals), b"", b""))
                return pa.table(table(out), fields)

            return run

        def words(key: tuple, rows: pa.Table) -> pa.Table:
            totals, names, sums, files = np.zeros(width, np.int64), [], [], []
            for r in rows.to_pylist():
                if r["kind"]:
                    totals += unpack(r["a"], np.uint64).astype(np.int64)
                    files += r["words"].decode().split()
                else:
                    names.append(unpack_sorted(r["words"]))
                    sums.append(unpack(r["a"], np.uint64).reshape(6, -1))
            if names:
                name, total = _merged(names, sums)
                one, two, more, after, follow, c = total.astype(np.int64)
                files.append(f"words-{key[0].as_py():06d}")
                write_arrays(f"{uri}/{files[-1]}", name, total[5], total[3], *(x.astype(np.uint32) for x in (one, two, more, follow)))
                totals[:4] = [(follow == k).sum() for k in (1, 2, 3, 4)]
                totals[4 * order :] = follow.sum(), c.sum(), (c > 0).sum(), (follow == 1).sum(), (follow == 2).sum(), (follow >= 3).sum()
            return pa.table([pa.array([files], pa.list_(pa.string())), pa.array([totals.tolist()], pa.list_(pa.int64()))], ["files", "totals"])

        counted = docs.select(text_col).mapInArrow(count, _SENT)
        for k in range(order, 1, -1):
            counted = counted.groupBy("key").applyInArrow(level(k), _SENT)
        found = counted.groupBy("key").applyInArrow(words, "files array<string>, totals array<bigint>").collect()
        return cls(uri, shards, order, np.sum([r.totals for r in found], axis=0) if found else np.zeros(width, np.int64), frozenset(f for r in found for f in r.files))

    # Lookups in a worker ------------------------------------------------------------

    def opened(self) -> KneserNey:
        """For one worker: files are mapped at their first use."""
        self.maps: dict[str, list[np.ndarray] | None] = {}
        return self

    def _shard(self, kind: str, s: int, *types: type) -> list[np.ndarray]:
        name = f"{kind}-{s:06d}"
        if name not in self.maps:
            # a file that was written must be there; no word or pair fell into the other shards
            self.maps[name] = map_arrays(f"{self.uri}/{name}", *types) if name in self.files else [np.zeros(0, t) for t in types]
        return self.maps[name]

    def words(self, names: np.ndarray) -> np.ndarray:
        """6 x n for sorted words: count; as a history: sum of counts, following types seen 1, 2, 3+ times; distinct histories."""
        return self._facts("words", names, np.uint64, np.uint64, *[np.uint32] * 4)

    def contexts(self, k: int, names: np.ndarray) -> np.ndarray:
        """4 x n for sorted histories of k-grams: sum of counts, following types seen 1, 2, 3+ times."""
        return self._facts(f"contexts{k}", names, np.uint64, *[np.uint32] * 3)

    def _facts(self, kind: str, names: np.ndarray, *types: type) -> np.ndarray:
        out = np.zeros((len(types), len(names)), np.int64)
        cut = _slices(shard_of(names, self.shards), self.shards)
        for s in np.flatnonzero(np.diff(cut)):
            keys, *columns = self._shard(kind, int(s), np.uint64, *types)
            at = find(keys, names[cut[s] : cut[s + 1]])
            some = at >= 0
            for row, column in zip(out, columns, strict=True):
                row[cut[s] : cut[s + 1]][some] = column[at[some]]
        return out

    def grams(self, k: int, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of k-grams by hash of history and word; distinct ones are looked up in the order of the arrays."""
        key, shard = pair_key(h, w), pair_shard(h, w, self.shards).astype(np.int64)
        order = np.lexsort((key, shard))
        sorted_ = key[order]
        new = np.concatenate(([True], sorted_[1:] != sorted_[:-1])) if len(order) else np.zeros(0, bool)
        wanted, own = sorted_[new], shard[order][new]
        got = np.zeros(len(wanted), np.int64)
        cut = _slices(own, self.shards)
        for s in np.flatnonzero(np.diff(cut)):
            keys, count = self._shard(f"grams{k}", int(s), np.uint64, np.uint32)
            at = find(keys, wanted[cut[s] : cut[s + 1]])
            some = at >= 0
            got[cut[s] : cut[s + 1]][some] = count[at[some]]
        out = np.empty(len(key), np.int64)
        out[order] = got[np.cumsum(new) - 1]
        return out

    def probabilities(self, *grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p(w | history) of each n-gram, oldest word first, and the training count of w."""
        h, w = grams[-2], grams[-1]
        names, at = np.unique(np.concatenate((h, w)), return_inverse=True)
        count, *history, follow = self.words(names)
        h_at, w_at = at[: len(h)], at[len(h) :]
        off = lambda k, c: np.where(c > 0, self.discounts[k - 1][np.clip(c, 1, 3) - 1], 0.0)
        types = max(self.types, 1)
        rest = float(self.discounts[0] @ self.lower) / types if self.types else 1.0
        p = ((follow - off(1, follow)) / types + rest / (self.vocabulary + 1))[w_at]
        for k in range(2, self.order + 1):
            if k > 2:
                h = sequence_hash(list(grams[-k:-1]))
                names, h_at = np.unique(h, return_inverse=True)
                history = self.contexts(k, names)
            total, *seen = history
            weight = np.where(total > 0, self.discounts[k - 1] @ np.array(seen) / np.maximum(total, 1), 1.0)
            c = self.grams(k, h, w)
            p = (c - off(k, c)) / np.maximum(total, 1)[h_at] + weight[h_at] * p
        return p, count[w_at]

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
        """id, n_tokens, n_known, base_score (add-one unigrams), score (log10 probability), perplexity of each document."""
        kind = dict(docs.dtypes)[id_col]
        own = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = own.opened()
            for b in blocks(batches, None, text_col, block_bytes):
                grams, first = tokens(b.data, b.off, model.order)
                p, count = model.probabilities(*grams)
                total = lambda x, first=first: np.add.reduceat(x, first[:-1])
                n = np.diff(first)
                base = np.log10((count + 1) / (model.tokens + model.vocabulary + 1))
                score = total(np.log10(p))
                yield pa.RecordBatch.from_arrays(
                    [b.batch.column(0).slice(b.rows.start, len(n)), pa.array(n), pa.array(total((count > 0).astype(np.int64))), pa.array(total(base)), pa.array(score), pa.array(np.float_power(10, -score / n))],
                    [id_col, "n_tokens", "n_known", "base_score", "score", "perplexity"],
                )

        return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double")


def train_and_score(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold."""
    held_out = F.crc32(F.col(id_col).cast("string")) % folds == held
    model = KneserNey.train(docs.where(~held_out), text_col, order)
    return model.score(docs, id_col, text_col).withColumn("held_out", held_out).withColumn("train_tokens", F.lit(int(model.tokens)).cast("long"))
