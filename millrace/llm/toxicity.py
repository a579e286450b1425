"""Toxicity by bags of subwords: averaged embeddings of words and their character n-grams under a linear softmax.

A text is cut into passages of about eight words. A passage's vector is the mean
of the vectors of all subwords of its distinct words, hashed to a fixed table, where
missing subwords of a short passage count as zeros; the softmax over it and the
table are trained jointly in numpy, on the driver, over a bounded sample
of labelled rows. A label belongs to a text, not to a passage, so training
alternates: each toxic text is represented by its two most toxic passages so far,
each clean one by its two hardest and one drawn; half of the passages come with spelling errors
made up for the purpose. A text's score comes from its four most toxic passages
and its length, by factors fitted on sampled rows that were not trained on,
as they are and misspelt. Every row is scored over
its whole text, by Arrow batches.

Rows: a null text, or one without a word, scores the share of toxic rows among
labelled ones, as does every text if one class has no sampled row or nothing
tells them apart (no labelled row: 0). A doc_id's label is the greatest of its
labels; null labels and ids don't train; repeated rows each get a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.blocks import ALNUM_BYTES, FOLDED, LOWER, blocks, hash_spans, spans, string_buffers

BITS = 18
DIMENSIONS = 8
PASSAGE_WORDS = 8
#: A passage of fewer subwords is averaged as if it had as many: one word, or one word again and again, weighs no more than in a sentence.
LEAST_SUBWORDS = 64
#: Labelled rows that training takes of each class, those of least hash, and the bytes of the longest text among them.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_BYTES = 3_000, 6_000, 1 << 14
#: Greatest passages that a text's score is made of.
TOP = 4
#: Weight in training of a passage that holds no known subword; either class has half in all.
UNKNOWN_WEIGHT = 0.02
PIECE_BYTES = 1 << 20
_FOLD = np.where(ALNUM_BYTES, LOWER, 0x20).astype(np.uint8)
_LETTERS = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0134", np.uint8)


def subwords(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as starts and ends; the word and the bucket of every subword: the word itself, and runs of 3 to 5 bytes that may take in the blank around it."""
    starts, ends = spans(data, off, ALNUM_BYTES)
    docs = len(off) - 1
    wide = np.full(len(data) + docs + 5, 0x20, np.uint8)
    doc = np.repeat(np.arange(docs, dtype=np.int64), np.diff(off))
    wide[np.arange(len(data)) + doc + 1] = _FOLD[data]
    letter = wide != 0x20
    nth = np.cumsum(letter[1:] & ~letter[:-1]) - 1  # nth[p]: the word of place p + 1
    shift = np.uint64(64 - BITS)
    words, buckets = [np.arange(len(starts))], [(hash_spans(data, starts, ends, FOLDED) >> shift).astype(np.int32)]
    code = wide[:-1].astype(np.uint64) << np.uint64(8) | wide[1:]
    inside = letter[1:].copy()
    for n in (3, 4, 5):
        code = (code[:-1] << np.uint64(8)) | wide[n - 1 :]
        inside = inside[: len(code)] & (letter[n - 2 : n - 2 + len(code)])
        at = np.flatnonzero(inside)
        words.append(nth[at])
        buckets.append(((code[at] + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int32))
    return starts, ends, np.concatenate(words), np.concatenate(buckets)


def passages(words_of: np.ndarray) -> np.ndarray:
    """First word of every passage, from the number of words of each text: as even as may be, none longer than PASSAGE_WORDS."""
    count = -(-words_of // PASSAGE_WORDS)
    doc = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    return (np.cumsum(words_of) - words_of)[doc] + nth * words_of[doc] // np.maximum(count, 1)[doc]


def repeated(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of words (as numbers) that stand earlier in their passage too."""
    passage = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
    key = passage.astype(np.int64) << 32 | words.astype(np.int64)
    order = np.argsort(key, kind="stable")
    return order[1:][key[order][1:] == key[order][:-1]]


@dataclass
class ToxicityModel:
    """weight: what each bucket's vector adds to the log odds of toxic; bias; scale: a factor for each of ``features``, empty if nothing was learned; share of toxic rows."""

    weight: np.ndarray
    bias: float
    scale: np.ndarray
    share: float

    def passage_odds(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of every passage, and the number of passages of each text."""
        starts, _, word, bucket = subwords(data, off)
        total = np.bincount(word, self.weight[bucket], len(starts))
        count = np.bincount(word, minlength=len(starts))
        words_of = np.diff(np.searchsorted(starts, off))
        first = passages(words_of)
        if not len(first):
            return np.zeros(0), np.zeros(len(words_of), np.int64)
        again = repeated(bucket[: len(starts)], first)
        total[again], count[again] = 0, 0
        return np.add.reduceat(total, first) / np.maximum(np.add.reduceat(count, first), LEAST_SUBWORDS) + self.bias, -(-words_of // PASSAGE_WORDS)

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.full(len(off) - 1, self.share)
        if len(self.scale):
            odds, count = self.passage_odds(data, off)
            some = np.flatnonzero(count)
            if len(some):
                out[some] = 1 / (1 + np.exp(-np.clip(features(odds, count[some]) @ self.scale, -700, 700)))
        return out


def features(odds: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of texts with count passages each: the TOP greatest odds (fewer: the least one again), the logarithm of count, one."""
    begin = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((-odds, doc))
    top = [odds[order[begin + np.minimum(k, count - 1)]] for k in range(TOP)]
    return np.stack((*top, np.log(count), np.ones(len(count))), axis=1)


def misspelt(word: bytes, rnd: np.random.RandomState) -> bytes:
    """word with one letter left out, doubled, swapped with the next or replaced."""
    if len(word) < 4:
        return word
    i, kind = rnd.randint(1, len(word)), rnd.randint(4)
    if kind == 0:
        return word[:i] + word[i + 1 :]
    if kind == 1:
        return word[:i] + word[i - 1 : i] + word[i:]
    if kind == 2:
        return word[: i - 1] + word[i : i + 1] + word[i - 1 : i] + word[i + 1 :]
    return word[: i - 1] + bytes([_LETTERS[rnd.randint(len(_LETTERS))]]) + word[i:]


class _Bags:
    """Sampled texts as passages of word numbers, and the buckets of every distinct word."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        self.toxic = toxic
        off, data = string_buffers(pa.array(texts, pa.large_string()))
        numbers, keys, self.words = [], {}, []
        first, doc, at = [], [], 0
        for i in range(0, len(texts), 256):
            part = slice(off[i], off[min(i + 256, len(texts))])
            own = off[i : i + 257] - off[i]
            starts, ends = spans(data[part], own, ALNUM_BYTES)
            hashes = hash_spans(data[part], starts, ends, FOLDED)
            distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
            code = np.empty(len(distinct), np.int64)
            for j, (h, w) in enumerate(zip(distinct.tolist(), where.tolist(), strict=True)):
                code[j] = keys.setdefault(h, len(self.words))
                if code[j] == len(self.words):
                    self.words.append(_FOLD[data[part][starts[w] : ends[w]]].tobytes())
            words_of = np.diff(np.searchsorted(starts, own))
            numbers.append(code[back])
            first.append(passages(words_of) + at)
            doc.append(np.repeat(np.arange(len(words_of)), -(-words_of // PASSAGE_WORDS)) + i)
            at += len(starts)
        self.number, self.first, self.doc = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (numbers, first, doc))
        kept = np.ones(len(self.number), bool)
        kept[repeated(self.number, self.first)] = False
        self.number, self.first = self.number[kept], (np.cumsum(kept) - kept)[self.first]
        self.size = np.diff(np.append(self.first, len(self.number)))
        self.csr = self._buckets(self.words)

    @staticmethod
    def _buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words' subwords, word by word, and n + 1 bounds."""
        off = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        _, _, word, bucket = subwords(np.frombuffer(b"".join(words), np.uint8), off)
        order = np.argsort(word, kind="stable")
        return bucket[order], np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words)))))

    def odds(self, weight: np.ndarray, bias: float) -> np.ndarray:
        bucket, bound = self.csr
        total = np.add.reduceat(weight[bucket], bound[:-1])
        return np.add.reduceat(total[self.number], self.first) / np.maximum(np.add.reduceat(np.diff(bound)[self.number], self.first), LEAST_SUBWORDS) + bias

    def best(self, value: np.ndarray, rows: np.ndarray, many: int) -> np.ndarray:
        """The ``many`` passages of greatest value of each text in rows."""
        own = np.flatnonzero(rows[self.doc])
        own = own[np.lexsort((-value[own], self.doc[own]))]
        begin = np.flatnonzero(np.concatenate(([True], self.doc[own][1:] != self.doc[own][:-1]))) if len(own) else np.zeros(0, int)
        rank = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
        return own[rank < many]

    def drawn(self, chosen: np.ndarray, rnd: np.random.RandomState) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage (0, 1, ...) and bucket of every subword of the chosen passages and of their misspelt copies, and the text of each."""
        bucket, bound = self.csr
        words = np.concatenate([np.arange(a, a + n) for a, n in zip(self.first[chosen], self.size[chosen], strict=True)])
        number, passage = self.number[words], np.repeat(np.arange(len(chosen)), self.size[chosen])
        size = np.diff(bound)[number]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - bound[:-1][number], size)
        edited = [misspelt(self.words[w], rnd) if rnd.rand() < 0.5 else self.words[w] for w in number.tolist()]
        other, cut = self._buckets(edited)
        again = np.repeat(passage, np.diff(cut)) + len(chosen)
        return np.concatenate((np.repeat(passage, size), again)), np.concatenate((bucket[at], other)), np.tile(self.doc[chosen], 2)


def first_values(bags: _Bags, rows: np.ndarray) -> np.ndarray:
    """Each passage's greatest word score: how far a word's share of toxic texts exceeds that of clean ones, in standard errors."""
    pairs = np.unique(np.repeat(bags.doc, bags.size) << 32 | bags.number)
    doc, number = pairs >> 32, pairs & 0xFFFFFFFF
    seen = np.stack([np.bincount(number[rows[doc] & (bags.toxic[doc] == k)], minlength=len(bags.words)) for k in (0, 1)])
    n = np.array([max(1, (rows & (bags.toxic == k)).sum()) for k in (0, 1)])
    share = (seen.sum(axis=0) + 1) / (n.sum() + 2)
    score = (seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
    return np.maximum.reduceat(score[bags.number], bags.first)


def trained(texts: list[str], toxic: np.ndarray, share: float, rounds: int = 4, steps: int = 40, rate: float = 0.05, seed: int = 11) -> ToxicityModel:
    """The model of sampled texts with their labels (0, 1)."""
    nothing = ToxicityModel(np.zeros(1 << BITS, np.float32), 0.0, np.zeros(0), share)
    if len(set(toxic.tolist())) < 2:
        return nothing
    bags = _Bags(texts, toxic)
    rnd = np.random.RandomState(seed)
    held = rnd.rand(len(texts)) < 0.2
    if not len(bags.first) or len(set(toxic[~held].tolist())) < 2:
        return nothing
    vectors = ((rnd.rand(1 << BITS, DIMENSIONS) - 0.5) * 2 / DIMENSIONS).astype(np.float32)
    softmax, bias = (rnd.rand(DIMENSIONS, 2).astype(np.float32) - 0.5) / DIMENSIONS, 0.0
    value = first_values(bags, ~held)
    moments: dict[str, tuple] = {}
    nth = 0

    def moved(name: str, grad: np.ndarray) -> np.ndarray:
        """Adam's step."""
        m, v = moments.get(name, (np.zeros_like(grad), np.zeros_like(grad)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        moments[name] = (m, v)
        return rate * (m / (1 - 0.9**nth)) / (np.sqrt(v / (1 - 0.999**nth)) + 1e-8)

    for _ in range(rounds):
        chosen = np.concatenate((bags.best(value, ~held & (toxic == 1), 2), bags.best(value, ~held & (toxic == 0), 2), bags.best(rnd.rand(len(value)), ~held & (toxic == 0), 1)))
        passage, bucket, doc = bags.drawn(chosen, rnd)
        y = np.append(toxic[doc].astype(np.float64), 0)  # a passage of unknown subwords only is clean
        weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        weight[-1] = UNKNOWN_WEIGHT
        size = np.maximum(np.bincount(passage, minlength=len(y)), LEAST_SUBWORDS)
        for _ in range(steps):
            nth += 1
            odds = np.bincount(passage, (vectors @ (softmax[:, 1] - softmax[:, 0]))[bucket], len(y)) / size + bias
            slip = weight * (1 / (1 + np.exp(-np.clip(odds, -60, 60))) - y)
            pull = np.bincount(bucket, (slip / size)[passage], 1 << BITS).astype(np.float32)
            across = vectors.T @ pull
            bias -= float(moved("bias", np.array(slip.sum())))
            step = np.outer(pull, softmax[:, 1] - softmax[:, 0])
            softmax -= moved("softmax", np.stack((-across, across), axis=1) + 1e-4 * softmax)
            vectors -= moved("vectors", step + 1e-6 * vectors)
        weight_now = vectors @ (softmax[:, 1] - softmax[:, 0])
        value = bags.odds(weight_now, bias)
    count = np.bincount(bags.doc, minlength=len(texts))
    judged = np.flatnonzero(held & (count > 0))
    own, top = held[bags.doc], bags.best(value, held, TOP)
    passage, bucket, _ = bags.drawn(top, rnd)
    size = np.maximum(np.bincount(passage, minlength=2 * len(top)), LEAST_SUBWORDS)
    edited = value.copy()
    edited[top] = (np.bincount(passage, weight_now[bucket], 2 * len(top)) / size + bias)[len(top) :]
    unknown = np.tile([bias] * TOP + [0.0, 1.0], (1 + len(judged) // 20, 1))  # a short text of unknown subwords only is clean
    found = np.concatenate([*(features(v[own], count[judged]) for v in (value, edited)), unknown])
    return ToxicityModel(weight_now.astype(np.float32), bias, fitted(found, np.append(np.tile(toxic[judged], 2), np.zeros(len(unknown), int)), share), share)


def fitted(x: np.ndarray, toxic: np.ndarray, share: float, rounds: int = 50, ridge: float = 0.3) -> np.ndarray:
    """Factors of a logistic regression, the classes weighed as in all labelled rows; those of odds are not below zero. Empty if a class is missing."""
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    if n.min() == 0:
        return np.zeros(0)
    target = np.where(toxic == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = np.where(toxic == 1, share / n[1], (1 - share) / n[0]) * len(toxic)
    mean, spread = np.append(x[:, :-1].mean(axis=0), 0), np.append(x[:, :-1].std(axis=0) + 1e-9, 1)
    z = (x - mean) / spread
    free, w = np.ones(x.shape[1], bool), np.zeros(x.shape[1])
    while True:
        w[~free] = 0
        for _ in range(rounds):
            own = z[:, free]
            p = 1 / (1 + np.exp(-np.clip(own @ w[free], -40, 40)))
            hess = (own * (weight * p * (1 - p))[:, None]).T @ own + ridge * np.eye(free.sum())
            w[free] += np.clip(np.linalg.solve(hess, own.T @ (weight * (target - p)) - ridge * w[free]), -2, 2)
        below = np.flatnonzero(w[:TOP] < 0)
        if not len(below):
            break
        free[below] = False
    if not free[:TOP].any():
        return np.zeros(0)
    out = w / spread
    out[-1] = w[-1] - (w[:-1] * mean[:-1] / spread[:-1]).sum()
    return out


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> ToxicityModel:
    """The model of a bounded sample of the labelled rows; the share of toxic rows counts all of them."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    count = known.agg(F.avg("y").alias("share")).first()
    order = [F.xxhash64("id"), F.col("id")]
    ids = known.where("y = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(known.where("y = 0").orderBy(*order).limit(CLEAN_ROWS))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    # of documents that share an id, one trains
    taken = texts.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text")).orderBy(*order).toArrow()
    return trained(taken.column("text").to_pylist(), taken.column("y").to_numpy(), float(count.share or 0.0))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with a score from 0 to 1; a column of that name is replaced."""
    docs = docs.drop(name)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, None, text_col, PIECE_BYTES):
            score = sent.value.score(block.data, block.off)
            kept = block.batch.slice(block.rows.start, len(score))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(score)], names=[*kept.schema.names, name])

    return docs.mapInArrow(run, fields)
