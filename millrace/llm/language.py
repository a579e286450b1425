"""Language identification as mixture inference over byte trigram likelihoods.

Training counts the hashed trigrams of every labelled text with Spark; the
model is one vector of fixed length for each language. A document is a
sequence of short units of words; expectation-maximisation estimates its
language proportions from the units' likelihoods, and the set of languages is
the one among the nested sets, by proportion, whose penalised likelihood is
greatest.

Rows: a text that is null or has no letter is ``und`` with score 0; so is every
text if nothing is learned; ties go to the language first in order; rows whose
label or text is null do not train; repeated rows each count and each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.blocks import LOWER, blocks

BUCKETS = 1 << 16
_LETTER = np.array([chr(c).isalpha() and c < 0x80 or c >= 0x80 for c in range(256)])
_FOLD = np.where(_LETTER, LOWER, 0x20).astype(np.uint8)
UNIT_WORDS = 4
#: Bytes of text that a worker looks at a time.
PIECE_BYTES = 1 << 20


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of letters, the bucket of the trigram around each, and a mark where a word starts.

    Documents are parted by a blank, so that no trigram crosses two of them.
    """
    n = len(data)
    folded = _FOLD[data]
    wide = np.full(n + 2, 0x20, np.uint8)
    wide[1:-1] = folded
    left, right = wide[:-2].copy(), wide[2:].copy()
    edge = off[1:-1]
    left[edge[edge < n]] = 0x20
    right[edge[edge > 0] - 1] = 0x20
    at = np.flatnonzero(folded != 0x20)
    l, m, r = left[at], folded[at], right[at]  # noqa: E741
    code = l.astype(np.uint32) << np.uint32(16) | m.astype(np.uint32) << np.uint32(8) | r
    return at, (code * np.uint32(2654435761)) >> np.uint32(16), l == 0x20


def count_trigrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, bucket, n over all labelled rows. Each task adds up its own counts before the shuffle, which so carries at most languages x buckets rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for block in blocks(batches, lang_col, text_col, PIECE_BYTES):
            names, code = np.unique(block.ids.astype(str), return_inverse=True)
            at, bucket, _ = trigrams(block.data, block.off)
            own = np.repeat(code, np.diff(block.off))[at]
            found = np.bincount(own * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for name, row in zip(names.tolist(), found, strict=True):
                total[name] = total.get(name, 0) + row
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], ["lang", "bucket", "n"])

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias(lang_col), text_col)
    return known.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log likelihoods of trigram buckets by language: languages x BUCKETS float32, whatever the corpus."""

    def __init__(self, names: list[str], logs: np.ndarray):
        self.names, self.logs = names, logs

    @classmethod
    def train(cls, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smooth: float = 0.5) -> LanguageModel:
        counts = count_trigrams(docs, text_col, lang_col).toArrow()
        names = sorted(set(counts.column("lang").to_pylist()))
        table = np.full((len(names), BUCKETS), smooth)
        code = np.searchsorted(names, counts.column("lang").to_pylist()) if names else np.zeros(0, int)
        np.add.at(table, (code, counts.column("bucket").to_numpy()), counts.column("n").to_numpy())
        return cls(names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32) if names else table.astype(np.float32))

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods of each unit by language, and the first unit of each document (n + 1)."""
        at, bucket, word = trigrams(data, off)
        first = np.searchsorted(at, off)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        nth = np.cumsum(word)
        before = np.concatenate(([0], nth))[first[:-1]]
        nth = (nth - 1 - before[doc]) // UNIT_WORDS
        starts = np.flatnonzero(np.concatenate(([True], (nth[1:] != nth[:-1]) | (doc[1:] != doc[:-1])))) if len(at) else np.zeros(0, int)
        logs = np.stack([np.add.reduceat(row[bucket], starts) for row in self.logs], axis=1) if len(starts) else np.zeros((0, len(self.names)), np.float32)
        return logs, np.searchsorted(starts, first)

    def mixture(self, logs: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log likelihood of each document (with units) under its allowed languages."""
        size = np.diff(first)
        top = logs.max(axis=1, keepdims=True)
        like = np.exp(logs - top)
        share = allowed / allowed.sum(axis=1, keepdims=True)
        doc = np.repeat(np.arange(len(size)), size)
        for _ in range(rounds):
            joint = like * share[doc] + 1e-30
            total = joint.sum(axis=1, keepdims=True)
            share = np.add.reduceat(joint / total, first[:-1], axis=0) / size[:, None] * allowed
            share /= share.sum(axis=1, keepdims=True)
        total = (like * share[doc]).sum(axis=1) + 1e-30
        return share, np.add.reduceat(np.log(total) + top[:, 0], first[:-1])

    def predict(self, data: np.ndarray, off: np.ndarray, rounds: int = 12, penalty: float = 2.0, least: float = 0.02) -> np.ndarray:
        """Proportions of each document by language; all zero where it has no letter."""
        docs, k = len(off) - 1, len(self.names)
        out = np.zeros((docs, k))
        if not k:
            return out
        logs, first = self.units(data, off)
        some = np.flatnonzero(np.diff(first))
        if not len(some):
            return out
        start = np.concatenate((first[some], first[-1:]))
        share, _ = self.mixture(logs, start, np.ones((len(some), k)), rounds)
        order = np.argsort(-share, axis=1, kind="stable")
        out[some] = np.eye(k)[order[:, 0]]
        mixed = np.flatnonzero(np.sort(share, axis=1)[:, -2] >= least) if k > 1 else np.zeros(0, int)
        if len(mixed):
            size = np.diff(start)
            pick = np.concatenate([np.arange(start[i], start[i + 1]) for i in mixed])
            own, begin = logs[pick], np.concatenate(([0], np.cumsum(size[mixed])))
            best = np.full(len(mixed), -np.inf)
            place = np.argsort(order[mixed], axis=1)
            for n in range(1, k + 1):
                got, value = self.mixture(own, begin, (place < n).astype(float), rounds)
                value = value - penalty * (n - 1) * np.log(size[mixed] + 1)
                better = value > best
                out[some[mixed[better]]] = got[better]
                best = np.maximum(best, value)
        return out


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_mix")) -> DataFrame:
    """docs with the main language, its proportion and the proportions of the selected set; columns of those names are replaced."""
    docs = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.logs))
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{names[0]}` string, `{names[1]}` double, `{names[2]}` map<string,double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*sent.value)
        for block in blocks(batches, None, text_col, PIECE_BYTES):
            share = own.predict(block.data, block.off)
            plain = np.concatenate(([0], np.cumsum((_LETTER & (np.arange(256) < 0x80))[block.data])))[block.off]
            for i in np.flatnonzero(plain[1:] == plain[:-1]):  # no ASCII letter: look at each character
                if not any(c.isalpha() for c in block.text(i).decode("utf-8", "replace")):
                    share[i] = 0
            known = share.sum(axis=1) > 0 if own.names else np.zeros(len(share), bool)
            top = share.argmax(axis=1) if own.names else np.zeros(len(share), int)
            lang = [own.names[j] if ok else "und" for j, ok in zip(top, known, strict=True)]
            score = [min(1.0, float(s[j])) if ok else 0.0 for s, j, ok in zip(share, top, known, strict=True)]
            mix = [[(own.names[j], float(s[j])) for j in np.flatnonzero(s > 0)] for s in share]
            kept = block.batch.slice(block.rows.start, len(share))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lang), pa.array(score, pa.float64()), pa.array(mix, pa.map_(pa.string(), pa.float64()))], names=[*kept.schema.names, *names])

    return docs.mapInArrow(run, fields)


def folded(id_col: str | Column = "doc_id", folds: int = 4, held: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the held-out remainder."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string")) % folds == held
