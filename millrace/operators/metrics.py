"""Evaluation metrics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from millrace.functions.text import strip_ws, words
from millrace.operators import ranking
from millrace.operators.batches import pieces


def exact_match(a: Column, b: Column) -> Column:
    return (strip_ws(a) == strip_ws(b)).cast("int")


def ngram_set(text: Column, n: int) -> Column:
    w = words(F.coalesce(text, F.lit("")))
    cut = lambda t: F.when(F.size(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " ")))).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(w), cut), 1)


def rouge_n(prediction: Column, reference: Column, n: int) -> Column:
    """F1 of sets of n-grams; zero if either is empty."""
    both = F.array(F.struct(ngram_set(prediction, n).alias("p"), ngram_set(reference, n).alias("r")))

    def f1(x: Column) -> Column:
        hit = F.size(F.array_intersect(x.p, x.r))
        return F.when((F.size(x.p) == 0) | (F.size(x.r) == 0) | (hit == 0), F.lit(0.0)).otherwise(2.0 * hit / (F.size(x.p) + F.size(x.r)))

    return F.element_at(F.transform(both, f1), 1)


def lcs(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """F1 of the longest common subsequence of characters."""
    for p, r in batches:
        yield pd.Series([2.0 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0 for a, b in zip(p.fillna(""), r.fillna(""), strict=True)], dtype=float)


def sentence_bleu(prediction: list[str], reference: list[str], most: int = 4, epsilon: float = 0.1) -> float:
    """BLEU of one pair; an order without a hit counts epsilon."""
    if not prediction or not reference:
        return 0.0
    logs = 0.0
    for n in range(1, most + 1):
        own = Counter(zip(*[prediction[i:] for i in range(n)], strict=False))
        other = Counter(zip(*[reference[i:] for i in range(n)], strict=False))
        hit = sum(min(c, other[g]) for g, c in own.items())
        if n == 1 and not hit:
            return 0.0
        logs += math.log((hit or epsilon) / max(1, sum(own.values()))) / most
    short = min(0.0, 1 - len(reference) / len(prediction))
    return math.exp(short + logs)


@F.pandas_udf(T.DoubleType())
def bleu(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Sentence BLEU over white-space words; null where a side is empty, so that means leave it out."""
    for p, r in batches:
        yield pd.Series([sentence_bleu(a.split(), b.split()) if a.strip() and b.strip() else None for a, b in zip(p.fillna(""), r.fillna(""), strict=True)], dtype=float)


def smoothed_bleu(prediction: list[str], reference: list[str], most: int = 4) -> float:
    """BLEU of one pair in which the k-th order without a hit counts 1 / 2 ** k."""
    if not prediction or not reference:
        return 0.0
    logs, misses = 0.0, 0
    for n in range(1, most + 1):
        own = Counter(zip(*[prediction[i:] for i in range(n)], strict=False))
        other = Counter(zip(*[reference[i:] for i in range(n)], strict=False))
        hit = sum(min(c, other[g]) for g, c in own.items())
        if n == 1 and not hit:
            return 0.0
        misses += not hit
        logs += math.log((hit or 0.5**misses) / max(1, sum(own.values()))) / most
    return math.exp(min(0.0, 1 - len(reference) / len(prediction)) + logs)


def training_scores(df: DataFrame, prediction: str, label: str, segment: Callable[[str], list[str]] = str.split, words: tuple[str, str] | None = None) -> DataFrame:
    """df with rouge_1, rouge_2, rouge_l (F1 over segmented words) and bleu_4 (characters), in percent; the segmenter is the caller's, or ``words`` names the columns of both sides' words."""

    def f1(hit: int, a: int, b: int) -> float:
        return 200.0 * hit / (a + b) if hit else 0.0

    def scores(p: str, r: str, pw: list[str], rw: list[str]) -> tuple[float, float, float, float]:
        a, b = " ".join(pw).split(), " ".join(rw).split()
        out = []
        for n in (1, 2):
            x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a, b))
            out.append(f1(len(x & y), len(x), len(y)))
        number = {w: chr(0x10000 + i) for i, w in enumerate(dict.fromkeys(a + b))}
        out.append(f1(lcs("".join(map(number.get, a)), "".join(map(number.get, b))), len(a), len(b)))
        return (*(round(x, 4) for x in out), round(100 * smoothed_bleu(list(p), list(r)), 4))

    names = ["rouge_1", "rouge_2", "rouge_l", "bleu_4"]

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for p, r, *cut in pieces(batches):
            p, r = ([x or "" for x in side] for side in (p, r))
            cut = [[x or [] for x in side] for side in cut] or [map(segment, p), map(segment, r)]
            found = zip(*map(scores, p, r, *cut), strict=True)
            yield pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in found], names=names)

    return df.withColumn("_s", run(prediction, label, *(words or ()))).select("*", "_s.*").drop("_s")


def token_accuracy(predicted: Column, labels: Column, ignore: int = -100) -> Column:
    """Part of unmasked labels that are hit."""
    kept = F.filter(F.zip_with(predicted, labels, lambda p, y: F.when(y != ignore, (p == y).cast("int"))), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0), lambda s, x: s + x) / F.size(kept))


def accuracy_by_category(df: DataFrame, category: str, correct: str) -> DataFrame:
    """Percent correct of each category and, with a null category, of all."""
    return df.rollup(category).agg((F.avg(F.col(correct).cast("double")) * 100).alias("accuracy"), F.count("*").alias("n"))


def smoothed(df: DataFrame, group: str, order: str, value: str, weight: float | None = None, chunk: int = 512) -> DataFrame:
    """group, n, position, smoothed: exponential smoothing from the first value on; the weight follows the series' length.

    A group is cut into chunks of positions. Each chunk maps the value before it
    linearly to its last; these maps are carried in blocks of chunks, and every
    chunk is finished from its carried start.
    """
    key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    whole = dict(df.dtypes)[order] in ("tinyint", "smallint", "int", "bigint")
    bucket = F.coalesce(F.floor(F.col("_r") / (1 << 16)), F.lit(-(1 << 62))) if whole else F.lit(0)
    rows = df.select(F.col(group).alias("_g"), F.col(order).alias("_r"), F.col(value).alias("_v"), key.alias("_k"))
    rows = ranking.with_position(rows, bucket, ["_r", "_v"], ["_k"], "_p", "_n")
    chunks = rows.groupBy("_k", F.floor(F.col("_p") / chunk).alias("_i")).agg(F.first("_g").alias("_g"), F.first("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_p", F.col("_v").cast("double").alias("x")))).alias("_s"))
    w = F.lit(weight).cast("double") if weight is not None else 1.8 * (1 / (1 + F.exp(-0.05 * F.col("_n"))) - 0.5)
    chunks = chunks.withColumn("_w", w)
    opening = F.element_at("_s", 1)["x"]
    last = F.aggregate("_s", F.when(F.col("_i") == 0, opening).otherwise(F.lit(0.0)), lambda s, x: s * F.col("_w") + (1 - F.col("_w")) * x["x"])
    maps = chunks.select("_k", "_i", F.when(F.col("_i") == 0, 0.0).otherwise(F.pow("_w", F.size("_s"))).alias("mul"), last.alias("add"))
    start = F.struct(F.when(F.col("_i") == 0, opening).otherwise(F.col("_start")).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        now = acc.last * F.col("_w") + (1 - F.col("_w")) * x["x"]
        return F.struct(now.alias("last"), F.array_append(acc.out, now).alias("out"))

    out = chunks.join(_starts(maps, chunk, 2), ["_k", "_i"]).withColumn("_o", F.aggregate("_s", start, step, lambda acc: acc.out))
    out = out.select("_g", "_n", "_i", F.posexplode("_o").alias("_at", "smoothed"))
    return out.select(F.col("_g").alias(group), F.col("_n").cast("int").alias("n"), (F.col("_i") * chunk + F.col("_at")).cast("int").alias("position"), "smoothed")


def _starts(maps: DataFrame, chunk: int, levels: int) -> DataFrame:
    """_k, _i, _start: the value before each linear map; the first of a key ignores it. Blocks of maps are maps again."""
    if levels:
        blocks = maps.groupBy("_k", F.floor(F.col("_i") / chunk).alias("_j"))
    else:
        blocks = maps.groupBy("_k")
    blocks = blocks.agg(F.array_sort(F.collect_list(F.struct("_i", "mul", "add"))).alias("_s"))
    if levels:
        whole = blocks.select("_k", F.col("_j").alias("_i"), F.aggregate("_s", F.lit(1.0), lambda m, x: m * x["mul"]).alias("mul"), F.aggregate("_s", F.lit(0.0), lambda s, x: s * x["mul"] + x["add"]).alias("add"))
        blocks = blocks.join(_starts(whole, chunk, levels - 1).withColumnRenamed("_i", "_j"), ["_k", "_j"])
    else:
        blocks = blocks.withColumn("_start", F.lit(0.0))
    first = F.struct(F.col("_start").alias("last"), F.array().cast("array<double>").alias("out"))
    step = lambda acc, x: F.struct((acc.last * x["mul"] + x["add"]).alias("last"), F.array_append(acc.out, acc.last).alias("out"))
    found = blocks.withColumn("_o", F.aggregate("_s", first, step, lambda acc: acc.out))
    return found.select("_k", F.explode(F.arrays_zip(F.col("_s._i").alias("i"), F.col("_o").alias("o"))).alias("z")).select("_k", F.col("z.i").alias("_i"), F.col("z.o").alias("_start"))


def running_average(df: DataFrame, group: str, order: str, value: str, weight: str) -> DataFrame:
    w = W.Window.partitionBy(group).orderBy(order).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    return df.withColumn("running", F.sum(F.col(value) * F.col(weight)).over(w) / F.sum(weight).over(w))


def preference_losses(chosen: Column, rejected: Column, beta: float = 0.1, gamma: float = 0.5) -> tuple[Column, Column, Column]:
    """Pairwise, reference-free margin and odds-ratio losses over mean log probabilities."""
    log_sigmoid = lambda x: -F.log1p(F.exp(-x))
    odds = (chosen - rejected) - (F.log1p(-F.exp(chosen)) - F.log1p(-F.exp(rejected)))
    return -log_sigmoid(chosen - rejected), -log_sigmoid(beta * (chosen - rejected) - gamma), -chosen - beta * log_sigmoid(odds)
