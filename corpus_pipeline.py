"""The corpus pipeline: stages that filter and rewrite documents before training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import encode_documents
from millrace.llm.decontaminate import drop_contaminated
from millrace.llm.jaccard import jaccard_classes
from millrace.llm.language import LanguageModel, folded, identify
from millrace.llm.secrets import WORDS, scan_secrets, vocabulary_words
from millrace.llm.shared import fresh_path
from millrace.session import table

#: Documents whose main language makes up less of them than this go: text in three languages by equal parts stays.
LEAST_LANGUAGE = 0.25


def own_names(docs: DataFrame, *names: str) -> list[str]:
    """Names for a stage's own columns that no column of docs has."""
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    return [mark + n for n in names]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; those without a letter or without any main language go."""
    model = LanguageModel.train(docs.where(~folded()))
    lang, score, mix = own_names(docs, "lang", "score", "mix")
    found = identify(docs, model, names=(lang, score, mix))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the least id. Rows without an id stay."""
    kept = jaccard_classes(docs).where("doc_id = component_id").select("doc_id")
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    import public_tokenizers

    words = (*WORDS, *vocabulary_words(public_tokenizers.path("byte_bpe_50k.json")))
    (spans,) = own_names(docs, "spans")
    clean = scan_secrets(docs, out_col=spans, words=words, mask="[SECRET]")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each document's ids and decoded text."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("encode", encode)]

#: SQL can't express the stages; tests compare each with a version written down anew over all rows (language: with the operator and the rule on letters).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
