"""Queries of this package: production parameters, whole tables, digest columns. Each gets its rows through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    import public_tokenizers

    from millrace.llm.bpe import encode_documents

    return encode_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, base kinds counted and digested."""
    import public_tokenizers

    from millrace.llm.secrets import WORDS, joined, scan_secrets, vocabulary_words

    words = (*WORDS, *vocabulary_words(public_tokenizers.path("byte_bpe_50k.json")))
    found = scan_secrets(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), words=words).drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), count("guess").alias("n_guess"),
        F.sha2(joined(F.col("secrets"), ("assign", "access", "hex")), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
        F.array_max(F.transform("secrets", lambda s: s.log10_guesses)).alias("most_log10_guesses"),
    )


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    from millrace.llm.language import LanguageModel, folded, identify

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = LanguageModel.train(docs.where(~folded()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", folded().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_mix").alias("n_langs"))


@query
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: 5-word shingles, similarity 0.75."""
    from millrace.llm.jaccard import jaccard_classes

    return jaccard_classes(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exact or edited, with the alignment's score."""
    from millrace.llm.decontaminate import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 100-byte strings which also start earlier cover."""
    from millrace.llm.suffixes import repeated_bytes

    found = repeated_bytes(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r.end - r.start)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of six sevenths of them."""
    from millrace.llm.kneser_ney import train_and_score

    found = train_and_score(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


@query
def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    from millrace.llm.multi_index import search

    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0")).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply-ordered conversations without quotes, each message with its links."""
    from millrace.llm.quotes import order_replies

    return order_replies(table(spark, sf_dir, "conversations"))


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that each document states."""
    from millrace.llm.licences import scan_licenses

    found = scan_licenses(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.size("license_sentences").cast("long").alias("n_license_sentences"), F.array_join("licenses", ",").alias("licenses"))


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic every document is, learned from labels of three quarters of them."""
    from millrace.llm.language import folded
    from millrace.llm.toxicity import score_toxicity, train

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = train(docs, table(spark, sf_dir, "labels").where(~folded()).select("doc_id", "toxic"))
    found = score_toxicity(docs, model)
    return found.select("doc_id", folded().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


@query
def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code of every vector: four parts, 256 entries, four rounds."""
    from millrace.llm.vector_codes import compress

    found = compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return found.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", "codebooks_sha256")


@query
def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    from millrace.llm.conversation_trie import century, prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"), century, 5)


def _oracles() -> None:
    from millrace.llm import conversation_trie, jaccard, licences, quotes, vector_codes

    ORACLES["op2_jaccard"] = jaccard.oracle()
    ORACLES["op5_quotes"] = quotes.oracle()
    ORACLES["op8_licenses"] = licences.oracle()
    ORACLES["op12_codes"] = vector_codes.oracle()
    ORACLES["op13_trie"] = conversation_trie.oracle()


_oracles()
