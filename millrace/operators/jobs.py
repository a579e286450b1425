"""Generation jobs as plans: which rows are due, their prompts, the replies' pairs, and summaries of runs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.qa import call_model, full_documents, parsed_pairs, question_count, with_neighbours

MODES = ("local", "context_enhanced", "full_doc")


def due_for_answer(status: Column, updated: Column, now: Column, include_failed: bool = False, include_answered: bool = False, stale_minutes: int = 10) -> Column:
    """Pending rows, rows in flight for too long, and failed or answered ones where asked for."""
    stale = (status == "processing") & (updated < now - F.expr(f"INTERVAL {stale_minutes} MINUTES"))
    out = status.isNull() | (status == "pending") | stale
    if include_failed:
        out = out | (status == "failed")
    return out | (status == "completed") if include_answered else out


def prompts(chunks: DataFrame, count: int = 5, modes: tuple[str, ...] = MODES, file: str = "file_id", chunk: str = "chunk_id", name: str = "name", text: str = "content", width: int = 1) -> DataFrame:
    """A row for each chunk and mode (one for each file in full_doc mode), with its own chunk, question count and prompt.

    Files are put together by one grouped aggregation; neighbours come from one window by file.
    """
    if unknown := set(modes) - set(MODES):
        raise ValueError(f"unknown modes {sorted(unknown)}")
    ask = lambda n: F.concat(F.lit("Write "), n.cast("string"), F.lit(" questions with answers about the text below, as a JSON array.\n\n"))
    parts = []
    n = question_count(F.col(text), count)
    if "local" in modes:
        parts.append(chunks.select(file, chunk, F.lit("local").alias("mode"), n.alias("n_questions"), F.concat(ask(n), text).alias("prompt")))
    if "context_enhanced" in modes:
        near = with_neighbours(chunks, file, [name, chunk], text, width)
        body = F.concat(ask(n), F.col(text), F.when(F.col("before") != "", F.concat(F.lit("\n\nBefore it:\n"), "before")).otherwise(""), F.when(F.col("after") != "", F.concat(F.lit("\n\nAfter it:\n"), "after")).otherwise(""))
        parts.append(near.select(file, chunk, F.lit("context_enhanced").alias("mode"), n.alias("n_questions"), body.alias("prompt")))
    if "full_doc" in modes:
        whole = full_documents(chunks.select(file, F.struct(name, chunk).alias("_o"), text), file, "_o", text)
        m = question_count(F.col("document"), count)
        parts.append(whole.select(file, F.lit(None).cast(dict(chunks.dtypes)[chunk]).alias(chunk), F.lit("full_doc").alias("mode"), m.alias("n_questions"), F.concat(ask(m), "document").alias("prompt")))
    return reduce(DataFrame.unionByName, parts)


def generate(rows: DataFrame, client: Callable[[str], str], keep: tuple[str, ...] = ("file_id", "chunk_id", "mode")) -> DataFrame:
    """Pairs of each prompt's reply, at most n_questions, with the prompt's own keys."""
    replies = call_model(rows, "prompt", client).withColumn("pairs", F.slice(parsed_pairs("reply"), 1, F.col("n_questions")))
    return replies.select(*keep, F.posexplode("pairs").alias("position", "p")).select(*keep, "position", "p.*")


def suitable(reply: Column) -> Column:
    """Whether a gate's reply lets a chunk through; anything unreadable does."""
    return F.coalesce(F.get_json_object(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "$.suitable").try_cast("boolean"), F.lit(True))


def retry_prompt(question: Column, text: Column, problem: Column) -> Column:
    return F.concat(F.lit("Answer again. The last answer failed because: "), F.coalesce(problem, F.lit("unknown")), F.lit("\nQuestion: "), question, F.lit("\nText: "), F.coalesce(text, F.lit("")))


def run_listing(runs: DataFrame, body: str = "summary") -> DataFrame:
    """task_id, created_questions, n_files of run summaries (JSON), files being a map by id."""
    parsed = F.from_json(body, "task_id string, created_questions long, files map<string,struct<filename:string,qa_count:long>>")
    return runs.select(parsed.alias("s")).select("s.task_id", "s.created_questions", F.coalesce(F.size("s.files"), F.lit(0)).alias("n_files"), F.aggregate(F.coalesce(F.map_values("s.files"), F.array()), F.lit(0).cast("long"), lambda n, f: n + F.coalesce(f.qa_count, F.lit(0))).alias("qa_count"))


def overall(*scores: Column) -> Column:
    """Mean of the scores that are there."""
    kept = F.filter(F.array(*[s.cast("double") for s in scores]), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def tokens_per_second(df: DataFrame, ids: str, epochs: float, seconds: float) -> DataFrame:
    return df.agg((F.sum(F.size(ids)) * epochs / seconds).alias("tokens_per_second"))


def placeholder_counts(text: Column, marks: tuple[str, ...] = ("<image>", "<video>", "<audio>")) -> Column:
    """How often each media placeholder stands in a text."""
    return F.struct(*[((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m)).cast("int").alias(m.strip("<>")) for m in marks])


def media_match(text: Column, images: Column, videos: Column, audios: Column) -> Column:
    """Whether a row has as many media as placeholders."""
    n = placeholder_counts(text)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return (n.image == size(images)) & (n.video == size(videos)) & (n.audio == size(audios))


def media_paths(paths: Column, folder: str) -> Column:
    """Relative media paths inside the dataset's folder."""
    return F.transform(paths, lambda p: F.when(p.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*://)"), p).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), p)))


#: Training stages and the kind of rows that each takes.
STAGES = {"pt": "pretrain", "sft": "supervised", "rm": "pairwise", "dpo": "pairwise", "kto": "feedback", "ppo": "unsupervised"}


def rows_for(stage: str, ranking: bool) -> str:
    """The kind of encoding for a stage; preference data and preference stages go together."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    if ranking != (stage in ("rm", "dpo")):
        raise ValueError("preference data is for rm and dpo, and they take no other")
    return STAGES[stage]
