"""Question and answer pairs from table rows, and helpers around model calls."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from millrace.functions.text import cut_at_sentence, rule_summary, strip_ws

#: Question templates by kind, with their placeholders.
FORWARD = (
    "已知{conditions}，请问{target}{target_qw}？",
    "当{first_condition}时，{target}{target_qw}？",
    "请查询{conditions}对应的{target}。",
    "在{first_condition}的条件下，{target}{target_qw}？",
    "根据{conditions}，{target}{target_qw}？",
    "{first_condition}的情况下，{target}{target_qw}？",
)
REVERSE = (
    "已知{target}为{target_value}，请问{feature}是什么？",
    "{target}是{target_value}，对应的{feature}是什么？",
    "如果{target}为{target_value}，那么{feature}是什么？",
    "查找{target}为{target_value}的记录，{feature}是什么？",
)
MULTI = (
    "已知{conditions}，请分别说明{target_list}的值。",
    "根据{conditions}，查询{target_list}的信息。",
    "在{first_condition}的条件下，{target_list}分别是什么？",
)
SUMMARY = (
    "请描述{conditions}对应的完整记录。",
    "根据{conditions}，给出该条记录的详细信息。",
    "查询{conditions}对应的所有字段信息。",
)
QUESTION_WORDS = {"integer": "是多少", "float": "是多少", "date": "是什么时候", "boolean": "是否"}
NUMBERS = ("integer", "float")


def condition(name: str, value: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.when(F.lower(F.trim(value)).isin("true", "是", "1", "yes"), F.lit(name)).otherwise(f"未{name}")
    return F.concat(F.lit(f"{name}为"), value)


def fill(template: str, **values: Column | str) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else (values[p] if isinstance(values[p], Column) else F.lit(values[p])) for i, p in enumerate(parts) if i % 2 or p])


def rotate(templates: tuple[str, ...], row: Column, shift: int, **values: Column | str) -> Column:
    """The template whose turn it is at this row."""
    out = None
    for k, t in enumerate(templates):
        filled = fill(t, **values)
        hit = (row + shift) % len(templates) == k
        out = F.when(hit, filled) if out is None else out.when(hit, filled)
    return out


def _join(values: list[Column], glue: str) -> Column:
    return F.array_join(F.filter(F.array(*values), lambda x: x.isNotNull()), glue)


def candidates(features: list[tuple[str, str, Column]], targets: list[tuple[str, str, Column]], row: Column) -> Column:
    """All pairs of a row: forward for each target, reverse for up to three features, several targets, and a summary.

    features and targets: name, type and value; empty values take no part.
    """
    has = lambda v: F.coalesce(v, F.lit("")) != ""
    texts = [F.when(has(v), condition(n, v, k)) for n, k, v in features]
    c, f = _join(texts, "，"), F.coalesce(*texts)
    value = lambda n, k, v: F.when(has(v), F.concat(F.lit(n + ("为" if k in NUMBERS else "是")), v))
    pair = lambda ok, q, a, kind, t: F.when(ok, F.struct(q.alias("question"), a.alias("answer"), F.lit(kind).alias("question_type"), F.lit(t).alias("template_type")))
    any_condition = f.isNotNull()
    out = [pair(any_condition & has(v), rotate(FORWARD, row, i, conditions=c, first_condition=f, target=n, target_qw=QUESTION_WORDS.get(k, "是什么")), F.concat(value(n, k, v), F.lit("。")), "fact", "forward") for i, (n, k, v) in enumerate(targets)]
    named, valued = F.coalesce(*[F.when(has(v), F.lit(n)) for n, _, v in targets]), F.coalesce(*[F.when(has(v), v) for _, _, v in targets])
    count = F.lit(0)
    for n, k, v in features:  # the place among features with a value decides the template
        out += [pair(has(v) & valued.isNotNull() & (count == i), rotate(REVERSE, row, i, target=named, target_value=valued, feature=n), F.concat(value(n, k, v), F.lit("。")), "fact", "reverse") for i in range(3)]
        count = count + has(v).cast("int")
    listed = _join([F.when(has(v), F.lit(n)) for n, _, v in targets], "和")
    many = sum((has(v).cast("int") for _, _, v in targets), F.lit(0)) >= 2
    out.append(pair(any_condition & many, rotate(MULTI, row, 0, conditions=c, first_condition=f, target_list=listed), F.concat(_join([value(*t) for t in targets], "，"), F.lit("。")), "fact", "multi_target"))
    every = _join([F.when(has(v), F.concat(F.lit(f"{n}为"), v)) for n, _, v in [*features, *targets]], "，")
    out.append(pair(any_condition, rotate(SUMMARY, row, 0, conditions=c), F.concat(F.lit("根据记录，"), every, F.lit("。")), "summary", "summary"))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def diverse(pairs: Column, most: int) -> Column:
    """The first pair of each template type in order, then the others, up to ``most``."""
    most = max(1, most)
    marked = F.transform(pairs, lambda p, i: F.struct(F.exists(F.slice(pairs, 1, i), lambda q: q.template_type == p.template_type).alias("again"), i.alias("i"), p.alias("p")))
    picked = F.transform(F.slice(F.array_sort(marked), 1, most), lambda m: m.p)
    return F.when(F.size(pairs) <= most, pairs).otherwise(picked)


def question_count(text: Column, count: int, per: int = 240) -> Column:
    """At least one, at most ``count``, one for each ``per`` characters."""
    return F.greatest(F.lit(1), F.least(F.lit(count), F.floor(F.length(text) / per))).cast("int")


def with_neighbours(df: DataFrame, group: str, order: list[str], text: str, width: int = 1) -> DataFrame:
    """Texts of up to ``width`` rows before and after within the group."""
    w = W.Window.partitionBy(group).orderBy(*order)
    join = lambda a, b: F.array_join(F.collect_list(text).over(w.rowsBetween(a, b)), "\n")
    return df.withColumn("before", join(-width, -1)).withColumn("after", join(1, width))


def full_documents(df: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Chunks of each group in order, parted by blank lines."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.groupBy(group).agg(F.array_join(F.transform(rows, lambda r: r[text]), "\n\n").alias("document"), F.count("*").alias("n_chunks"))


def parse_pairs(reply: str | None) -> list[dict]:
    """Question and answer objects of a model's reply: thinking and fences dropped, an array or a wrapping object found, items normalised."""
    text = re.sub(r"(?s)<think>.*?</think>", "", reply or "").strip()
    if m := re.search(r"(?s)```(?:json)?\s*(.*?)```", text):
        text = m[1].strip()
    found = None
    for a, b in (("[", "]"), ("{", "}")):
        i, j = text.find(a), text.rfind(b)
        if 0 <= i < j:
            try:
                found = json.loads(text[i : j + 1])
                break
            except ValueError:
                continue
    if isinstance(found, dict):
        found = next((found[k] for k in ("qa_pairs", "pairs", "questions", "data", "items", "results") if isinstance(found.get(k), list)), [found])
    out = []
    for item in found if isinstance(found, list) else []:
        item = {"question": item} if isinstance(item, str) else item
        if isinstance(item, dict) and (q := str(item.get("question") or item.get("content") or item.get("instruction") or "").strip()):
            out.append({"question": q, "answer": str(item.get("answer") or item.get("output") or "").strip(), "question_type": str(item.get("question_type") or item.get("type") or "fact")})
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("question", "answer", "question_type")])))
def parsed_pairs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(parse_pairs)


def call_model(df: DataFrame, prompt: str, client: Callable[[str], str], out: str = "reply", attempts: int = 3) -> DataFrame:
    """A reply for each prompt by a client that is a function of the prompt; errors are tried again and then give null, as a null prompt does."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def ask(text: str | None) -> str | None:
            for _ in range(attempts if isinstance(text, str) else 0):
                try:
                    return client(text)
                except OSError:
                    continue
            return None

        for batch in batches:
            yield batch.map(ask)

    return df.withColumn(out, run(F.col(prompt)))


def summarised(df: DataFrame, text: str, client: Callable[[str], str], out: str = "summary", most: int = 150, least: int = 50, attempts: int = 3) -> DataFrame:
    """CHK15: a client's summary of each text, cut at a sentence end; without a reply, the summary by rule.

    Texts of fewer than ``least`` or at most ``most`` characters stand for
    themselves and are not sent; null and empty text gives a fixed word.
    """
    body = strip_ws(F.col(text))
    own = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("空内容")).when((F.length(body) < least) | (F.length(text) <= most), body)
    ask = F.when(own.isNull(), F.concat(F.lit(f"请用不超过{most}字概括下文：\n\n"), F.col(text)))
    reply = F.nullif(strip_ws(F.col("_reply")), F.lit(""))
    got = call_model(df.withColumn("_ask", ask), "_ask", client, "_reply", attempts)
    return got.withColumn(out, F.coalesce(own, cut_at_sentence(reply, most), rule_summary(F.col(text), most))).drop("_ask", "_reply")


def reply_text(body: Column) -> Column:
    """The text of a provider's JSON reply, in any of the usual places."""
    return F.coalesce(*[F.get_json_object(body, p) for p in ("$.choices[0].message.content", "$.choices[0].text", "$.content[0].text", "$.output.text", "$.output.choices[0].message.content", "$.message.content")])
