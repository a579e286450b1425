"""Quality rules for answers, as Columns, and their verdict."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import CJK, strip_ws

#: Characters that count as ordinary besides letters, digits and white space.
ORDINARY = r"""\w\s\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}.,;:!?，。；：！？、"'（）()【】\[\]{}\-/\\@#$%^&*+=~`|<>"""
OPENS, CLOSES = "(（[【", ")）]】"
QUOTES = ("“”", "‘’", "「」", "『』")


def long_enough(answer: Column, source: Column) -> Column:
    """Two characters from tables, twenty from texts, after stripping."""
    least = F.when(F.coalesce(source, F.lit("")).contains("structured"), 2).otherwise(20)
    return F.coalesce(F.length(strip_ws(answer)), F.lit(0)) >= least


def garbled(answer: Column, most: float = 0.3) -> Column:
    beyond = F.regexp_replace(answer, r"[\t-\r -~]++", "")  # plain ASCII goes first: the wide class is slow
    odd = F.length(F.regexp_replace(beyond, f"(?U)[{ORDINARY}]++", ""))
    return (F.length(answer) > 0) & (odd / F.length(answer) > most)


def cut_off(answer: Column) -> Column:
    tail = F.regexp_replace(answer, r"(?U)\s+$", "")
    return tail.endswith("...") | tail.endswith("…") | tail.endswith("。。。")


def _marks(answer: Column) -> Column:
    """Only the brackets and quotes of a text; what counts them reads these few."""
    beyond = F.regexp_replace(answer, r"[\x00-'*-Z\\^-\x7f]++", "")
    return F.regexp_replace(beyond, f"[^{re.escape(OPENS + CLOSES + ''.join(QUOTES))}]++", "")


def _count(marks: Column, chars: str) -> Column:
    return F.length(marks) - F.length(F.translate(marks, chars, ""))


def _open(marks: Column) -> Column:
    return _count(marks, OPENS) > _count(marks, CLOSES)


def _odd(marks: Column) -> Column:
    out = F.lit(False)
    for a, b in QUOTES:
        out = out | (_count(marks, a) != _count(marks, b))
    return out


def open_brackets(answer: Column) -> Column:
    return F.element_at(F.transform(F.array(_marks(answer)), _open), 1)


def odd_quotes(answer: Column) -> Column:
    return F.element_at(F.transform(F.array(_marks(answer)), _odd), 1)


def unpaired(answer: Column) -> Column:
    """open_brackets, odd_quotes or an empty text, from one pass over the answer."""
    return F.element_at(F.transform(F.array(_marks(answer)), lambda m: F.when(_open(m), "open_brackets").when(_odd(m), "odd_quotes").otherwise("")), 1)


def repeats_at_once(answer: Column) -> Column:
    """A unit of six characters or more, three times in a row."""
    unit = rf"[{CJK}\w，。；：！？、]"
    # three units need a run of eighteen: only texts with one are searched
    return F.when(answer.rlike(rf"(?U)(?<!{unit}){unit}{{18}}"), answer.rlike(rf"(?U)({unit}{{6,}})\1{{2,}}")).otherwise(F.when(answer.isNotNull(), False))


@F.pandas_udf(T.BooleanType())
def _repeats_apart(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def hit(text: str | None) -> bool:
        if not text:
            return False
        seen: dict[str, list[int]] = {}
        for i in range(len(text) - 20):
            part = text[i : i + 20]
            if part.strip() and sum("一" <= c <= "鿿" for c in part) > 12:
                seen.setdefault(part, []).append(i)
        full = text[-20:]
        if full in seen:
            seen[full].append(len(text) - 20)
        for places in seen.values():
            count, free = 0, -1
            for at in places:
                if at >= free:
                    count, free = count + 1, at + 20
            if count >= 3:
                return True
        return False

    for batch in batches:
        yield batch.map(hit).astype(bool)


def repeats_apart(answer: Column) -> Column:
    """A mostly CJK fragment of twenty characters, three times anywhere. Only texts that can hold it reach Python."""
    cjk = F.length(F.regexp_replace(answer, f"[^{CJK}]++", ""))
    return F.coalesce(_repeats_apart(F.when(cjk >= 39, answer)), F.lit(False))


def follows_template(answer: Column, source: Column) -> Column:
    """Answers made from tables state that a field is a value, or a plain yes or no."""
    s = strip_ws(answer)
    shape = s.rlike(rf"(?U)[{CJK}\w]+[是为]\S+") | s.rlike(rf"^(未)?[{CJK}]{{2,10}}[。.]?$") | s.rlike(rf"(?U)[{CJK}\w]+不[是为]\S+")
    return F.when(F.coalesce(answer, F.lit("")) == "", True).when(F.coalesce(source, F.lit("")).contains("structured"), shape).otherwise(True)


def format_error(answer: Column, apart: bool = True) -> Column:
    """The first format rule that an answer breaks, else an empty text."""
    a = F.coalesce(answer, F.lit(""))
    late = F.when(repeats_at_once(a), "repeats")
    late = (late.when(repeats_apart(a), "repeats") if apart else late).otherwise("")
    return F.when(a == "", "").when(garbled(a), "garbled").when(cut_off(a), "cut_off").otherwise(F.coalesce(F.nullif(unpaired(a), F.lit("")), late))


def simple_error(answer: Column) -> Column:
    """format_error without the rules on repeats."""
    a = F.coalesce(answer, F.lit(""))
    return F.when(a == "", "").when(garbled(a), "garbled").when(cut_off(a), "cut_off").otherwise(unpaired(a))


def verdict(answer: Column, source: Column, similarity: Column | None = None, apart: bool = True, error: Column | None = None) -> Column:
    """format_error, template_error, hallucination (similarity below a half), basic_error or passed: the first that holds. ``error``: format_error's answer, where a column has it."""
    out = F.when((format_error(answer, apart) if error is None else error) != "", "format_error").when(~follows_template(answer, source), "template_error")
    if similarity is not None:
        out = out.when(similarity < 0.5, "hallucination")
    return out.when(~long_enough(answer, source), "basic_error").otherwise("passed")


def parse_judgement(reply: Column) -> tuple[Column, Column]:
    """Score (0 to 5 at half points) and correctness (3 or more) from a judge's reply."""
    from millrace.functions.text import half_points

    raw = F.coalesce(F.get_json_object(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "$.score").try_cast("double"), F.regexp_extract(reply, r'(?i)score"?\s*[:：]\s*([0-9]+(?:\.[0-9]+)?)', 1).try_cast("double"), F.lit(0.0))
    score = half_points(raw)
    return score, F.when(score >= 3, "true").otherwise("false")


#: What a judge scores from one to ten.
JUDGED = ("score", "factual", "completeness", "no_hallucination", "format")


def parse_scores(reply: Column, default: int = 5) -> Column:
    """The judge's five scores and reason; a missing score is the default, and so are all where the reply holds no readable object."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1)
    score = lambda name: F.coalesce(F.get_json_object(body, f"$.{name}").try_cast("double").cast("int"), F.lit(default))
    reason = F.when(F.try_parse_json(body).isNotNull(), F.coalesce(F.get_json_object(body, "$.reason"), F.lit(""))).otherwise(F.left(F.coalesce(reply, F.lit("")), F.lit(100)))
    return F.struct(*[score(n).alias(n) for n in JUDGED], reason.alias("reason"))
