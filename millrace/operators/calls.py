"""Calls of tools inside replies, by a recogniser of balanced brackets as a Column fold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of text up to and with one mark: an escape, a quote or a bracket; the last run may have none.
_RUNS = r'(?s)[^"{}\[\]\\]*(?:\\.|["{}\[\]\\])|[^"{}\[\]\\]+$'
_SPANS = "array<struct<start:int,end:int>>"
#: How a call is marked, by dialect: the pattern before an object, with the name if it stands there, and where the object holds name and arguments.
DIALECTS = {
    "tags": (r"(?s)<tool_call>\s*$", None),
    "action": (r"(?s)Action:\s*([A-Za-z0-9_.-]+)\s*Action Input:\s*$", "name"),
    "function": (r"(?s)<function=([A-Za-z0-9_.-]+)>\s*$", "name"),
    "named": (r"(?s)^\s*([A-Za-z_][\w.-]*)\s*\n\s*$", "name"),
    "object": (r"(?s)(?:^|[\[,]|\[TOOL_CALLS\]|<tool_calls>|\})\s*$", None),
}


def balanced(text: Column) -> Column:
    """start (from 1) and end (inclusive) of every outermost {...} whose brackets balance; strings inside, with their escapes, hide brackets.

    One pass: runs between marks are folded with their summed length. A bracket
    of the wrong kind or an object that doesn't end gives no span; reading goes on
    after the mark that failed. Null text has no spans.
    """
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_RUNS), 0)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("open"), F.lit(False).alias("quoted"), F.lit(0).alias("begin"), F.array().cast(_SPANS).alias("spans"))

    def step(acc: Column, run: Column) -> Column:
        at = acc.at + F.length(run)
        mark = F.when(F.substring(run, -2, 1) == "\\", "").otherwise(F.substring(run, -1, 1))  # an escaped mark is text
        inside = acc.open != ""
        opens = ~acc.quoted & mark.isin("{", "[") & (inside | (mark == "{"))
        closes = ~acc.quoted & inside & mark.isin("}", "]")
        fits = closes & (F.substring(acc.open, -1, 1) == F.translate(mark, "}]", "{["))
        left = F.substring(acc.open, F.lit(1), F.length(acc.open) - 1)
        done = fits & (F.length(acc.open) == 1)
        begin = F.when(opens & ~inside, at).otherwise(acc.begin)
        return F.struct(
            at.alias("at"),
            F.when(opens, F.concat(acc.open, mark)).when(fits, left).when(closes, F.lit("")).otherwise(acc.open).alias("open"),
            F.when(inside & (mark == '"'), ~acc.quoted).when(closes & ~fits, False).otherwise(acc.quoted).alias("quoted"),
            begin.alias("begin"),
            F.when(done, F.array_append(acc.spans, F.struct(begin.alias("start"), at.alias("end")))).otherwise(acc.spans).alias("spans"),
        )

    return F.aggregate(runs, start, step, lambda acc: acc.spans)


def nested_calls(text: Column, dialect: str) -> Column:
    """TRN17: name and arguments (compact JSON) of a reply's calls, objects in objects and brackets in strings included.

    tags: <tool_call>{name, arguments}; action: Action and Action Input; function:
    <function=name>{...}; named: a name's line before the object; object: an object
    or a list of them, as arguments or parameters, one a line or marked. Spans that
    are no JSON object with a name are left out, and so is text around them.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect}")
    before, kind = DIALECTS[dialect]
    spans = balanced(text)
    if dialect == "named":
        spans = F.slice(spans, 1, 1)

    def call(s: Column, i: Column) -> Column:
        earlier = F.when(i > 0, F.element_at(spans, F.greatest(i, F.lit(1))).end).otherwise(F.lit(0))
        lead = F.concat(F.when(i > 0, F.lit("}")).otherwise(F.lit("")), F.substring(text, earlier + 1, s.start - earlier - 1))
        body = F.substring(text, s.start, s.end - s.start + 1)
        if kind:
            name, arguments = F.nullif(F.regexp_extract(lead, before, 1), F.lit("")), F.get_json_object(body, "$")
        else:
            name, arguments = F.get_json_object(body, "$.name"), F.coalesce(F.get_json_object(body, "$.arguments"), F.get_json_object(body, "$.parameters"))
        return F.when(lead.rlike(before) & name.isNotNull() & arguments.isNotNull(), F.struct(name.alias("name"), arguments.alias("arguments")))

    return F.filter(F.transform(spans, call), lambda c: c.isNotNull())
