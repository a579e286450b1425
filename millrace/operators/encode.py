"""Token encodings of preference, feedback and prompt rows, their padding, and tool calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.batches import pieces
from millrace.operators.budget import infer_lengths


def _ids(*names: str) -> pa.DataType:
    return pa.struct([(n, pa.list_(pa.int32())) for n in names])


def _structs(rows: list[tuple], kind: pa.StructType) -> pa.StructArray:
    """Rows of encoded sequences as one column, each field at a time."""
    return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kind, strict=True)], fields=list(kind))


def _prompt_text(system: str | None, turns: list) -> str:
    return "\n".join([*([system] if system else []), *[t["content"] for t in turns]])


def encode_pairwise(df: DataFrame, tokenizer: Callable[[str], list[int]], cutoff: int, eos: int, ignore: int = -100) -> DataFrame:
    """chosen and rejected ids and labels; the prompt is cut by the longer response, alike for both."""

    kind = _ids("chosen_input_ids", "chosen_labels", "rejected_input_ids", "rejected_labels")

    @F.arrow_udf("struct<chosen_input_ids:array<int>,chosen_labels:array<int>,rejected_input_ids:array<int>,rejected_labels:array<int>>")
    def run(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for prompts, responses, systems in pieces(it):
            rows = []
            for p, r, s in zip(prompts, responses, systems, strict=True):
                prompt = tokenizer(_prompt_text(s, p))
                sides = [[*tokenizer(x["content"]), eos] for x in r[:2]]
                np_, nt = infer_lengths(len(prompt), max(map(len, sides)), cutoff)
                rows.append([y for side in sides for y in (prompt[:np_] + side[:nt], [ignore] * np_ + side[:nt])])
            yield _structs(rows, kind)

    return df.withColumn("_e", run("_prompt", "_response", F.coalesce("_system", F.lit("")))).select("*", "_e.*").drop("_e")


def encode_prompts(df: DataFrame, tokenizer: Callable[[str], list[int]], cutoff: int, eos: int) -> DataFrame:
    """input_ids of the prompt and labels of the response, for prediction."""

    kind = _ids("input_ids", "labels")

    @F.arrow_udf("struct<input_ids:array<int>,labels:array<int>>")
    def run(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for prompts, responses, systems in pieces(it):
            rows = []
            for p, r, s in zip(prompts, responses, systems, strict=True):
                source, target = tokenizer(_prompt_text(s, p)), [*(tokenizer(r[0]["content"]) if len(r) else []), eos]
                ns, nt = infer_lengths(len(source), len(target), cutoff)
                rows.append((source[:ns], target[:nt]))
            yield _structs(rows, kind)

    return df.withColumn("_e", run("_prompt", "_response", F.coalesce("_system", F.lit("")))).select("*", "_e.*").drop("_e")


def encode_feedback(df: DataFrame, tokenizer: Callable[[str], list[int]], cutoff: int, eos: int, kl: str = "kl_text", ignore: int = -100) -> DataFrame:
    """ids and labels of the response and of its mismatched neighbour; kto_tag says whether the first response is the filled one."""

    kind = pa.struct([*_ids("input_ids", "labels", "kl_input_ids", "kl_labels"), ("kto_tag", pa.bool_())])

    @F.arrow_udf("struct<input_ids:array<int>,labels:array<int>,kl_input_ids:array<int>,kl_labels:array<int>,kto_tag:boolean>")
    def run(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for prompts, responses, systems, others in pieces(it):
            rows = []
            for p, r, s, k in zip(prompts, responses, systems, others, strict=True):
                good = bool(r[0]["content"])
                prompt, own, other = tokenizer(_prompt_text(s, p)), [*tokenizer(r[0 if good else 1]["content"]), eos], [*tokenizer(k or ""), eos]
                row: list = []
                for target in (own, other):
                    ns, nt = infer_lengths(len(prompt), len(target), cutoff)
                    row += [prompt[:ns] + target[:nt], [ignore] * ns + target[:nt]]
                rows.append((*row, good))
            yield _structs(rows, kind)

    return df.withColumn("_e", run("_prompt", "_response", F.coalesce("_system", F.lit("")), kl)).select("*", "_e.*").drop("_e")


def padded(ids: Column, width: Column, fill: int, left: bool = False) -> Column:
    """A sequence brought to a width by a fill value."""
    more = F.array_repeat(F.lit(fill), F.greatest(width - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(more, ids) if left else F.concat(ids, more)


def packed_lengths(mask: Column) -> Column:
    """Cumulative lengths of the sequences that a packed mask numbers 1, 2, ...; zero is padding."""
    most = F.coalesce(F.array_max(mask), F.lit(0))
    ids = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(0)), F.transform(ids, lambda i: F.size(F.filter(mask, lambda m: (m > 0) & (m <= i)))))


def choice_prompt(question: Column, options: list[Column], answer: Column | None = None) -> Column:
    """A multiple-choice question with options A, B, ... and the answer if it is an example."""
    lines = [question, *[F.concat(F.lit(f"{chr(65 + i)}. "), o) for i, o in enumerate(options)], F.lit("Answer: ") if answer is None else F.concat(F.lit("Answer: "), answer)]
    return F.concat_ws("\n", *lines)


def align_tool_messages(messages: Column) -> Column:
    """Messages with role, content and tool_calls (JSON): calls become function messages, adjacent tool replies one observation."""
    named = F.transform(
        messages,
        lambda m: F.struct(
            F.when(F.coalesce(m.tool_calls, F.lit("")).isin("", "[]"), F.when(m.role == "tool", "observation").otherwise(m.role)).otherwise("function").alias("role"),
            F.when(F.coalesce(m.tool_calls, F.lit("")).isin("", "[]"), F.coalesce(m.content, F.lit(""))).otherwise(m.tool_calls).alias("content"),
        ),
    )
    start = F.array().cast("array<struct<role:string,content:string>>")

    def step(acc: Column, m: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        merge = F.coalesce((last.role == "observation") & (m.role == "observation"), F.lit(False))
        joined = F.struct(F.lit("observation").alias("role"), F.concat(last.content, F.lit("\n"), m.content).alias("content"))
        return F.when(merge, F.array_append(F.slice(acc, 1, F.size(acc) - 1), joined)).otherwise(F.array_append(acc, m))

    return F.aggregate(named, start, step)


def _call(c: Column, arguments: str = "$.arguments") -> Column:
    return F.struct(F.get_json_object(c, "$.name").alias("name"), F.get_json_object(c, arguments).alias("arguments"))


def _named(names: Column, inputs: Column) -> Column:
    return F.zip_with(names, inputs, lambda n, i: F.struct(n.alias("name"), i.alias("arguments")))


def tool_calls(text: Column, dialect: str = "any") -> Column:
    """name and arguments (JSON) of the calls in a reply.

    tags: <tool_call>{...}</tool_call>; action: Action and Action Input lines;
    named: a name's line before an object; object: one object or a list of
    objects as the whole reply. any: tags and action.
    """
    if dialect == "object":
        body = F.regexp_extract(text, r"(?s)^\s*(?:\[TOOL_CALLS\])?\s*(\[.*\]|\{.*\})\s*$", 1)
        listed = F.coalesce(F.from_json(F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body), "array<struct<name:string,arguments:string,parameters:string>>"), F.array())
        return F.filter(F.transform(listed, lambda c: F.struct(c["name"].alias("name"), F.coalesce(c.arguments, c.parameters).alias("arguments"))), lambda c: c["name"].isNotNull())
    if dialect == "named":
        shape = r"(?s)^\s*([A-Za-z_][\w.-]*)\n(\{.*\})\s*$"
        name = F.regexp_extract(text, shape, 1)
        one = F.array(F.struct(name.alias("name"), F.regexp_extract(text, shape, 2).alias("arguments")))
        return F.filter(one, lambda c: c["name"] != "")
    tagged = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), 1), lambda c: _call(c))
    names = F.regexp_extract_all(text, F.lit(r"(?m)^Action:\s*([^\n]+?)\s*\nAction Input:\s*[^\n]*$"), 1)
    inputs = F.regexp_extract_all(text, F.lit(r"(?m)^Action:\s*[^\n]+?\s*\nAction Input:\s*([^\n]*)$"), 1)
    if dialect not in ("any", "tags", "action"):
        raise ValueError(f"unknown dialect {dialect}")
    return tagged if dialect == "tags" else _named(names, inputs) if dialect == "action" else F.concat(tagged, _named(names, inputs))


def tool_text(name: Column, description: Column, parameters: Column, dialect: str = "action") -> Column:
    """How one tool is described to a model; parameters are JSON schema text."""
    if dialect == "tags":
        return F.to_json(F.struct(F.lit("function").alias("type"), F.struct(name.alias("name"), description.alias("description"), F.get_json_object(parameters, "$").alias("parameters")).alias("function")))
    return F.concat(F.lit("> Tool Name: "), name, F.lit("\nTool Description: "), description, F.lit("\nTool Args: "), parameters, F.lit("\n"))


def block_mask(mask: Column, causal: bool = True) -> Column:
    """Rows of a packed sequence's attention: a place sees the places of its own number (up to itself), padding sees nothing."""
    return F.transform(mask, lambda own, i: F.transform(mask, lambda other, j: (own > 0) & (own == other) & ((j <= i) if causal else F.lit(True))))


def side_by_side(chosen: Column, rejected: Column, fill: int) -> Column:
    """Both sides of a preference pair, padded to the longer one."""
    width = F.greatest(F.size(chosen), F.size(rejected))
    return F.array(padded(chosen, width, fill), padded(rejected, width, fill))
