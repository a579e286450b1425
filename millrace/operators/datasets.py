"""Training sets: formats, alignment, splits, mixing, packing and blocks."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.functions.text import words
from millrace.operators.ranking import attach, ordered_position, shuffle_key, shuffled_position

MESSAGE = "struct<role:string,content:string>"


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


# Formats ------------------------------------------------------------------------------


def to_alpaca(question: Column, answer: Column) -> Column:
    return F.struct(F.coalesce(question, F.lit("")).alias("instruction"), F.lit("").alias("input"), F.coalesce(answer, F.lit("")).alias("output"))


def to_sharegpt(question: Column, answer: Column) -> Column:
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.coalesce(c, F.lit("")).alias("value"))
    return F.struct(F.array(turn("human", question), turn("gpt", answer)).alias("conversations"))


def to_dpo(question: Column, answer: Column, rejected: Column) -> Column:
    return F.struct(F.coalesce(question, F.lit("")).alias("instruction"), F.lit("").alias("input"), F.coalesce(answer, F.lit("")).alias("chosen"), F.coalesce(rejected, F.lit("")).alias("rejected"))


def align_alpaca(df: DataFrame, prompt: str = "instruction", query: str = "input", response: str = "output", system: str | None = None, history: str | None = None, chosen: str | None = None, rejected: str | None = None, kto: str | None = None) -> DataFrame:
    """_prompt, _response, _system: history first, then prompt and query by a new line; preference and feedback rows have two responses."""
    turns = F.array().cast(f"array<{MESSAGE}>")
    if history:
        turns = F.flatten(F.transform(F.coalesce(F.col(history), F.array().cast("array<array<string>>")), lambda h: F.array(_message("user", h[0]), _message("assistant", h[1]))))
    text = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    asked = F.array_join(F.filter(F.array(text(prompt), text(query)), lambda x: x.isNotNull()), "\n")
    if chosen:
        answer = F.array(_message("assistant", F.col(chosen)), _message("assistant", F.col(rejected)))
    elif kto:
        good, none = _message("assistant", F.col(response)), _message("assistant", F.lit(""))
        answer = F.when(F.col(kto), F.array(good, none)).otherwise(F.array(none, good))
    else:
        answer = F.when(F.col(response).isNotNull(), F.array(_message("assistant", F.col(response)))).otherwise(F.array().cast(f"array<{MESSAGE}>"))
    return df.withColumn("_prompt", F.concat(turns, F.array(_message("user", asked)))).withColumn("_response", answer).withColumn("_system", F.col(system) if system else F.lit(""))


def align(df: DataFrame, formatting: str, **columns: str) -> DataFrame:
    """Rows of a registered formatting as _prompt, _response and _system."""
    if formatting not in CONVERTERS:
        raise ValueError(f"unknown formatting {formatting}, known are {sorted(CONVERTERS)}")
    return CONVERTERS[formatting](df, **columns)


def align_messages(df: DataFrame, messages: str = "messages") -> DataFrame:
    """_prompt, _response and _system of a column of role and content."""
    found = align_turns(F.col(messages))
    return df.withColumn("_a", found).select("*", F.col("_a.prompt").alias("_prompt"), F.col("_a.response").alias("_response"), F.col("_a.system").alias("_system")).drop("_a")


def align_turns(messages: Column) -> Column:
    """prompt, response, system of a list of role and content: a leading system message is taken off; broken alternation gives empty lists.

    User and assistant must alternate from user, and end on an assistant.
    """
    starts = F.coalesce(F.try_element_at(messages, F.lit(1)).role == "system", F.lit(False))
    system = F.when(starts, F.element_at(messages, 1).content).otherwise("")
    rest = F.when(starts, F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    sound = (F.size(rest) > 0) & (F.size(rest) % 2 == 0) & F.forall(F.transform(rest, lambda m, i: m.role == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda ok: ok)
    none = F.array().cast(f"array<{MESSAGE}>")
    return F.struct(F.when(sound, F.slice(rest, 1, F.size(rest) - 1)).otherwise(none).alias("prompt"), F.when(sound, F.slice(rest, -1, 1)).otherwise(none).alias("response"), system.alias("system"))


#: Converters by formatting; callers may add their own.
CONVERTERS: dict[str, Callable[..., DataFrame]] = {"alpaca": align_alpaca, "sharegpt": align_messages, "openai": align_messages}


def valid_example(prompt: Column, response: Column, stage: str) -> Column:
    """An odd prompt, and one response (sft, kto: two for rm and kto)."""
    odd = F.size(prompt) % 2 == 1
    return odd & (F.size(response) >= 2 if stage in ("rm", "kto") else F.size(response) == 1)


#: Prefix and suffix of each role in a few public chat templates.
CHAT_TEMPLATES = {
    "chatml": {"system": ("<|im_start|>system\n", "<|im_end|>\n"), "user": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"), "assistant": ("", "<|im_end|>\n")},
    "llama2": {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")},
    "alpaca": {"system": ("", "\n\n"), "user": ("### Instruction:\n", "\n\n### Response:\n"), "assistant": ("", "\n\n")},
    "llama3": {
        "system": ("<|start_header_id|>system<|end_header_id|>\n\n", "<|eot_id|>"),
        "user": ("<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"), "assistant": ("", "<|eot_id|>"),
    },
    "mistral": {"system": ("", "\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")},
    "gemma": {"system": ("", "\n\n"), "user": ("<start_of_turn>user\n", "<end_of_turn>\n<start_of_turn>model\n"), "assistant": ("", "<end_of_turn>\n")},
    "vicuna": {"system": ("", " "), "user": ("USER: ", " ASSISTANT:"), "assistant": (" ", "</s>")},
    "zephyr": {"system": ("<|system|>\n", "</s>\n"), "user": ("<|user|>\n", "</s>\n<|assistant|>\n"), "assistant": ("", "</s>\n")},
    "phi3": {"system": ("<|system|>\n", "<|end|>\n"), "user": ("<|user|>\n", "<|end|>\n<|assistant|>\n"), "assistant": ("", "<|end|>\n")},
    "chatglm3": {"system": ("<|system|>\n", ""), "user": ("<|user|>\n", "<|assistant|>\n"), "assistant": ("", "")},
    "plain": {"system": ("", "\n"), "user": ("User: ", "\nAssistant: "), "assistant": ("", "\n")},
}


def render_chat(messages: Column, template: str) -> Column:
    """The text that a chat template makes of messages."""
    slots = CHAT_TEMPLATES[template]
    wrap = lambda m, role: F.concat(F.lit(slots[role][0]), m.content, F.lit(slots[role][1]))
    return F.array_join(F.transform(messages, lambda m: F.when(m.role == "system", wrap(m, "system")).when(m.role == "assistant", wrap(m, "assistant")).otherwise(wrap(m, "user"))), "")


# Splits and mixing ---------------------------------------------------------------------


def split_random(df: DataFrame, id_col: str, train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """split: train, val or test by place in the shuffled order; what rounding leaves over is test."""
    whole = train + val + test
    if whole <= 0 or min(train, val, test) < 0:
        raise ValueError("ratios must not be negative and must have a positive sum")
    ranked = shuffled_position(df, id_col, seed, total="_total")
    train_end = F.floor(F.col("_total") * F.lit(train / whole))
    val_end = train_end + F.floor(F.col("_total") * F.lit(val / whole))
    return ranked.withColumn("split", F.when(F.col("position") < train_end, "train").when(F.col("position") < val_end, "val").otherwise("test")).drop("_total", "position")


def split_by_group(df: DataFrame, group: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Whole groups in shuffled order: a group's rows before it decide its split. Works on one row a group, then joins back."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_key", shuffle_key(group, seed)).withColumn("_b", F.substring("_key", 1, 2))
    buckets = sizes.groupBy("_b").agg(F.sum("_n").alias("_bn"))
    ahead = W.Window.orderBy("_b").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = buckets.select("_b", F.coalesce(F.sum("_bn").over(ahead), F.lit(0)).alias("_off"), F.sum("_bn").over(W.Window.partitionBy()).alias("_total"))
    own = W.Window.partitionBy("_b").orderBy("_key", group).rowsBetween(W.Window.unboundedPreceding, -1)
    placed = sizes.join(offsets, "_b").withColumn("_before", F.col("_off") + F.coalesce(F.sum("_n").over(own), F.lit(0)))
    train_target = F.floor(F.col("_total") * train)
    val_target = F.floor(F.col("_total") * val)
    named = placed.select(group, F.when(F.col("_before") < train_target, "train").when(F.col("_before") < train_target + val_target, "val").otherwise("test").alias("split"))
    return df.join(named, group)


def merged_splits(train: DataFrame, **validation: DataFrame) -> DataFrame:
    """One table of named splits: train, and validation_<name> for each further set."""
    out = train.withColumn("split", F.lit("train"))
    for name, df in validation.items():
        out = out.unionByName(df.withColumn("split", F.lit(f"validation_{name}")), allowMissingColumns=True)
    return out


def interleave(df: DataFrame, source: str, id_col: str, stop: str = "first") -> DataFrame:
    """Round robin over sources: n_th rows of each source side by side. ``first`` ends with the shortest source, ``all`` with the longest."""
    ranked = ordered_position(df, id_col, [source], "turn", "_rows")
    if stop == "first":
        least = df.groupBy(source).count().agg(F.min("count").alias("_least"))
        ranked = attach(ranked, least).where(F.col("turn") < F.col("_least")).drop("_least")
    return ranked.drop("_rows")


def mix_weighted(df: DataFrame, source: str, id_col: str, weights: dict[str, float], rows: int) -> DataFrame:
    """floor(weight * rows) rows of each source in id order."""
    quota = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, int(v / sum(weights.values()) * rows))])
    return ordered_position(df, id_col, [source], "turn").where(F.col("turn") < quota[F.col(source)])


def resample(df: DataFrame, id_col: str, rows: int, seed: int = 42) -> DataFrame:
    """Exactly ``rows`` rows: a shuffled order first, then repeats of it from its start."""
    ranked = shuffled_position(df, id_col, seed, total="_total")
    times = F.floor((F.lit(rows) - 1 - F.col("position")) / F.col("_total")) + 1
    return ranked.where(F.col("position") < rows).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times.cast("long") - 1))).drop("_total")


def few_shot(df: DataFrame, support: DataFrame, key: str, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """target_id, shot, support_id: k support rows of the same key, drawn anew for each target, which isn't its own support; all of them where there are fewer.

    A key's support has shuffled places. Each target cuts them, from a place of
    its own, into k + 1 stretches and draws one place of each, so that a draw is
    an equi-join on single places, however frequent a key is.
    """
    draws = F.least(F.lit(k + 1).cast("long"), F.col("_n"))
    at = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")
    pool = shuffled_position(support.select(F.col(id_col).alias("support_id"), F.col(key).alias("_k")), "support_id", seed, ["_k"], "_place")
    sizes = support.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    name = F.col("target_id").cast("string")
    target = df.select(F.col(id_col).alias("target_id"), F.col(key).alias("_k")).join(sizes, "_k")
    drawn = target.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), draws - 1)))
    low, high = F.floor(F.col("_n") * F.col("_j") / draws), F.floor(F.col("_n") * (F.col("_j") + 1) / draws)
    drawn = drawn.withColumn("_place", F.pmod(at(name) + low + F.pmod(at(name, F.col("_j").cast("string")), high - low), F.col("_n")))
    own = W.Window.partitionBy("target_id").orderBy("_j")
    pairs = drawn.join(pool, ["_k", "_place"]).where("target_id <> support_id").withColumn("shot", F.row_number().over(own)).where(F.col("shot") <= k)
    return pairs.select("target_id", "shot", "support_id")


# Token sequences -----------------------------------------------------------------------


def rotate_in_batches(df: DataFrame, order: str, value: str, out: str, size: int = 1000) -> DataFrame:
    """Each row's value replaced by that of the row before in its batch; the first takes the batch's last."""
    batched = ordered_position(df, order, out="batch").withColumn("batch", F.floor(F.col("batch") / size))
    w = W.Window.partitionBy("batch").orderBy(order)
    whole = w.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    return batched.withColumn(out, F.coalesce(F.lag(value).over(w), F.last(value).over(whole)))


def pretrain_blocks(df: DataFrame, id_col: str, text_col: str, block: int, eos: str = "<eos>", batch_rows: int = 1000) -> DataFrame:
    """batch, block, tokens: texts of a batch end to end with an end mark each, cut into blocks; the batch's remainder is dropped.

    Rows carry slices, not single tokens: one for each document and block that touch.
    """
    placed = ordered_position(df.select(id_col, text_col), id_col, out="_at")
    own = placed.select(F.floor(F.col("_at") / batch_rows).alias("batch"), F.col(id_col).alias("_id"), F.concat(words(F.coalesce(F.col(text_col), F.lit(""))), F.array(F.lit(eos))).alias("_t"))
    w = W.Window.partitionBy("batch").orderBy("_id")
    n = F.size("_t")
    own = own.withColumn("_off", F.sum(n).over(w.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)) - n)
    own = own.withColumn("block", F.explode(F.sequence(F.floor(F.col("_off") / block), F.floor((F.col("_off") + F.size("_t") - 1) / block))))
    first = F.greatest(F.col("block") * block - F.col("_off"), F.lit(0))
    last = F.least((F.col("block") + 1) * block - F.col("_off"), F.size("_t"))
    parts = own.select("batch", "block", "_id", F.slice("_t", (first + 1).cast("int"), (last - first).cast("int")).alias("_p"))
    joined = parts.groupBy("batch", "block").agg(F.array_sort(F.collect_list(F.struct("_id", "_p"))).alias("_ps"))
    return joined.select("batch", "block", F.flatten(F.transform("_ps", lambda p: p._p)).alias("tokens")).where(F.size("tokens") == block)


def pretrain_rows(df: DataFrame, text_col: str, cutoff: int, eos: str = "<eos>", bos: str | None = None) -> DataFrame:
    """TRN13 without packing: tokens of each text and its end mark, cut off at so many; a null text is the end mark alone. Nothing is shuffled."""
    if cutoff < 1:
        raise ValueError("the cutoff is at least one token")
    marks = [F.array(F.lit(bos))] if bos else []
    return df.withColumn("tokens", F.slice(F.concat(*marks, words(F.coalesce(F.col(text_col), F.lit(""))), F.array(F.lit(eos))), 1, cutoff))


def knapsack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Greedy packing, longest first into what is left; positions of the given lengths, each once if it fits at all."""
    order = sorted((n, i) for i, n in enumerate(lengths) if n <= capacity)
    out: list[list[int]] = []
    while order:
        room, pack = capacity, []
        while order and (at := bisect.bisect_right(order, (room, len(lengths)))):
            n, i = order.pop(at - 1)
            pack.append(i)
            room -= n
        out.append(pack)
    return out


def pack_sequences(df: DataFrame, id_col: str, length: str, capacity: int, batch_rows: int = 1000) -> DataFrame:
    """batch, pack, position, id: sequences packed within batches of rows by id; longer ones than the capacity go."""
    kind = dict(df.dtypes)[id_col]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        packs = knapsack(pdf["n"].tolist(), capacity)
        rows = [(pdf["batch"].iloc[0], p, k, pdf["id"].iloc[i], pdf["n"].iloc[i]) for p, members in enumerate(packs) for k, i in enumerate(members)]
        return pd.DataFrame(rows, columns=["batch", "pack", "position", "id", "n"])

    placed = ordered_position(df.select(id_col, length), id_col, out="_at")
    rows = placed.select(F.floor(F.col("_at") / batch_rows).alias("batch"), F.col(id_col).alias("id"), F.col(length).cast("long").alias("n"))
    return rows.groupBy("batch").applyInPandas(run, f"batch long, pack int, position int, id {kind}, n long")


def encode_supervised(df: DataFrame, tokenizer: Callable[[str], list[int]], cutoff: int, eos: int, ignore: int = -100, train_on_prompt: bool = False, mask_history: bool = False) -> DataFrame:
    """input_ids and labels of _prompt and _response: turn by turn within the cutoff, prompts masked."""
    from millrace.operators.budget import infer_lengths

    @F.pandas_udf("struct<input_ids:array<int>,labels:array<int>>")
    def run(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for prompts, responses, systems in it:
            rows = []
            for p, r, s in zip(prompts, responses, systems, strict=True):
                turns = [*p, *r]
                ids: list[int] = []
                labels: list[int] = []
                room = cutoff - 1
                pairs = list(zip(turns[::2], turns[1::2], strict=False))
                for k, (a, b) in enumerate(reversed(pairs) if mask_history else pairs):
                    first = k == (len(pairs) - 1 if mask_history else 0)
                    source = tokenizer((s + "\n" if s and first else "") + a["content"])
                    target = tokenizer(b["content"])
                    if room <= 0:
                        break
                    ns, nt = infer_lengths(len(source), len(target), room)
                    source, target = source[:ns], target[:nt]
                    room -= ns + nt
                    own = source if train_on_prompt else [ignore] * ns
                    goal = [ignore] * nt if mask_history and k else target
                    ids, labels = ((source + target + ids), (own + goal + labels)) if mask_history else ((ids + source + target), (labels + own + goal))
                rows.append(([*ids, eos], [*labels, eos]))
            yield pd.DataFrame(rows, columns=["input_ids", "labels"])

    return df.withColumn("_e", run("_prompt", "_response", F.coalesce("_system", F.lit("")))).select("*", "_e.input_ids", "_e.labels").drop("_e")


def first_rows(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The first rows by id."""
    return df.orderBy(id_col).limit(rows)
