"""Queries of alignment and token encodings. The tokenizer gives each word its length, so that SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.operators import datasets, encode, jobs
from millrace.plans.registry import query
from millrace.session import table


def _lengths(text: str) -> list[int]:
    return [len(w) for w in text.split()]


_PAIRS = r"""p AS (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
t AS (SELECT conv_id, turn, list_transform(list_filter(string_split_regex(q, '\s+'), lambda x: x <> ''), lambda x: length(x)) AS s, list_transform(list_filter(string_split_regex(a, '\s+'), lambda x: x <> ''), lambda x: length(x)) AS t FROM p WHERE q IS NOT NULL AND a IS NOT NULL)"""


def _budget(source: str, target: str, cutoff: int) -> tuple[str, str]:
    most = f"CASE WHEN {target} * 2 < {cutoff} THEN {cutoff} WHEN {source} * 2 < {cutoff} THEN {cutoff} - {source} ELSE CAST(floor({cutoff} * ({target} / ({source} + {target}))) AS INTEGER) END"
    kept = f"least({most}, {target})"
    return f"least(greatest({cutoff} - {kept}, 0), {source})", kept


def _turns(spark, sf_dir):
    nxt = F.lead("text").over(W.Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", nxt.alias("answer")).where("text is not null and answer is not null")


def _joined(*names):
    return [F.array_join(F.transform(n, lambda x: x.cast("string")), ",").alias(n) for n in names]


_NS, _NT = _budget("len(s)", "len(t)", 63)
_REPEAT = "list_transform(range(0, {n}), lambda i: -100)"


@query(f"""WITH {_PAIRS}, b AS (SELECT *, s[1 : {_NS}] AS si, t[1 : {_NT}] AS ti FROM t)
SELECT conv_id, turn, array_to_string(si || ti || [2], ',') AS input_ids, array_to_string({_REPEAT.format(n='len(si)')} || ti || [2], ',') AS labels FROM b""")
def encode_supervised(spark, sf_dir):
    """TRN1, TRN8: aligned pairs as ids and labels within 64 tokens."""
    rows = datasets.align_alpaca(_turns(spark, sf_dir).withColumn("none", F.lit("")), prompt="text", query="none", response="answer")
    return datasets.encode_supervised(rows, _lengths, 64, 2).select("conv_id", "turn", *_joined("input_ids", "labels"))


_PS, _PT = _budget("len(s)", "(len(t) + 1)", 48)


@query(f"""WITH {_PAIRS} SELECT conv_id, turn, array_to_string(s[1 : {_PS}], ',') AS input_ids, array_to_string((t || [2])[1 : {_PT}], ',') AS labels FROM t""")
def encode_prompts(spark, sf_dir):
    """TRN12: prompts and responses apart, for prediction."""
    rows = datasets.align_alpaca(_turns(spark, sf_dir).withColumn("none", F.lit("")), prompt="text", query="none", response="answer")
    return encode.encode_prompts(rows, _lengths, 48, 2).select("conv_id", "turn", *_joined("input_ids", "labels"))


_WS, _WT = _budget("len(s)", "(len(t) + 1)", 48)


@query(f"""WITH {_PAIRS}, b AS (SELECT *, {_WS} AS ns, {_WT} AS nt, t[1 : 2] || [2] AS r FROM t)
SELECT conv_id, turn, array_to_string(s[1 : ns] || (t || [2])[1 : nt], ',') AS chosen_input_ids, array_to_string({_REPEAT.format(n='least(ns, len(s))')} || (t || [2])[1 : nt], ',') AS chosen_labels,
  array_to_string(s[1 : ns] || r[1 : nt], ',') AS rejected_input_ids, array_to_string({_REPEAT.format(n='least(ns, len(s))')} || r[1 : nt], ',') AS rejected_labels FROM b""")
def encode_pairwise(spark, sf_dir):
    """TRN10: preference pairs, the rejected response being the first two words of the chosen one."""
    rows = _turns(spark, sf_dir).withColumn("none", F.lit("")).withColumn("worse", F.array_join(F.slice(F.filter(F.split("answer", r"(?U)\s+"), lambda x: x != ""), 1, 2), " "))
    rows = datasets.align_alpaca(rows, prompt="text", query="none", chosen="answer", rejected="worse")
    return encode.encode_pairwise(rows, _lengths, 48, 2).select("conv_id", "turn", *_joined("chosen_input_ids", "chosen_labels", "rejected_input_ids", "rejected_labels"))


_KS, _KT = _budget("len(s)", "(len(k) + 1)", 48)


@query(f"""WITH {_PAIRS}, u AS (SELECT *, s AS k FROM t)
SELECT conv_id, turn, array_to_string(s[1 : {_WS}] || (t || [2])[1 : {_WT}], ',') AS input_ids, array_to_string(s[1 : {_KS}] || (k || [2])[1 : {_KT}], ',') AS kl_input_ids,
  array_to_string({_REPEAT.format(n=_KS)} || (k || [2])[1 : {_KT}], ',') AS kl_labels, turn % 2 = 0 AS kto_tag FROM u""")
def encode_feedback(spark, sf_dir):
    """TRN11: feedback rows with a mismatched response, here the prompt itself."""
    rows = _turns(spark, sf_dir).withColumn("none", F.lit("")).withColumn("good", F.col("turn") % 2 == 0)
    rows = datasets.align_alpaca(rows, prompt="text", query="none", response="answer", kto="good").withColumn("kl_text", F.col("text"))
    return encode.encode_feedback(rows, _lengths, 48, 2).select("conv_id", "turn", *_joined("input_ids", "kl_input_ids", "kl_labels"), "kto_tag")


@query("""WITH m AS (SELECT user_id, event_id % 4 AS n, count(*) AS k FROM events GROUP BY ALL), a AS (SELECT user_id, list(n ORDER BY n) AS ns, list(k ORDER BY n) AS ks FROM m WHERE n > 0 GROUP BY user_id)
SELECT user_id, '0,' || array_to_string(list_transform(range(1, len(ks) + 1), lambda i: CAST(list_sum(ks[1 : i]) AS BIGINT)), ',') AS lengths, CAST((SELECT sum(k) FROM m WHERE m.user_id = a.user_id) AS INTEGER) AS places,
  CAST(list_sum(list_transform(ks, lambda k: k * (k + 1) // 2)) AS BIGINT) AS seen FROM a""")
def packed_masks(spark, sf_dir):
    """TRN22-23: cumulative lengths of packed sequences, and how many places their block-diagonal mask lets see each other."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list((F.col("event_id") % 4).cast("int"))).alias("m"))
    one = lambda row: F.size(F.filter(row, lambda x: x))
    seen = F.aggregate(encode.block_mask(F.col("m")), F.lit(0).cast("long"), lambda n, row: n + one(row))
    return rows.select("user_id", F.array_join(F.transform(encode.packed_lengths(F.col("m")), lambda x: x.cast("string")), ",").alias("lengths"), F.size("m").alias("places"), seen.alias("seen"))


@query("""SELECT conv_id, turn, greatest(length(text), length(role)) AS width, greatest(length(text), length(role)) - least(length(text), length(role)) AS filled FROM conversations WHERE text IS NOT NULL""")
def padded_pairs(spark, sf_dir):
    """TRN22: both sides of a pair brought to one width."""
    chars = lambda c: F.transform(F.split(c, ""), lambda x: F.lit(7))
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", encode.side_by_side(chars("text"), chars("role"), 0).alias("s"))
    return rows.select("conv_id", "turn", F.size(F.col("s")[0]).cast("long").alias("width"), F.size(F.filter(F.flatten("s"), lambda x: x == 0)).cast("long").alias("filled"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'weather' WHEN 1 THEN 'search' ELSE 'none' END AS name, CASE turn % 3 WHEN 0 THEN '{"n":' || turn || '}' WHEN 1 THEN '{"q": ' || turn || '}' ELSE '' END AS arguments FROM conversations""")
def tool_replies(spark, sf_dir):
    """TRN17: calls read from replies in two dialects."""
    n = F.col("turn").cast("string")
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('I will.\n<tool_call>\n{"name": "weather", "arguments": {"n":'), n, F.lit("}}\n</tool_call>"))).when(F.col("turn") % 3 == 1, F.concat(F.lit('Action: search\nAction Input: {"q": '), n, F.lit("}"))).otherwise("no call")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.try_element_at(encode.tool_calls(reply), F.lit(1)).alias("c"))
    return rows.select("conv_id", "turn", F.coalesce("c.name", F.lit("none")).alias("name"), F.coalesce("c.arguments", F.lit("")).alias("arguments"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 5 IN (1, 3) THEN role ELSE 'say_' || role END AS name, text AS said, '}' || role || '{' AS inner_text, CASE WHEN conv_id % 5 IN (1, 3) THEN 1 ELSE 1 + turn % 2 END AS n FROM conversations WHERE text IS NOT NULL""")
def nested_tool_calls(spark, sf_dir):
    """TRN17: messages as arguments of calls in five dialects, in objects inside objects with brackets in their strings, read back."""
    from millrace.operators.calls import nested_calls

    rows = table(spark, sf_dir, "conversations").where("text is not null")
    arguments = F.struct(F.struct(F.col("text").alias("said"), F.array(F.struct(F.concat(F.lit("}"), "role", F.lit("{")).alias("t"))).alias("parts")).alias("body"))
    both = lambda one: F.when(F.col("turn") % 2 == 1, F.concat(one, F.lit("\n"), one)).otherwise(one)
    name = F.concat(F.lit("say_"), "role")
    plain = F.to_json(arguments)
    replies = {
        "tags": both(F.concat(F.lit("I call:\n<tool_call>\n"), F.to_json(F.struct(name.alias("name"), arguments.alias("arguments"))), F.lit("\n</tool_call>"))),
        "named": F.concat("role", F.lit("\n"), plain),
        "action": both(F.concat(F.lit("Action: "), name, F.lit("\nAction Input: "), plain)),
        "function": F.concat(F.lit("<function="), F.col("role"), F.lit(">"), plain, F.lit("</function>")),
        "object": both(F.to_json(F.struct(name.alias("name"), arguments.alias("parameters")))),
    }
    found = [F.when(F.col("conv_id") % 5 == k, nested_calls(reply, dialect)) for k, (dialect, reply) in enumerate(replies.items())]
    calls = rows.select("conv_id", "turn", F.coalesce(*found).alias("c")).select("conv_id", "turn", F.element_at("c", -1).alias("c"), F.size("c").alias("n"))
    part = lambda path: F.get_json_object("c.arguments", path)
    return calls.select("conv_id", "turn", "c.name", part("$.body.said").alias("said"), part("$.body.parts[0].t").alias("inner_text"), F.col("n").cast("long").alias("n"))


@query("""WITH s AS (SELECT p_partkey, p_name, CAST(greatest(20 + p_partkey * 37 % 4000, 28) AS DOUBLE) AS w, CAST(greatest(20 + p_size * 53, 28) AS DOUBLE) AS h FROM part),
g AS (SELECT *, greatest(round_even(w / 28, 0), 1) AS a, greatest(round_even(h / 28, 0), 1) AS b FROM s),
t AS (SELECT p_partkey, p_name, CAST(CASE WHEN a * b * 784 > 1003520 THEN greatest(floor(w / sqrt(w * h / 1003520) / 28), 1) * greatest(floor(h / sqrt(w * h / 1003520) / 28), 1)
  WHEN a * b * 784 < 3136 THEN ceil(w / sqrt(w * h / 3136) / 28) * ceil(h / sqrt(w * h / 3136) / 28) ELSE a * b END AS BIGINT) AS tokens FROM g)
SELECT p_partkey, tokens, p_name || ' [' || repeat('*', CAST(tokens AS INTEGER)) || '].' AS text FROM t""")
def media_grids(spark, sf_dir):
    """TRN18: an image of each part's size as tokens of a patch grid, put in place of its mark."""
    from millrace.sources.images import expanded, grid_tokens

    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", grid_tokens(20 + F.col("p_partkey") * 37 % 4000, 20 + F.col("p_size") * 53).alias("tokens"))
    return rows.select("p_partkey", "tokens", expanded(F.concat("p_name", F.lit(" <image>.")), "<image>", "*", F.array("tokens"), "[", "]").alias("text"))


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'function' WHEN turn % 4 IN (2, 3) THEN 'observation' ELSE 'user' END AS role, CASE WHEN turn % 4 = 1 THEN '[{"name":"f"}]' ELSE text END AS content FROM conversations WHERE text IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN role = 'observation' AND before = 'observation' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM r))
SELECT conv_id, CAST(n - 1 AS INTEGER) AS position, min(role) AS role, string_agg(content, chr(10) ORDER BY turn) AS content FROM g GROUP BY conv_id, n""")
def tool_messages(spark, sf_dir):
    """TRN3: calls become function messages, adjacent tool replies one observation."""
    k = F.col("turn") % 4
    row = F.struct("turn", F.when(k == 0, "user").when(k == 1, "assistant").otherwise("tool").alias("role"), F.col("text").alias("content"), F.when(k == 1, '[{"name":"f"}]').otherwise("").alias("tool_calls"))
    rows = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("ms"))
    return rows.select("conv_id", F.posexplode(encode.align_tool_messages(F.col("ms"))).alias("position", "m")).select("conv_id", "position", "m.*")


@query("""SELECT page_id, 'data/media/' || page_id || '.png' AS first, url AS second FROM pages""")
def media_locations(spark, sf_dir):
    """TRN4: relative media paths inside the dataset's folder, addresses as they are."""
    paths = F.array(F.concat(F.lit("media/"), F.col("page_id").cast("string"), F.lit(".png")), "url")
    return table(spark, sf_dir, "pages").select("page_id", jobs.media_paths(paths, "data/").alias("p")).select("page_id", F.col("p")[0].alias("first"), F.col("p")[1].alias("second"))


@query("""SELECT 'train' AS split, count(*) AS n, min(lang) AS lang FROM documents UNION ALL SELECT 'validation_benchmark', count(*), NULL FROM benchmark UNION ALL SELECT 'validation_labels', count(*), NULL FROM labels""")
def named_splits(spark, sf_dir):
    """SET5: a training set and named validation sets as one table."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    out = datasets.merged_splits(docs, benchmark=table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), labels=table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))
    return out.groupBy("split").agg(F.count("*").alias("n"), F.min("lang").alias("lang"))


@query("""WITH m AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS ms FROM conversations GROUP BY conv_id), r AS (SELECT conv_id, CASE WHEN ms[1].role = 'system' THEN ms[2:] ELSE ms END AS rest FROM m)
SELECT conv_id, CASE WHEN len(rest) > 0 AND len(rest) % 2 = 0 AND len(list_filter(rest, lambda x, i: x.role <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0 THEN len(rest) - 1 ELSE 0 END AS n_prompt, 'supervised,pairwise,feedback' AS kinds FROM r""")
def registered_formats(spark, sf_dir):
    """TRN5, 20, 21: rows by the converter of their formatting, and the encoding of each stage."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("messages"))
    kinds = ",".join(jobs.rows_for(stage, ranking) for stage, ranking in (("sft", False), ("dpo", True), ("kto", False)))
    return datasets.align(rows, "openai", messages="messages").select("conv_id", F.size("_prompt").cast("long").alias("n_prompt"), F.lit(kinds).alias("kinds"))


@query("SELECT sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) * 3.0::DOUBLE / 60.0::DOUBLE AS tokens_per_second FROM conversations WHERE text IS NOT NULL")
def training_throughput(spark, sf_dir):
    """AGG18: tokens a second of a run of three epochs in a minute."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "").alias("ids"))
    return jobs.tokens_per_second(rows, "ids", 3.0, 60.0)
