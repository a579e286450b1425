"""Queries that make training sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.functions.text import sequence_budget, word_count
from millrace.operators import datasets, metrics
from millrace.plans.registry import query
from millrace.session import table

_KEYED = "SELECT doc_id, lang, source, md5(concat('42', doc_id)) AS k FROM documents"


@query(f"""SELECT doc_id, CASE WHEN p < floor(n * 0.8) THEN 'train' WHEN p < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM (
  SELECT doc_id, row_number() OVER (ORDER BY k, doc_id) - 1 AS p, count(*) OVER () AS n FROM ({_KEYED}))""")
def split_random(spark, sf_dir):
    """SMP2: a split by place in the hashed order."""
    return datasets.split_random(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""WITH g AS (SELECT source, count(*) AS n, md5(concat('42', source)) AS k FROM documents GROUP BY source),
b AS (SELECT source, coalesce(sum(n) OVER (ORDER BY k, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM g)
SELECT doc_id, CASE WHEN before < floor(total * 0.8) THEN 'train' WHEN before < floor(total * 0.8) + floor(total * 0.1) THEN 'val' ELSE 'test' END AS split FROM documents JOIN b USING (source)""")
def split_by_file(spark, sf_dir):
    """SMP3, WIN11: whole sources in one split."""
    return datasets.split_by_group(table(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", "split")


@query(f"""SELECT lang, CASE WHEN p < n - floor(n * 0.1) THEN 'train' ELSE 'validation' END AS split, count(*) AS rows FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY k, doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM ({_KEYED})) GROUP BY 1, 2""")
def split_validation(spark, sf_dir):
    """SMP4: a tenth of each language for validation."""
    from millrace.operators.ranking import shuffled_position

    ranked = shuffled_position(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", within=["lang"], total="n")
    return ranked.withColumn("split", F.when(F.col("position") < F.col("n") - F.floor(F.col("n") * F.lit(0.1)), "train").otherwise("validation")).groupBy("lang", "split").agg(F.count("*").alias("rows"))


@query("""SELECT doc_id, lang, r - 1 AS turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents)
  WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))""")
def mix_interleave(spark, sf_dir):
    """SET2: languages in turn until the rarest ends."""
    return datasets.interleave(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", "turn")


@query("""SELECT doc_id, lang, r - 1 AS turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents)
  WHERE r <= CASE lang WHEN 'en' THEN 100 WHEN 'fr' THEN 60 WHEN 'de' THEN 40 ELSE 0 END""")
def mix_weighted(spark, sf_dir):
    """SET2: rows of each language by weight."""
    return datasets.mix_weighted(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 0.5, "fr": 0.3, "de": 0.2}, 200).select("doc_id", "lang", "turn")


@query("SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark")
def mix_concat(spark, sf_dir):
    """SET1: aligned sets one after the other."""
    a = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), "text"))


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY k, doc_id) - 1 AS position, count(*) OVER () AS n FROM ({_KEYED}))
SELECT doc_id, position, unnest(range(0, ((25000 - 1 - position) // n + 1)::BIGINT)) AS copy FROM r WHERE position < 25000""")
def resample(spark, sf_dir):
    """SMP1: exactly 25,000 rows, repeats after the whole order."""
    return datasets.resample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 25_000).select("doc_id", "position", "copy")


@query(f"""WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY k, doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM ({_KEYED}) WHERE lang IS NOT NULL),
d AS (SELECT doc_id, lang, n, least(4, n) AS m, unnest(range(0, least(4, n))) AS j FROM s),
h AS (SELECT *, n * j // m AS low, n * (j + 1) // m AS high, ('0x' || substr(md5('42-' || doc_id), 1, 15))::BIGINT AS a, ('0x' || substr(md5('42-' || doc_id || '-' || j), 1, 15))::BIGINT AS b FROM d),
p AS (SELECT h.doc_id AS target_id, s.doc_id AS support_id, j FROM h JOIN s ON s.lang = h.lang AND s.place = (a + low + b % (high - low)) % h.n WHERE s.doc_id <> h.doc_id)
SELECT target_id, shot, support_id FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY j) AS shot FROM p) WHERE shot <= 3""")
def few_shot(spark, sf_dir):
    """SMP5: three support documents of its language for each document, drawn anew for each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return datasets.few_shot(docs, docs, "lang", "doc_id", 3)


@query("""WITH m AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS ms FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, CASE WHEN ms[1].role = 'system' THEN ms[1].content ELSE '' END AS system, CASE WHEN ms[1].role = 'system' THEN ms[2:] ELSE ms END AS rest FROM m),
s AS (SELECT *, len(rest) > 0 AND len(rest) % 2 = 0 AND len(list_filter(rest, lambda x, i: x.role <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0 AS sound FROM r)
SELECT conv_id, system, sound AS valid, CASE WHEN sound THEN len(rest) - 1 ELSE 0 END AS n_prompt, CASE WHEN sound THEN rest[len(rest)].content ELSE '' END AS response FROM s""")
def align_sharegpt(spark, sf_dir):
    """TRN2, TRN7: turns to prompt and response; broken alternation gives neither."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("ms")).select("conv_id", datasets.align_turns(F.col("ms")).alias("a"))
    return rows.select("conv_id", "a.system", datasets.valid_example(F.col("a.prompt"), F.col("a.response"), "sft").alias("valid"), F.size("a.prompt").cast("long").alias("n_prompt"), F.coalesce(F.try_element_at("a.response", F.lit(1)).content, F.lit("")).alias("response"))


@query("""WITH m AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations)
SELECT conv_id, turn, text AS instruction, '' AS input, coalesce(answer, '') AS output, 'human' AS first_from, text AS first_value, 'gpt' AS second_from, coalesce(answer, '') AS second_value, '' AS rejected FROM m WHERE role = 'user'""")
def to_formats(spark, sf_dir):
    """TRN6: user turns and their answers in the three export formats."""
    nxt = F.lead("text").over(W.Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("answer", nxt).where("role = 'user'")
    rows = rows.select("conv_id", "turn", datasets.to_alpaca(F.col("text"), F.col("answer")).alias("a"), datasets.to_sharegpt(F.col("text"), F.col("answer")).conversations.alias("s"), datasets.to_dpo(F.col("text"), F.col("answer"), F.lit(None)).alias("d"))
    return rows.select("conv_id", "turn", "a.*", F.col("s")[0]["from"].alias("first_from"), F.col("s")[0]["value"].alias("first_value"), F.col("s")[1]["from"].alias("second_from"), F.col("s")[1]["value"].alias("second_value"), "d.rejected")


@query(r"""SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '<|im_start|>system' || chr(10) || text || '<|im_end|>' || chr(10) WHEN 'assistant' THEN text || '<|im_end|>' || chr(10)
  ELSE '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) END, '' ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id""")
def render_chat(spark, sf_dir):
    """TRN14-16: conversations in a chat template."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("ms")).select("conv_id", datasets.render_chat(F.col("ms"), "chatml").alias("prompt"))


@query("""WITH m AS (SELECT conv_id, turn, role, text, lag(CASE WHEN role = 'system' THEN text END) OVER w AS held, lead(turn) OVER w IS NULL AS ends FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, '<s>' || string_agg(CASE WHEN role = 'system' THEN '' WHEN role = 'assistant' THEN ' ' || text || CASE WHEN ends THEN ' </s>' ELSE ' </s><s>' END
  ELSE '[INST] ' || coalesce('<<SYS>>' || chr(10) || held || chr(10) || '<</SYS>>' || chr(10) || chr(10), '') || text || ' [/INST]' END, '' ORDER BY turn) AS prompt FROM m GROUP BY conv_id""")
def inferred_template(spark, sf_dir):
    """TRN15: conversations in a template that is known by its renderings only: opening mark, system message inside the first user's, another end for the last turn."""
    from millrace.operators.templates import infer_slots, rendered

    def render(messages):  # stands for a tokenizer's template
        out, held = "<s>", ""
        for i, m in enumerate(messages):
            if m["role"] == "system":
                held = f"<<SYS>>\n{m['content']}\n<</SYS>>\n\n"
            elif m["role"] == "user":
                out, held = f"{out}[INST] {held}{m['content']} [/INST]", ""
            else:
                out += f" {m['content']} </s>" + ("<s>" if i < len(messages) - 1 else "")
        return out

    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("ms")).select("conv_id", rendered(F.col("ms"), infer_slots(render)).alias("prompt"))


@query("""WITH r AS (SELECT conv_id, turn, conv_id * 1000 + turn AS pos, text FROM conversations), b AS (SELECT *, (row_number() OVER (ORDER BY pos) - 1) // 1000 AS batch FROM r)
SELECT conv_id, turn, coalesce(lag(text) OVER w, last_value(text) OVER (PARTITION BY batch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS kl_text FROM b WINDOW w AS (PARTITION BY batch ORDER BY pos)""")
def kto_kl_rotate(spark, sf_dir):
    """WIN10: responses shifted by one within their batch."""
    rows = table(spark, sf_dir, "conversations").withColumn("pos", F.col("conv_id") * 1000 + F.col("turn"))
    return datasets.rotate_in_batches(rows, "pos", "text", "kl_text").select("conv_id", "turn", "kl_text")


@query(r"""WITH t AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS batch, doc_id, list_append(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), '<eos>') AS w FROM documents),
e AS (SELECT batch, doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM t), n AS (SELECT batch, tok, row_number() OVER (PARTITION BY batch ORDER BY doc_id, i) - 1 AS p FROM e)
SELECT batch, p // 512 AS block, md5(string_agg(tok, ' ' ORDER BY p)) AS tokens_md5 FROM n GROUP BY batch, p // 512 HAVING count(*) = 512""")
def pretrain_blocks(spark, sf_dir):
    """TRN13: blocks of 512 tokens of each batch of documents."""
    return datasets.pretrain_blocks(table(spark, sf_dir, "documents"), "doc_id", "text", 512).select("batch", "block", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query(r"""SELECT doc_id, len(t) AS n_tokens, t[len(t)] = '<eos>' AS whole, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, list_append(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> ''), '<eos>')[1:256] AS t FROM documents)""")
def pretrain_truncated(spark, sf_dir):
    """TRN13: unpacked rows, cut off at 256 tokens."""
    rows = datasets.pretrain_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 256)
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), (F.element_at("tokens", -1) == "<eos>").alias("whole"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query()
def pack_sequences(spark, sf_dir):
    """TRN9: sequences packed into 4,096 tokens within batches."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (word_count(F.col("text")) + 1).alias("n_tokens"))
    return datasets.pack_sequences(docs, "doc_id", "n_tokens", 4096)


_N = r"len(list_filter(string_split_regex({c}, '\s+'), lambda x: x <> ''))"


@query(f"""WITH l AS (SELECT conv_id, turn, {_N.format(c='text')} AS s, coalesce({_N.format(c='nxt')}, 0) AS t FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)),
m AS (SELECT *, CASE WHEN t * 2 < 128 THEN 128 WHEN s * 2 < 128 THEN 128 - s ELSE CAST(floor(128 * (t / (s + t))) AS INTEGER) END AS most FROM l)
SELECT conv_id, turn, CAST(least(greatest(128 - least(most, t), 0), s) AS INTEGER) AS source_len, CAST(least(most, t) AS INTEGER) AS target_len FROM m""")
def seq_budget(spark, sf_dir):
    """STR24: how much of a turn and the next fits 128 tokens."""
    nxt = F.lead("text").over(W.Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("nxt", nxt).select("conv_id", "turn", word_count(F.col("text")).alias("s"), word_count(F.coalesce("nxt", F.lit(""))).alias("t"))
    source, target = sequence_budget(F.col("s"), F.col("t"), 128)
    return rows.select("conv_id", "turn", source.cast("int").alias("source_len"), target.cast("int").alias("target_len"))


@query("""WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position FROM events),
f AS (SELECT user_id, position, value AS smoothed FROM s WHERE position = 0 UNION ALL SELECT s.user_id, s.position, f.smoothed * 0.6::DOUBLE + 0.4::DOUBLE * s.value FROM f JOIN s ON s.user_id = f.user_id AND s.position = f.position + 1)
SELECT user_id, CAST(position AS INTEGER) AS position, round(smoothed, 6) AS smoothed FROM f""")
def ema_loss(spark, sf_dir):
    """WIN9: exponential smoothing of each user's values."""
    out = metrics.smoothed(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 0.6)
    return out.select("user_id", "position", F.round("smoothed", 6).alias("smoothed"))


@query("""SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n_labels,
  (len(list_filter(embedding, lambda x, i: x > 0 AND i % 2 = 1)))::DOUBLE / nullif(len(list_filter(embedding, lambda x: x > 0)), 0) AS accuracy FROM embeddings""")
def token_accuracy(spark, sf_dir):
    """MET6: hits among the unmasked places of a sequence."""
    labels = F.transform("embedding", lambda x, i: F.when(x > 0, i % 2).otherwise(-100))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", labels.alias("y"), F.transform("embedding", lambda x: F.lit(0)).alias("p"))
    return rows.select("vec_id", F.size(F.filter("y", lambda y: y != -100)).alias("n_labels"), metrics.token_accuracy(F.col("p"), F.col("y")).alias("accuracy"))


@query("""SELECT l_orderkey, l_linenumber, round(ln(1 + exp(-(c - r))), 9) AS pairwise, round(ln(1 + exp(-(0.1 * (c - r) - 0.5))), 9) AS margin FROM (SELECT l_orderkey, l_linenumber, -l_tax - 0.1 AS c, -l_discount - 0.2 AS r FROM lineitem)""")
def preference_losses(spark, sf_dir):
    """MET7: losses of chosen and rejected log probabilities."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (-F.col("l_tax") - 0.1).alias("c"), (-F.col("l_discount") - 0.2).alias("r"))
    pairwise, margin, _ = metrics.preference_losses(F.col("c"), F.col("r"))
    return rows.select("l_orderkey", "l_linenumber", F.round(pairwise, 9).alias("pairwise"), F.round(margin, 9).alias("margin"))
