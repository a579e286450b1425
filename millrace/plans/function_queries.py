"""Queries of text, vector, judge and layout functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import catalog, chunking, encode, jobs, layout, qa, validation
from millrace.plans.registry import query
from millrace.session import table


def _case(key, *values):
    out = F.when(key % len(values) == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(key % len(values) == i, v)
    return out


@query(r"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey || '%' WHEN 1 THEN ' 1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ' ' WHEN 2 THEN 'n' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS n,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%-m/%-d') WHEN 2 THEN strftime(o_orderdate, '%Y年%-m月%-d日') WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE '2024-13-01' END AS d FROM orders)
SELECT o_orderkey, n LIKE '%!%' ESCAPE '!' OR suffix(trim(n), '%') OR TRY_CAST(replace(trim(n), ',', '') AS DOUBLE) IS NOT NULL AS is_number,
  coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%Y/%m/%d'), try_strptime(d, '%Y年%m月%d日'), try_strptime(d, '%d/%m/%Y'))::DATE AS parsed FROM t""".replace("n LIKE '%!%' ESCAPE '!' OR ", ""))
def numbers_and_dates(spark, sf_dir):
    """STR5, STR7: texts that read as numbers, and dates in four formats."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    n = _case(key, F.concat(key.cast("string"), F.lit("%")), F.concat(F.lit(" 1,"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(" ")), F.concat(F.lit("n"), key.cast("string")), key.cast("string"))
    d = _case(key, F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy/M/d"), F.date_format(day, "yyyy年M月d日"), F.date_format(day, "dd/MM/yyyy"), F.lit("2024-13-01"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.is_numeric_text(n).alias("is_number"), T.parse_date(d).alias("parsed"))


_MARKS = ("第一章 ", "第三条 ", "第2节", "1.2.3 ", "1.2 ", "3. ", "(一)", "", "12、 ")
_STYLES = ("Heading 2", "标题 9", "heading", "Normal", "")


@query(f"""WITH t AS (SELECT p_partkey, [{', '.join(f"'{m}'" for m in _MARKS)}][p_partkey % {len(_MARKS)} + 1] || p_name || CASE WHEN p_partkey % 2 = 0 THEN repeat('x', 90) ELSE '' END AS t, [{', '.join(f"'{m}'" for m in _STYLES)}][p_partkey % {len(_STYLES)} + 1] AS style FROM part)
SELECT p_partkey, CAST(CASE WHEN regexp_matches(t, '^第[一二三四五六七八九十百千零0-9]+章') THEN 1 WHEN regexp_matches(t, '^第[一二三四五六七八九十百千零0-9]+条') THEN 2 WHEN regexp_matches(t, '^第[一二三四五六七八九十百千零0-9]+[节部分篇]') THEN 1
  WHEN regexp_matches(t, '^[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.[0-9]{{1,2}}[\\s.、]') THEN 4 WHEN regexp_matches(t, '^[0-9]{{1,2}}\\.[0-9]{{1,2}}[\\s.、]') THEN 3 WHEN regexp_matches(t, '^[0-9]{{1,2}}[.、]\\s') THEN CASE WHEN length(t) < 80 THEN 3 ELSE 0 END
  WHEN regexp_matches(t, '^[(（][一二三四五六七八九十]+[)）]') THEN 3 ELSE 0 END AS INTEGER) AS level,
  CAST(CASE WHEN contains(lower(style), 'heading') OR contains(style, '标题') THEN CASE WHEN regexp_extract(style, '[0-9]+') <> '' THEN least(CAST(regexp_extract(style, '[0-9]+') AS INTEGER), 6) ELSE 1 END ELSE 0 END AS INTEGER) AS by_style FROM t""")
def heading_levels(spark, sf_dir):
    """STR9: heading levels by outline mark and by style name."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    t = F.concat(pick(_MARKS), "p_name", F.when(F.col("p_partkey") % 2 == 0, "x" * 90).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", T.heading_level(t).cast("int").alias("level"), T.style_level(pick(_STYLES)).cast("int").alias("by_style"))


_MODELS = ("models--Owner--bge-Reranker-v2", "models--a--bge-m3", "x-VL-7b", "models--org--name--chat", "M3E-base")


@query(f"""WITH t AS (SELECT c_custkey, [{', '.join(f"'{m}'" for m in _MODELS)}][c_custkey % {len(_MODELS)} + 1] AS m, '<think>' || c_name || chr(10) || '</think>' || chr(10) || chr(10) || c_mktsegment AS t, c_acctbal / 1000 AS s FROM customer)
SELECT c_custkey, CASE WHEN contains(lower(m), 'rerank') THEN 'rerank' WHEN regexp_matches(lower(m), 'embedding|embed|bge|m3e') THEN 'embedding' WHEN regexp_matches(lower(m), 'vlm|vision|-vl|ocr') THEN 'vlm' ELSE 'chat' END AS model_type,
  replace(regexp_replace(m, '^models--', ''), '--', '/') AS repo, regexp_replace(t, '(?s)<think>.*?</think>\\n*', '', 'g') AS answer, '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || c_name AS with_thought,
  round_even(least(greatest(s, 0.0), 5.0) * 2, 0) / 2 AS half FROM t JOIN customer USING (c_custkey)""")
def model_texts(spark, sf_dir):
    """STR19, 20, 23, 25: model types and names, thoughts, and half points."""
    m = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("c_custkey") % len(_MODELS) + 1).cast("int"))
    t = F.concat(F.lit("<think>"), "c_name", F.lit("\n</think>\n\n"), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", T.model_type(m).alias("model_type"), T.repo_name(m).alias("repo"), T.strip_thought(t).alias("answer"), T.add_thought(F.col("c_name")).alias("with_thought"), T.half_points(F.col("c_acctbal") / 1000).alias("half"))


@query("""SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, o_orderpriority AS priority, '12:30' AS at, 3 AS n_keys FROM orders""")
def key_value_lines(spark, sf_dir):
    """STR21: lines of key and value as a map, the later of equal keys wins."""
    lines = F.concat(F.lit("customer: none\nno key here\n priority :  "), "o_orderpriority", F.lit("\nat: 12:30\ncustomer: "), F.col("o_custkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", T.key_values(lines).alias("m"))
    return rows.select("o_orderkey", F.col("m")["customer"].alias("customer"), F.col("m")["priority"].alias("priority"), F.col("m")["at"].alias("at"), F.size("m").alias("n_keys"))


@query("""SELECT event_id, event_id % 3 <> 2 AS is_json, CASE event_id % 3 WHEN 0 THEN '{"a":' || event_id || '}' WHEN 1 THEN '[1,' || user_id || ']' ELSE 'plain {' || event_type END AS value FROM events""")
def json_in_text(spark, sf_dir):
    """STR22: JSON as it reads back, other text as it is."""
    c = _case(F.col("event_id"), F.concat(F.lit('{ "a" : '), F.col("event_id").cast("string"), F.lit(" }")), F.concat(F.lit("[1, "), F.col("user_id").cast("string"), F.lit("]")), F.concat(F.lit("plain {"), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", T.json_or_text(c).alias("j")).select("event_id", "j.*")


_E = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(f"""SELECT vec_id, round(list_dot_product(v, u) / ((sqrt(list_dot_product(v, v)) + 1e-8) * (sqrt(list_dot_product(u, u)) + 1e-8)), 9) AS raised,
  CASE WHEN list_dot_product(u, u) = 0 THEN 0.0 ELSE round(list_dot_product(v, u) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(u, u))), 9) END AS or_zero
  FROM (SELECT vec_id, {_E} AS v, list_transform({_E}, lambda x: CASE WHEN vec_id % 4 = 0 THEN 0.0 WHEN x > 0 THEN x ELSE 0.0 END) AS u FROM embeddings)""")
def cosine_kinds(spark, sf_dir):
    """STR18: both treatments of zero norms."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v")).withColumn("u", F.transform("v", lambda x: F.when(F.col("vec_id") % 4 == 0, 0.0).when(x > 0, x).otherwise(0.0)))
    return rows.select("vec_id", F.round(V.cosine(F.col("v"), F.col("u")), 9).alias("raised"), F.round(V.cosine_or_zero(F.col("v"), F.col("u")), 9).alias("or_zero"))


@query("""SELECT n_nationkey, CAST(n_nationkey AS INTEGER) AS index, 'GPU ' || n_name AS name, round((n_regionkey * 25) * 100.0 / 100, 1) AS used_percent, n_regionkey * 25 >= 90 AS busy FROM nation""")
def gpu_lines(spark, sf_dir):
    """SRC36, AGG21: a GPU's CSV line, busy from 90 % on."""
    line = F.concat_ws(", ", F.col("n_nationkey").cast("string"), F.concat(F.lit("GPU "), "n_name"), (F.col("n_regionkey") * 25).cast("string"), F.lit("100"))
    return table(spark, sf_dir, "nation").select("n_nationkey", layout.gpu_usage(line).alias("g")).select("n_nationkey", "g.*")


@query("""WITH d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM events)
SELECT user_id, min(event_id) FILTER (d > 60) AS at FROM d GROUP BY user_id""")
def value_jumps(spark, sf_dir):
    """WIN6: the first place where a user's value moves by more than 60."""
    return layout.first_jump(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 60.0)


@query(r"""SELECT o_orderkey, len(list_filter(c, lambda x: regexp_matches(x, '^[0-9]{4}年?$') OR regexp_matches(x, '^(?i)q[1-4]$') OR regexp_matches(x, '金额|数量|单价|合计|比例|增长|收入|成本|利润'))) > 0 AS is_header
  FROM (SELECT o_orderkey, [CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y') ELSE o_orderpriority END, CASE WHEN o_orderkey % 5 = 0 THEN 'Q' || (o_orderkey % 6) ELSE 'x' END, CASE WHEN o_orderkey % 7 = 0 THEN '销售收入' ELSE '客户' END] AS c FROM orders)""")
def header_rows(spark, sf_dir):
    """STR8: rows of cells that look like a header."""
    k = F.col("o_orderkey")
    cells = F.array(F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy")).otherwise(F.col("o_orderpriority")), F.when(k % 5 == 0, F.concat(F.lit("Q"), (k % 6).cast("string"))).otherwise("x"), F.when(k % 7 == 0, "销售收入").otherwise("客户"))
    return table(spark, sf_dir, "orders").select("o_orderkey", layout.header_row(cells).alias("is_header"))


@query("SELECT conv_id, avg(length(trim(text))) < 200 AS scanned FROM (SELECT conv_id, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id")
def scanned_documents(spark, sf_dir):
    """SRC16: documents whose pages hold too few characters, turns as pages."""
    return layout.is_scanned(table(spark, sf_dir, "conversations"), "conv_id", "text", 200.0)


@query("""WITH RECURSIVE c AS (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS t, CAST(l_linenumber AS DOUBLE) AS x, chr(CAST(97 + l_linenumber AS INTEGER)) AS c FROM lineitem WHERE l_quantity >= 50 * 0.1 AND l_quantity <= 50 * 0.9),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY t, x, c) AS r FROM c),
g AS (SELECT l_orderkey, t, x, c, r, t AS anchor, 0 AS n FROM o WHERE r = 1 UNION ALL SELECT o.l_orderkey, o.t, o.x, o.c, o.r, CASE WHEN o.t - g.anchor > 3 THEN o.t ELSE g.anchor END, CASE WHEN o.t - g.anchor > 3 THEN g.n + 1 ELSE g.n END FROM g JOIN o ON o.l_orderkey = g.l_orderkey AND o.r = g.r + 1),
l AS (SELECT l_orderkey, n, string_agg(c, '' ORDER BY x, c) AS line FROM g GROUP BY ALL) SELECT l_orderkey, string_agg(line, chr(10) ORDER BY n) AS lines FROM l GROUP BY l_orderkey""")
def layout_lines(spark, sf_dir):
    """SRC15, WIN12: placed characters in lines, header and footer left out; order lines as characters of a page."""
    chars = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("top"), F.col("l_linenumber").alias("x"), F.lit(50.0).alias("height"), F.char((F.lit(97) + F.col("l_linenumber")).cast("int")).alias("char"))
    return layout.page_lines(chars, ["l_orderkey"], 0.1, 0.9, 3.0)


_REPLY = """'Sure. {"score": ' || (o_orderkey % 13) || CASE WHEN o_orderkey % 2 = 0 THEN ', "factual": 7, "format": "9"' ELSE '' END || ', "reason": "' || o_orderpriority || '"} end'"""


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 0.0 ELSE round_even(least(greatest((o_orderkey % 13)::DOUBLE, 0.0), 5.0) * 2, 0) / 2 END AS points, CASE WHEN o_orderkey % 3 <> 2 AND o_orderkey % 13 >= 3 THEN 'true' ELSE 'false' END AS correct,
  CAST(CASE WHEN o_orderkey % 3 = 2 THEN 5 ELSE o_orderkey % 13 END AS INTEGER) AS score, CAST(CASE WHEN o_orderkey % 3 <> 2 AND o_orderkey % 2 = 0 THEN 7 ELSE 5 END AS INTEGER) AS factual, 5 AS completeness, CAST(CASE WHEN o_orderkey % 3 <> 2 AND o_orderkey % 2 = 0 THEN 9 ELSE 5 END AS INTEGER) AS format,
  CASE WHEN o_orderkey % 3 = 2 THEN 'no object in this reply' ELSE o_orderpriority END AS reason FROM orders""")
def judgements(spark, sf_dir):
    """VAL11-12: scores read from a judge's replies."""
    k = F.col("o_orderkey")
    reply = F.when(k % 3 == 2, "no object in this reply").otherwise(F.concat(F.lit('Sure. {"score": '), (k % 13).cast("string"), F.when(k % 2 == 0, ', "factual": 7, "format": "9"').otherwise(""), F.lit(', "reason": "'), "o_orderpriority", F.lit('"} end')))
    points, correct = validation.parse_judgement(F.col("reply"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", reply.alias("reply")).withColumn("s", validation.parse_scores(F.col("reply")))
    return rows.select("o_orderkey", points.alias("points"), correct.alias("correct"), "s.score", "s.factual", "s.completeness", "s.format", "s.reason")


@query("""SELECT o_orderkey, o_orderpriority AS content, o_orderstatus AS answer, CASE WHEN o_orderkey % 4 IN (0, 1) THEN CASE WHEN o_orderkey % 4 = 0 THEN 'worse' END END AS rejected_answer, o_orderkey % 4 IN (0, 1) AS is_dpo,
  CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'dpo' ELSE 'manual' END AS question_type, CASE WHEN o_orderkey % 2 = 0 THEN 'given' ELSE 'new-' || o_orderkey END AS batch_id, 'completed' AS answer_status FROM orders""")
def manual_pairs(spark, sf_dir):
    """FLT11: pairs entered by hand, with what follows from their type and rejected answer."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("answer"), F.when(k % 4 == 0, "worse").alias("rejected"), F.when(k % 4 == 1, "dpo").alias("question_type"), F.when(k % 2 == 0, "given").alias("batch_id"))
    return catalog.manual_pairs(rows, F.concat(F.lit("new-"), k.cast("string")))


@query("SELECT c_custkey, c_name AS name, 'new' AS segment, CAST(c_nationkey AS VARCHAR) AS nation, 4 AS n_keys FROM customer")
def merge_settings(spark, sf_dir):
    """FLT12: a shallow merge of settings, new keys win."""
    old = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("kept"), F.lit("1"))
    new = F.create_map(F.lit("segment"), F.lit("new"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", catalog.merge_json(old, new).alias("m"))
    return rows.select("c_custkey", F.col("m")["name"].alias("name"), F.col("m")["segment"].alias("segment"), F.col("m")["nation"].alias("nation"), F.size("m").alias("n_keys"))


@query("""SELECT event_id, CASE WHEN event_id % 50 > 0 THEN (event_id * 2.0) / (event_id % 50) * (100 - event_id % 50) END AS remaining,
  CASE WHEN event_type IN ('purchase') THEN 'error' WHEN event_type = 'click' THEN 'warning' ELSE 'info' END AS severity FROM events""")
def progress_lines(spark, sf_dir):
    """WIN13, STM3: seconds that remain, and how bad a line is."""
    from millrace.streaming import training_log

    line = F.when(F.col("event_type") == "purchase", "Traceback (most recent call last)").when(F.col("event_type") == "click", "UserWarning: x").otherwise("step done")
    done = F.col("event_id") % 50
    return table(spark, sf_dir, "events").select("event_id", training_log.remaining_seconds(F.col("event_id") * 2.0, done, F.lit(100)).alias("remaining"), training_log.severity(line).alias("severity"))


@query("""SELECT conv_id, turn, text AS question, 'A: ' || role AS answer, 'fact' AS question_type FROM conversations WHERE text IS NOT NULL AND trim(text) <> ''""")
def parsed_replies(spark, sf_dir):
    """QA12-13: a provider's JSON reply to its text, and the text to pairs."""
    pair = F.array(F.struct(F.col("text").alias("question"), F.concat(F.lit("A: "), "role").alias("answer")))
    content = F.concat(F.lit("<think>not this [1]</think>Here you are:\n```json\n"), F.to_json(pair), F.lit("\n```\n"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", qa.reply_text(body).alias("reply"))
    found = rows.select("conv_id", "turn", F.explode(qa.parsed_pairs("reply")).alias("p")).select("conv_id", "turn", "p.*")
    return found


@query("""SELECT conv_id, turn, 0 AS position, 'Q' || turn AS question, 'from ' || length(text) AS answer, turn % 3 <> 0 AS suitable FROM conversations WHERE text IS NOT NULL""")
def generated_pairs(spark, sf_dir):
    """QA6, 11, 14: a client's replies to prompts, its pairs and its gate."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.to_json(F.struct("turn", F.length("text").alias("n"))).alias("prompt"), F.lit(1).alias("n_questions"))

    def client(prompt: str) -> str:
        import json

        asked = json.loads(prompt)
        return json.dumps({"qa_pairs": [{"question": f"Q{asked['turn']}", "answer": f"from {asked['n']}"}, {"question": "one too many", "answer": "x"}]})

    gate = F.when(F.col("turn") % 3 == 0, '{"suitable": false}').when(F.col("turn") % 3 == 1, 'Yes: {"suitable": true}').otherwise("unreadable")
    out = jobs.generate(rows, client, ("conv_id", "turn"))
    return out.select("conv_id", "turn", "position", "question", "answer", jobs.suitable(gate).alias("suitable"))


@query(r"""SELECT doc_id, CAST(len(list_filter([trim(p) FOR p IN string_split_regex(regexp_replace(regexp_replace(trim(text), '([。！？；.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), '([。！？；])', '\1' || chr(1), 'g'), chr(1))], lambda p: p <> '')) AS INTEGER) AS n_parts FROM documents""")
def sentence_parts(spark, sf_dir):
    """STR3: how many parts the sentence ends cut a text into."""
    text = F.regexp_replace(T.strip_ws(F.col("text")), r"([。！？；.!?])[ \t\n\r]+", "$1\u0001")
    parts = F.split(F.regexp_replace(text, "([。！？；])", "$1\u0001"), "\u0001")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(parts, lambda p: F.trim(p) != "")).alias("n_parts"))


@query(r"""SELECT doc_id, CAST(len(packed) AS INTEGER) AS n_chunks, md5(array_to_string(packed, '|')) AS content_md5 FROM (
  SELECT doc_id, list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter(list_transform(list_filter(list_zip(p, range(len(p))), lambda x: x[2] % 2 = 0), lambda x: trim(x[1], ' ' || chr(10) || chr(13) || chr(9))), lambda x: x <> ''), lambda x: [x])),
    lambda acc, part: CASE WHEN len(acc) = 0 THEN part WHEN length(acc[len(acc)]) + 1 + length(part[1]) > 1000 THEN list_concat(acc, part) ELSE list_concat(acc[1:len(acc) - 1], [acc[len(acc)] || chr(10) || part[1]]) END) AS packed
  FROM (SELECT doc_id, string_split(replace(text, ' the ', '```'), '```') AS p FROM documents WHERE text IS NOT NULL))""")
def chunk_code(spark, sf_dir):
    """CHK4: prose around fenced blocks, every other part taken as fenced."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", chunking.code_chunks(F.replace("text", F.lit(" the "), F.lit("```"))).alias("c"))
    return rows.select("doc_id", F.size("c").alias("n_chunks"), F.md5(F.array_join("c", "|")).alias("content_md5"))


@query("""SELECT n_nationkey, 'Which region?' || chr(10) || 'A. ' || n_name || chr(10) || 'B. ' || n_regionkey || chr(10) || 'Answer: ' || CASE WHEN n_regionkey = 0 THEN '' ELSE 'B' END AS prompt FROM nation""")
def choice_prompts(spark, sf_dir):
    """TRN24: multiple-choice prompts, with and without the answer."""
    options = [F.col("n_name"), F.col("n_regionkey").cast("string")]
    rows = table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", F.when(F.col("n_regionkey") == 0, encode.choice_prompt(F.lit("Which region?"), options)).otherwise(encode.choice_prompt(F.lit("Which region?"), options, F.lit("B"))).alias("prompt"))
