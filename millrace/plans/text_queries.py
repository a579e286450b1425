"""Queries over texts: chunks, quality rules, masking, pages, vectors and metrics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.functions import text as T
from millrace.functions import url as U
from millrace.functions import vectors as V
from millrace.operators import chunking, crawl, datasets, metrics, privacy, validation
from millrace.operators.ranking import framed
from millrace.plans.registry import query
from millrace.session import spread, table
from millrace.storage import written

_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
_CHUNKS = f"""
words AS (SELECT doc_id, lang, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
chunks AS (SELECT doc_id, lang, CAST(s // 180 AS INTEGER) AS index, array_to_string(w[s + 1 : s + 200], ' ') AS content, CAST(least(200, len(w) - s) AS INTEGER) AS word_count
           FROM (SELECT doc_id, lang, w, unnest(range(0, len(w), 180)) AS s FROM words))"""
_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
#: The same, for the JVM: it starts at the first character of a local part only.
_EMAIL_ONCE = r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
#: The format rules that both engines can say; back-references have no place in the oracle's.
_RULES = r"""CASE WHEN {a} = '' THEN '' WHEN length(regexp_replace({a}, '[\p{{L}}\p{{N}}_\s　-〿＀-￯.,;:!?，。；：！？、"''（）()【】\[\]{{}}\-/\\@#$%^&*+=~`|<>]', '', 'g')) > 0.3 * length({a}) THEN 'garbled'
  WHEN regexp_matches({a}, '(\.\.\.|…|。。。)\s*$') THEN 'cut_off'
  WHEN length({a}) - length(translate({a}, '(（[【', '')) > length({a}) - length(translate({a}, ')）]】', '')) THEN 'open_brackets'
  WHEN {q} THEN 'odd_quotes' ELSE '' END"""


def _rules(a: str) -> str:
    q = " OR ".join(f"length(replace({a}, '{x}', '')) <> length(replace({a}, '{y}', ''))" for x, y in validation.QUOTES)
    return _RULES.format(a=a, q=q)


@query(f"""
WITH {_CHUNKS},
good AS (SELECT * FROM chunks WHERE length(trim(content)) >= 20 AND {_rules('content')} = ''),
masked AS (SELECT doc_id, lang, index, regexp_replace(content, '{_EMAIL}', '**邮箱A**', 'g') AS instruction, word_count FROM good),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42', doc_id)), doc_id, index) - 1 AS p, count(*) OVER () AS n FROM masked),
docs AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42', doc_id)), doc_id) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM masked)),
split AS (SELECT doc_id, CASE WHEN p < floor(n * 0.8) THEN 'train' WHEN p < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM docs)
SELECT lang, split, count(*) AS n_examples, CAST(sum(word_count) AS BIGINT) AS n_words, CAST(sum(length(instruction)) AS BIGINT) AS n_chars FROM masked JOIN split USING (doc_id) GROUP BY lang, split""")
def flagship_doc_to_sft(spark, sf_dir):
    """Documents to token chunks, format rules, masked e-mail addresses, instruction rows and a split by document, summed up."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    chunks = docs.select("doc_id", "lang", F.explode(chunking.token_chunks(F.col("text"))).alias("c")).select("doc_id", "lang", "c.*")
    good = chunks.where((F.length(F.trim("content")) >= 20) & (validation.format_error(F.col("content"), apart=False) == ""))
    rows = good.select("doc_id", "lang", "word_count", datasets.to_alpaca(F.when(F.col("content").contains("@"), F.regexp_replace("content", _EMAIL_ONCE, "**邮箱A**")).otherwise(F.col("content")), F.lit("")).alias("r"))
    sums = rows.groupBy("doc_id", "lang").agg(F.count("*").alias("n"), F.sum("word_count").alias("words"), F.sum(F.length("r.instruction")).alias("chars"))
    sums = written(sums, "examples")  # read by the split and by the result, made once
    out = sums.join(datasets.split_random(sums.select("doc_id").distinct(), "doc_id"), "doc_id")
    return out.groupBy("lang", "split").agg(F.sum("n").alias("n_examples"), F.sum("words").alias("n_words"), F.sum("chars").cast("long").alias("n_chars"))


@query(f"WITH {_CHUNKS} SELECT doc_id, index, content, word_count FROM chunks")
def chunk_token(spark, sf_dir):
    """CHK3: windows of 200 tokens with an overlap of 20."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(chunking.token_chunks(F.col("text"))).alias("c")).select("doc_id", "c.*")


@query(r"""SELECT doc_id, CAST(n AS BIGINT) AS n_chunks, CAST(total AS BIGINT) AS n_chars FROM (
  SELECT doc_id, count(*) AS n, sum(length(line)) AS total FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY doc_id)""")
def chunk_lines(spark, sf_dir):
    """CHK9 without a table: a chunk for each line that isn't blank."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("line")).cast("long").alias("n_chars"))


def _rows_of_chunks(method, **options):
    def run(spark, sf_dir):
        rows = chunking.chunk_rows(table(spark, sf_dir, "documents"), method, **options)
        return rows.select("doc_id", "index", "name", "level", "word_count", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))

    return run


for _method in ("recursive", "semantic", "sentence", "paragraph", "markdown", "similarity"):
    _f = _rows_of_chunks(_method)
    _f.__name__ = f"chunk_{_method}"
    _f.__doc__ = f"Chunks of all documents by the {_method} splitter."
    query()(_f)


@query(r"""SELECT doc_id, CAST(len(packed) AS INTEGER) AS n_chunks FROM (
  SELECT doc_id, list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter(string_split(text, '. '), lambda p: trim(p) <> ''), lambda p: [p])),
    lambda acc, part: CASE WHEN len(acc) = 0 THEN part WHEN length(acc[len(acc)]) + 2 + length(part[1]) > 800 THEN list_concat(acc, part)
      ELSE list_concat(acc[1:len(acc) - 1], [acc[len(acc)] || '. ' || part[1]]) END) AS packed FROM documents)""")
def chunk_custom(spark, sf_dir):
    """CHK5: parts between a literal separator, packed greedily up to 800 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(chunking.custom_chunks(F.col("text"), ". ", 800)).alias("n_chunks"))


@query(f"""SELECT doc_id, {_rules('text')} AS format_error, length(trim(text)) >= 20 AS long_enough,
  CASE WHEN {_rules('text')} <> '' THEN 'format_error' WHEN length(trim(text)) < 20 THEN 'basic_error' ELSE 'passed' END AS verdict
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def validate_format(spark, sf_dir):
    """VAL1-5: length, garbage, cut-off, bracket and quote rules of every document. Repeats are in validate_repeats."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", validation.simple_error(text).alias("format_error"), validation.long_enough(text, F.lit("")).alias("long_enough"))
    return found.withColumn("verdict", F.when(F.col("format_error") != "", "format_error").when(~F.col("long_enough"), "basic_error").otherwise("passed"))


@query()
def validate_repeats(spark, sf_dir):
    """VAL6-7 and 10: the whole verdict of each document, repeats included."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", "text", validation.format_error(F.col("text")).alias("format_error"))
    return found.select("doc_id", "format_error", validation.verdict(F.col("text"), F.lit("generated"), error=F.col("format_error")).alias("verdict"))


@query(r"""WITH t AS (SELECT p_partkey, p_partkey % 7 <> 6 AS structured, [p_name || '为' || p_size, '尺寸是 ' || p_size, '未上市。', p_name || '不是' || p_brand, p_name || ' ' || p_type, '', '已注册'][p_partkey % 7 + 1] AS text FROM part)
SELECT p_partkey, structured, CASE WHEN text = '' OR NOT structured THEN true ELSE regexp_matches(text, '[一-鿿\p{L}\p{N}_]+[是为]\S+') OR regexp_matches(trim(text), '^(未)?[一-鿿]{2,10}[。.]?$') OR regexp_matches(text, '[一-鿿\p{L}\p{N}_]+不[是为]\S+') END AS follows FROM t""")
def validate_template(spark, sf_dir):
    """VAL8: answers from tables must state that a field is a value; some here do, some do not."""
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    texts = F.array(F.concat(name, F.lit("为"), size), F.concat(F.lit("尺寸是 "), size), F.lit("未上市。"), F.concat(name, F.lit("不是"), "p_brand"), F.concat(name, F.lit(" "), "p_type"), F.lit(""), F.lit("已注册"))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 7 != 6).alias("structured"), F.element_at(texts, (F.col("p_partkey") % 7 + 1).cast("int")).alias("text"))
    return rows.select("p_partkey", "structured", validation.follows_template(F.col("text"), F.when(F.col("structured"), "structured_template").otherwise("generated")).alias("follows"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '""" + _EMAIL + r"""')) AS INTEGER) AS n_email,
  regexp_matches(text, '(^|[^0-9])1[3-9][0-9]{9}([^0-9]|$)') AS has_phone, regexp_matches(text, '(^|[^0-9])62[0-9]{14,17}([^0-9]|$)') AS has_bank_card,
  regexp_matches(text, '(^|[^0-9])([0-9]{1,3}\.){3}[0-9]{1,3}([^0-9]|$)') AS has_ip FROM documents""")
def detect_pii(spark, sf_dir):
    """DES1: matches of the built-in rules in every document."""
    text = F.col("text")
    marks = {name: privacy.holds(text, rule) for name, rule in (("has_phone", "phone"), ("has_bank_card", "bank_card"), ("has_ip", "ip_address"))}
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.size(privacy.found(text, "email")).alias("n_email"), *[c.alias(n) for n, c in marks.items()])


@query("SELECT doc_id, replace(text, 'the', '**关键词A**') AS masked, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS INTEGER) AS n_hits FROM documents")
def mask_keyword(spark, sf_dir):
    """DES5: a literal keyword in every document."""
    text = F.col("text")
    hits = ((F.length(text) - F.length(F.replace(text, F.lit("the"), F.lit("")))) / 3).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(text, F.lit("the"), F.lit("**关键词A**")).alias("masked"), hits.alias("n_hits"))


@query()
def mask_documents(spark, sf_dir):
    """DES3-4: masked texts and their audit rows."""
    out = privacy.mask_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "masked.text", F.explode_outer("masked.audit").alias("a")).select("doc_id", "a.rule", "a.original", "a.replacement", F.md5("text").alias("text_md5"))


@query(r"""SELECT doc_id, CAST(len(""" + _WORDS + r""") AS INTEGER) AS n_words,
  CAST(length(regexp_replace(text, '[^一-鿿]', '', 'g')) + floor((length(text) - length(regexp_replace(text, '[^一-鿿]', '', 'g'))) * 1.5) AS INTEGER) AS weighted,
  substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 8000) AS cleaned,
  greatest(1, least(5, length(text) // 240))::INTEGER AS n_questions,
  rtrim(substring(trim(regexp_replace(text, '[\\/:*?"<>|\x00-\x1f]', '_', 'g')), 1, 80), '. ') AS filename FROM documents""")
def text_functions(spark, sf_dir):
    """STR1, 2, 4, 17 and QA8 over every document."""
    from millrace.operators.qa import question_count

    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(text).alias("n_words"), T.weighted_length(text).alias("weighted"), T.clean_cell(text).alias("cleaned"), question_count(text, 5).alias("n_questions"), T.safe_filename(text).alias("filename"))


@query(r"""SELECT doc_id, CASE WHEN length(s) <= 100 THEN s WHEN e > 50 THEN left(h, e) ELSE h || '...' END AS summary FROM (
  SELECT doc_id, s, h, greatest(CASE WHEN contains(h, '.') THEN length(h) - strpos(reverse(h), '.') + 1 ELSE 0 END, CASE WHEN contains(h, '!') THEN length(h) - strpos(reverse(h), '!') + 1 ELSE 0 END,
    CASE WHEN contains(h, '?') THEN length(h) - strpos(reverse(h), '?') + 1 ELSE 0 END) AS e FROM (SELECT doc_id, trim(text) AS s, left(trim(text), 100) AS h FROM documents))""")
def rule_summary(spark, sf_dir):
    """CHK2f: the rule-made summary of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", T.rule_summary(F.col("text")).alias("summary"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url || '?utm_source=a&x=1&ref=b#top', '#.*$', ''), '([&?])(utm_[^&]*|fbclid|gclid|ref|source|from|spm|nsukey)=[^&]*', '', 'g'), '[?&]+$', '') AS url,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages""")
def url_normalize(spark, sf_dir):
    """STR10-11: addresses with tracking parameters and a fragment, normalised."""
    return table(spark, sf_dir, "pages").select("page_id", U.normalize_url(F.concat("url", F.lit("?utm_source=a&x=1&ref=b#top"))).alias("url"), U.host(F.col("url")).alias("host"))


_STRIP = "html"
for _tag in U.NOISE:
    _STRIP = f"regexp_replace({_STRIP}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', '', 'g')"
_PLAIN = f"regexp_replace({_STRIP}, '(?s)<[^>]*>', ' ', 'g')"
_TITLE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))"
for _name, _char in U.ENTITIES:
    _PLAIN = f"replace({_PLAIN}, '{_name}', '{_char}')".replace("'''", "''''")
    _TITLE = f"replace({_TITLE}, '{_name}', '{_char}')".replace("'''", "''''")


@query(rf"SELECT page_id, {_TITLE} AS title, trim(regexp_replace({_PLAIN}, '[ \t\r\n]+', ' ', 'g')) AS content FROM pages")
def html_clean(spark, sf_dir):
    """STR12, 14: title and visible text of every page."""
    return table(spark, sf_dir, "pages").select("page_id", U.title(F.col("html")).alias("title"), U.visible_text(F.col("html")).alias("content"))


@query(r"""SELECT page_id, CASE WHEN regexp_extract(html, '(?is)<article(?:\s[^>]*)?>.*?</article>') <> '' THEN regexp_extract(html, '(?is)<article(?:\s[^>]*)?>.*?</article>') ELSE html END AS selected,
  CAST(len(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS INTEGER) AS n_anchors FROM pages""")
def html_select(spark, sf_dir):
    """STR13: the article element of every page, and its anchors."""
    found = F.regexp_extract_all("html", F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), 1)
    return table(spark, sf_dir, "pages").select("page_id", U.select_css(F.col("html"), "article").alias("selected"), F.size(found).alias("n_anchors"))


_URL = r"""regexp_replace(regexp_replace(regexp_replace({u}, '#.*$', ''), '([&?])(utm_[^&]*|fbclid|gclid|ref|source|from|spm|nsukey)=[^&]*', '', 'g'), '[?&]+$', '')"""
_SKIP = "|".join(e.replace(".", "\\.") for e in U.SKIPPED)
_LINKS = rf"""s AS (SELECT {_URL.format(u='url')} AS src, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS l FROM pages),
links AS (SELECT DISTINCT src, dst FROM (SELECT src, {_URL.format(u="CASE WHEN l LIKE '/%' THEN regexp_extract(src, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || replace(l, '&amp;', '&') ELSE replace(l, '&amp;', '&') END")} AS dst FROM s WHERE l NOT LIKE '//%')
  WHERE regexp_matches(dst, '^https?://') AND regexp_extract(src, '://([^/?#]*)', 1) = regexp_extract(dst, '://([^/?#]*)', 1) AND NOT regexp_matches(lower(regexp_extract(dst, '^https?://[^/?#]*([^?#]*)', 1)), '({_SKIP})$'))"""


@query(f"WITH {_LINKS} SELECT src, dst FROM links")
def page_links(spark, sf_dir):
    """STR14, 16: links of every page to pages of its host."""
    return crawl.page_links(table(spark, sf_dir, "pages"))


@query(f"""WITH RECURSIVE {_LINKS}, known AS (SELECT DISTINCT {_URL.format(u='url')} AS u FROM pages), step AS (SELECT src, dst FROM links JOIN known ON known.u = links.dst),
reached AS (SELECT (SELECT src FROM links GROUP BY src ORDER BY count(*) DESC, src LIMIT 1) AS url, 0 AS depth UNION SELECT dst, depth + 1 FROM reached JOIN step ON step.src = reached.url WHERE depth < 20)
SELECT url, min(depth) AS depth FROM reached GROUP BY url ORDER BY depth, url LIMIT 50""")
def crawl_bfs(spark, sf_dir):
    """SRC25: pages reached from the address with the most links, at most 50."""
    pages = table(spark, sf_dir, "pages")
    start = crawl.page_links(pages).groupBy("src").count().orderBy(F.desc("count"), "src").first()
    return crawl.crawl(pages, start.src)


_D = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(f"""SELECT vec_id, label, round(list_dot_product(v, u) / ((sqrt(list_dot_product(v, v)) + 1e-8) * (sqrt(list_dot_product(u, u)) + 1e-8)), 6) AS similarity FROM (
  SELECT vec_id, label, {_D} AS v, lead({_D}) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM embeddings) WHERE u IS NOT NULL""")
def adjacent_similarity(spark, sf_dir):
    """WIN2: cosine of each vector and the next of its label."""
    return _adjacent(spark, sf_dir).select("vec_id", "label", F.round("s", 6).alias("similarity"))


def _adjacent(spark, sf_dir):
    """vec_id, label, s: blocks of positions with a border row each, so a frequent label is no single task."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))
    placed, w = framed(rows, "vec_id", ["label"], 1)
    pairs = placed.withColumn("u", F.lead("v").over(w)).where("_own and u is not null")
    return pairs.select("vec_id", "label", V.cosine(F.col("v"), F.col("u")).alias("s"))


@query(f"""WITH a AS (SELECT vec_id, label, list_dot_product(v, u) / ((sqrt(list_dot_product(v, v)) + 1e-8) * (sqrt(list_dot_product(u, u)) + 1e-8)) AS s FROM (
  SELECT vec_id, label, {_D} AS v, lead({_D}) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM embeddings) WHERE u IS NOT NULL),
b AS (SELECT *, avg(s) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM a)
SELECT vec_id, label, round(m, 6) AS smoothed FROM b""")
def smoothed_similarity(spark, sf_dir):
    """WIN3: centred moving average of the neighbours' similarity."""
    placed, w = framed(_adjacent(spark, sf_dir), "vec_id", ["label"], 3)
    return placed.withColumn("m", F.avg("s").over(w.rowsBetween(-3, 3))).where("_own").select("vec_id", "label", F.round("m", 6).alias("smoothed"))


@query(f"""WITH e AS (SELECT vec_id, label, {_D} AS v FROM embeddings)
SELECT a.label, count(*) AS n_pairs, round(avg(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))), 5) AS mean_cosine
FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def pairwise_similarity(spark, sf_dir):
    """AGG20: mean cosine of all pairs of a label, from the sum of unit vectors: no pairs are made."""
    rows = table(spark, sf_dir, "embeddings").select("label", V.doubles(F.col("embedding")).alias("v"))
    unit = rows.select("label", F.transform("v", lambda x: x / V.norm(F.col("v"))).alias("u"))
    # one row a component is summed before the shuffle, so a frequent label costs no more than a rare one
    parts = unit.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    n = F.max("n")
    out = parts.groupBy("label").agg((n * (n - 1) / 2).cast("long").alias("n_pairs"), F.round((F.sum(F.col("x") * F.col("x")) - n) / (n * (n - 1)), 5).alias("mean_cosine"))
    return out.where("n_pairs > 0")


_PAIR = "pairs AS (SELECT conv_id, turn, text AS p, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)"
_SPLIT = r"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"


def _grams(c: str, n: int) -> str:
    w = _SPLIT.format(c=c)
    return f"list_distinct(list_transform(range(1, greatest(len({w}) - {n - 2}, 1)), lambda i: array_to_string(({w})[i : i + {n - 1}], ' ')))"


def _f1(n: int) -> str:
    return f"CASE WHEN len(list_intersect(p{n}, r{n})) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(p{n}, r{n})) / (len(p{n}) + len(r{n})) END"


@query(f"""WITH {_PAIR}, g AS (SELECT conv_id, turn, {_grams('p', 1)} AS p1, {_grams('r', 1)} AS r1, {_grams('p', 2)} AS p2, {_grams('r', 2)} AS r2 FROM pairs WHERE r IS NOT NULL)
SELECT conv_id, turn, round({_f1(1)}, 9) AS rouge_1, round({_f1(2)}, 9) AS rouge_2 FROM g""")
def rouge_n(spark, sf_dir):
    """MET2: n-gram F1 of each turn and the next."""
    rows = _next_turn(spark, sf_dir)
    return rows.select("conv_id", "turn", F.round(metrics.rouge_n(F.col("p"), F.col("r"), 1), 9).alias("rouge_1"), F.round(metrics.rouge_n(F.col("p"), F.col("r"), 2), 9).alias("rouge_2"))


def _next_turn(spark, sf_dir):
    nxt = F.lead("text").over(W.Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("p"), nxt.alias("r")).where("r is not null")


@query(f"WITH {_PAIR} SELECT conv_id, turn, CAST(trim(p) = trim(r) AS INTEGER) AS hit FROM pairs WHERE r IS NOT NULL")
def exact_match(spark, sf_dir):
    """MET1: whether a turn repeats in the next."""
    return _next_turn(spark, sf_dir).select("conv_id", "turn", metrics.exact_match(F.col("p"), F.col("r")).alias("hit"))


@query()
def rouge_l_bleu(spark, sf_dir):
    """MET3-4: character ROUGE-L and BLEU of each turn and the next."""
    return _next_turn(spark, sf_dir).select("conv_id", "turn", F.round(metrics.rouge_l("p", "r"), 9).alias("rouge_l"), F.round(metrics.bleu("p", "r"), 9).alias("bleu"))


@query(f"""WITH e AS (SELECT vec_id, label, {_D} AS v FROM embeddings), p AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i),
m AS (SELECT label, list(x ORDER BY i) AS u FROM p GROUP BY label),
c AS (SELECT vec_id, round(list_dot_product(v, u) / ((sqrt(list_dot_product(v, v)) + 1e-8) * (sqrt(list_dot_product(u, u)) + 1e-8)), 4) AS similarity FROM e JOIN m ON m.label = e.label)
SELECT vec_id, similarity, CASE WHEN similarity < 0.5 THEN 'hallucination' ELSE 'passed' END AS verdict FROM c""")
def semantic_verdict(spark, sf_dir):
    """VAL9: similarity of each vector and its label's mean, below a half as hallucination."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))
    means = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y.x).alias("m"))
    scored = rows.join(means, "label").select("vec_id", F.round(V.cosine(F.col("v"), F.col("m")), 4).alias("similarity"))
    return scored.withColumn("verdict", F.when(F.col("similarity") < 0.5, "hallucination").otherwise("passed"))


@query()
def segmented_scores(spark, sf_dir):
    """MET5: messages without their blanks, cut into the words of the documents by the most probable path; scores against the next message."""
    from millrace.operators.metrics import training_scores
    from millrace.operators.segment import Segmenter, count_words
    from millrace.storage import written

    cut = Segmenter(count_words(table(spark, sf_dir, "documents").select(F.split(F.lower("text"), r"\s+").alias("w")), "w"), everywhere=True)
    squeezed = F.regexp_replace(F.lower("text"), r"\s+", "")
    rows = spread(table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", squeezed.alias("p")))

    @F.pandas_udf("words array<string>, log_probability double")
    def measured(texts: pd.Series) -> pd.DataFrame:
        found = [cut(t) for t in texts]
        known = [sum(cut.logs.get(w, -cut.total) for w in words if w[0].isalnum()) for words in found]
        return pd.DataFrame({"words": found, "log_probability": [round(x, 6) for x in known]})

    rows = written(rows.withColumn("m", measured("p")).select("conv_id", "turn", "p", "m.*"), "words")  # each message is cut once, for itself and for the one before
    pairs = rows.join(rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("p").alias("r"), F.col("words").alias("r_words")), ["conv_id", "turn"], "left")
    scored = training_scores(spread(pairs), "p", "r", words=("words", "r_words"))
    return scored.select("conv_id", "turn", F.size("words").cast("long").alias("n_words"), "log_probability", "rouge_1", "rouge_2", "rouge_l", "bleu_4")
