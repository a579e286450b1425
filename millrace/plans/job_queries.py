"""Queries of generation jobs, runs and media rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import catalog, crawl, jobs
from millrace.plans.registry import query
from millrace.session import table


@query("""WITH c AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER w, '') AS b, coalesce(lead(text) OVER w, '') AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, greatest(1, least(5, length(text) // 240)) AS n FROM c),
d AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS doc FROM conversations GROUP BY conv_id), p AS (SELECT 'Write ' AS x, ' questions with answers about the text below, as a JSON array.' || chr(10) || chr(10) AS y)
SELECT conv_id, turn, 'local' AS mode, n::INTEGER AS n_questions, md5(x || n || y || text) AS prompt_md5 FROM n, p
UNION ALL SELECT conv_id, turn, 'context_enhanced', n::INTEGER, md5(x || n || y || text || CASE WHEN b <> '' THEN chr(10) || chr(10) || 'Before it:' || chr(10) || b ELSE '' END || CASE WHEN a <> '' THEN chr(10) || chr(10) || 'After it:' || chr(10) || a ELSE '' END) FROM n, p
UNION ALL SELECT conv_id, NULL, 'full_doc', greatest(1, least(5, length(doc) // 240))::INTEGER, md5(x || greatest(1, least(5, length(doc) // 240)) || y || doc) FROM d, p""")
def generation_prompts(spark, sf_dir):
    """QA7, QA10: prompts of every turn in all modes, each with its own keys."""
    chunks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    rows = jobs.prompts(chunks.withColumn("name", F.lpad(F.col("turn").cast("string"), 9, "0")), 5, jobs.MODES, "conv_id", "turn", "name", "text")
    return rows.select("conv_id", "turn", "mode", "n_questions", F.md5("prompt").alias("prompt_md5"))


@query("""SELECT o_orderkey, o_orderstatus IN ('O') OR (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 10 MINUTE) OR o_orderstatus = 'X' AS due FROM orders""")
def answers_due(spark, sf_dir):
    """FLT4: rows that are pending, stale or failed."""
    names = F.create_map(*[F.lit(x) for p in (("O", "pending"), ("P", "processing"), ("F", "completed"), ("X", "failed")) for x in p])
    due = jobs.due_for_answer(names[F.col("o_orderstatus")], F.col("o_orderdate"), F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), include_failed=True)
    return table(spark, sf_dir, "orders").select("o_orderkey", due.alias("due"))


@query("""SELECT source AS task_id, count(*) AS created_questions, count(DISTINCT lang)::INTEGER AS n_files, count(*) AS qa_count FROM documents GROUP BY source""")
def run_listing(spark, sf_dir):
    """AGG14, SNK4: run summaries written as JSON and listed again."""
    files = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    entry = F.struct(F.col("lang").alias("filename"), F.col("n").alias("qa_count"))
    runs = files.groupBy("source").agg(F.to_json(F.struct(F.col("source").alias("task_id"), F.sum("n").alias("created_questions"), F.map_from_entries(F.collect_list(F.struct("lang", entry))).alias("files"))).alias("summary"))
    return jobs.run_listing(runs)


@query(r"""SELECT conv_id, turn, CAST((length(t) - length(replace(t, '<image>', ''))) // 7 AS INTEGER) AS n_images, (length(t) - length(replace(t, '<image>', ''))) // 7 = turn % 3 AND turn % 2 = 0 AS matches
  FROM (SELECT conv_id, turn, repeat('<image>', CAST(turn % 3 AS INTEGER)) || text || CASE WHEN turn % 2 = 1 THEN '<audio>' ELSE '' END AS t FROM conversations)""")
def media_placeholders(spark, sf_dir):
    """TRN18: placeholders of each row against its media."""
    t = F.concat(F.repeat(F.lit("<image>"), (F.col("turn") % 3).cast("int")), "text", F.when(F.col("turn") % 2 == 1, "<audio>").otherwise(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"), F.array_repeat(F.lit("a.png"), (F.col("turn") % 3).cast("int")).alias("images"), F.array().cast("array<string>").alias("none"))
    return rows.select("conv_id", "turn", jobs.placeholder_counts(F.col("t")).image.alias("n_images"), jobs.media_match(F.col("t"), F.col("images"), F.col("none"), F.col("none")).alias("matches"))


@query("""SELECT n AS id, 'only in documents' AS side FROM (SELECT doc_id AS n FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT n, 'both' FROM (SELECT doc_id AS n FROM documents INTERSECT SELECT doc_id FROM labels)""")
def id_sets(spark, sf_dir):
    """SET3: difference and intersection of ids."""
    docs, labels = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return docs.join(labels, "id", "left_anti").distinct().withColumn("side", F.lit("only in documents")).unionByName(docs.join(labels, "id", "left_semi").distinct().withColumn("side", F.lit("both")))


@query("""SELECT rule, original, replacement, count(*) AS n FROM (SELECT 'email' AS rule, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')) AS m FROM documents),
  LATERAL (SELECT CASE WHEN length(m) > 10 THEN left(m, 10) || '...' ELSE m END AS original, '**邮箱**' AS replacement) GROUP BY rule, original, replacement""".replace("\\\\", "\\"))
def audit_listing(spark, sf_dir):
    """DES9: audit rows of one rule, originals shortened."""
    from millrace.operators import privacy

    found = table(spark, sf_dir, "documents").select(F.explode(privacy.found(F.col("text"), "email")).alias("m"))
    short = F.when(F.length("m") > 10, F.concat(F.left("m", F.lit(10)), F.lit("..."))).otherwise(F.col("m"))
    return found.select(F.lit("email").alias("rule"), short.alias("original"), F.lit("**邮箱**").alias("replacement")).groupBy("rule", "original", "replacement").agg(F.count("*").alias("n"))


@query("""SELECT event_type, avg((a + b) / 2) AS overall, count(*) AS n FROM (SELECT event_type, CAST(event_id % 5 AS DOUBLE) AS a, CAST(user_id % 7 AS DOUBLE) AS b FROM events) GROUP BY event_type""")
def overall_score(spark, sf_dir):
    """AGG16: the mean of the metrics of each row, by type."""
    rows = table(spark, sf_dir, "events").select("event_type", jobs.overall(F.col("event_id") % 5, F.col("user_id") % 7, F.lit(None).cast("double")).alias("s"))
    return rows.groupBy("event_type").agg(F.avg("s").alias("overall"), F.count("*").alias("n"))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 5 AND c_mktsegment = 'BUILDING' AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""")
def equality_filters(spark, sf_dir):
    """FLT1-3: a conjunction of equalities and a semi-join."""
    nations = table(spark, sf_dir, "nation").where("n_regionkey < 3").select("n_nationkey")
    return catalog.where_in(catalog.where_equal(table(spark, sf_dir, "customer"), c_nationkey=5, c_mktsegment="BUILDING", no_such_column=1), "c_nationkey", nations).select("c_custkey", "c_name")


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 OR n_regionkey = 0 ORDER BY n_regionkey = 0, n_nationkey LIMIT 1""")
def default_row(spark, sf_dir):
    """FLT14: the own default, else the global one."""
    rows = table(spark, sf_dir, "nation").where("n_regionkey in (0, 2)").select(F.col("n_nationkey").alias("id"), "n_name", F.lit("true").alias("is_default"), F.when(F.col("n_regionkey") == 2, "p").alias("project_id"))
    return catalog.default_for(rows, "p").select(F.col("id").alias("n_nationkey"), "n_name")


_LINK = r"""regexp_replace(regexp_replace(regexp_replace(CASE WHEN l LIKE '/%' THEN regexp_extract(src, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || l ELSE l END, '#.*$', ''), '([&?])(utm_[^&]*|fbclid|gclid|ref|source|from|spm|nsukey)=[^&]*', '', 'g'), '[?&]+$', '')"""


@query(rf"""WITH s AS (SELECT regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([&?])(utm_[^&]*|fbclid|gclid|ref|source|from|spm|nsukey)=[^&]*', '', 'g'), '[?&]+$', '') AS src,
  unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS l FROM pages), r AS (SELECT DISTINCT src, {_LINK} AS dst FROM s WHERE l LIKE '/%' AND l NOT LIKE '//%')
SELECT regexp_extract(src, '://([^/?#]*)', 1) AS host, count(*) AS n_links, count(DISTINCT src) AS n_pages FROM r WHERE regexp_matches(dst, '^https?://') GROUP BY 1""")
def links_by_host(spark, sf_dir):
    """STR11, 14, 16: links to pages of the same host, by host."""
    from millrace.functions.url import host

    return crawl.page_links(table(spark, sf_dir, "pages")).groupBy(host(F.col("src")).alias("host")).agg(F.count("*").alias("n_links"), F.countDistinct("src").alias("n_pages"))
