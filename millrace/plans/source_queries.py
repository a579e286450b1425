"""Queries that write and read files: encodings, formats, exports, registries, run folders and streams. Files lie in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.operators import privacy
from millrace.plans.registry import query
from millrace.session import spread, table
from millrace.sources import databases, files, sinks
from millrace.storage import fresh_path
from millrace.streaming import training_log


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '编号' || turn || '：中文' ELSE text END AS text FROM conversations WHERE text IS NOT NULL")
def decoded_bytes(spark, sf_dir):
    """SRC1, SRC13: bytes in UTF-8 or GBK as text."""
    gbk = lambda text: F.unhex(F.lit(text.encode("gbk").hex()))
    raw = F.when(F.col("turn") % 2 == 0, F.concat(gbk("编号"), F.encode(F.col("turn").cast("string"), "UTF-8"), gbk("：中文"))).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", files.decoded(raw).alias("text"))


@query("SELECT 'A' || n_nationkey || '.' || ext AS name, kind FROM nation, (VALUES ('doc', 'docx'), ('DOCX', 'docx'), ('xls', 'xlsx'), ('csv', 'csv'), ('pdf', 'pdf'), ('markdown', 'md'), ('bin', 'txt')) e(ext, kind)")
def file_kinds(spark, sf_dir):
    """SRC22, 23: the kind of each file by its extension."""
    ext = F.explode(F.array(*map(F.lit, ("doc", "DOCX", "xls", "csv", "pdf", "markdown", "bin"))))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", ext.alias("e")).select(F.concat(F.lit("A"), F.col("n_nationkey").cast("string"), F.lit("."), "e").alias("name"))
    return rows.select("name", files.file_kind(F.col("name")).alias("kind"))


@query("""SELECT c_mktsegment AS split, count(*) AS n, (SELECT count(*) FROM customer) AS samples, 'alpaca' AS format FROM customer GROUP BY c_mktsegment""")
def exported_splits(spark, sf_dir):
    """SNK1, 2, SRC27, 30-32: splits exported as JSON lines, read again by extension, counted and told apart."""
    path = fresh_path(spark, "export")
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("split"), F.col("c_name").alias("instruction"), F.col("c_nationkey").cast("string").alias("output"))
    sinks.export_splits(rows, path)
    back = spark.read.json(path)
    return back.groupBy("split").agg(F.count("*").alias("n")).withColumn("samples", F.lit(files.sample_count(spark, path + "/*")).cast("long")).withColumn("format", F.lit(files.sniff_format(back)))


@query("""SELECT p_partkey, p_name AS question, p_type AS answer, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS rejected, p_partkey % 3 = 0 AS is_dpo FROM part""")
def imported_pairs(spark, sf_dir):
    """SRC33, SNK9: pairs under any of the known column names."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("").alias("instruction"), F.col("p_name").alias("prompt"), F.col("p_type").alias("response"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise("").alias("rejected_answer"))
    path = fresh_path(spark, "import")
    rows.write.json(path)
    back = spark.read.json(path)
    return back.select("p_partkey", files.coalesced(back, files.QUESTION_ALIASES).alias("question"), files.coalesced(back, files.ANSWER_ALIASES).alias("answer"), files.coalesced(back, ("rejected", "rejected_answer")).alias("rejected")).withColumn("is_dpo", F.col("rejected") != "")


@query("""SELECT 'csv' AS file_type, 'completed' AS status, count(*) AS row_count, 'n_nationkey,n_name,n_regionkey' AS fields, min(n_name) AS first_name FROM nation""")
def imported_table(spark, sf_dir):
    """SRC9-12: a catalogue table as CSV, its row of the files table, and a preview."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = fresh_path(spark, "nation")
    row = databases.import_table(spark, nation, path)
    first, _ = files.preview(files.read_csv(spark, path), ["n_name"], 1)
    return row.select("file_type", "status", "row_count", F.array_join(F.transform("field_schema", lambda f: f["name"]), ",").alias("fields")).crossJoin(F.broadcast(first.select(F.col("n_name").alias("first_name"))))


@query("SELECT action, count(*) AS n, max(id) AS last FROM (SELECT n_nationkey AS id, 'create' AS action FROM nation UNION ALL SELECT r_regionkey, 'delete' FROM region) GROUP BY action")
def audit_log(spark, sf_dir):
    """SNK10: rows appended to the audit log."""
    path = fresh_path(spark, "audit")
    databases.append(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("create").alias("action")), path)
    databases.append(table(spark, sf_dir, "region").select(F.lit("delete").alias("action"), F.col("r_regionkey").cast("long").alias("id")), path)
    return spark.read.parquet(path).groupBy("action").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query(r"""SELECT page_id, rtrim(substring(trim(regexp_replace('Page/' || page_id || '?', '[\\/:*?"<>|\x00-\x1f]', '_', 'g')), 1, 80), '. ') || '.md' AS filename, '# Page/' || page_id || '?' || chr(10) || chr(10) || '> 来源: ' || url || chr(10) || chr(10) || 'body' AS document FROM pages WHERE page_id % 2 = 0""")
def saved_pages(spark, sf_dir):
    """SNK6: crawled pages as Markdown under safe names, those without content left out."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("Page/"), F.col("page_id").cast("string"), F.lit("?")).alias("title"), F.when(F.col("page_id") % 2 == 0, "body").otherwise(" ").alias("content"))
    found = sinks.page_document(rows, "title", "url", "content")
    return found.select(F.regexp_extract("filename", r"_(\d+)_", 1).cast("long").alias("page_id"), "filename", "document")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS document, count(*) AS qa_count FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def ready_files(spark, sf_dir):
    """SNK4, 5: the Markdown of each file from its chunks, and its run summary."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.col("text").alias("content"))
    documents = sinks.ready_documents(rows, fresh_path(spark, "ready"), "conv_id", "turn")
    path = fresh_path(spark, "run")
    sinks.run_folder(rows, path, "conv_id")
    return documents.join(spark.read.json(f"{path}/summary"), "conv_id").select("conv_id", "document", "qa_count")


@query("SELECT event_id::VARCHAR AS prompt, event_type AS predict, user_id::VARCHAR AS label FROM events")
def dumped_predictions(spark, sf_dir):
    """SNK8: predictions as JSON lines, padding before them taken off."""
    path = fresh_path(spark, "predictions")
    pad = F.repeat(F.lit("<pad>"), (F.col("event_id") % 3).cast("int"))
    sinks.predictions(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("prompt"), F.concat(pad, "event_type").alias("predict"), F.col("user_id").cast("string").alias("label")), path)
    return spark.read.json(path).select("prompt", "predict", "label")


@query("SELECT count(*) AS rows, sum(event_id) AS steps, round(sum(value), 4) AS loss, count(*) FILTER (value > 50) AS high FROM events")
def followed_log(spark, sf_dir):
    """STM1, 2, 4, 6: a training log followed as a stream in two runs, no row twice, with counters of progress."""
    source, checkpoint, out = (fresh_path(spark, n) for n in ("log", "log-offsets", "log-rows"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("current_steps"), F.col("value").alias("loss"))
    for part in (0, 1):
        events.where(F.col("current_steps") % 2 == part).write.mode("append").json(source)
        training_log.follow(training_log.read_log(spark, source), checkpoint, lambda df, n: df.select("current_steps", "loss").write.mode("append").parquet(out)).awaitTermination()
    seen, progress = training_log.counted(spark.read.parquet(out), "rows", high=F.col("loss") > 50)
    sums = seen.agg(F.sum("current_steps").alias("steps"), F.round(F.sum("loss"), 4).alias("loss")).first()
    found = progress.get
    return spark.createDataFrame([(found["rows"], sums.steps, sums.loss, found["high"])], "rows long, steps long, loss double, high long")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment AS segment, c_custkey % 2 = 0 AS even, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row FROM customer WHERE c_nationkey % 5 = 0""")
def sheet_grid(spark, sf_dir):
    """SRC2, SRC5, SNK9: customers as spreadsheets, one for each nation, read again as cells; three of the columns reach the reader as comparisons."""
    from millrace.sources import sheets

    sheets.register(spark)
    path = fresh_path(spark, "sheets")
    rows = table(spark, sf_dir, "customer").where("c_nationkey % 5 = 0")
    rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", (F.col("c_custkey") % 2 == 0).alias("even"), "c_nationkey").write.format("sheet").mode("append").save(path)
    cells = spark.read.format("sheet").load(path).where("row > 0 and col <> 2 and col <= 5")
    wide = cells.groupBy("path", "sheet", "row").pivot("col", [0, 1, 3, 4, 5]).agg(F.first("value"))
    place = W.Window.partitionBy("5").orderBy(F.col("0").cast("long"))
    return wide.select(F.col("0").alias("key"), F.col("1").alias("name"), F.col("3").alias("segment"), (F.col("4") == "TRUE").alias("even"), F.row_number().over(place).cast("long").alias("row"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '^[\\x00-\\x7F]*$') AND doc_id % 3 <> 2 THEN 'utf-8' WHEN doc_id % 3 = 0 THEN 'utf-8' WHEN doc_id % 3 = 1 THEN 'cp1252' ELSE 'utf-16-le' END AS encoding, text FROM documents WHERE length(text) > 8 AND NOT regexp_matches(text, '[^\\x00-\\x7F\\xA0-\\xFF]')""")
def detected_encodings(spark, sf_dir):
    """SRC1: texts written in three encodings without a mark, each told from its bytes alone and read back."""
    from millrace.sources.encodings import detected

    docs = table(spark, sf_dir, "documents").where("length(text) > 8").where(~F.col("text").rlike("[^\\x00-\\x7F\\xA0-\\xFF]"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-8")).when(F.col("doc_id") % 3 == 1, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-16LE"))
    return spread(docs).select("doc_id", detected(raw).alias("d")).select("doc_id", "d.encoding", "d.text")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'claimed' WHEN doc_id % 7 = 4 THEN 'again' ELSE 'waiting' END AS status, CASE WHEN doc_id % 7 = 4 THEN source || '!' ELSE source END AS source, 4 AS last_version FROM documents WHERE doc_id % 7 <> 5""")
def snapshot_claims(spark, sf_dir):
    """FLT8-10, SNK3: rows claimed under a guard, claimed again in vain, put anew and deleted, each a version of one table."""
    from millrace.sources.snapshots import Conflict, SnapshotTable

    docs = SnapshotTable(spark, fresh_path(spark, "snapshots"))
    docs.commit(table(spark, sf_dir, "documents").select("doc_id", F.lit("waiting").alias("status"), "source"), None)
    third, waits = F.col("doc_id") % 7 == 3, F.col("status") == "waiting"
    docs.claim(third, waits, {"status": F.lit("claimed")})
    docs.claim(third | (F.col("doc_id") % 7 == 6), waits, {"status": F.lit("lost")})  # some are no longer waiting
    try:
        docs.commit(docs.read(0).limit(0), 0)
    except Conflict:
        docs.put(docs.read().where("doc_id % 7 = 4").select("doc_id", F.lit("again").alias("status"), F.concat("source", F.lit("!")).alias("source")), "doc_id")
    docs.update(F.col("status") == "lost", {"status": F.lit("never")})
    last = docs.delete(F.col("doc_id") % 7 == 5)
    return docs.read().withColumn("last_version", F.lit(last))


_JOB_LINE = """CASE event_type WHEN 'signup' THEN '{' WHEN 'purchase' THEN '}' WHEN 'click' THEN '  "k": {' WHEN 'error' THEN 'ERROR at ' || CAST(event_id AS VARCHAR(20)) ELSE 'step ' || CAST(event_id AS VARCHAR(20)) END"""
_JOB_STATUS = "CASE WHEN event_type = 'error' AND value > 90 THEN 'failed' WHEN event_type = 'purchase' AND value > 150 THEN 'completed' ELSE 'running' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS job, event_id AS seq, ts, {_JOB_LINE} AS line, {_JOB_STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, 0 AS depth, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS TIMESTAMP) AS last, CAST(NULL AS VARCHAR) AS ended, CAST(NULL AS VARCHAR) AS line FROM e
  UNION ALL SELECT e.job, e.n, CASE WHEN w.depth = 0 THEN CASE WHEN trim(e.line) = '{{' THEN 1 ELSE 0 END ELSE greatest(0, w.depth - CASE WHEN starts_with(trim(e.line), '}}') THEN 1 ELSE 0 END + CASE WHEN ends_with(trim(e.line), '{{') THEN 1 ELSE 0 END) END,
  CASE WHEN e.ts - w.last > INTERVAL 2 DAY THEN w.seq ELSE e.seq END, e.ts, CASE WHEN e.ts - w.last > INTERVAL 2 DAY THEN 'stalled' WHEN e.status <> 'running' THEN e.status END,
  CASE WHEN coalesce(e.ts - w.last <= INTERVAL 2 DAY, true) AND w.depth = 0 AND trim(e.line) <> '{{' THEN e.line END
  FROM w JOIN e ON e.job = w.job AND e.n = w.n + 1 WHERE w.ended IS NULL),
z AS (SELECT job, max(n) AS n FROM w GROUP BY job),
o AS (SELECT job, seq, line, NULL AS ended FROM w WHERE line IS NOT NULL UNION ALL SELECT job, seq, NULL, ended FROM w WHERE ended IS NOT NULL
  UNION ALL SELECT job, seq, NULL, 'stalled' FROM w JOIN z USING (job, n) WHERE ended IS NULL AND (SELECT max(ts) FROM events) - last > INTERVAL 2 DAY)
SELECT *, CASE WHEN contains(line, 'ERROR') THEN 'error' WHEN line IS NOT NULL THEN 'info' END AS severity FROM o""")
def job_log(spark, sf_dir):
    """STM2, STM3: the lines of jobs (here users) as a stream of four parts, the query started anew for each; blocks in braces go, jobs end by status or silence."""
    from millrace.streaming.job_log import follow_jobs

    source, checkpoint, out = (fresh_path(spark, n) for n in ("jobs", "jobs-state", "jobs-rows"))
    events = table(spark, sf_dir, "events")
    lines = events.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), "ts", F.expr(_JOB_LINE).alias("line"), F.expr(_JOB_STATUS).alias("status"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = [int(c) for c in lines.select(at.alias("at")).approxQuantile("at", [0.25, 0.5, 0.75], 0.01)]
    for k in range(len(cuts) + 1):  # by time, as lines come to a stream: ids of one time may lie far apart
        part = lines.where(at > cuts[k - 1]) if k else lines
        part = part.where(at <= cuts[k]) if k < len(cuts) else part
        part.write.mode("append").parquet(source)
        follow_jobs(spark.readStream.schema(part.schema).parquet(source), out, checkpoint, idle="2 days").awaitTermination()
    return spark.read.parquet(out)


_TEXT = "t AS (SELECT doc_id, 'id 110101199000307' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '1') || ' card, 工号: ' || (10000 + doc_id) || ' and YG-AB-CD' || doc_id || ' call 138' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS t FROM documents)"


@query(f"""WITH {_TEXT} SELECT doc_id, regexp_extract(t, '[1-9][0-9]{{5}}(?:19|20)[0-9]{{3}}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{{3}}[0-9Xx]') AS id_card, CAST(10000 + doc_id AS VARCHAR) AS employee, 'YG-AB-CD' || doc_id AS document,
  '138' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS phone FROM t""")
def detect_identifiers(spark, sf_dir):
    """DES1: identity cards, employee numbers, document numbers and phones."""
    i = F.col("doc_id").cast("string")
    t = F.concat(F.lit("id 110101199000307"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "1"), F.lit(" card, 工号: "), (F.col("doc_id") + 10000).cast("string"), F.lit(" and YG-AB-CD"), i, F.lit(" call 138"), F.lpad(i, 8, "0"))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    first = lambda rule: F.coalesce(F.try_element_at(privacy.found(F.col("t"), rule), F.lit(1)), F.lit(""))
    return rows.select("doc_id", first("id_card").alias("id_card"), first("employee_id").alias("employee"), first("doc_number").alias("document"), first("phone").alias("phone"))


@query("""SELECT doc_id, 'pay **关键词A** in **关键词B** to **邮箱A**' AS masked, 3 AS n_audit, CASE WHEN doc_id % 2 = 0 THEN '薪资' ELSE 'wage' END AS first_original FROM documents""")
def masked_by_settings(spark, sf_dir):
    """DES2-5, 7: rules, exact keywords and patterns of a project's settings, old and new form, with their audit rows."""
    config = {"sensitive_rules": {"enabled_rules": ["email"], "keyword_rules": [{"keyword": r"\d{4}年\d+月", "mode": "regex"}]}, "desensitize_rules": {"keywords": ["薪资", "wage"]}}
    rules, words, patterns = privacy.configured(config)
    word = F.when(F.col("doc_id") % 2 == 0, "薪资").otherwise("wage")
    rows = table(spark, sf_dir, "documents").select("doc_id", word.alias("w"), F.concat(F.lit("pay "), word, F.lit(" in 2024年5月 to a@b.cc")).alias("text"))
    out = privacy.mask_text(rows, rules=rules, keywords=words, patterns=patterns)
    named = F.element_at(F.filter("masked.audit", lambda a: a.rule == "keyword"), 1)
    return out.select("doc_id", "masked.text", F.size("masked.audit").alias("n_audit"), named.original.alias("first_original")).withColumnRenamed("text", "masked")


@query(r"""SELECT page_id, '<div id="m' || page_id || '">in ' || page_id || '</div>' AS by_id, '<p class="x body y">para</p>' AS by_class FROM pages""")
def css_selectors(spark, sf_dir):
    """STR13: elements by id and by class."""
    from millrace.functions.url import select_css

    i = F.col("page_id").cast("string")
    html = F.concat(F.lit("<html><h1>t</h1><p class=\"x body y\">para</p><div id=\"m"), i, F.lit("\">in "), i, F.lit("</div></html>"))
    fixed = F.regexp_replace(html, r'id="m\d+"', 'id="main"')
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(select_css(fixed, "#main"), 'id="main"', F.concat(F.lit('id="m'), i, F.lit('"'))).alias("by_id"), select_css(html, ".body").alias("by_class"))


@query("SELECT 'documents' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'labels', count(*) FROM labels")
def row_counts(spark, sf_dir):
    """AGG22: rows of each table."""
    out = None
    for name in ("documents", "conversations", "labels"):
        one = table(spark, sf_dir, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
