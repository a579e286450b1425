"""Queries of the relational core."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.operators import catalog
from millrace.operators.qa import full_documents, with_neighbours
from millrace.operators.ranking import attach
from millrace.plans.registry import query
from millrace.session import table


@query("""SELECT o_custkey AS batch_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS failed,
  min(o_orderdate) AS created_at, max(o_orderpriority) AS source FROM orders GROUP BY o_custkey""")
def batch_stats(spark, sf_dir):
    """AGG1: counts by status, first date and source of each batch."""
    status = F.col("o_orderstatus")
    counts = catalog.by_status(("completed", status == "F"), ("pending", status == "O"), ("failed", status == "P"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("batch_id")).agg(F.count("*").alias("total"), *counts, F.min("o_orderdate").alias("created_at"), F.max("o_orderpriority").alias("source"))


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_totalprice < 100000) AS low, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS failed FROM orders""")
def batch_detail(spark, sf_dir):
    """AGG2: filtered counts of the whole table."""
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("total"), *catalog.by_status(("completed", F.col("o_orderstatus") == "F"), ("low", F.col("o_totalprice") < 100000), ("failed", F.col("o_orderstatus") == "P")))


@query("""SELECT batch_id, array_to_string(list_sort(list_distinct(list(f))), ',') AS files FROM (
  SELECT o_custkey AS batch_id, o_orderpriority AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 50 GROUP BY batch_id""")
def batch_files(spark, sf_dir):
    """AGG3: distinct file names among the first 50 rows of each batch."""
    rows = catalog.interleaved_pages(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 50)
    return rows.groupBy(F.col("o_custkey").alias("batch_id")).agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("files"))


@query("""SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM conversations WHERE role = 'user') AS questions, (SELECT count(*) FROM conversations WHERE role = 'assistant') AS answers,
  (SELECT count(*) FROM benchmark) AS eval_sets, (SELECT count(*) FROM labels WHERE quality = 1) AS completed""")
def project_stats(spark, sf_dir):
    """AGG4: counts over several tables in one row."""
    t = lambda n: table(spark, sf_dir, n)
    one = lambda df, **c: df.agg(*[v.alias(k) for k, v in c.items()])
    parts = [
        one(t("documents"), files=F.count("*")), one(t("conversations"), questions=F.count_if(F.col("role") == "user"), answers=F.count_if(F.col("role") == "assistant")),
        one(t("benchmark"), eval_sets=F.count("*")), one(t("labels"), completed=F.count_if(F.col("quality") == 1)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = attach(out, p)
    return out


@query("""SELECT count(*) AS total, count(*) FILTER (quality = 1 AND toxic = 0) AS correct, count(*) FILTER (quality = 1 AND toxic = 1) AS partial, count(*) FILTER (quality = 0) AS incorrect,
  (count(*) FILTER (quality = 1 AND toxic = 0))::DOUBLE / count(*) AS accuracy, ((count(*) FILTER (quality = 1 AND toxic = 0)) + 0.5::DOUBLE * (count(*) FILTER (quality = 1 AND toxic = 1))) / count(*) AS correct_rate, avg(quality)::DOUBLE AS avg_score FROM labels""")
def eval_stats(spark, sf_dir):
    """AGG5: correct, partial and incorrect answers, and their rates."""
    q, t = F.col("quality"), F.col("toxic")
    counts = table(spark, sf_dir, "labels").agg(F.count("*").alias("total"), *catalog.by_status(("correct", (q == 1) & (t == 0)), ("partial", (q == 1) & (t == 1)), ("incorrect", q == 0)), F.avg("quality").alias("avg_score"))
    return counts.select("total", "correct", "partial", "incorrect", (F.col("correct") / F.col("total")).alias("accuracy"), ((F.col("correct") + 0.5 * F.col("partial")) / F.col("total")).alias("correct_rate"), "avg_score")


@query("""SELECT CASE WHEN trim(text) = '' THEN 'blank' WHEN length(text) < 20 THEN 'short' ELSE 'ok' END AS state, count(*) AS n FROM conversations GROUP BY 1""")
def validation_tally(spark, sf_dir):
    """AGG6: rows by the first rule that holds."""
    state = F.when(F.trim("text") == "", "blank").when(F.length("text") < 20, "short").otherwise("ok")
    return table(spark, sf_dir, "conversations").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""SELECT source, avg(quality) * 20 AS score_100, round(avg(quality), 1)::DOUBLE AS score_5, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def task_averages(spark, sf_dir):
    """AGG7: mean scores of each source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source").agg((F.avg("quality") * 20).alias("score_100"), F.round(F.avg("quality"), 1).alias("score_5"), F.count("*").alias("n"))


@query("""SELECT lang, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(greatest(1, least(5, length(text) // 240))) AS BIGINT) AS n_questions FROM documents GROUP BY lang""")
def question_estimate(spark, sf_dir):
    """AGG8: characters and the number of questions that they allow."""
    from millrace.operators.qa import question_count

    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.length("text")).cast("long").alias("n_chars"), F.sum(question_count(F.col("text"), 5)).cast("long").alias("n_questions"))


@query("""SELECT lang, source, count(*) AS qa_count, count(*) FILTER (length(text) >= 100) AS processed, count(*) FILTER (length(text) < 100) AS skipped FROM documents GROUP BY ROLLUP (lang, source)""")
def run_summary(spark, sf_dir):
    """AGG13: counts by file, by group and in total."""
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("qa_count"), *catalog.by_status(("processed", F.length("text") >= 100), ("skipped", F.length("text") < 100)))


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def dashboard_recent(spark, sf_dir):
    """AGG12: the five latest rows."""
    return catalog.page(table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 0, 5).select("o_orderkey", "o_totalprice", "o_orderdate")


@query("""SELECT label, avg(hit) * 100 AS accuracy, count(*) AS n FROM (SELECT label, CASE WHEN vec_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM embeddings) GROUP BY ROLLUP (label)""")
def choice_accuracy(spark, sf_dir):
    """AGG17: percent correct by category and in total."""
    from millrace.operators.metrics import accuracy_by_category

    rows = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 3 == 0).cast("int").alias("hit"))
    return accuracy_by_category(rows, "label", "hit")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, o_orderstatus, c_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  WHERE l_returnflag = 'R' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50 OFFSET 100""")
def questions_page(spark, sf_dir):
    """JN1, SRT1: a page of rows, then their parents: only the page is joined."""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    one = catalog.page(rows, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 100, 50)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return one.join(orders, "l_orderkey", "left").join(customers, "o_custkey", "left").select("l_orderkey", "l_linenumber", "l_quantity", "o_orderstatus", "c_name")


@query("""SELECT o_orderpriority, c_mktsegment, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  WHERE l_returnflag IN ('A', 'R') AND (o_orderstatus = 'F' OR o_orderstatus = 'P') GROUP BY 1, 2""")
def eligible_answers(spark, sf_dir):
    """FLT3-4, JN2: an inner and an outer join with IN and OR predicates."""
    rows = catalog.where_in(table(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "R"]).select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") | (F.col("o_orderstatus") == "P"))
    joined = rows.join(orders, "o_orderkey").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("o_orderpriority", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("""SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 GROUP BY lang, quality""")
def eval_results(spark, sf_dir):
    """JN3: results with the set that they belong to."""
    return table(spark, sf_dir, "labels").where("toxic = 0").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce(quality, -1) AS quality, quality IS NULL AS missing FROM documents LEFT JOIN labels USING (doc_id)")
def missing_results(spark, sf_dir):
    """JN6, JN8: results, and a placeholder where there is none."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(False).alias("missing"))
    return catalog.complete_missing(table(spark, sf_dir, "documents"), labels, "doc_id", quality=F.lit(-1), missing=F.lit(True))


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def same_text(spark, sf_dir):
    """JN7: documents of equal text, the first of each."""
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1")


@query("""SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_rows(spark, sf_dir):
    """SRT2: the latest row of each type."""
    return catalog.latest(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], ["event_id", "value"])


@query("""SELECT t.event_id, count(o.o_orderkey) AS n_orders FROM events t LEFT JOIN orders o ON CAST(json_extract_string(t.props, '$.k') AS BIGINT) = o.o_orderkey GROUP BY t.event_id""")
def task_batches(spark, sf_dir):
    """JN5: rows joined through a key inside JSON text."""
    events = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("o_orderkey"))
    return events.join(table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("one")), "o_orderkey", "left").groupBy("event_id").agg(F.count("one").alias("n_orders"))


@query("""SELECT conv_id, turn, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), '') AS after FROM conversations""")
def neighbor_context(spark, sf_dir):
    """JN10, WIN1: the texts beside each turn."""
    return with_neighbours(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text").select("conv_id", "turn", "before", "after")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS document, count(*) AS n_chunks FROM conversations GROUP BY conv_id")
def full_document(spark, sf_dir):
    """QA9: the turns of each conversation in order."""
    return full_documents(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("SELECT doc_id, lang FROM documents WHERE lower(text) LIKE '%license%' OR lower(source) LIKE '%src1%'")
def keyword_search(spark, sf_dir):
    """FLT5: a keyword in either of two columns."""
    docs = table(spark, sf_dir, "documents")
    return catalog.search(docs, "LICENSE", "text").unionByName(catalog.search(docs, "src1", "source").where(~F.lower("text").contains("license"))).select("doc_id", "lang")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'unknown' END AS status,
  CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'processing' ELSE o_orderstatus END AS claimed FROM orders""")
def status_labels(spark, sf_dir):
    """FLT6-9: labels by a map, and an update guarded by a predicate."""
    names = F.create_map(*[F.lit(x) for p in (("F", "completed"), ("O", "pending"), ("P", "processing")) for x in p])
    rows = table(spark, sf_dir, "orders").withColumn("claimed", F.col("o_orderstatus"))
    rows = catalog.update_where(rows, (F.col("claimed") == "O") & (F.col("o_totalprice") > 200000), claimed=F.lit("processing"))
    return rows.select("o_orderkey", F.coalesce(names[F.col("o_orderstatus")], F.lit("unknown")).alias("status"), "claimed")


@query("""SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL
  SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL
  SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))""")
def delete_cascade(spark, sf_dir):
    """FLT10: rows left after a delete that follows two levels of keys."""
    customers, orders, lines = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    kept = catalog.delete_cascade(customers, customers.where("c_mktsegment = 'BUILDING'"), "c_custkey", (orders, "o_orderkey", "o_custkey"), (lines, "l_orderkey", "l_orderkey"))
    out = None
    for name, df in zip(("customer", "orders", "lineitem"), kept, strict=True):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT coalesce(a.n_nationkey, b.n_nationkey) AS key, coalesce(b.n_name, a.n_name) AS name FROM (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20) a
  FULL JOIN (SELECT n_nationkey, lower(n_name) AS n_name FROM nation WHERE n_nationkey >= 10) b ON a.n_nationkey = b.n_nationkey""")
def merge_fields(spark, sf_dir):
    """FLT13: fields updated by name, unknown ones appended."""
    nation = table(spark, sf_dir, "nation")
    old = nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    new = nation.where("n_nationkey >= 10").select(F.col("n_nationkey").alias("key"), F.lower("n_name").alias("name"))
    return catalog.merge_fields(old, new, "key")


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, coalesce((SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS orders FROM customer""")
def eager_relations(spark, sf_dir):
    """JN9: each row with its children, in one grouped join."""
    children = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("o"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(children, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("o", F.lit("")).alias("orders"))


@query("""SELECT user_id, event_id, (sum(cents) OVER w)::DOUBLE / count(cents) OVER w AS running FROM (SELECT user_id, event_id, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_average(spark, sf_dir):
    """AGG19: the mean so far of each user, over exact integers."""
    w = W.Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    rows = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return rows.select("user_id", "event_id", (F.sum("cents").over(w).cast("double") / F.count("cents").over(w)).alias("running"))
