"""Queries over tables of cells: profiles, repair, chunks, questions and Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.operators import chunking, layout, privacy, qa, tables
from millrace.plans.registry import query
from millrace.session import table

_PROFILED = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def _profile_sql(c: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    kind = "CASE WHEN count(*) FILTER (lower(v) IN ('true', 'false', '是', '否', 'yes', 'no', '0', '1')) = count(v) THEN 'boolean' WHEN count(TRY_CAST(v AS DOUBLE)) > 0.8 * count(v) THEN 'integer' ELSE 'string' END"
    return f"""SELECT '{c}' AS "column", count(*) AS n, count(*) - count(v) AS n_missing, 0.0::DOUBLE AS missing_rate, {kind} AS type,
      (SELECT x FROM (SELECT {v} AS x, count(*) AS k FROM customer GROUP BY 1 ORDER BY k DESC, x LIMIT 1)) AS mode,
      (SELECT string_agg(x, '|' ORDER BY c_custkey) FROM (SELECT {v} AS x, c_custkey FROM customer ORDER BY c_custkey LIMIT 3)) AS samples FROM (SELECT {v} AS v FROM customer)"""


@query(" UNION ALL ".join(_profile_sql(c) for c in _PROFILED))
def profile_columns(spark, sf_dir):
    """STR6, AGG9-11: type, missing rate, mode and samples of each column."""
    return tables.profile(table(spark, sf_dir, "customer"), list(_PROFILED), "c_custkey")


@query("""WITH a AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, nullif(o_orderpriority, '5-LOW') AS priority, o_custkey FROM orders), b AS (SELECT * FROM a WHERE priority IS NOT NULL)
SELECT o_orderkey, coalesce(status, (SELECT status FROM b WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status, priority FROM b""")
def fill_missing(spark, sf_dir):
    """VAL13: rows dropped for one column, then the mode for another."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return tables.repair_missing(rows, [("priority", "drop_row", None), ("status", "fill_mode", None)])


@query("""SELECT c_custkey, concat_ws(chr(10), 'c_custkey: ' || c_custkey, 'c_name: ' || c_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'c_mktsegment: ' || c_mktsegment END) AS content FROM customer""")
def rows_to_chunks(spark, sf_dir):
    """CHK12: each row as lines of column and value."""
    rows = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return rows.select("c_custkey", chunking.row_chunks(["c_custkey", "c_name", "c_mktsegment"]).alias("content"))


def _case(templates, shift, **values):
    out = []
    for k, t in enumerate(templates):
        for name, v in values.items():
            t = t.replace("{" + name + "}", f"' || {v} || '")
        out.append(f"WHEN (p_partkey + {shift}) % {len(templates)} = {k} THEN '{t}'")
    return "CASE " + " ".join(out) + " END"


_C, _F1 = "'品牌为' || p_brand || '，类型为' || p_type", "'品牌为' || p_brand"
_V1, _V2 = "p_size::VARCHAR", "p_name"
_ORACLE_QA = " UNION ALL ".join(
    f"SELECT p_partkey, {i} AS position, {q} AS question, {a} AS answer, '{t}' AS template_type FROM part"
    for i, (q, a, t) in enumerate((
        (_case(qa.FORWARD, 0, conditions=_C, first_condition=_F1, target="'尺寸'", target_qw="'是多少'"), f"'尺寸为' || {_V1} || '。'", "forward"),
        (_case(qa.REVERSE, 0, target="'尺寸'", target_value=_V1, feature="'品牌'"), "'品牌是' || p_brand || '。'", "reverse"),
        (_case(qa.MULTI, 0, conditions=_C, first_condition=_F1, target_list="'尺寸和名称'"), f"'尺寸为' || {_V1} || '，名称是' || {_V2} || '。'", "multi_target"),
        (_case(qa.SUMMARY, 0, conditions=_C), f"'根据记录，' || {_C} || '，尺寸为' || {_V1} || '，名称为' || {_V2} || '。'", "summary"),
    ))
)


@query(_ORACLE_QA)
def structured_qa(spark, sf_dir):
    """QA1-5: four pairs of different kinds for each part."""
    rows = table(spark, sf_dir, "part")
    features = [("品牌", "string", F.col("p_brand")), ("类型", "string", F.col("p_type"))]
    targets = [("尺寸", "integer", F.col("p_size").cast("string")), ("名称", "string", F.col("p_name"))]
    pairs = rows.select("p_partkey", qa.candidates(features, targets, F.col("p_partkey")).alias("ps")).select("p_partkey", F.posexplode(qa.diverse(F.col("ps"), 4)).alias("position", "p"))
    return pairs.select("p_partkey", "position", "p.question", "p.answer", "p.template_type")


@query("""WITH f AS (SELECT c_mktsegment, min(c_custkey) AS first FROM customer GROUP BY 1), n AS (SELECT c_mktsegment, row_number() OVER (ORDER BY first) AS i FROM f)
SELECT c_custkey, '**c_mktsegment值' || chr(CAST(64 + i AS INTEGER)) || '**' AS masked FROM customer JOIN n USING (c_mktsegment)""")
def column_mask(spark, sf_dir):
    """DES8: values replaced by numbered placeholders in order of first appearance."""
    return privacy.mask_column(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", "masked").select("c_custkey", "masked")


def _grid(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("sheet"), F.col("n_nationkey").alias("row"), F.array(F.col("n_nationkey").cast("string"), "n_name").alias("cells"))
    return rows.select("sheet", "row", F.posexplode("cells").alias("col", "value"))


@query("""SELECT 'region ' || n_regionkey AS sheet, regexp_replace(string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey), chr(10), chr(10) || '| --- | --- |' || chr(10)) AS markdown FROM nation GROUP BY n_regionkey""")
def grid_markdown(spark, sf_dir):
    """SRC4, SRC17: sheets of cells as Markdown tables."""
    return tables.grid_to_markdown(_grid(spark, sf_dir))


@query("""WITH h AS (SELECT n_regionkey, min(n_nationkey) AS k FROM nation GROUP BY 1) SELECT 'region ' || n.n_regionkey AS sheet, n.n_nationkey AS row, a.n_name || '‖' || n.n_nationkey || '‖' || n.n_name AS line
FROM nation n JOIN h USING (n_regionkey) JOIN nation a ON a.n_nationkey = h.k WHERE n.n_nationkey <> h.k""")
def grid_lines(spark, sf_dir):
    """CHK13: header, row header and value of each body cell, the first row of a sheet as header."""
    grid = _grid(spark, sf_dir)
    first = grid.groupBy("sheet").agg(F.min("row").alias("k"))
    placed = grid.join(first, "sheet").withColumn("at", F.col("row")).withColumn("row", F.when(F.col("row") == F.col("k"), -1).otherwise(F.col("row"))).drop("k")
    out = tables.grid_to_lines(placed, 0, 1)
    return out.select("sheet", "row", "line")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_type || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events""")
def fill_forward(spark, sf_dir):
    """WIN7-8: the last header that isn't blank, carried forward."""
    rows = table(spark, sf_dir, "events").withColumn("h", F.when(F.col("event_type") == "purchase", F.concat("event_type", F.col("event_id").cast("string"))))
    return tables.fill_forward(rows, "user_id", "event_id", "h", "filled").select("event_id", "filled")


_HEADS = (("部门", "组", "2024年", None, "2025年", None), (None, None, "Q1", "Q2", "Q1", "Q2"), (None, None, "销售额", "销售额", "销售额", "利润率"))


@query("""SELECT n_regionkey AS sheet, 2 + k AS row, '部门: ' || CASE WHEN k % 3 = 0 THEN before ELSE n_name END || chr(10) || '组: ' || n_name || chr(10) ||
'2024年 Q1 销售额: ' || n_nationkey || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN '2024年 Q2 销售额: ' || n_nationkey || chr(10) ELSE '' END || '2025年 Q1 销售额: ' || (n_nationkey + 1) || chr(10) || '2025年 Q2 利润率: ' || n_nationkey || '%' AS content
FROM (SELECT *, 1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, lag(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS before FROM nation)""")
def table_records(spark, sf_dir):
    """CHK11: rows of sheets with three header rows and merged row headers, their structure found."""
    w = W.Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    key = F.col("n_nationkey").cast("string")
    body = table(spark, sf_dir, "nation").withColumn("row", F.row_number().over(w) + 2)
    body = body.select(F.col("n_regionkey").alias("sheet"), "row", F.array(F.when(F.col("row") % 3 != 1, F.col("n_name")), "n_name", key, F.when(F.col("n_nationkey") % 2 == 0, key), (F.col("n_nationkey") + 1).cast("string"), F.concat(key, F.lit("%"))).alias("cells"))
    heads = F.array(*[F.struct(F.lit(i).alias("row"), F.array(*[F.lit(x).cast("string") for x in cells]).alias("cells")) for i, cells in enumerate(_HEADS)])
    sheets = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("sheet")).distinct().select("sheet", F.explode(heads).alias("h")).select("sheet", "h.row", "h.cells")
    return layout.grid_records(sheets.unionByName(body).select("sheet", "row", F.posexplode("cells").alias("col", "value")))


@query("""WITH g AS (SELECT vec_id // 60 AS s, vec_id % 60 // 6 AS r, vec_id % 6 AS c, CASE WHEN vec_id % 7 > 0 THEN label END AS v, embedding::DOUBLE[] AS x FROM embeddings),
f AS (SELECT s, coalesce(min(r) FILTER (c = 0 AND v IS NOT NULL), 0) AS r0, coalesce(min(c) FILTER (r = 0 AND v IS NOT NULL), 0) AS c0, max(r) + 1 AS n_rows, max(c) + 1 AS n_cols FROM g GROUP BY s),
p AS (SELECT a.s, a.r - r0 AS i, b.r - r0 AS k, a.c - c0 AS j, list_cosine_similarity(a.x, b.x) AS sim FROM g a JOIN g b ON a.s = b.s AND a.c = b.c AND a.r < b.r JOIN f ON f.s = a.s WHERE a.v IS NOT NULL AND b.v IS NOT NULL AND a.r >= r0 AND b.r < r0 + 10 AND a.c >= c0 AND a.c < c0 + 10),
ri AS (SELECT s, unnest(range(0, least(10, n_rows - r0) - 1)) AS i FROM f), rs AS (SELECT ri.s, ri.i, coalesce(avg(sim), 0) AS sim FROM ri LEFT JOIN p ON p.s = ri.s AND p.i = ri.i AND p.k = ri.i + 1 GROUP BY ALL),
rd AS (SELECT s, min(i) AS down FROM (SELECT *, sim - lag(sim) OVER (PARTITION BY s ORDER BY i) AS d FROM rs) WHERE d > 0.1 GROUP BY s),
ci AS (SELECT s, unnest(range(0, least(10, n_cols - c0))) AS j FROM f), cs AS (SELECT ci.s, ci.j, CASE WHEN count(sim) >= 3 THEN avg(sim) ELSE 0 END AS sim FROM ci LEFT JOIN p ON p.s = ci.s AND p.j = ci.j AND p.k < 5 GROUP BY ALL),
cd AS (SELECT s, coalesce(min(j) FILTER (d > 0.1), CASE WHEN max(sim) FILTER (j = 0) > 0.6 THEN 0 ELSE min(j) FILTER (sim > 0.7) END) AS rightward FROM (SELECT *, sim - lag(sim) OVER (PARTITION BY s ORDER BY j) AS d FROM cs) GROUP BY s)
SELECT s AS sheet, r0 + coalesce(down, 0) AS data_row, c0 + coalesce(rightward, 0) AS data_col FROM f LEFT JOIN rd USING (s) LEFT JOIN cd USING (s)""")
def table_bounds(spark, sf_dir):
    """CHK14: where the data of a sheet begin, by the vectors of its cells."""
    cells = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 60).alias("sheet"), F.floor(F.col("vec_id") % 60 / 6).alias("row"), (F.col("vec_id") % 6).alias("col"), F.when(F.col("vec_id") % 7 > 0, F.col("label")).alias("value"), F.col("embedding").alias("vec"))
    return layout.table_bounds(cells)
