import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import url as U
from millrace.operators import catalog, chunking, datasets, metrics, privacy, qa, tables, validation
from millrace.operators.budget import infer_lengths
from millrace.operators.ranking import ordered_position, shuffled_position


def one(spark, column, **values):
    df = spark.range(1).select(*[(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "level"), [("第一章 总则", 1), ("第三条 内容", 2), ("1.1 a", 3), ("1.1.1 a", 4), ("1. short", 3), ("1. " + "x" * 90, 0), ("(一)范围", 3), ("plain", 0), ("", 0)])
def test_heading_level(spark, text, level):
    assert one(spark, T.heading_level(F.col("t")), t=text) == level


@pytest.mark.parametrize(("text", "date"), [("2024-01-05", "2024-01-05"), ("2024/1/5", "2024-01-05"), ("2024年1月5日", "2024-01-05"), ("31/12/2023", "2023-12-31"), ("2024-13-01", None), ("x", None)])
def test_parse_date(spark, text, date):
    got = one(spark, T.parse_date(F.col("t")), t=text)
    assert (str(got) if got else None) == date


def test_text_functions(spark):
    assert one(spark, T.is_numeric_text(F.col("t")), t="12%") and one(spark, T.is_numeric_text(F.col("t")), t="1,234") and not one(spark, T.is_numeric_text(F.col("t")), t="a1")
    assert one(spark, T.weighted_length(F.col("t")), t="汉字abc") == 2 + 4
    assert one(spark, T.key_values(F.col("t")), t="a: 1\nb: x:y\nnone\na: 2") == {"a": "2", "b": "x:y"}
    assert one(spark, T.strip_thought(F.col("t")), t="<think>a\nb</think>\n\nanswer") == "answer"
    assert one(spark, T.word_count(F.col("t")), t=" a  b　c ") == 3
    assert one(spark, T.model_type(F.col("t")), t="BGE-Reranker") == "rerank" and one(spark, T.model_type(F.col("t")), t="chatty") == "chat"
    assert one(spark, T.repo_name(F.col("t")), t="models--owner--name") == "owner/name"
    assert [one(spark, T.half_points(F.col("t")), t=v) for v in (4.25, 4.75, 9.0, -1.0)] == [4.0, 5.0, 5.0, 0.0]
    assert one(spark, T.style_level(F.col("t")), t="Heading 9") == 6 and one(spark, T.style_level(F.col("t")), t="Normal") == 0


def test_url_functions(spark):
    assert one(spark, U.normalize_url(F.col("t")), t="http://a.b/c?utm_x=1&y=2&ref=z#f") == "http://a.b/c&y=2"
    assert one(spark, U.links(F.col("t")), t='<a class="x" href="/a&amp;b">1</a><a href="mailto:x">2</a><a href=\'#t\'>3</a>') == ["/a&b"]
    base = "http://h.x/d/p.html?q=1"
    for link, want in (("a", "http://h.x/d/a"), ("/a", "http://h.x/a"), ("//o.x/a", "http://o.x/a"), ("?z", "http://h.x/d/p.html?z"), ("https://k/", "https://k/")):
        assert one(spark, U.resolve(F.col("l"), F.col("b")), l=link, b=base) == want
    assert one(spark, U.follows(F.col("l"), F.col("b")), l="http://h.x/a", b=base) and not one(spark, U.follows(F.col("l"), F.col("b")), l="http://h.x/a.PDF", b=base)
    assert one(spark, U.select_css(F.col("t"), "#m"), t='<p>1</p><div id="m">in</div>') == '<div id="m">in</div>'


@pytest.mark.parametrize(
    ("answer", "source", "want"),
    [
        ("", "generated", "basic_error"), ("abcd efgh ijkl mnop", "generated", "basic_error"), ("abcde fghij klmno pqrst", "generated", "passed"), ("cut off in the middle of...", "generated", "format_error"),
        ("an (open bracket and more text", "generated", "format_error"), ("“open quote and much more text", "generated", "format_error"), ("abcdefgabcdefgabcdefg and so on", "generated", "format_error"),
        ("☃☂☀☁☃☂☀☁☃☂☀☁☃☂☀☁☃☂☀☁", "generated", "format_error"), ("注册资本为5000万元。", "structured_template", "passed"), ("no such shape", "structured_template", "template_error"),
        ("一二三四五六七八九十甲乙丙丁戊己庚辛壬癸。x" * 3, "generated", "format_error"),
    ],
)
def test_verdict(spark, answer, source, want):
    assert one(spark, validation.verdict(F.col("a"), F.col("s")), a=answer, s=source) == want


def test_judgement(spark):
    score, ok = validation.parse_judgement(F.col("t"))
    assert (one(spark, score, t='prose {"score": 4.3} end'), one(spark, ok, t='{"score": 4.3}')) == (4.5, "true")
    assert one(spark, score, t="Score: 2") == 2.0 and one(spark, ok, t="nothing") == "false"


def test_masking():
    text, audit = privacy.Masker(privacy.RULES).mask("13812345678@x.com and a@b.cc, 13812345678, 工号: 12345, 10.0.0.1")
    assert text == "**手机A**@x.com and **邮箱A**, **手机A**, 工号: **内部员工A**, **IP地址A**"
    assert [a["rule"] for a in audit] == ["phone", "phone", "email", "ip_address", "employee_id"]
    assert privacy.placeholder("x", 27) == "**x27**" and [r[0] for r in privacy.active_rules(("phone", "email"), ("email",))] == ["phone"]
    assert privacy.Masker((), ("word",), ("[", r"\d+")).mask("a word 12 and 3")[0] == "a **关键词A** **关键词B** and **关键词C**"


def test_mask_text(spark):
    rows = privacy.mask_text(spark.createDataFrame([(1, "mail a@b.cc"), (2, None), (3, "plain")], "id int, text string")).orderBy("id").collect()
    assert [r.masked.text for r in rows] == ["mail **邮箱A**", None, "plain"] and [len(r.masked.audit) for r in rows] == [1, 0, 0]


def test_token_chunks(spark):
    with pytest.raises(ValueError, match="overlap"):
        chunking.token_chunks(F.col("t"), 10, 10)
    got = one(spark, chunking.token_chunks(F.col("t"), 3, 1), t="a b c d e")
    assert [(c.content, c.word_count) for c in got] == [("a b c", 3), ("c d e", 3), ("e", 1)]


@settings(max_examples=60, deadline=None)
@given(st.text("ab ,.\n", max_size=300), st.integers(5, 60))
def test_recursive_chunks_keep_every_word(text, size):
    parts = chunking.split_recursive(text, size, 0, chunking.LADDERS["recursive"])
    assert "".join("".join(parts).split()) == "".join(text.split()) and all(len(p) <= size for p in parts)


def test_markdown_chunks():
    text = "# A\nintro\n## B\none\n## C\ntwo\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n| x | y |\n|---|---|\n| 3 | 4 |\n```\n# not a heading\n```\nPage 3\n\nend"
    got = chunking.split_markdown(text)
    assert [(n, lvl) for _, n, lvl in got] == [("A", 1), ("A > B", 2), ("A > C", 2), ("A > C", 2)]
    table = next(c for c, _, _ in got if c.startswith("|"))
    assert table.splitlines() == ["| x | y |", "|---|---|", "| 1 | 2 |", "| 3 | 4 |"]
    assert "Page 3" not in "".join(c for c, _, _ in got) and "# not a heading" in "".join(c for c, _, _ in got)


def test_page_lines_with_custom_patterns():
    assert chunking.drop_page_lines("CONFIDENTIAL\n\nkept\nalso kept", ("^CONFIDENTIAL$",)) == "kept\nalso kept"


def test_code_and_custom_chunks(spark):
    assert one(spark, chunking.code_chunks(F.col("t")), t="a\n```\ncode\n```\nb") == ["a\nb"]
    assert one(spark, chunking.custom_chunks(F.col("t"), "|", 4), t="aa|b||cccccc|d") == ["aa|b", "cccccc", "d"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40), st.integers(1, 60))
def test_knapsack_keeps_what_fits(lengths, capacity):
    packs = datasets.knapsack(lengths, capacity)
    assert sorted(i for p in packs for i in p) == [i for i, n in enumerate(lengths) if n <= capacity]
    assert all(sum(lengths[i] for i in p) <= capacity for p in packs)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 300), st.integers(0, 300), st.integers(1, 200))
def test_budget_fits(source, target, cutoff):
    s, t = infer_lengths(source, target, cutoff)
    assert 0 <= s <= source and 0 <= t <= target and s + t <= cutoff


def test_positions(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    got = sorted(r.position for r in shuffled_position(df, "id", digits=1).collect())
    assert got == list(range(1000))
    rows = ordered_position(df, "id", ["g"], width=100, total="n").collect()
    assert all(r.position == r.id // 3 and r.n == (334 if r.g == 0 else 333) for r in rows)


def test_split_and_mix(spark):
    df = spark.range(101).withColumnRenamed("id", "doc_id")
    counts = {r.split: r.n for r in datasets.split_random(df, "doc_id", 8, 1, 1).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts == {"train": 80, "val": 10, "test": 11}
    with pytest.raises(ValueError, match="ratios"):
        datasets.split_random(df, "doc_id", 0, 0, 0)
    assert datasets.resample(df, "doc_id", 250).groupBy("doc_id").count().agg(F.min("count"), F.max("count")).first()[:] == (2, 3)
    assert datasets.resample(df, "doc_id", 7).count() == 7


def test_alignment(spark):
    m = lambda *t: [{"role": r, "content": c} for r, c in t]
    rows = [(1, m(("system", "s"), ("user", "a"), ("assistant", "b"))), (2, m(("user", "a"))), (3, m(("assistant", "a"), ("user", "b"))), (4, [])]
    df = spark.createDataFrame(rows, "id int, ms array<struct<role:string,content:string>>")
    got = {r.id: r.a for r in df.select("id", datasets.align_turns(F.col("ms")).alias("a")).collect()}
    assert got[1].system == "s" and [x.content for x in got[1].prompt] == ["a"] and [x.content for x in got[1].response] == ["b"]
    assert all(not got[i].prompt and not got[i].response for i in (2, 3, 4))
    rows = [("q", "in", "out", [["h", "i"]]), ("q", "", None, None)]
    out = datasets.align_alpaca(spark.createDataFrame(rows, "instruction string, input string, output string, hist array<array<string>>"), history="hist").collect()
    assert [x.content for x in out[0]._prompt] == ["h", "i", "q\nin"] and len(out[1]._response) == 0 and out[1]._prompt[0].content == "q"
    encoded = datasets.encode_supervised(datasets.align_alpaca(spark.createDataFrame([("ab", "", "cd")], "instruction string, input string, output string")), lambda s: [ord(c) for c in s], 10, 0).first()
    assert list(encoded.input_ids) == [97, 98, 99, 100, 0] and list(encoded.labels) == [-100, -100, 99, 100, 0]


def test_questions():
    reply = '<think>hm</think>```json\n{"qa_pairs": [{"question": "q", "answer": "a"}, "only", {"x": 1}]}\n```'
    assert qa.parse_pairs(reply) == [{"question": "q", "answer": "a", "question_type": "fact"}, {"question": "only", "answer": "", "question_type": "fact"}]
    assert qa.parse_pairs("no json") == [] and qa.parse_pairs(None) == []


def test_diverse(spark):
    row = spark.createDataFrame([(0, "1", "2", "yes", "x", "")], "row int, a string, b string, c string, t string, u string")
    features = [("A", "integer", F.col("a")), ("B", "string", F.col("b")), ("C", "boolean", F.col("c"))]
    pairs = qa.candidates(features, [("T", "date", F.col("t")), ("U", "string", F.col("u"))], F.col("row"))
    got = row.select(pairs.alias("p"), qa.diverse(pairs, 2).alias("d")).first()
    assert [p.template_type for p in got.p] == ["forward", "reverse", "reverse", "reverse", "summary"] and [p.template_type for p in got.d] == ["forward", "reverse"]
    assert got.p[0].question == "已知A为1，B为2，C，请问T是什么时候？" and got.p[0].answer == "T是x。" and got.p[2].question == "T是x，对应的B是什么？"


def test_metrics():
    rnd = random.Random(1)
    for _ in range(100):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert metrics.lcs(a, b) == table[-1][-1]
    assert metrics.sentence_bleu("a b c d e".split(), "a b c d e".split()) == pytest.approx(1) and metrics.sentence_bleu([], ["a"]) == 0


def test_tables(spark):
    rows = [(i, v, n) for i, (v, n) in enumerate([("a", "1"), ("b", "2.5"), (" ", None), ("b", "3"), ("a", "x"), ("1", "1,000")])]
    df = spark.createDataFrame(rows, "id int, v string, n string")
    got = {r.column: r for r in tables.profile(df, ["v", "n"], "id").collect()}
    assert got["v"].n_missing == 1 and got["v"].missing_rate == pytest.approx(0.1667) and got["v"].mode == "a" and got["v"].samples == "a|b|b"
    assert got["n"].type == "string"  # four of five are numbers, and more than 80 % are asked for
    fixed = tables.repair_missing(df, [("n", "drop_row", None), ("v", "fill_mode", None)]).orderBy("id").collect()
    assert [r.v for r in fixed] == ["a", "b", "b", "a", "1"]
    assert [r.n for r in tables.repair_missing(df, [("n", "fill_default", "0")]).orderBy("id").collect()][2] == "0"
    with pytest.raises(ValueError, match="policy"):
        tables.repair_missing(df, [("n", "guess", None)])


def test_catalog(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "a", "y")], "id int, k string, p string")
    assert [r.id for r in catalog.where_equal(df, k="a", p=None, unknown=1).collect()] == [1]
    assert {r.id for r in catalog.where_in(df, "k", spark.createDataFrame([("b",), ("b",)], "z string")).collect()} == {2}
    configs = spark.createDataFrame([("1", None, "true"), ("2", "p", "true"), ("3", "p", "false")], "id string, project_id string, is_default string")
    assert catalog.default_for(configs, "p").first().id == "2" and catalog.default_for(configs, "q").first().id == "1"
    old = spark.range(1).select(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")).alias("o"), F.create_map(F.lit("b"), F.lit("3")).alias("n"))
    assert old.select(catalog.merge_json(F.col("o"), F.col("n")).alias("m")).first().m == {"a": "1", "b": "3"}


@pytest.mark.parametrize("weight", [0.6, 0.9999, None])
def test_smoothing_in_chunks(spark, weight):
    rnd = random.Random(4)
    rows = [(g, i * 7919 - 50_000, rnd.random()) for g, n in ((1, 1), (2, 3), (3, 4), (4, 500), (None, 40)) for i in range(n)]
    rows += [(5, i, None if i == 20 else float(i)) for i in range(30)] + [(6, None, 5.0), (6, 1, 2.0), (6, 1, 1.0)]
    want = {}
    for g in (1, 2, 3, 4, 5, 6, None):
        xs = [v for _, v in sorted(((o if o is not None else -1e18, v) for h, o, v in rows if h == g), key=lambda r: (r[0], r[1] or 0))]
        w = weight if weight is not None else 1.8 * (1 / (1 + math.exp(-0.05 * len(xs))) - 0.5)
        last = xs[0]
        for i, x in enumerate(xs):
            last = None if last is None or x is None else last * w + (1 - w) * x
            want[g, i] = (len(xs), last)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, o long, v double")
    got = {(r.g, r.position): (r.n, r.smoothed) for r in metrics.smoothed(df, "g", "o", "v", weight, chunk=3).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and (got[k][1] is None if x is None else got[k][1] == pytest.approx(x, rel=1e-9)) for k, (n, x) in want.items())


def test_mask_entities(spark):
    def client(prompt):
        text = prompt.split("\n\n", 1)[1]
        if "fails" in text:
            raise OSError
        if "odd" in text:
            return "no JSON"
        return 'Here: {"entities": [{"text": "Ann Lee", "type": "name", "start": 0}, {"text": "邮箱", "type": "name", "start": 9}, {"text": "12 Hill Road, Upton", "type": "address", "start": 30}, {"text": "Bo", "type": "x"}, 7]}'

    rows = [(1, "Ann Lee a@b.cc, Ann Lee, 12 Hill Road, Upton"), (2, "fails a@b.cc"), (3, "odd"), (4, None), (5, ""), (6, "Bo 邮箱 a@b.cc")]
    got = {r.id: r.masked for r in privacy.mask_entities(spark.createDataFrame(rows, "id int, text string"), client).collect()}
    assert got[1].text == "**人物A** **邮箱A**, **人物A**, **地址A**"
    assert [(a.rule, a.original, a.confidence) for a in got[1].audit] == [("email", "a@b.cc", 1.0), ("ner:address", "12 Hill Ro...", 0.7), ("ner:name", "Ann Lee", 0.7)]
    assert [got[i].text for i in (2, 3, 4, 5)] == ["fails **邮箱A**", "odd", None, ""]
    assert got[6].text == "**实体A** **人物A** **邮箱A**"


def test_summaries_by_a_client(spark):
    def client(prompt):
        if "fails" in prompt:
            raise OSError
        return "" if "empty" in prompt else "s" * 120 + ". " + "t" * 60

    long = "word " * 60
    rows = [(1, long), (2, "fails. " + long), (3, "empty. " + long), (4, " short "), (5, None), (6, ""), (7, "x" * 149)]
    got = {r.id: r.summary for r in qa.summarised(spark.createDataFrame(rows, "id int, text string"), "text", client).collect()}
    assert got[1] == "s" * 120 + "."
    assert got[2] == ("fails. " + long)[:150] + "..." and got[3].startswith("empty. word")
    assert [got[i] for i in (4, 5, 6, 7)] == ["short", "空内容", "空内容", "x" * 149]


@pytest.mark.parametrize("key", ["id", "hashed", "skewed"])
def test_positions_of_sparse_ids(spark, key):
    """Dense, hashed and crowded ids: places are right, no single partition and few buckets."""
    from millrace.operators import ranking

    df = spark.range(20_000).select("id", F.xxhash64("id").alias("hashed"), F.when(F.col("id") < 19_000, F.col("id")).otherwise(F.col("id") * 10**12).alias("skewed"))
    placed = ordered_position(df, key, out="_p", total="_n")
    rows = placed.collect()
    want = {v: i for i, v in enumerate(sorted(r[key] for r in rows))}
    assert all(r._p == want[r[key]] and r._n == 20_000 for r in rows)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    splitters = ranking.range_splitters(df, key)
    sizes = [r["count"] for r in df.groupBy(ranking.range_of(F.col(key), splitters, "bigint")).count().collect()]
    assert len(sizes) <= ranking.RANGES and max(sizes) <= 4 * 20_000 / ranking.RANGES
    grouped = ordered_position(df.withColumn("g", F.col("id") % 3), key, ["g"], total="n").collect()
    for g in range(3):
        own = sorted(r[key] for r in grouped if r.g == g)
        assert [r.position for r in sorted((r for r in grouped if r.g == g), key=lambda r: r[key])] == list(range(len(own)))
    few = ordered_position(df.where("id in (7, 5, 9)"), key).orderBy("position").collect()
    assert [r.position for r in few] == [0, 1, 2] and ordered_position(df.where("id < 0"), key).count() == 0


def test_address_rule_begun_once_finds_the_same(spark):
    import random
    import re

    pattern = next(r[2] for r in privacy.RULES if r[0] == "email")
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab.@-%_ 9Z") for _ in range(rnd.randint(0, 40))) for _ in range(800)] + ["a@b.coma@b.com", "x@y.co@z.org", "a" * 5000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.f, r.h) for r in df.select("i", privacy.found(F.col("t"), "email").alias("f"), privacy.holds(F.col("t"), "email").alias("h")).collect()}
    assert got == {i: (None, None) if t is None else (re.findall(pattern, t), bool(re.search(pattern, t))) for i, t in enumerate(texts)}


def test_links_resolve_as_the_standard_library_does(spark):
    import itertools
    from urllib.parse import urljoin

    bases = ["http://h.org/a/b/c.html", "http://h.org/a/b/", "http://h.org", "https://h.org/x?q=1/2#f"]
    links = ["../x", "../../x", "../../../x", "./x", "x/./y", "x/../y", "..", ".", "../", "/a/../b", "/../b", "?p=1", "#top", "", "//o.org/z", "https://o.org/a/../b", "mailto:a@b", "x?u=../y", "a..b", ".hidden", "x/y/.."]
    pairs = list(itertools.product(links, bases))
    got = [r.u for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, l string, b string").orderBy("i").select(U.resolve(F.col("l"), F.col("b")).alias("u")).collect()]
    assert {p: g for p, g in zip(pairs, got, strict=True)} == {(link, base): urljoin(base, link) for link, base in pairs}


def test_unpacked_rows_are_cut_off(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "x " * 10)], "i int, t string")
    got = {r.i: r.tokens for r in datasets.pretrain_rows(df, "t", 4, bos="<s>").collect()}
    assert got == {1: ["<s>", "a", "b", "c"], 2: ["<s>", "<eos>"], 3: ["<s>", "<eos>"], 4: ["<s>", "x", "x", "x"]}
    assert datasets.pretrain_rows(df, "t", 9).where("i = 1").first().tokens == ["a", "b", "c", "<eos>"]
    with pytest.raises(ValueError):
        datasets.pretrain_rows(df, "t", 0)


def test_repeats_are_searched_once_a_text(spark):
    """The searches cost far more than the rest: the verdict reads the column that has their answer."""
    from millrace.operators import validation
    from millrace.plans import registry

    plan = registry.QUERIES["validate_repeats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_repeats_apart(") == 1 and plan.count("\\1{2,}") == 1
    apart = "春天来了公园里的花都开了孩子们在草地上跑"
    rows = [(apart + "一" + apart + "二三" + apart,), (apart + "一" + apart,), ("plain text",), (None,), ("",)]
    got = spark.createDataFrame(rows, "t string").select(validation.repeats_apart(F.coalesce("t", F.lit(""))).alias("r")).collect()
    assert [r.r for r in got] == [True, False, False, False, False]
