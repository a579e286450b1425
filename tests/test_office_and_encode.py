import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions.markup import markdown_of
from millrace.operators import datasets, encode, layout
from millrace.sources import office

S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_spreadsheet_grid(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S}><sheets><sheet name="one" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {S}><si><t>head</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>2.5</v></c><c r="AB2" t="inlineStr"><is><t>x</t></is></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>')
    rows = office.read_grids(spark, str(tmp_path)).orderBy("row", "col").collect()
    assert [(r.sheet, r.row, r.col, r.value) for r in rows] == [("one", 0, 0, "head"), ("one", 0, 1, "head"), ("one", 1, 0, "rich"), ("one", 1, 1, "2.5"), ("one", 1, 27, "x")]
    assert office.read_grids(spark, str(tmp_path), fill_merged=False).count() == 4


def test_document_markdown(spark, tmp_path):
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{p('Title', 'Heading2')}{p('第一章 总则')}{p('plain')}<w:tbl><w:tr>{cell('a')}{cell('b|c')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl></w:body></w:document>")
    assert office.read_documents(spark, str(tmp_path)).first().markdown == "## Title\n\n# 第一章 总则\n\nplain\n\n| a | b\\|c |\n| --- | --- |\n| 1 | 2 |"


def test_page_lines(spark):
    rows = [(1, 100.0, t, x, c) for t, x, c in ((1.0, 0, "H"), (10.0, 2, "b"), (11.0, 1, "a"), (12.9, 3, "c"), (14.0, 1, "d"), (99.0, 0, "F"))]
    df = spark.createDataFrame(rows, "doc int, height double, top double, x int, char string")
    assert layout.page_lines(df, ["doc"]).first().lines == "abc\nd"
    pages = spark.createDataFrame([(1, "x"), (1, None), (2, "long enough text")], "doc int, text string")
    assert {r.doc: r.scanned for r in layout.is_scanned(pages, "doc", "text").collect()} == {1: True, 2: False}
    sims = spark.createDataFrame([("a", 0, 0.9), ("a", 1, 0.85), ("a", 2, 0.4), ("b", 0, 0.5)], "g string, i int, s double")
    assert {r.g: r["at"] for r in layout.first_jump(sims, "g", "i", "s").collect()} == {"a": 2, "b": None}
    gpu = spark.range(1).select(layout.gpu_usage(F.lit("0, card, 95, 100")).alias("g")).first().g
    assert (gpu["index"], gpu.used_percent, gpu.busy) == (0, 95.0, True)
    assert spark.range(1).select(layout.header_row(F.array(F.lit("2024年"), F.lit("x"))).alias("h")).first().h


def test_encodings(spark):
    ids = lambda s: [ord(c) for c in s]
    pair = datasets.align_alpaca(spark.createDataFrame([("ab", "", "cd", "e")], "instruction string, input string, good string, bad string"), chosen="good", rejected="bad")
    got = encode.encode_pairwise(pair, ids, 20, 0).first()
    assert list(got.chosen_input_ids) == [97, 98, 99, 100, 0] and list(got.rejected_labels) == [-100, -100, 101, 0]
    kto = datasets.align_alpaca(spark.createDataFrame([("ab", "", "cd", False, "zz")], "instruction string, input string, output string, tag boolean, kl_text string"), kto="tag")
    got = encode.encode_feedback(kto, ids, 20, 0).first()
    assert not got.kto_tag and list(got.input_ids) == [97, 98, 99, 100, 0] and list(got.kl_input_ids) == [97, 98, 122, 122, 0]
    got = encode.encode_prompts(datasets.align_alpaca(spark.createDataFrame([("ab", "", "cd")], "instruction string, input string, output string")), ids, 3, 0).first()
    assert len(got.input_ids) + len(got.labels) == 3


def test_packing_padding_and_tools(spark):
    df = spark.range(1)
    one = lambda c: df.select(c.alias("x")).first().x
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(encode.packed_lengths(arr(1, 1, 2, 2, 2, 0))) == [0, 2, 5] and one(encode.packed_lengths(arr(0, 0))) == [0]
    assert one(encode.padded(arr(1, 2), F.lit(4), 9)) == [1, 2, 9, 9] and one(encode.padded(arr(1, 2), F.lit(3), 9, left=True)) == [9, 1, 2]
    assert one(encode.choice_prompt(F.lit("Q"), [F.lit("x"), F.lit("y")], F.lit("B"))) == "Q\nA. x\nB. y\nAnswer: B"
    text = 'hi <tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call>\nAction: g\nAction Input: {"b": 2}\n'
    assert [(c.name, c.arguments) for c in one(encode.tool_calls(F.lit(text)))] == [("f", '{"a":1}'), ("g", '{"b": 2}')]
    calls = lambda t, d: [(c.name, c.arguments) for c in one(encode.tool_calls(F.lit(t), d))]
    assert calls('{"name": "f", "parameters": {"a": 1}}', "object") == [("f", '{"a":1}')] and calls('[{"name": "f", "arguments": {}}, {"name": "g", "arguments": {"x": 2}}]', "object") == [("f", "{}"), ("g", '{"x":2}')]
    assert calls("weather\n{\"c\": 1}", "named") == [("weather", '{"c": 1}')] and calls("just text", "object") == calls("just text", "named") == calls("just text", "any") == []
    rows = spark.createDataFrame([([("user", "q", None), ("assistant", None, '[{"name":"f"}]'), ("tool", "1", None), ("tool", "2", None), ("assistant", "a", "")],)], "ms array<struct<role:string,content:string,tool_calls:string>>")
    got = rows.select(encode.align_tool_messages(F.col("ms")).alias("m")).first().m
    assert [(m.role, m.content) for m in got] == [("user", "q"), ("function", '[{"name":"f"}]'), ("observation", "1\n2"), ("assistant", "a")]


@pytest.mark.parametrize(("html", "want"), [("<h2>T &amp; U</h2><p>a <b>b</b> <a href='/x'>l</a></p><script>no</script>", "## T & U\n\na **b** [l](/x)"), ("<ul><li>1<li>2</ul>", "- 1\n- 2"), (None, "")])
def test_markdown(html, want):
    assert markdown_of(html) == want
