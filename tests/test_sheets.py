import sys
import zipfile
from pathlib import Path

import pytest

from millrace.sources import sheets
from millrace.sources.sheets import column_name, filled, place_of

S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
SCHEMA = "id long, text string, price double, good boolean"


def book(path, **members):
    """A workbook of sheets given by name as XML of rows and what follows them."""
    with zipfile.ZipFile(path, "w") as z:
        names = list(members)
        z.writestr("xl/workbook.xml", f"<workbook {S}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="rId{i}" Target="/xl/worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {S}>{members[n]}</worksheet>")


def test_places():
    for col, name in ((0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA"), (16383, "XFD")):
        assert column_name(col) == name and place_of(f"{name}7") == (6, col)


def test_merged_ranges_fill_rows_that_hold_nothing():
    rows = [(0, {0: "a", 3: "z"}), (4, {1: "own"}), (6, {0: "last"})]
    merges = [(0, 0, 5, 1), (2, 3, 3, 3), (6, 0, 6, 2)]
    assert list(filled(iter(rows), merges)) == [
        (0, {0: "a", 1: "a", 3: "z"}), (1, {0: "a", 1: "a"}), (2, {0: "a", 1: "a"}), (3, {0: "a", 1: "a"}), (4, {0: "a", 1: "own"}), (5, {0: "a", 1: "a"}), (6, {0: "last", 1: "last", 2: "last"}),
    ]


def test_written_sheets_come_back(spark, tmp_path):
    sheets.register(spark)
    texts = ["plain", " blanks ", "a<b>&\"c\"", "two\nlines\ttab", "\x01\x1f_x0041_", "", None, "汉字 é 😀", "=1+1", "\r\n", "x" * 40_000]
    rows = [(i, t, i / 3 if i % 4 else None, bool(i % 2)) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    df.write.format("sheet").mode("append").option("rows", 8).save(str(tmp_path / "out"))
    cells = spark.read.format("sheet").load(str(tmp_path / "out"))
    got = {}
    for r in cells.where("row > 0").collect():
        got.setdefault((r.path, r.sheet, r.row), {})[r.col] = r.value
    back = sorted((int(v[0]), v.get(1), float(v[2]) if 2 in v else None, v[3] == "TRUE") for v in got.values())
    assert back == rows
    heads = cells.where("row = 0").select("col", "value").distinct().orderBy("col").collect()
    assert [h.value for h in heads] == ["id", "text", "price", "good"]
    assert len({(r.path, r.sheet) for r in cells.collect()}) >= 5  # sheets of seven rows
    df.limit(1).write.format("sheet").mode("overwrite").save(str(tmp_path / "out"))
    assert spark.read.format("sheet").load(str(tmp_path / "out")).where("row > 0").count() == 3
    df.where("id < 0").coalesce(1).write.format("sheet").mode("append").save(str(tmp_path / "none"))
    assert {r.value for r in spark.read.format("sheet").load(str(tmp_path / "none")).collect()} == {"id", "text", "price", "good"}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    sheets.register(spark)
    bad = spark.range(10, numPartitions=2).select(F.when(F.col("id") == 9, F.raise_error(F.lit("stop"))).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("sheet").mode("append").save(str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")]  # readers skip hidden names


def test_comparisons_reach_the_reader(spark, tmp_path):
    sheets.register(spark)
    sheet = "<sheetData>" + "".join(f'<row r="{r}">' + "".join(f'<c r="{column_name(c)}{r}"><v>{r * 10 + c}</v></c>' for c in range(4)) + "</row>" for r in range(1, 7)) + "</sheetData>"
    book(tmp_path / "a.xlsx", one=sheet, two=sheet, three="not XML, never opened<")
    book(tmp_path / "~lock.xlsx", x="")
    (tmp_path / "notes.txt").write_text("x")
    df = spark.read.format("sheet").load(str(tmp_path)).where("sheet in ('one', 'two') and row between 1 and 3 and col in (0, 3) and value <> '23'")
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert sorted((r.sheet, r.row, r.col, r.value) for r in df.collect()) == sorted((s, r, c, str((r + 1) * 10 + c)) for s in ("one", "two") for r in (1, 2, 3) for c in (0, 3) if (r, c) != (1, 3))
    assert "value" in plan and df.rdd.getNumPartitions() == 2
    named = spark.read.format("sheet").option("sheets", "two").load(str(tmp_path / "a.xlsx"))
    assert {r.sheet for r in named.collect()} == {"two"} and named.where("col >= 2").count() == 12
    by_file = spark.read.format("sheet").option("most_opened", 0).load(str(tmp_path / "*.xlsx")).where("sheet = 'one'")
    assert by_file.count() == 24 and spark.read.format("sheet").load(str(tmp_path)).where("sheet = 'none'").count() == 0


_MILLION = """
import resource, sys, zipfile
from millrace.sources import sheets
writer = sheets.SheetWriter(sys.argv[1], ["id", "text"], False, sheets.MOST_ROWS)
with zipfile.ZipFile(sys.argv[1] + "/big.xlsx", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
    writer._sheets(z, ((i, f"row {i}") for i in range(1_000_000)))
reader = sheets.SheetReader({"path": sys.argv[1] + "/big.xlsx"})
(part,) = reader.partitions()
print(sum(b.num_rows for b in reader.read(part)), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_a_million_rows_in_bounded_memory(tmp_path):
    """Peak memory of a process that writes and reads one sheet, imports included."""
    import subprocess

    out = subprocess.run([sys.executable, "-c", _MILLION, str(tmp_path)], capture_output=True, text=True, timeout=240, cwd=Path(__file__).parents[1])
    cells, peak_mb = map(int, out.stdout.split())
    assert cells == 2_000_002 and peak_mb < 300
