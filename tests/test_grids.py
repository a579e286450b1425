import pytest

from millrace.operators import layout
from millrace.streaming.training_log import buffered_shuffle


def grid(spark, **sheets):
    rows = [(s, r, c, v) for s, lines in sheets.items() for r, line in enumerate(lines) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "sheet string, row int, col int, value string")


def test_records(spark):
    sheets = {
        "one": [["name", "n", " "], ["a", "1", None], [None, "2", "x"], ["c", None, None]],
        "two": [["who", "2024年", None], [None, "in", "out"], ["a", "5%", "7"]],
        "same": [["k", "v", "v"], ["a", "1", "2"]],
        "single": [["k", "v"]],
        "blank": [[None, None], [None, None]],
    }
    got = {(r.sheet, r.row): r.content for r in layout.grid_records(grid(spark, **sheets)).collect()}
    assert got == {
        ("one", 2): "name: a\nn: 1", ("one", 3): "name: a\nn: 2\n列3: x", ("one", 4): "name: c",
        ("two", 3): "who: a\n2024年 in: 5%\n2024年 out: 7", ("same", 2): "k: a\nv: 2",
    }
    fixed = {(r.sheet, r.row): r.content for r in layout.grid_records(grid(spark, **sheets), [1], fill=False).collect()}
    assert fixed["one", 3] == "n: 2\n列3: x" and fixed["one", 2] == "n: 1\nname: a"
    assert layout.grid_records(grid(spark).limit(0)).count() == 0


def test_bounds(spark):
    up, side = [1.0, 0.0], [0.0, 1.0]
    lines = [[up, side, up], [side, up, up], [side, up, up], [side, up, up]]
    rows = [("a", r + 1, c, "x", v) for r, line in enumerate(lines) for c, v in enumerate(line)] + [("a", 0, c, None, up) for c in range(3)] + [("b", 0, 0, "x", up)]
    found = layout.table_bounds(spark.createDataFrame(rows, "sheet string, row int, col int, value string, vec array<double>"))
    # rows 1 and 2 agree in one of three cells, the next ones in all; columns agree in half, half and all of their pairs
    assert {(r.sheet, r.data_row, r.data_col) for r in found.collect()} == {("a", 2, 2), ("b", 0, 0)}


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_buffered_shuffle(spark, size):
    rows = spark.range(0, 500, 1, 1)
    got = [r.id for r in buffered_shuffle(rows, size).collect()]
    assert sorted(got) == list(range(500)) and got == [r.id for r in buffered_shuffle(rows, size).collect()]
    assert (got == list(range(500))) == (size == 1)
    assert all(v - k <= size for k, v in enumerate(got))  # no row goes out before it has come
    assert buffered_shuffle(rows.limit(0), size).count() == 0
