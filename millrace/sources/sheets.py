"""Spreadsheets and text documents as data sources of Spark: ``spark.read.format("sheet")``, ``.format("paper")``, ``df.write.format("sheet")``.

A sheet is one task; files are opened in place by ranges and their XML is
streamed, so a task holds one row, the strings that the file shares (as bytes)
and, with ``merged`` = fill, the merged ranges. Comparisons of sheet, row and col
with constants are applied while reading; a sheet that they exclude is no task,
and reading ends at the last wanted row. Writing gives one file a task, in sheets
of at most ``MOST_ROWS`` rows, each under a header row; files take their names
only when the whole write commits.

Options: ``merged`` (fill, none; fill), ``sheets`` (names, comma-separated),
``most_opened`` (with more files than this, a task is a file, and no file is
opened to plan; 1,000). Paths are folders, files or globs of the last part, on
any file system that pyarrow opens. Files that start with ~ or . are skipped.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
import zipfile
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree as X
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

MOST_ROWS = 1_048_576
BATCH_CELLS = 8192
_MERGE = re.compile(rb"<(?:\w+:)?mergeCell\b[^>]*?\bref=\"([A-Z]+\d+(?::[A-Z]+\d+)?)\"")
_HIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_SHOWN = re.compile("_x([0-9A-Fa-f]{4})_")
_NS = "http://schemas.openxmlformats.org/"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let it push comparisons down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SheetSource)
    spark.dataSource.register(PaperSource)


def opened(path: str) -> tuple[files.FileSystem, str]:
    path = re.sub("^file:/+", "/", path)
    return files.FileSystem.from_uri(path) if "://" in path else (files.LocalFileSystem(), path)


def listed(path: str, ends: tuple[str, ...]) -> list[str]:
    """Paths of the files under a path, in order."""
    system, place = opened(path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    info = system.get_file_info(place)
    if info.type == files.FileType.File:
        return [path]
    folder, pattern = (place, "*") if info.type == files.FileType.Directory else place.rsplit("/", 1)
    found = [f.path for f in system.get_file_info(files.FileSelector(folder)) if f.type == files.FileType.File and fnmatch.fnmatch(f.base_name, pattern)]
    return [scheme + f for f in sorted(found) if f.lower().endswith(ends) and f.rsplit("/", 1)[-1][0] not in "~._"]


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def place_of(ref: str) -> tuple[int, int]:
    """Row and column, from 0, of a reference such as B7."""
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


def column_name(col: int) -> str:
    out, col = "", col + 1
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def plain_text(e: X.Element) -> str:
    """The text of a string item: its own and that of its runs, without readings of characters."""
    parts = [c.text or "" for c in e if local(c.tag) == "t"] + [t.text or "" for c in e if local(c.tag) == "r" for t in c if local(t.tag) == "t"]
    return _SHOWN.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


class Shared:
    """Shared strings as one run of bytes."""

    def __init__(self, z: zipfile.ZipFile):
        self.data, self.bounds = bytearray(), array("Q", [0])
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                root = None
                for event, e in X.iterparse(f, ("start", "end")):
                    root = e if root is None else root
                    if event == "end" and local(e.tag) == "si":
                        self.data += plain_text(e).encode("utf-8", "surrogatepass")
                        self.bounds.append(len(self.data))
                        root.clear()

    def __getitem__(self, i: int) -> str:
        return self.data[self.bounds[i] : self.bounds[i + 1]].decode("utf-8", "surrogatepass")


def sheets_of(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and member of every sheet, in order."""
    target = {r.get("Id"): r.get("Target").lstrip("/") for r in X.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in X.fromstring(z.read("xl/workbook.xml")).iter():
        if local(s.tag) == "sheet":
            at = target[next(v for k, v in s.attrib.items() if local(k) == "id" and "}" in k)]
            out.append((s.get("name"), at if at.startswith("xl/") else f"xl/{at}"))
    return out


def merges_of(z: zipfile.ZipFile, member: str) -> list[tuple[int, int, int, int]]:
    """First row, first column, last row, last column of merged ranges, by first row; the member is read in pieces."""
    found, rest = [], b""
    with z.open(member) as f:
        while piece := f.read(1 << 20):
            text = rest + piece
            end = 0
            for m in _MERGE.finditer(text):
                a, _, b = m[1].decode().partition(":")
                found.append((*place_of(a), *place_of(b or a)))
                end = m.end()
            rest = text[max(end, len(text) - 256) :]
    return sorted(found)


def streamed(z: zipfile.ZipFile, member: str, shared: Shared) -> Iterator[tuple[int, dict[int, str]]]:
    """Row number and values by column of every row that holds a value."""
    row, parent = -1, None
    with z.open(member) as f:
        for event, e in X.iterparse(f, ("start", "end")):
            name = local(e.tag)
            if event == "start":
                parent = e if name == "sheetData" else parent
                continue
            if name == "row":
                row = int(e.get("r")) - 1 if e.get("r") else row + 1
                values, col = {}, -1
                for c in e:
                    if local(c.tag) != "c":
                        continue
                    col = place_of(c.get("r"))[1] if c.get("r") else col + 1
                    kind, v = c.get("t"), next((x for x in c if local(x.tag) in ("v", "is")), None)
                    if v is None or (local(v.tag) == "v" and v.text is None):
                        continue
                    values[col] = plain_text(v) if local(v.tag) == "is" else shared[int(v.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}[v.text] if kind == "b" else v.text
                if values:
                    yield row, values
                parent.clear()
            elif name == "sheetData":
                return


def filled(rows: Iterator[tuple[int, dict[int, str]]], merges: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, dict[int, str]]]:
    """rows with the first value of each merged range in its empty cells, those of rows without own values too."""
    open_now: list[tuple[int, int, int, str]] = []  # last row, columns, value
    nth, at = 0, 0

    def row_of(r: int, own: dict[int, str]) -> dict[int, str]:
        nonlocal nth
        while nth < len(merges) and merges[nth][0] <= r:
            r0, c0, r1, c1 = merges[nth]
            if r0 == r and c0 in own:
                open_now.append((r1, c0, c1, own[c0]))
            nth += 1
        if open_now:
            own = dict(own)
            for _, c0, c1, value in open_now:
                for c in range(c0, c1 + 1):
                    own.setdefault(c, value)
            open_now[:] = [m for m in open_now if m[0] > r]
        return own

    for row, own in rows:
        while open_now and at < row:
            yield at, row_of(at, {})
            at += 1
        yield row, row_of(row, own)
        at = row + 1
    while open_now:
        yield at, row_of(at, {})
        at += 1


@dataclass
class Wanted:
    """What the pushed comparisons leave of sheets, rows and columns."""

    tests: dict[str, list]

    def take(self, f: D.Filter) -> bool:
        if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in ("sheet", "row", "col"):
            return False
        name = f.attribute[0]
        if isinstance(f, (D.EqualTo, D.EqualNullSafe)) and f.value is not None:
            self.tests.setdefault(name, []).append(("in", (f.value,)))
        elif isinstance(f, D.In):
            self.tests.setdefault(name, []).append(("in", tuple(f.value)))
        elif isinstance(f, D.IsNotNull):
            pass
        elif name != "sheet" and isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual)):
            low = isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual))
            open_end = isinstance(f, (D.GreaterThan, D.LessThan))
            self.tests.setdefault(name, []).append(("from", f.value + open_end) if low else ("to", f.value - open_end))
        else:
            return False
        return True

    def has(self, name: str, value: object) -> bool:
        return all(value in x if kind == "in" else value >= x if kind == "from" else value <= x for kind, x in self.tests.get(name, ()))

    def last_row(self) -> int:
        return min((max(x) if kind == "in" else x for kind, x in self.tests.get("row", ()) if kind != "from"), default=MOST_ROWS)


class SheetReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.fill = options.get("path"), options.get("merged", "fill") == "fill"
        self.names = [n.strip() for n in options["sheets"].split(",")] if options.get("sheets") else None
        self.most_opened = int(options.get("most_opened", 1000))
        self.wanted = Wanted({})

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def _asked(self, name: str) -> bool:
        return (self.names is None or name in self.names) and self.wanted.has("sheet", name)

    def partitions(self) -> Sequence[D.InputPartition]:
        paths = listed(self.path, (".xlsx", ".xlsm"))
        if len(paths) > self.most_opened:
            return [D.InputPartition((p, None)) for p in paths]
        out = []
        for p in paths:
            system, place = opened(p)
            with system.open_input_file(place) as f, zipfile.ZipFile(f) as z:
                out += [D.InputPartition((p, i)) for i, (name, _) in enumerate(sheets_of(z)) if self._asked(name)]
        return out or [D.InputPartition((None, None))]

    def read(self, partition: D.InputPartition) -> Iterator[pa.RecordBatch]:
        path, nth = partition.value
        if path is None:
            return
        system, place = opened(path)
        with system.open_input_file(place) as f, zipfile.ZipFile(f) as z:
            shared = Shared(z)
            for i, (name, member) in enumerate(sheets_of(z)):
                if (nth is None or i == nth) and self._asked(name):
                    yield from self._batches(path, name, self._rows(z, member, shared))

    def _rows(self, z: zipfile.ZipFile, member: str, shared: Shared) -> Iterator[tuple[int, dict[int, str]]]:
        merges, last = merges_of(z, member) if self.fill else [], self.wanted.last_row()
        for row, values in filled(streamed(z, member, shared), merges):
            if row > last:
                return
            if self.wanted.has("row", row):
                yield row, {c: v for c, v in values.items() if self.wanted.has("col", c)}

    def _batches(self, path: str, sheet: str, rows: Iterator[tuple[int, dict[int, str]]]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, str]] = []
        for row, values in rows:
            held += [(row, c, values[c]) for c in sorted(values)]
            if len(held) >= BATCH_CELLS:
                yield self._batch(path, sheet, held)
                held = []
        if held:
            yield self._batch(path, sheet, held)

    @staticmethod
    def _batch(path: str, sheet: str, cells: list[tuple[int, int, str]]) -> pa.RecordBatch:
        r, c, v = zip(*cells, strict=True)
        n = len(cells)
        return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([sheet] * n), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(v, pa.string())], ["path", "sheet", "row", "col", "value"])


@dataclass
class Written(D.WriterCommitMessage):
    """A file that a task wrote under a name of its own, and the name that it gets."""

    place: str
    final: str


class SheetWriter(D.DataSourceArrowWriter):
    """One workbook a task, its cells as numbers, truth values and inline strings."""

    def __init__(self, path: str, columns: list[str], overwrite: bool, rows: int):
        self.path, self.columns, self.overwrite, self.rows = path, columns, overwrite, rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, folder = opened(self.path)
        system.create_dir(folder)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.xlsx"
        hidden = f"{folder}/.{name}"
        try:
            with system.open_output_stream(hidden) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                self._sheets(z, (r for b in iterator for r in zip(*(c.to_pylist() for c in b.columns), strict=True)))
        except BaseException:  # what a lost executor leaves behind has a hidden name, which readers skip
            system.delete_file(hidden)
            raise
        return Written(hidden, f"{folder}/{name}")

    def _sheets(self, z: zipfile.ZipFile, rows: Iterator[tuple]) -> None:
        count, row = 0, next(rows, None)
        while row is not None or not count:
            count += 1
            row = self._sheet(z, count, row, rows)
        self._book(z, count)

    def _sheet(self, z: zipfile.ZipFile, nth: int, row: tuple | None, rows: Iterator[tuple]) -> tuple | None:
        """Write one sheet from ``row`` on; the first row that it has no room for."""
        with z.open(f"xl/worksheets/sheet{nth}.xml", "w") as f:
            f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS}spreadsheetml/2006/main"><sheetData>'.encode())
            f.write(self._row(1, self.columns))
            at = 1
            while row is not None and at < self.rows:
                at += 1
                f.write(self._row(at, row))
                row = next(rows, None)
            f.write(b"</sheetData></worksheet>")
        return row

    @staticmethod
    def _row(at: int, values: Sequence) -> bytes:
        cells = []
        for i, v in enumerate(values):
            ref = f"{column_name(i)}{at}"
            if v is None:
                continue
            if isinstance(v, bool):
                cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
                cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
            else:
                text = _HIDDEN.sub(lambda m: f"_x{ord(m[0]):04X}_", str(v)).replace("\r", "_x000D_")
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
        return f'<row r="{at}">{"".join(cells)}</row>'.encode("utf-8", "replace")

    @staticmethod
    def _book(z: zipfile.ZipFile, count: int) -> None:
        each = range(1, count + 1)
        head = '<?xml version="1.0" encoding="UTF-8"?>'
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_NS}spreadsheetml/2006/main" xmlns:r="{_NS}officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="Sheet{i}" sheetId="{i}" r:id="rId{i}"/>' for i in each) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_NS}package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_NS}officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in each) + "</Relationships>")
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_NS}package/2006/relationships"><Relationship Id="rId1" Type="{_NS}officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_NS}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in each) + "</Types>")

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        if self.overwrite:
            for old in listed(self.path, (".xlsx",)):
                system.delete_file(opened(old)[1])
        for m in messages:
            if m is not None:
                system.move(m.place, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m is not None and system.get_file_info(m.place).type == files.FileType.File:
                system.delete_file(m.place)


class SheetSource(D.DataSource):
    """path, sheet, row, col (from 0), value of every filled cell."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return "path string, sheet string, row int, col int, value string"

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options)

    def writer(self, schema, overwrite: bool) -> SheetWriter:
        return SheetWriter(self.options["path"], schema.names, overwrite, int(self.options.get("rows", MOST_ROWS)))


class PaperReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path")

    def partitions(self) -> Sequence[D.InputPartition]:
        return [D.InputPartition(p) for p in listed(self.path, (".docx",))] or [D.InputPartition(None)]

    def read(self, partition: D.InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        system, place = opened(partition.value)
        text = lambda e: "".join(t.text or "" for t in e.iter() if local(t.tag) == "t")
        with system.open_input_file(place) as f, zipfile.ZipFile(f) as z, z.open("word/document.xml") as doc:
            depth, body, nth = 0, None, 0
            for event, e in X.iterparse(doc, ("start", "end")):
                depth += 1 if event == "start" else -1
                body = e if event == "start" and depth == 2 else body
                if event == "start" or depth != 2:  # a block has ended under the body
                    continue
                name = local(e.tag)
                if name == "p":
                    style = next((s for s in e.iter() if local(s.tag) == "pStyle"), None)
                    yield partition.value, nth, next((v for k, v in style.attrib.items() if local(k) == "val"), "") if style is not None else "", text(e), []
                elif name == "tbl":
                    yield partition.value, nth, "", "", [[text(c) for c in row if local(c.tag) == "tc"] for row in e if local(row.tag) == "tr"]
                nth += 1
                body.clear()


class PaperSource(D.DataSource):
    """path, position, style, text and table cells of every block of a text document."""

    @classmethod
    def name(cls) -> str:
        return "paper"

    def schema(self) -> str:
        return "path string, position int, style string, text string, cells array<array<string>>"

    def reader(self, schema) -> PaperReader:
        return PaperReader(self.options)
