"""Splitters: text to an array of chunk structs, and to rows.

Window, literal and row splitters are native expressions; those that recurse
over separators or keep a heading stack run as Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip_ws, word_count, words
from millrace.operators.batches import pieces

CHUNK = "array<struct<index:int,content:string,name:string,level:int>>"
_CHUNK_TYPE = pa.struct([("index", pa.int32()), ("content", pa.string()), ("name", pa.string()), ("level", pa.int32())])


def token_chunks(text: Column, size: int = 200, overlap: int = 20) -> Column:
    """Windows of white-space tokens; the stride is size - overlap and the window at each stride's start is kept."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie between 0 and size")
    tokens = words(F.coalesce(text, F.lit("")))
    # let-binding by a one-element transform, so that the text is split once
    cut = lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(size - overlap)), lambda s, i: F.struct(i.cast("int").alias("index"), F.array_join(F.slice(w, s + 1, size), " ").alias("content"), F.least(F.lit(size), F.size(w) - s).cast("int").alias("word_count"))))
    return F.element_at(F.transform(F.array(tokens), cut), 1)


def _packed(parts: Column, size: int, glue: str) -> Column:
    """Greedy packing of parts up to size characters, joined by glue."""
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, part: Column) -> Column:
        joined = F.concat(acc.open, F.lit(glue), part)
        full = acc.open.isNotNull() & (F.length(joined) > size)
        return F.struct(F.when(acc.open.isNull() | full, part).otherwise(joined).alias("open"), F.when(full, F.array_append(acc.done, acc.open)).otherwise(acc.done).alias("done"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc.open.isNull(), acc.done).otherwise(F.array_append(acc.done, acc.open)))


def custom_chunks(text: Column, separator: str, size: int = 500) -> Column:
    """Parts between a literal separator, packed greedily with it put back."""
    parts = F.filter(F.split(text, re.escape(separator)), lambda p: strip_ws(p) != "")
    return _packed(parts, size, separator)


def code_chunks(text: Column, size: int = 1000) -> Column:
    """Prose around fenced blocks, packed greedily; the fenced code itself is left out."""
    outside = F.filter(F.transform(F.split(text, "```"), lambda p, i: F.when(i % 2 == 0, strip_ws(p)).otherwise("")), lambda p: p != "")
    return _packed(outside, size, "\n")


def row_chunks(columns: list[str]) -> Column:
    """A table row as ``column: value`` lines; empty cells are left out."""
    cells = F.array(*[F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns])
    return F.array_join(F.filter(cells, lambda x: x.isNotNull()), "\n")


# Recursive splitters ------------------------------------------------------------------

LADDERS = {
    "recursive": ("\n\n", "\n", ". ", " ", ",", ""),
    "semantic": ("。", "！", "？", "；", ". ", "! ", "? ", "\n", "，", ",", " ", ""),
    "sentence": ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", " ", ""),
}


def cjk_weight(text: str) -> int:
    cjk = 0 if text.isascii() else sum("一" <= c <= "鿿" for c in text)
    return cjk + int(1.5 * (len(text) - cjk))


def split_recursive(text: str, size: int, overlap: int, ladder: tuple[str, ...], measure: Callable[[str], int] = len) -> list[str]:
    """Split at the first separator that occurs, merge neighbours up to size with an overlap, and go down the ladder for parts that are too long."""
    used = next((s for s in ladder if s == "" or s in text), "")
    rest = ladder[ladder.index(used) + 1 :]
    pieces = list(text) if used == "" else [p + (used if i < text.count(used) else "") for i, p in enumerate(text.split(used))]
    out: list[str] = []
    held: list[str] = []
    total = 0

    def close() -> None:
        if held and (joined := "".join(held).strip()):
            out.append(joined)

    for piece in pieces:
        n = measure(piece)
        if n > size and used != "":
            close()
            held, total = [], 0
            out += split_recursive(piece, size, overlap, rest or ("",), measure)
            continue
        if held and total + n > size:
            close()
            while held and (total > overlap or total + n > size):
                total -= measure(held.pop(0))
        held.append(piece)
        total += n
    close()
    return out


def split_paragraphs(text: str, size: int, overlap: int) -> list[str]:
    """Blank-line paragraphs packed up to size; a longer one is split recursively."""
    out: list[str] = []
    held = ""
    for part in re.split(r"\n\s*\n", text):
        part = part.strip()
        if not part:
            continue
        if len(part) > size:
            if held:
                out.append(held)
                held = ""
            out += split_recursive(part, size, min(overlap, size // 2), LADDERS["semantic"])
        elif held and len(held) + 2 + len(part) > size:
            out.append(held)
            held = part
        else:
            held = f"{held}\n\n{part}" if held else part
    return [*out, held] if held else out


# Markdown structure -------------------------------------------------------------------

_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*$")
#: Shapes of lines that only number, date or mark pages.
PAGE_LINES = (r"^\s*[-—]*\s*(?:page|Page|PAGE)\s*\d+(?:\s*(?:of|/)\s*\d+)?\s*[-—]*\s*$", r"^\s*第\s*\d+\s*页(?:\s*共\s*\d+\s*页)?\s*$", r"^\s*[-—]{2,}\s*Page \d+\s*[-—]{2,}\s*$")


def drop_page_lines(text: str, custom: tuple[str, ...] = ()) -> str:
    """Without page header and footer lines and the blank lines right after each."""
    shapes = [re.compile(p) for p in (*PAGE_LINES, *custom)]
    out, skip = [], False
    for line in text.split("\n"):
        if any(p.search(line) for p in shapes):
            skip = True
        elif skip and not line.strip():
            continue
        else:
            skip = False
            out.append(line)
    return "\n".join(out)


def merge_tables(lines: list[str]) -> list[str]:
    """Tables of equal width with only blank lines between become one: the later header and rule go."""
    out: list[str] = []
    width = None
    gap: list[str] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if line.lstrip().startswith("|"):
            columns = line.strip().strip("|").count("|") + 1
            rule = i + 1 < len(lines) and re.fullmatch(r"\s*\|?[\s:|-]*-[\s:|-]*\|?\s*", lines[i + 1]) is not None
            if rule and width == columns and out and out[-1].lstrip().startswith("|"):
                gap = []
                i += 2
                continue
            if rule:
                width = columns
            out += [*gap, line]
            gap = []
        elif not line.strip() and width is not None:
            gap.append(line)
        else:
            out += [*gap, line]
            gap, width = [], None
        i += 1
    return out + gap


#: Titles of a table of contents, and what ends one.
CONTENTS = re.compile(r"^(?:#{1,6}\s*)?(?:目[\s\u3000]*录|table of contents|toc)\s*$", re.MULTILINE | re.IGNORECASE)
CONTENTS_END = re.compile(r"^(?:#{1,6}\s+.+|第[一二三四五六七八九十]+[章编部分])", re.MULTILINE)


def cut_contents(text: str, least: int = 50) -> tuple[str, str]:
    """A table of contents, headings in it without their marks, and the text without it; a shorter one stays."""
    title = CONTENTS.search(text)
    if not title:
        return "", text
    level = len(title[0]) - len(title[0].lstrip("#"))
    end = len(text)
    for m in CONTENTS_END.finditer(text, title.end()):
        deeper = m[0].startswith("#") and len(m[0]) - len(m[0].lstrip("#")) > level
        if not (level and deeper):
            end = m.start()
            break
    body = re.sub(r"(?m)^[ \t]*#{1,6}[ \t]+", "", text[title.end() : end])
    contents = (title[0] + body).strip()
    return (contents, text[: title.start()] + text[end:]) if len(contents) >= least else ("", text)


def split_markdown(text: str) -> list[tuple[str, str, int]]:
    """(content, name, level): headings are the only cut points besides tables, which stand alone; consecutive leaf siblings merge."""
    sections: list[tuple[list[str], int, list[str]]] = []  # path, level, lines
    path: list[tuple[int, str]] = []
    lines: list[str] = []
    level, fenced = 0, False

    def close() -> None:
        if any(x.strip() for x in lines):
            sections.append(([t for _, t in path], level, list(lines)))
        lines.clear()

    contents, text = cut_contents(drop_page_lines(text))
    for line in merge_tables(text.split("\n")):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        heading = None if fenced else _HEADING.match(line)
        if heading:
            close()
            level = len(heading[1])
            path = [*[(n, t) for n, t in path if n < level], (level, heading[2])]
        lines.append(line)
    close()
    out: list[tuple[str, str, int]] = [(contents, "目录", 1)] if contents else []
    parents: list[tuple[str, ...]] = [("", "")] if contents else []
    for names, level, body in sections:
        table = [x for x in body if x.lstrip().startswith("|")]
        rest = "\n".join(x for x in body if not x.lstrip().startswith("|")).strip()
        name = " > ".join(names)
        leaf = not any(other[: len(names)] == names and len(other) > len(names) for other, _, _ in sections)
        if rest and out and leaf and len(names) > 1 and not table and parents[-1] == tuple(names[:-1]) and out[-1][2] == level:
            content, before, _ = out[-1]
            out[-1] = (f"{content}\n\n{rest}", f"{before} / {names[-1]}", level)
        elif rest:
            out.append((rest, name, level))
            parents.append(tuple(names[:-1]) if leaf and not table else ("", ""))
        if table:
            out.append(("\n".join(table), name, level))
            parents.append(("", ""))
    return out


# Semantic boundaries ------------------------------------------------------------------

#: The marks that end a sentence; those of wide scripts need no blank after them.
SENTENCE_ENDS, WIDE_ENDS = "。！？；.!?", "。！？；"
_SENTENCE_CUT = re.compile(rf"(?<=[{SENTENCE_ENDS}])\s+|(?<=[{WIDE_ENDS}])")


def sentences(text: str, short: int = 8, least: int = 4) -> list[str]:
    """Sentences; one shorter than ``short`` joins the one before, fragments under ``least`` go."""
    parts = [p for p in _SENTENCE_CUT.split(text.strip()) if p and p.strip()]
    out: list[str] = []
    for p in parts:
        if out and len(p.strip()) < short:
            out[-1] += p
        else:
            out.append(p.strip())
    return [p for p in out if len(p) >= least]


def hashed_embedding(text: str, width: int = 64) -> list[float]:
    """A deterministic stand-in for an embedding service: hashed character trigrams."""
    import zlib

    v = [0.0] * width
    for i in range(max(1, len(text) - 2)):
        v[zlib.crc32(text[i : i + 3].encode()) % width] += 1.0
    return v


def split_by_similarity(text: str, embed: Callable[[str], list[float]] = hashed_embedding, threshold: float = 0.3, least: int = 100, window: int = 3) -> list[str]:
    """Cut at local minima of smoothed similarity between neighbours, not within ``least`` characters of the last cut; short runs merge."""
    import numpy as np

    parts = sentences(text)
    if len(parts) < 3:
        return [text.strip()] if text.strip() else []
    v = np.array([embed(p) for p in parts], float)
    n = np.linalg.norm(v, axis=1) + 1e-8
    sim = (v[:-1] * v[1:]).sum(axis=1) / (n[:-1] * n[1:])
    smooth = np.array([sim[max(0, i - window) : i + window + 1].mean() for i in range(len(sim))])
    bound = max(threshold, float(np.clip(smooth.mean() - 0.5 * smooth.std(), 0, 0.95)))
    groups, since = [[parts[0]]], len(parts[0])
    for i in range(len(sim)):
        low = smooth[i] < bound and (i == 0 or smooth[i] <= smooth[i - 1]) and (i + 1 == len(sim) or smooth[i] <= smooth[i + 1])
        if low and since >= least:
            groups.append([])
            since = 0
        groups[-1].append(parts[i + 1])
        since += len(parts[i + 1])
    out: list[str] = []
    for g in ("".join(x) for x in groups):
        if out and (len(out[-1]) < least or len(g) < least):
            out[-1] += g
        else:
            out.append(g)
    return out


SPLITTERS: dict[str, Callable[..., list]] = {
    "recursive": lambda t, size=500, overlap=50: split_recursive(t, size, overlap, LADDERS["recursive"]),
    "semantic": lambda t, size=500, overlap=50: split_recursive(t, size, overlap, LADDERS["semantic"], cjk_weight),
    "sentence": lambda t, size=200, overlap=0: split_recursive(t, size, overlap, LADDERS["sentence"]),
    "paragraph": lambda t, size=2000, overlap=200: split_paragraphs(t, size, overlap),
    "markdown": lambda t, size=0, overlap=0: split_markdown(t),
    "similarity": lambda t, size=0, overlap=0: split_by_similarity(t),
}


def chunk_rows(df: DataFrame, method: str, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """id, index, content, name, level, word_count of every chunk; an unknown method is the recursive one."""
    if method == "token":
        rows = df.select(id_col, F.explode(token_chunks(F.col(text_col), **options)).alias("c"))
        return rows.select(id_col, "c.index", "c.content", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"), "c.word_count")
    split = SPLITTERS.get(method, SPLITTERS["recursive"])

    @F.arrow_udf(CHUNK)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (texts,) in pieces(batches):
            found = [[c if isinstance(c, tuple) else (c, None, None) for c in split(t, **options)] if t else [] for t in texts]
            flat = [(i, *c) for chunks in found for i, c in enumerate(chunks)]
            columns = zip(*flat, strict=True) if flat else [()] * len(_CHUNK_TYPE)
            rows = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _CHUNK_TYPE, strict=True)], fields=list(_CHUNK_TYPE))
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), rows)

    rows = df.select(id_col, F.explode(run(F.col(text_col))).alias("c"))
    return rows.select(id_col, "c.index", "c.content", "c.name", "c.level", word_count(F.col("c.content")).alias("word_count"))
