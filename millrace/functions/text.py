"""Text functions from Column to Column. White space is Unicode's, as Python's strip and split have it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}"


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip_ws(c) == "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def weighted_length(c: Column) -> Column:
    """CJK characters count one, others one and a half, truncated."""
    cjk = F.length(F.regexp_replace(c, f"[^{CJK}]", ""))
    return cjk + F.floor((F.length(c) - cjk) * 1.5).cast("int")


def clean_cell(c: Column, most: int = 8000) -> Column:
    """Control characters out, white space collapsed, cut at the embedding service's limit."""
    return F.substring(strip_ws(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"(?U)\s+", " ")), 1, most)


def is_numeric_text(c: Column) -> Column:
    """Whether a text reads as a number; commas are dropped, a percent sign at the end is enough."""
    s = strip_ws(c)
    return F.coalesce(s.endswith("%") | F.regexp_replace(s, ",", "").try_cast("double").isNotNull(), F.lit(False))


def parse_date(c: Column) -> Column:
    """The four date formats, else null. The lengths keep lenient parsing out."""
    s = strip_ws(c)
    shapes = (
        (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", (1, 2, 3)), (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", (1, 2, 3)),
        (r"^(\d{4})年(\d{1,2})月(\d{1,2})日$", (1, 2, 3)), (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (3, 2, 1)),
    )
    part = lambda p, i: F.regexp_extract(s, p, i)
    made = [F.when(s.rlike(p), F.try_to_date(F.concat_ws("-", part(p, y), F.lpad(part(p, m), 2, "0"), F.lpad(part(p, d), 2, "0")), "yyyy-MM-dd")) for p, (y, m, d) in shapes]
    return F.coalesce(*made)


#: Outline marks and the heading level that each stands for, first match wins.
HEADING_PATTERNS = (
    (r"^第[一二三四五六七八九十百千零\d]+章", 1),
    (r"^第[一二三四五六七八九十百千零\d]+条", 2),
    (r"^第[一二三四五六七八九十百千零\d]+[节部分篇]", 1),
    (r"^\d{1,2}\.\d{1,2}\.\d{1,2}[\s.、]", 4),
    (r"^\d{1,2}\.\d{1,2}[\s.、]", 3),
)


def heading_level(c: Column) -> Column:
    """0 for a paragraph, else the level that the outline mark suggests."""
    s = strip_ws(c)
    out = F.when(F.coalesce(s, F.lit("")) == "", 0)
    for pattern, level in HEADING_PATTERNS:
        out = out.when(s.rlike(pattern), level)
    return out.when(s.rlike(r"^\d{1,2}[.、]\s"), F.when(F.length(s) < 80, 3).otherwise(0)).when(s.rlike(r"^[(（][一二三四五六七八九十]+[)）]"), 3).otherwise(0)


def style_level(c: Column) -> Column:
    """Heading level of a paragraph style's name."""
    number = F.regexp_extract(c, r"(\d+)", 1)
    named = F.lower(c).contains("heading") | c.contains("标题")
    return F.when(F.coalesce(named, F.lit(False)), F.when(number != "", F.least(number.cast("int"), F.lit(6))).otherwise(1)).otherwise(0)


def safe_filename(c: Column, most: int = 80) -> Column:
    return F.regexp_replace(F.substring(strip_ws(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]', "_")), 1, most), r"[. ]+$", "")


def key_values(c: Column) -> Column:
    """Lines ``key: value`` as a map: first colon parts, the later of equal keys wins."""
    lines = F.filter(F.split(c, "\n"), lambda x: x.contains(":"))
    at = lambda x: F.locate(":", x)
    pairs = F.transform(lines, lambda x: F.struct(strip_ws(F.substring_index(x, ":", 1)).alias("k"), strip_ws(x.substr(at(x) + 1, F.length(x))).alias("v")))
    kept = F.filter(pairs, lambda p: p.k != "")
    last = F.filter(F.transform(kept, lambda p, i: F.struct(p.k.alias("k"), p.v.alias("v"), i.alias("i"))), lambda p: ~F.exists(F.slice(kept, p.i + 2, F.size(kept)), lambda q: q.k == p.k))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p.k, p.v)))


def strip_thought(c: Column) -> Column:
    """Without thinking blocks and the new lines that follow them."""
    return F.regexp_replace(c, r"(?s)<think>.*?</think>\n*", "")


def add_thought(c: Column) -> Column:
    return F.concat(F.lit("<think>\n\n</think>\n\n"), c)


def rule_summary(c: Column, most: int = 100) -> Column:
    """Short text as it is; else cut at the last sentence end beyond half the limit, or marked as cut."""
    s = strip_ws(c)
    head = F.substring(s, 1, most)
    ends = F.greatest(*[F.when(head.contains(m), F.length(head) - F.locate(m, F.reverse(head)) + 1).otherwise(0) for m in ("。", "！", "？", ".", "!", "?")])
    return F.when(F.length(s) <= most, s).when(ends > most // 2, F.left(head, ends)).otherwise(F.concat(head, F.lit("...")))


def cut_at_sentence(c: Column, most: int, share: float = 0.7) -> Column:
    """Text over the limit ends at the first kind of sentence mark whose last place lies beyond that share of it, else at the limit."""
    head = F.left(c, F.lit(most))
    place = lambda m: F.length(head) - F.locate(m, F.reverse(head))
    cuts = [F.when(head.contains(m) & (place(m) > most * share), F.left(head, place(m) + 1)) for m in ("。", "！", "？", ".", "!", "?")]
    return F.when(F.length(c) <= most, c).otherwise(F.coalesce(*cuts, head))


def half_points(c: Column) -> Column:
    """Score clamped to 0..5, rounded half to even at half points."""
    return F.bround(F.least(F.greatest(c, F.lit(0.0)), F.lit(5.0)) * 2) / 2


def sequence_budget(source: Column, target: Column, cutoff: Column | int) -> tuple[Column, Column]:
    """How many tokens of source and target fit the cutoff."""
    cutoff = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    most = F.when(target * 2 < cutoff, cutoff).when(source * 2 < cutoff, cutoff - source).otherwise(F.floor(cutoff * (target / (source + target))).cast("int"))
    new_target = F.least(most, target)
    return F.least(F.greatest(cutoff - new_target, F.lit(0)), source), new_target


#: Words in a model's name and the type they stand for, first match wins.
MODEL_TYPES = (("rerank", ("rerank",)), ("embedding", ("embedding", "embed", "bge", "m3e")), ("vlm", ("vlm", "vision", "-vl", "ocr")))


def model_type(c: Column) -> Column:
    name, out = F.lower(c), None
    for kind, marks in MODEL_TYPES:
        hit = name.rlike("|".join(marks))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("chat")


def repo_name(c: Column) -> Column:
    """models--owner--name as owner/name."""
    return F.replace(F.regexp_replace(c, "^models--", ""), F.lit("--"), F.lit("/"))


def json_or_text(c: Column) -> Column:
    """is_json and the value: JSON text as it reads back, else the text as it is."""
    parsed = F.try_parse_json(c)
    return F.struct(parsed.isNotNull().alias("is_json"), F.when(parsed.isNotNull(), F.to_json(parsed)).otherwise(c).alias("value"))
