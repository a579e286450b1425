"""Secret scans: fixed base patterns, and a guess-cost dynamic programme for values in credential context.

The cost of a value is that of its cheapest segmentation into dictionary
words, dates, repeats, sequences, keyboard walks and brute-force spans, as a
decimal logarithm of guesses (in the manner of the published zxcvbn work). A
value behind a credential name whose cost reaches a threshold is a span of
kind ``guess``, unless it is code (an unquoted call, subscript or path of names)
or a quoted sentence (five words or more, a quarter of them function words). The base kinds ``assign``, ``access`` and ``hex`` do not depend
on it. Words are ranked by a short list of passwords, then by the order of a
tokenizer's vocabulary, whose merges stand by frequency.

Rows: null and empty texts have no spans; whole texts are read, however long;
an existing column of the output's name is replaced; other columns and
repeated rows pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The base patterns and their kinds, in the order in which ties of start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?|bearer)["']?\x20*(?:=>|[:=])\x20*(?:"([^"\r\n]+)"|'([^'\r\n]+)'|([^\s"',;]+))""",
    re.IGNORECASE | re.ASCII,
)
NAMES = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer")

#: Common words of passwords, most frequent first; callers may pass more.
WORDS = tuple(
    """password love admin welcome monkey dragon master login princess qwerty letmein sunshine football baseball
    shadow michael jordan super test user root guest default secret token changeme hello summer winter spring autumn
    angel flower freedom whatever computer internet server database mysql oracle access private public backup service
    account bank money house orange banana apple silver golden black white green purple yellow tiger eagle falcon
    soccer hockey hunter ranger killer batman superman matrix star wars pokemon cookie chocolate cheese pepper ginger
    the and you for with this that from have""".split()
)
LEET = str.maketrans("4@310$57!", "aaeiossti")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
KIND, _TURN = 0.3, math.log10(4.6)  # which kind of segment; a turn of a walk
_PLACE = {c: (r, i + r / 2) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
_YEAR, _MONTHS, _DAYS = "(?:19|20)[0-9]{2}", ("[1-9]", "(?:0[1-9]|1[0-2])"), ("[1-9]", "(?:0[1-9]|[12][0-9]|3[01])")
#: A pattern for each shape of date, so that every shape is found at every place.
_DATES = [re.compile(f"(?=({_YEAR}))", re.ASCII)] + [
    re.compile(f"(?=({a}([-/._]?){m}\\2{b}))", re.ASCII) for m in _MONTHS for d in _DAYS for a, b in ((_YEAR, d), (d, _YEAR))
]


def vocabulary_words(path: str, least: int = 3) -> tuple[str, ...]:
    """Words of a byte-level vocabulary file, in its order: entries that open with a space and hold letters only."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    found = (token[1:].lower() for token, _ in sorted(vocab.items(), key=lambda x: x[1]) if token.startswith("\u0120") and token[1:].isascii() and token[1:].isalpha() and len(token) > least)
    return tuple(dict.fromkeys(found))


class _Run:
    """Starts of parts of one run, kept while they can still be the cheapest for some end.

    A part from i to j costs value(i) + log10(j - i) in units. A start is out
    once an earlier one is cheaper even for the shortest part that it could
    begin, where its advantage in length is greatest.
    """

    def __init__(self, least: int):
        self.least = least
        self.open: list[tuple[int, float]] = []

    def add(self, i: int, value: float) -> None:
        if not any(v + math.log10((i + self.least - k) / self.least) <= value for k, v in self.open):
            self.open.append((i, value))

    def cheapest(self, j: int) -> float:
        return min((v + math.log10(j - i) for i, v in self.open if j - i >= self.least), default=math.inf)


class GuessCost:
    """log10 of the guesses that the cheapest segmentation of a value takes."""

    def __init__(self, words: tuple[str, ...] = WORDS):
        self.rank: dict[str, int] = {}
        for w in words:
            if len(w) >= 3:
                self.rank.setdefault(w.lower(), len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)

    def matches(self, value: str) -> Iterator[tuple[int, int, float]]:
        """Words and dates: start, end and log10 cost."""
        low = value.lower() if len(value.lower()) == len(value) else value
        plain = low.translate(LEET)
        n = len(value)
        for i in range(n):
            for j in range(i + 3, min(n, i + self.longest) + 1):
                for k, text in enumerate((low[i:j], plain[i:j]) if low[i:j] != plain[i:j] else (low[i:j],)):
                    if rank := self.rank.get(text):
                        upper = sum(c.isupper() for c in value[i:j])
                        case = 0.0 if not upper else math.log10(2) if upper == j - i or value[i].isupper() and upper == 1 else math.log10(sum(math.comb(j - i, x) for x in range(1, min(upper, j - i - upper) + 1)) or 2)
                        yield i, j, math.log10(rank) + case + 0.5 * k
        for pattern in _DATES:
            for m in pattern.finditer(value):
                text = m[1]
                yield m.start(), m.start() + len(text), math.log10(120) if len(text) == 4 else math.log10(365 * 120) + (0.6 if m[2] else 0)

    def __call__(self, value: str) -> float:
        n = len(value)
        if not n:
            return 0.0
        low = value.lower() if len(value.lower()) == len(value) else value
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i, j, cost in self.matches(value):
            ending[j].append((i, cost))
        each = math.log10(cardinality(value))
        best = [0.0] * (n + 1)
        repeats: list[dict[int, _Run]] = [{} for _ in range(9)]  # by unit, then place modulo the unit: parts are whole units
        since = [0] * 9  # where the run of each unit began
        line: tuple[int, _Run] | None = None  # a run of one step up or down
        walk: tuple[_Run, int, object] | None = None  # a keyboard walk, its turns so far and its last direction
        for j in range(1, n + 1):
            best[j] = best[j - 1] + each
            for i, cost in ending[j]:
                best[j] = min(best[j], best[i] + cost + KIND)
            for unit in range(1, 9):
                if j - since[unit] > unit and value[j - 1] != value[j - 1 - unit]:
                    since[unit], repeats[unit] = j - unit, {}
                start = j - 2 * unit  # the latest start of two whole units that end here
                if start >= since[unit]:
                    own = repeats[unit].setdefault(start % unit, _Run(3 if unit == 1 else 2))
                    own.add(start // unit, best[start])
                    best[j] = min(best[j], own.cheapest(j // unit) + unit * math.log10(cardinality(value[start : start + unit])) + KIND)
            if j > 1:
                step = ord(value[j - 1]) - ord(value[j - 2])
                if abs(step) != 1:
                    line = None
                else:
                    if line is None or line[0] != step:
                        line = (step, _Run(3))
                        if value[j - 2].isalnum():
                            line[1].add(j - 2, best[j - 2] + math.log10(26 if value[j - 2].isalpha() else 10))
                    best[j] = min(best[j], line[1].cheapest(j) + (0.3 if step < 0 else 0) + KIND)
                    if value[j - 1].isalnum():
                        line[1].add(j - 1, best[j - 1] + math.log10(26 if value[j - 1].isalpha() else 10))
                way = _way(low[j - 2], low[j - 1])
                if way is None:
                    walk = None
                else:
                    run, turns, last = walk or (_Run(3), 0, None)
                    turns += way != last
                    # a part that starts here makes its first turn by this step
                    run.add(j - 2, best[j - 2] - (turns - 1) * _TURN)
                    walk = (run, turns, way)
                    best[j] = min(best[j], math.log10(47) + turns * _TURN + run.cheapest(j) + KIND)
        return best[n]


def _way(a: str, b: str) -> tuple[int, bool] | None:
    """The direction from a key to a neighbouring one."""
    p, q = _PLACE.get(a), _PLACE.get(b)
    if p is None or q is None or p == q or abs(p[0] - q[0]) > 1 or abs(p[1] - q[1]) > 1:
        return None
    return q[0] - p[0], q[1] > p[1]


def cardinality(text: str) -> int:
    """Characters that brute force would draw from."""
    if all(c in "0123456789abcdef" for c in text):
        return 10 if text.isdigit() else 16
    kinds = (("a", "z", 26), ("A", "Z", 26), ("0", "9", 10))
    n = sum(size for low, high, size in kinds if any(low <= c <= high for c in text))
    return max(10, n + (33 if any(not c.isalnum() for c in text) else 0) + (100 if not text.isascii() else 0))


#: An unquoted value that is an expression: a call or subscript of a name, or a path of names without digits.
_NAME = r"(?:_?[A-Za-z]?[a-z]+(?:[A-Z][a-z]{2,})*(?:_[a-z]+)*|[A-Z]+(?:_[A-Z]+)*)"
CODE = re.compile(rf"(?:[A-Za-z_$][\w$]*(?:\.|::|->))*[A-Za-z_$][\w$]{{2,}}[(\[]|(?:new|await|return)$|(?:{_NAME}(?:\.|::|->))+{_NAME}[;)\]}}]*$", re.ASCII)
#: Words that hold sentences together; passphrases of drawn words have few.
FUNCTION_WORDS = frozenset("the a an and or but of on in at to for from with by as is are was were be been has have had not no this that these those it its he she they we you i my your his her their our which who when where there if then than so".split())

_WORD = re.compile(r"[^\W\d_]['’a-zß-ÿ-]*[,.;:!?]?")


def is_plain(value: str, quoted: bool) -> bool:
    """Whether a value is code or a sentence, and so no secret however dear its segmentation is."""
    if not quoted:
        return CODE.match(value) is not None
    words = value.split(" ")
    if len(words) < 5 or not all(_WORD.fullmatch(w) for w in words):
        return False
    return 4 * sum(w.lower().rstrip(",.;:!?") in FUNCTION_WORDS for w in words) >= len(words)


def find_spans(text: str, cost: GuessCost, threshold: float) -> list[tuple[str, int, int, float]]:
    """Spans kind, start, end, cost (nan where none is taken), by start, then kind as listed."""
    found: list[tuple[str, int, int, float]] = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(name in low for name in NAMES):
            found += [("assign", *m.span(), cost(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
            for m in CONTEXT.finditer(text):
                value = m[m.lastindex]
                if len(value) >= 6 and not is_plain(value, m.lastindex < 3) and (c := cost(value)) >= threshold:
                    found.append(("guess", *m.span(m.lastindex), c))
    if "AKIA" in text:
        found += [("access", *m.span(), math.nan) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), math.nan) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())])
_SPAN_SQL = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("log10_guesses", T.DoubleType())]))


def scan_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets", words: tuple[str, ...] = WORDS, threshold: float = 8.0, mask: str | None = None) -> DataFrame:
    """docs and a column of spans (kind, start, end, log10_guesses) in code points, end exclusive.

    With ``mask``, spans that touch or overlap are replaced by it in the text. The
    scan keeps its partitions: no shuffle.
    """
    docs = docs.drop(out_col)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, _SPAN_SQL)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = GuessCost(words)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [find_spans(t, cost, threshold) if t else [] for t in texts]
            columns = list(batch.columns)
            if mask is not None and any(found):
                columns[at] = pa.array([redacted(t, s, mask) if s else t for t, s in zip(texts, found, strict=True)], columns[at].type)
            spans = pa.array([[{"kind": k, "start": a, "end": b, "log10_guesses": None if c != c else c} for k, a, b, c in s] for s in found], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([*columns, spans], names=schema.names)

    return docs.mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple], mask: str) -> str:
    out, at, end = [], 0, -1
    for _, a, b, *_ in spans:  # by start
        if a > end:
            out += [text[at:a], mask]
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]


def joined(spans, kinds: tuple[str, ...] = KINDS):
    """kind:start:end of spans of these kinds, comma-joined."""
    kept = F.filter(spans, lambda s: s.kind.isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
