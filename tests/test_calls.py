import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.calls import DIALECTS, balanced, nested_calls


def scan(text):
    """Outermost objects, character by character."""
    out, open_now, quoted, begin, i = [], [], False, 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if open_now and c == '"':
            quoted = not quoted
        elif not quoted and c in "{[" and (open_now or c == "{"):
            begin = begin if open_now else i
            open_now.append(c)
        elif not quoted and open_now and c in "}]":
            if open_now[-1] == {"}": "{", "]": "["}[c]:
                open_now.pop()
                if not open_now:
                    out.append((begin + 1, i + 1))
            else:
                open_now, quoted = [], False
        i += 1
    return out


def test_spans_equal_a_scan_of_characters(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice('{}[]"\\ab\n ') for _ in range(rnd.randint(0, 60))) for _ in range(600)]
    texts += ['say "hi" {"a": "}"} and [1] {"b": [1, {"c": "\\"}"}]}', "{", "}", "", '{"é": "汉字 }"} x', "{[}] {}", "\\{}", "{" * 500 + "}" * 500, "\\"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string").select("i", balanced(F.col("t")).alias("s"))
    got = {r.i: [(s.start, s.end) for s in r.s] for r in df.collect()}
    assert got.pop(-1) == [] and got == {i: scan(t) for i, t in enumerate(texts)}


HARD = [{"q": 'a "quoted" } brace', "deep": {"x": [1, {"y": "{[("}], "z": None}}, {}, {"text": "</tool_call> Action: no\nAction Input: {}", "n": 1.5}, {"汉": "字\\"}]


@pytest.mark.parametrize("dialect", DIALECTS)
def test_calls_of_five_dialects(spark, dialect):
    dumps = lambda x: json.dumps(x, ensure_ascii=False)
    one = {
        "tags": lambda n, a: f"<tool_call>\n{dumps({'name': n, 'arguments': a})}\n</tool_call>",
        "action": lambda n, a: f"Action: {n}\nAction Input: {json.dumps(a, indent=1, ensure_ascii=False)}",
        "function": lambda n, a: f"<function={n}>{dumps(a)}</function>",
        "named": lambda n, a: f"{n}\n{dumps(a)}",
        "object": lambda n, a: dumps({"name": n, "parameters": a}),
    }[dialect]
    rows, want = [], []
    for k, a in enumerate(HARD):
        rows.append(one("tool_1", a))
        want.append([("tool_1", a)])
        if dialect != "named":
            many = [(f"f{j}", b) for j, b in enumerate(HARD[: k + 1])]
            parts = [one(n, b) for n, b in many]
            rows.append("[" + ", ".join(parts) + "]" if dialect == "object" and k % 2 else "\n".join(parts) if dialect == "object" else "Let me see.\n" + "\n\n".join(parts) + "\nDone.")
            want.append(many)
    rows += ["no call", None, "", "{broken", 'x {"name": "f", "arguments": {}} y' if dialect != "object" else "text {} text"]
    want += [[]] * 5
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", nested_calls(F.col("t"), dialect).alias("c"))
    got = {r.i: [(c.name, json.loads(c.arguments)) for c in r.c] for r in df.collect()}
    assert got == dict(enumerate(want))
    with pytest.raises(ValueError):
        nested_calls(F.lit(""), "none")
