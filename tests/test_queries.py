"""Every registered query that has a statement gives DuckDB's rows on the smallest tables."""

import glob
import hashlib
import math
import os
import re

import duckdb
import pytest

from millrace.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def turns(spark):
    by = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.text))
    return {(c, t): (p, r) for c, rows in by.items() for (t, p), (_, r) in zip(sorted(rows), sorted(rows)[1:], strict=False) if r is not None}


def chunk_contents(spark, name, docs):
    """Digests of the query's chunks by document, in order; and chunks made here must be found by digest."""
    out = {}
    for r in QUERIES[name](spark, SF).collect():
        out.setdefault(r.doc_id, []).append((r["index"], r.content_md5, r.n_chars, r.word_count))
    assert set(out) <= set(docs)
    return {i: [x[1:] for x in sorted(rows)] for i, rows in out.items()}


def described(parts):
    return [(hashlib.md5(p.encode()).hexdigest(), len(p), len(p.split())) for p in parts]


def ladder(text, size, overlap, seps, measure):
    """Splitting down a ladder of separators, written down again from its description: cut, then gather to size with an overlap."""
    seps = [s for s in seps if not s or s in text] or [""]
    sep, rest = seps[0], seps[1:]
    if sep == "":
        bits = list(text)
    else:
        cut = text.split(sep)
        bits = [b + sep for b in cut[:-1]] + [cut[-1]]
    groups, now = [], []
    for b in bits:
        if sep and measure(b) > size:
            groups += [("text", now), ("deep", b)]
            now = []
        else:
            if now and sum(map(measure, now)) + measure(b) > size:
                groups.append(("text", now))
                now = list(now)
                while now and (sum(map(measure, now)) > overlap or sum(map(measure, now)) + measure(b) > size):
                    now = now[1:]
            now = [*now, b]
    groups.append(("text", now))
    out = []
    for kind, g in groups:
        if kind == "deep":
            out += ladder(g, size, overlap, rest or [""], measure)
        elif "".join(g).strip():
            out.append("".join(g).strip())
    return out


LADDERS = {
    "chunk_recursive": (["\n\n", "\n", ". ", " ", ",", ""], 500, 50, len),
    "chunk_sentence": (["\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", " ", ""], 200, 0, len),
    "chunk_semantic": (["。", "！", "？", "；", ". ", "! ", "? ", "\n", "，", ",", " ", ""], 500, 50, lambda t: sum("一" <= c <= "鿿" for c in t) + int(1.5 * sum(not "一" <= c <= "鿿" for c in t))),
}


@pytest.mark.parametrize("name", sorted(LADDERS))
def test_ladder_chunks(spark, docs, name):
    seps, size, overlap, measure = LADDERS[name]
    got = chunk_contents(spark, name, docs)
    for i, text in docs.items():
        assert got.get(i, []) == described(ladder(text, size, overlap, seps, measure) if text else []), i


def test_paragraph_chunks(spark, docs):
    got = chunk_contents(spark, "chunk_paragraph", docs)
    seps, _, _, measure = LADDERS["chunk_semantic"]
    for i, text in docs.items():
        want, now = [], []
        for p in [x.strip() for x in re.split(r"\n\s*\n", text or "") if x.strip()]:
            if len(p) > 2000:
                want += (["\n\n".join(now)] if now else []) + ladder(p, 2000, 200, seps, len)
                now = []
            elif now and len("\n\n".join([*now, p])) > 2000:
                want, now = [*want, "\n\n".join(now)], [p]
            else:
                now.append(p)
        assert got.get(i, []) == described([*want, "\n\n".join(now)] if now else want), i


def test_markdown_and_similarity_chunks_keep_every_word(spark, docs):
    """No heading, table, page line or table of contents is in these texts, so Markdown keeps each as one chunk; similarity cuts between sentences."""
    got = chunk_contents(spark, "chunk_markdown", docs)
    plain = {i: t for i, t in docs.items() if t and t.strip() and not re.search(r"(?mi)^\s*(#|\||```|page \d|[-—]{2,}|目)", t)}
    assert len(plain) > 100 and all(got[i] == described([t.strip()]) for i, t in plain.items())
    got = chunk_contents(spark, "chunk_similarity", docs)
    for i, text in docs.items():
        if text and text.strip():
            assert sum(n for _, n, _ in got[i]) <= len(text.strip()) and all(n >= 100 for _, n, _ in got[i][:-1])


def test_repeats(spark, docs):
    got = {r.doc_id: (r.format_error, r.verdict) for r in QUERIES["validate_repeats"](spark, SF).collect()}
    simple = {r.doc_id: r.format_error for r in QUERIES["validate_format"](spark, SF).collect()}
    at_once = re.compile(r"([\u4e00-\u9fff\w，。；：！？、]{6,})\1{2,}")
    for i, text in docs.items():
        text = text or ""
        cjk = [text[k : k + 20] for k in range(len(text) - 19)]
        apart = any(text.count(p) >= 3 for p in set(cjk) if p.strip() and sum("一" <= c <= "鿿" for c in p) > 12)
        want = simple[i] or ("repeats" if text and (at_once.search(text) or apart) else "")
        assert got[i] == (want, "format_error" if want else "passed" if len(text.strip()) >= 20 else "basic_error"), i


def test_masking(spark, docs):
    patterns = [
        ("phone", "手机", r"(?<!\d)1[3-9]\d{9}(?!\d)"), ("id_card", "身份证", r"(?<!\d)[1-9]\d{5}(?:19|20)\d{3}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)"), ("email", "邮箱", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
        ("bank_card", "银行卡", r"(?<!\d)62\d{14,17}(?!\d)"), ("ip_address", "IP地址", r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)"),
    ]
    want = []
    for i, text in docs.items():
        names, audit = {}, []
        for rule, label, pattern in patterns:
            for m in list(re.finditer(pattern, text or "")):
                names.setdefault(m[0], f"**{label}{chr(65 + len([v for v in names.values() if v.startswith('**' + label)]))}**")
                audit.append((rule, m[0][:10] + "..." if len(m[0]) > 10 else m[0], names[m[0]]))
            text = re.sub(pattern, lambda m: names[m[0]], text) if text else text
        assert not re.search("工号|编号|YG-", text or "")
        md5 = hashlib.md5(text.encode()).hexdigest() if text is not None else None
        want += [(i, *a, md5) for a in audit] or [(i, None, None, None, md5)]
    got = [(r.doc_id, r.rule, r.original, r.replacement, r.text_md5) for r in QUERIES["mask_documents"](spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(r for _, r, *_ in want)


def test_rouge_l_and_bleu(spark):
    got = {(r.conv_id, r.turn): (r.rouge_l, r.bleu) for r in QUERIES["rouge_l_bleu"](spark, SF).collect()}
    want = turns(spark)
    assert set(got) == set(want)
    for key, (p, r) in want.items():
        p, r = p or "", r or ""
        row = [0] * (len(r) + 1)
        for x in p:
            last, row = row, [0] * (len(r) + 1)
            for j, y in enumerate(r, 1):
                row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
        f = 2 * row[-1] / (len(p) + len(r)) if p and r else 0.0
        a, b, logs = p.split(), r.split(), []
        for n in range(1, 5):
            own = [tuple(a[k : k + n]) for k in range(len(a) - n + 1)]
            other = [tuple(b[k : k + n]) for k in range(len(b) - n + 1)]
            hit = sum(min(own.count(g), other.count(g)) for g in set(own))
            logs.append(math.log((hit or 0.1) / max(1, len(own))) if hit or n > 1 else None)
        bleu = None if not a or not b else 0.0 if logs[0] is None else math.exp(sum(logs) / 4) * min(1.0, math.exp(1 - len(b) / len(a)))
        assert got[key][0] == pytest.approx(f, abs=1e-8) and (got[key][1] is None) == (bleu is None) and (bleu is None or got[key][1] == pytest.approx(bleu, abs=1e-8))


def test_packing(spark, docs):
    rows = QUERIES["pack_sequences"](spark, SF).collect()
    length = {i: len((t or "").split()) + 1 for i, t in docs.items()}
    want, left = [], sorted((n, k, i) for k, (i, n) in enumerate(sorted(length.items())) if n <= 4096)
    while left:
        room, pack = 4096, []
        while fits := [x for x in left if x[0] <= room]:
            pack.append(fits[-1][2])
            room -= fits[-1][0]
            left.remove(fits[-1])
        want.append(pack)
    got = {}
    for r in rows:
        assert r.batch == 0 and r.n == length[r.id]
        got.setdefault(r.pack, {})[r.position] = r.id
    assert [[got[p][k] for k in sorted(got[p])] for p in sorted(got)] == want


def test_every_query_has_a_statement_or_a_test():
    tested = {*LADDERS, "chunk_paragraph", "chunk_markdown", "chunk_similarity", "validate_repeats", "mask_documents", "rouge_l_bleu", "pack_sequences", "segmented_scores"}
    assert set(QUERIES) - set(ORACLES) == tested
