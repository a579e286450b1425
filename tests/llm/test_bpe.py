import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm.bpe import Encoder, Vocabulary, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n, seed):
    rnd = random.Random(seed)
    pool = "ab cde  '\n\t\x1c\x85​ 　é漢字😀123½ⅷ̀﻿\x00.,;!"
    out = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return [*out, "", " ", "<|endoftext|> x <|endoftext|><|endoftext|>", "ab" * 400, "é" * 3000, "don't they've I'll", "a" * 5001]


@pytest.mark.parametrize("cache", [40, 100_000])
def test_encoder_equals_library(library, cache):
    coder, every = Encoder(Vocabulary(PATH), cache), texts(600, 1)
    for k in range(0, len(every), 50):
        for got, want in zip(coder.encode(every[k : k + 50]), library.encode_batch(every[k : k + 50], add_special_tokens=False), strict=True):
            assert got == struct.pack(f"<{len(want.ids)}I", *want.ids)


def test_every_character(library):
    coder = Encoder(Vocabulary(PATH))
    every = ["a" + chr(c) + " " + chr(c) + "b " + chr(c) * 2 for c in range(0x3400) if not 0xD800 <= c < 0xE000]
    for got, want in zip(coder.encode(every), library.encode_batch(every, add_special_tokens=False), strict=True):
        assert got == struct.pack(f"<{len(want.ids)}I", *want.ids)


def test_scalar_and_stacked_trees_agree():
    v = Vocabulary(PATH)
    rnd = random.Random(2)
    words = ["".join(rnd.choice("thein ") for _ in range(rnd.randint(2, 120))) for _ in range(200)]
    stacked = v.encode_pieces(words)
    assert all(stacked[w] == struct.pack(f"<{len(ids)}I", *ids) for w in words for ids in [v.encode_wide(w.encode())])


def test_documents(spark, library):
    rows = [(i, t, i) for i, t in enumerate(texts(40, 3))] + [(1000, None, 0), (2000, "same", 1), (2000, "same", 1), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    full = encode_documents(df, PATH)
    assert full.columns == ["doc_id", "n_tokens", "ids", "decoded"] and full.count() == len(rows)
    by = {(i, t or ""): library.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    texts_of = {i: t or "" for i, t, _ in rows}
    for r in full.collect():
        assert list(r.ids) == by[r.doc_id, texts_of[r.doc_id]] and r.decoded == texts_of[r.doc_id]
    for r in encode_documents(df, PATH, digests=True).collect():
        ids = by[r.doc_id, texts_of[r.doc_id]]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_wide_pieces_are_not_kept_and_other_files_are_refused(tmp_path):
    import json

    import public_tokenizers
    import pytest

    from millrace.llm.bpe import KEPT, Encoder, Vocabulary

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = Encoder(Vocabulary(path))
    coder.encode(["x" * 5000 + " " + "ab12" * 4000 + " plain words", "y" * 5000])
    assert all(len(k) <= KEPT for k in (*coder.pieces, *coder.chunks)) and " plain" in coder.pieces
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="byte-level"):
            Vocabulary(str(other))
