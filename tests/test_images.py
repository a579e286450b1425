import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.sources.images import expanded, fitted, frame_indices, grid_tokens, header_size, image_sizes


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\0\0\0" + b"x" * 50


def jpeg(w, h, extra=70_000):
    """Segments of any length, one that holds a smaller picture, and fill bytes before the frame."""
    segment = lambda code, body: bytes([0xFF, code]) + struct.pack(">H", len(body) + 2) + body
    inner = b"\xff\xd8" + segment(0xC0, b"\x08" + struct.pack(">HH", 9, 9) + b"\x03")
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + b"\0" * 9) + segment(0xE1, inner + b"\0" * min(extra, 60_000)) + segment(0xC4, b"\0" * 20) + b"\xff\xff\xff" + segment(0xC2, b"\x08" + struct.pack(">HH", h, w) + b"\x03")[1:] + b"data"


FILES = {
    "a.png": (png(640, 480), ("png", 640, 480)), "b.jpg": (jpeg(3000, 2000), ("jpeg", 3000, 2000)), "c.gif": (b"GIF89a" + struct.pack("<HH", 10, 20) + b"\0" * 9, ("gif", 10, 20)),
    "d.bmp": (b"BM" + b"\0" * 16 + struct.pack("<ii", 31, -17) + b"\0" * 9, ("bmp", 31, 17)), "e.webp": (b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little") + b"\0\0", ("webp", 100, 50)),
    "f.webp": (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (199 | 299 << 14).to_bytes(4, "little") + b"\0" * 9, ("webp", 200, 300)), "g.txt": (b"no image", None), "h.png": (png(5, 5)[:20], None), "i.jpg": (jpeg(5, 5)[:60], None), "j.jpg": (b"", None),
}


def test_headers(spark, tmp_path):
    for name, (raw, want) in FILES.items():
        (tmp_path / name).write_bytes(raw)
        assert header_size(io.BytesIO(raw)) == want, name
    rows = [(str(tmp_path / n),) for n in FILES] + [(str(tmp_path / "missing"),), (None,)]
    got = {r.path and r.path.rsplit("/", 1)[-1]: (r.kind, r.width, r.height) for r in image_sizes(spark.createDataFrame(rows, "path string")).collect()}
    assert got == {n: w or (None, None, None) for n, (_, w) in FILES.items()} | {"missing": (None, None, None), None: (None, None, None)}


def plain_tokens(w, h, unit=28, least=3136, most=14 * 14 * 4 * 1280):
    import math

    w, h = max(w, unit), max(h, unit)
    if w / h > 200:
        w = h * 180
    elif h / w > 200:
        h = w * 180
    a, b = (max(1, round(x / unit)) * unit for x in (w, h))
    if a * b > most:
        beta = math.sqrt(w * h / most)
        a, b = (max(1, math.floor(x / beta / unit)) * unit for x in (w, h))
    elif a * b < least:
        beta = math.sqrt(least / (w * h))
        a, b = (math.ceil(x * beta / unit) * unit for x in (w, h))
    return a // unit * (b // unit)


def test_grids_and_scaling(spark):
    sizes = [(640, 480), (28, 28), (10, 20), (1, 5000), (5000, 10), (3000, 2000), (56, 56), (42, 70), (8000, 6000), (14, 1000)]
    df = spark.createDataFrame(sizes, "w int, h int").select("w", "h", grid_tokens(F.col("w"), F.col("h")).alias("n"), fitted(F.col("w"), F.col("h")).alias("f"))
    got = {(r.w, r.h): (r.n, r.f.width, r.f.height) for r in df.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: plain_tokens(*k) for k in sizes}
    assert got[640, 480][0] == 23 * 17 and got[56, 56][0] == 4  # by hand
    assert got[640, 480][1:] == (640, 480) and got[10, 20][1:] == (22, 45) and got[3000, 2000][1:] == (940, 627)


def test_frames_and_marks(spark):
    cases = [(300, 10.0), (5, 100.0), (1000, 0.1), (0, 3.0), (7, 3.0)]
    df = spark.createDataFrame(cases, "n int, s double").select("n", "s", frame_indices(F.col("n"), F.col("s"), most=16).alias("i"))
    for r in df.collect():
        k = 16 if r.n == 0 else min(r.n, 16, max(1, int(r.s * 2)))
        assert r.i == np.linspace(0, (16 if r.n == 0 else r.n) - 1, k).astype(int).tolist()
    texts = spark.createDataFrame([("<image> and <image>.", [2, 3]), ("none", [])], "t string, c array<long>")
    assert [r.x for r in texts.select(expanded(F.col("t"), "<image>", "<p>", F.col("c"), "[", "]").alias("x")).collect()] == ["[<p><p>] and [<p><p><p>].", "none"]
    with pytest.raises(Exception, match="another number"):
        texts.select(expanded(F.col("t"), "<image>", "<p>", F.array(F.lit(1))).alias("x")).collect()
