"""Sizes of images from their headers, and how many tokens a model's patch grid makes of them."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: JPEG markers of frames, which hold the size, and markers without a length.
_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
_BARE = {0x01, *range(0xD0, 0xD9)}


def header_size(f: BinaryIO) -> tuple[str, int, int] | None:
    """Kind, width and height of a PNG, JPEG, GIF, BMP or WebP image, reading no further than its size; None if it is none or is cut off before."""
    try:
        return _size(f)
    except (struct.error, IndexError):
        return None


def _size(f: BinaryIO) -> tuple[str, int, int] | None:
    head = f.read(32)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR":
        return ("png", *struct.unpack(">II", head[16:24]))
    if head[:6] in (b"GIF87a", b"GIF89a"):
        return ("gif", *struct.unpack("<HH", head[6:10]))
    if head[:2] == b"BM" and len(head) >= 26:
        width, height = struct.unpack("<ii", head[18:26])
        return "bmp", width, abs(height)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        kind = head[12:16]
        if kind == b"VP8X":
            return "webp", 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
        if kind == b"VP8 ":
            width, height = struct.unpack("<HH", head[26:30])
            return "webp", width & 0x3FFF, height & 0x3FFF
        if kind == b"VP8L":
            bits = int.from_bytes(head[21:25], "little")
            return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if head[:2] == b"\xff\xd8":
        at = 2
        while True:
            f.seek(at)
            mark = f.read(9)
            if mark[0] != 0xFF:
                return None
            code = mark[1]
            if code == 0xFF:  # fill bytes
                at += 1
            elif code in _BARE:
                at += 2
            elif code in _FRAMES:
                height, width = struct.unpack(">HH", mark[5:9])
                return "jpeg", width, height
            elif code in (0xD9, 0xDA):
                return None
            else:
                at += 2 + struct.unpack(">H", mark[2:4])[0]
    return None


def image_sizes(rows: DataFrame, path_col: str = "path") -> DataFrame:
    """TRN18: rows with kind, width and height of the image at each path: only headers are read; null where there is no image."""
    from millrace.sources.sheets import opened

    def size(path: str | None) -> tuple:
        try:
            system, place = opened(path)
            with system.open_input_file(place) as f:
                return header_size(f) or (None, None, None)
        except (OSError, TypeError):
            return None, None, None

    @F.pandas_udf("kind string, width int, height int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([size(p) for p in batch], columns=["kind", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    return rows.withColumn("_size", run(path_col)).select("*", "_size.*").drop("_size")


def fitted(width: Column, height: Column, most: int = 768 * 768, least: int = 32 * 32) -> Column:
    """width and height scaled to at most and at least so many pixels, each cut to whole pixels."""

    def scaled(w: Column, h: Column, pixels: int, where: Column) -> Column:
        factor = F.sqrt(F.lit(float(pixels)) / (w * h))
        cut = lambda x: F.when(where, F.floor(x * factor)).otherwise(x).cast("int")
        return F.struct(cut(w).alias("width"), cut(h).alias("height"))

    first = scaled(width, height, most, width.cast("long") * height > most)
    return F.element_at(F.transform(F.array(first), lambda s: scaled(s.width, s.height, least, s.width.cast("long") * s.height < least)), 1)


def grid_tokens(width: Column, height: Column, patch: int = 14, merge: int = 2, least: int = 56 * 56, most: int = 14 * 14 * 4 * 1280) -> Column:
    """Tokens of an image whose sides are rounded to whole merged patches, within bounds of pixels that keep its shape; sides of at least one, ratios of up to 200."""
    unit = patch * merge
    w0, h0 = F.greatest(width, F.lit(unit)), F.greatest(height, F.lit(unit))
    w, h = F.when(w0 / h0 > 200, h0 * 180).otherwise(w0).cast("double"), F.when(h0 / w0 > 200, w0 * 180).otherwise(h0).cast("double")
    near = lambda x: F.greatest(F.bround(x / unit), F.lit(1.0)) * unit
    beta = lambda pixels: F.sqrt(w * h / F.lit(float(pixels)))
    down = lambda x: F.greatest(F.floor(x / beta(most) / unit), F.lit(1)) * unit
    up = lambda x: F.ceil(x / beta(least) / unit) * unit
    area = near(w) * near(h)
    side = lambda x: F.when(area > most, down(x)).when(area < least, up(x)).otherwise(near(x)) / unit
    return (side(w) * side(h)).cast("long")


def frame_indices(frames: Column, seconds: Column, fps: float = 2.0, most: int = 128) -> Column:
    """Evenly spaced frames of a video: one for each 1 / fps seconds, at most ``most``; a stream of unknown length (0 frames) takes its first."""
    n = F.least(frames, F.lit(most), F.greatest(F.lit(1), F.floor(seconds * fps))).cast("int")
    many = F.when(frames == 0, F.lit(most)).otherwise(n)
    last = F.when(frames == 0, F.lit(most - 1)).otherwise(frames - 1)
    return F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.when(many == 1, 0).otherwise(F.floor(i * (last / (many - 1)))).cast("int"))


def expanded(text: Column, mark: str, token: str, counts: Column, begin: str = "", end: str = "") -> Column:
    """Each mark of a text becomes as many tokens as its place in ``counts`` says, between begin and end; marks beyond the counts raise an error."""
    parts = F.split(text, "\\Q" + mark + "\\E", -1)

    def one(part: Column, i: Column) -> Column:
        filled = F.concat(F.lit(begin), F.repeat(F.lit(token), F.element_at(counts, F.greatest(i, F.lit(1))).cast("int")), F.lit(end))
        return F.when(i == 0, part).otherwise(F.concat(filled, part))

    over = F.size(parts) - 1 != F.size(counts)
    return F.when(over, F.raise_error(F.lit(f"the text has another number of {mark} than there are media")).cast("string")).otherwise(F.array_join(F.transform(parts, one), ""))
