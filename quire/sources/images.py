"""Image types and sizes from file heads, as native columns; TIFF tags."""

from __future__ import annotations

import struct
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.shipping import arrow_udf


def _hex(content: Column, start: int, length: int) -> Column:
    return F.hex(F.substring(content, start, length))


def _big(content: Column, start: int, length: int) -> Column:
    return F.conv(_hex(content, start, length), 16, 10).cast("long")


def _little(content: Column, start: int, length: int) -> Column:
    return F.conv(F.concat(*[_hex(content, start + k, 1) for k in reversed(range(length))]), 16, 10).cast("long")


def image_type(content: Column) -> Column:
    """jpeg, png, gif, webp or bmp; null for anything else."""
    head = lambda magic: _hex(content, 1, len(magic)) == magic.hex().upper()
    webp = head(b"RIFF") & (_hex(content, 9, 4) == b"WEBP".hex().upper())
    return F.when(head(b"\xff\xd8\xff"), "jpeg").when(head(b"\x89PNG\r\n\x1a\n"), "png").when(head(b"GIF87a") | head(b"GIF89a"), "gif").when(webp, "webp").when(head(b"BM"), "bmp")


def jpeg_size(content: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(content) and content[at] == 0xFF:
        kind = content[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", content[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
    return None


def image_size(content: Column) -> Column:
    """struct<width, height> from the head; JPEG's frame is searched by an Arrow function."""
    def run(values: pa.Array) -> pa.Array:
        kind = pa.struct([("width", pa.int64()), ("height", pa.int64())])
        sizes = [jpeg_size(v) if v else None for v in values.to_pylist()]
        return pa.array([{"width": s[0], "height": s[1]} if s else None for s in sizes], kind)

    pair = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    kind, chunk = image_type(content), _hex(content, 13, 4)
    bits = _little(content, 22, 4)
    webp = F.when(chunk == b"VP8X".hex().upper(), pair(_little(content, 25, 3) + 1, _little(content, 28, 3) + 1)).when(chunk == b"VP8 ".hex().upper(), pair(_little(content, 27, 2) % 16384, _little(content, 29, 2) % 16384))
    webp = webp.when(chunk == b"VP8L".hex().upper(), pair(bits % 16384 + 1, F.floor(bits / 16384) % 16384 + 1))
    jpeg = arrow_udf(run, "struct<width: bigint, height: bigint>")(F.when(kind == "jpeg", content))
    return F.when(kind == "png", pair(_big(content, 17, 4), _big(content, 21, 4))).when(kind == "gif", pair(_little(content, 7, 2), _little(content, 9, 2))).when(kind == "bmp", pair(_little(content, 19, 4), F.least(_little(content, 23, 4), F.lit(1 << 32) - _little(content, 23, 4)))).when(kind == "webp", webp).otherwise(jpeg)


#: TIFF tags of interest (fixed values).
TIFF_TAGS = {256: "width", 257: "height", 269: "title", 270: "description", 271: "make", 272: "model", 305: "software", 306: "created", 315: "author", 33432: "rights"}


def tiff_tags(content: bytes) -> dict:
    """Known tags of the first directory; BigTIFF as well."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None:
        raise ValueError("no TIFF head")
    big = struct.unpack(f"{order}H", content[2:4])[0] == 43
    at = struct.unpack(f"{order}{'Q' if big else 'I'}", content[8:16] if big else content[4:8])[0]
    count = struct.unpack(f"{order}{'Q' if big else 'H'}", content[at : at + (8 if big else 2)])[0]
    at += 8 if big else 2
    out: dict = {}
    size, place = (20, 8) if big else (12, 4)
    for k in range(min(count, 1000)):
        entry = content[at + size * k : at + size * (k + 1)]
        tag, kind = struct.unpack(f"{order}HH", entry[:4])
        n = struct.unpack(f"{order}{'Q' if big else 'I'}", entry[4 : 4 + place])[0]
        if tag not in TIFF_TAGS:
            continue
        if kind == 2 and n <= 65536:
            start = struct.unpack(f"{order}{'Q' if big else 'I'}", entry[-place:])[0]
            raw = entry[-place:][:n] if n <= place else content[start : start + n]
            out[TIFF_TAGS[tag]] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        elif kind in (3, 4):
            out[TIFF_TAGS[tag]] = struct.unpack(f"{order}{'H' if kind == 3 else 'I'}", entry[4 + place :][: 2 if kind == 3 else 4])[0]
    if "created" in out:
        try:
            out["created"] = datetime.strptime(out["created"], "%Y:%m:%d %H:%M:%S")
        except ValueError:
            del out["created"]
    return out
