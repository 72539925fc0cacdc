"""Markup, navigation and sections of the older Palm books, whose links are byte offsets into one stream."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_IMAGE = re.compile(r"(<img\b[^>]*?)\s(?:lowrecindex|hirecindex|recindex)\s*=\s*[\"']?(\d+)[\"']?", re.I)
_FILEPOS = re.compile(r"\sfilepos\s*=\s*[\"']?(\d+)[\"']?", re.I)
_BREAK = re.compile(r"<\s*/?\s*mbp:pagebreak[^>]*>", re.I)
_OPEN_END = re.compile(r"</([a-zA-Z]+)<")
_LINK = re.compile(r"<a\b[^>]*\shref\s*=\s*[\"']#filepos(\d+)[\"'][^>]*>(.*?)</a>", re.S)
_BETWEEN = re.compile(r"<(?:br|/p|p|/div|div)[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")
NEAR, THIN = 80, 2


def markup(html: str, images: dict[int, str] | None = None) -> str:
    """HTML of a book's markup: image numbers become sources, offsets become anchors, page breaks a styled element."""
    html = _IMAGE.sub(lambda m: f'{m[1]} src="{images[int(m[2])]}"' if images and int(m[2]) in images else m[1], html)
    html = _FILEPOS.sub(lambda m: f' href="#filepos{int(m[1])}"', html).replace(" filepos-id=", " id=")
    html = _BREAK.sub('<div class="mbp_pagebreak"></div>', html).replace("</</", "</")
    return _OPEN_END.sub(r"</\1><", html)


def navigation(html: str) -> list[dict]:
    """label and offset of the longest run of links with little but line and paragraph tags between them, the first of equals."""
    links = list(_LINK.finditer(html))
    runs: list[list[re.Match]] = []
    for link in links:
        last = runs[-1][-1] if runs else None
        joins = last is not None and link.start() - last.end() <= NEAR and len(_BETWEEN.sub("", html[last.end() : link.start()]).strip()) <= THIN
        if joins:
            runs[-1].append(link)
        else:
            runs.append([link])
    best = max(runs, key=len, default=[])
    return [{"label": _TAG.sub("", m[2]).strip(), "offset": int(m[1])} for m in best]


def boundary(raw: bytes, offset: int) -> int | None:
    """Where a section for an offset begins: there, or behind the tag that the offset lies in; None outside of the stream."""
    if not 0 < offset < len(raw):
        return None
    low, high = raw.rfind(b"<", 0, offset), raw.find(b">", offset)
    inside = low > raw.rfind(b">", 0, offset)
    return high + 1 if inside and high >= 0 else offset


def sections(raw: bytes, offsets: list[int]) -> list[tuple[int, int]]:
    """Byte ranges that tile the stream at the boundaries of the offsets; page breaks serve where there are none.

    What precedes the first boundary is a section of its own if it shows any text.
    """
    cuts = sorted({b for o in offsets if (b := boundary(raw, o)) is not None})
    if not cuts:
        breaks = [m.start() for m in re.finditer(rb"<\s*mbp:pagebreak", raw, re.I)]
        cuts = [b for b in breaks if b] if len(breaks) > 1 else []
    if cuts and not _TAG.sub("", raw[: cuts[0]].decode("latin-1")).strip():
        cuts = cuts[1:]
    edges = [0, *(c for c in cuts if c < len(raw)), len(raw)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a] or [(0, len(raw))]


def tiles(marks: DataFrame, books: DataFrame, book: str = "book_id", at: str = "offset", length: str = "length") -> DataFrame:
    """book, section_index, start, end: each book's text cut at its marks; the part before the first mark is a section too."""
    inside = marks.join(books.select(book, length), book).where((F.col(at) > 0) & (F.col(at) < F.col(length))).select(book, F.col(at).alias("start"))
    edges = inside.unionByName(books.select(book, F.lit(0).cast(dict(inside.dtypes)["start"]).alias("start"))).distinct()
    w = Window.partitionBy(book).orderBy("start")
    rows = edges.join(books.select(book, length), book)
    return rows.select(book, (F.row_number().over(w) - 1).alias("section_index"), "start", F.coalesce(F.lead("start").over(w), F.col(length).cast(dict(inside.dtypes)["start"])).alias("end"))
