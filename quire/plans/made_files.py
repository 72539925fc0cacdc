"""Book files made of rows, so that the parsers can be run over whole tables: (name, title, author, texts) -> bytes."""

from __future__ import annotations

import io
import sqlite3
import struct
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column

from quire.shipping import arrow_udf


def _zip(entries: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in entries.items():
            archive.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def fb2(title: str, author: str, texts: list[str]) -> bytes:
    body = "".join(f"<section><p>{escape(t)}</p></section>" for t in texts)
    info = f"<title-info><author><first-name>{escape(author)}</first-name></author><book-title>{escape(title)}</book-title></title-info>"
    return f'<?xml version="1.0" encoding="UTF-8"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description>{info}</description><body>{body}</body></FictionBook>'.encode()


def fbz(title: str, author: str, texts: list[str]) -> bytes:
    return _zip({"book.fb2": fb2(title, author, texts)})


def htmlz(title: str, author: str, texts: list[str]) -> bytes:
    body = "".join(f"<p>{escape(t)}</p>" for t in texts)
    return _zip({"index.html": f"<html><head></head><body>{body}</body></html>", "metadata.opf": opf(title, author, [])})


def opf(title: str, author: str, names: list[str]) -> str:
    items = "".join(f'<item id="i{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
    refs = "".join(f'<itemref idref="i{k}"/>' for k in range(len(names)))
    meta = f'<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>en</dc:language><dc:identifier id="uid">urn:x:{escape(title)}</dc:identifier></metadata>'
    return f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid">{meta}<manifest>{items}</manifest><spine>{refs}</spine></package>'


def epub(title: str, author: str, texts: list[str]) -> bytes:
    names = [f"text/t{k}.xhtml" for k in range(len(texts))]
    root = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    pages = {f"OEBPS/{n}": f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title/></head><body><p>{escape(t)}</p></body></html>' for n, t in zip(names, texts)}
    return _zip({"mimetype": "application/epub+zip", "META-INF/container.xml": root, "OEBPS/content.opf": opf(title, author, names), **pages})


def packed_palmdoc(data: bytes) -> bytes:
    """Bytes that stand for themselves, and runs of eight or less of those that do not."""
    out, at = bytearray(), 0
    while at < len(data):
        if data[at] == 0 or 9 <= data[at] < 0x80:
            out.append(data[at])
            at += 1
            continue
        end = at
        while end < len(data) and end - at < 8 and not (data[end] == 0 or 9 <= data[end] < 0x80):
            end += 1
        out += bytes([end - at]) + data[at:end]
        at = end
    return bytes(out)


def palm(name: str, kind: bytes, records: list[bytes]) -> bytes:
    head = name.encode("cp1252", "replace")[:31].ljust(32, b"\0") + bytes(28) + kind + bytes(8) + struct.pack(">H", len(records))
    at = len(head) + 8 * len(records) + 2
    table = b""
    for r in records:
        table += struct.pack(">II", at, 0)
        at += len(r)
    return head + table + bytes(2) + b"".join(records)


def _records(raw: bytes) -> list[bytes]:
    return [packed_palmdoc(raw[k : k + 4096]) for k in range(0, max(1, len(raw)), 4096)]


def palmdoc(title: str, author: str, texts: list[str]) -> bytes:
    raw = "\n\n".join(texts).encode()
    parts = _records(raw)
    return palm(title, b"TEXtREAd", [struct.pack(">HHIHHI", 2, 0, len(raw), len(parts), 4096, 0), *parts])


def mobi(title: str, author: str, texts: list[str]) -> bytes:
    raw = ("<html><body>" + "".join(f"<p>{escape(t)}</p>" for t in texts) + "</body></html>").encode()
    parts, name, who = _records(raw), title.encode(), author.encode()
    exth = b"EXTH" + struct.pack(">III", 12 + 8 + len(who), 1, 100) + struct.pack(">I", 8 + len(who)) + who
    head = bytearray(struct.pack(">HHIHHHH", 2, 0, len(raw), len(parts), 4096, 0, 0) + b"MOBI" + struct.pack(">III", 232, 2, 65001) + bytes(216))
    head[84:92] = struct.pack(">II", len(head) + len(exth), len(name))
    return palm(title, b"BOOKMOBI", [bytes(head) + exth + name, *parts])


def _number(value: int) -> bytes:
    out = [value & 0x7F | 0x80]
    while value := value >> 7:
        out.insert(0, value & 0x7F)
    return bytes(out)


def index_records(tags: list[tuple[int, int]], rows: list[tuple[bytes, list[list[int]]]], labels: bytes = b"") -> list[bytes]:
    """An index: tags as (tag, values), each with a bit of its own; rows as (name, values of each tag)."""
    head = bytearray(192)
    head[:4], head[4:8], head[24:28], head[52:56] = b"INDX", struct.pack(">I", 192), struct.pack(">I", 1), struct.pack(">I", bool(labels))
    layout = b"".join(bytes((tag, values, 1 << k, 0)) for k, (tag, values) in enumerate(tags)) + bytes((0, 0, 0, 1))
    tagx = b"TAGX" + struct.pack(">II", 12 + len(layout), 1) + layout
    body, places = b"", []
    for name, values in rows:
        places.append(192 + len(body))
        body += bytes([len(name)]) + name + bytes([(1 << len(tags)) - 1]) + b"".join(_number(v) for own in values for v in own)
    data = bytearray(192)
    data[:4], data[20:24], data[24:28] = b"INDX", struct.pack(">I", 192 + len(body)), struct.pack(">I", len(rows))
    return [bytes(head) + tagx, bytes(data) + body + b"IDXT" + b"".join(struct.pack(">H", p) for p in places), *([labels] if labels else [])]


def azw3(title: str, author: str, texts: list[str]) -> bytes:
    """A page for each text: a skeleton with one fragment in its body, and a navigation that leads to the fragments."""
    raw, skeletons, fragments, points, labels = b"", [], [], [], b""
    for k, t in enumerate(texts):
        skeleton, piece = b"<html><body></body></html>", f'<p id="t{k}">{escape(t)}</p>'.encode()
        into = len(raw) + skeleton.index(b"</body>")
        skeletons.append((f"SKEL{k:010}".encode(), [[1], [len(raw), len(skeleton)]]))
        fragments.append((f"{into:010}".encode(), [[0], [k], [k], [0, len(piece)]]))
        points.append((f"{k:04}".encode(), [[len(labels)], [0], [k, 0]]))
        label = f"Turn {k}".encode()
        labels += _number(len(label)) + label
        raw += skeleton + piece
    parts, name, who = _records(raw), title.encode(), author.encode()
    exth = b"EXTH" + struct.pack(">III", 12 + 8 + len(who), 1, 100) + struct.pack(">I", 8 + len(who)) + who
    head = bytearray(struct.pack(">HHIHHHH", 2, 0, len(raw), len(parts), 4096, 0, 0) + b"MOBI" + struct.pack(">III", 248, 2, 65001) + bytes(232))
    head[84:92] = struct.pack(">II", len(head) + len(exth), len(name))
    head[0x68:0x6C], head[0xC0:0xC8] = struct.pack(">I", 8), struct.pack(">II", 0xFFFFFFFF, 1)
    at, tables = 1 + len(parts), []
    for place, index in ((0xF4, index_records([(3, 1), (4, 1), (6, 2)], points, labels + b"\0")), (0xF8, index_records([(2, 1), (3, 1), (4, 1), (6, 2)], fragments)), (0xFC, index_records([(1, 1), (6, 2)], skeletons))):
        head[place : place + 4] = struct.pack(">I", at)
        at += len(index)
        tables += index
    return palm(title, b"BOOKMOBI", [bytes(head) + exth + name, *parts, *tables])


def tiff(title: str, author: str, texts: list[str]) -> bytes:
    """One directory with size, title and author."""
    strings = [title.encode() + b"\0", author.encode() + b"\0"]
    entries, at = [], 8 + 2 + 12 * 4 + 4
    for tag, raw in zip((269, 315), strings):
        entries.append(struct.pack("<HHII", tag, 2, len(raw), at) if len(raw) > 4 else struct.pack("<HHI", tag, 2, len(raw)) + raw.ljust(4, b"\0"))
        at += len(raw)
    sizes = [struct.pack("<HHIHH", tag, 3, 1, n, 0) for tag, n in ((256, len(texts)), (257, 7))]
    return b"II*\0" + struct.pack("<IH", 8, 4) + b"".join(sizes + entries) + bytes(4) + b"".join(strings)


def broken(title: str, author: str, texts: list[str]) -> bytes:
    return b"PK\3\4" + title.encode()


MAKERS: dict[str, Callable[[str, str, list[str]], bytes]] = {"epub": epub, "fb2": fb2, "fbz": fbz, "htmlz": htmlz, "pdb": palmdoc, "mobi": mobi, "tiff": tiff, "zip": broken, "azw3": azw3}


def book_file(kind: Column, title: Column, author: Column, texts: Column) -> Column:
    def run(kinds: pa.Array, titles: pa.Array, authors: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([MAKERS[k](t, a, x) for k, t, a, x in zip(*(c.to_pylist() for c in (kinds, titles, authors, lists)))], pa.binary())

    return arrow_udf(run, "binary")(kind, title, author, texts)


def word_file(kind: Column, words: Column) -> Column:
    """An OCR document of one page and line; words: array<struct<id, text, x, y, w, h>>, whole numbers."""
    def alto(words: list[dict]) -> str:
        inner = "".join(f'<String ID={quoteattr(w["id"])} CONTENT={quoteattr(w["text"])} HPOS="{w["x"]}" VPOS="{w["y"]}" WIDTH="{w["w"]}" HEIGHT="{w["h"]}" WC="0.5"/>' for w in words)
        return f'<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Description><MeasurementUnit>pixel</MeasurementUnit></Description><Layout><Page WIDTH="900" HEIGHT="900"><PrintSpace><TextBlock ID="b" HPOS="0" VPOS="0" WIDTH="900" HEIGHT="900"><TextLine ID="l" HPOS="0" VPOS="0" WIDTH="900" HEIGHT="90">{inner}</TextLine></TextBlock></PrintSpace></Page></Layout></alto>'

    def page(words: list[dict]) -> str:
        points = lambda w: f'{w["x"]},{w["y"]} {w["x"] + w["w"]},{w["y"]} {w["x"] + w["w"]},{w["y"] + w["h"]} {w["x"]},{w["y"] + w["h"]}'
        inner = "".join(f'<Word id={quoteattr(w["id"])}><Coords points="{points(w)}"/><TextEquiv conf="0.5"><Unicode>{escape(w["text"])}</Unicode></TextEquiv></Word>' for w in words)
        return f'<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page imageWidth="900" imageHeight="900"><TextRegion id="b"><Coords points="0,0 900,900"/><TextLine id="l"><Coords points="0,0 900,90"/>{inner}</TextLine></TextRegion></Page></PcGts>'

    def hocr(words: list[dict]) -> str:
        inner = " ".join(f'<span class="ocrx_word" id={quoteattr(w["id"])} title="bbox {w["x"]} {w["y"]} {w["x"] + w["w"]} {w["y"] + w["h"]}; x_wconf 50">{escape(w["text"])}</span>' for w in words)
        return f'<html><body><div class="ocr_page" title="bbox 0 0 900 900"><div class="ocr_carea" id="b" title="bbox 0 0 900 900"><span class="ocr_line" id="l" title="bbox 0 0 900 90">{inner}</span></div></div></body></html>'

    makers = {"alto": alto, "page": page, "hocr": hocr}

    def run(kinds: pa.Array, rows: pa.Array) -> pa.Array:
        return pa.array([makers[k](w).encode() for k, w in zip(kinds.to_pylist(), rows.to_pylist())], pa.binary())

    return arrow_udf(run, "binary")(kind, words)


def catalogue_file(books: Column) -> Column:
    """A SQLite catalogue; books: array<struct<id, title, author, tag, isbn>>."""
    def one(rows: list[dict]) -> bytes:
        db = sqlite3.connect(":memory:")
        db.executescript(
            """CREATE TABLE books (id INTEGER PRIMARY KEY, title TEXT, sort TEXT, timestamp TEXT, series_index REAL, author_sort TEXT, isbn TEXT, path TEXT); CREATE TABLE authors (id INTEGER PRIMARY KEY, name TEXT);
            CREATE TABLE tags (id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE series (id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE books_authors_link (id INTEGER PRIMARY KEY, book INTEGER, author INTEGER);
            CREATE TABLE books_tags_link (id INTEGER PRIMARY KEY, book INTEGER, tag INTEGER); CREATE TABLE books_series_link (id INTEGER PRIMARY KEY, book INTEGER, series INTEGER);
            CREATE TABLE identifiers (id INTEGER PRIMARY KEY, book INTEGER, type TEXT, val TEXT); CREATE TABLE data (id INTEGER PRIMARY KEY, book INTEGER, format TEXT);"""
        )
        tags = sorted({r["tag"] for r in rows})
        db.executemany("INSERT INTO tags VALUES (?, ?)", list(enumerate(tags)))
        for r in rows:
            db.execute("INSERT INTO books VALUES (?, ?, ?, '2020-01-02 03:04:05+00:00', 1.5, '', ?, '')", (r["id"], r["title"], r["title"], r["isbn"]))
            db.execute("INSERT INTO authors VALUES (?, ?)", (r["id"], r["author"]))
            db.execute("INSERT INTO books_authors_link (book, author) VALUES (?, ?)", (r["id"], r["id"]))
            db.execute("INSERT INTO books_tags_link (book, tag) VALUES (?, ?)", (r["id"], tags.index(r["tag"])))
            db.executemany("INSERT INTO data (book, format) VALUES (?, ?)", [(r["id"], "EPUB"), (r["id"], "PDF")])
            if r["id"] % 2:
                db.execute("INSERT INTO identifiers (book, type, val) VALUES (?, 'isbn', 'own')", (r["id"],))
        db.commit()
        return db.serialize()

    def run(libraries: pa.Array) -> pa.Array:
        return pa.array([one(rows) for rows in libraries.to_pylist()], pa.binary())

    return arrow_udf(run, "binary")(books)
