"""Format detection: an ordered ladder of signatures over a binary column, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 8192
#: PalmDB type and creator -> format (fixed values).
PALM = {"PNRDPPRS": "pdb", "DATAPLKR": "pdb", "TEXTREAD": "pdb", "BOOKMOBI": "mobi"}


def _hex(content: Column, start: int, length: int) -> Column:
    return F.hex(F.substring(content, start, length))


def _starts(content: Column, *magic: bytes) -> Column:
    out = F.lit(False)
    for m in magic:
        out = out | (_hex(content, 1, len(m)) == m.hex().upper())
    return out


def head_text(content: Column, size: int) -> Column:
    """The head as Latin-1 text, so that patterns can be matched on it."""
    return F.decode(F.substring(content, 1, size), "ISO-8859-1")


def looks_like_text(content: Column) -> Column:
    """A byte order mark; else no NUL, few control bytes and mostly printable ones in the head."""
    head = head_text(content, WINDOW)
    n = F.length(head)
    controls = n - F.length(F.regexp_replace(head, r"[\x01-\x08\x0B\x0E-\x1F\x7F]", ""))
    printable = n - F.length(F.regexp_replace(head, r"[\x09\x0A\x0C\x0D\x20-\x7E\x80-\xFF]", ""))
    marked = _starts(content, b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")
    return marked | ((F.instr(head, "\x00") == 0) & (controls <= 0.05 * n) & (printable >= 0.85 * n))


def detected_format(content: Column) -> Column:
    """The format's name; null for empty content, 'unknown' for what no rule takes."""
    head = head_text(content, WINDOW)
    palm = F.upper(F.decode(F.substring(content, 61, 8), "ISO-8859-1"))
    out = F.when(content.isNull() | (F.octet_length(content) == 0), None)
    for magic, name in (((b"TPZ",), "unsupported"), ((b"\xeaDRMION",), "unsupported"), ((b"CONT",), "unsupported")):
        out = out.when(_starts(content, *magic), name)
    out = out.when(F.substring(head, 1, 1024).rlike(r"^(?:\xEF\xBB\xBF)?\s*%PDF"), "pdf")
    for magic, name in (
        ((b"ITSF",), "chm"), ((b"AT&TFORM",), "djvu"), ((b"II*\x00", b"MM\x00*", b"II+\x00", b"MM\x00+"), "tiff"), ((b"{\\rtf",), "rtf"), ((b"L\x00R\x00X\x00",), "lrx"), ((b"L\x00R\x00F\x00",), "lrf"),
        ((b"PK\x03\x04", b"PK\x05\x06"), "zip"), ((b"7z\xbc\xaf\x27\x1c",), "7z"), ((b"Rar!\x1a\x07",), "rar"), ((b"SQLite format 3\x00",), "sqlite"),
    ):
        out = out.when(_starts(content, *magic), name)
    for kind, name in PALM.items():
        out = out.when(palm == kind, name)
    out = out.when(F.substring(head, 1, 4096).rlike(r"(?i)<FictionBook[\s>]"), "fb2")
    out = out.when(head.rlike(r"(?i)<!doctype\s+html|<html[\s>]|<(?:head|body)[\s>]"), "html")
    return out.when(looks_like_text(content), "txt").otherwise("unknown")


def refine_zip(paths: Column) -> Column:
    """What a zip holds, by its entries' names, in order of precedence."""
    any_ = lambda pattern: F.exists(paths, lambda p: F.lower(p).rlike(pattern))
    return (
        F.when(any_(r"^meta-inf/container\.xml$"), "epub").when(any_(r"^comics\.txt$"), "cbc").when(any_(r"\.fb2$"), "fbz").when(any_(r"^word/document\.xml$"), "docx")
        .when(any_(r"^content\.xml$"), "odt").when(any_(r"^[^/]+\.x?html?$"), "htmlz").when(any_(r"^[^/]+\.(txt|md|markdown)$"), "txtz").when(any_(r"\.(jpe?g|png|gif|webp|bmp)$"), "cbz").otherwise("zip")
    )


def refine_mobi(content: Column) -> Column:
    """azw3 where the first record's version field is 8, else mobi."""
    record = F.conv(_hex(content, 79, 4), 16, 10).cast("int")
    return F.when(F.conv(F.hex(F.substr(content, record + 0x68 + 1, F.lit(4))), 16, 10) == "8", "azw3").otherwise("mobi")
