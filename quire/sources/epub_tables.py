"""EPUB packages as the tables that the integrity rules read; media overlays and viewports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import package_rules
from quire.operators.package_rules import PACKAGE_TYPE

from .archive import Refused, entries, find, resolve
from .books import _local, decode_text, parse_nav, parse_ncx, parse_opf, xml_root
from quire.shipping import ship

TABLES = {
    "books": "version string, mimetype string, rootfile string, rootfile_type string",
    "toc": "toc_id string",
    "manifest": "pos int, item_id string, href string, media_type string, properties string",
    "spine": "pos int, idref string",
    "entries": "pos int, path string",
    "links": "pos int, kind string, path string, fragment string",
    "anchors": "path string, fragment string",
}
ROW = "book_id string, part string, pos int, a string, b string, c string, d string"
_ID = re.compile(r"\b(?:id|name)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def _split(target: str) -> tuple[str, str | None]:
    path, _, fragment = target.partition("#")
    return path, fragment or None


def package_rows(content: bytes) -> Iterator[tuple]:
    """(part, pos, a, b, c, d) of one book, as far as it can be read; hrefs are resolved against the package's folder."""
    try:
        box = entries(content)
    except Refused:
        yield "books", 0, None, None, None, None
        return
    for pos, path in enumerate(zipfile.ZipFile(io.BytesIO(content)).namelist()):
        yield "entries", pos, path, None, None, None
    container = find(box, "META-INF/container.xml")
    roots = [e.attrib for e in xml_root(box[container]).iter() if _local(e.tag) == "rootfile"] if container else []
    root = next((a.get("full-path") for a in roots), None)
    # Some root file must have the type of a package; else the first one's is told.
    kind = next((a["media-type"] for a in roots if a.get("media-type") == PACKAGE_TYPE), next((a.get("media-type") for a in roots), None))
    mimetype = box.get("mimetype", b"").decode("latin-1")
    path = find(box, root) if root else None
    if path is None:
        yield "books", 0, None, mimetype, root, kind
        return
    opf = parse_opf(box[path])
    yield "books", 0, opf["version"], mimetype, root, kind
    yield "toc", 0, opf["toc_id"], None, None, None
    here = lambda href: href if re.match(r"[a-zA-Z][\w+.-]*:", href) else resolve(path, href) + (f"#{href.split('#', 1)[1]}" if "#" in href else "")
    for pos, m in enumerate(opf["manifest"]):
        yield "manifest", pos, m.get("id"), here(m["href"]) if m.get("href") else None, m.get("media-type"), m.get("properties")
    for pos, ref in enumerate(opf["spine"]):
        yield "spine", pos, ref, None, None, None
    pos = 0
    for m in opf["manifest"]:
        own = find(box, resolve(path, m.get("href", "")))
        is_nav, is_ncx = "nav" in m.get("properties", "").split(), "ncx" in m.get("media-type", "")
        if own and (is_nav or is_ncx):
            if is_nav:
                yield "links", pos, "nav", own, None, None
                pos += 1
            for n in parse_nav(box[own], own) if is_nav else parse_ncx(box[own], own):
                yield "links", pos, "toc", *_split(n["target"]), None
                pos += 1
        if own and "html" in m.get("media-type", ""):
            for one in _ID.finditer(decode_text(box[own])):
                yield "anchors", 0, own, one[1] or one[2], None, None
    for e in xml_root(box[path]).iter():
        if _local(e.tag) == "reference" and "href" in e.attrib:
            yield "links", pos, "guide", *_split(here(e.attrib["href"])), None
            pos += 1


def read_packages(files: DataFrame, path: str = "path", content: str = "content") -> dict[str, DataFrame]:
    """Table name -> rows, for all EPUBs of files at once; each archive is read where its row is."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for book_id, data in frame.itertuples(index=False):
                try:
                    rows += [(book_id, *r) for r in package_rows(bytes(data))]
                except Refused:
                    rows.append((book_id, "books", 0, None, None, None, None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ROW.split(", ")])

    ship(files.sparkSession)
    flat = files.select(F.col(path).alias("book_id"), content).mapInPandas(run, ROW)
    out = {}
    for name, schema in TABLES.items():
        fields = [x.split()[0] for x in schema.split(", ")]
        texts = [f for f in fields if f != "pos"]
        out[name] = flat.where(F.col("part") == name).select("book_id", *(["pos"] if "pos" in fields else []), *[F.col(k).alias(f) for k, f in zip("abcd", texts)])
    return out


def diagnose(files: DataFrame) -> DataFrame:
    """All findings of the integrity rules over the EPUBs of files."""
    t = read_packages(files)
    books = t["books"].join(t["toc"], "book_id", "left")
    return package_rules.findings(books, t["manifest"], t["spine"], t["entries"], t["links"], t["anchors"])


def parse_overlay(content: bytes, base: str) -> list[dict]:
    """Clips of a media overlay in order: text target, audio and its begin and end as written."""
    out = []
    for par in (e for e in xml_root(content).iter() if _local(e.tag) == "par"):
        text = next((e.attrib.get("src", "") for e in par if _local(e.tag) == "text"), "")
        audio = next((e for e in par if _local(e.tag) == "audio"), None)
        path, _, fragment = text.partition("#")
        clip = {"text": resolve(base, path) + (f"#{fragment}" if fragment else ""), "audio": None, "begin": None, "end": None}
        if audio is not None:
            clip |= {"audio": resolve(base, audio.attrib.get("src", "")), "begin": audio.attrib.get("clipBegin"), "end": audio.attrib.get("clipEnd")}
        out.append(clip)
    return out


def viewport_of(html: Column) -> Column:
    """struct<width, height> of a page: its viewport meta, else its SVG's size or view box; whole numbers from 1 to 20,000."""
    head = F.substring(html, 1, 8192)
    meta = F.regexp_extract(head, r"(?is)<meta\b[^>]*name\s*=\s*[\"']viewport[\"'][^>]*>", 0)
    svg = F.regexp_extract(head, r"(?is)<svg\b[^>]*>", 0)
    number = lambda text, pattern: F.regexp_extract(text, pattern, 1).try_cast("int")
    box = r"(?i)\bviewBox\s*=\s*[\"']\s*[-\d.]+[\s,]+[-\d.]+[\s,]+(\d+)[\d.]*[\s,]+(\d+)"
    width = F.coalesce(number(meta, r"(?i)\bwidth\s*=\s*(\d+)"), number(svg, r"(?i)\bwidth\s*=\s*[\"'](\d+)(?:px)?[\"']"), F.regexp_extract(svg, box, 1).try_cast("int"))
    height = F.coalesce(number(meta, r"(?i)\bheight\s*=\s*(\d+)"), number(svg, r"(?i)\bheight\s*=\s*[\"'](\d+)(?:px)?[\"']"), F.regexp_extract(svg, box, 2).try_cast("int"))
    good = width.between(1, 20_000) & height.between(1, 20_000)
    return F.when(good, F.struct(width.alias("width"), height.alias("height")))
