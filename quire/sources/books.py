"""Parsers from bytes to books: one function for each format, and the reader that runs them.

A parsed book is a dict of title, authors, languages, identifiers and other
metadata, ``sections`` (path, is_html, content) and ``nav`` (label, target,
depth).  A parser refuses what it cannot read; the reader turns that into data.
"""

from __future__ import annotations

import html
import json
import os
import re
import sqlite3
import struct
import tempfile
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .archive import Box, Refused, entries, find, resolve

from quire.shipping import arrow_udf, ship

Book = dict


def _book(**more) -> Book:
    return {"title": "", "authors": [], "languages": [], "publisher": "", "description": "", "subjects": [], "series": "", "series_index": None, "identifiers": {}, "sections": [], "nav": []} | more


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def xml_root(content: bytes) -> ET.Element:
    try:
        return ET.fromstring(content)
    except ET.ParseError as e:
        raise Refused(f"bad XML: {e}") from e


def _texts(root: ET.Element, name: str) -> list[str]:
    return [t for e in root.iter() if _local(e.tag) == name and (t := " ".join("".join(e.itertext()).split()))]


def decode_text(content: bytes) -> str:
    """By byte order mark, declared encoding, the parity of NULs (UTF-16), UTF-8, then Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    head = content[:50_000].decode("latin-1")
    said = re.search(r"<\?xml[^>]*\bencoding\s*=\s*[\"']([\w.-]+)|<meta[^>]+charset\s*=\s*[\"']?([\w.-]+)", head, re.I)
    if said:
        try:
            return content.decode(said[1] or said[2])
        except (LookupError, UnicodeDecodeError):
            pass
    odd, even = content[1:4096:2].count(0), content[0:4096:2].count(0)
    if max(odd, even) > len(content[:4096]) // 4:
        return content.decode("utf-16-le" if odd > even else "utf-16-be", "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        pass
    return content.decode("cp1252", "replace")


def parse_opf(content: bytes) -> Book:
    """Dublin Core and series metadata of a package file, with manifest and spine."""
    root = xml_root(content)
    out = _book(titles=_texts(root, "title"), authors=[], languages=_texts(root, "language"), subjects=_texts(root, "subject"))
    out["title"] = (out.pop("titles") or [""])[0]
    for e in root.iter():
        name, text = _local(e.tag), " ".join("".join(e.itertext()).split())
        attrs = {_local(k): v for k, v in e.attrib.items()}
        if name == "creator" and attrs.get("role", "aut") == "aut" and text:
            out["authors"].append(text)
        elif name in ("publisher", "description") and text and not out[name]:
            out[name] = text
        elif name == "identifier" and text:
            out["identifiers"].setdefault((attrs.get("scheme") or attrs.get("id") or "id").lower(), text)
        elif name == "meta":
            key, value = attrs.get("name") or attrs.get("property") or "", attrs.get("content") or text
            if key.endswith(":series") or key == "belongs-to-collection":
                out["series"] = value
            elif key.endswith(":series_index") or key == "group-position":
                out["series_index"] = _number(value)
    out["version"] = root.attrib.get("version", "")
    out["manifest"] = [{_local(k): v for k, v in e.attrib.items()} for e in root.iter() if _local(e.tag) == "item"]
    out["spine"] = [e.attrib.get("idref", "") for e in root.iter() if _local(e.tag) == "itemref"]
    out["spine_properties"] = [e.attrib.get("properties", "").split() for e in root.iter() if _local(e.tag) == "itemref"]
    metas = [({_local(k): v for k, v in e.attrib.items()}, " ".join("".join(e.itertext()).split())) for e in root.iter() if _local(e.tag) == "meta"]
    out["layout"] = next((text for attrs, text in metas if attrs.get("property") == "rendition:layout"), None)
    out["cover_id"] = next((attrs.get("content") for attrs, _ in metas if attrs.get("name") == "cover"), None)
    out["guide"] = [(e.attrib.get("type", ""), e.attrib.get("href", "")) for e in root.iter() if _local(e.tag) == "reference"]
    out["toc_id"] = next((e.attrib.get("toc") for e in root.iter() if _local(e.tag) == "spine"), None)
    return out


def _number(text: str) -> float | None:
    try:
        return float(text.replace(",", "."))
    except ValueError:
        return None


def parse_ncx(content: bytes, base: str) -> list[dict]:
    out: list[dict] = []

    def walk(e: ET.Element, depth: int) -> None:
        for child in e:
            if _local(child.tag) != "navPoint":
                continue
            label = next((" ".join("".join(x.itertext()).split()) for x in child if _local(x.tag) == "navLabel"), "")
            source = next((x.attrib.get("src", "") for x in child if _local(x.tag) == "content"), "")
            out.append({"label": label, "target": _target(base, source), "depth": depth})
            walk(child, depth + 1)

    for e in xml_root(content).iter():
        if _local(e.tag) == "navMap":
            walk(e, 0)
    return out


def _target(base: str, href: str) -> str:
    path, _, fragment = href.partition("#")
    return (resolve(base, path) if path else base) + (f"#{fragment}" if fragment else "")


def parse_nav(content: bytes, base: str) -> list[dict]:
    """The table of contents of a navigation document, flattened in order."""
    root, out = xml_root(content), []
    navs = [e for e in root.iter() if _local(e.tag) == "nav"]
    toc = next((e for e in navs if "toc" in next((v for k, v in e.attrib.items() if _local(k) == "type"), "").split()), navs[0] if navs else None)

    def walk(e: ET.Element, depth: int) -> None:
        for child in e:
            if _local(child.tag) == "a":
                out.append({"label": " ".join("".join(child.itertext()).split()), "target": _target(base, child.attrib.get("href", "")), "depth": depth})
            else:
                walk(child, depth + (_local(child.tag) == "ol" and _local(e.tag) == "li"))

    if toc is not None:
        walk(toc, 0)
    return out


def cover_item(opf: Book) -> dict | None:
    """The manifest item of the cover: by its property, the package's meta, the guide, or an image's telling id."""
    items = opf["manifest"]
    is_image = lambda m: "image/" in m.get("media-type", "")
    guide = next((href for kind, href in opf["guide"] if kind.lower() == "cover"), None)
    named = resolve("", guide) if guide else None
    rules = (
        lambda m: "cover-image" in m.get("properties", "").split() and is_image(m),
        lambda m: bool(opf["cover_id"]) and m.get("id") == opf["cover_id"],
        lambda m: named is not None and resolve("", m.get("href", "")) == named,
        lambda m: "cover" in m.get("id", "").lower() and is_image(m),
    )
    return next((m for rule in rules for m in items if rule(m)), None)


def package_of(box: Mapping[str, bytes]) -> str:
    """The path of an archive's package document: what the container names, else the first by its suffix."""
    container = find(box, "META-INF/container.xml")
    path = None
    if container:
        path = next((find(box, e.attrib.get("full-path", "")) for e in xml_root(box[container]).iter() if _local(e.tag) == "rootfile"), None)
    path = path or next((p for p in box if p.lower().endswith(".opf")), None)
    if path is None:
        raise Refused("no package document")
    return path


def epub_metadata(content: bytes) -> Book:
    """What the package says, and the cover's path; nothing else of the archive is unpacked."""
    box = Box(content)
    path = package_of(box)
    out = parse_opf(box[path])
    item = cover_item(out)
    return out | {"cover": find(box, resolve(path, item.get("href", ""))) if item else None}


def parse_epub(content: bytes) -> Book:
    box = entries(content)
    path = package_of(box)
    if (enc := find(box, "META-INF/encryption.xml")) and any(x not in _FONT_CIPHERS for x in re.findall(r'EncryptionMethod[^>]*Algorithm="([^"]+)"', decode_text(box[enc]))):
        raise Refused("the book is protected")
    out = parse_opf(box[path])
    item = cover_item(out)
    out["cover"] = find(box, resolve(path, item.get("href", ""))) if item else None
    items = {m.get("id", ""): m | {"path": find(box, resolve(path, m.get("href", "")))} for m in out["manifest"]}
    for ref in out["spine"]:
        item = items.get(ref)
        if item and item["path"]:
            is_html = "html" in item.get("media-type", "")
            out["sections"].append({"path": item["path"], "is_html": is_html, "content": decode_text(box[item["path"]]) if is_html else ""})
    nav = next((m for m in items.values() if "nav" in m.get("properties", "").split() and m["path"]), None)
    ncx = items.get(out["toc_id"] or "") or next((m for m in items.values() if "ncx" in m.get("media-type", "")), None)
    if nav:
        out["nav"] = parse_nav(box[nav["path"]], nav["path"])
    elif ncx and ncx["path"]:
        out["nav"] = parse_ncx(box[ncx["path"]], ncx["path"])
    return out


#: Font obfuscation methods, which are no protection of the text (fixed values).
_FONT_CIPHERS = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")


def deobfuscated(data: bytes, identifier: str, adobe: bool = False) -> bytes:
    """A font with its head XORed back: by the SHA-1 of the identifier, or by a UUID's bytes."""
    import hashlib

    key = bytes.fromhex(re.sub(r"[^0-9a-fA-F]", "", identifier.split(":")[-1])) if adobe else hashlib.sha1(re.sub(r"[ \t\r\n]", "", identifier).encode()).digest()
    size = min(len(data), 1024 if adobe else 1040)
    return bytes(b ^ key[k % len(key)] for k, b in enumerate(data[:size])) + data[size:]


def parse_fb2(content: bytes) -> Book:
    root = xml_root(content)
    out = _book()
    info = next((e for e in root.iter() if _local(e.tag) == "title-info"), None)
    if info is not None:
        for e in info:
            name, text = _local(e.tag), " ".join("".join(e.itertext()).split())
            if name == "book-title":
                out["title"] = text
            elif name == "author":
                parts = [" ".join("".join(x.itertext()).split()) for x in e if _local(x.tag) in ("first-name", "middle-name", "last-name", "nickname")]
                out["authors"] += [" ".join(p for p in parts if p)] if any(parts) else []
            elif name == "lang" and text:
                out["languages"].append(text)
            elif name == "genre" and text:
                out["subjects"].append(text)
            elif name == "annotation":
                out["description"] = text
            elif name == "sequence":
                out["series"], out["series_index"] = e.attrib.get("name", ""), _number(e.attrib.get("number", ""))
    markup = {"p": "p", "subtitle": "h3", "emphasis": "em", "strong": "strong", "poem": "div", "stanza": "div", "v": "p", "cite": "blockquote", "epigraph": "blockquote", "text-author": "p", "empty-line": "br"}

    def render(e: ET.Element, level: int) -> str:
        name = _local(e.tag)
        inner = html.escape(e.text or "", False) + "".join(render(c, level) + html.escape(c.tail or "", False) for c in e)
        if name == "title":
            return f"<h{min(6, level)}>{re.sub(r'</?p>', ' ', inner).strip()}</h{min(6, level)}>"
        if name == "section":
            return f"<div>{inner}</div>"
        return f"<{markup[name]}>{inner}</{markup[name]}>" if name in markup and name != "empty-line" else "<br/>" if name == "empty-line" else inner

    number = 0
    for body in (e for e in root if _local(e.tag) == "body"):
        sections = [e for e in body if _local(e.tag) == "section"] or [body]
        for section in sections:
            path = f"section{number}.xhtml"
            title = next((" ".join("".join(t.itertext()).split()) for t in section if _local(t.tag) == "title"), "")
            out["sections"].append({"path": path, "is_html": True, "content": f"<html><body>{render(section, 1)}</body></html>"})
            out["nav"] += [{"label": title, "target": path, "depth": 0}] if title else []
            number += 1
    if not out["sections"]:
        raise Refused("no body")
    return out


_DESCRIPTION = re.compile(rb"<(?:\w+:)?description[\s>].*?</(?:\w+:)?description\s*>", re.S)


def fb2_metadata(content: bytes) -> Book:
    """Of the description alone, without reading the bodies; of the whole document where it cannot be cut out."""
    found = _DESCRIPTION.search(content)
    head = re.match(rb"\s*(?:\xef\xbb\xbf)?\s*<\?xml[^>]*\?>", content)
    root = re.search(rb"<(?:\w+:)?FictionBook\b[^>]*>", content)
    if found and root and root.start() < found.start():
        name = re.match(rb"<((?:\w+:)?FictionBook)", root[0])[1]
        body = name.replace(b"FictionBook", b"body")
        try:
            return parse_fb2((head[0] if head else b"") + root[0] + found[0] + b"<" + body + b"/></" + name + b">") | {"sections": [], "nav": []}
        except Refused:
            pass
    return parse_fb2(content)


def fbz_metadata(content: bytes) -> Book:
    box = Box(content)
    path = next((p for p in box if p.lower().endswith(".fb2")), None)
    if path is None:
        raise Refused("no FictionBook inside")
    return fb2_metadata(box[path])


def parse_fbz(content: bytes) -> Book:
    box = entries(content)
    path = next((p for p in box if p.lower().endswith(".fb2")), None)
    if path is None:
        raise Refused("no FictionBook inside")
    return parse_fb2(box[path])


def normalized_txt(text: str) -> str:
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{6,}", "\n" * 5, re.sub(r"[ \t]+(?=\n|\Z)", "", text)).strip("\n")


def parse_txt(content: bytes) -> Book:
    text = decode_text(content)
    lines = text.replace("\r\n", "\n").split("\n")
    out = _book()
    if len(lines) > 3 and lines[0].strip() and not lines[1].strip() and not lines[2].strip() and lines[3].strip():
        out["title"], out["authors"] = lines[0].strip(), [a.strip() for a in lines[3].split(",") if a.strip()]
    blocks = [" ".join(b.split()) for b in re.split(r"\n[ \t]*\n\s*", normalized_txt(text)) if b.strip()]
    out["sections"] = [{"path": "index.xhtml", "is_html": True, "content": "<html><body>" + "".join(f"<p>{html.escape(b, False)}</p>" for b in blocks) + "</body></html>"}]
    return out


def _inline_markdown(text: str) -> str:
    text = html.escape(text, False)
    text = re.sub(r"`([^`]+)`", r"<code>\1</code>", text)
    text = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)", r'<img src="\2" alt="\1"/>', text)
    text = re.sub(r"\[([^\]]+)\]\(([^)\s]+)[^)]*\)", r'<a href="\2">\1</a>', text)
    text = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"<strong>\2</strong>", text)
    return re.sub(r"(?<!\w)([*_])(?=\S)(.+?)(?<=\S)\1(?!\w)", r"<em>\2</em>", text)


def front_matter(text: str) -> tuple[dict, str]:
    """Keys of a leading block between dashes (scalars and lists) and the rest."""
    m = re.match(r"---\n(.*?)\n(?:---|\.\.\.)\n", text, re.S)
    if not m:
        return {}, text
    out: dict = {}
    key = ""
    for line in m[1].split("\n"):
        if item := re.match(r"\s+-\s+(.*)", line):
            out[key] = [*(out[key] if isinstance(out.get(key), list) else []), item[1].strip(" \"'")]
        elif pair := re.match(r"([\w-]+):\s*(.*)", line):
            key, value = pair[1].lower(), pair[2].strip()
            out[key] = [x.strip(" \"'") for x in value[1:-1].split(",")] if value.startswith("[") else value.strip("\"'")
    return out, text[m.end() :]


def parse_markdown(content: bytes) -> Book:
    """The common subset: headings, paragraphs, lists, quotes, code, rules; headings get unique slugs."""
    meta, text = front_matter(decode_text(content).replace("\r\n", "\n"))
    many = lambda v: v if isinstance(v, list) else [x.strip() for x in v.split(",") if x.strip()] if v else []
    out = _book(title=str(meta.get("title", "")), authors=many(meta.get("authors") or meta.get("author")), languages=many(meta.get("language") or meta.get("lang")), subjects=many(meta.get("tags")))
    parts, slugs, lists = [], {}, []
    in_code, paragraph = False, []

    def close() -> None:
        if paragraph:
            parts.append(f"<p>{_inline_markdown(' '.join(paragraph))}</p>")
            paragraph.clear()
        while lists:
            parts.append(f"</{lists.pop()}>")

    for line in text.split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            close()
            parts.append("</code></pre>" if in_code else "<pre><code>")
            in_code = not in_code
        elif in_code:
            parts.append(html.escape(line, False) + "\n")
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            close()
            base = re.sub(r"[^a-z0-9]+", "-", m[2].lower()).strip("-") or "section"
            slugs[base] = slugs.get(base, 0) + 1
            slug = base if slugs[base] == 1 else f"{base}-{slugs[base]}"
            parts.append(f'<h{len(m[1])} id="{slug}">{_inline_markdown(m[2])}</h{len(m[1])}>')
            out["nav"].append({"label": m[2], "target": f"index.xhtml#{slug}", "depth": len(m[1]) - 1})
        elif m := re.match(r"\s*(?:[-*+]|(\d+)[.)])\s+(.*)", line):
            kind = "ol" if m[1] else "ul"
            if not lists:
                close()
                lists.append(kind)
                parts.append(f"<{kind}>")
            parts.append(f"<li>{_inline_markdown(m[2])}</li>")
        elif re.match(r"\s*([-*_])(\s*\1){2,}\s*$", line):
            close()
            parts.append("<hr/>")
        elif line.startswith(">"):
            close()
            parts.append(f"<blockquote>{_inline_markdown(line.lstrip('> '))}</blockquote>")
        elif not line.strip():
            close()
        else:
            paragraph.append(line.strip())
    close()
    out["title"] = out["title"] or next((n["label"] for n in out["nav"] if n["depth"] == 0), "")
    out["sections"] = [{"path": "index.xhtml", "is_html": True, "content": f"<html><body>{''.join(parts)}</body></html>"}]
    return out


_HEADING = re.compile(r"<h([1-6])\b([^>]*)>(.*?)</h\1>", re.S | re.I)


def heading_nav(page: str, path: str) -> list[dict]:
    out, levels = [], []
    for m in _HEADING.finditer(page):
        level = int(m[1])
        while levels and levels[-1] >= level:
            levels.pop()
        own = re.search(r"\bid\s*=\s*[\"']?([^\s\"'>]+)", m[2])
        out.append({"label": " ".join(html.unescape(re.sub(r"<[^>]*>", "", m[3])).split()), "target": path + (f"#{own[1]}" if own else ""), "depth": len(levels)})
        levels.append(level)
    return out


def html_meta(page: str) -> dict:
    """Title, language and metas of a page; the first of each key counts."""
    out: dict = {}
    if m := re.search(r"<title[^>]*>(.*?)</title>", page, re.S | re.I):
        out["title"] = " ".join(html.unescape(m[1]).split())
    if m := re.search(r"<html[^>]*\blang\s*=\s*[\"']?([\w-]+)", page, re.I):
        out["lang"] = m[1]
    for tag in re.findall(r"<meta\b[^>]*>", page, re.I):
        key = re.search(r"\b(?:name|property)\s*=\s*[\"']([^\"']+)", tag, re.I)
        value = re.search(r"\bcontent\s*=\s*(\"[^\"]*\"|'[^']*')", tag, re.I)
        if key and value:
            out.setdefault(key[1].lower(), html.unescape(value[1][1:-1]).strip())
    return out


def page_metadata(page: Column) -> Column:
    """``html_meta`` as struct<title, lang, metas>; null for null."""
    kind = pa.struct([("title", pa.string()), ("lang", pa.string()), ("metas", pa.map_(pa.string(), pa.string()))])

    def run(pages: pa.Array) -> pa.Array:
        out = []
        for text in pages.to_pylist():
            found = html_meta(text) if text is not None else None
            out.append(None if found is None else {"title": found.pop("title", ""), "lang": found.pop("lang", ""), "metas": list(found.items())})
        return pa.array(out, kind)

    return arrow_udf(run, "struct<title: string, lang: string, metas: map<string,string>>")(page)


def parse_html(content: bytes) -> Book:
    page = decode_text(content)
    meta = html_meta(page)
    first = lambda *keys: next((meta[k] for k in keys if meta.get(k)), "")
    authors = [a.strip() for a in re.split(r"(?i)\s*;\s*|\s*\|\s*|\s+\band\b\s+", first("author", "dc.creator", "article:author")) if a.strip()]
    return _book(
        title=first("dc.title", "og:title", "title"), authors=authors, languages=[x] if (x := first("dc.language", "lang")) else [], description=first("description", "dc.description", "og:description"), publisher=first("dc.publisher", "publisher"),
        identifiers={"isbn": x} if (x := first("isbn", "dc.identifier.isbn", "book:isbn")) else {}, sections=[{"path": "index.html", "is_html": True, "content": page}], nav=heading_nav(page, "index.html"),
    )


def parse_htmlz(content: bytes) -> Book:
    box = entries(content)
    path = next((p for p in box if "/" not in p and p.lower().endswith((".html", ".htm", ".xhtml"))), None)
    if path is None:
        raise Refused("no page at the top")
    out = parse_html(box[path])
    if opf := next((p for p in box if p.lower().endswith(".opf")), None):
        out = merged(out, parse_opf(box[opf]))
    return out


def parse_txtz(content: bytes) -> Book:
    box = entries(content)
    paths = [p for p in box if p.lower().endswith((".txt", ".md", ".markdown"))]
    if not paths:
        raise Refused("no text inside")
    path = paths[0]
    out = (parse_txt if path.lower().endswith(".txt") else parse_markdown)(box[path])
    if opf := next((p for p in box if p.lower().endswith(".opf")), None):
        out = merged(out, parse_opf(box[opf]))
    return out


def merged(base: Book, over: Book) -> Book:
    """What the overlay has wins; maps are joined key by key."""
    out = dict(base)
    for k in ("title", "authors", "languages", "publisher", "description", "subjects", "series", "series_index"):
        out[k] = over[k] if over.get(k) not in ("", [], None) else base[k]
    return out | {"identifiers": base["identifiers"] | over.get("identifiers", {})}


def parse_docx(content: bytes) -> Book:
    box = entries(content)
    path = find(box, "word/document.xml")
    if path is None:
        raise Refused("no document part")
    out, parts, number = _book(), [], 0
    for p in (e for e in xml_root(box[path]).iter() if _local(e.tag) == "p"):
        style = next((v for e in p.iter() if _local(e.tag) == "pStyle" for k, v in e.attrib.items() if _local(k) == "val"), "")
        runs = []
        for run in (e for e in p.iter() if _local(e.tag) == "r"):
            text = "".join({"t": e.text or "", "tab": "\t", "br": "\n"}.get(_local(e.tag), "") for e in run.iter())
            marks = {_local(e.tag) for e in run.iter()}
            text = html.escape(text, False).replace("\n", "<br/>")
            runs.append(f"<strong>{text}</strong>" if "b" in marks and text else f"<em>{text}</em>" if "i" in marks and text else text)
        inner = "".join(runs)
        if m := re.match(r"(?i)(?:heading|berschrift|Überschrift|titre)\s*([1-6])$", style):
            number += 1
            parts.append(f'<h{m[1]} id="h{number}">{inner}</h{m[1]}>')
            out["nav"].append({"label": re.sub(r"<[^>]*>", "", inner), "target": f"index.xhtml#h{number}", "depth": int(m[1]) - 1})
        elif inner.strip():
            parts.append(f"<p>{inner}</p>")
    if core := find(box, "docProps/core.xml"):
        root = xml_root(box[core])
        one = lambda name: (_texts(root, name) or [""])[0]
        out |= {"title": one("title"), "authors": [a.strip() for a in one("creator").split(";") if a.strip()], "description": one("description"), "languages": _texts(root, "language")}
    out["sections"] = [{"path": "index.xhtml", "is_html": True, "content": f"<html><body>{''.join(parts)}</body></html>"}]
    return out


def parse_odt(content: bytes) -> Book:
    box = entries(content)
    path = find(box, "content.xml")
    if path is None:
        raise Refused("no content part")
    out, parts, number = _book(), [], 0

    def inner(e: ET.Element) -> str:
        text = html.escape(e.text or "", False)
        for c in e:
            name = _local(c.tag)
            text += {"tab": "\t", "line-break": "<br/>", "s": " " * int(next((v for k, v in c.attrib.items() if _local(k) == "c"), "1"))}.get(name) or inner(c)
            text += html.escape(c.tail or "", False)
        return text

    for e in xml_root(box[path]).iter():
        if _local(e.tag) == "h":
            number += 1
            level = min(6, int(next((v for k, v in e.attrib.items() if _local(k) == "outline-level"), "1")))
            parts.append(f'<h{level} id="h{number}">{inner(e)}</h{level}>')
            out["nav"].append({"label": " ".join("".join(e.itertext()).split()), "target": f"index.xhtml#h{number}", "depth": level - 1})
        elif _local(e.tag) == "p" and inner(e).strip():
            parts.append(f"<p>{inner(e)}</p>")
    if meta := find(box, "meta.xml"):
        root = xml_root(box[meta])
        out |= {"title": (_texts(root, "title") or [""])[0], "authors": _texts(root, "initial-creator") or _texts(root, "creator"), "languages": _texts(root, "language"), "subjects": _texts(root, "keyword")}
    out["sections"] = [{"path": "index.xhtml", "is_html": True, "content": f"<html><body>{''.join(parts)}</body></html>"}]
    return out


#: Groups of RTF whose text is none of the document's (fixed values).
_RTF_SILENT = frozenset("fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr generator themedata listtable listoverridetable rsidtbl xmlnstbl fldinst object datastore latentstyles".split())
_RTF_TEXT = {"par": "\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "cell": "\t", "row": "\n"}
_RTF = re.compile(rb"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def parse_rtf(content: bytes) -> Book:
    if not content.startswith(b"{\\rtf"):
        raise Refused("no RTF head")
    page = re.search(rb"\\ansicpg(\d+)", content[:4096])
    charset = f"cp{page[1].decode()}" if page else "cp1252"
    out, stack, silent, skip, fallback, raw = [], [], False, 0, 1, bytearray()

    def flush() -> None:
        if raw:
            out.append(bytes(raw).decode(charset, "replace"))
            raw.clear()

    for m in _RTF.finditer(content):
        word, number, byte, sign, brace, plain = m.groups()
        if brace == b"{":
            flush()
            stack.append((silent, fallback))
            if len(stack) > 1000:
                raise Refused("groups too deep")
        elif brace == b"}":
            flush()
            silent, fallback = stack.pop() if stack else (False, 1)
        elif word:
            name = word.decode()
            if name in _RTF_SILENT:
                silent = True
            elif name == "uc":
                fallback = int(number or 1)
            elif name == "u" and number and not silent:
                flush()
                out.append(chr(int(number) % 65536))
                skip = fallback
            elif name in _RTF_TEXT and not silent:
                flush()
                out.append(_RTF_TEXT[name])
        elif sign == b"*":
            silent = True
        elif not silent and byte:
            if skip:
                skip -= 1
            else:
                raw += bytes.fromhex(byte.decode())
        elif not silent and sign in (b"\\", b"{", b"}", b"~", b"_"):
            raw += {b"~": b"\xa0", b"_": b"-"}.get(sign, sign)
        elif not silent and plain:
            cut = min(skip, len(plain))
            skip -= cut
            raw += plain[cut:]
    flush()
    text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    blocks = [b.strip() for b in text.split("\n") if b.strip()]
    meta = lambda name: (re.sub(rb"\\'([0-9a-f]{2})", lambda m: bytes.fromhex(m[1].decode()), m[1]).decode(charset, "replace").strip() if (m := re.search(rb"\{\\" + name + rb" ([^{}]*)\}", content)) else "")
    authors = [a.strip() for a in meta(b"author").split(";") if a.strip()]
    return _book(title=meta(b"title"), authors=authors, sections=[{"path": "index.xhtml", "is_html": True, "content": "<html><body>" + "".join(f"<p>{html.escape(b, False)}</p>" for b in blocks) + "</body></html>"}])


_IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp")


def natural(name: str) -> tuple:
    return tuple((0, int(x)) if x.isdigit() else (1, x) for x in re.findall(r"\d+|\D", name))


def parse_comic_info(content: bytes) -> dict:
    root = xml_root(content)
    one = lambda name: next((e.text.strip() for e in root if _local(e.tag) == name and e.text), "")
    people = [x.strip() for x in re.split("[,;]", one("Writer")) if x.strip()]
    return {"title": one("Title"), "series": one("Series"), "series_index": _number(one("Number")), "authors": list(dict.fromkeys(people)), "publisher": one("Publisher"), "description": one("Summary"), "languages": [x] if (x := one("LanguageISO")) else [], "is_rtl": one("Manga") == "YesAndRightToLeft"}


def parse_cbz(content: bytes) -> Book:
    box = entries(content)
    pages = [p for p in box if p.lower().endswith(_IMAGES) and not p.startswith("__MACOSX/")]
    if not pages:
        raise Refused("no images inside")
    uniform = len({p.count("/") for p in pages}) == 1
    pages.sort(key=lambda p: (natural(p),) if uniform else (natural(p.rsplit("/", 1)[-1]), natural(p)))
    out = _book()
    if info := next((p for p in box if p.rsplit("/", 1)[-1].lower() == "comicinfo.xml"), None):
        out |= {k: v for k, v in parse_comic_info(box[info]).items() if v not in ("", [], None)}
    out["sections"] = [{"path": p, "is_html": False, "content": ""} for p in pages]
    return out


def parse_cbc(content: bytes) -> Book:
    """Comics in one archive, in the order that comics.txt gives."""
    box = entries(content)
    listing = find(box, "comics.txt")
    if listing is None:
        raise Refused("no listing")
    out = _book()
    for line in decode_text(box[listing]).split("\n"):
        name, _, label = line.strip().partition(":")
        if name and (path := find(box, name)):
            pages = parse_cbz(box[path])["sections"]
            out["nav"].append({"label": label or name, "target": f"{path}/{pages[0]['path']}", "depth": 0})
            out["sections"] += [p | {"path": f"{path}/{p['path']}"} for p in pages]
    if not out["sections"]:
        raise Refused("no comics inside")
    return out


def palm_records(content: bytes) -> tuple[str, str, list[bytes]]:
    """Name, type and records of a Palm database."""
    if len(content) < 78:
        raise Refused("too short")
    name, kind, n = content[:32].split(b"\0")[0].decode("cp1252", "replace"), content[60:68].decode("latin-1").upper(), struct.unpack(">H", content[76:78])[0]
    offsets = [struct.unpack(">I", content[78 + 8 * k : 82 + 8 * k])[0] for k in range(n) if 82 + 8 * k <= len(content)]
    if not offsets or any(a > b for a, b in zip(offsets, offsets[1:])) or offsets[-1] > len(content):
        raise Refused("bad record table")
    return name, kind, [content[a:b] for a, b in zip(offsets, [*offsets[1:], len(content)])]


def inflate_palmdoc(data: bytes) -> bytes:
    """PalmDOC: literals, runs of 1 to 8 bytes, a blank with a letter, or a distance and length back."""
    out, at = bytearray(), 0
    while at < len(data):
        code, at = data[at], at + 1
        if 1 <= code <= 8:
            out += data[at : at + code]
            at += code
        elif code < 0x80:
            out.append(code)
        elif code >= 0xC0:
            out += bytes((0x20, code ^ 0x80))
        elif at < len(data):
            pair, at = (code << 8 | data[at]) & 0x3FFF, at + 1
            back = pair >> 3
            if not 0 < back <= len(out):
                raise Refused("bad distance")
            for _ in range((pair & 7) + 3):
                out.append(out[-back])
    return bytes(out)


def parse_ereader(name: str, records: list[bytes]) -> Book:
    """Deflated eReader texts; the markup becomes HTML with its chapters as navigation."""
    from .palm import render_pml

    packing, pages = struct.unpack(">H", records[0][:2])[0], struct.unpack(">H", records[0][12:14])[0]
    if packing not in (2, 10):
        raise Refused(f"packing {packing}")
    text = b"".join(inflate_palmdoc(r) if packing == 2 else zlib.decompress(r) for r in records[1:pages])
    body, titles = render_pml(text.decode("cp1252", "replace").replace("\r\n", "\n").replace("\r", "\n"))
    return _book(title=name, sections=[{"path": "index.html", "is_html": True, "content": f"<html><body>{body}</body></html>"}], nav=[{"label": t, "target": "index.html", "depth": 0} for t in titles])


def parse_palmdoc(content: bytes) -> Book:
    name, kind, records = palm_records(content)
    if kind == "PNRDPPRS":
        return parse_ereader(name, records)
    if kind != "TEXTREAD" or len(records[0]) < 16:
        raise Refused(f"Palm database {kind}")
    packing, _, _, count = struct.unpack(">HHIH", records[0][:10])
    if packing not in (1, 2):
        raise Refused(f"packing {packing}")
    text = b"".join(inflate_palmdoc(r) if packing == 2 else r for r in records[1 : 1 + count])
    return parse_txt(text) | {"title": name}


def _mobi_head(content: bytes) -> tuple[Book, list[bytes], str]:
    """The book without its text, the records and the charset."""
    name, _, records = palm_records(content)
    head = records[0]
    if len(head) < 0x84 or head[16:20] != b"MOBI":
        raise Refused("no MOBI head")
    charset = "utf-8" if struct.unpack(">I", head[28:32])[0] == 65001 else "cp1252"
    start, length = struct.unpack(">II", head[84:92]) if len(head) >= 92 else (0, 0)
    out = _book(title=head[start : start + length].decode(charset, "replace") or name)
    at = head.find(b"EXTH", 16)
    if at > 0:
        for kind, value in _exth(head[at:]):
            said = value.decode(charset, "replace")
            if kind == 100:
                out["authors"].append(said)
            elif kind in (101, 103):
                out["publisher" if kind == 101 else "description"] = said
            elif kind == 104:
                out["identifiers"]["isbn"] = said
            elif kind == 105:
                out["subjects"].append(said)
            elif kind == 503:
                out["title"] = said
            elif kind == 524:
                out["languages"].append(said)
    return out, records, charset


def mobi_metadata(content: bytes) -> Book:
    """Head and EXTH records; no text is unpacked."""
    return _mobi_head(content)[0]


def parse_mobi(content: bytes) -> Book:
    """Books of the older kind: plain, PalmDOC or dictionary-packed text, cut at the places its contents name."""
    from . import mobi6

    out, records, charset = _mobi_head(content)
    head = records[0]
    packing, _, size, count = struct.unpack(">HHIH", head[:10])
    if struct.unpack(">H", head[12:14])[0]:
        raise Refused("the book is protected")
    if packing not in (1, 2, 17480):
        raise Refused(f"packing {packing}")
    unpack = {1: bytes, 2: inflate_palmdoc}.get(packing)
    if unpack is None:
        from .palm import Dictionary

        first, n = struct.unpack(">II", head[0x70:0x78])
        unpack = Dictionary(records[first], records[first + 1 : first + n]).unpack
    flags = struct.unpack(">H", head[0xF2:0xF4])[0] if struct.unpack(">I", head[20:24])[0] >= 228 and len(head) >= 0xF4 else 0
    text = bytearray()
    for r in records[1 : 1 + count]:
        text += unpack(_without_trailers(r, flags))
    raw = bytes(text[:size])
    if len(head) >= 0x100 and struct.unpack(">I", head[0x68:0x6C])[0] == 8:
        from . import kf8

        out["sections"], out["nav"] = kf8.book(raw, records, charset)
        return out
    points = mobi6.navigation(mobi6.markup(raw.decode(charset, "replace")))
    parts = mobi6.sections(raw, [p["offset"] for p in points])
    names = [f"chapter{k + 1:05}.html" for k in range(len(parts))]
    out["sections"] = [{"path": n, "is_html": True, "content": mobi6.markup(raw[a:b].decode(charset, "replace"))} for n, (a, b) in zip(names, parts)]
    for p in points:
        at = mobi6.boundary(raw, p["offset"])
        holds = next((n for n, (a, b) in zip(names, parts) if at is not None and a <= at < b), names[0])
        out["nav"].append({"label": p["label"], "target": f"{holds}#filepos{p['offset']}", "depth": 0})
    if not points:
        out["nav"] = [x for s in out["sections"] for x in heading_nav(s["content"], s["path"])]
    return out


def _without_trailers(record: bytes, flags: int) -> bytes:
    for bit in range(15, 0, -1):
        if flags >> bit & 1 and record:
            size = shift = 0
            for byte in reversed(record[-4:]):
                size |= (byte & 0x7F) << shift
                shift += 7
                if byte & 0x80:
                    break
            record = record[: max(0, len(record) - size)]
    return record[: len(record) - (record[-1] & 3) - 1] if flags & 1 and record else record


def _exth(block: bytes) -> Iterator[tuple[int, bytes]]:
    at = 12
    for _ in range(struct.unpack(">I", block[8:12])[0]):
        if at + 8 > len(block):
            return
        kind, size = struct.unpack(">II", block[at : at + 8])
        if size < 8:
            return
        yield kind, block[at + 8 : at + size]
        at += size


def parse_opds(content: bytes) -> Book:
    """A feed as a book: its entries' titles as navigation, their links as targets."""
    if content.lstrip()[:1] == b"{":
        feed = json.loads(content)
        items = [*feed.get("navigation", []), *feed.get("publications", []), *(x for g in feed.get("groups", []) for x in [*g.get("publications", []), *g.get("navigation", [])])]
        text = lambda v: v if isinstance(v, str) else next(iter(v.values()), "") if isinstance(v, dict) else ""
        nav = [{"label": text(x.get("title") or x.get("metadata", {}).get("title", "")), "target": x.get("href") or next((n.get("href", "") for n in x.get("links", [])), ""), "depth": 0} for x in items]
        return _book(title=text(feed.get("metadata", {}).get("title", "")), nav=nav)
    root = xml_root(content)
    if _local(root.tag) != "feed":
        raise Refused("no feed")
    one = lambda e, name: next((" ".join("".join(x.itertext()).split()) for x in e if _local(x.tag) == name), "")
    nav = [{"label": one(e, "title"), "target": next((x.attrib.get("href", "") for x in e if _local(x.tag) == "link"), ""), "depth": 0} for e in root if _local(e.tag) == "entry"]
    return _book(title=one(root, "title"), authors=[one(e, "name") for e in root if _local(e.tag) == "author"], nav=nav)


def sqlite_rows(content: bytes, table: str) -> list[dict]:
    """All rows of a table of a database file, read-only."""
    if not re.fullmatch(r"\w+", table):
        raise Refused("bad table name")
    with tempfile.NamedTemporaryFile(suffix=".db", delete=False) as f:
        f.write(content)
    try:
        db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
        try:
            db.row_factory = sqlite3.Row
            return [dict(r) for r in db.execute(f'SELECT rowid AS _rowid, * FROM "{table}" ORDER BY rowid')]
        finally:
            db.close()
    except sqlite3.DatabaseError as e:
        raise Refused(f"bad database: {e}") from e
    finally:
        os.unlink(f.name)


def parse_tiff(content: bytes) -> Book:
    """Metadata only: pages of a TIFF hold no text."""
    from .images import tiff_tags

    tags = tiff_tags(content)
    return _book(title=tags.get("title", ""), description=tags.get("description", ""), authors=[tags["author"]] if tags.get("author") else [])


def _pdf(content: bytes) -> Book:
    from .pdf import parse_pdf

    return parse_pdf(content)


PARSERS: dict[str, Callable[[bytes], Book]] = {
    "epub": parse_epub, "fb2": parse_fb2, "fbz": parse_fbz, "txt": parse_txt, "txtz": parse_txtz, "markdown": parse_markdown, "html": parse_html, "htmlz": parse_htmlz, "docx": parse_docx, "odt": parse_odt,
    "rtf": parse_rtf, "cbz": parse_cbz, "cbc": parse_cbc, "pdb": parse_palmdoc, "mobi": parse_mobi, "azw3": parse_mobi, "pdf": _pdf, "tiff": parse_tiff, "opds": parse_opds,
}
BOOK = """book_id string, format string, error string, title string, authors array<string>, languages array<string>, publisher string, description string, subjects array<string>,
series string, series_index double, identifiers map<string,string>, sections array<struct<path: string, is_html: boolean, content: string>>, nav array<struct<label: string, target: string, depth: int>>, cover string"""


def zip_kind(content: bytes) -> str:
    """What a zip holds, by its entries' names, in order of precedence."""
    import io
    import zipfile

    try:
        names = [n.lower() for n in zipfile.ZipFile(io.BytesIO(content)).namelist()]
    except zipfile.BadZipFile:
        return "zip"
    rules = (("epub", r"meta-inf/container\.xml"), ("cbc", r"comics\.txt"), ("fbz", r".*\.fb2"), ("docx", r"word/document\.xml"), ("odt", r"content\.xml"), ("htmlz", r"[^/]+\.x?html?"), ("txtz", r"[^/]+\.(?:txt|md|markdown)"), ("cbz", r".*\.(?:jpe?g|png|gif|webp|bmp)"))
    return next((kind for kind, pattern in rules if any(re.fullmatch(pattern, n) for n in names)), "zip")


def _tried(content: bytes, kind: str | None, parser: Callable[[bytes], Book] | None) -> tuple[str | None, Book | None, str | None]:
    if parser is None:
        return kind, None, f"unsupported: {kind}"
    try:
        return kind, parser(content), None
    except Refused as e:
        return kind, None, str(e)
    except (ValueError, zlib.error, KeyError, IndexError, AttributeError, TypeError, struct.error, RecursionError) as e:
        return kind, None, f"malformed: {type(e).__name__}"


def parse(content: bytes, kind: str | None) -> tuple[str | None, Book | None, str | None]:
    """(format, book, error): one of the last two."""
    kind = zip_kind(content) if kind == "zip" else kind
    return _tried(content, kind, PARSERS.get(kind))


def _read(files: DataFrame, path: str, content: str, reader: Callable, schema: str) -> DataFrame:
    from .detect import detected_format, refine_mobi

    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    found = detected_format(F.col(content))
    kind = F.when(suffix.isin("md", "markdown"), "markdown").when(found == "mobi", refine_mobi(F.col(content))).otherwise(found)
    fields = [x.strip().split(" ")[0] for x in re.split(r",\s*(?![^<]*>)", schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for book_id, data, said in frame.itertuples(index=False):
                kind, book, error = reader(bytes(data), said) if data is not None else (None, None, "no content")
                rows.append({"book_id": book_id, "format": kind, "error": error} | {k: (book or {}).get(k) for k in fields[3:]})
            yield pd.DataFrame(rows, columns=fields)

    ship(files.sparkSession)
    return files.select(F.col(path).alias("book_id"), content, kind.alias("kind")).mapInPandas(run, schema)


def read_books(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A book for each row of files (as ``spark.read.format('binaryFile')`` gives them); what cannot be read says so in error."""
    return _read(files, path, content, parse, BOOK)


#: Readers that leave texts alone; other formats are parsed as a whole.
METADATA = {"epub": epub_metadata, "fb2": fb2_metadata, "fbz": fbz_metadata, "mobi": mobi_metadata, "azw3": mobi_metadata}
META = "book_id string, format string, error string, title string, authors array<string>, languages array<string>, publisher string, description string, subjects array<string>, series string, series_index double, identifiers map<string,string>, cover string"


def parse_metadata(content: bytes, kind: str | None) -> tuple[str | None, Book | None, str | None]:
    """(format, book without texts, error): one of the last two."""
    kind = zip_kind(content) if kind == "zip" else kind
    return _tried(content, kind, METADATA.get(kind) or PARSERS.get(kind))


def read_metadata(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The metadata of each row of files, without texts: the projection reaches into the parsers."""
    return _read(files, path, content, parse_metadata, META)


def sections_of(books: DataFrame) -> DataFrame:
    """book_id, section_index, path, is_html, html: the reading order, repeats kept."""
    return books.select("book_id", F.posexplode("sections").alias("section_index", "s")).select("book_id", "section_index", "s.path", "s.is_html", F.col("s.content").alias("html"))


def with_sidecars(books: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Metadata of ``<stem>.opf``, else ``metadata.opf`` of the folder, over each book's own.

    sidecars: path, title, authors.
    """
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    own = sidecars.select(stem(F.col("path")).alias("_stem"), F.col("title").alias("_t1"), F.col("authors").alias("_a1"))
    common = sidecars.where(F.col("path").rlike(r"(?:^|/)metadata\.opf$")).select(folder(F.col("path")).alias("_folder"), F.col("title").alias("_t2"), F.col("authors").alias("_a2"))
    out = books.withColumn("_stem", stem(F.col("book_id"))).withColumn("_folder", folder(F.col("book_id"))).join(own, "_stem", "left").join(common, "_folder", "left")
    filled = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit(""))
    list_ = lambda *cs: F.coalesce(*[F.when(F.size(c) > 0, F.col(c)) for c in cs], F.array().cast("array<string>"))
    out = out.withColumn("title", F.when(F.col("_t1").isNotNull(), filled("_t1", "title")).otherwise(filled("_t2", "title")))
    out = out.withColumn("authors", F.when(F.col("_t1").isNotNull(), list_("_a1", "authors")).otherwise(list_("_a2", "authors")))
    return with_file_names(out.drop("_stem", "_folder", "_t1", "_a1", "_t2", "_a2"))


def with_file_names(books: DataFrame, path: str = "book_id") -> DataFrame:
    """What a book lacks of title and authors, from a file name like ``Title - Author``: the title may hold dashes, the author may not."""
    name = F.trim(F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^./]*$", ""))
    pattern = r"^(.+)\s+-\s+([^-]+)$"
    title, author = (F.trim(F.regexp_extract(name, pattern, k)) for k in (1, 2))
    whole = (title != "") & (author != "")
    lacks = F.coalesce(F.size("authors"), F.lit(0)) <= 0
    return books.withColumns({"title": F.when((F.coalesce("title", F.lit("")) == "") & whole, title).otherwise(F.col("title")), "authors": F.when(lacks & whole, F.array(author)).otherwise(F.col("authors"))})
