"""Fragment identifiers against documents: a place in a section's text as a path of its markup, and back.

A document is indexed once into elements with the text offsets they begin and end
at, and the chunks of text between an element's children; every question is then a
walk down the steps.  Offsets in text are code points of the body without scripts
and styles; offsets in identifiers are UTF-16 units, as their format has it.

Sections that are no XML are read leniently (elements close with their parents);
trees that browsers would build of badly nested markup are not rebuilt.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.locators import Cfi, Path, Step, cfi_section, try_cfi
from quire.functions.text import decode_entity, document_text_of
from quire.shipping import arrow_udf

_PREDEFINED = ("lt", "gt", "amp", "quot", "apos")
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7})|([a-zA-Z][a-zA-Z0-9]{0,31}));")
_BARE = re.compile(r"&(?!(?:lt|gt|amp|quot|apos);)")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = ("script", "style")
EXCERPT = 24
SLACK = 64


def units(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def _points(text: str, offset: int) -> int | None:
    """Code points that ``offset`` UTF-16 units are; None past the end or inside a pair."""
    n = 0
    for k, c in enumerate(text):
        if n >= offset:
            return k if n == offset else None
        n += 2 if c > "￿" else 1
    return len(text) if n == offset else None


class Element:
    __slots__ = ("name", "id", "anchor", "children", "chunks", "start", "end", "starts", "indexed")

    def __init__(self, name: str, attrs: dict):
        low = {k.rsplit("}", 1)[-1].lower(): v for k, v in attrs.items()}
        self.name, self.id, self.anchor = name.rsplit("}", 1)[-1].lower(), low.get("id"), low.get("name")
        self.children: list[Element] = []
        self.chunks = [""]
        self.start = self.end = 0
        self.starts: list[int] = []
        self.indexed = False


def _from_xml(e: ET.Element) -> Element:
    """Without recursion, so that depth is no limit."""
    root = Element(e.tag, e.attrib)
    open_ = [(e, root)]
    while open_:
        source, out = open_.pop()
        out.chunks[0] = source.text or ""
        for child in source:
            if isinstance(child.tag, str):
                node = Element(child.tag, child.attrib)
                out.children.append(node)
                out.chunks.append(child.tail or "")
                open_.append((child, node))
            else:  # a comment or instruction: the text around it is one chunk
                out.chunks[-1] += child.tail or ""
    return root


class _Lenient(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag == "p" and self.stack[-1].name == "p":
            self.stack.pop()
        if tag == "body":
            del self.stack[1:]
        node = Element(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        self.stack[-1].chunks.append("")
        if tag not in _VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and len(self.stack) > 1:
            self.stack.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.stack[-1].chunks[-1] += data


def _decoded(m: re.Match) -> str:
    if m[3] in _PREDEFINED:
        return m[0]
    said = decode_entity(m)
    return said if m[3] or said == "�" else m[0]


class CfiDocument:
    """The elements of a section and the text of its body."""

    def __init__(self, xhtml: str):
        source = _ENTITY.sub(_decoded, xhtml)
        try:
            root = _from_xml(ET.fromstring(source))
            if root.name != "html":
                raise ET.ParseError("no html")
        except (ET.ParseError, ValueError):
            reader = _Lenient()
            reader.feed(_BARE.sub("&amp;", source))
            reader.close()
            root = reader.root
        self.root, self.body = root, next((c for c in root.children if c.name == "body"), None)
        parts: list[str] = []
        self.nodes: list[tuple[int, int, tuple[Step, ...], int]] = []  # start, end, steps of the element around, slot
        if self.body is not None:
            self._index(self.body, parts)
        self.text = "".join(parts)

    def _index(self, body: Element, parts: list[str]) -> None:
        at, place = 0, self.root.children.index(body)
        todo: list[tuple[Element, tuple[Step, ...], int]] = [(body, (Step((place + 1) * 2, None, body.id),), 0)]
        while todo:
            e, steps, slot = todo.pop()
            if slot == 0:
                e.start, e.indexed = at, True
            if slot:
                e.children[slot - 1].end = at
            e.starts.append(at)
            if e.chunks[slot]:
                self.nodes.append((at, at + len(e.chunks[slot]), steps, slot))
                parts.append(e.chunks[slot])
                at += len(e.chunks[slot])
            if slot < len(e.children):
                child = e.children[slot]
                todo.append((e, steps, slot + 1))
                if child.name in SILENT:
                    child.start = child.end = at
                else:
                    todo.append((child, (*steps, Step((slot + 1) * 2, None, child.id)), 0))
            else:
                e.end = at

    def steps_at(self, offset: int) -> tuple[Step, ...]:
        """The path to an offset of the text; at the border of two chunks, of the one that begins there."""
        if not 0 <= offset <= len(self.text):
            raise ValueError("outside of the text")
        if not self.nodes:
            return () if self.body is None else (Step((self.root.children.index(self.body) + 1) * 2, None, self.body.id),)
        low, high = 0, len(self.nodes) - 1
        while low < high:  # the first chunk that ends after the offset, else the last
            mid = (low + high) // 2
            low, high = (low, mid) if self.nodes[mid][1] > offset else (mid + 1, high)
        start, _, steps, slot = self.nodes[low]
        return (*steps, Step(slot * 2 + 1, units(self.text[start:offset])))

    def offset_of(self, steps: tuple[Step, ...]) -> int | None:
        """The text offset that a path means; an element means its beginning."""
        now = self.root
        for k, step in enumerate(steps):
            last = k == len(steps) - 1
            if step.index % 2:
                slot = step.index // 2
                if not last or not now.indexed or slot >= len(now.chunks):
                    return None
                inside = _points(now.chunks[slot], step.offset or 0)
                return None if inside is None else now.starts[slot] + inside
            n = step.index // 2
            child = now.children[n - 1] if 1 <= n <= len(now.children) else None
            if step.assertion is not None and (child is None or child.id != step.assertion):
                child = next((c for c in now.children if c.id == step.assertion), None)
            if child is None:
                if last and now.indexed and n in (0, len(now.children) + 1):
                    return now.start if n == 0 else now.end
                return None
            now = child
        return now.start if now.indexed or now is self.root else None

    def anchor(self, name: str) -> tuple[int, str] | None:
        """Where the element with that id (or the a with that name) begins, and its first text."""
        found, todo = None, [self.body] if self.body is not None else []
        while todo:
            e = todo.pop()
            if e.id == name:
                found = e
                break
            if found is None and e.name == "a" and e.anchor == name:
                found = e
            todo += reversed(e.children)
        if found is None:
            return None
        node = next((n for n in self.nodes if n[1] > found.start), None)
        return found.start, self.text[max(node[0], found.start) : node[1]][:SLACK] if node else ""


@lru_cache(maxsize=64)
def document(xhtml: str) -> CfiDocument:
    return CfiDocument(xhtml)


def _range(document: CfiDocument, spine: Path, start: int, end: int) -> Cfi:
    a, b = document.steps_at(start), document.steps_at(end)
    shared = 0
    while shared < min(len(a), len(b)) - 1 and a[shared] == b[shared]:
        shared += 1
    return Cfi((*spine, a[:shared]) if shared else spine, (a[shared:],), (b[shared:],))


def cfi_at(html: str | None, start: int | None, end: int | None = None, section: int | None = None) -> str | None:
    """The identifier of a place or range in a section's text, alone or in its book; null for what is outside."""
    if html is None or start is None or end is not None and end < start:
        return None
    doc, spine = document(html), () if section is None else ((Step(6), Step((section + 1) * 2)),)
    try:
        if end is None or end == start:
            steps = doc.steps_at(start)
            return str(Cfi((*spine, steps))) if steps else None
        return str(_range(doc, spine, start, end))
    except ValueError:
        return None


def place_of(html: str | None, text: str | None) -> tuple[int, int | None, str] | None:
    """(start, end or None, excerpt) that an identifier means in a section; its last steps are the section's own."""
    cfi = try_cfi(text)
    if html is None or cfi is None or len(cfi.start) > 2:
        return None
    doc, base = document(html), cfi.start[-1]
    if cfi.low is None and cfi.high is None:
        at = doc.offset_of(base)
        return None if at is None else (at, None, doc.text[max(0, at - EXCERPT) : at + EXCERPT])
    if len(cfi.low) > 1 or len(cfi.high) > 1:
        return None
    a, b = (doc.offset_of((*base, *(p[0] if p else ()))) for p in (cfi.low, cfi.high))
    return None if a is None or b is None or b < a else (a, b, doc.text[max(0, a - EXCERPT) : b + EXCERPT])


def anchor_place(html: str | None, name: str | None) -> int | None:
    """Offset of an anchor in the document text; where markup shifts it, its first text is looked for near by."""
    found = document(html).anchor(name) if html is not None and name else None
    if found is None:
        return None
    at, said = found
    canonical = document_text_of(html)
    if not said or canonical.startswith(said, at):
        return at
    near = canonical.find(said, max(0, at - SLACK))
    return near if near >= 0 else None


def cfi_for(html: Column, start: Column, end: Column | None = None, section: Column | None = None) -> Column:
    """``cfi_at`` as a column."""
    def run(htmls: pa.Array, starts: pa.Array, ends: pa.Array, sections: pa.Array) -> pa.Array:
        return pa.array([cfi_at(*row) for row in zip(*(c.to_pylist() for c in (htmls, starts, ends, sections)))], pa.string())

    none = F.lit(None).cast("int")
    return arrow_udf(run, "string")(html, start, none if end is None else end, none if section is None else section)


PLACE = "struct<start: int, end: int, excerpt: string>"


def cfi_place(html: Column, cfi: Column) -> Column:
    """``place_of`` as a struct column; null where the identifier means no place."""
    def run(htmls: pa.Array, cfis: pa.Array) -> pa.Array:
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("excerpt", pa.string())])
        found = (place_of(h, c) for h, c in zip(htmls.to_pylist(), cfis.to_pylist()))
        return pa.array([None if p is None else dict(zip(("start", "end", "excerpt"), p)) for p in found], kind)

    return arrow_udf(run, PLACE)(html, cfi)


def anchor_offset(html: Column, name: Column) -> Column:
    def run(htmls: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([anchor_place(h, n) for h, n in zip(htmls.to_pylist(), names.to_pylist())], pa.int32())

    return arrow_udf(run, "int")(html, name)


def resolve_cfis(cfis: DataFrame, sections: DataFrame, book: str = "book_id", order: str = "section_index", html: str = "html", cfi: str = "cfi") -> DataFrame:
    """cfis with section, start, end and excerpt; identifiers of no section or no place have nulls.

    The section is read from the identifier by a native pattern, so sections meet theirs by an equi-join.
    """
    wanted = cfis.withColumn("_s", cfi_section(F.col(cfi)))
    met = wanted.join(sections.select(F.col(book), F.col(order).alias("_s"), F.col(html).alias("_html")), [book, "_s"], "left")
    met = met.withColumn("_p", cfi_place(F.col("_html"), F.col(cfi)))
    return met.select(*cfis.columns, F.when(F.col("_p").isNotNull(), F.col("_s")).alias("section"), F.col("_p.start").alias("start"), F.col("_p.end").alias("end"), F.col("_p.excerpt").alias("excerpt"))
