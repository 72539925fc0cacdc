"""Locators: fragment identifiers of books (CFI), web annotation selectors and reader positions."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.shipping import arrow_udf

_STEP = re.compile(r"/(\d+)(?::(\d+))?(?:\[((?:[^\^\[\](),;]|\^.)*)(?:;s=([ab]))?\])?")
_ESCAPED = re.compile(r"[\^\[\](),;~@!]")


@dataclass(frozen=True)
class Step:
    index: int
    offset: int | None = None
    assertion: str | None = None
    side: str | None = None

    def __str__(self) -> str:
        out = f"/{self.index}" + (f":{self.offset}" if self.offset is not None else "")
        if self.assertion is None and self.side is None:
            return out
        return f"{out}[{_ESCAPED.sub(lambda m: '^' + m[0], self.assertion or '')}{f';s={self.side}' if self.side else ''}]"


Path = tuple[tuple[Step, ...], ...]


@dataclass(frozen=True)
class Cfi:
    """A path of steps, cut by indirections; a range has two more paths below it."""

    start: Path
    low: Path | None = None
    high: Path | None = None

    def __str__(self) -> str:
        text = lambda p: "!".join("".join(map(str, part)) for part in p)
        return f"epubcfi({','.join(text(p) for p in (self.start, self.low, self.high) if p is not None)})"

    def events(self, more: Path | None) -> tuple:
        """What orders a place: steps, offsets before steps, indirections after."""
        parts = [list(p) for p in self.start]
        if more:
            parts[-1] += more[0]
            parts += [list(p) for p in more[1:]]
        out = []
        for k, part in enumerate(parts):
            out += [(3, 0)] if k else []
            for n, step in enumerate(part):
                out.append((1, step.index))
                last = k == len(parts) - 1 and n == len(part) - 1
                if step.offset is not None or last and step.index % 2:
                    out.append((0, step.offset or 0))
        return tuple(out)

    @property
    def key(self) -> tuple:
        return self.events(self.low), self.events(self.high)


def _path(text: str, empty: bool = False) -> Path:
    if not text and empty:
        return ()
    out = []
    for part in re.split(r"!(?=/)", text):
        steps, at = [], 0
        while m := _STEP.match(part, at):
            said = None if m[3] is None or not m[3] and m[4] else re.sub(r"\^(.)", r"\1", m[3])
            steps.append(Step(int(m[1]), int(m[2]) if m[2] else None, said, m[4]))
            at = m.end()
        if not steps or at != len(part):
            raise ValueError(f"bad path {text!r}")
        if any(s.offset is not None or s.side for s in steps[:-1]):
            raise ValueError("an offset ends its path")
        out.append(tuple(steps))
    if any(p[-1].offset is not None or p[-1].side for p in out[:-1]):
        raise ValueError("an offset ends its path")
    return tuple(out)


def parse_cfi(text: str) -> Cfi:
    if not text.startswith("epubcfi(") or not text.endswith(")"):
        raise ValueError("no epubcfi(…)")
    parts = re.split(r",(?=(?:[^\[\]^]|\^.|\[(?:[^\]^]|\^.)*\])*$)", text[8:-1])
    if len(parts) not in (1, 3):
        raise ValueError("a range has three paths")
    start = _path(parts[0])
    if len(parts) == 1:
        return Cfi(start)
    low, high = _path(parts[1], empty=True), _path(parts[2])
    if start[-1][-1].offset is not None or any(p[-1][-1].side for p in (start, low, high) if p):
        raise ValueError("a range's parent has no offset, its paths no side")
    return Cfi(start, low, high)


def try_cfi(text: str | None) -> Cfi | None:
    try:
        return parse_cfi(text) if text else None
    except ValueError:
        return None


def compare_cfi(a: Cfi, b: Cfi) -> int:
    return (a.key > b.key) - (a.key < b.key)


cfi_order = cmp_to_key(compare_cfi)


def section_cfi(section: Column, path: str = "/4/2/1") -> Column:
    """The place of a section's content in its book: package, spine item, path."""
    return F.concat(F.lit("epubcfi(/6/"), (section + 1) * 2, F.lit(f"!{path})"))


def cfi_section(cfi: Column) -> Column:
    """The section a place is in; null for what names no spine item."""
    step = F.regexp_extract(cfi, r"^epubcfi\(/6/(\d+)(?:\[[^\]]*\])?!", 1).try_cast("int")
    return F.when((step > 0) & (step % 2 == 0), (step / 2).cast("int") - 1)


def normalized_cfi(cfi: Column) -> Column:
    """The canonical spelling; null for what is none."""
    def run(values: pa.Array) -> pa.Array:
        return pa.array([str(c) if (c := try_cfi(v)) else None for v in values.to_pylist()], pa.string())

    return arrow_udf(run, "string")(cfi)


def cfi_sort_key(cfi: Column) -> Column:
    """array of (type, value) pairs that order places as compare_cfi does for single places."""
    def run(values: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("type", pa.int32()), ("value", pa.int32())]))
        return pa.array([[{"type": a, "value": b} for a, b in c.key[0]] if (c := try_cfi(v)) else None for v in values.to_pylist()], kind)

    return arrow_udf(run, "array<struct<type: int, value: int>>")(cfi)


QUOTE_SELECTOR = "type string, exact string, prefix string, suffix string"
POSITION_SELECTOR = "type string, start int, `end` int"


def quote_selector(exact: Column, before: Column, after: Column) -> Column:
    return F.to_json(F.struct(F.lit("TextQuoteSelector").alias("type"), exact.alias("exact"), before.alias("prefix"), after.alias("suffix")))


def position_selector(start: Column, end: Column) -> Column:
    return F.to_json(F.struct(F.lit("TextPositionSelector").alias("type"), start.alias("start"), end.alias("end")))


def from_position_selector(selector: Column) -> Column:
    """struct<start, end>; null for another type or a range that is none."""
    s = F.from_json(selector, POSITION_SELECTOR)
    return F.when((s["type"] == "TextPositionSelector") & (s["start"] >= 0) & (s["end"] >= s["start"]), F.struct(s["start"].alias("start"), s["end"].alias("end")))


SELECTORS = ("TextQuoteSelector", "TextPositionSelector", "FragmentSelector")


def selector_support(annotation: Column) -> Column:
    """struct<supported, unsupported>: the selector types of an annotation's target."""
    def run(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            try:
                target = (json.loads(v) if v else {}).get("target", {})
                found = target.get("selector", []) if isinstance(target, dict) else []
            except (ValueError, AttributeError):
                found = []
            types = [s.get("type", "") for s in (found if isinstance(found, list) else [found]) if isinstance(s, dict)]
            out.append({"supported": [t for t in types if t in SELECTORS], "unsupported": [t for t in types if t not in SELECTORS]})
        return pa.array(out, pa.struct([("supported", pa.list_(pa.string())), ("unsupported", pa.list_(pa.string()))]))

    return arrow_udf(run, "struct<supported: array<string>, unsupported: array<string>>")(annotation)


def u16_from_code_points(text: Column, at: Column) -> Column:
    """UTF-16 offset of a code point offset; null outside of the text."""
    return F.when((at >= 0) & (at <= F.length(text)), (F.octet_length(F.encode(F.left(text, at), "UTF-16LE")) / 2).cast("int"))


def code_points_from_u16(text: Column, at: Column) -> Column:
    """Code point offset of a UTF-16 offset; null outside of the text and between the halves of a pair."""
    def run(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for t, k in zip(texts.to_pylist(), places.to_pylist()):
            raw = (t or "").encode("utf-16-le")
            good = t is not None and k is not None and 0 <= 2 * k <= len(raw)
            pair = good and 2 * k < len(raw) and 0xDC <= raw[2 * k + 1] <= 0xDF
            out.append(len(raw[: 2 * k].decode("utf-16-le")) if good and not pair else None)
        return pa.array(out, pa.int32())

    return arrow_udf(run, "int")(text, at)


#: Extension -> media type (fixed values).
MEDIA_TYPES = {"xhtml": "application/xhtml+xml", "html": "text/html", "htm": "text/html", "svg": "image/svg+xml", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "css": "text/css", "pdf": "application/pdf", "txt": "text/plain", "mp3": "audio/mpeg", "mp4": "video/mp4", "ncx": "application/x-dtbncx+xml"}


def media_type(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.try_element_at(known, F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)))


def reader_locator(href: Column, progression: Column, position: Column, total: Column) -> Column:
    """A reader's locator as JSON; numbers out of range are left out."""
    inside = lambda c: F.when(c.between(0, 1), c)
    places = F.struct(inside(progression).alias("progression"), F.when(position >= 1, position).alias("position"), inside(total).alias("totalProgression"))
    return F.to_json(F.struct(href.alias("href"), media_type(href).alias("type"), places.alias("locations")))


LOCATOR = "kind string, section int, start int, `end` int, cfi string, page int, total int, v int"


def locator_json(locator: Column) -> Column:
    return F.to_json(locator)


def locator_of(text: Column) -> Column:
    """A locator of kind text, cfi or page from JSON; null if it is malformed."""
    x = F.from_json(text, LOCATOR)
    good = ((x["kind"] == "text") & (x["section"] >= 0) & (x["start"] >= 0) & (x["end"] >= x["start"])) | ((x["kind"] == "cfi") & x["cfi"].startswith("epubcfi(")) | ((x["kind"] == "page") & (x["page"] >= 0) & (x["page"] < x["total"]))
    return F.when((x["v"] == 1) & good, x)


def expand_template(template: str, values: dict[str, str]) -> str:
    """``{name}`` and ``{?a,b}`` of a URI template; other expressions stay."""
    from urllib.parse import quote

    def one(m: re.Match) -> str:
        names = m[2].split(",")
        if m[1]:
            pairs = [f"{n}={quote(values[n], safe='')}" for n in names if n in values]
            return "?" + "&".join(pairs) if pairs else ""
        return quote(values.get(m[2], ""), safe="") if len(names) == 1 else m[0]

    return re.sub(r"\{(\?)?([A-Za-z0-9_.]+(?:,[A-Za-z0-9_.]+)*)\}", one, template)
