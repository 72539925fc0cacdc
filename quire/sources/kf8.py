"""KF8 books (AZW3): index records, parts put together of skeletons and fragments, navigation.

The text of such a book is one stream: skeletons of pages, each followed by the
fragments that belong into it.  Three indices say how it is cut: skeletons (place,
length, number of fragments), fragments (place to insert at, length) and the
navigation (label, level, fragment and offset in it).
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from .archive import Refused

NONE = 0xFFFFFFFF
#: Places in the head of a book's first record, and tags of its indices (fixed values of the format).
VERSION, FLOWS, FLOW_COUNT, NAVIGATION, FRAGMENTS, SKELETONS = 0x68, 0xC0, 0xC4, 0xF4, 0xF8, 0xFC
SKELETON_COUNT, SKELETON_PLACE, FRAGMENT_PLACE = 1, 6, 6
LABEL, LEVEL, TARGET = 3, 4, 6
MAX_ENTRIES = 200_000


def number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, the last byte marked, and where it ends."""
    value = 0
    for k in range(at, min(at + 5, len(data))):
        value = value << 7 | data[k] & 0x7F
        if data[k] & 0x80:
            return value, k + 1
    raise Refused("bad number")


@dataclass
class Entry:
    name: bytes
    tags: dict[int, list[int]] = field(default_factory=dict)


def _u32(data: bytes, at: int) -> int:
    if at + 4 > len(data):
        raise Refused("a record is cut short")
    return struct.unpack(">I", data[at : at + 4])[0]


def _layout(head: bytes) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Control bytes of an entry, and (tag, values, mask, ends the byte) in order."""
    at = _u32(head, 4)
    if head[at : at + 4] != b"TAGX":
        raise Refused("an index has no tags")
    end, control = at + _u32(head, at + 4), _u32(head, at + 8)
    return control, [tuple(head[k : k + 4]) for k in range(at + 12, min(end, len(head) - 3), 4)]


def _tags(data: bytes, at: int, control: int, layout: list[tuple[int, int, int, int]]) -> dict[int, list[int]]:
    """The values of each tag of an entry whose control bytes stand at ``at``."""
    flags, at = data[at : at + control], at + control
    wanted: list[tuple[int, int, int | None, int | None]] = []
    byte = 0
    for tag, values, mask, ends in layout:
        if ends:
            byte += 1
            continue
        held = (flags[byte] if byte < len(flags) else 0) & mask
        if not held:
            continue
        shift = (mask & -mask).bit_length() - 1
        if held == mask and mask.bit_count() > 1:  # the size of the values in bytes follows
            size, at = number(data, at)
            wanted.append((tag, values, None, size))
        else:
            wanted.append((tag, values, held >> shift, None))
    out: dict[int, list[int]] = {}
    for tag, values, count, size in wanted:
        own = out.setdefault(tag, [])
        if size is None:
            for _ in range(count * values):
                value, at = number(data, at)
                own.append(value)
        else:
            end = at + size
            while at < end:
                value, at = number(data, at)
                own.append(value)
    return out


def read_index(records: list[bytes], first: int) -> tuple[list[Entry], dict[int, bytes]]:
    """The entries of an index, and its texts by offset; the index begins at record ``first``."""
    if not 0 <= first < len(records) or records[first][:4] != b"INDX":
        raise Refused("no index record")
    head = records[first]
    count, texts = _u32(head, 24), _u32(head, 52)
    control, layout = _layout(head)
    out: list[Entry] = []
    for data in records[first + 1 : first + 1 + count]:
        if data[:4] != b"INDX":
            raise Refused("no index record")
        table, n = _u32(data, 20), _u32(data, 24)
        if data[table : table + 4] != b"IDXT" or len(out) + n > MAX_ENTRIES:
            raise Refused("bad index table")
        for k in range(n):
            (at,) = struct.unpack(">H", data[table + 4 + 2 * k : table + 6 + 2 * k])
            size = data[at]
            out.append(Entry(data[at + 1 : at + 1 + size], _tags(data, at + 1 + size, control, layout)))
    labels: dict[int, bytes] = {}
    for number_, data in enumerate(records[first + 1 + count : first + 1 + count + texts]):
        at = 0
        while at < len(data) and data[at]:
            size, begin = number(data, at)
            labels[number_ * 0x10000 + at] = data[begin : begin + size]
            at = begin + size
    return out, labels


def parts_of(raw: bytes, skeletons: list[Entry], fragments: list[Entry]) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The pages of a book, and for each fragment (page, place in the assembled page where it was put)."""
    pages: list[bytes] = []
    places: list[tuple[int, int]] = []
    used = 0
    for page, entry in enumerate(skeletons):
        (count, *_), (start, length, *_) = entry.tags.get(SKELETON_COUNT, [0]), entry.tags.get(SKELETON_PLACE, [0, 0])
        body, at = bytearray(raw[start : start + length]), start + length
        for piece in fragments[used : used + count]:
            size = piece.tags.get(FRAGMENT_PLACE, [0, 0])[1]
            try:
                into = int(piece.name) - start
            except ValueError:
                raise Refused("a fragment has no place") from None
            if not 0 <= into <= len(body):
                raise Refused("a fragment lies outside of its page")
            body[into:into] = raw[at : at + size]
            places.append((page, into))
            at += size
        used += count
        pages.append(bytes(body))
    return pages, places


_ID = re.compile(rb"<[^>]*?\s(?:id|name)\s*=\s*[\"']([^\"']+)[\"'][^>]*>")
_KINDLE = re.compile(r"kindle:pos:fid:([0-9A-V]{4}):off:([0-9A-V]{10})")


def anchor_at(page: bytes, place: int) -> str:
    """The id of the element that begins at a place of a page or, failing that, of the last one before it."""
    last = ""
    for m in _ID.finditer(page):
        if m.start() > place and last:
            break
        last = m[1].decode("utf-8", "replace")
        if m.start() >= place:
            break
    return last


def flows_of(raw: bytes, records: list[bytes], head: bytes) -> list[bytes]:
    """The text and the flows of style and drawings behind it."""
    at, n = _u32(head, FLOWS), _u32(head, FLOW_COUNT)
    if at == NONE or n <= 1 or at >= len(records) or records[at][:4] != b"FDST":
        return [raw]
    spans = [struct.unpack(">II", records[at][12 + 8 * k : 20 + 8 * k]) for k in range(n) if 20 + 8 * k <= len(records[at])]
    return [raw[a:b] for a, b in spans] or [raw]


def _base32(text: str) -> int:
    return int(text, 32)


def book(raw: bytes, records: list[bytes], charset: str) -> tuple[list[dict], list[dict]]:
    """(sections, nav) of a book whose unpacked text is ``raw``; links between its places become paths and ids."""
    head = records[0]
    text = flows_of(raw, records, head)[0]
    index = lambda at: read_index(records, _u32(head, at)) if _u32(head, at) != NONE else ([], {})
    (skeletons, _), (fragments, _), (points, labels) = index(SKELETONS), index(FRAGMENTS), index(NAVIGATION)
    pages, places = parts_of(text, skeletons, fragments) if skeletons else ([text], [])
    names = [f"part{k:04}.xhtml" for k in range(len(pages))]

    def target(fragment: int, offset: int) -> str | None:
        if not 0 <= fragment < len(places):
            return None
        page, into = places[fragment]
        anchor = anchor_at(pages[page], into + offset)
        return names[page] + (f"#{anchor}" if anchor else "")

    linked = lambda m: target(_base32(m[1]), _base32(m[2])) or m[0]
    sections = [{"path": n, "is_html": True, "content": _KINDLE.sub(linked, p.decode(charset, "replace"))} for n, p in zip(names, pages)]
    nav = []
    for e in points:
        where = e.tags.get(TARGET, [])
        label = labels.get(e.tags.get(LABEL, [-1])[0], b"").decode(charset, "replace")
        nav.append({"label": label, "target": (target(*where[:2]) if len(where) > 1 else None) or names[0], "depth": e.tags.get(LEVEL, [0])[0]})
    return sections, nav
