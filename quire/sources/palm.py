"""Dictionary compression of MOBI texts, and eReader's markup."""

from __future__ import annotations

import html
import re
import struct

from .archive import Refused


class Dictionary:
    """HUFF and CDIC records: codes of up to 32 bits name phrases, which may be packed themselves."""

    def __init__(self, huff: bytes, phrases: list[bytes]):
        if huff[:4] != b"HUFF" or any(p[:4] != b"CDIC" for p in phrases):
            raise Refused("no dictionary records")
        short, long = struct.unpack(">II", huff[8:16])
        self.short = []
        for v in struct.unpack(">256I", huff[short : short + 1024]):
            size = v & 31
            self.short.append((size, bool(v & 128), ((v >> 8) + 1 << 32 - size) - 1 if size else 0))
        bounds = struct.unpack(">64I", huff[long : long + 256])
        self.least = [0] + [bounds[2 * k] << 31 - k for k in range(32)]
        self.most = [0] + [(bounds[2 * k + 1] + 1 << 31 - k) - 1 for k in range(32)]
        self.phrases: list[tuple[bytes, bool] | None] = []
        for p in phrases:
            total, bits = struct.unpack(">II", p[8:16])
            n = min(1 << bits, total - len(self.phrases))
            for at in struct.unpack(f">{n}H", p[16 : 16 + 2 * n]):
                head = struct.unpack(">H", p[16 + at : 18 + at])[0]
                self.phrases.append((p[18 + at : 18 + at + (head & 0x7FFF)], bool(head & 0x8000)))

    def unpack(self, data: bytes, depth: int = 0) -> bytes:
        if depth > 32:
            raise Refused("phrases too deep")
        out, left, at = bytearray(), 8 * len(data), 0
        bits = int.from_bytes(data + bytes(8), "big")
        total = left + 64
        while True:
            code = bits >> total - at - 32 & 0xFFFFFFFF
            size, final, most = self.short[code >> 24]
            if not final:
                while size < 32 and code < self.least[size]:
                    size += 1
                most = self.most[size]
            at += size
            left -= size
            if left < 0 or not size:
                return bytes(out)
            k = most - code >> 32 - size
            if k >= len(self.phrases) or self.phrases[k] is None:
                raise Refused("bad code")
            phrase, plain = self.phrases[k]
            if not plain:
                self.phrases[k] = None  # a phrase cannot hold itself
                phrase = self.unpack(phrase, depth + 1)
                self.phrases[k] = (phrase, True)
            out += phrase


#: Codes of the markup that switch an element on and off (fixed values).
PML_SPANS = {"i": "i", "b": "b", "u": "u", "o": "s", "sp": "sup", "Sp": "sup", "Sb": "sub", "l": "big", "c": "center", "r": "blockquote", "t": "blockquote", "T": "blockquote", "k": "small"}
_PML = re.compile(r"\\(?:a(\d{3})|U([0-9a-fA-F]{4})|([xX][0-4]?)|(Sp|Sb|sp|[biuolcrtTk])|([pn\\-])|[wmQqFC]\d?=?\"([^\"]*)\"|.)", re.S)


def render_pml(text: str) -> tuple[str, list[str]]:
    """HTML of the markup and its chapter titles."""
    out, opened, titles, heading, place = [], [], [], "", 0

    def one(m: re.Match) -> str:
        if m[1]:
            return html.escape(bytes((int(m[1]) & 255,)).decode("cp1252", "replace"), False)
        if m[2]:
            return html.escape(chr(int(m[2], 16)), False)
        if m[4]:
            tag = PML_SPANS[m[4]]
            if m[4] in opened:
                opened.remove(m[4])
                return f"</{tag}>"
            opened.append(m[4])
            return f"<{tag}>"
        return {"p": "<hr/>", "n": "", "\\": "\\", "-": "­"}.get(m[5] or "", "")

    for m in _PML.finditer(text):
        out.append(html.escape(text[place : m.start()], False))
        place = m.end()
        if m[3]:
            level = int(m[3][1:] or 0) + 1
            if heading:
                start = len(out) - 1 - out[::-1].index(heading)
                titles.append(html.unescape(re.sub(r"<[^>]*>", "", "".join(out[start + 1 :]))).strip())
                out.append(f"</h{level}>")
                heading = ""
            else:
                heading = f"<h{level}>"
                out.append(heading)
        else:
            out.append(one(m))
    out.append(html.escape(text[place:], False))
    body = "".join(out) + "".join(f"</{PML_SPANS[k]}>" for k in reversed(opened))
    return "".join(f"<p>{x}</p>" for x in body.split("\n") if x.strip()), titles
