"""Text measures and scanners.

Offsets count code points unless a name says ``u16``; UTF-16 lengths come from
the encoded size, so both agree where no astral character occurs.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.shipping import arrow_udf

#: White space that separates counted words (fixed values).
COUNT_SPACES = r"\x09-\x0D\x1C-\x20\x85\xA0  -     　"
#: White space that plain text collapses (fixed values).
TEXT_SPACES = " \t-\r   -     　﻿"
#: Entities that plain text knows (fixed values).
PLAIN_ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'"}
#: Entities that document text knows (fixed values).
DOCUMENT_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "hellip": "…",
    "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "deg": "°",
    "plusmn": "±", "times": "×", "divide": "÷", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "uuml": "ü", "ouml": "ö",
    "auml": "ä", "szlig": "ß",
}


def word_count(text: Column) -> Column:
    """Runs of non-space characters below U+3001, plus each character from there on."""
    runs = F.size(F.regexp_extract_all(text, F.lit("[^" + COUNT_SPACES + r"、-\x{10FFFF}]+"), F.lit(0)))
    return (runs + F.length(F.regexp_replace(text, r"[^、-\x{10FFFF}]", ""))).cast("long")


def u16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def reading_minutes(words: Column, per_minute: int = 200) -> Column:
    """Whole minutes, rounded up; 0 without words or speed."""
    return F.when((words <= 0) | F.lit(per_minute <= 0), F.lit(0)).otherwise(F.ceil(words / F.lit(max(per_minute, 1)))).cast("long")


def reading_time(words: Column, per_minute: int = 200) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), reading_minutes(words, per_minute).cast("int"))


def text_revision(text: Column) -> Column:
    """Digest of the UTF-16LE code units."""
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(text, "UTF-16LE"), 256))


def _json_text(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[|\]$", "")


def order_revision(order: Column) -> Column:
    """Digest of a reading order, array<struct<path, is_html>>: the compact JSON of its pairs, so that order and repeats count."""
    pair = lambda x: F.concat(F.lit("["), _json_text(x["path"]), F.lit(","), x["is_html"].cast("string"), F.lit("]"))
    return text_revision(F.concat(F.lit("["), F.array_join(F.transform(order, pair), ","), F.lit("]")))


def profile_revision(algorithm: Column, options: Column, plan: Column) -> Column:
    """Digest of how a text was made: the algorithm, its options (map<string, string>, by key) and the revision of the plan."""
    entry = lambda e: F.concat(_json_text(e["key"]), F.lit(":"), _json_text(e["value"]))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(options)), entry), ",")
    return text_revision(F.concat(F.lit('{"algorithm":'), _json_text(algorithm), F.lit(',"options":{'), shown, F.lit('},"planRevision":'), _json_text(plan), F.lit("}")))


def is_revision(value: Column) -> Column:
    return value.rlike("^sha256:[0-9a-f]{64}$")


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


_PLAIN = re.compile(r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>|(?-i:&(?:nbsp|amp|lt|gt|quot|apos|#39|#x[0-9a-fA-F]+|#[0-9]+);)")
_PLAIN_SPACES = re.compile(f"[{TEXT_SPACES}]+")


def _plain_part(m: re.Match) -> str:
    got = m[0]
    if got[0] == "<":
        return " "
    if (known := PLAIN_ENTITIES.get(got)) is not None:
        return known
    code = int(got[3:-1], 16) if got[2] == "x" else int(got[2:-1])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def plain_text_of(html: str) -> str:
    """Readable text of a whole document: markup is a space, seven entities and numeric ones decode once."""
    return _PLAIN_SPACES.sub(" ", _PLAIN.sub(_plain_part, html)).strip(" \x85")


_BODY = re.compile(r"(?i)<body[^>]*>")
_SCRIPT = r"<(?:script\b[^>]*>(?:(?!</script>).)*</script>|style\b[^>]*>(?:(?!</style>).)*</style>)"
_DROPPED = re.compile(rf"(?is)({_SCRIPT})|(<!--.*?-->)|(<!\[CDATA\[.*?\]\]>)|<![^>]*>|<(?=[a-z/?])[^>]*>")
_REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7})|([a-zA-Z][a-zA-Z0-9]{0,31}));")


def decode_entity(m: re.Match) -> str:
    if m[3] is not None:
        return DOCUMENT_ENTITIES.get(m[3], m[0])
    code = int(m[1], 16) if m[1] else int(m[2])
    if code > 0x10FFFF:
        return m[0]
    return "�" if code == 0 or 0x80 <= code <= 0x9F or 0xD800 <= code < 0xE000 else chr(code)


def document_text_of(html: str) -> str:
    """Canonical text: the body with white space kept; tags give nothing, CDATA gives ``$1`` so that offsets stay put."""
    low, high = 0, len(html)
    close = html.lower().rfind("</body>")
    for m in _BODY.finditer(html):
        if close >= m.end():
            low, high = m.end(), close
        break
    bare = _DROPPED.sub(lambda m: "$1" if m[3] else "", html[low:high])
    return _REFERENCE.sub(decode_entity, bare)


def arrow_scalar(function, returns: str):
    """An Arrow UDF of a plain function; null in, null out."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else function(v) for v in values.to_pylist()], pa.string())

    return lambda column: arrow_udf(run, returns)(column)


def plain_text(html: Column) -> Column:
    return arrow_scalar(plain_text_of, "string")(html)


def document_text(html: Column) -> Column:
    return arrow_scalar(document_text_of, "string")(html)


#: What the reference's patterns call white space.
WIDE_SPACES = r"\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def smarten_punctuation(text: Column) -> Column:
    """Ellipses, dashes and quotes by what stands before them."""
    text = F.replace(F.replace(text, F.lit("..."), F.lit("…")), F.lit("--"), F.lit("—"))
    for raw, opening, closing in (('"', "“", "”"), ("'", "‘", "’")):
        text = F.replace(F.regexp_replace(text, rf"(^|[{WIDE_SPACES}(\[{{—–]){raw}", f"$1{opening}"), F.lit(raw), F.lit(closing))
    return text


def scene_breaks(html: Column, marker: str = '<p class="scene-break">* * *</p>') -> Column:
    return F.regexp_replace(html, r"(?i)<p[^>]*>\s*(?:[*#~•·—–-]\s*){3,}</p>", marker)


def unwrap_lines(text: Column) -> Column:
    """Join hyphenated and soft line breaks; blank lines stay."""
    text = F.regexp_replace(text, r"(?<=[\p{L}])-\n(?=[\p{Ll}])", "")
    return F.regexp_replace(text, r"(?<=[^\n.!?:;…\"”])\n(?=[^\n])", " ")


def txt_normalize(text: Column) -> Column:
    """Controls out, line ends to \\n, trailing blanks off, at most four blank lines in a run, edges trimmed."""
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    text = F.regexp_replace(text, r"[ \t]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{6,}", "\n\n\n\n\n"), r"^\n+|\n+$", "")


def txt_paragraphs(text: Column) -> Column:
    """array<string>: the blocks between blank lines, each on one line."""
    blocks = F.split(text, r"\n[ \t]*\n\s*")
    return F.filter(F.transform(blocks, lambda b: F.trim(F.regexp_replace(b, r"\s*\n\s*", " "))), lambda b: b != "")


def txt_header(text: Column) -> Column:
    """struct<title, authors>: a title line, two blank lines, a line of authors; null if the head is not so."""
    lines = F.split(text, "\n")
    line = lambda k: F.trim(F.coalesce(F.get(lines, k), F.lit("")))
    good = (line(0) != "") & (line(1) == "") & (line(2) == "") & (line(3) != "")
    authors = F.filter(F.transform(F.split(line(3), ","), lambda a: F.trim(a)), lambda a: a != "")
    return F.when(good, F.struct(line(0).alias("title"), authors.alias("authors")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


#: Chapter words that head a line, without and with accents (fixed values).
CHAPTER_WORDS = "chapter|part|book|section|prologue|epilogue|capítulo|capitulo|parte|livro|libro|prólogo|prologo|epílogo|epilogo|chapitre|partie|kapitel|teil|capitolo"
CHAPTER_LINE = rf"(?imu)^[ \t]*(?:{CHAPTER_WORDS})\b[^\n]{{0,60}}$"


def chapter_titles(text: Column) -> Column:
    """array<string>: lines that look like chapter headings."""
    return F.transform(F.regexp_extract_all(text, F.lit(CHAPTER_LINE), F.lit(0)), lambda x: F.trim(x))


_WIDE = "[" + WIDE_SPACES + "]"
_LINE_START, _LINE_END = r"(?<![^\n\r\u2028\u2029])", r"(?![^\n\r\u2028\u2029])"


def _either(word: str) -> str:
    """The word in either case, and in no other letters that fold to it."""
    return "".join(f"[{c}{c.upper()}]" for c in word)


_KEYWORDS = "|".join([_either("chapter"), _either("cap") + "[iI\u00ED\u00CD]" + _either("tulo"), _either("capitolo"), _either("kapitel")])
_NUMBERED = re.compile(rf"{_LINE_START}{_WIDE}*(?:{_KEYWORDS}){_WIDE}+(?:[0-9]+|[ivxlcIVXLC]+)(?![0-9A-Za-z_])[^\n]{{0,60}}{_WIDE}*{_LINE_END}")
_ROMAN_OR_CAPS = re.compile(rf"{_LINE_START}{_WIDE}*(?:[IVXLC]{{1,7}}|[A-Z][A-Z{WIDE_SPACES}:'\-,.]{{3,60}}){_WIDE}*{_LINE_END}")
_WIDE_CHARS = "".join(chr(c) for c in [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])


def headings_of(text: str) -> list[tuple[str, int]]:
    """Headings with their places: a chapter word and its number, Roman numerals alone, short lines in capitals."""
    found = [(m.start(), k, m[0].strip(_WIDE_CHARS)) for k, p in enumerate((_NUMBERED, _ROMAN_OR_CAPS)) for m in p.finditer(text)]
    return [(title, at) for at, _, title in sorted(found)]


def _headings(texts: pa.Array) -> pa.Array:
    rows = [None if t is None else [{"title": title, "offset": at} for title, at in headings_of(t)] for t in texts.to_pylist()]
    return pa.array(rows, pa.list_(pa.struct([("title", pa.string()), ("offset", pa.int32())])))


def chapter_headings(text: Column) -> Column:
    """array<struct<title, offset>>: likely chapter headings by offset; a match begins at its line's blanks, or blank lines before."""
    return arrow_udf(_headings, "array<struct<title: string, offset: int>>")(text)
