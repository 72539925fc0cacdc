"""Media columns: what a blob is, by its signature and structure.

An Aho-Corasick automaton over all magic bytes passes each blob once.  Each hit
goes to its format's validator, which follows the structure and returns the
length it spans, or None; so two letters that happen to look like a magic number
claim nothing.  Where a format has checksums they are checked (PNG, GZIP, OGG,
FLAC), and ends that must be searched for (PDF, ZIP, JPEG) are searched for once a
blob and not once a hit.  A valid structure at offset 0 corrects the declared
type; valid structures further in, also inside that first one, are carved as
embedded media, outermost first.

``stored`` writes texts as media (8-bit PCM in WAV, without loss) into a column of
a table in the shared folder, and the report is computed from what is read back.

Defined results: a null or empty blob has type ``application/x-empty`` and no
media; overlapping finds inside a carved one are not reported again; a blob that
nothing matches keeps its declared type if that is not one that validation can
refute, else ``application/octet-stream``.  In the report a null text is empty; a
null doc_id stays; repeated rows each get a row, and equal texts (ties) equal
values; very long texts are stored whole; an empty table gives an empty result;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, staged, whole_text

UNIT = 576
RATE = 8_000


def _u16(b: bytes, i: int) -> int:
    return int.from_bytes(b[i : i + 2], "little")


def _u32(b: bytes, i: int, order: str = "little") -> int:
    return int.from_bytes(b[i : i + 4], order)


def _places(b: bytes, marker: bytes) -> list[int]:
    return [m.start() for m in re.finditer(re.escape(marker), b)]


class Blob:
    """A blob and what validators look up in it, found once."""

    def __init__(self, b: bytes):
        self.b = b
        self.pages: dict[int, int] = {}

    @cached_property
    def jpeg_ends(self) -> list[int]:
        return _places(self.b, b"\xff\xd9")

    @cached_property
    def zips(self) -> dict[int, int]:
        """Start -> end of archives whose last record points back to their directory."""
        b, out = self.b, {}
        for at in _places(self.b, b"PK\x05\x06"):
            size, start, note = _u32(b, at + 12), _u32(b, at + 16), _u16(b, at + 20)
            begin, end = at - size - start, at + 22 + note
            if begin >= 0 and end <= len(b) and b[begin + start : begin + start + 4] == b"PK\x01\x02":
                out.setdefault(begin, end)
        return out

    @cached_property
    def pdfs(self) -> dict[int, int]:
        """Start -> end of the last trailer whose offset leads to a cross-reference table or stream."""
        b, out = self.b, {}
        tables = [m.start() for m in re.finditer(rb"(?<!start)xref\b", b)]
        objects = [m.start() for m in re.finditer(rb"(?<!\d)\d{1,10} \d{1,5} obj\b", b)]
        for m in re.finditer(rb"startxref\s{1,4}(\d{1,12})\s{1,4}%%EOF", b):
            for places in (tables, objects):
                k = bisect_left(places, m.start())
                if k and (begin := places[k - 1] - int(m[1])) >= 0:
                    out[begin] = m.end()
        return out


def _riff(x: Blob, i: int) -> tuple[str, int] | None:
    b = x.b
    kind, end = b[i + 8 : i + 12], i + 8 + _u32(b, i + 4)
    kinds = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}
    if kind not in kinds or end > len(b):
        return None
    at, seen = i + 12, set()
    while at + 8 <= end:
        seen.add(b[at : at + 4])
        at += 8 + (n := _u32(b, at + 4)) + n % 2
    if at not in (end, end + 1) or kind == b"WAVE" and not {b"fmt ", b"data"} <= seen:
        return None
    return kinds[kind], end - i


def _png(x: Blob, i: int) -> tuple[str, int] | None:
    b, at = x.b, i + 8
    while at + 12 <= len(b):
        n, kind = _u32(b, at, "big"), b[at + 4 : at + 8]
        if at + 12 + n > len(b) or zlib.crc32(b[at + 4 : at + 8 + n]) != _u32(b, at + 8 + n, "big"):
            return None
        if at == i + 8 and kind != b"IHDR":
            return None
        at += 12 + n
        if kind == b"IEND":
            return "image/png", at - i
    return None


def _gif(x: Blob, i: int) -> tuple[str, int] | None:
    b = x.b
    if i + 13 > len(b):
        return None
    flags = b[i + 10]
    at = i + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while at < len(b):
        kind = b[at]
        if kind == 0x3B:
            return "image/gif", at + 1 - i
        if kind == 0x2C and at + 10 < len(b):
            at += 10 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 128 else 0) + 1
        elif kind == 0x21:
            at += 2
        else:
            return None
        while at < len(b) and b[at]:
            at += 1 + b[at]
        at += 1
    return None


def _jpeg(x: Blob, i: int) -> tuple[str, int] | None:
    b, at, frame = x.b, i + 2, False
    while at + 4 <= len(b) and b[at] == 0xFF:
        kind = b[at + 1]
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        n = int.from_bytes(b[at + 2 : at + 4], "big")
        if n < 2:
            return None
        at += 2 + n
        if kind == 0xDA:
            k = bisect_left(x.jpeg_ends, at)
            return ("image/jpeg", x.jpeg_ends[k] + 2 - i) if frame and k < len(x.jpeg_ends) else None
    return None


def _bmp(x: Blob, i: int) -> tuple[str, int] | None:
    b = x.b
    if i + 54 > len(b):
        return None
    n, data, head, bits = _u32(b, i + 2), _u32(b, i + 10), _u32(b, i + 14), _u16(b, i + 28)
    good = 54 <= n <= len(b) - i and head in (40, 108, 124) and 14 + head <= data < n and _u16(b, i + 26) == 1 and bits in (1, 4, 8, 16, 24, 32)
    return ("image/bmp", n) if good else None


def _pdf(x: Blob, i: int) -> tuple[str, int] | None:
    return ("application/pdf", x.pdfs[i] - i) if x.b[i + 5 : i + 8].replace(b".", b"").isdigit() and i in x.pdfs else None


def _gzip(x: Blob, i: int) -> tuple[str, int] | None:
    if i + 18 > len(x.b) or x.b[i + 3] & 0xE0:
        return None
    d, at, view = zlib.decompressobj(31), i, memoryview(x.b)
    try:
        while at < len(x.b) and not d.eof:  # in steps: a small input can inflate to a very large one
            rest = view[at : at + (1 << 16)]
            at += len(rest)
            while len(rest) and not d.eof:
                d.decompress(rest, 1 << 20)
                rest = d.unconsumed_tail
    except zlib.error:
        return None
    return ("application/gzip", at - len(d.unused_data) - i) if d.eof else None


def _zip(x: Blob, i: int) -> tuple[str, int] | None:
    return ("application/zip", x.zips[i] - i) if i in x.zips else None


def _crc_table(poly: int, width: int) -> list[int]:
    out, top, mask = [], 1 << width - 1, (1 << width) - 1
    for k in range(256):
        r = k << width - 8
        for _ in range(8):
            r = (r << 1 ^ (poly if r & top else 0)) & mask
        out.append(r)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_frame(b: bytes, i: int) -> int | None:
    """Samples in the frame whose header stands at i, by its own checksum."""
    if i + 6 > len(b) or b[i] != 0xFF or b[i + 1] & 0xFE != 0xF8 or b[i + 3] & 1:
        return None
    size, rate, lead = b[i + 2] >> 4, b[i + 2] & 15, b[i + 4]
    more = 0 if lead < 0x80 else next((k for k in range(1, 7) if not lead & 0x80 >> k + 1), 7) if lead >= 0xC0 else -1
    if more < 0 or not size or rate == 15:
        return None
    at = i + 5 + more
    if size in (6, 7):
        at += size - 5
    end = at + (1 if rate == 12 else 2 if rate in (13, 14) else 0)
    if end >= len(b):
        return None
    crc = 0
    for byte in b[i:end]:
        crc = _CRC8[crc ^ byte]
    if crc != b[end]:
        return None
    if size in (6, 7):
        return int.from_bytes(b[at - (size - 5) : at], "big") + 1
    return 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8


def _flac(x: Blob, i: int) -> tuple[str, int] | None:
    """Metadata blocks, then frames up to the samples that the stream declares; each frame ends where its checksum holds."""
    b, at = x.b, i + 4
    if at + 38 > len(b) or b[at] & 127:
        return None
    total, last = int.from_bytes(b[at + 17 : at + 22], "big") & (1 << 36) - 1, 0
    while not last and at + 4 <= len(b):
        last, at = b[at] >> 7, at + 4 + int.from_bytes(b[at + 1 : at + 4], "big")
    done = 0
    while (n := _flac_frame(b, at)) is not None:
        done += n
        crc, ends = 0, 0
        for p in range(at, len(b)):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[p]]
            if not crc and p > at + 6:  # the checksum included, it is 0
                if (final := bool(total) and done >= total) or _flac_frame(b, p + 1) is not None or p + 1 == len(b):
                    ends = p + 1
                    break
        if not ends:
            return None
        at = ends
        if final or at == len(b):
            return "audio/flac", at - i
    return None


_TURNED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def _ogg_page(b: bytes, at: int) -> int | None:
    """Where the page at ``at`` ends, if its checksum holds."""
    if b[at : at + 5] != b"OggS\0" or at + 27 > len(b):
        return None
    end = at + 27 + b[at + 26] + sum(b[at + 27 : at + 27 + b[at + 26]])
    if end > len(b):
        return None
    page = b[at : at + 22] + bytes(4) + b[at + 26 : end]
    # The checksum runs the other way round than zlib's and begins with 0.
    crc = zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return end if int(f"{crc:032b}"[::-1], 2) == _u32(b, at + 22) else None


def _ogg(x: Blob, i: int) -> tuple[str, int] | None:
    at, met = i, []
    while at not in x.pages and (end := _ogg_page(x.b, at)) is not None:
        met.append(at)
        at = end
    at = x.pages.get(at, at)
    x.pages.update((p, at) for p in met)
    return ("audio/ogg", at - i) if at > i else None


def _mp4(x: Blob, i: int) -> tuple[str, int] | None:
    b, i, kinds = x.b, i - 4, set()
    at = i
    while 0 <= at and at + 8 <= len(b):
        n, kind = _u32(b, at, "big"), b[at + 4 : at + 8]
        if n < 8 or at + n > len(b) or not kind.isalnum():
            break
        kinds.add(kind)
        at += n
    return ("video/mp4", at - i) if {b"ftyp", b"moov"} <= kinds else None


#: Magic bytes, their place in the structure and its validator (fixed values).
SIGNATURES = {
    b"RIFF": (0, _riff), b"\x89PNG\r\n\x1a\n": (0, _png), b"GIF87a": (0, _gif), b"GIF89a": (0, _gif), b"\xff\xd8\xff": (0, _jpeg), b"BM": (0, _bmp),
    b"%PDF-": (0, _pdf), b"\x1f\x8b\x08": (0, _gzip), b"PK\x03\x04": (0, _zip), b"fLaC": (0, _flac), b"OggS": (0, _ogg), b"ftyp": (4, _mp4),
}
KNOWN = {"audio/wav", "video/avi", "image/webp", "image/png", "image/gif", "image/jpeg", "image/bmp", "application/pdf", "application/gzip", "application/zip", "audio/flac", "audio/ogg", "video/mp4"}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic, (shift, check) in SIGNATURES.items():
        out.add_word(magic.decode("latin-1"), (len(magic), shift, check))
    out.make_automaton()
    return out


def sniff(blob: bytes | None, declared: str | None, magic: ahocorasick.Automaton) -> tuple[str, list[tuple[int, int, str]]]:
    """The corrected type, and (offset, length, type) of each embedded medium."""
    if not blob:
        return "application/x-empty", []
    actual, found, free, tail = None, [], 0, None
    blob = bytes(blob)
    known = Blob(blob)
    for end, (n, shift, check) in magic.iter(blob.decode("latin-1")):
        start = end + 1 - n - shift
        if start < free or not (hit := check(known, end + 1 - n)):
            continue
        if start == 0 and actual is None:
            actual, tail = hit[0], (hit[0], hit[1])
            continue
        if (hit[0], start + hit[1]) == tail:  # a later part of the first structure itself
            continue
        found.append((start, hit[1], hit[0]))
        free = start + hit[1]
    if actual is None:
        actual = declared if declared and declared not in KNOWN else "application/octet-stream"
    return actual, found


def as_wav(samples: bytes) -> bytes:
    """Unsigned 8-bit mono PCM."""
    pad = len(samples) % 2
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * pad


def wav_samples(blob: bytes) -> bytes:
    at = 12
    while bytes(blob[at : at + 4]) != b"data":
        at += 8 + (n := _u32(blob, at + 4)) + n % 2
    return blob[at + 8 : at + 8 + _u32(blob, at + 4)]


def sniff_column(df: DataFrame, blob: str, declared: str | None = None) -> DataFrame:
    """All columns and media_type string, embedded array<struct<offset, length, type>>."""
    @F.udf("media_type string, embedded array<struct<offset: bigint, length: bigint, type: string>>", useArrow=True)
    def typed(content, said):
        magic = typed.__dict__.setdefault("magic", automaton())
        return sniff(content, said, magic)

    out = df.withColumn("_m", typed(F.col(blob), F.col(declared) if declared else F.lit(None).cast("string")))
    return out.select(*df.columns, "_m.media_type", "_m.embedded")


REPORT = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def stored(docs: DataFrame, name: str = "media") -> DataFrame:
    """doc_id, n_bytes, media: every text padded to whole units and written as a WAV file, read back from the shared folder."""
    @F.arrow_udf("binary")
    def as_media(texts: pa.Array) -> pa.Array:
        raw = (t.as_buffer().to_pybytes() for t in texts)
        return pa.array([as_wav(x + b"\xff" * (-len(x) % UNIT if x else UNIT)) for x in raw], pa.binary())

    rows = docs.select("doc_id", F.octet_length(whole_text()).cast("bigint").alias("n_bytes"), as_media(whole_text()).alias("media"))
    return staged(rows, name, "zstd")


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    magic = automaton()
    for batch in batches:
        out = []
        for doc_id, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
            payload = wav_samples(blob)
            kind, embedded = sniff(blob, "application/octet-stream", magic)
            feature = f"{kind};rate={RATE};bits=8;frames={len(payload)};crc={zlib.crc32(payload):08x};embedded={len(embedded)}"
            out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*out)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in REPORT.split(", ")])


def media_report(docs: DataFrame) -> DataFrame:
    """One row of the stored form's digests and features for each row of docs."""
    bounded_batches(docs.sparkSession)
    return stored(docs).mapInArrow(_report, REPORT)
