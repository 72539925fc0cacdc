"""OCR and page-layout documents as zones: ALTO, PAGE, hOCR and TSV.

All give rows of page, zone_seq, kind (region, line, word), id, text, x, y, w, h
and confidence (0 to 1), in document order; text offsets come from ``with_offsets``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .archive import Refused
from .books import _local, decode_text, xml_root

from quire.shipping import ship

ZONE = "page int, zone_seq int, kind string, id string, text string, x double, y double, w double, h double, confidence double"
FIELDS = [f.strip().split(" ")[0] for f in ZONE.split(",")]


def _zone(page: int, kind: str, id_: str, text: str, box: tuple, confidence: float | None) -> list:
    return [page, 0, kind, id_, text, *box, confidence]


def _numbered(zones: list[list]) -> list[list]:
    for k, z in enumerate(zones):
        z[1] = k
    return zones


def parse_alto(content: bytes) -> tuple[list[list], dict]:
    """Zones and {unit, pages: [(width, height)]}; versions 2 to 4."""
    root = xml_root(content)
    if _local(root.tag) != "alto":
        raise Refused("no ALTO document")
    version = re.search(r"/alto/ns-v(\d)", root.tag)
    if version and version[1] not in "234":
        raise Refused(f"ALTO version {version[1]}")
    unit = next((e.text.strip() for e in root.iter() if _local(e.tag) == "MeasurementUnit" and e.text), "pixel")
    if unit not in ("pixel", "mm10", "inch1200"):
        raise Refused(f"unit {unit}")
    zones, sizes = [], []
    number = lambda e, k: float(e.attrib.get(k, "nan"))
    box = lambda e: (number(e, "HPOS"), number(e, "VPOS"), number(e, "WIDTH"), number(e, "HEIGHT"))
    for page, p in enumerate(e for e in root.iter() if _local(e.tag) == "Page"):
        sizes.append((number(p, "WIDTH"), number(p, "HEIGHT")))
        for block in (e for e in p.iter() if _local(e.tag) == "TextBlock"):
            zones.append(_zone(page, "region", block.attrib.get("ID", ""), "", box(block), None))
            for line in (e for e in block if _local(e.tag) == "TextLine"):
                words = [e for e in line if _local(e.tag) in ("String", "HYP")]
                zones.append(_zone(page, "line", line.attrib.get("ID", ""), " ".join(w.attrib.get("CONTENT", "") for w in words if _local(w.tag) == "String"), box(line), None))
                for w in words:
                    if _local(w.tag) == "String":
                        sure = number(w, "WC")
                        zones.append(_zone(page, "word", w.attrib.get("ID", ""), w.attrib.get("CONTENT", ""), box(w), sure if sure == sure else None))
    return _numbered(zones), {"unit": unit, "pages": sizes}


def _points(e) -> tuple:
    found = next((c.attrib.get("points", "") for c in e if _local(c.tag) == "Coords"), "")
    xy = [tuple(map(float, p.split(","))) for p in found.split()]
    if not xy:
        return (float("nan"),) * 4
    xs, ys = zip(*xy)
    return min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)


def parse_page(content: bytes) -> tuple[list[list], dict]:
    """Zones of a PAGE document in its reading order; version 2019-07-15 only."""
    root = xml_root(content)
    if _local(root.tag) != "PcGts" or "2019-07-15" not in root.tag:
        raise Refused("not a PAGE document of 2019-07-15")
    zones, sizes = [], []

    def text(e) -> tuple[str, float | None]:
        equiv = next((c for c in e if _local(c.tag) == "TextEquiv"), None)
        if equiv is None:
            return "", None
        said = next((u.text or "" for u in equiv if _local(u.tag) == "Unicode"), "")
        return said, float(equiv.attrib["conf"]) if "conf" in equiv.attrib else None

    def order(e) -> list[str]:
        """Region ids, groups in place; ordered ones by index."""
        items = list(e)
        if _local(e.tag).startswith("OrderedGroup"):
            items.sort(key=lambda c: int(c.attrib.get("index", "0")))
        out = []
        for c in items:
            out += [c.attrib["regionRef"]] if "regionRef" in c.attrib else []
            out += order(c) if "Group" in _local(c.tag) else []
        return out

    for page, p in enumerate(e for e in root if _local(e.tag) == "Page"):
        sizes.append((float(p.attrib.get("imageWidth", "nan")), float(p.attrib.get("imageHeight", "nan"))))
        regions = [e for e in p.iter() if _local(e.tag) == "TextRegion"]
        listed = [r for e in p if _local(e.tag) == "ReadingOrder" for g in e for r in order(g)]
        place = {r: k for k, r in enumerate(listed)}
        regions.sort(key=lambda r: place.get(r.attrib.get("id", ""), len(place)))
        for region in regions:
            said, sure = text(region)
            zones.append(_zone(page, "region", region.attrib.get("id", ""), said, _points(region), sure))
            for line in (e for e in region if _local(e.tag) == "TextLine"):
                said, sure = text(line)
                zones.append(_zone(page, "line", line.attrib.get("id", ""), said, _points(line), sure))
                for word in (e for e in line if _local(e.tag) == "Word"):
                    said, sure = text(word)
                    zones.append(_zone(page, "word", word.attrib.get("id", ""), said, _points(word), sure))
    return _numbered(zones), {"unit": "pixel", "pages": sizes}


def parse_title(title: str) -> dict[str, list[str]]:
    """Properties of an hOCR title: ``name value …; name …``, values may be quoted; the first of a name counts."""
    out: dict[str, list[str]] = {}
    for part in re.findall(r"((?:[^;\"']|\"[^\"]*\"|'[^']*')+)", title):
        values = [a or b or c for a, b, c in re.findall(r"\"([^\"]*)\"|'([^']*)'|([^\s,\"']+)", part)]
        if values:
            out.setdefault(values[0], values[1:])
    return out


#: hOCR classes by kind of zone (fixed values).
HOCR_KINDS = {"ocr_carea": "region", "ocr_line": "line", "ocr_header": "line", "ocr_caption": "line", "ocr_textfloat": "line", "ocrx_word": "word"}


def _percent(values: list[str] | None) -> float | None:
    return float(values[0]) / 100 if values and re.fullmatch(r"\d+(\.\d+)?", values[0]) else None


class _Hocr(HTMLParser):
    def __init__(self):
        super().__init__()
        self.zones, self.sizes, self.open, self.page = [], [], [], -1

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "meta", "link", "hr", "input"):
            return
        own = dict(attrs)
        classes = (own.get("class") or "").split()
        said = parse_title(own.get("title") or "")
        box = (float("nan"),) * 4
        if len(corners := [x for x in said.get("bbox", []) if re.fullmatch(r"-?\d+(\.\d+)?", x)]) == 4:
            a, b, c, d = map(float, corners)
            box = (a, b, c - a, d - b)
        zone = None
        if "ocr_page" in classes:
            self.page += 1
            self.sizes.append(box[2:])
        for kind in (HOCR_KINDS[c] for c in classes if c in HOCR_KINDS):
            sure = _percent(said.get("x_wconf"))
            zone = _zone(max(self.page, 0), kind, own.get("id") or "", "", box, sure)
            self.zones.append(zone)
        self.open.append((tag, zone))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        for _, zone in self.open:
            if zone is not None and zone[2] != "region":
                zone[4] += data


def parse_hocr(content: bytes) -> tuple[list[list], dict]:
    reader = _Hocr()
    reader.feed(decode_text(content))
    if reader.page < 0:
        raise Refused("no ocr_page")
    for z in reader.zones:
        z[4] = " ".join(z[4].split())
    return _numbered(reader.zones), {"unit": "pixel", "pages": reader.sizes}


def parse_tsv(content: bytes) -> tuple[list[list], dict]:
    """The table form of the same: levels 2 (block), 4 (line) and 5 (word)."""
    zones, sizes = [], []
    lines = decode_text(content).split("\n")
    if not lines[0].startswith("level\t"):
        raise Refused("no table head")
    for line in lines[1:]:
        cell = line.rstrip("\r").split("\t")
        if len(cell) < 12:
            continue
        level, page = int(cell[0]), int(cell[1]) - 1
        box, sure = tuple(map(float, cell[6:10])), float(cell[10])
        if level == 1:
            sizes.append(box[2:])
        elif level in (2, 4) or level == 5 and cell[11].strip():
            zones.append(_zone(page, {2: "region", 4: "line", 5: "word"}[level], "-".join(cell[1:6]), html.unescape(cell[11]).strip() if level == 5 else "", box, sure / 100 if level == 5 and sure >= 0 else None))
    return _numbered(zones), {"unit": "pixel", "pages": sizes}


PARSERS = {"alto": parse_alto, "page": parse_page, "hocr": parse_hocr, "tsv": parse_tsv}


def kind_of(content: bytes) -> str:
    head = content[:4096].decode("latin-1")
    return "tsv" if head.startswith("level\t") else "alto" if re.search(r"<(?:\w+:)?alto[\s>]", head) else "page" if re.search(r"<(?:\w+:)?PcGts[\s>]", head) else "hocr"


def read_zones(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """book_id, error and the zones of each file; a file that is refused gives one row with its error."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for book_id, data in frame.itertuples(index=False):
                try:
                    zones, _ = PARSERS[kind_of(bytes(data))](bytes(data))
                    rows += [[book_id, None, *z] for z in zones]
                except (Refused, ValueError) as e:
                    rows.append([book_id, str(e)] + [None] * len(FIELDS))
            yield pd.DataFrame(rows, columns=["book_id", "error", *FIELDS])

    ship(files.sparkSession)
    return files.select(F.col(path).alias("book_id"), content).mapInPandas(run, f"book_id string, error string, {ZONE}")


def with_offsets(zones: DataFrame) -> DataFrame:
    """Word zones with text_start and text_end in their page's text, words joined by one blank."""
    words = zones.where("kind = 'word'")
    w = Window.partitionBy("book_id", "page").orderBy("zone_seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int")
    return words.withColumn("text_start", start).withColumn("text_end", F.col("text_start") + F.length("text"))


def bind_words(words: list[str], text: str) -> list[tuple[int, int, bool] | None]:
    """(start, end, ambiguous) of each word: its first place at or after the cursor, else from the start."""
    out, cursor = [], 0
    for word in words:
        at = text.find(word, cursor) if word else -1
        at = text.find(word) if at < 0 and word else at
        if at < 0:
            out.append(None)
            continue
        out.append((at, at + len(word), text.find(word, at + 1) >= 0 or text.find(word) < at))
        cursor = at + len(word)
    return out


def bind(words: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys, zone_seq, text) bound to texts (keys, page_text) page by page: adds start, end, ambiguous."""
    types = dict(words.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", zone_seq int, start int, `end` int, ambiguous boolean"

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("zone_seq")
        found = bind_words(page["text"].tolist(), page["page_text"].iloc[0])
        out = page[[*keys, "zone_seq"]].copy()
        for k, name in enumerate(("start", "end", "ambiguous")):
            out[name] = pd.array([None if f is None else f[k] for f in found], dtype="boolean" if name == "ambiguous" else "Int32")
        return out

    ship(words.sparkSession)
    return words.join(texts, keys).groupBy(*keys).applyInPandas(run, schema)
