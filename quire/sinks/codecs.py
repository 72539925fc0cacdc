"""Versioned JSON of annotations, anchors, snapshots and position lists; what does not fit its version reads as null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_revision, text_revision

VERSION = 1
MAX_PAYLOAD = 1 << 20
HIGHLIGHT = "id string, section_index int, start int, `end` int, text string, before string, after string, created_at timestamp, note string"
BOOKMARK = "id string, title string, section_index int, char_offset int, created_at timestamp, note string"
ANNOTATIONS = f"v int, highlights array<struct<{', '.join(f'{a.strip().rsplit(' ', 1)[0]}: {a.strip().rsplit(' ', 1)[1]}' for a in HIGHLIGHT.split(','))}>>, bookmarks array<struct<{', '.join(f'{a.strip().rsplit(' ', 1)[0]}: {a.strip().rsplit(' ', 1)[1]}' for a in BOOKMARK.split(','))}>>"
ANCHOR = "v int, section bigint, start int, `end` int, revision string, quote string, before string, after string"
SNAPSHOT = "v int, book string, section int, profile string, text string, revision string"


def annotations_json(highlights: DataFrame, bookmarks: DataFrame, owner: str) -> DataFrame:
    """owner and the JSON of all its annotations, in order of place."""
    h = highlights.groupBy(owner).agg(F.sort_array(F.collect_list(F.struct("section_index", "start", *[c for c in highlights.columns if c not in (owner, "section_index", "start")]))).alias("highlights"))
    b = bookmarks.groupBy(owner).agg(F.sort_array(F.collect_list(F.struct("section_index", "char_offset", *[c for c in bookmarks.columns if c not in (owner, "section_index", "char_offset")]))).alias("bookmarks"))
    both = h.join(b, owner, "full")
    return both.select(owner, F.to_json(F.struct(F.lit(VERSION).alias("v"), F.coalesce("highlights", F.array()).alias("highlights"), F.coalesce("bookmarks", F.array()).alias("bookmarks"))).alias("json"))


def annotations_of(json: Column) -> Column:
    x = F.from_json(json, ANNOTATIONS)
    return F.when((F.octet_length(json) <= MAX_PAYLOAD) & (x["v"] == VERSION), x)


def anchor_json(section: Column, start: Column, end: Column, revision: Column, quote: Column, before: Column, after: Column) -> Column:
    parts = {"section": section, "start": start, "end": end, "revision": revision, "quote": quote, "before": before, "after": after}
    return F.to_json(F.struct(F.lit(VERSION).alias("v"), *[c.alias(n) for n, c in parts.items()]))


def anchor_of(json: Column) -> Column:
    x = F.from_json(json, ANCHOR)
    good = (x["v"] == VERSION) & (x["start"] >= 0) & (x["end"] >= x["start"]) & is_revision(x["revision"]) & x["quote"].isNotNull()
    return F.when((F.octet_length(json) <= MAX_PAYLOAD) & good, x)


def snapshot_json(book: Column, section: Column, profile: Column, text: Column) -> Column:
    parts = {"book": book, "section": section, "profile": profile, "text": text, "revision": text_revision(text)}
    return F.to_json(F.struct(F.lit(VERSION).alias("v"), *[c.alias(n) for n, c in parts.items()]))


def snapshot_of(json: Column) -> Column:
    """Null also where the text is not the one that was digested."""
    x = F.from_json(json, SNAPSHOT)
    return F.when((x["v"] == VERSION) & (x["revision"] == text_revision(x["text"])), x)


def position_list_json(positions: DataFrame, book: str) -> DataFrame:
    """book and {total, positions} of a position list."""
    one = F.struct("position", "progression", "total_progression")
    return positions.groupBy(book).agg(F.to_json(F.struct(F.count("*").alias("total"), F.sort_array(F.collect_list(one)).alias("positions"))).alias("json"))
