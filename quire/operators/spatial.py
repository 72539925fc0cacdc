"""Page geometry and text zones: range joins, units, page layout."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.shipping import arrow_udf

GRID = 512


def overlapping(ranges: DataFrame, zones: DataFrame, keys: list[str], grid: int = GRID) -> DataFrame:
    """ranges (keys, start, end) joined to every zone (keys, text_start, text_end) that overlaps them.

    Both sides are dealt to cells of ``grid`` offsets and joined on the cell; a
    pair is taken only in the first cell that both touch, so none comes twice.
    """
    cell = lambda a, b: F.explode(F.sequence(F.floor(a / grid).cast("int"), F.floor(F.greatest(b - 1, a) / grid).cast("int")))
    left = ranges.withColumn("_cell", cell(F.col("start"), F.col("end")))
    right = zones.withColumn("_cell", cell(F.col("text_start"), F.col("text_end")))
    met = left.join(right, [*keys, "_cell"]).where((F.col("text_start") < F.col("end")) & (F.col("text_end") > F.col("start")))
    return met.where(F.col("_cell") == F.floor(F.greatest("start", "text_start") / grid)).drop("_cell")


def zone_at(points: DataFrame, zones: DataFrame, keys: list[str], kind: str, offset: str = "offset", grid: int = GRID) -> DataFrame:
    """points with the innermost zone of a kind that holds the offset (the shortest, then the first)."""
    ranges = points.withColumn("_p", F.monotonically_increasing_id()).withColumn("start", F.col(offset)).withColumn("end", F.col(offset) + 1)
    met = overlapping(ranges.select("_p", *keys, "start", "end"), zones.where(F.col("kind") == kind), keys, grid)
    best = met.groupBy("_p").agg(F.min(F.struct((F.col("text_end") - F.col("text_start")).alias("size"), "text_start", "zone_seq")).alias("z"))
    return ranges.drop("start", "end").join(best, "_p", "left").select(*points.columns, F.col("z.zone_seq").alias("zone_seq"), F.col("z.text_start").alias("text_start"))


def enclosing(zones: DataFrame, keys: list[str], kind: str = "region") -> DataFrame:
    """zones with the zone_seq of the nearest zone of ``kind`` at or before them."""
    w = Window.partitionBy(*keys).orderBy("zone_seq").rowsBetween(Window.unboundedPreceding, 0)
    return zones.withColumn("within", F.last(F.when(F.col("kind") == kind, F.col("zone_seq")), ignorenulls=True).over(w))


def contains_point(x: Column, y: Column, w: Column, h: Column, px: Column, py: Column) -> Column:
    return (px >= x) & (px <= x + w) & (py >= y) & (py <= y + h)


def intersects(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    return (ax < bx + bw) & (bx < ax + aw) & (ay < by + bh) & (by < ay + ah)


def pixel_scale(unit: Column, dpi: Column) -> Column:
    """Pixels for one unit; null where it needs a resolution that is missing."""
    return F.when(unit == "pixel", F.lit(1.0)).when(unit == "mm10", dpi / 254).when(unit == "inch1200", dpi / 1200)


def page_scale(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Scale from page units to pixels if both sides agree within one per cent, else null."""
    a, b = width / page_width, height / page_height
    return F.when(F.abs(a - b) <= 0.01 * F.greatest(a, b), (a + b) / 2)


def bounding_boxes(zones: DataFrame, keys: list[str]) -> DataFrame:
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return zones.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), right.alias("right"), bottom.alias("bottom"))


def merged_rules(rules: DataFrame, keys: list[str], position: float = 1.5, gap: float = 2.0) -> DataFrame:
    """Collinear ruling lines (keys, at, low, high) within ``position`` and ``gap`` of each other as one."""
    w = Window.partitionBy(*keys).orderBy("at", "low")
    rows = rules.withColumn("_line", F.sum(F.when(F.col("at") - F.lag("at").over(w) <= position, 0).otherwise(1)).over(w))
    line = Window.partitionBy(*keys, "_line").orderBy("low")
    reach = F.max("high").over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_part", F.sum(F.when(F.col("low") - reach <= gap, 0).otherwise(1)).over(line))
    return rows.groupBy(*keys, "_line", "_part").agg(F.avg("at").alias("at"), F.min("low").alias("low"), F.max("high").alias("high")).drop("_line", "_part")


def upper_median(values: Column) -> Column:
    """The middle element of a list, the upper one of two."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


BAND, GUTTER, MAX_COLUMNS = 0.5, 0.03, 6


def by_page(rows: DataFrame, keys: list[str], name: str, function: Callable[[list[dict]], list[int]]) -> DataFrame:
    """rows with a column ``name``: what the function says of each row of a page (rows of equal keys), given all of the page.

    Pages are gathered as arrays, so that one Arrow batch holds many of them.
    """
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([function(page) for page in pages.to_pylist()], pa.list_(pa.int32()))

    pages = rows.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in keys])).alias("_rows"))
    both = pages.select(*keys, F.explode(F.arrays_zip("_rows", arrow_udf(run, "array<int>")("_rows").alias("_said"))).alias("_r"))
    return both.select(*keys, "_r._rows.*", F.col("_r._said").alias(name)).select(*rows.columns, name)


def row_bands(words: list[dict]) -> list[int]:
    """Row number of each word: by baseline, within half a height of the row's first word."""
    band, row, first = [0] * len(words), -1, None
    base = [w["y"] + w["h"] for w in words]
    for k in sorted(range(len(words)), key=base.__getitem__):
        if first is None or base[k] - base[first] > BAND * max(words[first]["h"], words[k]["h"]):
            row, first = row + 1, k
        band[k] = row
    return band


def with_row_bands(words: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys, x, y, w, h, …) with ``band``, computed page by page."""
    return by_page(words, keys, "band", row_bands)


def xy_cut(blocks: list[dict], width: float) -> list[int]:
    """Positions of blocks in reading order: wide horizontal gaps first, then gutters, recursively."""
    def cut(ids: list[int]) -> list[int]:
        if len(ids) < 2:
            return ids
        height = sorted(blocks[k]["h"] for k in ids)[len(ids) // 2]
        for axis, size, least in (("y", "h", 2 * height), ("x", "w", GUTTER * width)):
            parts, reach = [], None
            for k in sorted(ids, key=lambda k: blocks[k][axis]):
                low, high = blocks[k][axis], blocks[k][axis] + blocks[k][size]
                if reach is None or low - reach > least:
                    parts.append([])
                parts[-1].append(k)
                reach = high if reach is None else max(reach, high)
            if 1 < len(parts) and (axis == "y" or len(parts) <= MAX_COLUMNS):
                return [k for p in parts for k in cut(p)]
        return sorted(ids, key=lambda k: (blocks[k]["y"], blocks[k]["x"]))

    return cut(list(range(len(blocks))))


def reading_order(blocks: DataFrame, keys: list[str], page_width: str = "page_width") -> DataFrame:
    """blocks with ``place``, their number in reading order on their page."""
    def run(page: list[dict]) -> list[int]:
        place = [0] * len(page)
        for n, k in enumerate(xy_cut(page, page[0][page_width])):
            place[k] = n
        return place

    return by_page(blocks, keys, "place", run)


def edge_lines(lines: DataFrame, book: str, page: str, first_pages: int = 20) -> DataFrame:
    """Lines that head or foot at least half of a book's first pages: book, edge, text, n.

    lines: book, page, line_no, text.  Page numbers count as one text.
    """
    some = lines.where(F.col(page) < first_pages)
    w = Window.partitionBy(book, page)
    edge = F.when(F.col("line_no") == F.min("line_no").over(w), "head").when(F.col("line_no") == F.max("line_no").over(w), "foot")
    text = F.when(F.trim("text").rlike(r"^\W*\d+\W*$"), "#").otherwise(F.trim("text"))
    marked = some.select(book, page, edge.alias("edge"), text.alias("text")).where("edge IS NOT NULL")
    pages = some.groupBy(book).agg(F.countDistinct(page).alias("pages"))
    return marked.groupBy(book, "edge", "text").agg(F.count("*").alias("n")).join(pages, book).where(F.col("n") * 2 >= F.col("pages")).drop("pages")


SAME_INDENT, PITCH = 2.0, 1.6


def contiguous_rows(rows: DataFrame, keys: list[str], top: str = "top") -> DataFrame:
    """The leading rows of each table whose distance from the row above is at most 1.6 times the upper median distance."""
    w = Window.partitionBy(*keys).orderBy(top)
    pitch = rows.withColumn("_pitch", F.col(top) - F.lag(top).over(w))
    middle = pitch.groupBy(*keys).agg(upper_median(F.collect_list("_pitch")).alias("_middle"))
    broken = F.max(F.coalesce(F.col("_pitch") > PITCH * F.col("_middle"), F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return pitch.join(middle, keys).withColumn("_broken", broken).where(~F.col("_broken")).select(*rows.columns)


def commonest(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, value, low, high, n: the most frequent value (of equals the greatest) and the extent and size of what lies within two units of it."""
    counted = values.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = counted.groupBy(*keys).agg(F.max(F.struct("_n", value)).alias("_b")).select(*keys, F.col(f"_b.{value}").alias("_best"))
    near = counted.join(best, keys).where(F.abs(F.col(value) - F.col("_best")) <= SAME_INDENT)
    return near.groupBy(*keys, F.col("_best").alias(value)).agg(F.min(near[value]).alias("low"), F.max(near[value]).alias("high"), F.sum("_n").alias("n"))


def orientation_bins(angles: DataFrame, keys: list[str], angle: str = "angle", bins: int = 12) -> DataFrame:
    """keys and the bin of half a turn that most angles fall in, with its neighbours counted half as much; the first of equals."""
    turn = F.pmod(F.col(angle), F.lit(np.pi))
    votes = angles.select(*keys, (F.floor(turn / np.pi * bins) % bins).cast("int").alias("_b")).groupBy(*keys, "_b").agg(F.count("*").alias("_v"))
    share = F.explode(F.array(*[F.struct(F.pmod(F.col("_b") + k, F.lit(bins)).alias("bin"), (F.col("_v") * (2 if k == 0 else 1)).alias("v")) for k in (-1, 0, 1)]))
    smooth = votes.select(*keys, share.alias("s")).groupBy(*keys, "s.bin").agg(F.sum("s.v").alias("votes"))
    return smooth.groupBy(*keys).agg(F.min_by("bin", F.struct(-F.col("votes"), F.col("bin"))).cast("int").alias("bin"))


def neighbour_angles(words: list[dict], k: int = 4) -> list[list[float]]:
    """Angles from each word's centre to those of its k nearest; by blocks of words, so that memory stays small."""
    x = np.array([w["x"] + w["w"] / 2 for w in words], float)
    y = np.array([w["y"] + w["h"] / 2 for w in words], float)
    out: list[list[float]] = []
    for at in range(0, len(words), 256):
        dx, dy = x[None, :] - x[at : at + 256, None], y[None, :] - y[at : at + 256, None]
        far = dx * dx + dy * dy
        far[np.arange(len(far)), at + np.arange(len(far))] = np.inf
        near = np.argsort(far, axis=1, kind="stable")[:, : min(k, len(words) - 1)]
        out += np.arctan2(np.take_along_axis(dy, near, 1), np.take_along_axis(dx, near, 1)).tolist()
    return out


def with_neighbour_angles(words: DataFrame, keys: list[str], k: int = 4) -> DataFrame:
    """keys and the angle to each of the k nearest neighbours of each word of a page (x, y, w, h)."""
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([[a for own in neighbour_angles(page, k) for a in own] for page in pages.to_pylist()], pa.list_(pa.float64()))

    pages = words.groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("_w"))
    return pages.select(*keys, F.explode(arrow_udf(run, "array<double>")("_w")).alias("angle"))
