"""Lines and blocks of pages from the places of their words alone.

The dominant orientation of a page is voted by the angles between near words.
Words whose centres follow each other along it are one line; lines one under the
other within a paragraph's leading are one block.  Both relations are closed
transitively.  Pairs are tested in blocks of words with arrays, page by page; a page
of more than ``MAX_WORDS`` words is left unsegmented.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.shipping import arrow_udf

from .spatial import neighbour_angles

#: Reaches and tolerances, in sizes and heights of words and lines (fixed values).
BINS, NEIGHBOURS = 12, 4
ALONG_SIZE, ALONG_HEIGHT, ACROSS_HEIGHT, ACROSS_ALONG = 3.0, 0.9, 0.45, 0.12
OVERLAP, RISE, GAP = 0.25, 0.45, 1.55
MAX_WORDS, PAIRS = 5_000, 512


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' connected component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def orientation(words: list[dict]) -> float:
    """The direction of reading, in radians from -90 to 90 degrees: the fullest of twelve smoothed bins and the axial mean around it."""
    angles = np.array([a for own in neighbour_angles(words, NEIGHBOURS) for a in own])
    if not len(angles):
        return 0.0
    votes = np.bincount((np.mod(angles, np.pi) / np.pi * BINS).astype(int) % BINS, minlength=BINS).astype(float)
    smooth = np.roll(votes, 1) + 2 * votes + np.roll(votes, -1)
    best = int(smooth.argmax())
    centres = 2 * (best + np.arange(-1, 2) + 0.5) / BINS * np.pi
    weight = np.array([1.0, 2.0, 1.0])
    middle = np.arctan2((weight * np.sin(centres)).sum(), (weight * np.cos(centres)).sum()) / 2 % np.pi
    return float(middle - np.pi if np.cos(middle) < 0 else middle)


def _related(n: int, test) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j that pass a test on a block of rows i against all columns j."""
    left, right = [], []
    for at in range(0, n, PAIRS):
        rows = np.arange(at, min(at + PAIRS, n))
        i, j = np.nonzero(test(rows[:, None], np.arange(n)[None, :]) & (np.arange(n)[None, :] > rows[:, None]))
        left.append(rows[i])
        right.append(j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _numbered(group: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Groups numbered from the top, those of one height from the left."""
    order = sorted(set(group.tolist()), key=lambda g: (y[group == g].min(), x[group == g].min()))
    place = {g: k for k, g in enumerate(order)}
    return np.array([place[g] for g in group.tolist()], int)


def lines_of(words: list[dict]) -> np.ndarray:
    """The line number of each word (x, y, w, h and maybe size)."""
    x, y, w, h = (np.array([r[k] for r in words], float) for k in ("x", "y", "w", "h"))
    size = np.array([r.get("size") or r["h"] for r in words], float)
    turn = orientation(words)
    # The bins are coarse; places along and across are taken on the voted direction, with slack that grows with the gap.
    along = (x + w / 2) * np.cos(turn) + (y + h / 2) * np.sin(turn)
    across = (y + h / 2) * np.cos(turn) - (x + w / 2) * np.sin(turn)

    def same(i, j):
        gap, off = np.abs(along[j] - along[i]), np.abs(across[j] - across[i])
        small = np.minimum(h[i], h[j])
        return (gap <= ALONG_SIZE * np.minimum(size[i], size[j]) + ALONG_HEIGHT * small) & (off <= ACROSS_HEIGHT * small + ACROSS_ALONG * gap)

    return _numbered(components(len(words), *_related(len(words), same)), y, x)


def blocks_of(words: list[dict], line: np.ndarray) -> np.ndarray:
    """The block number of each word, from the boxes of its page's lines."""
    n = int(line.max()) + 1 if len(line) else 0
    x, y, right, bottom = (np.full(n, v) for v in (np.inf, np.inf, -np.inf, -np.inf))
    for r, k in zip(words, line):
        x[k], y[k], right[k], bottom[k] = min(x[k], r["x"]), min(y[k], r["y"]), max(right[k], r["x"] + r["w"]), max(bottom[k], r["y"] + r["h"])
    order = np.lexsort((x, y))
    x, y, right, bottom = x[order], y[order], right[order], bottom[order]
    wide, high = right - x, bottom - y

    def below(i, j):
        shared = np.minimum(right[i], right[j]) - np.maximum(x[i], x[j])
        gap, leading = y[j] - bottom[i], np.maximum(high[i], high[j])
        return (shared > 0) & (shared >= OVERLAP * np.minimum(wide[i], wide[j])) & (gap >= -RISE * leading) & (gap <= GAP * leading)

    group = np.empty(n, int)
    group[order] = _numbered(components(n, *_related(n, below)), y, x)
    return group[line] if n else line


def segmented(words: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys, x, y, w, h and maybe size, …) with their line and block on their page; null on pages past the limit."""
    kind = pa.list_(pa.struct([("line", pa.int32()), ("block", pa.int32())]))

    def run(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages.to_pylist():
            if len(page) > MAX_WORDS:
                out.append([None] * len(page))
                continue
            line = lines_of(page)
            out.append([{"line": int(a), "block": int(b)} for a, b in zip(line, blocks_of(page, line))])
        return pa.array(out, kind)

    pages = words.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in words.columns if c not in keys])).alias("_rows"))
    both = pages.select(*keys, F.explode(F.arrays_zip("_rows", arrow_udf(run, "array<struct<line: int, block: int>>")("_rows").alias("_said"))).alias("_r"))
    return both.select(*keys, "_r._rows.*", "_r._said.line", "_r._said.block").select(*words.columns, "line", "block")
