"""Tables on pages: ruled grids and columns of aligned words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import row_bands

from quire.shipping import ship

LEAST_LINES = 3
LEAST_BOUNDED = 0.9
MAX_COLUMNS = 8
EVIDENCE = 2 / 3
CELL = "row int, col int, text string"


def words_in_cells(words: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, col and text of each cell (keys, row, col, x, y, w, h): words whose centre is inside, in reading order."""
    w = words.select(*keys, "text", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    met = cells.join(w, keys).where(F.col("cx").between(F.col("x"), F.col("x") + F.col("w")) & F.col("cy").between(F.col("y"), F.col("y") + F.col("h")))
    rows = F.sort_array(F.collect_list(F.struct(F.round("cy"), "cx", "text")))
    return met.groupBy(*keys, "row", "col").agg(F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("text"))


def grid_of(horizontal: list[tuple[float, float, float]], vertical: list[tuple[float, float, float]], slack: float = 2.0) -> tuple[list[float], list[float]] | None:
    """Row and column borders of a ruled grid from lines (at, low, high); None if it is no table."""
    rows, columns = sorted({h[0] for h in horizontal}), sorted({v[0] for v in vertical})
    if len(rows) < LEAST_LINES or len(columns) < LEAST_LINES:
        return None

    def covered(lines, at: float, low: float, high: float) -> bool:
        return any(abs(a - at) <= slack and x <= low + slack and y >= high - slack for a, x, y in lines)

    bounded = total = 0
    for top, bottom in zip(rows, rows[1:]):
        for left, right in zip(columns, columns[1:]):
            total += 1
            bounded += covered(horizontal, top, left, right) and covered(horizontal, bottom, left, right) and covered(vertical, left, top, bottom) and covered(vertical, right, top, bottom)
    return (rows, columns) if bounded >= LEAST_BOUNDED * total else None


def aligned_columns(words: pd.DataFrame, slack: float = 3.0) -> list[float] | None:
    """Left edges that words of most rows share; None if there are fewer than two or more than eight."""
    band = np.array(row_bands(words.to_dict("records")), int)
    rows = band.max() + 1 if len(band) else 0
    if rows < LEAST_LINES:
        return None
    starts: list[list] = []
    for x, row in sorted(zip(words.x, band)):
        if starts and x - starts[-1][0] <= slack:
            starts[-1][1].add(row)
        else:
            starts.append([x, {row}])
    found = [x for x, own in starts if len(own) >= EVIDENCE * rows]
    return found if 2 <= len(found) <= MAX_COLUMNS else None


def column_tables(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, col, text of pages whose words stand in aligned columns; other pages give no row."""
    types = dict(words.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {CELL}"

    def run(page: pd.DataFrame) -> pd.DataFrame:
        columns = aligned_columns(page)
        if columns is None:
            return pd.DataFrame(columns=[*keys, "row", "col", "text"])
        page = page.assign(row=row_bands(page.to_dict("records")), col=np.searchsorted(np.array(columns) - 3.0, page.x, "right") - 1)
        page = page[page.col >= 0].sort_values(["row", "x"])
        return page.groupby([*keys, "row", "col"], as_index=False).agg(text=("text", " ".join))[[*keys, "row", "col", "text"]]

    ship(words.sparkSession)
    return words.groupBy(*keys).applyInPandas(run, schema)
