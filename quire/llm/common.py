"""Helpers shared by the training-data operators.

Words are maximal runs of characters other than ``[\\x20\\x09-\\x0D]``.
Null texts count as empty.  Rows are told apart by ``(doc_id, hash of text)``:
rows equal in both are handled alike and each keeps its own output row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.shipping import ship
from quire.sinks.shared import drop, new_path

SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, for tables with very long texts, and see that workers have this package.

    The settings stay: they are read when the DataFrame that the caller returns is run.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column without nulls and each row's bounds in them."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[: bounds[-1]], bounds


def row_slices(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes (one row at least), so that temporaries stay small."""
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, to
        at = to


_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
#: Tabulation hashing: a random number for each byte at each place.
_TABLE = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, (256, 256), np.uint64)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def hashed_words(raw: np.ndarray, bounds: np.ndarray, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the rows, in order, and each row's bounds among them."""
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, to in row_slices(bounds, most):
        own, edges = raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        solid = _SOLID[own]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        heads = edges[:-1][edges[:-1] < len(own)]
        begins[heads] = solid[heads]
        starts = np.flatnonzero(begins)
        counts.append(np.diff(np.searchsorted(starts, edges)))
        if len(starts):
            place = np.arange(len(own)) - starts[np.maximum(np.cumsum(begins) - 1, 0)]
            value = _TABLE[own, place & 255]
            if place.max() > 255:  # words longer than the table
                value = value * ((place >> 8).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            value[~solid] = 0
            parts.append(mixed(np.add.reduceat(value, starts)))
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def packed(docs: DataFrame, *names: str, without: tuple[str, ...] = ()) -> DataFrame:
    """The row (but for the columns in ``without``) as one struct beside the named columns, so that no column of the input can clash with an operator's own."""
    kept = [c for c in docs.columns if c not in without]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *names)


def words(text: Column) -> Column:
    """array<string> of the words of a non-null text, in order."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def word_hashes(text: Column) -> Column:
    """array<bigint> of the words' 64-bit hashes, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


_OPEN: ContextVar[list[str] | None] = ContextVar("stages", default=None)


@contextmanager
def own_stages() -> Iterator[list[str]]:
    """Collects the paths of the tables staged inside, so that the caller can drop them once they are read."""
    paths: list[str] = []
    token = _OPEN.set(paths)
    try:
        yield paths
    finally:
        _OPEN.reset(token)


def drop_stages(spark: SparkSession, paths: list[str]) -> None:
    drop(spark, paths)


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    if (own := _OPEN.get()) is not None:
        own.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing needs any more."""
    drop_stages(df.sparkSession, list({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


#: Keys that hold at least this share of the rows are joined by broadcast: there can be no more of them than its inverse.
HOT_KEYS = 4_096


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n", drop: tuple[str, ...] = ()) -> DataFrame:
    """Inner join with a staged ``right`` that has one row a key and in ``n`` the rows of ``left`` with that key.

    Keys with at least 1 / ``HOT_KEYS`` of these rows, which are at most ``HOT_KEYS``,
    are broadcast, so that no task gets all rows of a hot key; the others are shuffled.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * F.lit(HOT_KEYS) >= F.lit(max(total, HOT_KEYS))
    some = right.where(hot).drop(*drop)
    cold = left.join(F.broadcast(some.select(*keys)), keys, "left_anti").join(right.where(~hot).drop(*drop).hint("merge"), keys)
    return left.join(F.broadcast(some), keys).unionByName(cold)
