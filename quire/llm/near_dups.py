"""N-gram Jaccard join: documents whose five-word shingle sets have Jaccard >= 0.8.

1. Each distinct shingle set gets ``bands x rows`` minimum hashes.  Band and row
   counts follow from the target recall at the threshold (``banding``).
2. The shuffle goes by band hash.  A bucket's members are not paired there: each
   set learns its hub, the least set that shares a bucket with it, and the sets
   of one hub are dealt into blocks of bounded size.
3. Two blocks that meet in a bucket are a pair of blocks.  Each pair of blocks is
   one group, in which the full n-gram sets are compared by matrix products over
   the shingles that at least two of them hold.  Rows leave a group only as a
   count of links and one tree edge for each set, never as pairs of sets.
4. Tree edges are closed to classes by min-label propagation with pointer
   jumping, each round written to the shared folder.

Every pair of sets that shares a bucket is compared exactly; so are further
pairs in the same pair of blocks.  No bucket or candidate list is capped.  Copies
are one set throughout, named by a number of its own, so that no hash decides
which texts are the same but the 128 bits of the shingle set.  Hubs, roots and
sets that hold a large share of the rows are joined by broadcast
(``join_counted``).  A group of pairs of blocks has at most two blocks' sets;
how many pairs a very large group of near copies has follows from what
is asked: the links of each with all others.

Defined results: a text of one to four words has one shingle, all of it; texts
without words (and null texts) are equal to each other only.  A document's links
count every other row with Jaccard >= the threshold, copies included; its class
id is the least doc_id of its connected component (null doc_ids count as
-2**63).  Repeated rows count as copies and each gets a row; Jaccard just at the
threshold (a tie) links; very long texts are taken whole; an empty table gives an
empty result; further columns, whatever their names, are ignored (``one_of_each``
returns them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bytes_of, hashed_words, join_counted, mixed, packed, staged, unstage, whole_text

SIZE = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.999999
BLOCK_SETS = 256
BLOCK_SHINGLES = 1 << 18
NO_ID = -(1 << 63)

def banding(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands reach the recall within the hash budget."""
    best = (most_hashes, 1)
    for rows in range(1, 20):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def rolled(hashes: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each row of word hashes and their row numbers."""
    counts = np.diff(offsets)
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(31) + hashes[k : k + n] + np.uint64(k))
    row = np.repeat(np.arange(len(counts)), counts)
    inside = row[:n] == row[size - 1 :] if n else np.zeros(0, bool)
    out, row_of = out[inside], row[:n][inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            longer = counts[short] > k
            whole[longer] = mixed(whole[longer] * np.uint64(33) + hashes[offsets[short[longer]] + k])
        out, row_of = np.concatenate([out, whole]), np.concatenate([row_of, short])
        order = np.argsort(row_of, kind="stable")
        out, row_of = out[order], row_of[order]
    return out, row_of


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a column."""
    values, row = rolled(*hashed_words(*bytes_of(column)))
    ends = np.searchsorted(row, np.arange(len(column) + 1))
    return [np.unique(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def _signatures(bands: int, rows: int):
    seeds = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2))
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            flat = np.concatenate([sets[k] for k in full]) if len(full) else np.zeros(0, np.uint64)
            starts = np.concatenate(([0], np.cumsum(sizes[full])))[:-1].astype(np.int64)
            least = np.zeros((len(seeds), len(sets)), np.uint64)
            if len(full):
                for k, seed in enumerate(seeds):
                    x = flat * seed
                    x ^= x >> np.uint64(32)
                    least[k, full] = np.minimum.reduceat(x * seed, starts)
            keys = np.zeros((bands, len(sets)), np.uint64)
            for b in range(bands):
                for r in range(rows):
                    keys[b] = mixed(keys[b] * np.uint64(31) + least[b * rows + r] + np.uint64(b + 1))
            h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if len(full):
                h1[full] = np.add.reduceat(mixed(flat), starts)
                h2[full] = np.add.reduceat(mixed(flat ^ np.uint64(0x9E3779B97F4A7C15)), starts)
            flat_keys = pa.array(keys.T.ravel().view(np.int64))
            per_row = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat_keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(sizes.astype(np.int32)), per_row], ["_id", "_th", "s1", "s2", "n", "bands"]
            )

    return sign


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(batch.column(3))
        ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["set", "w", "block", "shingles"])


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of n nodes' components."""
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


def _links(threshold: float):
    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        """Links between the left and the right block of one pair (or within one block)."""
        pair = pair.sort_values("set", kind="stable").drop_duplicates("set")  # repeated rows bring a set twice
        side, sets = pair["side"].to_numpy(), pair["set"].to_numpy()
        weight = pair["w"].to_numpy(float)
        sizes = np.array([len(x) for x in pair["shingles"]])
        values = np.concatenate(list(pair["shingles"]))
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        fresh = np.concatenate(([True], values[1:] != values[:-1]))
        column = np.cumsum(fresh) - 1
        shared = np.bincount(column)[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        width = int(column.max()) + 1 if len(column) else 0
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        in_left, in_right = np.full(len(sets), -1), np.full(len(sets), -1)
        in_left[left], in_right[right] = np.arange(len(left)), np.arange(len(right))
        both = np.zeros((len(left), len(right)), np.float32)
        ends = np.searchsorted(column, np.arange(0, width + 2048, 2048))
        for k in range(len(ends) - 1):
            o, c = owner[ends[k] : ends[k + 1]], column[ends[k] : ends[k + 1]] - k * 2048
            a, b = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
            mine, yours = in_left[o] >= 0, in_right[o] >= 0
            a[in_left[o[mine]], c[mine]] = 1
            b[in_right[o[yours]], c[yours]] = 1
            both += a @ b.T
        union = sizes[left][:, None] + sizes[right][None, :] - both
        linked = (both >= threshold * union - 1e-6) & (sets[left][:, None] != sets[right][None, :])
        links = np.zeros(len(sets))
        links[left] += linked @ weight[right]
        if (side != 2).any():
            links[right] += linked.T @ weight[left]
        i, j = np.nonzero(linked)
        root = _components(len(sets), left[i], right[j])
        return pd.DataFrame({"set": sets, "root": sets[root], "links": links.astype(np.int64)})

    return compare


def least_members(edges: DataFrame) -> DataFrame:
    """set, root: the least set of each connected component, for the sets in ``edges`` (set, root)."""
    ends = edges.where("set <> root").select(F.greatest("set", "root").alias("a"), F.least("set", "root").alias("b")).distinct()
    ends = staged(ends, "edges")
    both = ends.union(ends.select("b", "a"))
    label = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")), "label")
    while True:
        near = both.join(label.toDF("b", "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(near, "a").select("a", "l", F.least("l", "m").alias("m"))
        jump = step.join(label.toDF("m", "far"), "m", "left").select("a", F.col("l").alias("was"), F.least("m", F.coalesce("far", "m")).alias("l"))
        new = staged(jump, "label")
        moved = new.where("was <> l").limit(1).count()
        unstage(label)
        label = new.select("a", "l")
        if not moved:
            return label.toDF("set", "root")


def linked(docs: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """_id, _th, class_id, n_links for each distinct (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    bands, rows = banding(threshold, recall)
    text = whole_text()
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("text"))
    schema = "_id bigint, _th bigint, s1 bigint, s2 bigint, n int, bands array<bigint>"
    signed = staged(base.mapInArrow(_signatures(bands, rows), schema), "signed")
    # One row for each distinct set, named by the least row that has it.
    same = signed.groupBy("s1", "s2").agg(F.count("*").alias("w"), F.min(F.struct("_id", "_th", "bands", "n")).alias("first"), F.min("_id").alias("low"))
    # Sets are named by a number of their own, given once as they are written: no two have the same.
    reps = same.select("s1", "s2", "w", "low", F.monotonically_increasing_id().alias("set"), F.col("first._id").alias("_id"), F.col("first._th").alias("_th"), F.col("first.bands").alias("bands"), F.col("first.n").alias("n"))
    reps = staged(reps, "sets")
    keys = reps.where("n > 0").select("set", F.explode("bands").alias("key"))
    hubs = staged(keys.groupBy("key").agg(F.min("set").alias("hub"), F.count("*").alias("m")).where("m > 1"), "hubs")
    met = staged(join_counted(keys, hubs, ["key"], "m", drop=("m",)), "met")
    hub = staged(met.groupBy("set").agg(F.min("hub").alias("hub")), "hub")
    tops = staged(hub.groupBy("hub").agg(F.count("*").alias("m")).join(hub.toDF("hub", "top"), "hub"), "tops")
    up = join_counted(hub, tops, ["hub"], "m", drop=("m",)).select("set", F.least("hub", "top").alias("hub"))
    homes = staged(up.join(reps.select("set", "_id", "_th", "w", "n"), "set"), "homes")
    sizes = staged(homes.groupBy("hub").agg(F.count("*").alias("m"), F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).alias("blocks")), "sizes")
    homes = join_counted(homes, sizes, ["hub"], "m", drop=("m",)).withColumn("block", F.xxhash64("hub", F.pmod(F.xxhash64(F.lit(7), "set"), F.col("blocks"))))
    homes = staged(homes.select("set", "_id", "_th", "w", "block"), "homes")
    meets = met.join(homes.select("set", "block"), "set").groupBy("key").agg(F.collect_set("block").alias("b"))
    meets = meets.where(F.size("b") > 1).select(F.sort_array("b").alias("b")).distinct()
    pairs = meets.select("b", F.posexplode("b").alias("i", "left")).select("left", F.explode(F.expr("slice(b, i + 2, size(b))")).alias("right")).distinct()
    pairs = staged(pairs, "pairs")
    full = base.join(homes.hint("merge"), ["_id", "_th"]).select("set", "w", "block", "text")
    full = staged(full.mapInArrow(_sets, "set bigint, w bigint, block bigint, shingles array<bigint>"), "shingles")
    block = F.col("block")
    alone = homes.groupBy("block").count().where("count > 1").select(block, block.alias("left"), block.alias("right"), F.lit(2).alias("side"))
    deal = alone.union(pairs.select(F.col("left").alias("block"), "left", "right", F.lit(0).alias("side"))).union(pairs.select(F.col("right").alias("block"), "left", "right", F.lit(1).alias("side")))
    found = deal.join(full, "block").select("left", "right", "side", "set", "w", "shingles")
    found = staged(found.groupBy("left", "right").applyInPandas(_links(threshold), "set bigint, root bigint, links bigint"), "found")
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    roots = least_members(found.select("set", "root"))
    known = reps.select("s1", "s2", "set", "w", "low").join(links, "set", "left").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    known = staged(known, "known")
    least = staged(known.groupBy("root").agg(F.count("*").alias("m"), F.min("low").alias("class_id")), "least")
    known = staged(join_counted(known, least, ["root"], "m", drop=("m",)).select("s1", "s2", "w", "class_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links")), "classes")
    each = signed.select("_id", "_th", "s1", "s2").distinct()
    return join_counted(each, known, ["s1", "s2"], "w", drop=("w",)).select("_id", "_th", "class_id", "n_links")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64(whole_text()).alias("_th"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, one row for each row of docs."""
    return _keyed(docs.select("doc_id", "text")).drop("text").join(linked(docs), ["_id", "_th"]).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of each class's least doc_id (of repeated rows one), with the columns they came with."""
    first = linked(docs).groupBy("class_id").agg(F.min(F.struct("_id", "_th")).alias("f")).select("f._id", "f._th")
    kept = _keyed(packed(docs, "doc_id", "text")).join(first, ["_id", "_th"])
    # Repeated rows agree in doc_id and text; only they can meet here.
    return kept.dropDuplicates(["_id", "_th"]).select("row.*")


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p + 1 : p + 5], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 4, 1))) AS p FROM texts)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE shared * 5 >= (x.n + y.n - shared) * 4
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM texts
  UNION
  SELECT reach.doc_id, b FROM reach JOIN links ON a = other
)
SELECT doc_id, min(other) AS class_id, (SELECT count(*) FROM links WHERE a = reach.doc_id) AS n_links FROM reach GROUP BY doc_id
"""
