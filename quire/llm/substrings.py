"""Substring dedup: remove words of 35-word windows that occur more than once.

The texts are threaded through a sparse de Bruijn graph.  Its edges are the
token k-mers that are the least by hash in some run of neighbouring k-mers, so
two equal windows always hold the same edge at the same place.

1. Edges of all texts are counted by hash; edges met once are cut.
2. Every text learns which of its edges repeat.  A window is a candidate if its
   least edge repeats; candidates that follow each other are a span of that text.
   Paths are not compacted across texts by graph joins: spans are read off each
   text's own coordinates, and step 3 decides.
3. Source coordinates verify the spans: the windows inside them are hashed with
   128 bits and counted, and those that occur at least twice are marked.
4. Marks meet their text again, their windows are laid over its words, and
   covered words go.

Steps 2 and 3 combine inside each task first: what a chunk of its rows holds twice
is settled there, and one row stands for it in the shuffle.  So a line, passage or
text that a third of all documents share sends at most one row from each chunk.
Of a text that occurs more than once as a whole, only the first enters step 3.
Texts travel compressed.

A text that many rows copy is joined by broadcast (``join_counted``).

Defined results: null and empty texts have no words; texts shorter than a window
keep all; repeated rows count as copies and each gets a row; a null doc_id is
treated like any other; of windows that are equal (ties) all go; very long texts
are taken whole; an empty table gives an empty result; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, bytes_of, hashed_words, join_counted, mixed, staged, whole_text

WINDOW = 35
EDGE = 8
CHUNK = 1 << 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ROOTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def run_hashes(hashes: np.ndarray, size: int, root: np.uint64) -> np.ndarray:
    """Polynomial hash of every run of ``size`` neighbouring word hashes, by doubling."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, part, span, power = None, 0, mixed(hashes ^ root), 1, np.array([root])  # an array: its overflow is meant
    while True:
        if size & span:  # append the run of length span that starts where the present one ends
            tail = part[have : have + n]
            out = tail if out is None else out * power + tail
            have += span
        if have == size:
            return mixed(out)
        part = part[:-span] * power + part[span:]
        span, power = span * 2, power * power


def _sliding(values: np.ndarray, reach: int, pick) -> np.ndarray:
    """Least or greatest of every ``reach`` neighbours, by doubling."""
    n, span = len(values) - reach + 1, 1
    while span * 2 <= reach:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[:n], values[reach - span : reach - span + n])


def least_kmers(hashes: np.ndarray, window: int = WINDOW, size: int = EDGE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers, and for each window that of its least one."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    kmers = run_hashes(hashes, size, _ROOTS[0])
    return kmers, _sliding(kmers, window - size + 1, np.minimum)


def edges_of(hashes: np.ndarray, window: int = WINDOW, size: int = EDGE) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-mers that are least in some window; none if no window fits."""
    kmers, low = least_kmers(hashes, window, size)
    if not len(low):
        return np.zeros(0, np.int32), kmers
    reach = window - size + 1
    edge = np.zeros(reach - 1, np.uint64)
    places = np.flatnonzero(kmers == _sliding(np.concatenate([edge, low, edge]), reach, np.maximum))
    return places.astype(np.int32), kmers[places]


def candidates(hashes: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Starts of the windows whose least edge is among ``repeated``."""
    _, low = least_kmers(hashes)
    return np.flatnonzero(np.isin(low, repeated)) if len(low) else np.zeros(0, np.int64)


EDGES = "rid bigint, edge bigint, kind int"
SINGLE, SETTLED, STANDS = 0, 1, 2


def _combined(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur once here, and a place of each of the others."""
    n = len(keys[0])
    order = np.lexsort(keys)
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    for key in keys:
        key = key[order]
        fresh[1:] |= key[1:] != key[:-1]
    size = np.diff(np.append(np.flatnonzero(fresh), n))
    single = np.zeros(n, bool)
    single[order[fresh][size == 1]] = True
    return single, order[fresh][size > 1]


def _emit_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's edges; those that a chunk of texts holds twice are settled, and one row stands for them."""
    rids, edges, have = [], [], 0

    def flush() -> pa.RecordBatch:
        rid, edge = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rids, edges))
        single, stand = _combined(edge)
        # One settled row for each text and edge is enough.
        settled = np.flatnonzero(~single)
        order = settled[np.lexsort((edge[settled], rid[settled]))]
        differs = np.ones(len(order), bool)
        differs[1:] = (edge[order][1:] != edge[order][:-1]) | (rid[order][1:] != rid[order][:-1])
        settled, single = order[differs], np.flatnonzero(single)
        kind = np.repeat(np.array([SINGLE, SETTLED, STANDS], np.int32), [len(single), len(settled), len(stand)])
        at = np.concatenate([single, settled, stand]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.where(kind == STANDS, 0, rid[at])), pa.array(edge[at]), pa.array(kind)], ["rid", "edge", "kind"])

    for batch in batches:
        own = batch.column(0).to_numpy()
        hashes, ends = hashed_words(*bytes_of(batch.column(1)))
        for k in range(batch.num_rows):
            _, found = edges_of(hashes[ends[k] : ends[k + 1]])
            if len(found):
                edges.append(found.view(np.int64))
                rids.append(np.full(len(found), own[k]))
                have += len(found)
        if have >= CHUNK:
            yield flush()
            rids, edges, have = [], [], 0
    yield flush()


def _hex(parts: list[str]) -> str:
    return hashlib.sha256(" ".join(parts).encode()).hexdigest()


def _kept(text: str, n: int, starts: np.ndarray) -> tuple[int, str]:
    """How many of n words the windows at ``starts`` cover, and the hash of the others."""
    step = np.zeros(n + 1, np.int64)
    starts = np.unique(starts)
    step[starts] += 1
    step[starts + WINDOW] -= 1
    keep = np.cumsum(step)[:n] == 0
    words = _WORD.findall(text)
    return n - int(keep.sum()), _hex(words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k])


SPANS = "rid bigint, doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, packed binary, sure array<int>, starts array<int>, w1 array<bigint>, w2 array<bigint>, r1 array<bigint>, r2 array<bigint>"
_KINDS = [pa.int64()] * 4 + [pa.string(), pa.binary()] + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())] * 4


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are settled, and for the others their text and the hashed windows of their spans."""
    unpack, serial = zstandard.ZstdDecompressor(), TaskContext.get().partitionId() << 33
    rows: list[list] = []
    starts_of: list[np.ndarray] = []
    hashed: list[tuple[np.ndarray, np.ndarray]] = []
    have = 0

    def flush() -> pa.RecordBatch:
        w1, w2 = (np.concatenate([h[k] for h in hashed]) if hashed else np.zeros(0, np.uint64) for k in (0, 1))
        single, stand = _combined(w1, w2)
        stood = np.zeros(len(w1), bool)
        stood[stand] = True
        out, at = [], 0
        for row, starts in zip(rows, starts_of):
            rid, doc_id, n, copied, data = row
            part = slice(at, at := at + len(starts))
            if copied:  # a whole text that occurs again: its windows stand for themselves
                open_, sure, rep = np.zeros(0, bool), np.zeros(0, np.int64), single[part] | stood[part]
                out.append((rid, doc_id, n, n, _hex([]), None, None, None, None, None, w1[part][rep].view(np.int64), w2[part][rep].view(np.int64)))
                continue
            open_, rep = single[part], stood[part]
            sure = starts[~open_]
            windows = (w1[part][open_].view(np.int64), w2[part][open_].view(np.int64), w1[part][rep].view(np.int64), w2[part][rep].view(np.int64))
            if open_.any():
                out.append((rid, doc_id, n, None, None, data, sure, starts[open_], *windows))
            else:
                out.append((rid, doc_id, n, *_kept(unpack.decompress(data).decode(), n, sure), None, None, None, None, None, *windows[2:]))
        columns = list(zip(*out)) or [()] * len(_KINDS)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _KINDS)], [x.split()[0] for x in SPANS.split(", ")])

    for batch in batches:
        doc_ids, packed, copies, first = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
        texts = pa.array([unpack.decompress(z) for z in packed], pa.binary()).cast(pa.string())
        hashes, ends = hashed_words(*bytes_of(texts))
        for k in range(batch.num_rows):
            own, serial = hashes[ends[k] : ends[k + 1]], serial + 1
            copied = copies[k] > 1 and len(own) >= WINDOW
            repeated = batch.column(2)[k]
            starts = candidates(own, repeated.values.to_numpy().view(np.uint64)) if repeated.is_valid and (first[k] or not copied) else np.zeros(0, np.int64)
            rows.append([serial, doc_ids[k], len(own), copied, packed[k]])
            starts_of.append(starts)
            hashed.append(tuple(run_hashes(own, WINDOW, r)[starts] if len(starts) else np.zeros(0, np.uint64) for r in _ROOTS))
            have += len(starts) + len(packed[k]) // 16
        if have >= CHUNK:
            yield flush()
            rows, starts_of, hashed, have = [], [], [], 0
    yield flush()


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        done = []
        for n, data, sure, marks in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
            done.append(_kept(unpack.decompress(data).decode(), n, np.array((sure or []) + (marks or []), np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _pack(texts: pa.Array) -> pa.Array:
    pack = zstandard.ZstdCompressor(level=3)
    return pa.array([pack.compress(t.as_buffer()) for t in texts], pa.binary())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs."""
    bounded_batches(docs.sparkSession)
    text = whole_text()
    # rid only gathers candidates: rows that share one would only get more of them.
    rows = docs.select(F.xxhash64(F.coalesce("doc_id", F.lit(0)), text).alias("rid"), "doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    edges = staged(rows.select("rid", "text").mapInArrow(_emit_edges, EDGES), "edges")
    met = edges.where(F.col("kind") != SETTLED).withColumn("n", F.count("*").over(Window.partitionBy("edge")))
    repeated = met.where((F.col("n") > 1) & (F.col("kind") == SINGLE)).select("rid", "edge").union(edges.where(F.col("kind") == SETTLED).select("rid", "edge"))
    paths = repeated.groupBy("rid").agg(F.collect_set("edge").alias("repeated"))
    # Copies of whole texts, told by two hashes of the text; the first is the row with the least rid.
    same = staged(rows.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("rid").alias("first")).where("copies > 1"), "copies")
    copied = join_counted(rows.select("rid", "t1", "t2"), same, ["t1", "t2"], "copies").groupBy("rid").agg(F.max("copies").alias("copies"), F.max(F.col("first") == F.col("rid")).alias("first"))
    known = rows.select("rid", "doc_id", F.arrow_udf(_pack, "binary")("text").alias("packed")).join(paths, "rid", "left").join(copied, "rid", "left")
    known = known.select("doc_id", "packed", "repeated", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("first", F.lit(True)).alias("first"))
    spans = staged(known.mapInArrow(_verify, SPANS), "spans")
    open_ = spans.select("rid", F.explode(F.arrays_zip("starts", "w1", "w2")).alias("w")).select("rid", "w.starts", "w.w1", "w.w2")
    stands = spans.select(F.explode(F.arrays_zip("r1", "r2")).alias("w")).select(F.lit(None).cast("bigint").alias("rid"), F.lit(None).cast("int").alias("starts"), F.col("w.r1").alias("w1"), F.col("w.r2").alias("w2"))
    # A standing row speaks for at least two windows of its chunk, or for a text with copies.
    counted = open_.union(stands).withColumn("n", F.count("*").over(Window.partitionBy("w1", "w2")))
    marks = counted.where("n > 1 AND rid IS NOT NULL").groupBy("rid").agg(F.collect_list("starts").alias("marks"))
    waiting = spans.where("n_removed IS NULL").select("rid", "doc_id", "n_words", "packed", "sure").join(marks, "rid", "left")
    covered = waiting.select("doc_id", "n_words", "packed", "sure", "marks").mapInArrow(_cover, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    return spans.where("n_removed IS NOT NULL").select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(covered)


SUBSTRINGS_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(ws[p + 1 : p + 35], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 34)) AS p FROM texts WHERE len(ws) >= 35)
), twice AS (
  SELECT w FROM windows GROUP BY w HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM windows SEMI JOIN twice USING (w)
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM texts
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""
