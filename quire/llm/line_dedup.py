"""Line dedup: drop lines that many documents share.  DataFrame functions only.

Lines are exploded with their positions, normalised and hashed, and the hashes
are written, so that texts are split once for them; one aggregate counts the
distinct documents of each hash and finds the largest doc_id holding it.  Lines
over the threshold go, except in that document, and what stays is reassembled by
position inside each row, so texts are shuffled once, when the dropped positions
meet their documents.  The hashes that are over the threshold are written once;
those that hold a large share of all lines (at most ``HOT_KEYS``) meet their
lines by broadcast, the others by a shuffle.

Defined results: a null or empty text is one empty line; a null doc_id is one
document that precedes all others; repeated rows of one doc_id count as one
document and each gets its own output row; lines of equal keys in one document
(ties) go or stay together; very long texts are taken whole; an empty table gives
an empty result; further columns of the input, whatever their names, are ignored
(``drop_common_lines`` returns them).
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, join_counted, packed, staged, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 20
MIN_DOCS = 3
NO_ID = -(1 << 63)


def ascii_lower(text: Column) -> Column:
    """Lower A-Z and nothing else; texts of ASCII alone take the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def stripped(line: Column) -> Column:
    """line without SPACE_CHARS at both ends; the trim makes eight bytes of garbage a byte, so only lines that need it get it."""
    ends = functools.reduce(operator.or_, [test(c) for c in SPACE_CHARS for test in (line.startswith, line.endswith)])
    return F.when(ends, F.btrim(line, F.lit(SPACE_CHARS))).otherwise(line)


def _rows(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.withColumns({"text": text, "_id": F.coalesce("doc_id", F.lit(NO_ID)), "_th": F.xxhash64(text)})


def keyed_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """_id, _th, pos and two independent 64-bit hashes of each line's key that is long enough."""
    lines = rows.select("_id", "_th", F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("pos", "line"))
    lines = lines.select("_id", "_th", "pos", stripped(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return lines.select("_id", "_th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def marked(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs (null texts empty) with _kept, the text without the dropped lines, _n_lines and _n_dropped; docs has doc_id, text and maybe row."""
    rows = _rows(docs)
    lines = staged(keyed_lines(rows, min_chars), "keys")
    common = lines.groupBy("h1", "h2").agg(F.countDistinct("_id").alias("docs"), F.count("*").alias("n"), F.max("_id").alias("holder")).where(F.col("docs") >= min_docs)
    gone = join_counted(lines, staged(common, "lines"), ["h1", "h2"], drop=("docs", "n")).where(F.col("_id") != F.col("holder"))
    gone = gone.groupBy("_id", "_th").agg(F.collect_set("pos").alias("_gone"))
    joined = rows.join(gone, ["_id", "_th"], "left").withColumn("_lines", F.split("text", "\n"))
    n, whole = F.size("_lines"), F.col("_gone").isNull()
    joined = joined.withColumn("_stay", F.when(~whole, F.array_except(F.sequence(F.lit(0), n - 1), "_gone")))
    kept = F.when(whole, F.col("text")).otherwise(F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n"))
    n_dropped = F.when(whole, F.lit(0)).otherwise(F.size("_gone"))
    return joined.withColumns({"_kept": kept, "_n_lines": n.cast("long"), "_n_dropped": n_dropped.cast("long")}).drop("_id", "_th", "_gone", "_lines", "_stay")


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the lines dropped from text, and n_chars (where there is such a column) counted anew."""
    out = marked(packed(docs, "doc_id", "text", without=("text", "n_chars")), min_chars, min_docs)
    changed = {"text": F.col("_kept")} | ({"n_chars": F.length("_kept").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns])


def line_dedup_report(docs: DataFrame) -> DataFrame:
    out = marked(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


LINE_DEDUP_SQL = r"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM rows
), keyed AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM lines
), keys AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM keyed
), common AS (
  SELECT k, max(doc_id) AS holder FROM keys WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keys.doc_id, pos, line, common.k IS NOT NULL AND keys.doc_id <> holder AS gone
  FROM keys LEFT JOIN common ON keys.k = common.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
