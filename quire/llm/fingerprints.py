"""Document fingerprints: threshold-scaled sketches.  DataFrame functions only.

A document's sketch is a struct.  ``kept`` holds every hash of its five-word
shingles whose top ``scale_bits`` bits are zero, a fixed fraction 2**-scale_bits
of all hashes; ``least`` is its smallest hash.  Since the threshold is the same
for all, containment between very unequal documents is estimated without bias,
and sketches merge: ``merged`` takes the union of ``kept`` and the smaller
``least`` and is the sketch of the joined shingle sets, whatever the parts' sizes.
``least`` stands in only when two documents are compared and one has nothing
below the threshold.  ``near`` is the share of the two sketches' hashes that both
hold; ``contained`` the share of the smaller one's.  The printed fingerprint is
``kept`` in hex, or ``~`` and ``least``.

Defined results: a null text is empty; a text of one to four words has one
shingle, all of it; a text without words has an empty fingerprint, which is like
another empty one (1) and unlike any other (0).  The next document is the next
row by (doc_id, hash of text, text), null doc_ids first, after the last the first;
a lone row is its own successor.  Repeated rows each get a row; very long texts
are taken whole; an empty table gives an empty result; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, whole_text, word_hashes

SHINGLE_WORDS = 5
SCALE_BITS = 3
CELLS = 65_536
MOST_BUCKETS = 1 << 20
BUCKET_ROWS = 256


def with_sketch(df: DataFrame, text: str, out: str, scale_bits: int = SCALE_BITS, size: int = SHINGLE_WORDS) -> DataFrame:
    """Add ``out``: struct of ``kept``, the sorted array of retained shingle hashes of column ``text``, and ``least`` (null without words)."""
    df = df.withColumn("_w", word_hashes(F.col(text)))
    n = F.size("_w")
    rolled = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(size)]))
    df = df.withColumn("_s", F.when(n >= size, rolled).when(n > 0, F.array(F.xxhash64("_w"))).otherwise(F.array().cast("array<bigint>")))
    low = F.filter("_s", lambda h: F.shiftrightunsigned(h, 64 - scale_bits) == 0)
    return df.withColumn(out, F.struct(F.sort_array(F.array_distinct(low)).alias("kept"), F.array_min("_s").alias("least"))).drop("_w", "_s")


def merged(a: str | Column, b: str | Column) -> Column:
    """The sketch of two documents' joined shingles."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.struct(F.sort_array(F.array_union(a["kept"], b["kept"])).alias("kept"), F.least(a["least"], b["least"]).alias("least"))


def members(sketch: str) -> Column:
    """What stands for a document in comparisons."""
    kept, least = F.col(f"{sketch}.kept"), F.col(f"{sketch}.least")
    return F.when((F.size(kept) == 0) & least.isNotNull(), F.array(least)).otherwise(kept)


def as_text(sketch: str) -> Column:
    kept, least = F.col(f"{sketch}.kept"), F.col(f"{sketch}.least")
    return F.when((F.size(kept) == 0) & least.isNotNull(), F.concat(F.lit("~"), F.hex(least))).otherwise(F.array_join(F.transform(kept, lambda h: F.hex(h)), " "))


def near(a: str, b: str) -> Column:
    """Estimated resemblance of two sketches, 0 to 1."""
    x, y = members(a), members(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(both / (F.size(x) + F.size(y) - both))


def contained(a: str, b: str) -> Column:
    """Estimated share of the smaller document's shingles that the other has too."""
    x, y = members(a), members(b)
    least = F.least(F.size(x), F.size(y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / least)


def bucketed(rows: DataFrame) -> DataFrame:
    """rows (doc_id, _th, ...) with _b, a number that does not fall along (doc_id, _th): about ``BUCKET_ROWS`` rows have the same.

    doc_id is cut into at most ``CELLS`` ranges of equal width.  Ranges that hold too many
    rows are cut by their own count and bounds, and what is too full then once more, so that
    unevenly spread ids fill buckets evenly; a range of one id (or none: null) is parted by
    the hash of the text.  Only the counts of too full ranges are broadcast, and
    these are at most ``MOST_BUCKETS`` / 4.
    """
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    per = max(BUCKET_ROWS, math.ceil(n / MOST_BUCKETS))
    low, high = low or 0, high or 0
    width = max(1.0, (high - low + 1) / max(1, min(CELLS, n // per)))
    real = F.col("doc_id").cast("double")
    rows = rows.withColumn("_b", F.coalesce(F.floor((real - F.lit(float(low))) / F.lit(width)), F.lit(-1)))
    for _ in range(2):
        full = rows.groupBy("_b").agg(F.min("doc_id").alias("_from"), F.max("doc_id").alias("_to"), F.count("*").alias("_n")).where(F.col("_n") > 4 * per)
        full = staged(full.select("_b", "_from", "_to", F.ceil(F.col("_n") / per).alias("_parts")), "ranges")
        begin, end = F.col("_from").cast("double"), F.col("_to").cast("double")
        place = F.when(F.col("_to") > F.col("_from"), (real - begin) / (end - begin + 1)).otherwise(F.col("_th").cast("double") / F.lit(2.0**64) + 0.5)
        part = F.coalesce(F.greatest(F.lit(0), F.least(F.floor(place * F.col("_parts")), F.col("_parts") - 1)), F.lit(0))
        rows = rows.join(F.broadcast(full), "_b", "left").withColumn("_b", F.col("_b") * F.lit(1 << 20) + part).drop("_from", "_to", "_parts")
    return rows


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Add next_<c> for each carried column: its value in the next row by (doc_id, hash of text, text), cyclic.

    Each bucket (``bucketed``) also gets a copy of the row that heads the following
    one, so no window spans more than a bucket and texts move once.  The broadcast
    table of heads has a row of four numbers for each bucket, whose number is bounded.
    """
    rows = bucketed(rows.withColumn("_th", F.xxhash64("text")))
    heads = rows.groupBy("_b").agg(F.min(F.struct("doc_id", "_th")).alias("h"))
    order = Window.orderBy("_b")
    before = F.coalesce(F.lag("_b").over(order), F.max("_b").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("h.doc_id").alias("_head"), F.col("h._th").alias("_head_th"), before.alias("_before"), F.lit(True).alias("_is_head"))
    rows = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_head")) & (F.col("_th") == F.col("_head_th")), "left")
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_before").alias("b"), F.lit(True).alias("guest"))
    rows = rows.withColumn("_to", F.explode(F.when(F.col("_is_head"), F.array(own, guest)).otherwise(F.array(own))))
    rows = rows.select("*", F.col("_to.b").alias("_in"), F.col("_to.guest").alias("_guest"))
    w = Window.partitionBy("_in").orderBy("_guest", F.asc_nulls_first("doc_id"), "_th", "text")
    rows = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return rows.where(~F.col("_guest")).drop("_b", "_th", "_head", "_head_th", "_before", "_is_head", "_to", "_in", "_guest")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = with_next(with_sketch(rows, "text", "sketch"), ["text", "sketch"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"),
        near("sketch", "edited_sketch").alias("near_edited"), near("sketch", "next_sketch").alias("near_next"),
        contained("sketch", "edited_sketch").alias("contained_edited"), contained("sketch", "next_sketch").alias("contained_next"),
    )
