"""Quality classifier: importance resampling with hashed n-gram models.

Two generative models over hashed n-grams are counted: one of the target (rows
labelled good), one of the raw text (every row).  The log ratio of the two, summed
over a document's n-grams, says how much likelier the target makes it.  As the
n-grams overlap, that sum counts the same evidence many times over; so the ratio a
byte is calibrated on labelled rows that the models have not learned from, by a
logistic curve of two parameters.  A document's importance weight is
P(good | document) / P(good), and nothing else is rescaled.

Adding Gumbel noise to the log weights and taking the k largest draws k documents
without replacement in proportion to their weights.  k is, unless given, the
expected number of good documents, the sum of P over all rows.  Documents of like
weight are told apart by the noise alone.  A document outside the draw is rejected.

N-grams: hashed runs of four UTF-8 bytes, each counting a fourth as four of them
overlap in every byte, and the hashed difference of neighbouring words, which is
one bucket for all words that repeat at once.

Labelled rows are dealt by crc32(doc_id as text) mod 4: 0 and 1 teach the target's
model, 3 the curve, and 2 teach nothing, so that figures can be held out.  All labelled
rows of its parts teach each of the two; raw counts cover all rows.  Up to ``FEW_LABELS``
labels (they are counted first) are broadcast; of more a bitmap of fixed size screens the
rows whose texts are shuffled.  The curve of more rows than that is fitted by sums that
Spark takes.  What reaches the driver has a fixed size: one count for each of
2 x ``BUCKETS`` buckets, the bitmap, and at most ``FEW_LABELS`` ratios.

Defined results: null and empty texts have a null key and are rejected; labels with
null fields are ignored, and so is a doc_id with labels of both kinds; where the
curve cannot be learned, for want of rows of either kind, every document has
weight 1 (log 0) and all that are not empty stay, as in an empty table; repeated
rows are decided alike; ties at the threshold all stay; very long texts are read
whole; further columns, whatever their names, are returned as they came.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, bytes_of, join_counted, packed, row_slices, staged, unstage, whole_text

BUCKETS = 1 << 14
GRAM_BYTES = 4
#: Up to so many labels are broadcast, and so many ratios fitted on the driver.
FEW_LABELS = 20_000
#: The bitmap of labelled doc_ids has at most 2 to this power bits, else 16 to 32 for each label.
MOST_BITS = 26
SMOOTHING = 5.0
SLOPE_PRIOR = 0.01
SEED = 20
SLICE_BYTES = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_SHIFT = np.uint64(64 - 14)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def grams(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and rows of the byte n-grams, and of the word differences, of one row group."""
    first = int(bounds[0])
    raw, bounds = raw[first : bounds[-1]], bounds - first
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    wide = raw.astype(np.uint64)
    n = max(0, len(raw) - GRAM_BYTES + 1)
    code = np.zeros(n, np.uint64)
    for k in range(GRAM_BYTES):
        code = (code << np.uint64(8)) | wide[k : k + n]
    inside = row[:n] == row[GRAM_BYTES - 1 :] if n else np.zeros(0, bool)
    byte_bucket = ((code[inside] * _MIX) >> _SHIFT).astype(np.int64)
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | (row[1:] != row[:-1])
    starts = np.flatnonzero(begins)
    if len(starts) < 2:
        return byte_bucket, row[:n][inside], np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.cumsum(begins) - 1
    place = np.arange(len(raw)) - starts[np.maximum(word, 0)]
    powers = np.multiply.accumulate(np.full(256, _BASE, np.uint64))
    value = np.where(solid, (wide + np.uint64(1)) * powers[place & 255], np.uint64(0))
    hashed = np.add.reduceat(value, starts) * _MIX
    of = row[starts]
    same = of[1:] == of[:-1]
    step = (hashed[1:] - hashed[:-1])[same]
    step ^= step >> np.uint64(29)
    return byte_bucket, row[:n][inside], ((step * _MIX) >> _SHIFT).astype(np.int64), of[1:][same]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * BUCKETS, np.int64)
    for batch in batches:
        raw, bounds = bytes_of(batch.column(0))
        for at, to in row_slices(bounds, SLICE_BYTES):
            bytes_, _, words, _ = grams(raw, bounds[at : to + 1])
            total[:BUCKETS] += np.bincount(bytes_, minlength=BUCKETS)
            total[BUCKETS:] += np.bincount(words, minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, good, part and n (rows of docs) of all usable labels of docs, written."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    known = known.select("doc_id", (F.col("q") == 1).alias("good"), (F.crc32(F.col("doc_id").cast("string")) % 4).alias("part"))
    return staged(known.where("part <> 2").join(docs.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id"), "labels")


def _screened(rows: DataFrame, known: DataFrame, many: int) -> DataFrame:
    """The rows whose doc_id is in known, and few others: those with a bit of known in a bitmap of hashes."""
    power = max(16, min(MOST_BITS, (16 * many).bit_length()))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - power)

    def marked(batches):
        bits = np.zeros(1 << power, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    bits = np.zeros(1 << power >> 3, np.uint8)
    for r in known.select(place.alias("place")).coalesce(16).mapInArrow(marked, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r["bits"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def held(places: pa.Array) -> pa.Array:
        at = places.to_numpy()
        return pa.array((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    return rows.where(held(place))


def _with_labels(rows: DataFrame, known: DataFrame, screen: bool = False) -> DataFrame:
    """Inner join of rows with labels by doc_id; with ``screen`` rows are sorted out before a shuffle."""
    many = known.count()
    if many <= FEW_LABELS:
        return rows.join(F.broadcast(known.drop("n")), "doc_id")
    return join_counted(_screened(rows, known, many) if screen else rows, known, ["doc_id"], drop=("n",))


def learn(docs: DataFrame, known: DataFrame) -> np.ndarray:
    """Log ratio of target to raw for each bucket, from docs and the rows of ``labelled``."""
    bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", whole_text().alias("text"))
    good = _with_labels(texts, known.where("good AND part <= 1").select("doc_id", "n"), True)
    counts = [rows.select("text").mapInArrow(_count, "bucket int, n bigint").withColumn("kind", F.lit(k)) for k, rows in enumerate((texts, good))]
    sums = counts[0].unionByName(counts[1]).groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((2, 2 * BUCKETS))
    table[sums.kind.to_numpy(int), sums.bucket.to_numpy(int)] = sums.n.to_numpy(float)
    return log_ratio(table)


def log_ratio(table: np.ndarray) -> np.ndarray:
    """Of raw and target counts by bucket: the log ratio, drawn together where there are few of both."""
    out = np.zeros(2 * BUCKETS)
    for part, share in ((slice(0, BUCKETS), 1 / GRAM_BYTES), (slice(BUCKETS, 2 * BUCKETS), 1.0)):
        raw, target = table[:, part]
        if target.sum():
            out[part] = share * np.log((target + SMOOTHING) / (raw * (target.sum() / raw.sum()) + SMOOTHING))
    return out


def _newton(sums: Callable, rounds: int) -> np.ndarray:
    """The coefficients of least loss; ``sums`` gives the loss at some, its slope and its bend over all rows.

    A weak normal prior on the second (``SLOPE_PRIOR``) lets the least exist where the kinds do not overlap.
    """
    held = np.diag([0.0, SLOPE_PRIOR])

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, slope, bend = sums(beta)
        return loss + beta @ held @ beta / 2, slope + held @ beta, bend + held

    beta = np.zeros(2)
    loss, slope, bend = at(beta)
    for _ in range(rounds):
        step = -np.linalg.solve(bend + 1e-9 * np.eye(2), slope)
        if np.abs(step).max() < 1e-10:
            return beta + step
        size, now = 1.0, at(beta + step)
        while size > 1e-6 and now[0] > loss:
            size /= 2
            now = at(beta + size * step)
        beta, (loss, slope, bend) = beta + size * step, now
        if np.abs(size * step).max() < 1e-10:
            break
    return beta


def curve(rate: np.ndarray, good: np.ndarray, rounds: int = 100) -> tuple[float, float, float] | None:
    """(a, b, P(good)) with P(good | rate) = 1 / (1 + exp(-a - b x rate)); None without rows of both kinds.

    Fitted by Newton steps over ratios in standard deviations; never falling.
    """
    yes, no = int(good.sum()), int((~good).sum())
    if not yes or not no:
        return None
    middle, width = rate.mean(), rate.std() or 1.0
    x, goal = np.stack([np.ones(len(rate)), (rate - middle) / width], 1), good.astype(float)

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        t = x @ beta
        p = 1 / (1 + np.exp(-t))
        return float(np.logaddexp(0, t).sum() - goal @ t), x.T @ (p - goal), (x * (p * (1 - p))[:, None]).T @ x

    return _line(_newton(sums, rounds), middle, width, yes / (yes + no))


def _line(beta: np.ndarray, middle: float, width: float, prior: float) -> tuple[float, float, float]:
    b = max(0.0, beta[1]) / width
    return float(beta[0] - b * middle), float(b), prior


def curve_of(known: DataFrame, rounds: int = 100) -> tuple[float, float, float] | None:
    """``curve`` of the rows (_rate, good) of a written table, by sums that Spark takes."""
    n, yes, middle, width = known.agg(F.count("*"), F.count(F.when(F.col("good"), 1)), F.avg("_rate"), F.stddev_pop("_rate")).first()
    if not yes or yes == n:
        return None
    width = width or 1.0
    x, goal = (F.col("_rate") - F.lit(middle)) / F.lit(width), F.col("good").cast("double")

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        t = F.lit(float(beta[0])) + F.lit(float(beta[1])) * x
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-t))
        loss = F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t))) - goal * t
        rows = known.select(x.alias("x"), (p - goal).alias("g"), (p * (F.lit(1.0) - p)).alias("h"), loss.alias("loss"))
        loss, g, gx, h, hx, hxx = rows.agg(F.sum("loss"), F.sum("g"), F.sum(F.col("g") * F.col("x")), F.sum("h"), F.sum(F.col("h") * F.col("x")), F.sum(F.col("h") * F.col("x") * F.col("x"))).first()
        return loss, np.array([g, gx]), np.array([[h, hx], [hx, hxx]])

    return _line(_newton(sums, rounds), middle, width, yes / n)


def rate_of(spark: SparkSession, ratio: np.ndarray, text: Column) -> Column:
    """The log ratio of a text a byte, as a double column."""
    shared = spark.sparkContext.broadcast(ratio)

    @F.arrow_udf("double")
    def weigh(column: pa.Array) -> pa.Array:
        raw, bounds = bytes_of(column)
        ratio, out = shared.value, np.zeros(len(bounds) - 1)
        for at, to in row_slices(bounds, SLICE_BYTES):
            bytes_, rows, words, word_rows = grams(raw, bounds[at : to + 1])
            for shift, bucket, of in ((0, bytes_, rows), (BUCKETS, words, word_rows)):
                out[at:to] += np.bincount(of, ratio[shift + bucket], minlength=to - at)
        return pa.array(out / np.maximum(np.diff(bounds), 1))

    return weigh(text)


def kth_largest(keys: DataFrame, name: str, k: int, few: int = 4_096) -> float:
    """Exact k-th largest non-null value: counts over ever finer bins, then the last few values."""
    low, high, n = keys.agg(F.min(name), F.max(name), F.count(name)).first()
    if k <= 0 or not n:
        return float("inf")
    k = min(k, n)
    while True:
        part = keys.where(F.col(name).between(low, high))
        if n <= few or low == high:
            values = sorted((r[0] for r in part.select(name).limit(few + k).collect()), reverse=True) if low < high else [low]
            return values[k - 1] if low < high else low
        width = (high - low) / 1024
        bins = F.least(F.floor((F.col(name) - low) / F.lit(width)), F.lit(1023))
        counts = part.groupBy(bins.alias("b")).agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).orderBy(F.desc("b")).collect()
        for b in counts:
            if k <= b["n"]:
                low, high, n = b["low"], b["high"], b["n"]
                break
            k -= b["n"]


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> tuple[float, DataFrame]:
    """The threshold of the draw, and docs (doc_id, text, ...) with log_weight and gumbel_key; each text is scored once."""
    spark = docs.sparkSession
    known = labelled(docs, labels)
    ratio = learn(docs, known)
    # The noise is a function of (doc_id, text).
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11)
    noise = -F.log(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))))
    rated = staged(docs.withColumns({"_rate": rate_of(spark, ratio, whole_text()), "_noise": F.when(F.length(whole_text()) > 0, noise)}), "quality", "zstd")
    taught = known.where("part = 3").select("doc_id", "good", "n")
    many = taught.agg(F.sum("n")).first()[0] or 0
    rates = _with_labels(rated.select("doc_id", "_rate"), taught).select("_rate", "good")
    if many <= FEW_LABELS:
        got = rates.toPandas()
        fit = curve(got["_rate"].to_numpy(float), got["good"].to_numpy(bool))
    else:
        rates = staged(rates, "rates")
        fit = curve_of(rates)
        unstage(rates)
    unstage(known)
    weight = F.lit(0.0)
    if fit:
        a, b, prior = fit
        weight = -F.log1p(F.exp(-(F.lit(a) + F.lit(b) * F.col("_rate")))) - F.lit(float(np.log(prior)))
    keys = rated.withColumn("log_weight", weight).withColumn("gumbel_key", F.col("log_weight") + F.col("_noise")).drop("_rate", "_noise")
    if k is None:
        k = keys.where("gumbel_key IS NOT NULL").agg(F.sum(F.exp("log_weight"))).first()[0] or 0.0
        k = round(k * (fit[2] if fit else 1.0))
    return kth_largest(keys, "gumbel_key", k), keys


def quality_report(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    least, keys = resample(docs.select("doc_id", "text"), labels, seed=seed)
    return keys.select("doc_id", "log_weight", "gumbel_key", F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents in the draw, with the columns they came with."""
    least, keys = resample(packed(docs, "doc_id", "text"), labels)
    return keys.where(F.col("gumbel_key") >= F.lit(least)).select("row.*")
