"""Annotations: latest-wins merges, quote anchoring and relocation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.shipping import arrow_udf, ship


def merge_highlights(local: DataFrame, incoming: DataFrame, key: list[str], stamp: str, order: str | None = None) -> DataFrame:
    """The newest record of each key, and ``changed``: whether it is one that came in.

    Of equal stamps a local record stays; within a side the one that arrived first by
    ``order``, a numeric column, or without it the greatest row.
    """
    both = local.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    row = F.struct(*local.columns)
    rank = F.struct(F.col(stamp), -F.col("_side"), -F.col(order) if order else row.alias("row"))
    best = both.groupBy(*key).agg(F.max_by(F.struct(row.alias("r"), "_side"), rank).alias("b"))
    return best.select("b.r.*", (F.col("b._side") == 1).alias("changed"))


BOOKMARK_KEYS = ("title", "section_index", "char_offset")


def merge_bookmarks(records: DataFrame, owner: str) -> DataFrame:
    """Bookmarks meet by title or by position; the newest of a group stays.

    records: owner, appearance (order of arrival), title, section_index, char_offset, created_at.
    A key is known only from the record that opened its group, so grouping is
    sequential by owner and runs as one function for each owner's few records.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        groups: list[list[int]] = []
        known: dict[tuple, int] = {}
        rows = rows.sort_values("appearance").reset_index(drop=True)
        for k, r in enumerate(rows.itertuples(index=False)):
            keys = [("title", r.title), ("position", r.section_index, r.char_offset)]
            met = [known[x] for x in keys if x in known]
            if met:
                groups[min(met)].append(k)
            else:
                known.update(dict.fromkeys(keys, len(groups)))
                groups.append([k])
        best = [max(g, key=lambda k: (rows.created_at[k], -k)) for g in groups]
        return rows.loc[best].sort_values(["section_index", "char_offset", "appearance"], kind="stable")

    ship(records.sparkSession)
    return records.groupBy(owner).applyInPandas(run, records.schema)


#: Quotes up to this number are sought by a broadcast of their hashes (eight bytes each, so 8 MB at most); more by a shuffle.
BROADCAST_QUOTES = 1_000_000


def exact_quotes(quotes: DataFrame, texts: DataFrame, quote: str = "quote", text: str = "text", words: int = 6) -> DataFrame:
    """All columns of both with start (0-based) of every occurrence of each quote in each text.

    The first and last word of a quote may be parts of a text's words; those between
    are whole.  Every text that holds a quote of eight words or more holds the run of
    six that follows its first word, and one that holds a quote of three to seven words
    holds its longest inner word: the join is on the hashes of these, and the whole
    quote is then verified.  Only quotes of one or two words are compared with every text.
    """
    split = lambda c: F.split(F.btrim(c, F.lit(" \t\n\r\f\x0b")), r"[ \t-\r]+")
    hashes = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    run = lambda h, k: F.xxhash64(*[F.get(h, k + i) for i in range(words)])
    q = quotes.withColumn("_w", split(F.col(quote))).withColumn("_q", F.xxhash64(quote))
    size = F.size("_w")
    inner = F.slice("_w", 2, F.greatest(size - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    seed = F.when(size >= words + 2, run(hashes(F.col("_w")), F.lit(1))).when(size > 2, F.xxhash64(longest))
    sought = q.where(size > 2).select("_q", seed.alias("_seed"), (size >= words + 2).alias("_run")).distinct()
    t = texts.withColumn("_t", F.xxhash64(text))
    kinds = {r["_run"] for r in sought.select("_run").distinct().collect()}
    found = None
    if kinds:
        small = sought.count() <= BROADCAST_QUOTES
        starts = F.sequence(F.lit(0), F.greatest(F.size("_h") - words, F.lit(0)))
        seeds = F.array_distinct(F.concat(*([F.transform(starts, lambda k: run(F.col("_h"), k))] if True in kinds else []), *([F.col("_h")] if False in kinds else [])))
        held = t.select("_t", hashes(split(F.col(text))).alias("_h")).select("_t", F.explode(seeds).alias("_seed"))
        # Only hashes are exploded and joined; texts and quotes come back to the pairs that share one.
        pairs = held.join(F.broadcast(sought) if small else sought, "_seed").select("_q", "_t").distinct()
        found = pairs.join(q.where(size > 2).drop("_w"), "_q").join(t, "_t").drop("_q", "_t").where(F.col(text).contains(F.col(quote)))
    few = q.where(size <= 2).drop("_w", "_q")
    if found is None or not few.isEmpty():
        met = few.join(texts, texts[text].contains(few[quote]))
        found = met if found is None else found.unionByName(met)
    return found.withColumn("start", F.explode(occurrences(F.col(text), F.col(quote))))


def _all_starts(texts: pa.Array, quotes: pa.Array) -> pa.Array:
    out = []
    for text, quote in zip(texts.to_pylist(), quotes.to_pylist()):
        at, own = -1, []
        while quote and text and (at := text.find(quote, at + 1)) >= 0:
            own.append(at)
        out.append(own)
    return pa.array(out, pa.list_(pa.int32()))


def occurrences(text: Column, quote: Column) -> Column:
    """array<int>: every start, overlapping ones too."""
    return arrow_udf(_all_starts, "array<int>")(text, quote)


def context_score(text: Column, start: Column, end: Column, before: Column, after: Column) -> Column:
    """Characters of the context that match: the end of what precedes and the start of what follows."""
    left = F.substr(text, F.greatest(start - F.length(before) + 1, F.lit(1)), F.least(start, F.length(before)))
    right = F.substr(text, end + 1, F.length(after))
    def run(a: Column, b: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
        miss = F.array_min(F.filter(places, lambda k: F.substr(a, k, F.lit(1)) != F.substr(b, k, F.lit(1))))
        return F.when(F.least(F.length(a), F.length(b)) == 0, 0).otherwise(F.coalesce(miss - 1, F.least(F.length(a), F.length(b))))
    return run(F.reverse(left), F.reverse(before)) + run(right, after)


def relocate(found: DataFrame, key: str, section: str, home: str, score: Column) -> DataFrame:
    """The best occurrence of each anchor: its own section first, then the score, then the earliest."""
    order = [F.desc(F.col(section) == F.col(home)), F.desc("score"), section, "start"]
    ranked = found.withColumn("score", score).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_r = 1").drop("_r")


def outcomes(anchors: DataFrame, found: DataFrame, key: str, score: Column) -> DataFrame:
    """key, outcome (resolved, ambiguous, missing), n: ties of the best score are ambiguous."""
    best = found.withColumn("score", score).withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.desc("score")))).where("_r = 1")
    n = best.groupBy(key).agg(F.count("*").alias("n"))
    outcome = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return anchors.select(key).join(n, key, "left").select(key, outcome.alias("outcome"), F.coalesce("n", F.lit(0)).alias("n"))


def semi_global(quote: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best place of quote in text within ``most`` edits; the leftmost of equals.

    Columns of the edit table are kept as bits of their differences (Myers).
    """
    best = end = None
    for at, cost in enumerate(_last_row(quote, text, 0), 1):
        if cost <= most and (best is None or cost < best):
            best, end = cost, at
    if best is None:
        return None
    # From the end backwards the place must begin at once; the longest of equal cost begins leftmost.
    back = text[max(0, end - len(quote) - best) : end][::-1]
    size = max((k for k, cost in enumerate(_last_row(quote[::-1], back, 1), 1) if cost == best), default=0)
    return best, end - size, end


def _last_row(quote: str, text: str, step: int) -> Iterator[int]:
    """The edit distance of quote to what ends after each character of text; ``step`` is the cost of each character skipped before it."""
    full = (1 << len(quote)) - 1
    top = len(quote) - 1
    has: dict[str, int] = {}
    for k, char in enumerate(quote):
        has[char] = has.get(char, 0) | 1 << k
    up, down, cost = full, 0, len(quote)
    for char in text:
        eq = has.get(char, 0)
        x = eq | down
        d = ((eq & up) + up ^ up) | eq
        right, left = down | ~(d | up) & full, up & d
        cost += (right >> top & 1) - (left >> top & 1) if quote else step
        right, left = (right << 1 | step) & full, left << 1 & full
        up, down = left | ~(x | right) & full, right & x
        yield cost


#: Size of the bitmap of the quotes' grams that screens the texts' own.
SCREEN_BITS = 1 << 23
_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_hashes(text: str, size: int) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` characters at every place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(0, len(codes) - size + 1)
    value = np.full(n, size, np.uint64)
    for k in range(size):
        value += codes[k : k + n].astype(np.uint64) * _FACTORS[k]
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(27))


def _sampled_places(n: int, size: int, most: int) -> list[int]:
    """Where a quote of ``n`` characters is sampled: evenly, first and last run among them."""
    return [0] if n <= size or most == 1 else sorted({k * (n - size) // (most - 1) for k in range(most)})


def approximate_places(quotes: DataFrame, texts: DataFrame, key: str, text_key: str, quote: str = "quote", text: str = "text", grams: int = 8, gram: int = 8, most: int = 8) -> DataFrame:
    """key, text_key, distance, start, end: approximate places of each quote, the best of each window.

    Up to ``grams`` evenly spaced runs of ``gram`` characters of a quote (the whole
    quote if it is no longer) are looked up at every place of the texts.  Hits within
    2 * ``most`` + 1 of each other on the diagonal make a window if there are two of
    them, or one for quotes of one run, and only windows are compared by edit distance.
    A place whose edits spoil all but one of its quote's runs is not found.

    Of the texts' runs only hashes travel, and only those that a bitmap of the quotes' lets through.
    """
    name = dict(quotes.dtypes)[key], dict(texts.dtypes)[text_key]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, q in zip(*(c.to_pylist() for c in batch.columns)):
                places = _sampled_places(len(q), gram, grams)
                size = min(gram, len(q))
                hashes = _gram_hashes(q, size)[places].view(np.int64).tolist()
                out += [(a, size, 1 if len(places) == 1 else 2, at, h) for at, h in zip(places, hashes)]
            columns = list(zip(*out)) or [()] * 5
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [key, "size", "votes", "at", "g"])

    own = quotes.where(F.length(quote) > 0).select(key, quote)
    sampled = own.mapInArrow(sample, f"`{key}` {name[0]}, size int, votes int, at int, g bigint")
    bit = F.pmod("g", F.lit(SCREEN_BITS))
    bits = sampled.groupBy("size", F.floor(bit / 8).alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(pmod(g, {SCREEN_BITS}) % 8 as int))")).alias("bits")).collect()
    sizes = sorted({r["size"] for r in bits})
    screen = np.zeros(SCREEN_BITS // 8, np.uint8)
    for r in bits:
        screen[r["byte"]] |= r["bits"]
    packed = screen.tobytes()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(packed, np.uint8)
        for batch in batches:
            for a, t in zip(*(c.to_pylist() for c in batch.columns)):
                for size in sizes:
                    hashes = _gram_hashes(t, size)
                    low = hashes.view(np.int64) % SCREEN_BITS
                    places = np.flatnonzero(held[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                    if len(places):
                        columns = [pa.array([a] * len(places), batch.schema.field(0).type), pa.array(places.astype(np.int32)), pa.array(hashes[places].view(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, [text_key, "place", "g"])

    ship(texts.sparkSession)
    met = texts.where(F.col(text).isNotNull()).select(text_key, text).mapInArrow(look, f"`{text_key}` {name[1]}, place int, g bigint").join(sampled, "g")
    diagonals = met.groupBy(key, text_key).agg(F.max("votes").alias("votes"), F.sort_array(F.collect_list(F.col("place") - F.col("at"))).alias("places")).where(F.size("places") >= F.col("votes"))
    seeds = diagonals.select(key, text_key, F.explode(arrow_udf(_windows(most), "array<struct<low: int, high: int>>")("places", "votes")).alias("w"))
    start = F.greatest(F.col("w.low") - most, F.lit(0))
    near = seeds.join(own, key).join(texts.select(text_key, text), text_key)
    near = near.select(key, text_key, quote, start.alias("from"), F.substr(text, start + 1, F.col("w.high") + F.length(quote) + most - start).alias("window"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, q_, low, window in zip(*(c.to_pylist() for c in batch.columns)):
                if hit := semi_global(q_, window, most):
                    out.append((a, b, hit[0], low + hit[1], low + hit[2]))
            columns = list(zip(*out)) or [()] * 5
            kinds = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [key, text_key, "distance", "start", "end"])

    return near.mapInArrow(verify, f"`{key}` {name[0]}, `{text_key}` {name[1]}, distance int, start int, end int").distinct()


def _windows(most: int):
    """First and last diagonal of each run of hits that is dense enough."""
    def run(places: pa.Array, votes: pa.Array) -> pa.Array:
        out = []
        for own, least in zip(places.to_pylist(), votes.to_pylist()):
            groups: list[list[int]] = []
            for x in own:
                if groups and x - groups[-1][0] <= 2 * most + 1:
                    groups[-1].append(x)
                else:
                    groups.append([x])
            out.append([{"low": g[0], "high": g[-1]} for g in groups if len(g) >= least])
        return pa.array(out, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))

    return run


def fuzzy_quotes(quotes: DataFrame, texts: DataFrame, key: str, text_key: str, quote: str = "quote", text: str = "text", grams: int = 8, gram: int = 8, most: int = 8) -> DataFrame:
    """key, text_key, distance, start, end: the best approximate place of each quote."""
    hits = approximate_places(quotes, texts, key, text_key, quote, text, grams, gram, most)
    return hits.groupBy(key).agg(F.min(F.struct("distance", text_key, "start", "end")).alias("b")).select(key, "b.*")
