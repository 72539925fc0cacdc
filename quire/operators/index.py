"""Positional inverted index and ranked queries.

The index is three tables: ``postings(section key, term, starts, ends)`` with one
row for each section and term, ``stats(section key, tokens)`` and, once stored, the
vocabulary ``terms(term, df, tf)``.  Terms are found and grouped section by section
as texts are read, so building shuffles nothing; a stored index
(``quire.sinks.index_store``) is sorted by term, and a query reads only the row
groups of its terms.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.shipping import arrow_udf

K, B, DELTA = 1.2, 0.7, 0.5
EXACT, PREFIX, FUZZY = 1.0, 0.375, 0.45
TOKENS = "array<struct<term: string, start: int, end: int>>"
#: Letters that fold to two letters or have no base letter in Unicode (fixed values).
SPECIAL_FOLDS = {"ß": "ss", "ẞ": "ss", "Þ": "th", "þ": "th", "æ": "ae", "ð": "d", "Ĳ": "ij", "ĳ": "ij", "Ŋ": "ng", "ŋ": "ng", "Œ": "oe", "œ": "oe", "Đ": "d", "đ": "d", "Ħ": "h", "ħ": "h", "ı": "i", "Ł": "l", "ł": "l", "Ŀ": "l", "ŀ": "l", "Ŧ": "t", "ŧ": "t", "Ø": "o", "ø": "o", "ſ": "s", "ª": "a", "º": "o"}
#: Accented Greek small letters and their vowels (fixed values); capitals only lose their case.
GREEK_FOLDS = {"ΐ": "ί", "ί": "ί", "ά": "α", "έ": "ε", "ή": "η", "ΰ": "υ", "ς": "σ", "ό": "ο", "ύ": "υ", "ώ": "ω"}


@dataclass(frozen=True)
class Limits:
    max_matches: int = 200
    max_expansions: int = 200
    max_query_tokens: int = 32
    max_term_length: int = 64
    max_fuzzy_distance: int = 6


@lru_cache(maxsize=70_000)
def classify(char: str) -> str | None:
    """What a character adds to a term: '' if it is ignored, None if it ends the term."""
    code = ord(char)
    if code < 0x80:
        return char.lower() if char.isalnum() or char == "_" else None
    if code > 0xFFFF:
        return char
    category = unicodedata.category(char)
    if code == 0xAD or category == "Mn" or category == "Cf" and code >= 0x2000:
        return ""
    if char in SPECIAL_FOLDS:
        return SPECIAL_FOLDS[char]
    if code in (0x85, 0x1680, 0x3000) or category[0] == "Z":
        return None
    if code < 0x180 or 0x1E00 <= code <= 0x1EFF:
        if category[0] != "L":
            return None
        return unicodedata.normalize("NFD", char)[0].lower() if char != "µ" else char
    if 0x370 <= code <= 0x3FF:
        return GREEK_FOLDS.get(char, char.lower()) if category[0] in "LN" else None
    if 0x400 <= code <= 0x52F:
        return char.lower() if category[0] == "L" and char != "Ӏ" else char if category[0] == "L" else None
    if 0x2000 <= code <= 0x2BFF:
        return char if 0x2160 <= code <= 0x2188 else None
    if 0x2E00 <= code <= 0x2E7F or 0x3000 <= code <= 0x303F:
        return char if 0x3005 <= code <= 0x3007 else None
    if 0xFF00 <= code <= 0xFFEF:
        if (wide := unicodedata.normalize("NFKC", char)).isascii() and wide.isalnum():
            return wide.lower()
        return char if 0xFF66 <= code <= 0xFFDC else None
    return char


def tokenize_text(text: str) -> list[tuple[str, int, int]]:
    """(term, start, end) of each run of word characters, folded; ignored characters do not split a run."""
    out, term, begin, n = [], [], -1, 0
    for n, char in enumerate(text):
        kind = classify(char)
        if kind is None:
            if begin >= 0:
                out.append(("".join(term), begin, n))
                term, begin = [], -1
        elif kind:
            begin = n if begin < 0 else begin
            term.append(kind)
    if begin >= 0:
        out.append(("".join(term), begin, len(text)))
    return out


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``classify`` as tables by code point: 0 ends a term, 1 is ignored, 2 and 3 add one and two letters; and these letters."""
    kind, first, second = np.full(0x110000, 2, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint32)
    for code in range(0x10000):
        adds = classify(chr(code)) if not 0xD800 <= code < 0xE000 else None
        kind[code] = 0 if adds is None else 1 + len(adds)
        if adds:
            first[code], second[code] = ord(adds[0]), ord(adds[-1])
    return kind, first, second


def token_arrays(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, start, end) of all tokens of a column of texts (null: none), in order; equal to ``tokenize_text`` text by text."""
    kind, first, second = _classes()
    texts = column.fill_null("").to_pylist()
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1].astype(np.int64)
    of = kind[codes]
    solid = np.concatenate(([False], of > 0, [False]))
    run_starts, run_ends = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(solid[:-1] & ~solid[1:])
    places = np.flatnonzero(of > 1)
    head, tail = np.searchsorted(places, run_starts), np.searchsorted(places, run_ends)
    full = tail > head  # runs of ignored characters alone are no token
    head, run_ends = head[full], run_ends[full]
    start = places[head] if len(head) else np.zeros(0, np.int64)
    # All letters of all terms in one text; a term is a part of it.
    letters = codes[places]
    adds = of[places].astype(np.int64) - 1
    ends = np.cumsum(adds)
    out = np.repeat(first[letters], adds)
    out[ends[adds == 2] - 1] = second[letters[adds == 2]]
    width = 1 + (out >= 0x80).astype(np.int64) + (out >= 0x800) + (out >= 0x10000)
    offsets = np.concatenate(([0], np.cumsum(width)))
    at = np.concatenate(([0], ends))[np.append(head, len(places))]
    data = out.astype("<u4").tobytes().decode("utf-32-le").encode()
    terms = pa.StringArray.from_buffers(len(head), pa.py_buffer(offsets[at].astype(np.int32)), pa.py_buffer(data))
    row = np.searchsorted(begins, start, "right") - 1
    return terms, row, (start - begins[row]).astype(np.int32), (run_ends - begins[row]).astype(np.int32)


SLICE_CHARS = 1 << 20


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """Parts of about ``SLICE_CHARS`` bytes (one text at least), so that temporaries stay small."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy())
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_CHARS, "right")))
        yield column.slice(at, to - at)
        at = to


def _tokens_of(column: pa.Array) -> pa.Array:
    terms, row, start, end = token_arrays(column)
    offsets = np.searchsorted(row, np.arange(len(column) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([terms, pa.array(start), pa.array(end)], ["term", "start", "end"]))


def _tokens(column: pa.Array) -> pa.Array:
    parts = [_tokens_of(part) for part in _slices(column)]
    return pa.concat_arrays(parts) if parts else _tokens_of(column)


def _postings_of(column: pa.Array) -> pa.Array:
    terms, row, start, end = token_arrays(column)
    coded = terms.dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.lexsort((start, code, row))
    row, code = row[order], code[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    heads = np.flatnonzero(fresh)
    places = pa.array(np.append(heads, len(row)).astype(np.int32))
    fields = [coded.dictionary.take(pa.array(code[heads])), pa.ListArray.from_arrays(places, pa.array(start[order])), pa.ListArray.from_arrays(places, pa.array(end[order]))]
    postings = pa.StructArray.from_arrays(fields, ["term", "starts", "ends"])
    bounds = np.arange(len(column) + 1)
    counts = np.diff(np.searchsorted(row, bounds)).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(counts), pa.ListArray.from_arrays(pa.array(np.searchsorted(row[heads], bounds).astype(np.int32)), postings)], ["tokens", "postings"])


def _postings(column: pa.Array) -> pa.Array:
    parts = [_postings_of(part) for part in _slices(column)]
    return pa.concat_arrays(parts) if parts else _postings_of(column)


def tokenize(text: Column) -> Column:
    """The folding tokenizer, with spans."""
    return arrow_udf(_tokens, TOKENS)(text)


POSTINGS = "struct<tokens: int, postings: array<struct<term: string, starts: array<int>, ends: array<int>>>>"


def posted(text: Column) -> Column:
    """The number of tokens, and each term with its spans."""
    return arrow_udf(_postings, POSTINGS)(text)


def native_terms(text: Column) -> Column:
    """array<string>: lower-cased word runs without folds and spans, all in the JVM."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def build(sections: DataFrame, keys: list[str], text: str = "text", limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(postings, stats); over-long terms are counted in stats but not posted.

    Both read the texts.  ``index_store.write`` reads them once and gives tables that queries read by term.
    """
    own = sections.select(*keys, posted(F.col(text)).alias("p"))
    return unfolded(own, keys, limits), own.select(*keys, F.col("p.tokens").cast("bigint").alias("tokens"))


def unfolded(own: DataFrame, keys: list[str], limits: Limits = Limits()) -> DataFrame:
    """Postings of sections whose ``p`` is their ``posted`` text."""
    return own.select(*keys, F.explode("p.postings").alias("t")).select(*keys, "t.*").where(F.length("term") <= limits.max_term_length)


def vocabulary(postings: DataFrame) -> DataFrame:
    """term, df (sections that hold it) and tf (all its occurrences)."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("starts")).alias("tf"))


def bm25_plus(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    idf = F.log1p((n - df + 0.5) / (df + 0.5))
    score = idf * (DELTA + tf * (K + 1) / (tf + K * (1 - B + B * length / average)))
    return F.when((n <= 0) | (average <= 0) | (df <= 0), F.lit(0.0)).otherwise(score)


def fuzzy_distance(length: Column, cap: int = 6) -> Column:
    return F.least(F.round(length * 0.2), F.lit(cap)).cast("int")


def expand(terms: DataFrame, tokens: list[str], mode: str = "exact", limits: Limits = Limits()) -> list[tuple[int, str, float]]:
    """(token number, term, weight); only the last token takes the mode. More terms than the cap is an error.

    ``terms`` is the vocabulary or, where there is none, the postings.  The cap bounds what comes to the driver, so the terms can then be literals that reach the scan of the postings.
    """
    out = [(k, t, EXACT) for k, t in enumerate(tokens)]
    last, term, size = tokens[-1], F.col("term"), F.length("term")
    most = min(round(len(last) * 0.2), limits.max_fuzzy_distance)
    if mode == "prefix":
        extra = size - len(last)
        grown = terms.where(term.startswith(last) & (extra > 0)).select("term", (PREFIX * extra / (extra + 0.3 * extra)).alias("weight"))
    elif mode == "fuzzy" and most > 0:
        off = F.levenshtein(term, F.lit(last), most)
        band = size.between(len(last) - most, len(last) + most)
        grown = terms.where(band & (off > 0)).select("term", (FUZZY * size / (size + off)).alias("weight"))
    else:
        return out
    found = grown.distinct().limit(limits.max_expansions + 1).collect()
    if len(found) > limits.max_expansions:
        raise ValueError(f"{last!r} expands past {limits.max_expansions} terms")
    return out + [(len(tokens) - 1, r["term"], r["weight"]) for r in found]


def _query_tokens(query: str, limits: Limits) -> list[str]:
    tokens = [t for t, _, _ in tokenize_text(query.strip()) if t]
    if len(tokens) > limits.max_query_tokens:
        raise ValueError("too many tokens in the query")
    return tokens


def _ranked(postings: DataFrame, stats: DataFrame, keys: list[str], tokens: list[str], terms: list[tuple[int, str, float]]) -> DataFrame:
    weights = F.broadcast(stats.sparkSession.createDataFrame(terms, "token_no int, term string, weight double"))
    tf = postings.where(F.col("term").isin(*{t for _, t, _ in terms})).select(*keys, "term", F.size("starts").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # a row for each of the capped terms
    corpus = stats.agg(F.count("*").alias("n"), F.avg("tokens").alias("average"))
    scored = tf.join(F.broadcast(df), "term").join(weights, "term").join(stats, keys).join(F.broadcast(corpus))
    part = F.col("weight") * bm25_plus(F.col("tf"), F.col("df"), F.col("n"), F.col("tokens"), F.col("average"))
    by_section = scored.groupBy(*keys).agg(F.sum(part).alias("score"), F.countDistinct("token_no").alias("held"))
    return by_section.where(F.col("held") == len(tokens)).drop("held")


def ranked(postings: DataFrame, stats: DataFrame, keys: list[str], query: str, mode: str = "exact", limits: Limits = Limits(), terms: DataFrame | None = None) -> DataFrame:
    """keys and score of the sections that hold every token of the query; ``terms`` is the vocabulary, if there is one."""
    tokens = _query_tokens(query, limits)
    if not tokens:
        return stats.select(*keys, F.lit(0.0).alias("score")).limit(0)
    return _ranked(postings, stats, keys, tokens, expand(postings if terms is None else terms, tokens, mode, limits))


def search(postings: DataFrame, stats: DataFrame, keys: list[str], query: str, mode: str = "exact", limits: Limits = Limits(), terms: DataFrame | None = None) -> DataFrame:
    """keys, start, end, score of the best hits; hits stand on the first token's terms."""
    tokens = _query_tokens(query, limits)
    if not tokens:
        return stats.select(*keys, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("score")).limit(0)
    grown = expand(postings if terms is None else terms, tokens, mode, limits)
    scores = _ranked(postings, stats, keys, tokens, grown)
    hits = postings.where(F.col("term").isin(*{t for k, t, _ in grown if k == 0})).join(scores, keys)
    hits = hits.select(*keys, "score", F.explode(F.arrays_zip("starts", "ends")).alias("span"))
    return hits.select(*keys, F.col("span.starts").alias("start"), F.col("span.ends").alias("end"), "score").orderBy(F.desc("score"), *keys, "start", "end").limit(limits.max_matches)


def coverage(sections: DataFrame, terms: DataFrame, stats: DataFrame, text: str = "text", failed: Column | None = None) -> DataFrame:
    """eligible, indexed, failed and pending sections; tokens of all, occurrences and terms of the vocabulary.

    A section with stats is indexed.  Of the others those that ``failed`` tells (by default: without a text) have failed and the rest is pending.
    """
    keys = [c for c in stats.columns if c != "tokens"]
    failed = F.col(text).isNull() if failed is None else failed
    held = sections.select(*keys, failed.alias("failed")).join(stats.select(*keys, F.lit(True).alias("indexed")), keys, "left")
    is_in = F.coalesce("indexed", F.lit(False))
    a = held.agg(F.count("*").alias("eligible"), F.count_if(is_in & ~F.col("failed")).alias("indexed"), F.count_if("failed").alias("failed"), F.count_if(~is_in & ~F.col("failed")).alias("pending"))
    b = stats.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    c = terms.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("occurrences"), F.count("*").alias("terms"))
    return a.crossJoin(b).crossJoin(c).withColumn("is_complete", (F.col("failed") == 0) & (F.col("pending") == 0))


IDENTITY = ("tokenizer", "normalization", "profile", "publication")


def compatible(a: Column, b: Column) -> Column:
    """All four identity fields agree; a missing one agrees only with a missing one."""
    out = F.lit(True)
    for name in IDENTITY:
        out = out & a[name].eqNullSafe(b[name])
    return out
