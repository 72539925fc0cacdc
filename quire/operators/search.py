"""Full-text scan: four modes over a text column, with spans, snippets and limits.

A native predicate cuts the rows first; only rows that can match reach the
Arrow function that finds all spans, since no built-in returns match offsets.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.shipping import arrow_udf

MODES = ("contains", "whole_words", "regex", "proximity")
NEAR_CHARS = 60
CONTEXT_CHARS = 48
MAX_MATCHES = 200
_INVISIBLE = "[­​‌‍]?"
_OUTSIDE = r"[^\p{L}\p{N}_]"
SPANS = "array<struct<start: int, end: int>>"


def _literal(char: str) -> str:
    return "\\" + char if char in r"\.^$|?*+()[]{}-&~#" else char


def token_pattern(token: str, tolerant: bool = True) -> str:
    """A token as a pattern; a tolerant one ignores soft hyphens and quote styles and joins white space."""
    if not tolerant:
        return "".join(map(_literal, token))
    parts: list[str] = []
    for char in token:
        if char.isspace():
            if not parts or parts[-1] != r"\s+":
                parts.append(r"\s+")
        else:
            parts.append({'"': '["“”]', "'": "['‘’]"}.get(char, _literal(char)))
    return _INVISIBLE.join(parts)


def near_words(query: str, default: int = NEAR_CHARS) -> tuple[list[str], int]:
    """Words of a proximity query and the span it allows; digits at the end replace the default."""
    words, span = query.split(), default
    if len(words) > 1 and words[-1].isdigit():
        span = int(words.pop())
    return words, max(1, span)


class Query:
    """A compiled query: ``spans`` finds all matches, ``screen`` is a native pattern that every match satisfies."""

    def __init__(self, text: str, mode: str = "contains", case: bool = False, tolerant: bool = True, near_chars: int = NEAR_CHARS):
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        flags = regex.V0 | (0 if case else regex.IGNORECASE)
        text, self.words, self.bounded = text.strip(), None, mode in ("whole_words", "proximity")
        self.empty = not text
        java = "(?u)" if case else "(?iu)"
        if mode == "contains":
            body = token_pattern(text, tolerant)
        elif mode == "regex":
            body, flags, java = text, flags | regex.MULTILINE, java[:-1] + "m)"
        elif mode == "whole_words":
            body = r"\s+".join(token_pattern(t, tolerant) for t in text.split())
        else:
            words, span = near_words(text, near_chars)
            if not self.empty and len(words) < 2:
                raise ValueError("a proximity query needs two words or more")
            any_word = "(?:" + "|".join(f"(?:{token_pattern(w, tolerant)})" for w in words) + ")"
            gap = _OUTSIDE if span <= 1 else f"{_OUTSIDE}(?:.{{0,{span - 2}}}{_OUTSIDE})?"
            body, flags = gap.join([any_word] * len(words)), flags | regex.DOTALL
            self.words = [regex.compile(f"(?:^|{_OUTSIDE}){token_pattern(w, tolerant)}(?={_OUTSIDE}|$)", flags & ~regex.DOTALL) for w in words]
        self.pattern = regex.compile(f"(?:{body})(?={_OUTSIDE}|\\Z)" if self.bounded else body, flags)
        self.screens = [java + token_pattern(w, tolerant) for w in near_words(text)[0]] if mode == "proximity" else [java + body]

    def spans(self, text: str) -> list[tuple[int, int]]:
        out = []
        for m in self.pattern.finditer(text):
            if self.words and not all(w.search(m[0]) for w in self.words):
                continue
            if self.bounded and m.start() and _INSIDE.match(text[m.start() - 1]):
                continue
            out.append((m.start(), m.end()))
        return out

    def screen(self, column: Column) -> Column:
        out = F.lit(not self.empty)
        for pattern in self.screens:
            out = out & column.rlike(pattern)
        return out


_INSIDE = regex.compile(r"[\p{L}\p{N}_]")


def snippet(text: Column, start: Column, end: Column, context: int = CONTEXT_CHARS) -> Column:
    low, high = F.greatest(start - context, F.lit(0)), F.least(end + context, F.length(text))
    return F.concat(F.when(low > 0, F.lit("…")).otherwise(""), F.substr(text, low + 1, high - low), F.when(high < F.length(text), F.lit("…")).otherwise(""))


def scan(sections: DataFrame, query: str, order: list[str], mode: str = "contains", case: bool = False, tolerant: bool = True, near_chars: int = NEAR_CHARS, context: int = CONTEXT_CHARS, max_matches: int | None = MAX_MATCHES, text: str = "text") -> DataFrame:
    """order columns, start, end, snippet and is_truncated of the first ``max_matches`` matches in reading order (None: all)."""
    compiled = Query(query, mode, case, tolerant, near_chars)

    def find(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[{"start": a, "end": b} for a, b in compiled.spans(t)] if t else [] for t in column.to_pylist()], kind)

    hits = sections.where(compiled.screen(F.col(text))).select(*order, text, F.explode(arrow_udf(find, SPANS)(text)).alias("span"))
    hits = hits.select(*order, F.col("span.start").alias("start"), F.col("span.end").alias("end"), snippet(F.col(text), F.col("span.start"), F.col("span.end"), context).alias("snippet"))
    if max_matches is None:
        return hits.withColumn("is_truncated", F.lit(False))
    first = hits.orderBy(*order, "start").limit(max_matches + 1)
    total = F.count("*").over(Window.partitionBy(F.lit(0)))  # of the limited rows
    ranked = first.withColumn("is_truncated", total > max_matches)
    return ranked.orderBy(*order, "start").limit(max_matches)

