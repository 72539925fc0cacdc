"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is cut
greedily into the longest phrases that occur in that training text; the language
that needs the fewest phrases for each symbol wins.  Segments of many texts
advance in step, one lookup a symbol and language.  Texts are read whole, in
segments of ``SEGMENT`` symbols at whose ends a phrase ends too.

Symbols are lower-case letters, each a symbol of its own if any training text
has it and else one common symbol that no training text holds; a run of anything
else is one space.  Transitions are kept in one table by row displacement, so that
its size follows the training text (at most three transitions a symbol) and not
the number of letters of all scripts.

Learned from labelled rows whose crc32(doc_id as text) mod 4 is not 2: of each
language the first ``SAMPLE_DOCS`` by a hash of (doc_id, text), and of these, whole texts
only, as many as fit together into ``SAMPLE_SYMBOLS`` characters (one at least,
the shortest if none fits).  These two parameters bound what is learned from; no
text is cut.  A model of at most ``MODEL_SYMBOLS`` characters goes to the workers
at a time, 30 MB of table (measured: 7.5 MB for four languages).  More languages
are scored in several passes of one plan, which keep the best so far, so that
100 languages are seven passes and no model is larger.  A language column of
more than ``MOST_LANGUAGES`` values is refused with an error.

Defined results: null and empty texts and texts without a letter are ``und`` with
score 0; with nothing to learn from (an empty table too), all are; ties go to the
language first in order; a null doc_id is not held out and not learned from;
repeated rows are learned from once and each gets a row; very long texts are read
whole; further columns, whatever their names, are ignored.  The score is the
winner's share of the sum over languages of symbols per phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, staged, whole_text

SAMPLE_DOCS = 256
SAMPLE_SYMBOLS = 1 << 16
MODEL_SYMBOLS = 1 << 20
MOST_LANGUAGES = 4_096
SEGMENT = 4_096


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _chosen(docs: DataFrame) -> dict[str, list[tuple[int, int, int]]]:
    """lang -> (doc_id, hash of text, length) of its sample, the rows first by a hash of (doc_id, text).

    Labelled rows are counted by language first.  Of n rows only those whose hash lies in
    the lowest 4 x ``SAMPLE_DOCS`` / n of its range meet in a task: the first
    ``SAMPLE_DOCS`` are among them but for a chance below 1e-100.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    rows = staged(rows.select("lang", "doc_id", F.xxhash64("text").alias("th"), F.length("text").alias("n"), F.xxhash64("doc_id", "text").alias("h")).distinct(), "labelled", "zstd")
    many = rows.groupBy("lang").agg(F.count("*").alias("rows")).limit(MOST_LANGUAGES + 1).collect()
    if len(many) > MOST_LANGUAGES:
        raise ValueError(f"lang holds more than {MOST_LANGUAGES} values")
    if not many:
        return {}
    counts = F.broadcast(docs.sparkSession.createDataFrame(many, "lang string, rows bigint"))
    share = F.col("h").cast("double") / F.lit(2.0**64) + 0.5
    first = rows.join(counts, "lang").where(share * F.col("rows") < 4 * SAMPLE_DOCS)
    w = Window.partitionBy("lang").orderBy("h", "doc_id", "th")
    out: dict[str, list[tuple[int, int, int]]] = {}
    for r in first.withColumn("k", F.row_number().over(w)).where(F.col("k") <= SAMPLE_DOCS).orderBy("lang", "k").collect():
        out.setdefault(r["lang"], []).append((r["doc_id"], r["th"], r["n"]))
    return {lang: fitting(own) for lang, own in out.items()}


def fitting(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The rows that fit into the sample one after the other, whole; the shortest where none does."""
    out, room = [], SAMPLE_SYMBOLS
    for row in rows:
        if row[2] <= room:
            out.append(row)
            room -= row[2]
    return out or [min(rows, key=lambda r: r[2])]


def training_texts(docs: DataFrame, chosen: dict[str, list[tuple[int, int, int]]]) -> dict[str, list[str]]:
    """lang -> its sample's whole texts; at most ``SAMPLE_DOCS`` keys a language are broadcast."""
    keys = [(lang, doc_id, th) for lang, own in chosen.items() for doc_id, th, _ in own]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(keys, "lang string, doc_id bigint, _th bigint"))
    rows = docs.select("lang", "doc_id", "text", F.xxhash64("text").alias("_th")).join(wanted, ["lang", "doc_id", "_th"])
    out: dict[str, set[tuple[int, str]]] = {lang: set() for lang in sorted(chosen)}
    for r in rows.collect():
        out[r["lang"]].add((r["doc_id"], r["text"]))
    return {lang: [t for _, t in sorted(own)] for lang, own in out.items()}


def symbol_table(texts: dict[str, list[str]]) -> np.ndarray:
    """Code point -> 0 (no letter), 1 (a letter not seen in training), 2.. (a letter seen there)."""
    seen = sorted({c for own in texts.values() for t in own for c in t.lower() if c.isalpha()})
    ids = {c: k + 2 for k, c in enumerate(seen)}
    return np.array([ids.get(c.lower(), 1) if c.isalpha() else 0 for c in map(chr, range(0x110000))], np.int32)


def symbols(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    found = table[codes]
    keep = found != 0
    keep[1:] |= found[:-1] != 0
    return found[keep]


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``, by state; 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            if length[p] + 1 == length[q := step[p][c]]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def displaced(step: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row displacement: the transition of state s by symbol c stands at base[s] + c, with the state it is of in the upper half.

    States with several transitions take the next places where all of them fit, the many with one fill the gaps.
    """
    base = np.zeros(len(step), np.int64)
    used, low = bytearray(4 * sum(map(len, step)) + 2 * width), 0
    for state in sorted((k for k, out in enumerate(step) if len(out) > 1), key=lambda k: -len(step[k])):
        at, tries = low, 0
        while any(used[at + c] for c in step[state]):
            at += 1
            tries += 1
        low += tries >> 4  # leave crowded places
        if at + 2 * width >= len(used):
            used += bytearray(len(used))
        base[state] = at
        for c in step[state]:
            used[at + c] = 1
    single = np.array([k for k, out in enumerate(step) if len(out) == 1], np.int64)
    taken = np.frombuffer(used, np.uint8)
    gaps = width + np.flatnonzero(taken[width:] == 0)[: len(single)]
    gaps = np.concatenate([gaps, len(taken) + np.arange(len(single) - len(gaps))])
    base[single] = gaps - np.array([next(iter(step[k])) for k in single], np.int64)
    places = [(base[k] + c, k << 32 | t) for k, out in enumerate(step) for c, t in out.items()]
    packed = np.full(int(base.max()) + width, -1, np.int64)
    if places:
        at, value = map(np.array, zip(*places))
        packed[at] = value
    return base, packed


class Parser:
    """The automata of some languages as one sparse table, and what their start states do by symbol.

    State 0 is the dead one of all: texts start there, and a symbol that the training text lacks leads there, as it is a phrase of its own.
    """

    def __init__(self, texts: dict[str, list[str]], table: np.ndarray):
        self.width = int(table.max()) + 1
        self.first = np.zeros((len(texts), self.width), np.int64)
        every: list[dict[int, int]] = [{}]
        for row, own in enumerate(texts.values()):
            shift = len(every)
            step = automaton(symbols(np.frombuffer(" ".join(own).encode("utf-32-le"), np.uint32), table))
            every += [{c: t + shift for c, t in out.items()} for out in step]
            for c, t in step[0].items():
                self.first[row, c] = t + shift
        self.base, self.packed = displaced(every, self.width)

    def phrases(self, rows: list[np.ndarray]) -> np.ndarray:
        """Phrases that each row of symbols needs, by language."""
        many = len(self.first)
        cuts = [(k, a) for k, row in enumerate(rows) for a in range(0, len(row), SEGMENT)]
        out = np.zeros((len(rows), many), np.int64)
        if not cuts:
            return out
        sizes = np.array([min(SEGMENT, len(rows[k]) - a) for k, a in cuts], int)
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((sizes[order[0]], len(cuts)), np.int64)
        for column, j in enumerate(order):
            k, a = cuts[j]
            grid[: sizes[j], column] = rows[k][a : a + SEGMENT]
        # Segments go from long to short, so that those still at work stand in front.
        state = np.zeros((len(cuts), many), np.int64)
        count = np.zeros((len(cuts), many), np.int32)
        first, base, packed, low = self.first.ravel(), self.base, self.packed, np.int64(0xFFFFFFFF)
        start = np.arange(many) * self.width
        active = np.searchsorted(-sizes[order], -np.arange(len(grid)), "left")
        for at in range(len(grid)):
            n = active[at]
            symbol, now = grid[at, :n], state[:n]
            found = packed.take(base.take(now) + symbol[:, None])
            ended = (found >> 32) != now
            count[:n] += ended
            found &= low
            row, lang = np.nonzero(ended)
            found[row, lang] = first.take(start.take(lang) + symbol.take(row))
            state[:n] = found
        np.add.at(out, np.array([cuts[j][0] for j in order]), count)
        return out


def passes(chosen: dict[str, list[tuple[int, int, int]]]) -> list[list[str]]:
    """The languages in order, dealt into models of at most ``MODEL_SYMBOLS`` characters (a larger one stands alone)."""
    out: list[list[str]] = []
    room = 0
    for lang in sorted(chosen):
        size = sum(n for _, _, n in chosen[lang])
        if not out or size > room:
            out.append([])
            room = MODEL_SYMBOLS
        out[-1].append(lang)
        room -= size
    return out


STATE = "doc_id bigint, held_out boolean, text string, lang_pred string, best double, total double"


def _pass(names: list[str], model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, parser = model.value
        for batch in batches:
            lang, best, total = (batch.column(k).to_pylist() for k in (3, 4, 5))
            rows = [symbols(np.frombuffer((t or "").encode("utf-32-le"), np.uint32), table) for t in batch.column(2).to_pylist()]
            need = parser.phrases(rows)
            for k in np.flatnonzero([r.any() for r in rows]):
                per = len(rows[k]) / need[k]
                total[k] += float(per.sum())
                if (top := float(per.max())) > best[k]:
                    best[k], lang[k] = top, names[int(np.argmax(per))]
            columns = [*batch.columns[:3], pa.array(lang, pa.string()), pa.array(best, pa.float64()), pa.array(total, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in STATE.split(", ")])

    return score


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; lang is only read of the training sample."""
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = _chosen(docs)
    out = docs.select("doc_id", held_out().alias("held_out"), whole_text().alias("text"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("best"), F.lit(0.0).alias("total"))
    for names in passes(chosen):
        texts = training_texts(docs, {n: chosen[n] for n in names})
        table = symbol_table(texts)
        out = out.mapInArrow(_pass(names, spark.sparkContext.broadcast((table, Parser(texts, table)))), STATE)
    return out.select("doc_id", "held_out", "lang_pred", F.when(F.col("total") > 0, F.col("best") / F.col("total")).otherwise(0.0).alias("score"))
