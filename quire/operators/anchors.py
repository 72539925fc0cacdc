"""Durable anchors: a quotation finds its place again in revised texts.

Stages, each only for what the ones before it left open: the same section with
the same text digest; an exact occurrence, told apart by context; an occurrence
with white space runs as one blank; the nearest approximate place, of equals by context.
Equally good places are ambiguous.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import text_revision

from .annotations import approximate_places, context_score, exact_quotes
from quire.shipping import arrow_udf
from quire.sinks.shared import staged

OUTCOME = ["anchor_id", "outcome", "pass", "section", "start", "end"]
CONTEXT = 32


def capture(sections: DataFrame, ranges: DataFrame, section: str = "section", text: str = "text", context: int = CONTEXT) -> DataFrame:
    """Anchors of ranges (anchor_id, section, start, end): digest of the text, quote, before and after."""
    met = ranges.join(sections.select(section, text), section)
    t, a, b = F.col(text), F.col("start"), F.col("end")
    return met.select(
        "anchor_id", section, "start", "end", text_revision(t).alias("revision"), F.substr(t, a + 1, b - a).alias("quote"),
        F.substr(t, F.greatest(a - context + 1, F.lit(1)), F.least(a, F.lit(context))).alias("before"), F.substr(t, b + 1, F.lit(context)).alias("after"),
    )


def collapsed(text: Column) -> Column:
    return F.regexp_replace(text, r"[\t-\r ]+", " ")


_SPACE_RUNS = re.compile(r"[\t-\r ]+")


def _projected(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Places in texts of ranges in their collapsed forms."""
    out = []
    for text, a, b in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist()):
        if text is None or a is None or b is None:
            out.append(None)
            continue
        places, at = [], 0
        for m in _SPACE_RUNS.finditer(text):
            places += range(at, m.start() + 1)
            at = m.end()
        places += range(at, len(text) + 1)
        out.append({"start": places[a], "end": places[b - 1] + 1 if b > a else places[a]})
    return pa.array(out, pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _best(found: DataFrame, stage: str) -> DataFrame:
    """One row for each anchor: its best place, or ambiguous if another is as good."""
    w = Window.partitionBy("anchor_id").orderBy(F.desc("score"))
    top = found.withColumn("_r", F.rank().over(w)).where("_r = 1")
    one = top.groupBy("anchor_id").agg(F.count("*").alias("n"), F.min(F.struct("section", "start", "end")).alias("p"))
    sure = F.col("n") == 1
    return one.select("anchor_id", F.when(sure, "resolved").otherwise("ambiguous").alias("outcome"), F.lit(stage).alias("pass"), *[F.when(sure, F.col(f"p.{c}")).alias(c) for c in ("section", "start", "end")])


@dataclass(frozen=True)
class Limits:
    """What an anchor may hold, and how far the last stage goes."""

    max_quote: int = 4_096
    max_context: int = 512
    max_fuzzy_quote: int = 256
    max_distance: int = 8

    def __post_init__(self):
        if any(v <= 0 for v in vars(self).values()):
            raise ValueError("limits are positive")


#: How far an anchor may be carried: to the same text alone, within its publication, or by its quote anywhere.
VERIFIED, MIGRATION, RECOVERY = "verified", "migration", "recovery"


def resolve(anchors: DataFrame, sections: DataFrame, fuzzy: bool = True, section: str = "section", text: str = "text", policy: str = RECOVERY, limits: Limits = Limits()) -> DataFrame:
    """anchor_id, outcome (resolved, ambiguous, missing, incompatible, unsupported), pass, section, start, end.

    Anchors past the limits are unsupported.  Under ``verified`` what the identity pass
    does not find is incompatible; under ``migration`` so is what was captured in another
    publication than the sections' (columns ``publication`` on both sides, nulls being equal).
    """
    if policy not in (VERIFIED, MIGRATION, RECOVERY):
        raise ValueError(f"unknown policy {policy!r}")
    fits = (F.length("quote") <= limits.max_quote) & (F.greatest(F.length("before"), F.length("after")) <= limits.max_context)
    refused = [anchors.where(~fits).select("anchor_id", F.lit("unsupported").alias("outcome"))]
    anchors = anchors.where(fits)
    if policy == MIGRATION:
        known = sections.select(F.col("publication").alias("_p")).distinct()
        here = F.col("publication").eqNullSafe(F.col("_p"))
        refused.append(anchors.join(known, here, "left_anti").select("anchor_id", F.lit("incompatible").alias("outcome")))
        anchors = anchors.join(known, here, "left_semi")
    live = sections.select(F.col(section).alias("section"), F.col(text).alias("text"))
    told = anchors.select("anchor_id", F.col(section).alias("home"), F.col("start").alias("was_start"), F.col("end").alias("was_end"), "revision", "quote", "before", "after")
    digests = live.select("section", text_revision(F.col("text")).alias("revision"))
    same = told.join(digests, (told["home"] == digests["section"]) & (told["revision"] == digests["revision"]), "left_semi")
    parts = [same.select("anchor_id", F.lit("resolved").alias("outcome"), F.lit("identity").alias("pass"), F.col("home").alias("section"), F.col("was_start").alias("start"), F.col("was_end").alias("end"))]

    def still(rows: DataFrame) -> DataFrame:
        return rows.join(parts[-1].select("anchor_id"), "anchor_id", "left_anti")

    # What each stage found and left open is written, so that no stage is computed twice.
    parts[0] = staged(parts[0], "identity")
    rest = staged(still(told), "rest")
    if policy == VERIFIED:
        refused.append(rest.select("anchor_id", F.lit("incompatible").alias("outcome")))
        rest, fuzzy = rest.limit(0), False
    exact = exact_quotes(rest, live).withColumn("end", F.col("start") + F.length("quote"))
    exact = exact.withColumn("score", context_score(F.col("text"), F.col("start"), F.col("end"), F.col("before"), F.col("after")))
    parts.append(staged(_best(exact, "exact"), "exact"))
    rest = staged(still(rest), "rest")
    flat = live.withColumn("whole", F.col("text")).withColumn("text", collapsed(F.col("text")))
    loose = exact_quotes(rest.withColumn("quote", collapsed(F.col("quote"))), flat).withColumn("end", F.col("start") + F.length("quote"))
    loose = loose.withColumn("score", context_score(F.col("text"), F.col("start"), F.col("end"), collapsed(F.col("before")), collapsed(F.col("after"))))
    back = arrow_udf(_projected, "struct<start: int, end: int>")("whole", "start", "end")
    loose = loose.withColumn("p", back).withColumn("start", F.col("p.start")).withColumn("end", F.col("p.end"))
    parts.append(staged(_best(loose, "normalized"), "normalized"))
    rest = staged(still(rest), "rest")
    if fuzzy:
        short = rest.where(F.length("quote") <= limits.max_fuzzy_quote).select("anchor_id", "quote")
        near = approximate_places(short, live, "anchor_id", "section", most=limits.max_distance)
        near = near.join(rest.select("anchor_id", "before", "after"), "anchor_id").join(live, "section")
        near = near.withColumn("score", context_score(F.col("text"), F.col("start"), F.col("end"), F.col("before"), F.col("after")) - F.col("distance") * 0x10000)
        parts.append(staged(_best(near, "fuzzy"), "fuzzy"))
        rest = still(rest)
    none = F.lit(None)
    kinds = dict(parts[0].dtypes)
    refused.append(rest.select("anchor_id", F.lit("missing").alias("outcome")))
    parts += [r.select("anchor_id", "outcome", none.cast("string").alias("pass"), *[none.cast(kinds[c]).alias(c) for c in ("section", "start", "end")]) for r in refused]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
