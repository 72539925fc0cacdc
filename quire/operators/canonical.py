"""Source lines of pages and the canonical text that was made of them: alignment, and ranges carried from one to the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .annotations import occurrences


def aligned_lines(canonical: DataFrame, source: DataFrame, keys: list[str], same: list[str], line: str = "line_no") -> DataFrame:
    """keys, line and source_line: the source line that each canonical line is, null where there is none.

    Lines are the same if they agree in all columns of ``same`` (nulls too); of equal
    ones the first canonical line is the last source line that is left.
    """
    w = Window.partitionBy(*keys, *same)
    asked = canonical.select(*keys, *same, F.col(line), F.row_number().over(w.orderBy(line)).alias("_k"))
    held = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in same], F.col(line).alias("source_line"), F.row_number().over(w.orderBy(F.desc(line))).alias("_j"))
    agree = [asked[k] == held[k] for k in keys] + [asked[c].eqNullSafe(held[f"_{c}"]) for c in same] + [asked["_k"] == held["_j"]]
    return asked.join(held, agree, "left").select(*[asked[k] for k in keys], line, "source_line")


def canonical_text(canonical: DataFrame, keys: list[str], line: str = "line_no", text: str = "text") -> DataFrame:
    """keys, line, prefix (where the line begins in its page's text, lines being joined by one line feed)."""
    before = Window.partitionBy(*keys).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    return canonical.select(*keys, line, F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0)).cast("int").alias("prefix"))


def mapped_ranges(ranges: DataFrame, source: DataFrame, canonical: DataFrame, keys: list[str], same: list[str], line: str = "line_no", text: str = "text") -> DataFrame:
    """ranges (keys, line, start, end, expected or null) with outcome, offset and length in their page's canonical text.

    Outcomes: mapped; unsupported, where the page has no canonical text; else missing, and
    ``reason`` says why: line-out-of-range, text-mismatch, bounds, line-dropped.
    """
    own = source.select(*keys, line, F.col(text).alias("_text"))
    places = aligned_lines(canonical, source, keys, same, line).join(canonical_text(canonical, keys, line, text), [*keys, line])
    places = places.where("source_line IS NOT NULL").select(*keys, F.col("source_line").alias(line), "prefix")
    pages = canonical.select(*keys).distinct().withColumn("_page", F.lit(True))
    met = ranges.join(own, [*keys, line], "left").join(places, [*keys, line], "left").join(pages, keys, "left")
    reason = (
        F.when(F.col("_page").isNull(), "no-canonical-text").when(F.col("_text").isNull(), "line-out-of-range").when(F.col("expected").isNotNull() & (F.col("expected") != F.col("_text")), "text-mismatch")
        .when(F.col("end") > F.length("_text"), "bounds").when(F.col("prefix").isNull(), "line-dropped")
    )
    outcome = F.when(reason.isNull(), "mapped").when(F.col("_page").isNull(), "unsupported").otherwise("missing")
    sure = reason.isNull()
    return met.select(*ranges.columns, outcome.alias("outcome"), reason.alias("reason"), F.when(sure, F.col("prefix") + F.col("start")).alias("offset"), F.when(sure, F.col("end") - F.col("start")).alias("length"))


def mapped_into(ranges: DataFrame, targets: DataFrame, keys: list[str], line_text: str = "line_text", target: str = "target") -> DataFrame:
    """ranges (keys, line_text, start, end) in another text of their page: where the line stands there once, it is mapped; where more often, ambiguous with all places."""
    met = ranges.join(targets.select(*keys, target), keys, "left")
    found = F.when((F.col(line_text) != "") & F.col(target).isNotNull(), occurrences(F.col(target), F.col(line_text)))
    met = met.withColumn("_at", F.coalesce(found, F.array().cast("array<int>")))
    places = F.transform("_at", lambda a: (a + F.col("start")).cast("int"))
    outcome = F.when(F.size("_at") == 0, "missing").when(F.size("_at") == 1, "mapped").otherwise("ambiguous")
    return met.select(*ranges.columns, outcome.alias("outcome"), places.alias("offsets"))
