"""Reading positions: progression, position lists, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.cfi_documents import anchor_offset
from quire.functions.metadata import percent_decoded

POSITION_STEP = 1024


def progression(sections: DataFrame, book: str, order: str, length: Column) -> DataFrame:
    """Per section: length, start (sum of what precedes it), total of the book, and its number of sections."""
    w = Window.partitionBy(book).orderBy(order)
    rows = sections.select(book, order, length.cast("long").alias("length"))
    rows = rows.withColumn("start", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("place", (F.row_number().over(w) - 1).cast("long"))
    return rows.join(rows.groupBy(book).agg(F.sum("length").alias("total"), F.count("*").alias("sections")), book)


def book_fraction(offset: Column) -> Column:
    """How far through its book an offset in a section is; by section number where the book has no text."""
    inside = F.greatest(F.lit(0), F.least(offset, F.col("length")))
    return F.when(F.col("total") > 0, (F.col("start") + inside) / F.col("total")).otherwise(F.col("place") / F.col("sections"))


def section_fraction(offset: Column) -> Column:
    inside = F.greatest(F.lit(0), F.least(offset, F.col("length")))
    return F.when(F.col("length") > 0, inside / F.col("length")).otherwise(F.lit(0.0))


def positions(progress: DataFrame, book: str, order: str, step: int = POSITION_STEP) -> DataFrame:
    """A position at each ``step`` characters of every section (one for an empty one), numbered through the book."""
    at = F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)).cast("int"), F.lit(step))
    rows = progress.select(book, order, "start", "length", "total", F.explode(at).alias("offset"))
    number = F.row_number().over(Window.partitionBy(book).orderBy(order, "offset"))
    return rows.select(
        book, order, "offset", number.cast("long").alias("position"), F.when(F.col("length") > 0, F.col("offset") / F.col("length")).otherwise(0.0).alias("progression"),
        F.when(F.col("total") > 0, (F.col("start") + F.col("offset")) / F.col("total")).otherwise(0.0).alias("total_progression"),
    )


def heading_rows(html: DataFrame, key: str, column: str = "html") -> DataFrame:
    """key, play_order, level, label of each heading of a page."""
    found = F.regexp_extract_all(F.col(column), F.lit(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>"), F.lit(0))
    rows = html.select(key, F.posexplode(found).alias("k", "h"))
    label = F.trim(F.regexp_replace(F.regexp_replace("h", r"(?s)<[^>]*>", ""), r"\s+", " "))
    return rows.select(key, (F.col("k") + 1).alias("play_order"), F.regexp_extract("h", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), label.alias("label"))


def heading_parents(headings: DataFrame, key: str) -> DataFrame:
    """Adds parent: the play_order of the nearest heading before with a lower level (null at the top)."""
    w = Window.partitionBy(key).orderBy("play_order").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == n, F.col("play_order"))).over(w) for n in range(1, 7)]
    lower = F.greatest(F.lit(0), *[F.when(F.col("level") > n, F.coalesce(last[n - 1], F.lit(0))).otherwise(F.lit(0)) for n in range(1, 7)])
    return headings.withColumn("parent", F.nullif(lower, F.lit(0)))


def match_targets(nav: DataFrame, sections: DataFrame, path: str = "path", name: str = "name", order: str = "section_index", book: str = "book_id") -> DataFrame:
    """Each nav row with the first section it means: equal path, equal but for case, or a path that ends in it.

    Suffixes are compared by equality on every suffix of a section's name, so the join stays an equi-join.
    Both sides grow with the books, however small their files look to the planner: neither is broadcast.
    """
    parts = F.split(F.lower(name), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    keyed = sections.select(F.col(book), F.col(order), F.col(name), F.explode(suffixes).alias("_suffix"))
    asked = nav.select(book, path).distinct().withColumn("_suffix", F.lower(path))
    rank = F.when(F.col(name) == F.col(path), 0).when(F.lower(name) == F.lower(path), 1).otherwise(2)
    met = asked.join(keyed.hint("merge"), [book, "_suffix"])
    best = met.groupBy(book, path).agg(F.min(F.struct(rank.alias("rank"), F.col(order).alias("order"))).alias("_hit"))
    return nav.join(best.hint("merge"), [book, path], "left").select(*nav.columns, F.col("_hit.order").alias("target"))


def nav_targets(nav: DataFrame, sections: DataFrame, href: str = "href", name: str = "name", order: str = "section_index", book: str = "book_id", html: str = "html") -> DataFrame:
    """nav with target, the section that a path means, and offset, where its fragment's anchor begins in the section's text.

    A href without a fragment means its section's beginning; a fragment that the section lacks gives no offset.
    """
    path, fragment = F.regexp_replace(href, "#.*$", ""), F.nullif(F.regexp_extract(href, "#(.*)$", 1), F.lit(""))
    asked = nav.withColumns({"_path": percent_decoded(path), "_fragment": percent_decoded(fragment)})
    met = match_targets(asked, sections.select(book, order, name), "_path", name, order, book)
    texts = sections.select(F.col(book), F.col(order).alias("target"), F.col(html).alias("_html"))
    found = met.join(texts, [book, "target"], "left")
    offset = F.when(F.col("target").isNotNull() & F.col("_fragment").isNull(), F.lit(0)).otherwise(anchor_offset(F.col("_html"), F.col("_fragment")))
    return found.select(*nav.columns, "target", offset.alias("offset"))


def nav_paths(nav: DataFrame, spark, book: str = "book_id", deepest: int = 100) -> DataFrame:
    """nav (book, nav_id, parent_id, label) with depth and the path of labels from the top, by a recursive query."""
    nav.createOrReplaceTempView("_quire_nav")
    return spark.sql(
        f"""WITH RECURSIVE tree({book}, nav_id, depth, path) MAX RECURSION LEVEL {deepest} AS (
          SELECT {book}, nav_id, 0, array(label) FROM _quire_nav WHERE parent_id IS NULL
          UNION ALL
          SELECT n.{book}, n.nav_id, t.depth + 1, concat(t.path, array(n.label))
          FROM tree t JOIN _quire_nav n ON n.{book} = t.{book} AND n.parent_id = t.nav_id)
        SELECT * FROM tree"""
    )
