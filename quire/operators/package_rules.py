"""Integrity rules of book packages, as joins and groups over four tables.

manifest(book_id, pos, item_id, href, media_type), spine(book_id, pos, idref),
entries(book_id, pos, path), links(book_id, pos, kind, path, fragment) with
anchors(book_id, path, fragment); books(book_id, version, mimetype, rootfile and,
if the rules on them are wanted, rootfile_type and toc_id).
Each finding is book_id, rule, severity, subject.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rule -> severity (fixed values).
SEVERITY = {
    "container.mimetype-invalid": "error", "container.missing": "error", "container.rootfile.missing": "error", "container.rootfile.path-unresolved": "error",
    "package.version-unsupported": "warning", "manifest.item.incomplete": "error", "manifest.id-duplicate": "error", "manifest.href-duplicate": "warning",
    "manifest.href-fragment": "warning", "manifest.resource-missing": "error", "manifest.remote-resource-undeclared": "warning", "spine.empty": "error",
    "spine.reference-invalid": "error", "spine.reference-duplicate": "warning", "navigation.nav-missing": "warning", "navigation.nav-duplicate": "warning",
    "navigation.toc-missing": "warning", "navigation.toc-reference-missing": "warning", "container.rootfile.media-type-unsupported": "error", "navigation.link-unresolved": "error", "navigation.fragment-unresolved": "warning", "guide.reference-unresolved": "warning",
}
EPUB_TYPE = "application/epub+zip"
PACKAGE_TYPE = "application/oebps-package+xml"


def finding(rows: DataFrame, rule: str, subject) -> DataFrame:
    return rows.select("book_id", F.lit(rule).alias("rule"), F.lit(SEVERITY[rule]).alias("severity"), F.coalesce(subject.cast("string"), F.lit("")).alias("subject"))


def manifest_rules(manifest: DataFrame, entries: DataFrame) -> list[DataFrame]:
    whole = manifest.where("item_id IS NOT NULL AND href IS NOT NULL AND media_type IS NOT NULL")
    remote = F.col("href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")
    local = whole.where(~remote).withColumn("path", F.regexp_replace("href", "#.*$", ""))
    twice = lambda c: manifest.where(F.col(c).isNotNull()).groupBy("book_id", c).count().where("count > 1")
    return [
        finding(manifest.where("item_id IS NULL OR href IS NULL OR media_type IS NULL"), "manifest.item.incomplete", F.col("pos")),
        finding(twice("item_id"), "manifest.id-duplicate", F.col("item_id")), finding(twice("href"), "manifest.href-duplicate", F.col("href")),
        finding(whole.where(F.col("href").contains("#")), "manifest.href-fragment", F.col("href")),
        finding(whole.where(remote & ~F.coalesce(F.col("properties"), F.lit("")).contains("remote-resources")) if "properties" in manifest.columns else whole.where(remote), "manifest.remote-resource-undeclared", F.col("href")),
        finding(local.join(entries.select("book_id", "path").distinct(), ["book_id", "path"], "left_anti"), "manifest.resource-missing", F.col("href")),
    ]


def spine_rules(books: DataFrame, spine: DataFrame, manifest: DataFrame) -> list[DataFrame]:
    known = manifest.select("book_id", F.col("item_id").alias("idref")).distinct()
    return [
        finding(spine.join(known, ["book_id", "idref"], "left_anti"), "spine.reference-invalid", F.col("idref")),
        finding(spine.groupBy("book_id", "idref").count().where("count > 1"), "spine.reference-duplicate", F.col("idref")),
        finding(books.join(spine.select("book_id").distinct(), "book_id", "left_anti"), "spine.empty", F.lit("")),
    ]


def container_rules(books: DataFrame, entries: DataFrame) -> list[DataFrame]:
    first = entries.groupBy("book_id").agg(F.min_by("path", "pos").alias("first"))
    head = books.join(first, "book_id", "left")
    container = entries.where(F.col("path") == "META-INF/container.xml").select("book_id").distinct()
    root = books.where("rootfile IS NOT NULL").select("book_id", F.col("rootfile").alias("path"))
    major = F.regexp_extract(F.coalesce("version", F.lit("")), r"^\s*(\d+)", 1).try_cast("int")
    return [
        finding(head.where((F.coalesce("first", F.lit("")) != "mimetype") | (F.coalesce(F.trim("mimetype"), F.lit("")) != EPUB_TYPE)), "container.mimetype-invalid", F.col("first")),
        finding(books.join(container, "book_id", "left_anti"), "container.missing", F.lit("META-INF/container.xml")),
        finding(books.where("rootfile IS NULL"), "container.rootfile.missing", F.lit("")),
        finding(root.join(entries.select("book_id", "path").distinct(), ["book_id", "path"], "left_anti"), "container.rootfile.path-unresolved", F.col("path")),
        *([finding(books.where(F.col("rootfile").isNotNull() & (F.col("rootfile_type") != PACKAGE_TYPE)), "container.rootfile.media-type-unsupported", F.col("rootfile_type"))] if "rootfile_type" in books.columns else []),
        finding(books.where(major.isNull() | (major < 2) | (major >= 4)), "package.version-unsupported", F.col("version")),
    ]


def navigation_rules(books: DataFrame, links: DataFrame, entries: DataFrame, anchors: DataFrame) -> list[DataFrame]:
    paths = entries.select("book_id", "path").distinct()
    major = F.regexp_extract(F.coalesce("version", F.lit("")), r"^\s*(\d+)", 1).try_cast("int")
    toc, guide = links.where("kind = 'toc'"), links.where("kind = 'guide'")
    found = toc.join(paths, ["book_id", "path"], "left_semi")
    return [
        finding(books.join(links.where("kind = 'nav'").select("book_id").distinct(), "book_id", "left_anti"), "navigation.nav-missing", F.lit("")),
        finding(links.where("kind = 'nav'").groupBy("book_id").count().where("count > 1"), "navigation.nav-duplicate", F.col("count")),
        finding(books.join(toc.select("book_id").distinct(), "book_id", "left_anti"), "navigation.toc-missing", F.lit("")),
        finding(toc.join(paths, ["book_id", "path"], "left_anti"), "navigation.link-unresolved", F.col("path")),
        finding(found.where("fragment IS NOT NULL").join(anchors.select("book_id", "path", "fragment").distinct(), ["book_id", "path", "fragment"], "left_anti"), "navigation.fragment-unresolved", F.concat_ws("#", "path", "fragment")),
        *([finding(books.where((major < 3) & F.nullif("toc_id", F.lit("")).isNull()), "navigation.toc-reference-missing", F.lit(""))] if "toc_id" in books.columns else []),
        finding(guide.join(paths, ["book_id", "path"], "left_anti"), "guide.reference-unresolved", F.col("path")),
    ]


def findings(books: DataFrame, manifest: DataFrame, spine: DataFrame, entries: DataFrame, links: DataFrame, anchors: DataFrame) -> DataFrame:
    parts = [*container_rules(books, entries), *manifest_rules(manifest, entries), *spine_rules(books, spine, manifest), *navigation_rules(books, links, entries, anchors)]
    return reduce(DataFrame.unionByName, parts)


def report(found: DataFrame) -> DataFrame:
    return found.groupBy("book_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
