"""Queries that apply the library's column functions and small operators to whole tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import cfi_documents as cfi
from quire.functions import locators, metadata, text
from quire.operators import anchors, canonical, catalogue, index, package_rules, reading, segments, spatial
from quire.sinks import codecs, index_store
from quire.sinks.shared import new_path
from quire.sources import mobi6, opds2

from .catalogue import query
from .library import stored_index, table


def pick(number, values):
    """The value of a list at number modulo its length."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))).cast("int"))


def pick_sql(number: str, values) -> str:
    shown = ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{shown}])[CAST({number} % {len(values)} AS INTEGER) + 1]"


TAGS = ["en", "FR-ca", "xx", "ar-EG", "he", "pl", "deu", "pt-BR", "", "zh"]
KEYS = ["eng", "fra", "eng", "eng", "eng", "pol", "deu", "por", "eng", "eng"]
RIGHT = [False, False, False, True, True, False, False, False, False, False]
HEADS = ["The ", "L'", "An ", "The ", "A ", "Der ", "Die ", "Os ", "the ", "De "]
MOVED = [", The", ", L'", ", An", ", The", ", A", None, ", Die", ", Os", ", the", None]


@query(f"SELECT c_custkey, {pick_sql('c_custkey', KEYS)} AS language, {pick_sql('c_custkey', RIGHT)} AS is_rtl, CASE WHEN {pick_sql('c_custkey', MOVED)} IS NULL THEN {pick_sql('c_custkey', HEADS)} || c_name ELSE c_name || {pick_sql('c_custkey', MOVED)} END AS sort_key FROM customer")
def languages_and_articles(spark, d):
    """Language keys, writing direction and titles with the articles of their languages moved."""
    tag = pick(F.col("c_custkey"), TAGS)
    title = F.concat(pick(F.col("c_custkey"), HEADS), "c_name")
    return table(spark, d, "customer").select("c_custkey", metadata.language_key(tag).alias("language"), metadata.is_rtl(tag).alias("is_rtl"), metadata.title_sort(title, tag).alias("sort_key"))


@query(
    """SELECT c_custkey, c_name AS quoted, c_name || '“' AS half, c_name || '   end' AS bare, 'Lee, Ann & ' || c_mktsegment || ' Inc. & ' || c_name AS authors,
    ['Ann Lee', c_name, 'Bo'] AS split, CAST(c_custkey + 0.5 AS DOUBLE) AS series, '978' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS isbn, 'x-' || c_custkey AS no_isbn, c_mktsegment AS said FROM customer"""
)
def names_and_numbers(spark, d):
    """Quotes, brackets, joined and split authors, series numbers, ISBN and texts by language."""
    name, number, lit = F.col("c_name"), F.col("c_custkey").cast("string"), F.lit
    return table(spark, d, "customer").select(
        "c_custkey", metadata.strip_quote(F.concat(lit("“"), name, lit("”"))).alias("quoted"), metadata.strip_quote(F.concat(lit("«"), name, lit("“"))).alias("half"),
        metadata.remove_brackets(F.concat(name, lit(" (a [b) c] {d}) "), lit("end"))).alias("bare"),
        metadata.authors_sort(F.array(lit("Ann Lee"), F.concat("c_mktsegment", lit(" Inc.")), name)).alias("authors"),
        metadata.split_authors(F.concat(lit("Ann Lee ; "), name, lit(" and Bo"))).alias("split"), metadata.series_index(F.concat(number, lit(",5"))).alias("series"),
        metadata.isbn(F.concat(lit("urn:isbn:978-"), F.lpad(number, 10, "0"))).alias("isbn"), metadata.isbn(F.concat(lit(" x-"), number)).alias("no_isbn"),
        metadata.localized(lit(None).cast("string"), F.create_map(lit("fr"), F.col("c_mktsegment"), lit("de"), lit("other")), lit("fr-CA")).alias("said"),
    )


@query(
    """SELECT p_partkey, 'a/c' || p_size || '/d' AS normal, 'OEBPS/images/' || p_partkey || '.png' AS resolved, 'img/x.gif' AS rooted, 'p ' || p_size || '+q é' AS decoded, '%zz' || p_size AS kept,
    CASE p_partkey % 3 WHEN 0 THEN 'application/xhtml+xml' WHEN 1 THEN 'image/jpeg' ELSE NULL END AS media_type FROM part"""
)
def paths_and_types(spark, d):
    """Normal and resolved paths, percent decoding and media types by extension."""
    size, key, lit = F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), F.lit
    return table(spark, d, "part").select(
        "p_partkey", metadata.normalize_path(F.concat(lit("/a/./b/../c"), size, lit("\\d"))).alias("normal"), metadata.resolve_path(F.concat(lit("OEBPS/text/"), key, lit(".xhtml")), F.concat(lit("../images/"), key, lit(".png"))).alias("resolved"),
        metadata.resolve_path(lit("OEBPS/a.xhtml"), lit("/img/x.gif")).alias("rooted"), metadata.percent_decoded(F.concat(lit("p%20"), size, lit("+q%20%C3%A9"))).alias("decoded"), metadata.percent_decoded(F.concat(lit("%zz"), size)).alias("kept"),
        locators.media_type(F.concat(lit("a.b/p"), key, pick(F.col("p_partkey"), [".XHTML", ".jpeg", ".xyz"]))).alias("media_type"),
    )


@query(
    """SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped, true AS is_revision, false AS is_other,
    CAST(length(left(text, CAST(length(text) // 2 AS INTEGER))) + len(regexp_extract_all(left(text, CAST(length(text) // 2 AS INTEGER)), '[\\x{10000}-\\x{10FFFF}]')) AS INTEGER) AS u16, CAST(length(text) // 2 AS INTEGER) AS back,
    CAST(length(regexp_replace('<p>x</p>' || '<P class="a"> * # ~ </P>' || text, '(?i)<p[^>]*>\\s*(?:[*#~•·—–-]\\s*){3,}</p>', '<p class="scene-break">* * *</p>', 'g')) AS INTEGER) AS scenes FROM documents"""
)
def text_units(spark, d):
    """Escapes, digests, offsets in code points and UTF-16, and scene breaks."""
    docs, half = table(spark, d, "documents"), F.floor(F.length("text") / 2).cast("int")
    u16 = locators.u16_from_code_points(F.col("text"), half)
    return docs.select(
        "doc_id", F.sha2(text.escape_html(F.col("text")), 256).alias("escaped"), text.is_revision(text.text_revision(F.col("text"))).alias("is_revision"), text.is_revision(F.lit("sha256:xyz")).alias("is_other"),
        u16.alias("u16"), locators.code_points_from_u16(F.col("text"), u16).alias("back"), F.length(text.scene_breaks(F.concat(F.lit('<p>x</p><P class="a"> * # ~ </P>'), "text"))).alias("scenes"),
    )


@query("SELECT p_partkey, 'sha256:' || sha256(unhex(regexp_replace(hex(encode(p_name || ' ' || p_brand)), '(..)', '\\100', 'g'))) AS revision FROM part")
def name_revisions(spark, d):
    """Digests of UTF-16 code units (of names in ASCII, whose units SQL can spell)."""
    return table(spark, d, "part").select("p_partkey", text.text_revision(F.concat("p_name", F.lit(" "), "p_brand")).alias("revision"))


SOFT = "'([^\\n.!?:;…\"”])\\n([^\\n])', '\\1 \\2', 'g')"


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '(\\p{L})-\\n(\\p{Ll})', '\\1\\2', 'g'), " + SOFT + ", " + SOFT + ") AS sha256 FROM documents")
def unwrapped_lines(spark, d):
    """Documents with hyphenated and soft line breaks joined."""
    return table(spark, d, "documents").select("doc_id", F.sha2(text.unwrap_lines(F.col("text")), 256).alias("sha256"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS title, CASE WHEN p_partkey % 2 = 0 THEN [p_type, p_brand] END AS authors FROM part")
def text_headers(spark, d):
    """Title and authors at the head of a plain text; every second text has none."""
    gap = F.when(F.col("p_partkey") % 2 == 0, F.lit("\n\n\n")).otherwise(F.lit("\n\n"))
    head = text.txt_header(F.concat("p_name", gap, "p_type", F.lit(" , "), "p_brand", F.lit("\nbody")))
    return table(spark, d, "part").select("p_partkey", head["title"].alias("title"), head["authors"].alias("authors"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 1.0 WHEN 1 THEN l_quantity / 254 WHEN 2 THEN l_quantity / 1200 END AS scale,
    CASE WHEN abs(l_quantity / 100 - l_quantity / (100 + l_linenumber)) <= 0.01 * l_quantity / 100 THEN (l_quantity / 100 + l_quantity / (100 + l_linenumber)) / 2 END AS page_scale,
    l_quantity BETWEEN 10 AND 30 AND l_linenumber BETWEEN 2 AND 5 AS inside, l_quantity < 30 AND 10 < l_quantity + 5 AND l_linenumber < 4 AS meets FROM lineitem"""
)
def page_units(spark, d):
    """Pixel scales, page scales and points and rectangles."""
    q, n, lit = F.col("l_quantity").cast("double"), F.col("l_linenumber"), F.lit
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", spatial.pixel_scale(pick(n, ["pixel", "mm10", "inch1200", "cm"]), q).alias("scale"), spatial.page_scale(q, q, lit(100.0), 100.0 + n).alias("page_scale"),
        spatial.contains_point(lit(10), lit(2), lit(20), lit(3), q, n).alias("inside"), spatial.intersects(q, n, lit(5), lit(1), lit(10), lit(0), lit(20), lit(4)).alias("meets"),
    )


@query("SELECT l_orderkey, list_sort(list(l_quantity))[CAST(count(*) // 2 AS INTEGER) + 1] AS middle FROM lineitem GROUP BY 1")
def upper_medians(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(spatial.upper_median(F.collect_list("l_quantity")).alias("middle"))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber // 2 * 10 + l_linenumber % 2 AS "at", l_linenumber * 5 AS low, l_linenumber * 5 + l_quantity / 10 AS high, l_linenumber // 2 AS line FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)),
    p AS (SELECT *, CASE WHEN low - max(high) OVER (PARTITION BY l_orderkey, line ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2 THEN 0 ELSE 1 END AS fresh FROM r),
    q AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey, line ORDER BY low ROWS UNBOUNDED PRECEDING) AS part FROM p)
    SELECT l_orderkey, avg("at") AS "at", CAST(min(low) AS DOUBLE) AS low, CAST(max(high) AS DOUBLE) AS high FROM q GROUP BY l_orderkey, line, part"""
)
def ruling_lines(spark, d):
    """Collinear rules that nearly touch, as one."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("double")
    rules = _lines(spark, d).select("l_orderkey", (F.floor(n / 2) * 10 + n % 2).cast("double").alias("at"), (n * 5.0).alias("low"), (n * 5 + q / 10).alias("high"))
    return spatial.merged_rules(rules, ["l_orderkey"])


def _lines(spark, d):
    """The lines of each order, one of each number."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))


def _boxes(spark, d, x, y):
    n = F.col("l_linenumber")
    return _lines(spark, d).select("l_orderkey", "l_linenumber", x(n).cast("double").alias("x"), y(n).cast("double").alias("y"), F.lit(80.0).alias("w"), F.lit(10.0).alias("h"))


@query("SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber // 3) - 1 AS INTEGER) AS band FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def row_bands(spark, d):
    """Words of one baseline, within half their height, as rows."""
    words = _boxes(spark, d, lambda n: n * 100, lambda n: F.floor(n / 3) * 40 + n % 3)
    return spatial.with_row_bands(words, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "band")


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, l_linenumber) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def column_order(spark, d):
    """Blocks in two columns, in reading order."""
    blocks = _boxes(spark, d, lambda n: n % 2 * 300, lambda n: F.floor(n / 2) * 4).withColumn("page_width", F.lit(600.0))
    return spatial.reading_order(blocks, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "place")


@query(
    """WITH z AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, coalesce(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations)
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(start + n // 2 AS INTEGER) AS "offset", CASE WHEN n > 0 THEN CAST(turn AS INTEGER) END AS zone_seq,
    CAST(max(CASE WHEN turn % 4 = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS INTEGER) AS within FROM z"""
)
def zones_at_points(spark, d):
    """The innermost zone that holds a place, and the zone of another kind before it."""
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("zone_seq"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    w = Window.partitionBy("conv_id").orderBy("zone_seq").rowsBetween(Window.unboundedPreceding, -1)
    zones = turns.withColumn("text_start", F.coalesce(F.sum(F.col("n") + 1).over(w), F.lit(0)).cast("int")).withColumn("text_end", (F.col("text_start") + F.col("n")).cast("int"))
    whole = zones.groupBy("conv_id").agg(F.lit(-1).alias("zone_seq"), F.lit(0).alias("text_start"), F.max("text_end").alias("text_end")).where("text_end > text_start").withColumn("kind", F.lit("line"))
    lines = zones.select("conv_id", "zone_seq", "text_start", "text_end", F.lit("line").alias("kind"))
    kinds = zones.withColumn("kind", F.when(F.col("zone_seq") % 4 == 0, "region").otherwise("line"))
    around = spatial.enclosing(kinds, ["conv_id"]).select("conv_id", F.col("zone_seq").alias("turn"), "within")
    points = zones.select("conv_id", F.col("zone_seq").alias("turn"), (F.col("text_start") + F.floor(F.col("n") / 2)).cast("int").alias("offset"), F.col("n"))
    found = spatial.zone_at(points, lines.unionByName(whole), ["conv_id"], "line").withColumn("zone_seq", F.when(F.col("n") > 0, F.col("zone_seq")))
    return found.join(around, ["conv_id", "turn"]).select("conv_id", F.col("turn").cast("long").alias("turn"), "offset", "zone_seq", "within")


@query(
    """SELECT l_orderkey, l_linenumber, 'epubcfi(/6/' || (l_linenumber + 1) * 2 || '!/4/2/1)' AS cfi, CAST(l_linenumber AS INTEGER) AS section, 'epubcfi(/6/4[ch^]1]!/4/2/1:' || CAST(l_quantity AS INTEGER) || '[;s=a])' AS normal,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, CAST(l_quantity AS INTEGER), l_linenumber) AS INTEGER) AS place FROM lineitem"""
)
def cfi_places(spark, d):
    """Places in books as fragment identifiers: built, read, spelled canonically and put in order."""
    n, q, lit = F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.lit
    made = locators.section_cfi(n)
    exact = F.concat(lit("epubcfi(/6/"), (n % 3 + 1) * 2, lit("!/4/2/1:"), q, lit(")"))
    lines = table(spark, d, "lineitem").withColumn("_key", locators.cfi_sort_key(exact))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("_key", "l_linenumber"))
    normal = locators.normalized_cfi(F.concat(lit("epubcfi(/6/4[ch^]1]!/4/2/1:"), q, lit("[;s=a])")))
    return lines.select("l_orderkey", "l_linenumber", made.alias("cfi"), locators.cfi_section(made).alias("section"), normal.alias("normal"), place.alias("place"))


@query(
    """SELECT o_orderkey, '{"type":"TextPositionSelector","start":' || o_custkey || ',"end":' || o_custkey + 5 || '}' AS position, '{"type":"TextQuoteSelector","exact":"' || o_orderpriority || '","prefix":"a","suffix":"b"}' AS quote,
    CAST(o_custkey AS BIGINT) AS start, CAST(o_custkey + 5 AS BIGINT) AS "end", CASE WHEN o_orderkey % 2 = 0 THEN ['TextQuoteSelector'] ELSE [] END AS supported, CASE WHEN o_orderkey % 2 = 0 THEN [] ELSE ['SvgSelector'] END AS unsupported,
    CASE WHEN o_orderkey % 3 = 0 THEN 'text' WHEN o_orderkey % 3 = 1 THEN 'page' END AS kind FROM orders"""
)
def selectors_and_locators(spark, d):
    """Web annotation selectors both ways, their support, and the locator codec."""
    o, c, lit = F.col("o_orderkey"), F.col("o_custkey").cast("int"), F.lit
    position = locators.position_selector(c, c + 5)
    back = locators.from_position_selector(position)
    target = F.concat(lit('{"target":{"source":"x","selector":[{"type":"'), F.when(o % 2 == 0, "TextQuoteSelector").otherwise("SvgSelector"), lit('"}]}}'))
    support = locators.selector_support(target)
    of_text, of_page = o % 3 == 0, o % 3 == 1
    fields = [F.when(of_text, "text").when(of_page, "page").otherwise("cfi").alias("kind"), F.when(of_text, c).alias("section"), F.when(of_text, lit(0)).alias("start"), F.when(of_text, lit(4)).alias("end")]
    fields += [F.when(o % 3 == 2, "no cfi").alias("cfi"), F.when(of_page, lit(1)).alias("page"), F.when(of_page, lit(2)).alias("total"), lit(1).alias("v")]
    kind = locators.locator_of(locators.locator_json(F.struct(*fields)))["kind"]
    return table(spark, d, "orders").select(
        "o_orderkey", position.alias("position"), locators.quote_selector(F.col("o_orderpriority"), lit("a"), lit("b")).alias("quote"), back["start"].cast("long").alias("start"), back["end"].cast("long").alias("end"),
        support["supported"].alias("supported"), support["unsupported"].alias("unsupported"), kind.alias("kind"),
    )


@query("SELECT CAST(o_custkey AS BIGINT) AS owner, CAST(count(*) AS INTEGER) AS n, min(o_orderkey) AS \"first\", max(o_orderkey) AS \"last\", CAST(count(*) FILTER (WHERE o_orderkey % 2 = 0) AS INTEGER) AS n_bookmarks FROM orders GROUP BY 1")
def annotation_codec(spark, d):
    """Highlights and bookmarks of each owner as JSON and back."""
    lit, names = F.lit, lambda schema: ["owner", *[f.split()[0].strip("`") for f in schema.split(", ")]]
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("owner"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"), "o_orderpriority", "o_orderkey")
    none = lit(None).cast("string")
    high = o.select("owner", "id", lit(0), lit(1), lit(5), "o_orderpriority", lit(""), lit(""), "at", none).toDF(*names(codecs.HIGHLIGHT))
    marks = o.where(F.col("o_orderkey") % 2 == 0).select("owner", "id", "o_orderpriority", lit(0), lit(1), "at", none).toDF(*names(codecs.BOOKMARK))
    back = codecs.annotations_json(high, marks, "owner").select("owner", codecs.annotations_of(F.col("json")).alias("b"))
    ids = F.transform("b.highlights", lambda h: h["id"].cast("long"))
    return back.select(F.col("owner").cast("long").alias("owner"), F.size("b.highlights").alias("n"), F.array_min(ids).alias("first"), F.array_max(ids).alias("last"), F.size("b.bookmarks").alias("n_bookmarks"))


@query(
    """WITH last AS (SELECT l_orderkey, l_returnflag, arg_max(l_partkey, l_linenumber * 1000000 + l_partkey) AS v FROM lineitem GROUP BY 1, 2)
    SELECT o_orderkey, coalesce(list(l_returnflag || '=' || v ORDER BY l_returnflag) FILTER (WHERE l_returnflag IS NOT NULL), []) AS pairs, CAST(coalesce(max(v) FILTER (WHERE l_returnflag = 'A'), o_custkey) AS BIGINT) AS air
    FROM orders LEFT JOIN last ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey"""
)
def catalogue_maps(spark, d):
    """Identifiers by scheme, the last of each winning; a column fills in a scheme that is missing."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", F.col("l_partkey").cast("string").alias("v"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos"))
    values = catalogue.last_values(lines, "o_orderkey", "l_returnflag", "v", "pos")
    out = catalogue.assemble(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", {}, {"ids": values})
    full = catalogue.backfilled(F.col("ids"), "A", F.col("o_custkey").cast("string"))
    pairs = F.transform(F.array_sort(F.map_entries(F.coalesce("ids", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("o_orderkey", pairs.alias("pairs"), full["A"].cast("long").alias("air"))


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS INTEGER) AS target FROM orders")
def navigation_targets(spark, d):
    """Paths of navigation matched to sections: equal, equal but for case, or the end of a section's path."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("book_id"))
    nav = o.withColumn("path", pick(F.col("book_id"), ["OEBPS/Text/b.xhtml", "oebps/text/B.XHTML", "c.xhtml", "d.xhtml"]))
    names = F.array(*map(F.lit, ["OEBPS/a.xhtml", "OEBPS/Text/b.xhtml", "OEBPS/Text/c.xhtml"]))
    sections = o.select("book_id", F.posexplode(names).alias("section_index", "name"))
    return reading.match_targets(nav, sections).select(F.col("book_id").alias("o_orderkey"), "target")


@query("WITH s AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations) SELECT conv_id, turn, round(CASE WHEN n > 0 THEN least(50, n) / n ELSE 0 END, 6) AS inside FROM s")
def section_fractions(spark, d):
    progress = reading.progression(table(spark, d, "conversations"), "conv_id", "turn", F.length(F.coalesce("text", F.lit(""))))
    return progress.select("conv_id", "turn", F.round(reading.section_fraction(F.lit(50)), 6).alias("inside"))


PACKAGES = """b AS (SELECT o_orderkey AS book_id, CASE o_orderkey % 5 WHEN 0 THEN '1.0' WHEN 1 THEN '4' ELSE '3.0' END AS version, CASE WHEN o_orderkey % 7 = 0 THEN 'text/plain' ELSE 'application/epub+zip' END AS mimetype, CASE WHEN o_orderkey % 11 > 0 THEN 'OEBPS/p' || o_orderkey % 13 || '.opf' END AS rootfile FROM orders),
    s AS (SELECT l_orderkey AS book_id, 'i' || l_suppkey % 9 AS idref FROM lineitem WHERE l_linenumber > 1), m AS (SELECT DISTINCT l_orderkey AS book_id, 'i' || l_suppkey % 9 AS idref FROM lineitem WHERE l_linenumber < 4),
    t AS (SELECT o_orderkey AS book_id FROM orders WHERE o_orderkey % 3 = 0)"""


@query(
    f"""WITH {PACKAGES}, f AS (
      SELECT book_id, 'error' AS severity FROM b WHERE mimetype <> 'application/epub+zip' UNION ALL SELECT book_id, 'error' FROM b WHERE book_id % 2 = 1 UNION ALL SELECT book_id, 'error' FROM b WHERE rootfile IS NULL
      UNION ALL SELECT book_id, 'error' FROM b WHERE rootfile <> 'OEBPS/p1.opf' UNION ALL SELECT book_id, 'warning' FROM b WHERE version <> '3.0'
      UNION ALL SELECT s.book_id, 'error' FROM s ANTI JOIN m USING (book_id, idref) UNION ALL SELECT book_id, 'warning' FROM (SELECT book_id, idref FROM s GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT book_id, 'error' FROM b ANTI JOIN s USING (book_id)
      UNION ALL SELECT book_id, 'warning' FROM b UNION ALL SELECT book_id, 'warning' FROM b ANTI JOIN t USING (book_id) UNION ALL SELECT book_id, 'error' FROM t WHERE book_id % 2 = 0 UNION ALL SELECT book_id, 'warning' FROM t WHERE book_id % 2 = 1
      UNION ALL SELECT book_id, 'warning' FROM b WHERE book_id % 4 = 0)
    SELECT book_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM f GROUP BY 1"""
)
def package_reports(spark, d):
    """Container, package, spine, navigation and guide rules, counted by severity."""
    o, l, lit = table(spark, d, "orders").select(F.col("o_orderkey").alias("book_id")), table(spark, d, "lineitem"), F.lit
    key = F.col("book_id")
    rootfile = F.when(key % 11 > 0, F.concat(lit("OEBPS/p"), key % 13, lit(".opf")))
    books = o.select("book_id", pick(key, ["1.0", "4", "3.0", "3.0", "3.0"]).alias("version"), F.when(key % 7 == 0, "text/plain").otherwise("application/epub+zip").alias("mimetype"), rootfile.alias("rootfile"))
    item = F.concat(lit("i"), F.col("l_suppkey") % 9)
    spine = l.where("l_linenumber > 1").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("pos"), item.alias("idref"))
    manifest = l.where("l_linenumber < 4").select(F.col("l_orderkey").alias("book_id"), item.alias("item_id"))
    paths = lambda *p: F.array(*map(lit, p))
    entries = o.select("book_id", F.posexplode(F.when(key % 2 == 0, paths("mimetype", "META-INF/container.xml", "OEBPS/p1.opf")).otherwise(paths("mimetype", "a.xhtml", "OEBPS/p1.opf"))).alias("pos", "path"))
    toc = o.where(key % 3 == 0).select("book_id", lit(0).alias("pos"), lit("toc").alias("kind"), lit("a.xhtml").alias("path"), lit("f").alias("fragment"))
    guide = o.where(key % 4 == 0).select("book_id", lit(0).alias("pos"), lit("guide").alias("kind"), lit("none.xhtml").alias("path"), lit(None).cast("string").alias("fragment"))
    places = o.select("book_id", lit("a.xhtml").alias("path"), lit("other").alias("fragment"))
    parts = [*package_rules.container_rules(books, entries), *package_rules.spine_rules(books, spine, manifest), *package_rules.navigation_rules(books, toc.unionByName(guide), entries, places)]
    return package_rules.report(reduce(lambda a, b: a.unionByName(b), parts))


@query("SELECT count(*) AS sections, (SELECT count(*) FROM documents WHERE regexp_matches(text, '(?i)\\bapache\\b')) AS apache, CAST(2 AS INTEGER) AS refused FROM documents")
def index_round_trip(spark, d):
    """The index written with identity and digests, read back, and refused for another publication or changed texts."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    postings, stats, _ = stored_index(spark, d)
    who, path = {"tokenizer": "fold", "normalization": "none", "profile": "text", "publication": None}, new_path(spark, "export")
    index_store.export(path, docs, postings, stats, ["doc_id"], who)
    back, own = index_store.load(spark, path, docs, ["doc_id"], who)
    refused = 0
    for live, other in ((docs, who | {"publication": "x"}), (docs.withColumn("text", F.concat("text", F.lit("x"))), who)):
        try:
            index_store.load(spark, path, live, ["doc_id"], other)
        except index_store.Incompatible:
            refused += 1
    held = back.where("term = 'apache'").agg(F.count("*").alias("apache"))
    return own.agg(F.count("*").alias("sections")).crossJoin(held).withColumn("refused", F.lit(refused))


@query("SELECT CAST(n_nationkey AS INTEGER) AS k, n_nationkey % 4 <> 1 AS agrees FROM nation")
def index_identities(spark, d):
    """Identity tuples agree field by field, a missing field only with a missing one."""
    n, lit = F.col("n_nationkey"), F.lit
    fields = lambda publication: F.struct(lit("t").alias("tokenizer"), lit("n").alias("normalization"), lit("p").alias("profile"), publication.alias("publication"))
    mine, other = F.when(n % 2 == 0, "x"), F.when((n % 4 == 1) | (n % 2 == 0), "x")
    return table(spark, d, "nation").select(n.cast("int").alias("k"), fields(mine).alias("a"), fields(other).alias("b")).select("k", index.compatible(F.col("a"), F.col("b")).alias("agrees"))


@query(
    """WITH q AS (SELECT c_custkey, length(list_reduce([x || c_custkey for x in ['ab', 'cd', 'ef', 'gh', 'ij', 'kl', 'mn', 'op', 'qr']], lambda a, b: a || ' ' || b)) AS n FROM customer)
    SELECT c_custkey AS anchor_id, 'resolved' AS outcome, CASE c_custkey % 3 WHEN 0 THEN 'identity' WHEN 1 THEN 'exact' ELSE 'normalized' END AS pass, c_custkey AS section, CAST(CASE c_custkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 11 ELSE 4 END AS INTEGER) AS start,
    CAST(n + CASE c_custkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 11 ELSE 12 END AS INTEGER) AS "end" FROM q"""
)
def anchor_passes(spark, d):
    """Ranges captured with their context, found again in texts that stayed, moved or had their white space changed."""
    c, lit = table(spark, d, "customer"), F.lit
    words = F.transform(F.array(*map(lit, ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr"])), lambda w: F.concat(w, F.col("c_custkey").cast("string")))
    body = F.concat(lit("Now "), F.array_join(words, " "), lit(" end"))
    before = c.select(F.col("c_custkey").alias("section"), body.alias("text"))
    ranges = c.select(F.col("c_custkey").alias("anchor_id"), F.col("c_custkey").alias("section"), lit(4).alias("start"), (F.length(body) - 4).cast("int").alias("end"))
    key = F.col("section")
    after = before.select("section", F.when(key % 3 == 0, F.col("text")).when(key % 3 == 1, F.concat(lit("Before "), "text")).otherwise(F.concat(lit("Now "), F.regexp_replace(F.substr("text", lit(5)), " ", "\n ")).alias("t")).alias("text"))
    return anchors.resolve(anchors.capture(before, ranges), after, fuzzy=False)


TALKS = """t AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, length(coalesce(text, '')) AS n FROM conversations),
    o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, sum(n) OVER (PARTITION BY conv_id) AS total FROM t)"""


def _talk_pages(spark, d):
    """A conversation as a section in XHTML, its turns as paragraphs with ids."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    paragraph = lambda r, k: F.concat(F.lit('<p id="t'), k, F.lit('">'), text.escape_html(r["text"]), F.lit("</p>"))
    html = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>x</title></head><body>'), F.array_join(F.transform("t", paragraph), ""), F.lit("</body></html>"))
    return rows.select("conv_id", html.alias("html"), F.posexplode("t").alias("k", "r")).select("conv_id", "html", "k", F.col("r.text").alias("text"))


@query(
    f"""WITH {TALKS} SELECT conv_id, CAST(k AS INTEGER) AS k, 'epubcfi(/6/' || (k + 1) * 2 || '!/4/' || (k + 1) * 2 || '[t' || k || ']/1:' || n // 2 || ')' AS cfi, CAST(pos + n // 2 AS INTEGER) AS start, CAST(pos AS INTEGER) AS anchor,
    CASE WHEN n > 1 THEN 'epubcfi(/4/' || (k + 1) * 2 || '[t' || k || '],/1:0,/1:' || n // 2 || ')' END AS span, CASE WHEN n > 1 THEN CAST(pos + n // 2 AS INTEGER) END AS span_end FROM o"""
)
def cfi_documents(spark, d):
    """Places and ranges in sections as identifiers, resolved back to offsets, and offsets of anchors."""
    pages = _talk_pages(spark, d).withColumn("n", F.length("text"))
    anchor = cfi.anchor_offset(F.col("html"), F.concat(F.lit("t"), "k"))
    pages = pages.withColumn("anchor", anchor).withColumn("mid", F.col("anchor") + F.floor(F.col("n") / 2).cast("int"))
    pages = pages.withColumn("cfi", cfi.cfi_for(F.col("html"), F.col("mid"), section=F.col("k"))).withColumn("span", F.when(F.col("n") > 1, cfi.cfi_for(F.col("html"), F.col("anchor"), F.col("mid"))))
    pages = pages.withColumn("book_id", F.col("conv_id"))
    found = cfi.resolve_cfis(pages.drop("html"), pages.select("book_id", F.col("k").alias("section_index"), "html"))
    back = pages.select("conv_id", "k", cfi.cfi_place(F.col("html"), F.col("span"))["end"].alias("span_end"))
    return found.join(back, ["conv_id", "k"]).select("conv_id", "k", "cfi", "start", "anchor", "span", "span_end")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'stored' WHEN c_custkey % 3 = 1 THEN c_name || ', Der' END AS title_sort, CASE WHEN c_custkey % 2 = 0 THEN 'stored' ELSE 'Lee, Ann & ' || c_name END AS author_sort,
    CASE c_custkey % 3 WHEN 0 THEN 'pre-paginated' WHEN 1 THEN 'reflowable' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'pre-paginated' ELSE 'reflowable' END END AS layout, 'Guild of ' || c_name AS guild FROM customer"""
)
def effective_keys(spark, d):
    """Stored sort keys or computed ones, layouts of spine items, and author keys under given word lists."""
    key, name, lit = F.col("c_custkey"), F.col("c_name"), F.lit
    title = F.when(key % 3 < 2, F.concat(lit("Der "), name))
    own = F.when(key % 3 == 0, F.array(lit("page-spread-left"), lit("rendition:layout-pre-paginated"))).when(key % 3 == 1, F.array(lit("rendition:layout-reflowable")))
    return table(spark, d, "customer").select(
        "c_custkey", metadata.effective_title_sort(title, F.when(key % 3 == 0, "stored").otherwise(""), F.array(lit("de"), lit("en"))).alias("title_sort"),
        metadata.effective_author_sort(F.array(lit("Ann Lee"), name), F.when(key % 2 == 0, "stored")).alias("author_sort"),
        metadata.effective_layout(own, F.when(key % 2 == 0, "pre-paginated").otherwise("other")).alias("layout"), metadata.author_sort(F.concat(lit("Guild of "), name), copy_words=["guild"]).alias("guild"),
    )


LE = "'sha256:' || sha256(unhex(regexp_replace(hex(encode({x})), '(..)', '\\100', 'g')))"


@query(
    "WITH s AS (SELECT l_orderkey, '[' || string_agg('[\"p' || l_partkey || '.xhtml\",' || CASE WHEN l_partkey % 2 = 0 THEN 'true' ELSE 'false' END || ']', ',' ORDER BY l_linenumber, l_partkey) || ']' AS x FROM lineitem GROUP BY 1) "
    "SELECT l_orderkey, " + LE.format(x="x") + " AS reading_order, " + LE.format(x="'{\"algorithm\":\"plain\",\"options\":{\"a\":\"1\",\"b\":\"' || l_orderkey || '\"},\"planRevision\":\"r\"}'") + " AS profile FROM s"
)
def order_revisions(spark, d):
    """Digests of reading orders and of text profiles."""
    row = F.struct("l_linenumber", "l_partkey")
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("r"))
    order = F.transform("r", lambda r: F.struct(F.concat(F.lit("p"), r["l_partkey"], F.lit(".xhtml")).alias("path"), (r["l_partkey"] % 2 == 0).alias("is_html")))
    options = F.create_map(F.lit("b"), F.col("l_orderkey").cast("string"), F.lit("a"), F.lit("1"))
    return orders.select("l_orderkey", text.order_revision(order).alias("reading_order"), text.profile_revision(F.lit("plain"), options, F.lit("r")).alias("profile"))


@query(
    """WITH m AS (SELECT DISTINCT l_orderkey, l_partkey % 500 AS start FROM lineitem WHERE l_partkey % 500 > 0 UNION SELECT DISTINCT l_orderkey, 0 FROM lineitem)
    SELECT l_orderkey, CAST(row_number() OVER w - 1 AS INTEGER) AS section_index, CAST(start AS INTEGER) AS start, CAST(coalesce(lead(start) OVER w, 500) AS INTEGER) AS "end" FROM m WINDOW w AS (PARTITION BY l_orderkey ORDER BY start)"""
)
def section_tiles(spark, d):
    """Texts cut at their marks: each section ends where the next begins."""
    marks = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 500).cast("int").alias("offset"))
    return mobi6.tiles(marks, marks.select("l_orderkey").distinct().withColumn("length", F.lit(500)), "l_orderkey")


@query(
    """WITH r AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber * l_linenumber AS DOUBLE) AS top FROM lineitem), p AS (SELECT *, top - lag(top) OVER (PARTITION BY l_orderkey ORDER BY top) AS pitch FROM r),
    m AS (SELECT l_orderkey, list_sort(list(pitch) FILTER (WHERE pitch IS NOT NULL)) AS l FROM p GROUP BY 1), b AS (SELECT p.*, max(CASE WHEN pitch > 1.6 * l[len(l) // 2 + 1] THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY top ROWS UNBOUNDED PRECEDING) AS broken FROM p JOIN m USING (l_orderkey))
    SELECT l_orderkey, top FROM b WHERE broken = 0"""
)
def table_rows(spark, d):
    """Rows of a table as long as they keep its rhythm."""
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * F.col("l_linenumber")).cast("double").alias("top")).distinct()
    return spatial.contiguous_rows(rows, ["l_orderkey"])


@query(
    """WITH c AS (SELECT l_suppkey, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_suppkey, max(value) AS best FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY n DESC) AS r FROM c) WHERE r = 1 GROUP BY 1)
    SELECT l_suppkey, best AS value, min(value) AS low, max(value) AS high, CAST(sum(n) AS BIGINT) AS n FROM c JOIN b USING (l_suppkey) WHERE abs(value - best) <= 2 GROUP BY 1, 2"""
)
def common_indents(spark, d):
    """The most frequent value and what clusters around it."""
    return spatial.commonest(table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("value")), ["l_suppkey"])


@query(
    """WITH v AS (SELECT l_suppkey, CAST(floor((l_quantity / 10.0 % pi()) / pi() * 12) % 12 AS INTEGER) AS b FROM lineitem), s AS (SELECT l_suppkey, (b + x.k + 12) % 12 AS bin, sum(CASE WHEN x.k = 0 THEN 2 ELSE 1 END) AS votes FROM v CROSS JOIN (VALUES (-1), (0), (1)) AS x(k) GROUP BY 1, 2)
    SELECT l_suppkey, CAST(bin AS INTEGER) AS bin FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, bin) AS r FROM s) WHERE r = 1"""
)
def orientation_votes(spark, d):
    """Twelve bins of angles, smoothed over their neighbours, and the fullest of them."""
    angles = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity").cast("double") / 10.0).alias("angle"))
    return spatial.orientation_bins(angles, ["l_suppkey"])


@query("SELECT DISTINCT l_orderkey, CAST(CASE WHEN n > 1 THEN 0 END AS INTEGER) AS bin FROM (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) WHERE n > 1")
def page_orientations(spark, d):
    """Words in a row: their nearest neighbours stand beside them, so the page is horizontal."""
    words = _boxes(spark, d, lambda n: n * 100, lambda n: n * 0)
    return spatial.orientation_bins(spatial.with_neighbour_angles(words, ["l_orderkey"]), ["l_orderkey"])


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'Order ' || o_orderkey END AS title, CASE WHEN o_orderkey % 6 IN (0, 5) THEN ['Clerk'] END AS authors,
    CASE o_orderkey % 6 WHEN 1 THEN '/links' WHEN 2 THEN '/metadata/title' WHEN 3 THEN '/metadata/modified' WHEN 4 THEN '' END AS pointer, CASE WHEN o_orderkey % 6 IN (0, 5) THEN epoch_us(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 10 HOUR) END AS modified_us FROM orders"""
)
def feed_publications(spark, d):
    """Publications in JSON: read, or refused with the place that is wrong; times as instants."""
    o, lit, sixth = table(spark, d, "orders"), F.lit, F.col("o_orderkey") % 6
    title = F.when(sixth == 2, lit("")).otherwise(F.concat(lit('"title":"Order '), "o_orderkey", lit('",')))
    stamp = F.when(sixth == 3, lit("2020-02-30T00:00:00Z")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), lit("T12:00:00+02:00")))
    rel = F.when(sixth == 1, lit("self")).otherwise(lit("http://opds-spec.org/acquisition/buy"))
    whole = F.concat(lit('{"metadata":{'), title, lit('"author":{"name":{"en":"Clerk"}},"modified":"'), stamp, lit('"},"links":[{"href":"x","rel":"'), rel, lit('"}]'), F.when(sixth == 4, lit("")).otherwise(lit("}")))
    read = o.select("o_orderkey", opds2.publications(whole).alias("p"))
    return read.select("o_orderkey", "p.title", "p.authors", "p.pointer", F.unix_micros(opds2.rfc3339_time(F.col("p.modified"))).alias("modified_us"))


@query(
    f"""WITH {TALKS} SELECT conv_id, CAST(k AS INTEGER) AS k, CAST(CASE k % 4 WHEN 3 THEN NULL ELSE 0 END AS INTEGER) AS target, CAST(CASE k % 4 WHEN 0 THEN pos WHEN 1 THEN 0 END AS INTEGER) AS "offset" FROM o"""
)
def navigation_offsets(spark, d):
    """Navigation with fragments: to an anchor, to a section as a whole, to an anchor that is missing, to no section."""
    pages = _talk_pages(spark, d)
    sections = pages.select(F.col("conv_id").alias("book_id"), F.lit(0).alias("section_index"), F.lit("OEBPS/a talk.xhtml").alias("name"), "html").dropDuplicates(["book_id"])
    href = F.concat(pick(F.col("k"), ["a%20talk.xhtml#t", "OEBPS/A%20talk.xhtml", "a%20talk.xhtml#none", "b.xhtml#t"]), F.when(F.col("k") % 4 != 1, F.col("k").cast("string")).otherwise(""))
    nav = pages.select(F.col("conv_id").alias("book_id"), "k", href.alias("href"))
    return reading.nav_targets(nav, sections).select(F.col("book_id").alias("conv_id"), "k", "target", "offset")


@query(
    """WITH w AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS k FROM lineitem)
    SELECT l_suppkey, CAST(k // 400 AS INTEGER) AS page, CAST(k % 400 AS INTEGER) AS k, CAST(k % 400 // 10 AS INTEGER) AS line, CAST(k % 400 // 50 AS INTEGER) AS block FROM w"""
)
def page_segments(spark, d):
    """Rows as words of pages, dealt to lines of ten and paragraphs of five lines, which are found again from the words' places."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    words = table(spark, d, "lineitem").withColumn("n", F.row_number().over(order) - 1).withColumn("k", F.col("n") % 400)
    line = F.floor(F.col("k") / 10)
    words = words.select("l_suppkey", F.floor(F.col("n") / 400).cast("int").alias("page"), "k", (F.col("k") % 10 * 10.0).alias("x"), (line * 24.0 + F.floor(line / 5) * 100.0).alias("y"), F.lit(8.0).alias("w"), F.lit(10.0).alias("h"))
    return segments.segmented(words, ["l_suppkey", "page"]).select("l_suppkey", "page", "k", "line", "block")


@query(
    """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, coalesce(text, '') AS text FROM conversations),
    c AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix FROM t WHERE k % 3 <> 2 AND conv_id % 5 <> 0),
    r AS (SELECT conv_id, k, CASE WHEN conv_id % 5 = 0 THEN 'no-canonical-text' WHEN k % 7 = 3 THEN 'text-mismatch' WHEN k % 7 = 4 THEN 'bounds' WHEN k % 3 = 2 THEN 'line-dropped' END AS reason FROM t)
    SELECT conv_id, CAST(k AS INTEGER) AS line_no, CASE reason WHEN 'no-canonical-text' THEN 'unsupported' ELSE CASE WHEN reason IS NULL THEN 'mapped' ELSE 'missing' END END AS outcome, reason, CAST(CASE WHEN reason IS NULL THEN prefix + 2 END AS INTEGER) AS "offset", CAST(CASE WHEN reason IS NULL THEN 3 END AS INTEGER) AS length
    FROM r LEFT JOIN c USING (conv_id, k) UNION ALL SELECT DISTINCT conv_id, 999, CASE WHEN conv_id % 5 = 0 THEN 'unsupported' ELSE 'missing' END, CASE WHEN conv_id % 5 = 0 THEN 'no-canonical-text' ELSE 'line-out-of-range' END, NULL, NULL FROM t"""
)
def source_ranges(spark, d):
    """Ranges of source lines carried into a canonical text that lacks some lines, with the reason where they cannot be."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    source = table(spark, d, "conversations").select("conv_id", (F.row_number().over(w) - 1).cast("int").alias("line_no"), F.coalesce("text", F.lit("")).alias("text"))
    source = source.withColumn("y", F.col("line_no") * 12.0)  # where the line stands on its page
    kept = source.where("line_no % 3 <> 2 AND conv_id % 5 <> 0")  # what the reflow left
    lines = kept.withColumn("line_no", (F.row_number().over(Window.partitionBy("conv_id").orderBy("line_no")) - 1).cast("int"))
    late = F.when(F.col("line_no") % 7 == 4, F.length("text") + 1).otherwise(5).cast("int")
    ranges = source.select("conv_id", "line_no", F.lit(2).alias("start"), late.alias("end"), F.when(F.col("line_no") % 7 == 3, "other").otherwise(F.col("text")).alias("expected"))
    beyond = source.select("conv_id").distinct().select("conv_id", F.lit(999).alias("line_no"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(None).cast("string").alias("expected"))
    found = canonical.mapped_ranges(ranges.unionByName(beyond), source, lines, ["conv_id"], ["text", "y"])
    return found.select("conv_id", "line_no", "outcome", "reason", "offset", "length")
