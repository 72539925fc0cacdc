"""Scalar functions against golden values."""

import hashlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from quire.functions import locators, metadata, text
from quire.operators import index


def each(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["x"] for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_word_count(spark):
    values = ["山の上に白い雲、風", "first 漢字 last", "", "\tq  r s\n", "k l m", "d\x1ce\x85f"]
    assert each(spark, text.word_count, values) == [9, 4, 0, 3, 3, 3]


def test_lengths_and_revisions(spark):
    values = ["a𐍈b", "", "é"]
    assert each(spark, text.u16_length, values) == [4, 0, 1]
    assert each(spark, text.text_revision, values) == ["sha256:" + hashlib.sha256(v.encode("utf-16-le")).hexdigest() for v in values]
    assert each(spark, text.reading_minutes, [0, 1, 200, 201], "int") == [0, 1, 1, 2]


@pytest.mark.parametrize(
    ("html", "plain"),
    [
        ("a < b <c> d", "a d"), ("before<!-- c -->after", "before after"), ('<div class="a > b">attr</div>', 'b">attr'), ("a&amp;lt;b", "a&lt;b"), ("&#60;x&#x3E; &nbsp; y", "<x> y"),
        ("<script>var a='</p>';</script>x<style>p{}</style>y", "x y"), ("<SCRIPT>open", "open"), ("&NBSP; &#38", "&NBSP; &#38"), ("a\xa0　b", "a b"), ("", ""),
    ],
)
def test_plain_text(spark, html, plain):
    assert text.plain_text_of(html) == plain
    assert each(spark, text.plain_text, [html]) == [plain]


@pytest.mark.parametrize(
    ("html", "doc"),
    [
        ("<html><head><title>x</title></head><body><p>abc</p></body></html>", "abc"), ("a&nbsp;b", "a\xa0b"), ("<body>one</body>two</body>", "one</body>two".replace("</body>", "")), ("x<![CDATA[y]]>z", "x$1z"),
        ("a &copy; &bogus; &#0; &#x41;", "a © &bogus; � A"), ("a&am<b></b>p;b", "a&b"), ("no <1 tag", "no <1 tag"), ("<body>unclosed <p>x", "unclosed x"),
    ],
)
def test_document_text(html, doc):
    assert text.document_text_of(html) == doc


def test_typography(spark):
    assert each(spark, text.smarten_punctuation, ["a cook's pan", "stop--now...", 'it read "red" ("blue")']) == ["a cook’s pan", "stop—now…", "it read “red” (“blue”)"]
    assert each(spark, text.unwrap_lines, ["a long win-\nter night\n\nThen spring", "two\nlines"]) == ["a long winter night\n\nThen spring", "two lines"]
    assert each(spark, text.chapter_titles, ["Chapter 1\ntext\nCapítulo II\nparted ways"]) == [["Chapter 1", "Capítulo II"]]
    assert each(spark, text.txt_normalize, ["\n\na  \r\nb\x00\n\n\n\n\n\n\nc\n"]) == ["a\nb\n\n\n\n\nc"]
    assert each(spark, text.slug, ["  Héllo, World! "]) == ["h-llo-world"]
    assert [h and (h["title"], h["authors"]) for h in each(spark, text.txt_header, ["T\n\n\nA, B\nx", "T\nx"])] == [("T", ["A", "B"]), None]


def test_title_sort(spark):
    values = [("The Silver Road", "en"), ("O Barco", "pt"), ("O Barco", "en"), ("“An Oar”", None), ("L'Olivier", "fr-FR"), ("De la Mer", "fra"), ("Die Brücke", "deu"), ("Der Wald", "xx"), ("Kamień", "pl"), ("«Une Rue»", "fr")]
    want = ["Silver Road, The", "Barco, O", "O Barco", "Oar, An", "Olivier, L'", "Mer, De la", "Brücke, Die", "Der Wald", "Kamień", "Rue, Une"]
    rows = spark.createDataFrame([(k, *v) for k, v in enumerate(values)], "k int, t string, l string")
    assert [r["x"].strip() for r in rows.select("k", metadata.title_sort(F.col("t"), F.col("l")).alias("x")).orderBy("k").collect()] == want


def test_author_sort(spark):
    cases = {
        "Mara Holt": "Holt, Mara", "Dr. Ivo Peter Lind Jr.": "Lind, Ivo Peter Jr.", "Holt, Mara": "Holt, Mara", "Ovid": "Ovid", "Northern Corporation": "Northern Corporation", "": "",
        "Ann Lee (editor)": "Lee, Ann", "Mr. Dr.": "Mr. Dr.", "Iris B. De Wit": "Wit, Iris B. De", "Mara Holt III": "Holt, Mara III",
    }
    assert each(spark, metadata.author_sort, list(cases)) == list(cases.values())
    assert each(spark, metadata.remove_brackets, ["a[b]c(d)e{f}g<h>i", "x)y", "a(b", "a([b)c]d"]) == ["aceg<h>i", "xy", "a", "ad"]


def test_small_normalisers(spark):
    assert each(spark, metadata.isbn, ["urn:isbn:978-0-306-40615-7", "0-306-40615-x", " none "]) == ["9780306406157", "030640615X", "none"]
    assert each(spark, metadata.series_index, ["1,5", " 2 ", "x", None]) == [1.5, 2.0, None, None]
    assert each(spark, metadata.is_rtl, ["ar", "he_IL", "en", None]) == [True, True, False, False]
    assert each(spark, metadata.split_authors, ["A; B | C and D"]) == [["A", "B", "C", "D"]]
    assert each(spark, metadata.partial_date, ["2001", "2001-02-30", "2001-2-3T00", "x"]) == [date(2001, 1, 1), None, date(2001, 2, 3), None]
    assert each(spark, metadata.clock_ms, ["0:00:01.5", "02:03", "12.5s", "250ms", "2min", "1h", "7", "bad"]) == [1500, 123000, 12500, 250, 120000, 3600000, 7000, None]
    assert each(spark, metadata.normalize_path, ["a/./b/../c", "\\x\\y", "../z"]) == ["a/c", "x/y", "z"]
    assert each(spark, metadata.percent_decoded, ["a%20b+c", "%zz"]) == ["a b+c", "%zz"]
    names = ["p10.jpg", "p2.jpg", "p01.jpg", "a1b10", "a1b9"]
    keys = each(spark, metadata.natural_key, names)
    assert sorted(names, key=dict(zip(names, keys)).get) == ["a1b9", "a1b10", "p01.jpg", "p2.jpg", "p10.jpg"]


def test_merge_and_localized(spark):
    df = spark.sql("SELECT named_struct('t', 'base', 'l', array('x'), 'm', map('a', '1', 'b', '2')) b, named_struct('t', '', 'l', array('y'), 'm', map('b', '3')) o, map('en', 'E', 'pt-BR', 'P') v")
    m = df.select(metadata.merge_metadata(F.col("b"), F.col("o"), {"t": "text", "l": "list", "m": "map"}).alias("m")).first()["m"]
    assert (m["t"], m["l"], m["m"]) == ("base", ["y"], {"a": "1", "b": "3"})
    got = df.select(*[metadata.localized(F.lit(None).cast("string"), F.col("v"), F.lit(x)).alias(x.replace("-", "_")) for x in ("en", "pt", "xx")]).first()
    assert tuple(got) == ("E", "P", "E")


def test_tokenizer():
    assert index.tokenize_text("Três, gatos!") == [("tres", 0, 4), ("gatos", 6, 11)]
    assert [t for t, _, _ in index.tokenize_text("Gruß up-to-date win­ter Σ 山川 ＣＤ２ y³")] == ["gruss", "up", "to", "date", "winter", "σ", "山川", "cd2", "y"]
    assert [t for t, _, _ in index.tokenize_text("Έ έ Б ё Œdème")] == ["έ", "ε", "б", "ё", "oedeme"]


def test_cfi(spark):
    good = ["epubcfi(/6/4!/4)", "epubcfi(/6/4!/4/4/1:40)", "epubcfi(/6/4[spine4]!/4[body]/4[p4]/1:40)", "epubcfi(/6/4!/4/4[we^^ird^[p4^]^;]/1:40)", "epubcfi(/6/4!/4,/2/1:1,/4/1:40)", "epubcfi(/6/4!/4/2/1:3[;s=a])"]
    bad = ["pubcfi(/6/4!/4)", "epubcfi(/6/4!/4))", "epubCfi(/6/4)", "epubcfi()", "epubcfi(64!4)", "epubcfi(/6:1/4)", "epubcfi(/6/4!/4/1:0,/6/2!/4/2/1:5)", "", None]
    assert each(spark, locators.normalized_cfi, good + bad) == good + [None] * len(bad)
    order = ["epubcfi(/6/4!/4/1)", "epubcfi(/6/4!/4/1:3)", "epubcfi(/6/4!/4/2)", "epubcfi(/6/4!/4/10)", "epubcfi(/6/6!/4)"]
    assert sorted(reversed(order), key=lambda c: locators.cfi_order(locators.parse_cfi(c))) == order
    keys = each(spark, locators.cfi_sort_key, order)
    assert keys == sorted(keys)
    assert each(spark, locators.cfi_section, order + ["epubcfi(/6/3!/4)"]) == [1, 1, 1, 1, 2, None]


def test_selectors_and_locators(spark):
    df = spark.createDataFrame([("a𐍈b é", 2)], "t string, k int")
    got = df.select(locators.u16_from_code_points(F.col("t"), F.col("k")), locators.code_points_from_u16(F.col("t"), F.lit(3)), locators.code_points_from_u16(F.col("t"), F.lit(2))).first()
    assert tuple(got) == (3, 2, None)
    assert each(spark, locators.from_position_selector, ['{"type":"TextPositionSelector","start":1,"end":3}', '{"type":"X","start":1,"end":3}', "bad"]) == [(1, 3), None, None]
    assert [tuple(map(list, x)) for x in each(spark, locators.selector_support, ['{"target":{"selector":[{"type":"TextQuoteSelector"},{"type":"SvgSelector"}]}}', "{}", "x"])] == [(["TextQuoteSelector"], ["SvgSelector"]), ([], []), ([], [])]
    assert each(spark, locators.media_type, ["a/b.XHTML", "x.unknown", "none"]) == ["application/xhtml+xml", None, None]
    found = each(spark, locators.locator_of, ['{"v":1,"kind":"text","section":0,"start":1,"end":2}', '{"v":2,"kind":"page"}', '{"v":1,"kind":"page","page":3,"total":3}'])
    assert [f and f["kind"] for f in found] == ["text", None, None]
    assert locators.expand_template("/s{?query,author}{&x}/{id}", {"query": "a b", "id": "7"}) == "/s?query=a%20b{&x}/7"
