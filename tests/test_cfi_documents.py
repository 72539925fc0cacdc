"""Identifiers of places in documents, both ways."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import cfi_documents as cd

PAGE = """<html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title></head><body id="b">lead<p>one <em id="e^[1]">two</em> three<!-- x --> four</p><script>no()</script><p/>
<p id="q">a&nbsp;&lt;b&gt; \U0001f600x</p></body></html>"""


def test_offsets_and_identifiers():
    doc = cd.CfiDocument(PAGE)
    assert doc.text == "leadone two three four\na\xa0<b> \U0001f600x"
    assert cd.cfi_at(PAGE, 0) == "epubcfi(/4[b]/1:0)"
    assert cd.cfi_at(PAGE, 4) == "epubcfi(/4[b]/2/1:0)"
    assert cd.cfi_at(PAGE, 9) == "epubcfi(/4[b]/2/2[e^^^[1^]]/1:1)"
    assert cd.cfi_at(PAGE, doc.text.index("four")) == "epubcfi(/4[b]/2/3:7)"  # a comment does not cut its chunk
    assert cd.cfi_at(PAGE, len(doc.text)) == "epubcfi(/4[b]/8[q]/1:9)"  # UTF-16 units behind the pair
    assert cd.cfi_at(PAGE, 8, 11, 2) == "epubcfi(/6/6!/4[b]/2/2[e^^^[1^]],/1:0,/1:3)".replace("/2[e^^^[1^]],/1:0,/1:3", ",/2[e^^^[1^]]/1:0,/3:0")
    assert cd.cfi_at(PAGE, 5, 6, 0) == "epubcfi(/6/2!/4[b]/2,/1:1,/1:2)"
    assert cd.cfi_at(PAGE, len(doc.text) + 1) is None and cd.cfi_at(PAGE, 3, 2) is None
    for at in range(len(doc.text) + 1):
        assert cd.place_of(PAGE, cd.cfi_at(PAGE, at))[0] == at
        for end in range(at + 1, len(doc.text) + 1):
            assert cd.place_of(PAGE, cd.cfi_at(PAGE, at, end, 1))[:2] == (at, end)


@pytest.mark.parametrize(
    ("cfi", "want"),
    [
        ("epubcfi(/4)", 0), ("epubcfi(/4/2)", 4), ("epubcfi(/4/8)", 23), ("epubcfi(/4/98[q])", 23), ("epubcfi(/4/2[q])", 23), ("epubcfi(/4/0)", 0), ("epubcfi(/4/10)", 31), ("epubcfi(/4/12)", None),
        ("epubcfi(/4/6/1:0)", 22), ("epubcfi(/4/2/1:99)", None), ("epubcfi(/2/2/1:0)", None), ("epubcfi(/4/4/1:0)", None), ("epubcfi(/4/8/1:7)", None), ("epubcfi(/4/2/1:1,/2)", None), ("x", None),
    ],
)
def test_what_paths_mean(cfi, want):
    got = cd.place_of(PAGE, cfi)
    assert (got and got[0]) == want


def test_soup_round_trips():
    r = random.Random(1)
    for _ in range(60):
        page = "<body>" + "".join(r.choice(["<p>", "</p>", "<b>", "</i>", "a & b", "&eacute;", "<br>", "text ", "<div id=x>", "</div>", "<!-- c -->", "&unknown;", "1 < 2 "]) for _ in range(30))
        doc = cd.CfiDocument(page)
        for at in range(len(doc.text) + 1):
            if (cfi := cd.cfi_at(page, at)) and doc.nodes:
                assert cd.place_of(page, cfi)[0] == at
    deep = "<html><body>" + "<div>" * 20_000 + "x" + "</div>" * 20_000 + "</body></html>"
    assert cd.place_of(deep, cd.cfi_at(deep, 1))[0] == 1


def test_anchors_and_books(spark):
    assert [cd.anchor_place(PAGE, n) for n in ("q", "e^[1]", "none", None)] == [23, 8, None, None]
    assert cd.anchor_place("<body><p>x</p><a name='n'>y</a></body>", "n") == 1
    sections = spark.createDataFrame([("k", 0, PAGE), ("k", 1, "<html><head/><body><p>other</p></body></html>")], "book_id string, section_index int, html string")
    marks = spark.createDataFrame([("k", "epubcfi(/6/4!/4/2/1:2)"), ("k", "epubcfi(/6/2!/4/2,/1:1,/3:2)"), ("k", "epubcfi(/6/8!/4)"), ("k", "bad")], "book_id string, cfi string")
    got = {r["cfi"]: tuple(r)[2:5] for r in cd.resolve_cfis(marks, sections).collect()}
    assert got == {"epubcfi(/6/4!/4/2/1:2)": (1, 2, None), "epubcfi(/6/2!/4/2,/1:1,/3:2)": (0, 5, 13), "epubcfi(/6/8!/4)": (None,) * 3, "bad": (None,) * 3}
    made = sections.select(cd.cfi_for(F.col("html"), F.lit(2), section=F.col("section_index")).alias("c")).collect()
    assert [r["c"] for r in made] == ["epubcfi(/6/2!/4[b]/1:2)", "epubcfi(/6/4!/4/2/1:2)"]
