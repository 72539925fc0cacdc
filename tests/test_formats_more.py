"""Metadata without texts, covers, the older Palm markup, OPDS 2 and package rules."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import package_rules, spatial
from quire.plans import made_files
from quire.sources import archive, books, epub_tables, mobi6, opds2


def package(items: str, head: str = "", guide: str = "", spine: str = "", version: str = "3.0") -> bytes:
    return f'<package xmlns="http://www.idpf.org/2007/opf" version="{version}"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title>{head}</metadata><manifest>{items}</manifest><spine>{spine}</spine>{guide}</package>'.encode()


IMAGE = '<item id="{0}" href="{0}.png" media-type="image/png" {1}/>'


@pytest.mark.parametrize(
    ("items", "head", "guide", "want"),
    [
        (IMAGE.format("x", "") + IMAGE.format("y", 'properties="svg cover-image"'), '<meta name="cover" content="x"/>', "", "y"),
        (IMAGE.format("x", "") + IMAGE.format("y", ""), '<meta name="cover" content="x"/>', "", "x"),
        (IMAGE.format("x", "") + IMAGE.format("z-Cover", ""), "", '<guide><reference type="Cover" href="./x.png#a"/></guide>', "x"),
        (IMAGE.format("x", "") + IMAGE.format("z-Cover", ""), "", "", "z-Cover"),
        ('<item id="cover" href="c.xhtml" media-type="application/xhtml+xml" properties="cover-image"/>', "", "", None),
    ],
)
def test_cover(items, head, guide, want):
    found = books.cover_item(books.parse_opf(package(items, head, guide)))
    assert (found and found["id"]) == want


def test_metadata_reads_nothing_else(spark, monkeypatch):
    turns = ["one & two", "three"]
    made = {k: f("The title", "An author", turns) for k, f in made_files.MAKERS.items()}
    read = []
    monkeypatch.setattr(archive.Box, "__getitem__", lambda self, path, real=archive.Box.__getitem__: read.append(path) or real(self, path))
    monkeypatch.setattr(books, "inflate_palmdoc", None)
    for kind in ("epub", "fb2", "fbz", "mobi"):
        got = books.parse_metadata(made[kind], "zip" if kind in ("epub", "fbz") else kind)
        assert got[0] == kind and got[2] is None and (got[1]["title"], got[1]["authors"]) == ("The title", ["An author"]), kind
    assert not any("text/" in p for p in read)
    monkeypatch.undo()
    rows = [(f"/b/{k}.bin", bytearray(v)) for k, v in made.items()]
    frame = books.read_metadata(spark.createDataFrame(rows, "path string, content binary"))
    assert {r["book_id"]: r["title"] for r in frame.collect() if r["error"] is None} == {f"/b/{k}.bin": "The title" for k in made if k not in ("zip",)}
    assert "sections" not in frame.columns
    odd = b'<?xml version="1.0"?><FictionBook xmlns:l="u"><description><title-info><book-title l:x="1">A</book-title></title-info></description><body><section><p>never closed'
    assert books.fb2_metadata(odd)["title"] == "A"


def test_entry_past_its_size(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 50_000)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    at = data.rfind(b"PK\1\2") + 24
    data[at : at + 4] = (10).to_bytes(4, "little")
    with pytest.raises(archive.Refused):
        archive.entries(bytes(data))


def test_palm_markup():
    html = '<img alt="a" recindex="00002"><a filepos=0000123>x</a><p filepos-id="f">y</p><mbp:pagebreak/>z</b<i>'
    assert mobi6.markup(html, {2: "p.png"}) == '<img alt="a" src="p.png"><a href="#filepos123">x</a><p id="f">y</p><div class="mbp_pagebreak"></div>z</b><i>'
    links = '<a href="#filepos9">lone</a>' + "text " * 5 + '<p><a href="#filepos10">One</a></p><p><a href="#filepos20"><b>Two</b></a><br/>. <a href="#filepos30">Three</a></p>'
    assert mobi6.navigation(links) == [{"label": "One", "offset": 10}, {"label": "Two", "offset": 20}, {"label": "Three", "offset": 30}]
    raw = b"<html><p>front</p><h1 id=a>A</h1>text<h1>B</h1>more"
    a, b = raw.index(b"<h1 id"), raw.index(b"<h1>B")
    assert mobi6.sections(raw, [a, b + 2, 0, 999]) == [(0, a), (a, b + 4), (b + 4, len(raw))]
    assert mobi6.sections(b"<html><body><p>x", [12]) == [(0, 16)]
    assert mobi6.sections(b"a<mbp:pagebreak/>b<mbp:pagebreak/>c", []) == [(0, 1), (1, 18), (18, 35)] and mobi6.sections(b"abc", []) == [(0, 3)]


def test_palm_book_with_contents():
    parts = ["<html><body><p>Front</p>", "<h1>First</h1><p>aaa</p>", "<h1>Second</h1><p>bbb</p>"]
    contents = '<p><a filepos={0:010}>First</a></p><p><a filepos={1:010}>Second</a></p>'
    size = len(parts[0]) + len(contents.format(0, 0))
    raw = (parts[0] + contents.format(size, size + len(parts[1])) + parts[1] + parts[2] + "</body></html>").encode()
    made = made_files.mobi("T", "A", ["x"])
    name, _, records = books.palm_records(made)
    head = bytearray(records[0])
    head[4:8], head[8:10] = len(raw).to_bytes(4, "big"), (1).to_bytes(2, "big")
    book = books.parse_mobi(made_files.palm(name, b"BOOKMOBI", [bytes(head), made_files.packed_palmdoc(raw)]))
    assert [s["path"] for s in book["sections"]] == ["chapter00001.html", "chapter00002.html", "chapter00003.html"]
    assert book["sections"][1]["content"] == parts[1] and [n["label"] for n in book["nav"]] == ["First", "Second"]
    assert [n["target"].split("#")[0] for n in book["nav"]] == ["chapter00002.html", "chapter00003.html"]


def test_publications_and_limits(spark):
    good = {"metadata": {"title": {"en": "T"}, "author": ["A", {"name": "B"}], "modified": "2020-01-01T00:00:00Z"}, "links": [{"href": "h", "rel": ["self", "http://opds-spec.org/acquisition"]}]}
    assert opds2.publication(json.dumps(good))["authors"] == ["A", "B"]
    small = opds2.Limits(max_bytes=200, max_depth=3, max_values=9, max_string=5)
    for text, said in (("x" * 201, "bytes"), ("[[[[1]]]]", "deeper"), (json.dumps(list(range(10))), "values"), ('["abcdef"]', "string"), ('["\\u00e9\\u00e9\\u00e9\\"\\""]', None), ('{"a": [1, true]}', None)):
        assert (said in opds2.preflight(text, small)) if said else opds2.preflight(text, small) is None
    for change, pointer in (({"links": [{"rel": "x"}]}, "/links/0/href"), ({"links": [3]}, "/links/0"), ({"links": {}}, "/links"), ({"metadata": []}, "/metadata")):
        with pytest.raises(opds2.Invalid) as e:
            opds2.publication(json.dumps(good | change))
        assert e.value.pointer == pointer
    stamps = [("2020-02-29T23:59:59.5+01:00", True), ("2020-02-30T00:00:00Z", False), ("2020-01-01t00:00:00z", True), ("2020-01-01 00:00:00Z", False), ("2020-01-01T24:00:00Z", False), ("2020-01-01T00:00:00-23:59", True), ("x", False), (None, False)]
    got = spark.createDataFrame([(s,) for s, _ in stamps], "s string").select("s", F.unix_micros(opds2.rfc3339_time(F.col("s"))).alias("t")).collect()
    assert [r["t"] is not None for r in got] == [x for _, x in stamps]
    assert got[0]["t"] == 1_583_017_199_500_000 and got[5]["t"] == (1_577_836_800 + 86_340) * 1_000_000
    for s, ok in stamps:
        if not ok:
            with pytest.raises(opds2.Invalid):
                opds2.rfc3339(s, "")


def test_root_type_and_toc_reference(spark):
    def epub(kind, version, spine):
        root = f'<container><rootfiles><rootfile full-path="p.opf" media-type="{kind}"/></rootfiles></container>'
        opf = package("", version=version).decode().replace("<spine>", spine)
        return bytearray(made_files._zip({"mimetype": "application/epub+zip", "META-INF/container.xml": root, "p.opf": opf}))

    files = spark.createDataFrame([("a", epub("text/xml", "3.0", "<spine>")), ("b", epub(package_rules.PACKAGE_TYPE, "2.0", "<spine>")), ("c", epub(package_rules.PACKAGE_TYPE, "2.0", '<spine toc="n">'))], "path string, content binary")
    got = {(r["book_id"], r["rule"]) for r in epub_tables.diagnose(files).collect()}
    assert {x for x in got if "media-type" in x[1] or "toc-reference" in x[1]} == {("a", "container.rootfile.media-type-unsupported"), ("b", "navigation.toc-reference-missing")}


def test_nearest_neighbours():
    words = [{"x": 10.0 * k, "y": 0.0, "w": 8.0, "h": 8.0} for k in range(600)] + [{"x": 0.0, "y": 50.0, "w": 8.0, "h": 8.0}]
    angles = spatial.neighbour_angles(words, 2)
    assert len(angles) == 601 and sorted(abs(round(a, 6)) for a in angles[300]) == [0.0, 3.141593]
    assert spatial.neighbour_angles(words[:1]) == [[]]
