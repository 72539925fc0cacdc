"""Detection and parsers on inputs built here."""

import hashlib
import io
import sqlite3
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quire.sinks.epub_metadata import updated_epub, with_title
from quire.sources import archive, books, detect, epub_tables, images, ocr, palm as palm_codec
from quire.sources.pdf import Document, decoded


def zipped(**files) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("·", "."), data)
    return out.getvalue()


OPF = """<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A Book</dc:title><dc:creator>Ann Lee</dc:creator>
<dc:creator role="edt">Ed</dc:creator><dc:language>en</dc:language><dc:identifier id="isbn">978</dc:identifier><meta name="x:series" content="S"/><meta name="x:series_index" content="2,5"/></metadata>
<manifest><item id="c1" href="one.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="sub/Two.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest>
<spine><itemref idref="c1"/><itemref idref="c2"/><itemref idref="gone"/><itemref idref="c1"/></spine></package>"""
NAV = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="one.xhtml#a">One</a><ol><li><a href="sub/two.xhtml">Two</a></li></ol></li></ol></nav></body></html>'


def epub(**more) -> bytes:
    container = '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'
    files = {"mimetype": "application/epub+zip", "META-INF__container·xml": container, "OPS__book·opf": OPF, "OPS__one·xhtml": "<html><body>1</body></html>", "OPS__sub__two·xhtml": "<p>2</p>", "OPS__nav·xhtml": NAV}
    return zipped(**(files | more))


def test_epub():
    book = books.parse_epub(epub())
    assert (book["title"], book["authors"], book["languages"], book["series"], book["series_index"]) == ("A Book", ["Ann Lee"], ["en"], "S", 2.5)
    assert [s["path"] for s in book["sections"]] == ["OPS/one.xhtml", "OPS/sub/two.xhtml", "OPS/one.xhtml"]
    assert [(n["label"], n["target"], n["depth"]) for n in book["nav"]] == [("One", "OPS/one.xhtml#a", 0), ("Two", "OPS/sub/two.xhtml", 1)]
    with pytest.raises(archive.Refused):
        books.parse_epub(epub(**{"META-INF__encryption·xml": '<e><EncryptionMethod Algorithm="http://www.w3.org/2001/04/xmlenc#aes128-cbc"/></e>'}))
    key = hashlib.sha1(b"urn:x").digest()
    assert books.deobfuscated(bytes(a ^ b for a, b in zip(b"fontdata", key)), "urn: x") == b"fontdata"


def test_epub_writer(spark):
    changed = books.parse_epub(updated_epub(epub(), "New & Old", ["B"]))
    assert (changed["title"], changed["authors"], len(changed["sections"])) == ("New & Old", ["B"], 3)
    df = spark.createDataFrame([(0, bytearray(epub())), (1, bytearray(b"no"))], "k int, content binary")
    got = [r["c"] for r in df.select("k", with_title(F.col("content"), F.lit("T")).alias("c")).orderBy("k").collect()]
    assert books.parse_epub(bytes(got[0]))["title"] == "T" and got[1] is None


def test_word_processors():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>a &lt; b</w:t></w:r></w:p></w:body></w:document>'
    book = books.parse_docx(zipped(word__document·xml=doc, docProps__core·xml="<c><title>T</title><creator>A;B</creator></c>"))
    assert (book["title"], book["authors"], book["nav"][0]["label"]) == ("T", ["A", "B"], "Top") and "<strong>a &lt; b</strong>" in book["sections"][0]["content"]
    t = 'xmlns:text="urn:t"'
    book = books.parse_odt(zipped(content·xml=f'<d {t}><text:h text:outline-level="2">H</text:h><text:p>x<text:s text:c="2"/>y<text:line-break/>z</text:p></d>', meta·xml="<m><title>T</title></m>"))
    assert book["title"] == "T" and "<p>x  y<br/>z</p>" in book["sections"][0]["content"] and book["nav"][0]["depth"] == 1
    book = books.parse_rtf(rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\info{\title My T}{\author A;B}}Caf\'e9 \u28450?\par {\b Second} line\par}")
    assert (book["title"], book["authors"]) == ("My T", ["A", "B"]) and book["sections"][0]["content"] == "<html><body><p>Café 漢</p><p>Second line</p></body></html>"


def test_plain_formats():
    txt = books.parse_txt("T\n\n\nA, B\n\nbody <x>\nmore".encode("utf-16"))
    assert (txt["title"], txt["authors"]) == ("T", ["A", "B"]) and "<p>body &lt;x&gt; more</p>" in txt["sections"][0]["content"]
    md = books.parse_markdown(b"---\ntitle: M\nauthors:\n  - A\ntags: x, y\n---\n# H\n\ntext *e* **s** `c`\n\n## H\n- i\n- j\n\n```\n<c>\n```\n")
    assert (md["title"], md["authors"], md["subjects"]) == ("M", ["A"], ["x", "y"])
    assert [n["target"] for n in md["nav"]] == ["index.xhtml#h", "index.xhtml#h-2"]
    assert "<p>text <em>e</em> <strong>s</strong> <code>c</code></p>" in md["sections"][0]["content"] and "&lt;c&gt;" in md["sections"][0]["content"]
    page = books.parse_html(b"<html lang=pt><head><title> A\n B </title><meta name=author content='x'><meta name='author' content='Z; Y and W'></head><h2 id=q>S</h2><h3>T</h3></html>")
    assert (page["title"], page["authors"], page["languages"]) == ("A B", ["Z", "Y", "W"], ["pt"]) and [(n["target"], n["depth"]) for n in page["nav"]] == [("index.html#q", 0), ("index.html", 1)]
    fb2 = b"<FictionBook><description><title-info><genre>g</genre><author><first-name>A</first-name><last-name>B</last-name></author><book-title>F</book-title><lang>ru</lang></title-info></description><body><section><title><p>One</p></title><p>x <emphasis>y</emphasis></p></section></body></FictionBook>"
    book = books.parse_fb2(fb2)
    assert (book["title"], book["authors"], book["nav"][0]["label"]) == ("F", ["A B"], "One") and "<h1>One</h1><p>x <em>y</em></p>" in book["sections"][0]["content"]
    assert books.parse_fbz(zipped(a·fb2=fb2))["title"] == "F"
    assert books.parse_htmlz(zipped(index·html="<title>x</title>", metadata·opf=OPF))["title"] == "A Book"
    assert books.parse_txtz(zipped(a·txt="hello"))["sections"][0]["content"] == "<html><body><p>hello</p></body></html>"


def test_comics():
    info = "<ComicInfo><Title>C</Title><Writer>A, B; A</Writer><Number>3</Number></ComicInfo>"
    cbz = zipped(p10·jpg="", p2·jpg="", p1·png="", ComicInfo·xml=info, readme·txt="")
    book = books.parse_cbz(cbz)
    assert [s["path"] for s in book["sections"]] == ["p1.png", "p2.jpg", "p10.jpg"] and (book["title"], book["authors"], book["series_index"]) == ("C", ["A", "B"], 3)
    cbc = books.parse_cbc(zipped(comics·txt="b.cbz:Second\na.cbz:First\n", a·cbz=cbz, b·cbz=zipped(x·jpg="")))
    assert [s["path"] for s in cbc["sections"]] == ["b.cbz/x.jpg", "a.cbz/p1.png", "a.cbz/p2.jpg", "a.cbz/p10.jpg"] and [n["label"] for n in cbc["nav"]] == ["Second", "First"]


def palm(kind: bytes, records: list[bytes], name=b"Name") -> bytes:
    head = name.ljust(32, b"\0") + bytes(28) + kind + bytes(8) + struct.pack(">H", len(records))
    at, table = 78 + 8 * len(records) + 2, b""
    for r in records:
        table += struct.pack(">II", at, 0)
        at += len(r)
    return head + table + bytes(2) + b"".join(records)


def test_palm_books():
    packed = b"abcab" + bytes((0x80 | 3 << 3 >> 8, 3 << 3 & 255 | 0)) + bytes((0x80 ^ ord("T") | 0x80,)) + bytes((2, 0xE9, 0x01))
    assert books.inflate_palmdoc(b"abc\x80\x18") == b"abcabc"
    assert books.inflate_palmdoc(bytes((0xC0 | ord("t") & 0x3F | 0x40 & ord("t"),)))[:1] == b" "
    assert books.inflate_palmdoc(b"\x02\xe9\x01x") == b"\xe9\x01x" and packed
    doc = palm(b"TEXTREAD", [struct.pack(">HHIHHI", 1, 0, 5, 1, 4096, 0), b"hello"])
    book = books.parse_palmdoc(doc)
    assert book["title"] == "Name" and "<p>hello</p>" in book["sections"][0]["content"]
    exth = b"".join(struct.pack(">II", k, 8 + len(v)) + v for k, v in ((100, b"Ann"), (503, b"Title"), (524, b"en")))
    exth = b"EXTH" + struct.pack(">II", 12 + len(exth), 3) + exth
    head = bytearray(0xF8)
    struct.pack_into(">HHIHHI", head, 0, 1, 0, 12, 1, 4096, 0)
    head[16:20] = b"MOBI"
    struct.pack_into(">II", head, 20, 232, 2)
    struct.pack_into(">I", head, 28, 65001)
    mobi = palm(b"BOOKMOBI", [bytes(head) + exth, b"<h1>A</h1>xy"])
    book = books.parse_mobi(mobi)
    assert (book["title"], book["authors"], book["languages"]) == ("Title", ["Ann"], ["en"]) and book["sections"][0]["content"] == "<h1>A</h1>xy"
    with pytest.raises(archive.Refused):
        books.parse_palmdoc(doc[:60])


def pdf(text: bytes = b"BT /F1 12 Tf 72 700 Td (Hello \\(x\\)) Tj 0 -14 Td [(Wo) -20 (rld) -400 (end)] TJ ET") -> bytes:
    packed = zlib.compress(text)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 6 0 R] /Count 2 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream", b"<< /Type /Font >>", b"<< /Type /Page /Parent 2 0 R >>", b"<< /Title (A #T) /Author <FEFF00C1> >>"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k + 1, o) for k, o in enumerate(objects)) + b"trailer << /Root 1 0 R /Info 7 0 R >>\n%%EOF"


def test_pdf():
    kind, book, error = books.parse(pdf(), "pdf")
    assert (kind, error, book["title"], book["authors"]) == ("pdf", None, "A #T", ["Á"])
    assert [s["content"] for s in book["sections"]] == ["<html><body><p>Hello (x)</p><p>World end</p></body></html>", "<html><body></body></html>"]
    assert books.parse(pdf().replace(b"/Root", b"/Encrypt 9 0 R /Root"), "pdf")[2] == "the document is encrypted"
    assert decoded(b"68656C6C6F>", "ASCIIHexDecode", None) == b"hello" and decoded(b"\x02abc\xfed\x80", "RunLengthDecode", None) == b"abcddd"
    assert decoded(b"\x80\x0b\x60\x50\x22\x0c\x0c\x85\x01", "LZWDecode", None) == b"-----A---B"
    assert Document(pdf()).pages()[0]["Type"] == "Page"


def test_opds_and_sqlite(tmp_path):
    atom = b'<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>E</title><link href="x"/></entry></feed>'
    assert books.parse_opds(atom)["nav"] == [{"label": "E", "target": "x", "depth": 0}]
    feed = b'{"metadata": {"title": {"en": "F2"}}, "publications": [{"metadata": {"title": "P"}, "links": [{"href": "p"}]}], "navigation": [{"title": "N", "href": "n"}]}'
    assert books.parse_opds(feed)["title"] == "F2" and [n["label"] for n in books.parse_opds(feed)["nav"]] == ["N", "P"]
    db = sqlite3.connect(tmp_path / "m.db")
    db.executescript("CREATE TABLE books(id INTEGER, title TEXT); INSERT INTO books VALUES (1, 'a'), (2, NULL);")
    db.close()
    assert [(r["id"], r["title"]) for r in books.sqlite_rows((tmp_path / "m.db").read_bytes(), "books")] == [(1, "a"), (2, None)]
    with pytest.raises(archive.Refused):
        books.sqlite_rows(b"not a database" * 99, "books")


def test_zip_limits(monkeypatch):
    monkeypatch.setattr(archive, "RATIO_FROM", 1000)
    with pytest.raises(archive.Refused):
        archive.entries(zipped(big="0" * 1_000_000))
    with pytest.raises(archive.Refused):
        archive.entries(b"PK\x03\x04 broken")


FILES = {
    "b.epub": (epub(), "epub"), "p.pdf": (pdf(), "pdf"), "t.txt": (b"just text\n", "txt"), "t.md": (b"# Head\n", "markdown"), "h.html": (b"<!DOCTYPE html><title>x</title>", "html"), "r.rtf": (rb"{\rtf1 x}", "rtf"),
    "f.fb2": (b"<?xml version='1.0'?><FictionBook><body><p>x</p></body></FictionBook>", "fb2"), "c.cbz": (zipped(a·jpg=""), "cbz"), "d.djvu": (b"AT&TFORM1234", "djvu"), "x.chm": (b"ITSFxxxx", "chm"),
    "o.bin": (bytes(range(256)) * 4, "unknown"), "m.mobi": (palm(b"BOOKMOBI", [b"x" * 200]), "mobi"), "i.tif": (b"II*\x00\x08\0\0\0\0\0", "tiff"),
}


def test_reading_files(spark, tmp_path):
    for name, (data, _) in FILES.items():
        (tmp_path / name).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r["book_id"].rsplit("/", 1)[-1]: r for r in books.read_books(files).collect()}
    assert {k: got[k]["format"] for k in FILES} == {k: kind for k, (_, kind) in FILES.items()}
    assert got["b.epub"]["title"] == "A Book" and got["b.epub"]["error"] is None and got["p.pdf"]["title"] == "A #T"
    assert got["d.djvu"]["error"] == "unsupported: djvu" and got["m.mobi"]["error"] == "no MOBI head"
    sections = books.sections_of(books.read_books(files)).where(F.col("book_id").endswith("b.epub")).orderBy("section_index").collect()
    assert [s["path"] for s in sections] == ["OPS/one.xhtml", "OPS/sub/two.xhtml", "OPS/one.xhtml"]


def test_sidecars(spark):
    b = spark.createDataFrame([("d/a.txt", "own", ["x"]), ("d/Great Book - Ann Lee.txt", "", []), ("e/c.txt", "", [])], "book_id string, title string, authors array<string>")
    s = spark.createDataFrame([("d/a.opf", "", ["S"]), ("e/metadata.opf", "From folder", [])], "path string, title string, authors array<string>")
    got = {r["book_id"]: (r["title"], r["authors"]) for r in books.with_sidecars(b, s).collect()}
    assert got == {"d/a.txt": ("own", ["S"]), "d/Great Book - Ann Lee.txt": ("Great Book", ["Ann Lee"]), "e/c.txt": ("From folder", [])}


def test_refinements(spark):
    df = spark.createDataFrame([(0, ["META-INF/container.xml", "a.fb2"]), (1, ["x/a.PNG"]), (2, ["q"])], "k int, p array<string>")
    assert [r["z"] for r in df.select("k", detect.refine_zip(F.col("p")).alias("z")).orderBy("k").collect()] == ["epub", "cbz", "zip"]
    azw = palm(b"BOOKMOBI", [bytes(0x68) + struct.pack(">I", 8) + bytes(40)])
    assert spark.createDataFrame([(bytearray(azw),)], "c binary").select(detect.refine_mobi(F.col("c"))).first()[0] == "azw3"


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 30, 20) + bytes(9)
    jpeg = b"\xff\xd8\xff\xe0\0\x04xx\xff\xc0\0\x0b\x08" + struct.pack(">HH", 7, 9) + bytes(9)
    vp8x = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    rows = [png, jpeg, b"GIF89a" + struct.pack("<HH", 5, 6) + bytes(9), b"BM" + bytes(16) + struct.pack("<ii", 11, -12) + bytes(9), vp8x, b"none of these"]
    df = spark.createDataFrame([(k, bytearray(r)) for k, r in enumerate(rows)], "k int, c binary")
    got = df.select("k", images.image_type(F.col("c")).alias("t"), images.image_size(F.col("c")).alias("s")).orderBy("k").collect()
    assert [(r["t"], r["s"] and tuple(r["s"])) for r in got] == [("png", (30, 20)), ("jpeg", (9, 7)), ("gif", (5, 6)), ("bmp", (11, 12)), ("webp", (100, 50)), (None, None)]
    tiff = b"II*\0\x08\0\0\0\x02\0" + struct.pack("<HHIHH", 256, 3, 1, 640, 0) + struct.pack("<HHII", 306, 2, 20, 38) + bytes(4) + b"2020:01:02 03:04:05\0"
    tags = images.tiff_tags(tiff)
    assert tags["width"] == 640 and tags["created"].year == 2020


def test_ocr():
    alto = b'<alto xmlns="http://www.loc.gov/standards/alto/ns-v3#"><Description><MeasurementUnit>mm10</MeasurementUnit></Description><Layout><Page WIDTH="10" HEIGHT="20"><PrintSpace><TextBlock ID="b" HPOS="1" VPOS="2" WIDTH="3" HEIGHT="4"><TextLine HPOS="1" VPOS="2" WIDTH="3" HEIGHT="4"><String CONTENT="a" HPOS="1" VPOS="2" WIDTH="1" HEIGHT="1" WC="0.5"/><SP/><String CONTENT="b" HPOS="2" VPOS="2" WIDTH="1" HEIGHT="1"/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>'
    zones, about = ocr.parse_alto(alto)
    assert [(z[2], z[4], z[9]) for z in zones] == [("region", "", None), ("line", "a b", None), ("word", "a", 0.5), ("word", "b", None)] and about == {"unit": "mm10", "pages": [(10.0, 20.0)]}
    page = b'<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page imageWidth="9" imageHeight="9"><ReadingOrder><OrderedGroup><RegionRefIndexed index="1" regionRef="r1"/><RegionRefIndexed index="0" regionRef="r2"/></OrderedGroup></ReadingOrder><TextRegion id="r1"><Coords points="0,0 2,0 2,3"/></TextRegion><TextRegion id="r2"><Coords points="1,1 4,5"/><TextEquiv conf="0.9"><Unicode>x</Unicode></TextEquiv></TextRegion></Page></PcGts>'
    zones, _ = ocr.parse_page(page)
    assert [(z[3], z[4], z[5:9]) for z in zones] == [("r2", "x", [1, 1, 3, 4]), ("r1", "", [0, 0, 2, 3])]
    hocr = b"<div class='ocr_page' title='image \"a;b\"; bbox 0 0 10 20'><span class='ocr_line' title='bbox 1 1 5 5'><span class='ocrx_word' title='bbox 1 1 2 2; x_wconf 90'>a&amp;b</span> <span class='ocrx_word' title='x_wconf unknown'>c</span></span></div>"
    zones, _ = ocr.parse_hocr(hocr)
    assert [(z[2], z[4], z[9]) for z in zones] == [("line", "a&b c", None), ("word", "a&b", 0.9), ("word", "c", None)]
    assert ocr.parse_title("image \"a;b\"; bbox 1 2 3 4; bbox 9") == {"image": ["a;b"], "bbox": ["1", "2", "3", "4"]}
    tsv = b"level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n1\t1\t0\t0\t0\t0\t0\t0\t10\t20\t-1\t\n5\t1\t1\t1\t1\t1\t1\t2\t3\t4\t96.5\tword\n"
    assert [(z[2], z[4], z[9]) for z in ocr.parse_tsv(tsv)[0]] == [("word", "word", 0.965)]
    assert ocr.bind_words(["a", "b", "a", "z"], "a b a") == [(0, 1, True), (2, 3, False), (4, 5, True), None]


def test_ocr_tables(spark):
    hocr = b"<div class='ocr_page' title='bbox 0 0 10 20'><span class='ocrx_word' title='bbox 1 1 2 2'>one</span><span class='ocrx_word' title='bbox 1 1 2 2'>two</span></div>"
    df = spark.createDataFrame([("g", bytearray(hocr)), ("bad", bytearray(b"<html></html>"))], "path string, content binary")
    zones = ocr.read_zones(df)
    assert zones.where("error IS NOT NULL").count() == 1
    words = ocr.with_offsets(zones)
    assert [(r["text_start"], r["text_end"]) for r in words.orderBy("zone_seq").collect()] == [(0, 3), (4, 7)]
    texts = spark.createDataFrame([("g", 0, "xx two one two")], "book_id string, page int, page_text string")
    bound = ocr.bind(words.select("book_id", "page", "zone_seq", "text"), texts, ["book_id", "page"]).orderBy("zone_seq").collect()
    assert [(r["start"], r["end"], r["ambiguous"]) for r in bound] == [(7, 10, False), (11, 14, True)]


def test_decoding():
    assert books.decode_text("é".encode("utf-8")) == "é" and books.decode_text("é".encode("cp1252")) == "é"
    assert books.decode_text(b'<?xml version="1.0" encoding="windows-1251"?>' + "ж".encode("cp1251")).endswith("ж")
    assert books.decode_text("plain ascii".encode("utf-16-le")) == "plain ascii"


def test_epub_diagnostics(spark):
    bad = OPF.replace('id="c2" href="sub/Two.xhtml"', 'id="c1" href="none.xhtml"').replace('version="3.0"', 'version="9"')
    df = spark.createDataFrame([("good", bytearray(epub(**{"OPS__one·xhtml": '<p id="a">1</p>', "OPS__sub__Two·xhtml": "<p/>"}))), ("bad", bytearray(epub(**{"OPS__book·opf": bad}))), ("junk", bytearray(b"PK nothing"))], "path string, content binary")
    found = {}
    for r in epub_tables.diagnose(df).collect():
        found.setdefault(r["book_id"], set()).add(r["rule"])
    assert found["good"] == {"spine.reference-invalid", "spine.reference-duplicate"}
    assert {"package.version-unsupported", "manifest.id-duplicate", "manifest.resource-missing", "navigation.fragment-unresolved"} <= found["bad"]
    assert {"container.missing", "container.rootfile.missing", "spine.empty"} <= found["junk"]


def test_overlays_and_viewports(spark):
    smil = b'<smil><body><seq><par><text src="../t/a.xhtml#p1"/><audio src="x.mp3" clipBegin="0:00:01" clipEnd="2s"/></par><par><text src="b.xhtml"/></par></seq></body></smil>'
    assert epub_tables.parse_overlay(smil, "OPS/smil/s.smil") == [{"text": "OPS/t/a.xhtml#p1", "audio": "OPS/smil/x.mp3", "begin": "0:00:01", "end": "2s"}, {"text": "OPS/smil/b.xhtml", "audio": None, "begin": None, "end": None}]
    pages = ['<meta name="viewport" content="width=600, height=800">', '<svg width="30px" height="40">', '<svg viewBox="0 0 50.5 60">', "<p>", '<meta name="viewport" content="width=0, height=9">']
    df = spark.createDataFrame(list(enumerate(pages)), "k int, h string")
    got = [r["v"] and tuple(r["v"]) for r in df.select("k", epub_tables.viewport_of(F.col("h")).alias("v")).orderBy("k").collect()]
    assert got == [(600, 800), (30, 40), (50, 60), None, None]


def test_dictionary_packing():
    """Two-bit codes, complete: phrases 0 to 3 for codes 11, 10, 01, 00."""
    short = b"".join(struct.pack(">I", 3 << 8 | 128 | 2) for _ in range(256))
    huff = b"HUFF" + struct.pack(">III", 24, 24, 24 + 1024) + bytes(8) + short + bytes(256)
    parts = [(b"ab", 1), (b"c", 1), (b"\xf0", 0), (b" ", 1)]
    table, body = b"", b""
    for data, plain in parts:
        table += struct.pack(">H", 2 * len(parts) + len(body))
        body += struct.pack(">H", len(data) | plain << 15) + data
    cdic = b"CDIC" + struct.pack(">III", 16, len(parts), 2) + table + body
    d = palm_codec.Dictionary(huff, [cdic])
    assert d.unpack(bytes((0b11100001,))) == b"abc " + b"abab  "
    assert d.unpack(b"\xff") == b"abababab"


def test_ereader():
    body, titles = palm_codec.render_pml('\\xOne \\a233\\x\nplain \\i it\\i \\U6f22 <&\\\\ \\Q="x"')
    assert titles == ["One é"] and body == "<p><h1>One é</h1></p><p>plain <i> it</i> 漢 &lt;&amp;\\ </p>"
    head = bytearray(132)
    struct.pack_into(">H", head, 0, 10)
    struct.pack_into(">H", head, 12, 2)
    book = books.parse(palm(b"PNRDPPRS", [bytes(head), zlib.compress(b"hello")]), "pdb")[1]
    assert book["sections"][0]["content"] == "<html><body><p>hello</p></body></html>"


def test_catalogue_database(spark, tmp_path):
    from quire.sources import catalogue_db

    db = sqlite3.connect(tmp_path / "m.db")
    db.executescript("""
      CREATE TABLE books(id INTEGER, title TEXT, sort TEXT, timestamp TEXT, series_index REAL, author_sort TEXT, isbn TEXT, path TEXT);
      CREATE TABLE authors(id INTEGER, name TEXT); CREATE TABLE series(id INTEGER, name TEXT); CREATE TABLE tags(id INTEGER, name TEXT);
      CREATE TABLE books_authors_link(id INTEGER, book INTEGER, author INTEGER); CREATE TABLE books_series_link(id INTEGER, book INTEGER, series INTEGER); CREATE TABLE books_tags_link(id INTEGER, book INTEGER, tag INTEGER);
      CREATE TABLE identifiers(id INTEGER, book INTEGER, type TEXT, val TEXT); CREATE TABLE data(id INTEGER, book INTEGER, format TEXT);
      INSERT INTO books VALUES (1, 'One', 'One', '2020-01-02 03:04:05+00:00', 2.0, 'B', '978', 'p'), (2, NULL, NULL, 'bad', NULL, NULL, '', NULL);
      INSERT INTO authors VALUES (5, 'Z'), (6, 'A'); INSERT INTO series VALUES (1, 'S1'), (2, 'S2');
      INSERT INTO books_authors_link VALUES (1, 1, 5), (2, 1, 6); INSERT INTO books_series_link VALUES (1, 1, 1), (2, 1, 2);
      INSERT INTO identifiers VALUES (1, 1, 'doi', 'x'), (2, 1, 'doi', 'y'); INSERT INTO data VALUES (1, 1, 'EPUB'), (2, 1, 'PDF');""")
    db.close()
    data = bytearray((tmp_path / "m.db").read_bytes())
    df = spark.createDataFrame([("a", data), ("b", data), ("bad", bytearray(b"x" * 200))], "path string, content binary")
    got = {(r["library"], r["book_id"]): r for r in catalogue_db.read_catalogue(df).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}
    one, two = got["b", 1], got["a", 2]
    assert (one["title"], one["authors"], one["series"], one["formats"], one["identifiers"]) == ("One", ["Z", "A"], "S2", ["EPUB", "PDF"], {"doi": "y", "isbn": "978"})
    assert one["added_at"].year == 2020 and (two["title"], two["authors"], two["series"], two["identifiers"], two["added_at"]) == ("", [], None, None, None)
