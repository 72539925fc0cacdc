"""KF8: indices, assembly, links and navigation."""

import struct

import pytest

from quire.plans import made_files
from quire.sources import archive, books, kf8


def test_numbers_and_indices():
    for value in (0, 1, 127, 128, 300_000, 0xFFFFFFF):
        assert kf8.number(made_files._number(value), 0) == (value, len(made_files._number(value)))
    with pytest.raises(archive.Refused):
        kf8.number(b"\1\2", 0)
    rows = [(b"a", [[7], [300, 1]]), (b"bc", [[0], [5, 70_000]])]
    entries, labels = kf8.read_index([b"x", *made_files.index_records([(1, 1), (6, 2)], rows, b"\x83abc\x82de\0")], 1)
    assert [(e.name, e.tags) for e in entries] == [(n, {1: v[0], 6: v[1]}) for n, v in rows] and labels == {0: b"abc", 4: b"de"}


def test_masks_of_several_bits():
    layout = [(1, 1, 0x03, 0), (2, 2, 0x0C, 0), (3, 1, 0x10, 0), (0, 0, 0, 1), (4, 1, 0x01, 0), (0, 0, 0, 1)]
    data = bytes([0b11011, 0b1]) + b"\x82" + b"\x85\x86" + b"\x81\x82\x83\x84" + b"\x87" + b"\x88"
    # All bits of a mask set: the size in bytes stands before the values; else the bits are the number of values.
    assert kf8._tags(data, 0, 2, layout) == {1: [5, 6], 2: [1, 2, 3, 4], 3: [7], 4: [8]}


def test_assembly_and_links():
    skeletons = [kf8.Entry(b"s0", {1: [2], 6: [0, 26]}), kf8.Entry(b"s1", {1: [0], 6: [36, 4]})]
    raw = b"<html><body></body></html>" + b"<p>1</p>"[:5] + b"22222" + b"last"
    fragments = [kf8.Entry(b"0000000012", {6: [0, 5]}), kf8.Entry(b"0000000017", {6: [0, 5]})]
    pages, places = kf8.parts_of(raw, skeletons, fragments)
    assert pages == [b"<html><body><p>1<22222</body></html>", b"last"]
    assert places == [(0, 12), (0, 17)]
    with pytest.raises(archive.Refused):
        kf8.parts_of(raw, skeletons, [kf8.Entry(b"0000009999", {6: [0, 5]}), fragments[1]])
    page = b"<p id='a'>x</p><p>y</p><h1 name=\"b\">z</h1>"
    assert [kf8.anchor_at(page, k) for k in (0, 3, 16, 24)] == ["a", "a", "a", "b"]


def test_whole_book():
    texts = ["first & one", 'see <a href="kindle:pos:fid:0000:off:0000000000">there</a>', "third"]
    made = made_files.azw3("A title", "An author", texts)
    kind, book, error = books.parse(made, "azw3")
    assert (kind, error, book["title"], book["authors"]) == ("azw3", None, "A title", ["An author"])
    assert [s["path"] for s in book["sections"]] == ["part0000.xhtml", "part0001.xhtml", "part0002.xhtml"]
    assert book["sections"][0]["content"] == '<html><body><p id="t0">first &amp; one</p></body></html>'
    assert "part0000.xhtml#t0" in book["sections"][1]["content"]
    assert book["nav"] == [{"label": f"Turn {k}", "target": f"part000{k}.xhtml#t{k}", "depth": 0} for k in range(3)]
    name, _, records = books.palm_records(made)
    broken = bytearray(records[0])
    broken[0xFC:0x100] = struct.pack(">I", 1)
    assert books.parse(made_files.palm(name, b"BOOKMOBI", [bytes(broken), *records[1:]]), "azw3")[2] == "no index record"
