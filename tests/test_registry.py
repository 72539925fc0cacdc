"""Functions under their SQL names."""

import io
import json
import sqlite3
import zipfile

from quire.functions import registry


def test_scalars(spark):
    registry.register(spark)
    row = spark.sql("SELECT plain_text('<p>a&amp;b</p>') a, document_text('<body>x <b>y</b></body>') b, index_terms('Olá, Straße') c, find_spans('the theme the', 'the', 'whole_words') d, cfi_normalized('epubcfi(/6/4!/4)') e, cfi_normalized('x') f, html_meta('<title>T</title>')['title'] g, decode_text(X'C3A9') h").first()
    assert (row["a"], row["b"], row["c"], [tuple(x) for x in row["d"]], row["e"], row["f"], row["g"], row["h"]) == ("a&b", "x y", ["ola", "strasse"], [(0, 3), (10, 13)], "epubcfi(/6/4!/4)", None, "T", "é")


def test_table_functions(spark, tmp_path):
    registry.register(spark)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    db = sqlite3.connect(tmp_path / "m.db")
    db.executescript("CREATE TABLE books(id INTEGER, title TEXT); INSERT INTO books VALUES (1, 'é'), (2, NULL);")
    db.close()
    rows = [(1, bytearray(out.getvalue())), (2, bytearray(b"junk")), (3, bytearray((tmp_path / "m.db").read_bytes()))]
    spark.createDataFrame(rows, "k int, content binary").createOrReplaceTempView("blobs")
    assert [tuple(r) for r in spark.sql("SELECT k, path, size FROM blobs, LATERAL zip_entries(content)").collect()] == [(1, "a.txt", 5)]
    got = spark.sql("SELECT number, row FROM blobs, LATERAL sqlite_table(content, 'books') WHERE k = 3 ORDER BY number").collect()
    assert [(r["number"], json.loads(r["row"])) for r in got] == [(1, {"id": 1, "title": "é"}), (2, {"id": 2, "title": None})]
    assert [r[0] for r in spark.sql("SELECT * FROM occurrences('aaa', 'aa')").collect()] == [0, 1]
