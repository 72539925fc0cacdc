"""Operators on small tables, and the query catalogue against its SQL."""

import hashlib
import os
import random
import shutil
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import anchors, annotations, catalogue, index, package_rules, reading, search, spatial, tables
from quire.plans import queries
from quire.sinks import index_store
from quire.streaming import incremental

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spans(spark, text, query, mode="contains", **more):
    df = spark.createDataFrame([(0, text)], "s int, text string")
    return [(r["start"], r["end"]) for r in search.scan(df, query, ["s"], mode, **more).collect()]


def test_scan_modes(spark):
    assert spans(spark, "art artist part art", "art", "whole_words") == [(0, 3), (16, 19)]
    assert spans(spark, "win­ter", "winter") == [(0, 7)]
    assert spans(spark, "win­ter", "winte", "whole_words") == []
    assert spans(spark, "A “bright”  lamp", '"bright" lamp') == [(2, 16)]
    assert spans(spark, "ab AB", "ab", case=True) == [(0, 2)]
    assert spans(spark, "x1\ny22", "^y\\d+$", "regex") == [(3, 6)]
    assert spans(spark, "sea or a hill; sea", "sea hill 20", "proximity") == [(0, 18)]
    assert spans(spark, "sea or a hill; sea", "sea hill 2", "proximity") == [(9, 18)]
    assert spans(spark, "sea or a hill; sea", "sea hill 1", "proximity") == []
    assert spans(spark, "ÇÖL", "çöl") == [(0, 3)]
    assert spans(spark, "anything", "   ") == []
    with pytest.raises(ValueError):
        spans(spark, "x", "one", "proximity")


def test_scan_limit_and_snippet(spark):
    df = spark.createDataFrame([(0, "abc abc abc"), (1, "abc abc abc")], "s int, text string")
    got = search.scan(df, "abc", ["s"], max_matches=2, context=1).collect()
    assert [(r["s"], r["start"], r["is_truncated"]) for r in got] == [(0, 0, True), (0, 4, True)]
    assert [r["snippet"] for r in got] == ["abc …", "… abc …"]
    assert not search.scan(df, "abc", ["s"], max_matches=6).first()["is_truncated"]


def build(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "s int, text string")
    return (df, *index.build(df, ["s"]))


def test_index_queries(spark):
    _, p, st = build(spark, "grey heron", "grey", "heron run", None)
    assert [r["s"] for r in index.ranked(p, st, ["s"], "grey heron").collect()] == [0]
    assert index.ranked(p, st, ["s"], "  ").count() == 0 and index.ranked(p, st, ["s"], "zebra").count() == 0
    _, p, st = build(spark, "navio navegacao navegaca zebra")
    assert sorted(r["end"] - r["start"] for r in index.search(p, st, ["s"], "navegacao", "fuzzy").collect()) == [8, 9]
    assert index.search(p, st, ["s"], "nav", "prefix").count() == 3
    with pytest.raises(ValueError):
        index.search(p, st, ["s"], "nav", "prefix", index.Limits(max_expansions=2))
    _, p, st = build(spark, "repeat repeat", "repeat and more words repeat")
    assert [(r["s"], r["start"]) for r in index.search(p, st, ["s"], "repeat").collect()][:2] == [(0, 0), (0, 7)]


def test_written_index(spark, tmp_path):
    """Texts are read once; the vocabulary and the postings by term agree with what building in place gives."""
    texts = ["Grey heron, grey\u00adheron ﬁ Ærø", None, "", "straße STRASSE \U0001F600x", "x" * 70 + " short", "\u0301 \u0301a\u0301 Ｆｕｌｌ ｶﾅ"] * 3
    df, p, st = build(spark, *texts)
    index_store.write(f"{tmp_path}/w", df, ["s"])
    postings, stats, terms = index_store.read(spark, f"{tmp_path}/w")
    flat = lambda f: sorted((r["s"], r["term"], tuple(r["starts"]), tuple(r["ends"])) for r in f.collect())
    want = {}
    for s, t in enumerate(texts):
        for term, a, b in index.tokenize_text(t or ""):
            if len(term) <= 64:
                want.setdefault((s, term), []).append((a, b))
    assert flat(postings) == flat(p) == sorted((s, term, tuple(a for a, _ in x), tuple(b for _, b in x)) for (s, term), x in want.items())
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, st.collect())) == [(s, len(index.tokenize_text(t or ""))) for s, t in enumerate(texts)]
    assert {r["term"]: (r["df"], r["tf"]) for r in terms.collect()}["grey"] == (3, 3)
    assert index.ranked(postings, stats, ["s"], "heron", terms=terms).count() == 3
    got = index.coverage(df, terms, stats.where("s <> 0")).first()
    assert (got["eligible"], got["failed"], got["pending"], got["indexed"], got["is_complete"]) == (18, 3, 1, 14, False)


def test_results_as_json(spark):
    df, p, st = build(spark, "grey heron heron", "heron", None)
    cover = index.coverage(df, index.vocabulary(p), st.where("s < 2"))
    hits = index.search(p, st, ["s"], "heron")
    sent = index_store.results_json(hits, cover)
    got = index_store.results_of(sent, "s: int, start: int, end: int, score: double").first()
    assert [tuple(h) for h in got["hits"]] == [tuple(h) for h in hits.collect()] and len(got["hits"]) == 3
    assert (got["coverage"]["failed"], got["coverage"]["is_complete"]) == (1, False)
    wrong = sent.select(F.regexp_replace("json", '"indexed":2', '"indexed":3').alias("json")).union(sent.select(F.regexp_replace("json", '"v":2', '"v":1'))).union(sent.select(F.lit("no json")))
    assert all(r["hits"] is None and r["coverage"] is None for r in index_store.results_of(wrong, "s: int").collect())


def test_anchor_policies_and_limits(spark):
    text, other = "one two three four five six seven eight nine ten", "red green blue black white brown grey pink gold lilac"
    sections = spark.createDataFrame([(0, text + " more", "pub"), (1, other, None)], "section int, text string, publication string")
    made = anchors.capture(spark.createDataFrame([(0, text, "pub"), (1, other, None)], sections.schema), spark.createDataFrame([("moved", 0, 0, 40), ("same", 1, 6, 40)], "anchor_id string, section int, start int, end int"))
    away = made.where("anchor_id = 'moved'").withColumns({"anchor_id": F.lit("away"), "publication": F.lit("elsewhere")})
    long = made.where("anchor_id = 'moved'").withColumns({"anchor_id": F.lit("long"), "quote": F.repeat(F.lit("x"), 5000), "publication": F.lit("pub")})
    all_ = made.withColumn("publication", F.when(F.col("section") == 0, "pub")).unionByName(away).unionByName(long)
    outcomes = lambda **more: {r["anchor_id"]: r["outcome"] for r in anchors.resolve(all_, sections, **more).collect()}
    assert outcomes(policy="verified") == {"same": "resolved", "moved": "incompatible", "away": "incompatible", "long": "unsupported"}
    assert outcomes(policy="migration", fuzzy=False) == {"same": "resolved", "moved": "resolved", "away": "incompatible", "long": "unsupported"}
    assert outcomes(fuzzy=False) == {"same": "resolved", "moved": "resolved", "away": "resolved", "long": "unsupported"}
    with pytest.raises(ValueError):
        anchors.resolve(all_, sections, policy="none")
    with pytest.raises(ValueError):
        anchors.Limits(max_quote=0)


def test_tokens_in_arrays_equal_the_scalar_tokenizer(spark):
    import random

    import pyarrow as pa

    r = random.Random(2)
    pool = [chr(c) for c in range(0x20, 0x250)] + [chr(c) for c in range(0x370, 0x530)] + list("\u0301\u0308\u00ad\u200b\u2060 漢字ｱＡ１１ ﬀ😀𐍈\0\n_") + [" "] * 200
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(300)] + ["", None]
    got = index._tokens(pa.array(texts, pa.string())).to_pylist()
    assert [[(t["term"], t["start"], t["end"]) for t in x] for x in got] == [index.tokenize_text(t or "") for t in texts]


def test_index_store(spark, tmp_path):
    df, p, st = build(spark, "one two", "three")
    who = {"tokenizer": "t", "normalization": "n", "profile": "p", "publication": None}
    index_store.export(f"{tmp_path}/i", df, p, st, ["s"], who)
    back, stats = index_store.load(spark, f"{tmp_path}/i", df, ["s"], who)
    assert back.count() == 3 and stats.count() == 2
    for other, live in ((who | {"publication": "x"}, df), (who, df.withColumn("text", F.lit("changed")))):
        with pytest.raises(index_store.Incompatible):
            index_store.load(spark, f"{tmp_path}/i", live, ["s"], other)
    with pytest.raises(index_store.Incompatible):
        index_store.export(f"{tmp_path}/j", df, p, st.limit(1), ["s"], who)


def test_progression(spark):
    df = spark.createDataFrame([("b", 0, 6), ("b", 1, 5), ("b", 2, 0), ("b", 3, 2), ("e", 0, 0), ("e", 1, 0)], "book string, k int, n int")
    p = reading.progression(df, "book", "k", F.col("n"))
    got = {(r["book"], r["k"]): (r["start"], r["total"], r["f"]) for r in p.withColumn("f", reading.book_fraction(F.lit(0))).collect()}
    assert got["b", 1] == (6, 13, 6 / 13) and got["b", 3] == (11, 13, 11 / 13) and got["e", 1] == (0, 0, 0.5)
    assert p.select(F.max(reading.book_fraction(F.lit(99)))).first()[0] == 1
    places = reading.positions(p.where("book = 'b'"), "book", "k", 4).orderBy("position").collect()
    assert [(r["k"], r["offset"]) for r in places] == [(0, 0), (0, 4), (1, 0), (1, 4), (2, 0), (3, 0)]


def test_navigation(spark):
    pages = spark.createDataFrame([(1, "<h1>A</h1><h2>B</h2><h3 class=x>C <b>d</b></h3><h2>E</h2><h1>F</h1>")], "p int, html string")
    got = reading.heading_parents(reading.heading_rows(pages, "p"), "p").orderBy("play_order").collect()
    assert [(r["label"], r["parent"]) for r in got] == [("A", None), ("B", 1), ("C d", 2), ("E", 1), ("F", None)]
    sections = spark.createDataFrame([("b", 0, "OEBPS/one.xhtml"), ("b", 1, "OEBPS/text/two.xhtml"), ("b", 2, "two.xhtml")], "book_id string, section_index int, name string")
    nav = spark.createDataFrame([("b", "OEBPS/one.xhtml"), ("b", "two.XHTML"), ("b", "text/two.xhtml"), ("b", "none"), ("b", "wo.xhtml")], "book_id string, path string")
    assert {r["path"]: r["target"] for r in reading.match_targets(nav, sections).collect()} == {"OEBPS/one.xhtml": 0, "two.XHTML": 2, "text/two.xhtml": 1, "none": None, "wo.xhtml": None}


def test_navigation_targets_broadcast_no_side(spark):
    """Files that look small may hold more rows than the driver has memory for."""
    sections = spark.sql("SELECT * FROM VALUES ('b', 0, 'x/one'), ('b', 1, 'y/one'), ('c', 0, 'ONE'), (NULL, 5, 'one') t(book_id, section_index, name)")
    nav = spark.sql("SELECT * FROM VALUES ('b', 'one', 1), ('b', 'one', 1), ('b', 'Y/one', 2), ('c', 'one', 3), ('c', NULL, 4), (NULL, 'one', 5) t(book_id, path, n)")
    out = reading.match_targets(nav, sections)
    assert sorted(out.select("n", "target").collect()) == [(1, 0), (1, 0), (2, 1), (3, 0), (4, None), (5, None)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_html_metadata_of_odd_pages_as_sql(spark, tmp_path):
    titles = ["a &amp;&quot;b&quot; &amp", " \u00a0x  y\u3000", "\n z\t", "a&lt;b&#39;", "", "ſt\u00e9 &amp;amp;"]
    pages = [f'<HTML class="k" lang="en US"><title>{t}</TITLE><title>2</title>' for t in titles]
    pages += ["<html lang='de'><title lang=de>t</title>", '<html xml:lang="a" data-lang="b"\n><title>\nq', '<html élang="x">', '<html _lang="x">', "", None]
    rows = [(k, t, f"http://H{k}.example/p?q" if k % 3 else None) for k, t in enumerate(pages)]
    pd.DataFrame(rows, columns=["page_id", "html", "url"]).to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = con.execute(queries.ORACLE_SQL["html_metadata"]).fetchall()
    assert sorted(map(tuple, queries.html_metadata(spark, str(tmp_path)).collect())) == sorted(want)
    decoded = {r["page_id"]: r["title"] for r in queries.html_metadata_decoded(spark, str(tmp_path)).collect()}
    assert decoded[0] == 'a &"b" &' and decoded[3] == "a<b'" and decoded[6] == "t" and decoded[11] == ""


def test_merges(spark):
    kind = "id string, at int, note string"
    local, incoming = spark.createDataFrame([("a", 1, "l"), ("b", 5, "l"), ("c", 2, "l")], kind), spark.createDataFrame([("a", 2, "i"), ("b", 3, "i"), ("c", 2, "i"), ("d", 1, "i")], kind)
    assert sorted(tuple(r) for r in annotations.merge_highlights(local, incoming, ["id"], "at").collect()) == [("a", 2, "i", True), ("b", 5, "l", False), ("c", 2, "l", False), ("d", 1, "i", True)]
    twice = spark.createDataFrame([("a", 1, 0, "x"), ("a", 1, 1, "y")], "id string, at int, arrived int, side string")
    assert annotations.merge_highlights(twice, twice.limit(0), ["id"], "at", "arrived").first()["side"] == "x"
    marks = [("u", 0, "one", 0, 0, 10), ("u", 1, "two", 1, 0, 20), ("u", 2, "one", 5, 5, 30), ("u", 3, "new", 5, 5, 40), ("u", 4, "x", 1, 0, 5)]
    df = spark.createDataFrame(marks, "owner string, appearance int, title string, section_index int, char_offset int, created_at int")
    # The third joins the first's group by title; its own position stays unknown, so the fourth opens a group.
    assert sorted((r["title"], r["created_at"]) for r in annotations.merge_bookmarks(df, "owner").collect()) == [("new", 40), ("one", 30), ("two", 20)]


def test_quotes(spark):
    quotes = spark.createDataFrame([(1, "aa"), (2, "the second quote is a long one with words in it"), (3, "missing")], "q int, quote string")
    texts = spark.createDataFrame([(10, "aaa b"), (11, "x the second quote is a long one with words in it, xthe second quote is a long one with words in itx"), (12, "none")], "d int, text string")
    got = sorted((r["q"], r["d"], r["start"]) for r in annotations.exact_quotes(quotes, texts).collect())
    assert got == [(1, 10, 0), (1, 10, 1), (2, 11, 2), (2, 11, 52)]
    ctx = spark.createDataFrame([("abc QUOTE def", 4, 9, "xbc ", " dex")], "t string, s int, e int, b string, a string")
    assert ctx.select(annotations.context_score(*[F.col(c) for c in "tseba"])).first()[0] == 3 + 3
    assert annotations.semi_global("needle", "hay neddle hay", 2) == (1, 4, 10)
    assert annotations.semi_global("needle", "nothing here", 2) is None
    long = "it was the best of times, it was the worst of times, it was the age of wisdom"
    fuzzy = annotations.fuzzy_quotes(spark.createDataFrame([(1, long.replace("worst", "wurst"))], "q int, quote string"), spark.createDataFrame([(7, "Then " + long + " indeed"), (8, "unrelated text " * 9)], "d int, text string"), "q", "d")
    assert [tuple(r) for r in fuzzy.collect()] == [(1, 1, 7, 5, 5 + len(long))]


def test_outcomes_and_relocation(spark):
    found = spark.createDataFrame([(1, 5, 0, 3), (1, 6, 4, 9), (2, 5, 1, 1), (2, 5, 8, 1), (3, 9, 0, 2)], "a int, s int, start int, c int")
    anchors = spark.createDataFrame([(1,), (2,), (3,), (4,)], "a int")
    got = {r["a"]: (r["outcome"], r["n"]) for r in annotations.outcomes(anchors, found, "a", F.col("c")).collect()}
    assert got == {1: ("resolved", 1), 2: ("ambiguous", 2), 3: ("resolved", 1), 4: ("missing", 0)}
    best = annotations.relocate(found.withColumn("home", F.lit(5)), "a", "s", "home", F.col("c"))
    assert {r["a"]: (r["s"], r["start"]) for r in best.collect()} == {1: (5, 0), 2: (5, 1), 3: (9, 0)}


def plain_semi_global(quote, text, most):
    """The table of edit distances with the leftmost start of each, cell by cell."""
    row = [(k, 0) for k in range(len(quote) + 1)]
    best = None
    for at, char in enumerate(text, 1):
        new = [(0, at)]
        for k in range(1, len(quote) + 1):
            new.append(min((row[k - 1][0] + (quote[k - 1] != char), row[k - 1][1]), (row[k][0] + 1, row[k][1]), (new[k - 1][0] + 1, new[k - 1][1])))
        row = new
        if row[-1][0] <= most and (best is None or row[-1][0] < best[0]):
            best = (*row[-1], at)
    return best


def test_semi_global_equals_the_table():
    r = random.Random(4)
    for _ in range(1500):
        quote, text = ("".join(r.choice("abc") for _ in range(r.randint(1, n))) for n in (9, 24))
        most = r.randint(0, 4)
        assert annotations.semi_global(quote, text, most) == plain_semi_global(quote, text, most), (quote, text, most)


def test_fuzzy_quotes_without_blanks(spark):
    """Grams are taken anywhere: texts without blanks, short quotes and long words are found."""
    r = random.Random(5)
    chinese = "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(300))
    word = "".join(r.choice("abcdefghij") for _ in range(200))
    texts = spark.createDataFrame([(1, chinese), (2, word), (3, "see the Ωmega end"), (4, None), (5, "")], "d int, text string")
    quotes = [(1, chinese[100:140] + "x" + chinese[141:160]), (2, "X" + word[51:90]), (3, "Ωmega"), (4, "absent quote of some length"), (5, ""), (6, None)]
    got = {x["q"]: (x["d"], x["distance"], x["start"], x["end"]) for x in annotations.fuzzy_quotes(spark.createDataFrame(quotes, "q int, quote string"), texts, "q", "d").collect()}
    assert got.keys() == {1, 2, 3} and got[1] == (1, 1, 100, 160) and got[3] == (3, 0, 8, 13) and got[2][:2] == (2, 1) and got[2][3] == 90


def test_durable_anchors(spark):
    kind = "section int, text string"
    quote = "the quick brown fox jumps over the lazy dog and runs away"
    old = spark.createDataFrame([(0, "same text here"), (1, f"before one {quote} after one"), (2, f"x {quote} y"), (3, "gone forever and ever amen"), (4, "alpha beta  gamma delta epsilon zeta eta theta iota"), (5, "it was the best of times it was the worst of times indeed")], kind)
    ranges = spark.createDataFrame([(0, 0, 5, 9), (1, 1, 11, 11 + len(quote)), (3, 3, 0, 26), (4, 4, 0, 50), (5, 5, 0, 57)], "anchor_id int, section int, start int, end int")
    kept = anchors.capture(old, ranges)
    new = spark.createDataFrame([(0, "same text here"), (1, f"New intro. before one {quote} after one"), (2, f"x {quote} z"), (4, "** alpha beta gamma delta epsilon zeta eta theta iota"), (5, "it was the bast of times it was the worst of times indeed")], kind)
    got = {r["anchor_id"]: (r["outcome"], r["pass"], r["section"], r["start"], r["end"]) for r in anchors.resolve(kept, new).collect()}
    assert got[0] == ("resolved", "identity", 0, 5, 9) and got[1] == ("resolved", "exact", 1, 22, 22 + len(quote))
    assert got[3][0] == "missing" and got[4] == ("resolved", "normalized", 4, 3, 52) and got[5] == ("resolved", "fuzzy", 5, 0, 57)
    blank = kept.where("anchor_id = 1").withColumn("before", F.lit("")).withColumn("after", F.lit(""))
    assert anchors.resolve(blank, new).first()["outcome"] == "ambiguous"


def test_fuzzy_queries_read_documents(spark, tmp_path):
    """Whole altered passages against documents, and each anchor with its outcome, by brute force."""
    r = random.Random(6)
    passages = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(25)) for _ in range(6)]
    bent = passages[1][:70] + "qq" + passages[1][72:]
    docs = ["lead " + passages[0] + " tail", "x " + bent, "a " + passages[2] + " b", passages[2], "c " + passages[3][:60] + passages[3][62:], "d " + passages[3][:60] + passages[3][62:], None]
    pd.DataFrame({"item_id": range(6), "text": passages}).to_parquet(tmp_path / "benchmark.parquet")
    pd.DataFrame({"doc_id": range(len(docs)), "text": docs}).to_parquet(tmp_path / "documents.parquet")
    want = {}
    for k, p in enumerate(passages):
        quote = p[:42] + "zz" + p[44:]
        hits = [(h[0], n, *h[1:]) for n, t in enumerate(docs) if t and (h := plain_semi_global(quote, t, 8))]
        if hits:
            want[k] = min(hits)
    assert {x["item_id"]: (x["distance"], x["section"], x["start"], x["end"]) for x in queries.quote_fuzzy(spark, str(tmp_path)).collect()} == want
    got = {x["anchor_id"]: (x["outcome"], x["pass"], x["section"]) for x in queries.durable_anchors_fuzzy(spark, str(tmp_path)).collect()}
    none = ("missing", None, None)
    assert got == {0: ("resolved", "exact", 0), 1: ("resolved", "fuzzy", 1), 2: ("ambiguous", "exact", None), 3: ("ambiguous", "fuzzy", None), 4: none, 5: none}


def test_text_queries_read_every_document(spark, tmp_path):
    """Quotes, blank lines and html tags are in the tables, by brute force."""
    texts = ['He said "yes" (\'no\')... --"so"', "one\n two\n\nthree\n \t\n\n four \n", "see <html> here", "a\u00a0'b'", "", "   ", "plain"]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"page_id": [1], "url": ["u"], "html": ["<html></html>"]}).to_parquet(tmp_path / "pages.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def smart(t):
        out, before = "", "\n"
        for c in t.replace("...", "…").replace("--", "—"):
            out += c if c not in "\"'" else {'"': "“”", "'": "‘’"}[c][not (before.isspace() or before in "([{—–")]
            before = c
        return out

    def paragraphs(t):
        out = [[]]
        for line in t.split("\n"):
            out[-1].append(line.strip()) if line.strip() else out.append([])
        return [" ".join(p) for p in out if p]

    d = str(tmp_path)
    assert {r["doc_id"]: r["sha256"] for r in queries.smart_punctuation_all(spark, d).collect()} == {k: sha(smart(t)) for k, t in enumerate(texts)}
    got = {r["doc_id"]: (r["sha256"], r["n"]) for r in queries.txt_paragraphs(spark, d).collect()}
    assert got == {k: (sha("\n".join(paragraphs(t))), len(paragraphs(t))) for k, t in enumerate(texts)}
    assert {(r["source"], r["format"]): r["n"] for r in queries.detected_formats(spark, d).collect()} == {("pages", "html"): 1, ("documents", "html"): 1, ("documents", "txt"): 5, ("documents", None): 1}


def test_chapter_headings(spark, tmp_path):
    text = "Chapter 1: Start\nbody\n\n  IV\npart of the plan\nTHE RETURN\nchapter one\ncapÍtulo ii fin\nIVa\nABC\nKAPITEL 3\n"
    pd.DataFrame({"doc_id": [1, 2, 3], "text": [text, "no headings", None]}).to_parquet(tmp_path / "documents.parquet")
    want = [("Chapter 1: Start", 0), ("IV", text.index("\n  IV")), ("THE RETURN", text.index("THE")), ("capÍtulo ii fin", text.index("cap"))]
    want += [("KAPITEL 3", text.index("KAP"))]
    got = sorted((r["doc_id"], r["offset"], r["title"]) for r in queries.chapter_headings(spark, str(tmp_path)).collect())
    assert got == [(1, at, title) for title, at in want]


def test_tables(spark):
    lines = [(float(k), 0.0, 20.0) for k in (0, 10, 20)]
    assert tables.grid_of(lines, lines) == ([0, 10, 20], [0, 10, 20])
    assert tables.grid_of(lines[:2], lines) is None and tables.grid_of(lines, [(0.0, 0.0, 20.0), (10.0, 0.0, 3.0), (20.0, 0.0, 20.0)]) is None
    words = [("p", f"{c}{r}", 50.0 * c, 20.0 * r, 10.0, 8.0) for r in range(4) for c in range(3)] + [("q", "lone", 0.0, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame(words, "page string, text string, x double, y double, w double, h double")
    got = {(r["row"], r["col"]): r["text"] for r in tables.column_tables(df, ["page"]).collect()}
    assert got == {(r, c): f"{c}{r}" for r in range(4) for c in range(3)}
    cells = spark.createDataFrame([("p", 0, 0, 0.0, 0.0, 60.0, 15.0)], "page string, row int, col int, x double, y double, w double, h double")
    assert tables.words_in_cells(df, cells, ["page"]).first()["text"] == "00 10"


def test_zones(spark):
    zones = spark.createDataFrame([("b", k, kind, a, e) for k, (kind, a, e) in enumerate([("region", 0, 1500), ("word", 0, 5), ("word", 6, 10), ("word", 1100, 1500), ("region", 1500, 1600)])], "book string, zone_seq int, kind string, text_start int, text_end int")
    ranges = spark.createDataFrame([("b", 1, 11, 15), ("b", 2, 4, 7), ("b", 3, 500, 1200)], "book string, r int, start int, end int")
    got = {}
    for r in spatial.overlapping(ranges, zones, ["book"], 64).collect():
        got.setdefault(r["r"], []).append(r["zone_seq"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [0], 2: [0, 1, 2], 3: [0, 3]}
    at = spatial.zone_at(spark.createDataFrame([("b", 7), ("b", 5)], "book string, offset int"), zones, ["book"], "word")
    assert {r["offset"]: r["zone_seq"] for r in at.collect()} == {7: 2, 5: None}
    assert [r["within"] for r in spatial.enclosing(zones, ["book"]).orderBy("zone_seq").collect()] == [0, 0, 0, 0, 4]


def test_layout(spark):
    rules = spark.createDataFrame([("p", 10.0, 0.0, 5.0), ("p", 10.5, 6.0, 9.0), ("p", 10.2, 20.0, 30.0), ("p", 50.0, 0.0, 5.0)], "page string, at double, low double, high double")
    assert sorted((r["low"], r["high"]) for r in spatial.merged_rules(rules, ["page"]).collect()) == [(0, 5), (0, 9), (20, 30)]
    blocks = [("p", n, x, y, w, h, 100.0) for n, x, y, w, h in (("r", 60.0, 20.0, 40.0, 50.0), ("head", 0.0, 0.0, 100.0, 5.0), ("l1", 0.0, 20.0, 40.0, 5.0), ("l2", 0.0, 28.0, 40.0, 5.0))]
    df = spark.createDataFrame(blocks, "page string, name string, x double, y double, w double, h double, page_width double")
    assert [r["name"] for r in spatial.reading_order(df, ["page"]).orderBy("place").collect()] == ["head", "l1", "l2", "r"]
    assert sorted(r["band"] for r in spatial.with_row_bands(df.where("name <> 'r'"), ["page"]).collect()) == [0, 1, 2]
    lines = spark.createDataFrame([("b", p, k, t) for p in range(4) for k, t in enumerate(["My Book", f"text {p}", str(p + 1)])], "book string, page int, line_no int, text string")
    assert sorted((r["edge"], r["text"]) for r in spatial.edge_lines(lines, "book", "page").collect()) == [("foot", "#"), ("head", "My Book")]


def test_catalogue(spark):
    link = spark.createDataFrame([(1, 1, 10), (2, 1, 11), (3, 2, 12)], "rid int, book int, item int")
    names = spark.createDataFrame([(10, "B"), (11, "A"), (12, None)], "item int, name string")
    books = catalogue.assemble(spark.createDataFrame([(1,), (2,), (3,)], "book int"), "book", {"authors": catalogue.linked_names(link, names, "book", "item", "name", "rid")})
    assert {r["book"]: r["authors"] for r in books.collect()} == {1: ["B", "A"], 2: [""], 3: []}
    ids = spark.createDataFrame([(1, 1, "isbn", "x"), (2, 1, "isbn", "y"), (3, 1, "doi", "z")], "rid int, book int, k string, v string")
    values = catalogue.last_values(ids, "book", "k", "v", "rid")
    assert values.first()["values"] == {"doi": "z", "isbn": "y"}
    assert values.select(catalogue.backfilled(F.col("values"), "isbn", F.lit("n")).alias("a"), catalogue.backfilled(F.col("values"), "asin", F.lit("n")).alias("b")).first()["b"]["asin"] == "n"


def test_package_rules(spark):
    book = spark.createDataFrame([("good", "3.0", "application/epub+zip", "o.opf"), ("bad", "1.0", "x", "gone.opf")], "book_id string, version string, mimetype string, rootfile string")
    manifest = spark.createDataFrame([("good", 0, "a", "a.xhtml", "t"), ("bad", 0, "a", "a.xhtml", "t"), ("bad", 1, "a", "a.xhtml", "t"), ("bad", 2, None, "b", "t"), ("bad", 3, "c", "c.xhtml#f", "t"), ("bad", 4, "d", "http://x/y", "t")], "book_id string, pos int, item_id string, href string, media_type string")
    spine = spark.createDataFrame([("good", 0, "a"), ("bad", 0, "zz"), ("bad", 1, "zz")], "book_id string, pos int, idref string")
    entries = spark.createDataFrame([("good", 0, "mimetype"), ("good", 1, "META-INF/container.xml"), ("good", 2, "o.opf"), ("good", 3, "a.xhtml"), ("bad", 0, "a.xhtml")], "book_id string, pos int, path string")
    links = spark.createDataFrame([("good", 0, "nav", "a.xhtml", None), ("good", 1, "toc", "a.xhtml", "x"), ("bad", 0, "toc", "none.xhtml", None), ("bad", 1, "toc", "a.xhtml", "no"), ("bad", 2, "guide", "g", None)], "book_id string, pos int, kind string, path string, fragment string")
    anchors = spark.createDataFrame([("good", "a.xhtml", "x")], "book_id string, path string, fragment string")
    found = package_rules.findings(book, manifest, spine, entries, links, anchors)
    rules = {r["rule"] for r in found.where("book_id = 'bad'").collect()}
    assert found.where("book_id = 'good'").count() == 0
    assert rules == {
        "container.mimetype-invalid", "container.missing", "container.rootfile.path-unresolved", "package.version-unsupported", "manifest.item.incomplete", "manifest.id-duplicate", "manifest.href-duplicate", "manifest.href-fragment",
        "manifest.remote-resource-undeclared", "manifest.resource-missing", "spine.reference-invalid", "spine.reference-duplicate", "navigation.nav-missing", "navigation.link-unresolved", "navigation.fragment-unresolved", "guide.reference-unresolved",
    }
    assert package_rules.report(found).first()["errors"] > 0


def test_incremental_index(spark, tmp_path):
    schema = "s int, text string"
    # Section 1 comes again: only its last text counts.
    for rows in ([(0, "grey heron"), (1, "grey heron")], [(10, "heron run"), (1, "grey")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q = incremental.index_stream(spark.readStream.schema(schema).json(f"{tmp_path}/in"), ["s"], f"{tmp_path}/out", f"{tmp_path}/cp")
        assert q.awaitTermination(120)
    p, st = incremental.read_index(spark, f"{tmp_path}/out", ["s"])
    assert [r["s"] for r in index.ranked(p, st, ["s"], "grey heron").collect()] == [0]
    assert {r["s"]: r["tokens"] for r in st.collect()} == {0: 2, 1: 1, 10: 2} and p.where("s = 1").count() == 1


def plain(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 5)
    if isinstance(v, (np.integer, int)) and not isinstance(v, bool):
        return round(float(v), 5)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return bool(v) if isinstance(v, np.bool_) else v


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return db


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, oracle, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    if name in queries.ORACLE_SQL:
        want = oracle.execute(queries.ORACLE_SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        names = sorted(got.columns)
        assert sorted(repr([plain(v) for v in r]) for r in got[names].itertuples(index=False)) == sorted(repr([plain(v) for v in r]) for r in want[names].itertuples(index=False))


def test_entry_without_the_training_operators(tmp_path):
    import subprocess
    import sys

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "quire", tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).returncode == 0
