"""Operators that compare documents, and HTML, against plain Python."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import common, html_main, near_dups, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sortable(rows):
    return sorted(map(repr, rows))


def repeats_brute(rows):
    texts = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[k : k + 35]) for w in texts for k in range(len(w) - 34))
    out = []
    for r, w in zip(rows, texts):
        keep = [True] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                keep[k : k + 35] = [False] * 35
        kept = [x for x, y in zip(w, keep) if y]
        out.append((r[0], len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 1])
def test_substrings(docs, rows, empty, clashing, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    want = sortable(repeats_brute(rows))
    assert sortable(map(tuple, substrings.remove_repeats(docs).collect())) == want
    assert sortable(map(tuple, substrings.remove_repeats(clashing).collect())) == want
    assert substrings.remove_repeats(empty).count() == 0


def test_windows_at_the_edges(spark):
    from tests.llm.conftest import DOCS, passage

    common_, rows = passage(50, 35), []
    for k in range(60):
        rows.append((k, passage(100 + k, k % 7) + " " + common_ + " " + passage(200 + k, k % 5), "en", "s", 0))
        rows.append((100 + k, " ".join(common_.split()[: 20 + k % 20]) + " " + passage(300 + k, 30), "en", "s", 0))
    rows.append((999, " ".join([passage(70, 40)] * 2), "en", "s", 0))
    assert sortable(map(tuple, substrings.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())) == sortable(repeats_brute(rows))


def test_run_hashes_and_least_kmers():
    h = np.arange(100, dtype=np.uint64) % np.uint64(13)
    for size in (1, 2, 3, 8, 35):
        got = substrings.run_hashes(h, size, substrings._ROOTS[1])
        assert len(got) == 101 - size
        same = {}
        for k, x in enumerate(got.tolist()):
            assert same.setdefault(tuple(h[k : k + size].tolist()), x) == x
        assert len(set(same.values())) == len(same)
    kmers, low = substrings.least_kmers(h)
    assert low.tolist() == [kmers[k : k + 28].min() for k in range(66)]
    places, _ = substrings.edges_of(h)
    assert set(places.tolist()) == {p for k in range(66) for p in range(k, k + 28) if kmers[p] == low[k]}


def test_word_hashes_follow_the_words():
    texts = ["a b  a\tab", "", "  ", "x" * 700 + " " + "x" * 699 + "y", "é\x0bé", "last"]
    for most in (1, 1 << 20):
        hashes, ends = common.hashed_words(*common.bytes_of(pa.array(texts)), most)
        by = {}
        for t, a, b in zip(texts, ends[:-1], ends[1:]):
            assert b - a == len(WORD.findall(t))
            for w, x in zip(WORD.findall(t), hashes[a:b].tolist()):
                assert by.setdefault(w, x) == x
        assert len(set(by.values())) == len(by)


def near_brute(rows, threshold=0.8):
    no_id = -(1 << 63)
    sets = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids = [no_id if r[0] is None else r[0] for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        same = not sets[a] and not sets[b] or len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9 and sets[a] and sets[b]
        if same:
            links[a] += 1
            links[b] += 1
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    low = {}
    for k in range(len(rows)):
        low[top(k)] = min(ids[k], low.get(top(k), ids[k]))
    return [(r[0], low[top(k)], links[k]) for k, r in enumerate(rows)]


def family(n=90):
    from tests.llm.conftest import passage

    rows = []
    for k in range(n):
        words = passage(1000 + k % 3, 100).split()
        for j in range(k // 3 % 6):
            words[(7 * j + k) % 100] = f"changed{k}x{j}"
        rows.append((k * 7 % 1009, " ".join(words), "en", "s", 0))
    return rows


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates(spark, docs, rows, empty, clashing, monkeypatch, block):
    from tests.llm.conftest import DOCS

    monkeypatch.setattr(near_dups, "BLOCK_SETS", block)
    many = rows + [(r[0] + 5000, *r[1:]) for r in family()]
    got = near_dups.near_duplicates(spark.createDataFrame(many, DOCS)).collect()
    assert sortable(map(tuple, got)) == sortable(near_brute(many))
    if block == 256:
        assert sortable(map(tuple, near_dups.near_duplicates(clashing).collect())) == sortable(near_brute(rows))
        assert near_dups.near_duplicates(empty).count() == 0
        kept = near_dups.one_of_each(clashing)
        assert kept.columns == clashing.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter({(None if c == -(1 << 63) else c): 1 for c in {x[1] for x in near_brute(rows)}})


def test_banding_reaches_its_recall():
    for threshold, recall in ((0.8, 0.999999), (0.8, 0.95), (0.5, 0.9)):
        bands, rows = near_dups.banding(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 50), (50, 50), (60, 61)]
    got = {r["set"]: r["root"] for r in near_dups.least_members(spark.createDataFrame(edges, "set bigint, root bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 50, 50: 50, 60: 60, 61: 60}


PAGES = "page_id bigint, url string, html string"


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in html_main.extract_main(spark.createDataFrame(rows, PAGES)).collect()}


def test_declared_articles(spark):
    page = "<html><head><title>t</title><style>p{}</style><script>x='<p>no</p>'</script></head><body><nav><ul><li>m</li></ul></nav><div class='ad'>buy</div>{}<footer>f</footer>"
    bodies = {
        1: ("<article><h1>A &amp; B</h1><p><b>one  \n two<br>three<p>four</article>", "A & B\none two three\nfour"),
        2: ("<article><header><h1>T</h1></header><p>x</p><aside>s</aside><div class='comments'><p>c</p></div><form>q</form></article>", "T\nx"),
        3: ("<main><p>&lt;i&gt; &#233;</p></main>", "<i> é"),
        5: ("<article><ul><li>1<li>2</ul><table><tr><td>a<td>b</table><!-- <p>no</p> --></article>", "1\n2\na\nb"),
        6: ("<article></article>", ""),
        7: ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    }
    rows = [(k, f"http://h{k}.example.com/", page.replace("{}", b)) for k, (b, _) in bodies.items()]
    rows += [(20, "http://x/", None), (21, None, ""), (None, None, "plain"), (23, "http://x/", "<article>a < b, cut <b"), (22, "no url", "<p>q</p>" * 20_000)]
    got = extracted(spark, rows)
    assert {k: got[k] for k in bodies} == {k: t for k, (_, t) in bodies.items()}
    assert got[20] == got[21] == "" and got[None] == "plain" and got[22] == "\n".join(["q"] * 20_000)
    assert got[23] == "a < b, cut"
    assert len(extracted(spark, [])) == 0


def test_template_of_a_host_is_deduced(spark):
    """Without declared articles, text that stands in each page of a host is template."""
    page = "<body><div><p>Welcome to our site</p></div><div><h2>{0}</h2><p>Body of {0}, long enough.</p></div><div><p>All rights belong to us</p></div></body>"
    rows = [(k, "http://one.example.com/a", page.format(name)) for k, name in enumerate(["red", "green", "blue"])]
    rows += [(9, "http://two.example.com/a", page.format("lone"))]
    got = extracted(spark, rows + rows[:1])
    assert got[1] == "green\nBody of green, long enough."
    assert got[9].startswith("Welcome to our site\nlone")
    copies = extracted(spark, [(k, "http://c.example.com/", page.format("same")) for k in range(5)])
    assert all("Body of same" in t for t in copies.values())  # copies lend no support


def test_articles_repeated_on_a_host_stay(spark):
    page = "<body><nav>{0}</nav><article><p>The same article in all pages.</p></article></body>"
    got = extracted(spark, [(k, "http://s.example.com/", page.format(k)) for k in range(4)])
    assert set(got.values()) == {"The same article in all pages."}


def test_template_of_some_pages(spark):
    """Empty pages, errors and pages of another layout do not switch a host's template off, nor do near copies pass for one."""
    page = "<body><div><p>Welcome to our site</p></div><div><h2>{0}</h2><p>Body of {0}, long enough.</p></div><div><p>All rights belong to us</p></div></body>"
    url = "http://one.example.com/a"
    rows = [(k, url, page.format(name)) for k, name in enumerate(["red", "green", "blue"])]
    rows += [(10, url, None), (11, url, ""), (12, url, "<h1>Error 500</h1>"), (13, url, "<body><table><tr><td>other layout</table></body>")]
    rows += [(k, url, "<body>" + "".join(f"<p>Paragraph {j} of a copied page</p>" for j in range(9)) + f"<p>copy {k}</p></body>") for k in range(20, 24)]
    got = extracted(spark, rows)
    assert [got[k] for k in range(3)] == [f"{c}\nBody of {c}, long enough." for c in ("red", "green", "blue")]
    assert got[12] == "Error 500" and got[13] == "other layout" and got[20].count("\n") == 9


def test_classes_nest_and_leave_slots(spark):
    """A link inside a slot of prose stays, a list of links goes, and classes that cross the template are none of it."""
    members = [{"class": 1, "token": 10, "places": [0], "support": 9}, {"class": 1, "token": 11, "places": [5], "support": 9}]
    inner = [{"class": 2, "token": 20, "places": [1, 3], "support": 5}, {"class": 2, "token": 21, "places": [2, 4], "support": 5}]
    assert sorted(nested(members + inner)) == [(1, 0, 0), (2, 1, 1)]
    across = [{"class": 3, "token": 30, "places": [1], "support": 5}, {"class": 3, "token": 31, "places": [6], "support": 5}]
    assert sorted(nested(members + across)) == [(1, 0, 0), (3, 0, -1)]
    page = "<body><div><h1>Site</h1></div><section><p>{0} begins with a long enough sentence here.</p><p><a href=x>link {0}</a></p></section><ul><li><a href=y>item {0}</a></li><li><a href=z>more {0}</a></li></ul></body>"
    got = extracted(spark, [(k, "http://n.example.com/", page.format(c)) for k, c in enumerate("abcd")])
    assert got[0] == "a begins with a long enough sentence here.\nlink a"


def test_names_inside_articles(spark):
    """Words in names do not cut a declared article; whole names of adverts and comments do."""
    body = "<section id='related-work'><h2 id='search-results'>Found</h2><p class='notice'>note</p></section><p id='ads'>p</p><div class='share'>s</div><div id='comments'>c</div><div class='ad box'>buy</div>"
    rows = [(1, "http://a/", f"<article class='post hentry category-social tag-advertising'>{body}</article>"), (2, "http://b/", f"<main class='with-sidebar'>{body}</main><div class='side-ads'>x</div>")]
    assert extracted(spark, rows) == {1: "Found\nnote\np", 2: "Found\nnote\np"}


def text_of(page: str) -> str:
    return html_main.main_text(page)[0]


@pytest.mark.parametrize(
    "name",
    ["main class='content no-sidebar'", "main class='has-sidebar'", "article class='post comments-open'", "article class='post-form'", "article class='post search-engines'", "div class='ad-free'", "div class='page-nav-layout'", "div id='main-content'"],
)
def test_names_of_wrappers_lose_no_article(name):
    kind = name.split()[0]
    assert text_of(f"<body><div class='ad'>buy</div><{name}><h1>Title</h1><p>One.</p></{kind}><footer>f</footer></body>") == "Title\nOne."


def test_asides_by_name():
    page = "<div class='main-nav'>m</div><div id='sidebar'>s</div><div class='site-footer'>f</div><div class='ad-box'>b</div><section class='comments'>c</section><p>Text.</p>"
    assert text_of(page) == "Text."
    inner = "<article><p class='notice-board'>a</p><div class='form-group'>b</div><div class='comments'>c</div><form><p>q</p></form><p>d</p></article>"
    assert text_of(inner) == "a\nb\nd"


def test_marked_wrappers_of_the_only_article():
    assert text_of("<div class='sidebar-right layout ad'><article><p>x</p></article></div><p>y</p>") == "x"
    assert text_of("<form><div><article><p>x</p></article></div></form>") == "x"
    assert text_of("<form><p>The whole page stands in a form.</p></form>") == "The whole page stands in a form."
    assert text_of("<div class='related'><article><p>teaser</p></article></div><article><p>x</p></article>") == "x"


def test_main_and_articles():
    assert text_of("<main><h1>Title</h1><article>x</article><p>tail</p></main>") == "Title\nx\ntail"
    assert text_of("<main><article><p>A long article, the page's own.</p></article><article><p>teaser</p></article></main>") == "A long article, the page's own."
    assert text_of("<article><p>one</p></article><article><p>two</p></article>") == "one\ntwo"


def test_tags_and_quotes():
    assert text_of("<p title=it's>text one</p><p title=\"a > b\">two</p><p title='x>three</p>") == "text one\ntwo\nthree"
    assert text_of("<p>a &lt;b&gt; &amp;amp; 1 < 2 <3 <!-- c --> <!--> d <? e ?> </ f> g</p>") == "a <b> &amp; 1 < 2 <3 d g"
    assert text_of("<p>x<script>if (a</script>y<ScRiPt>'</p>'</sCript >z") == "xyz"
    assert text_of("<p>Some words and <a href=x>a link</a></p><div><a href=y>all a link</a></div><ul><li><a>m</a></li><li><a>n</a></li></ul>") == "Some words and a link"
    assert text_of("<div><p>Some text of the page.</p><p><a href=y>all a link</a></p></div><ul><li><a>m</a></li><li><a>n</a></li></ul>") == "Some text of the page.\nall a link"


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<div><li>", "<ul><div>", "</div>", "<div>", "<p><table><td>", "<!--", "<script>", "<a b=\"", "<a b='>", "<a b=\">\" ", "<a b=\">\"> ", "&amp", "<", "</", "<p>x</p>", "<div class='a b c'>x", "<svg><g>", "<main><article>x</article>"])
def test_time_is_in_proportion(piece):
    import time

    def took(n):
        begun = time.perf_counter()
        html_main.main_text("<article><p>start</p>" + piece * (n // len(piece)) + '"')
        return time.perf_counter() - begun

    assert took(1 << 20) < 12 or took(1 << 20) < 12  # a few times 1 s per MB on a busy machine; quadratic would be hours


def nested(members):
    """``nesting`` of members (class, token, places, support) of one page."""
    tokens = {}
    for m in members:
        tokens.setdefault(m["class"], set()).add(m["token"])
    width = {c: len(t) for c, t in tokens.items()}
    rank = {m["class"]: (m["support"], width[m["class"]], m["class"]) for m in members}
    return html_main.nesting([c for _, c in sorted((p, m["class"]) for m in members for p in m["places"])], width, rank)


def template_brute(rows) -> dict[int, set[int]]:
    """page row -> tokens of its host's template: classes of equal vectors, in one order, spread and nested."""
    hosts, out = {}, {k: set() for k in range(len(rows))}
    for k, (_, url, page) in enumerate(rows):
        host = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
        hosts.setdefault(host[1].lower() if host else "", {}).setdefault(page or "", []).append(k)
    for pages in hosts.values():
        seqs, prose, article = {}, {}, {}
        for page in pages:
            blocks, tags = html_main.blocks_of(page)
            taken, declared = html_main.chosen(blocks)
            roles = html_main._roles(blocks, tags)
            seqs[page] = [t for t, _ in roles]
            prose[page] = {t for t, b in roles if any(b is x for x in taken)}
            article[page] = prose[page] if declared else set()
        tokens = {t for s in seqs.values() for t in s}
        vectors = {t: tuple((p, s.count(t)) for p, s in seqs.items() if t in s) for t in tokens}
        # Support of fewer than MIN_PAGES rows (copies included) makes no class.
        classes = {}
        for t, v in vectors.items():
            if sum(len(pages[p]) for p, _ in v) >= 3:
                classes.setdefault(v, set()).add(t)
        held = {p: set().union(*(c for v, c in classes.items() if any(q == p for q, _ in v))) if classes else set() for p in seqs}
        differs = {p: len(prose[p]) >= 2 * len(prose[p] & held[p]) for p in seqs}
        valid = {}
        for v, members in classes.items():
            orders = set()
            for p, _ in v:
                order = [t for t in seqs[p] if t in members]
                first = order[: len(members)]
                orders.add(tuple(first) if len(set(first)) == len(members) and order == first * (len(order) // len(members)) else None)
            if len(v) < 3 or len(orders) > 1 or None in orders:
                continue
            common, differing = 2 * len(v) >= len(pages), sum(differs[p] for p, _ in v) >= 3
            if common or differing:
                valid[v] = (members, common and differing)
        gaps = {}
        for p in seqs:
            mine = [(v, m) for v, (m, _) in valid.items() if any(q == p for q, _ in v)]
            members = [{"class": v, "token": t, "places": [i for i, x in enumerate(seqs[p]) if x == t], "support": len(v)} for v, m in mine for t in m]
            for name, around, gap in nested([{**m, "class": hash(m["class"])} for m in members]):
                gaps.setdefault((name, around), set()).add(gap)
        stray = {name for (name, _), g in gaps.items() if len(g) > 1 or min(g) < 0}
        for v, (members, strong) in valid.items():
            for p, _ in v:
                if hash(v) not in stray:
                    for k in pages[p]:
                        out[k] |= {t for t in members if strong or t not in article[p]}
    return out


def test_extraction_against_brute_force(spark):
    """Whole query by plain Python over three hosts: with and without declared articles, copies, nulls, other layouts."""
    import random

    r = random.Random(3)
    line = lambda: " ".join(r.choice("red green blue stone water light cloud".split()) for _ in range(r.randint(4, 12)))
    shared = [line() for _ in range(3)]
    rows = []
    for k in range(24):
        own = "".join(f"<p>{line()}</p>" for _ in range(r.randint(2, 5))) + (f"<p>{shared[k % 3]}</p>" if k % 4 == 0 else "")
        menu = "".join(f"<li><a href=/{x}>{x}</a></li>" for x in r.sample(["home", "news", "about", "more"], 3))
        rows.append((k, "http://plain.example.com/p", f"<body><div><h2>The Site</h2></div><ul>{menu}</ul><div><h1>T{k}</h1>{own}<p>Read us every day of the week</p></div><div><p>All rights belong to us</p></div></body>"))
        rows.append((100 + k, "http://news.example.com/p", f"<body><nav>{menu}</nav><article><h1>T{k}</h1>{own}<p>Read us every day of the week</p></article><p>The foot</p></body>"))
    rows += [(200 + k, "http://copies.example.com/", f"<body><nav>{k}</nav><article><p>Always the same text.</p></article></body>") for k in range(4)]
    rows += [(300, "http://plain.example.com/x", None), (301, None, "<p>alone</p>"), rows[0], rows[0], rows[1], (302, "http://plain.example.com/e", "<h1>Error</h1>")]
    templates = template_brute(rows)
    want = sortable((x[0], x[1], *(lambda t: (t[0], len(t[0]), t[1]))(html_main.main_text(x[2] or "", frozenset(templates[k])))) for k, x in enumerate(rows))
    got = html_main.extract_main(spark.createDataFrame(rows, PAGES)).collect()
    assert sortable((x["page_id"], x["url"], x["text"], x["n_chars"], x["n_template"]) for x in got) == want
    by = {x["page_id"]: x["text"] for x in got}
    # The template takes text from pages with and without a declared article; what some articles share, and copies, stay.
    assert not any("Read us" in t or "The Site" in t or "rights" in t for k, t in by.items() if k is not None and k < 200)
    assert all(by[k].startswith(f"T{k % 100}\n") for k in (*range(24), *range(100, 124)))
    assert by[100].endswith(shared[0]) and by[203] == "Always the same text."


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "h", 2, "t")], f"{PAGES}, host string, page int, template string")
    assert html_main.extract_main(df).collect()[0]["text"] == "a"
