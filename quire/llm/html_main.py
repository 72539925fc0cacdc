"""HTML extraction by template deduction.

1. Pages are cut into tokens: a tag with the path of block elements above it, or
   a text block with its path (and which of the page's equal ones it is).  Each
   token's occurrence vector over the pages of its host is kept as one number, a
   sum of hashes of (page, count).
2. Tokens of a host with the same vector form an equivalence class.  A class is
   valid if at least ``MIN_PAGES`` different pages hold it and each of them has
   its tokens in the same order, once or over and over.  It need not be in all
   pages; but where less than half of the host's pages hold it, it needs
   ``MIN_PAGES`` pages with as many text blocks of their own as shared ones, or
   near copies of one page would pass for a template.
3. Valid classes nest into the host's template: in every page each occurrence of
   a class stands between the same two tokens of the class around it.  Of two
   that cross, the one in fewer pages is dropped.  What remains between template
   tokens are the slots, named by the token before them; a block of links is left
   out unless its slot, or without a template the element around it, is mostly
   other text.  Text of the template is left out, and so is text in menus,
   headers, footers, sidebars, notices, adverts, forms and reader comments.

Where a page declares its article (article, main), it chooses the slots.  Text
inside is template too where its class is in at least half of the host's pages and
``MIN_PAGES`` of these have as much text of their own: a byline or a call to
subscribe in every article goes, a passage that some articles share stays, and so
do articles that are copies of each other.

What marks an aside is an element's name or role, or a word of its class or id:
outside declared articles the whole name or its first or last part (``MARKS``;
not "no-sidebar" or "ad-free"), inside them whole names only (``INNER_MARKS``).
Words never mark html, body, main and article.  Words and forms around
a page's only declared article do not make it an aside, nor does a form around all
text of a page that declares none.  Of several articles one that holds
more than half of their text stands alone, else all are taken; what a main element
has besides its articles is taken as well.

Text: character references are decoded, scripts, styles, comments and markup go,
runs of ``[\\x20\\x09-\\x0D]`` inside a block become one space, blocks are trimmed
and joined by ``\\n`` in page order; ``br`` is white space inside its block.

Defined results: a null or empty html gives the empty text; unclosed and
truncated markup is tolerated (a tag cut off by the end is dropped, a quote that
is never closed is none); very long pages take time in proportion; equal blocks of
one page (ties) are told apart by their order; a null url is a host of its own;
repeated rows each get a row; a null page_id is kept as null; an empty table gives
an empty result; further columns, whatever their names, are ignored.  Tokens are 64
bits within a host: ten million different ones collide with a chance of 3e-6, and
a collision can only change the class of two tokens.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_counted, mixed, staged

MIN_PAGES = 3
LINK_SHARE = 0.5
#: Sample that the dictionary for packing is made of, and its size; they change no result.
PACK_PAGES, PACK_CHARS, PACK_BYTES = 2_000, 16_384, 1 << 17
#: Elements that begin and end a text block (fixed values of HTML).
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no page text, and those among them that hold no markup (fixed values of HTML).
SILENT = frozenset("script style noscript template head title iframe object svg math canvas select textarea button audio video datalist noembed noframes xmp".split())
RAW = frozenset("script style noscript title iframe textarea noembed noframes xmp".split())
ASIDE = frozenset("nav aside menu search footer header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class or id that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside "
    "footer masthead comment comments respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social "
    "related recommended widget pagination pager toolbar search".split()
)
#: Parts of a name that say it only speaks of an aside.
UNMARKS = frozenset("no not non without free has have with open closed off hide hidden disabled layout".split())
#: Whole classes (or ids of containers) that mark what is not the article even inside it.
INNER_MARKS = frozenset(
    "ad ads advert adverts advertisement comments comment-list respond disqus share sharing social-share sharedaddy newsletter newsletter-signup breadcrumb breadcrumbs sidebar pagination pager related-posts related-articles".split()
)
PHRASES = frozenset("h1 h2 h3 h4 h5 h6 p".split())
IMPLIED_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table tbody thead tfoot menu dir".split())

#: A tag, whose quotes count only behind an equals sign and only if they are closed (an empty last group: no end is left
#: outside quotes), or the beginning of a comment or declaration.
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>|())|(!--)|[!?/])")
_PLAIN_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)(?:([^>]*+)>|())|(!--)|[!?/])")
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACES = re.compile(r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+")
_PARTS = re.compile(r"[^a-z0-9]+")


def _hash(path: int, text: str) -> int:
    return int.from_bytes(blake2b(f"{path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


BY_WORD, BY_FORM = 1, 2


class Root:
    """A declared article or main element; ``article`` is the outermost article around it or it."""

    __slots__ = ("article", "in_main", "marked")

    def __init__(self, kind: str, outer: Root | None, marked: int):
        self.article = outer.article if outer and outer.article else self if kind == "article" else None
        self.in_main = kind == "main" or outer is not None and outer.in_main
        self.marked = marked


class Block:
    __slots__ = ("path", "text", "root", "aside", "marked", "links", "around", "at")

    def __init__(self, path: int, text: str, root: Root | None, aside: bool, marked: int, links: float, around: int, at: int):
        self.path, self.text, self.root, self.aside, self.marked, self.links, self.around, self.at = path, text, root, aside, marked, links, around, at  # at: tags before it


class Frame:
    """An open block element: ``aside`` by its name or role, ``marked`` by words or as a form, or one around it."""

    __slots__ = ("name", "path", "aside", "marked", "root", "silent", "number")

    def __init__(self, name: str, path: int, aside: bool, marked: int, root: Root | None, silent: bool, number: int):
        self.name, self.path, self.aside, self.marked, self.root, self.silent, self.number = name, path, aside, marked, root, silent, number


def _attributes(rest: str) -> tuple[list[str], str, str]:
    """Names in class, the id and the role."""
    names, own, role = [], "", ""
    for m in _ATTR.finditer(rest):
        value = (m[2] or m[3] or m[4] or "").lower()
        kind = m[1].lower()
        if kind == "role":
            role = role or value
        elif kind == "id":
            own = own or value
        elif not names:
            names = value.split()
    return names, own, role


def marks_aside(name: str) -> bool:
    """Whether a class or id outside articles names an aside."""
    if name in MARKS:
        return True
    parts = [p for p in _PARTS.split(name) if p]
    return bool(parts) and (parts[0] in MARKS or parts[-1] in MARKS) and not UNMARKS.intersection(parts)


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) in order: kind is text (in rest), open or close; time is in proportion to the page.

    Comments, declarations, tags that neither end a block nor hide text, and the content of
    elements without markup are left out.  Where a tag's quotes leave it no end, quotes do not count from there on.
    """
    at, n, search = 0, len(page), _TAG.search
    while (m := search(page, at)) is not None:
        start = m.start()
        if start > at:
            yield "text", "", page[at:start]
        at = m.end()
        if m[2] is None:
            if m[5]:
                short = next((k for k in (">", "->") if page.startswith(k, at)), None)
                end = at + len(short) - 3 if short else page.find("-->", at)
            else:
                end = page.find(">", start) - 2 if page.find(">", start) >= 0 else -1
            if end < 0:
                return
            at = end + 3
            continue
        rest = m[3]
        if rest is None:
            search = _PLAIN_TAG.search
            if (end := page.find(">", at)) < 0:
                return  # the end cuts the tag off
            rest, at = page[at:end], end + 1
        name = m[2].lower()
        if name not in _KNOWN:
            continue
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, rest
        if name in RAW and not rest.endswith("/"):
            closing = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = closing.start() if closing else n
    if at < n:
        yield "text", "", page[at:]


_KNOWN = BLOCKS | SILENT | {"a", "br"}
_PATHS: dict[tuple[int, str], int] = {}


def _path(above: int, shown: str) -> int:
    """The hash of a path; frequent ones are kept for the process."""
    if (found := _PATHS.get((above, shown))) is None:
        if len(_PATHS) > 100_000:
            _PATHS.clear()
        found = _PATHS[above, shown] = _hash(above, shown)
    return found


def blocks_of(page: str) -> tuple[list[Block], list[int]]:
    """The page's text blocks in order, and its tag tokens."""
    stack = [Frame("", 0, False, 0, None, False, 0)]
    open_: Counter[str] = Counter()
    scopes: list[Counter[str]] = [Counter()]
    out: list[Block] = []
    tags: list[int] = []
    text: list[str] = []
    linked = size = number = 0
    in_link = False

    def flush() -> None:
        nonlocal linked, size
        if size:
            top = stack[-1]
            if not top.silent and (joined := _SPACES.sub(" ", "".join(text)).strip(" ")):
                around = stack[-2].number if top.name in TEXT_ITEMS else top.number
                out.append(Block(top.path, joined, top.root, top.aside, top.marked, linked / size, around, len(tags)))
            text.clear()
            linked = size = 0

    def add(piece: str) -> None:
        nonlocal linked, size
        text.append(piece)
        size += len(piece)
        linked += len(piece) if in_link else 0

    def pop() -> None:
        gone = stack.pop().name
        open_[gone] -= 1
        if gone in SCOPES:
            scopes.pop()
        scopes[-1][gone] -= 1

    muted: list[str] = []  # open inline elements whose content is no text, and the blocks inside them
    inside: Counter[str] = Counter()
    for kind, name, rest in pieces(page):
        if kind == "text":
            if not muted:
                add(_html.unescape(rest) if "&" in rest else rest)
            continue
        if name in SILENT and name != "head":
            if name in RAW or rest.endswith("/"):
                continue
            if kind == "open":
                muted.append(name)
                inside[name] += 1
            elif inside[name]:
                while (gone := muted.pop()) != name:
                    inside[gone] -= 1
                inside[name] -= 1
            continue
        if muted:
            if name not in BLOCKS or name in VOID:
                continue
            if kind == "open":
                muted.append(name)
                inside[name] += 1
                continue
            if inside[name]:
                while (gone := muted.pop()) != name:
                    inside[gone] -= 1
                inside[name] -= 1
                continue
            muted.clear()  # what is around has ended
            inside.clear()
        if name == "a":
            in_link = kind == "open"
            continue
        if name == "br":
            add(" ")
            continue
        if name not in BLOCKS:
            continue
        flush()
        if kind == "close":
            if open_[name]:
                while stack[-1].name != name:
                    pop()
                pop()
            continue
        if name in VOID:
            continue
        if stack[-1].name == "p":
            pop()
        if stack[-1].name == "head":
            pop()
        ends = IMPLIED_END.get(name, ())
        if any(scopes[-1][e] > 0 for e in ends):
            while stack[-1].name not in ends:
                pop()
            pop()
        top = stack[-1]
        names, own, role = _attributes(rest) if "=" in rest else ((), "", "")
        path = _path(top.path, f"{name}.{' '.join(names)}" if names else name)
        root, aside, marked = top.root, top.aside, top.marked
        declares = "article" if name == "article" else "main" if name == "main" or role == "main" else ""
        if declares and not aside:
            # Words around it may make it an aside; inside it only its own asides count.
            root, marked = Root(declares, root, marked if root is None else root.marked | marked), 0
        elif name not in ("html", "body") and not declares:
            outer = name in ("header", "footer") or role in ("banner", "contentinfo")
            aside = aside or (name == "footer" if outer and root else name in ASIDE or role in ROLES)
            if name not in PHRASES or root is None:
                names = [*names, own] if own else names
            words = any(map(marks_aside, names)) if root is None else not INNER_MARKS.isdisjoint(names)
            marked |= BY_WORD * words | BY_FORM * (name in ("form", "dialog"))
        number += 1
        stack.append(Frame(name, path, aside, marked, root, top.silent or name == "head", number))
        open_[name] += 1
        if name in SCOPES:
            scopes[-1][name] += 1
            scopes.append(Counter())
        else:
            scopes[-1][name] += 1
        tags.append(path)
    flush()
    return out, tags


#: Elements that stand for one line or item of the element around them.
TEXT_ITEMS = PHRASES | frozenset("li dt dd td th option caption figcaption summary legend".split())


def chosen(blocks: list[Block]) -> tuple[list[Block], bool]:
    """The blocks that may be the article, and whether the page declares it."""
    for words in (True, False):  # words count unless they leave nothing
        held = [b for b in blocks if b.root is not None and not b.aside and not b.marked and not (words and b.root.marked)]
        if held:
            return _declared(held), True
    for marks in (BY_WORD | BY_FORM, BY_WORD):  # a form around all text is none
        held = [b for b in blocks if b.root is None and not b.aside and not b.marked & marks]
        if held:
            return held, False
    return [], False


def _declared(held: list[Block]) -> list[Block]:
    mains = [b for b in held if b.root.in_main]
    held = mains or held
    sizes: Counter[Root] = Counter()
    for b in held:
        if (own := b.root.article) is not None:
            sizes[own] += len(b.text)
    if len(sizes) < 2:
        return held
    most, size = sizes.most_common(1)[0]
    return [b for b in held if b.root.article in (None, most)] if 2 * size > sum(sizes.values()) else held


def main_text(page: str, template: frozenset[int] = frozenset()) -> tuple[str, int]:
    """The article's text, and how many of the page's tokens belong to its host's ``template``."""
    blocks, tags = blocks_of(page)
    roles = _roles(blocks, tags)
    found = len(template.intersection(token for token, _ in roles))
    taken, declared = chosen(blocks)
    may = set(map(id, taken))
    around: dict[int, list[float]] = {}
    slots: dict[int, list[float]] = {}
    held: list[tuple[int, Block]] = []
    slot = 0
    for token, block in roles:
        if token in template:
            slot = token
        elif block is not None and id(block) in may:
            held.append((slot, block))
            for sizes in (slots.setdefault(slot, [0, 0]), around.setdefault(block.around, [0, 0])):
                sizes[0] += len(block.text)
                sizes[1] += len(block.text) * block.links
    mostly_text = lambda sizes: sizes[1] <= LINK_SHARE * sizes[0]
    free = lambda b: declared and b.root.article is not None  # noqa: E731  an article's links are its own
    kept = [b.text for at, b in held if b.links <= LINK_SHARE or free(b) or mostly_text(around[b.around]) or found and mostly_text(slots[at])]
    return "\n".join(kept), found


def _roles(blocks: list[Block], tags: list[int]) -> list[tuple[int, Block | None]]:
    """The page's tokens in order, with the block where one is text."""
    out: list[tuple[int, Block | None]] = []
    seen: Counter[tuple[int, str]] = Counter()
    at = 0
    for b in blocks:
        out += [(t, None) for t in tags[at : b.at]]
        at = b.at
        again = seen[b.path, b.text]
        seen[b.path, b.text] += 1
        out.append((_hash(b.path, f"{b.text}\0{again}"), b))
    return out + [(t, None) for t in tags[at:]]


TOKENS = "host bigint, page bigint, prose int, token bigint, n int, is_prose boolean, is_article boolean, places array<int>"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each token of each page with its places; prose is the number of the page's text blocks that may be taken."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()))
    for batch in batches:
        columns: list[list] = [[] for _ in kinds]
        for host, page, text in zip(*(c.to_pylist() for c in batch.columns)):
            blocks, tags = blocks_of(text)
            taken, declared = chosen(blocks)
            may = set(map(id, taken))
            seen: dict[int, tuple[list[int], bool, bool]] = {}
            for place, (token, b) in enumerate(_roles(blocks, tags)):
                prose = b is not None and id(b) in may
                seen.setdefault(token, ([], prose, prose and declared))[0].append(place)
            total = sum(p for _, p, _ in seen.values())
            for token, (places, prose, article) in seen.items():
                for column, value in zip(columns, (host, page, total, token, len(places), prose, article, places)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in TOKENS.split(", ")])


def _flat(members: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """Of lists of members with places: each place, the member it is of, the row that is of, and named columns of the members."""
    rows = np.repeat(np.arange(len(members)), members.value_lengths().to_numpy())
    inner = members.flatten()
    columns = [inner.field(name) for name in ("places", *names)]
    places = columns[0]
    member = np.repeat(np.arange(len(inner)), places.value_lengths().to_numpy())
    return (places.flatten().to_numpy().astype(np.int64), member, rows, *(c.to_numpy(zero_copy_only=False) for c in columns[1:]))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where neighbours differ in a key, and 0."""
    fresh = np.zeros(len(keys[0]), bool)
    fresh[:1] = True
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(fresh)


def sequences(members: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, class, tokens of it, hash of their order, whether they follow each other in one order over and over) for each class of each row."""
    place, member, row, name, token = _flat(members, "class", "token")
    order = np.lexsort((place, name[member], row[member]))
    member = member[order]
    row, name, token = row[member], name[member], token[member]
    starts = _runs(row, name)
    sizes = np.diff(np.append(starts, len(row)))
    # A token is one member of its class, so the members of a run are its different tokens.
    by_member = np.sort(np.repeat(np.arange(len(starts)), sizes) * (len(members.flatten()) + 1) + member)
    width = np.bincount(by_member[_runs(by_member)] // (len(members.flatten()) + 1), minlength=len(starts)) if len(starts) else np.zeros(0, int)
    group = np.repeat(np.arange(len(starts)), sizes)
    within = np.arange(len(row)) - starts[group] if len(row) else np.zeros(0, int)
    same = token == token[starts[group] + within % width[group]] if len(row) else np.zeros(0, bool)
    good = np.bitwise_and.reduceat(same, starts) & (sizes % width == 0) if len(starts) else np.zeros(0, bool)
    first = within < width[group] if len(row) else np.zeros(0, bool)
    parts = np.where(first, mixed(token.view(np.uint64) ^ mixed(within.astype(np.uint64) + np.uint64(1))), np.uint64(0)) if len(row) else np.zeros(0, np.uint64)
    hashes = np.add.reduceat(parts, starts).view(np.int64) if len(starts) else np.zeros(0, np.int64)
    return row[starts], name[starts], width, hashes, good


ORDERS = "host bigint, class bigint, `order` bigint, differs int"


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The order of each class in each page, and whether the page has as much prose of its own as shared."""
    for batch in batches:
        row, name, _, order, good = sequences(batch.column(2))
        _, _, owner, prose = _flat(batch.column(2), "is_prose")
        shared = np.bincount(owner, prose.astype(float), batch.num_rows)
        differs = (batch.column(1).to_numpy() >= 2 * shared).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row]), pa.array(name), pa.array(order, mask=~good), pa.array(differs[row])], ["host", "class", "order", "differs"])


def nesting(items: list[int], width: dict[int, int], rank: dict[int, tuple]) -> list[tuple[int, int, int]]:
    """(class, class around it or 0, gap in that) of the classes of a page; gap -1 of one that crosses a class in more pages.

    ``items`` are the classes of the page's template tokens in order, ``width`` the tokens of each class.
    """
    dropped: set[int] = set()
    while True:
        stack: list[list[int]] = []  # class, tokens met
        open_: set[int] = set()
        found: set[tuple[int, int, int]] = set()
        crossed = False
        for name in items:
            if name in dropped:
                continue
            if name in open_:
                while stack[-1][0] != name:
                    if (other := min(stack[-1][0], name, key=rank.__getitem__)) == name:
                        break
                    dropped.add(other)
                    open_.discard(stack.pop()[0])
                    crossed = True
                if stack[-1][0] != name:
                    dropped.add(name)
                    stack = [s for s in stack if s[0] != name]
                    open_.discard(name)
                    crossed = True
                    continue
                stack[-1][1] += 1
            else:
                found.add((name, *(stack[-1] if stack else (0, 0))))
                if width[name] == 1:
                    continue
                stack.append([name, 1])
                open_.add(name)
            if stack[-1][1] == width[name]:
                open_.discard(stack.pop()[0])
        if not crossed:
            return [*found, *((name, 0, -1) for name in dropped)]


NESTS = "host bigint, class bigint, around bigint, gap int"


def _nests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members = batch.column(1)
        row, name, width, _, _ = sequences(members)
        place, member, owner, of, support = _flat(members, "class", "support")
        order = np.lexsort((place, owner[member]))
        of, support, owner = of[member[order]], support[member[order]], owner[member[order]]
        ends, bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1)), np.searchsorted(row, np.arange(batch.num_rows + 1))
        out: list[tuple] = []
        for k, host in enumerate(batch.column(0).to_pylist()):
            widths = dict(zip(name[bounds[k] : bounds[k + 1]].tolist(), width[bounds[k] : bounds[k + 1]].tolist()))
            items = of[ends[k] : ends[k + 1]].tolist()
            rank = {c: (n, widths[c], c) for c, n in zip(items, support[ends[k] : ends[k + 1]].tolist())}
            out += ((host, *x) for x in nesting(items, widths, rank))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["host", "class", "around", "gap"])


def _extract(shared):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value))
        for batch in batches:
            got = [main_text(unpack.decompress(page).decode(), frozenset(t or ())) for page, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            columns = [pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "text", "n_chars", "n_template"])

    return extract


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def packing(keyed: DataFrame) -> bytes:
    """A dictionary for packing pages, from a bounded sample; none if there is too little to learn from."""
    pages = keyed.where(F.length("html") <= PACK_CHARS).select("page", "html")
    most = pages.select("page").distinct().orderBy("page").limit(PACK_PAGES).agg(F.max("page")).first()[0]
    some = [] if most is None else [r["html"].encode() for r in pages.where(F.col("page") <= F.lit(most)).groupBy("page").agg(F.min("html").alias("html")).orderBy("page").collect()]
    try:
        return zstandard.train_dictionary(PACK_BYTES, some).as_bytes() if len(some) > 100 else b""
    except zstandard.ZstdError:
        return b""


def _pack(shared):
    def pack(texts: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=6, dict_data=_dictionary(shared.value))
        return pa.array([packer.compress(t.as_buffer()) for t in texts], pa.binary())

    return pack


def _keyed(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.xxhash64(host).alias("host"), F.xxhash64(html).alias("page"))


def templates(pages: DataFrame) -> DataFrame:
    """host, page, template: the page's tokens that are of its host's valid classes and count in it.

    They are told page by page, so that what pages are joined by is as fine as the pages.
    Tokens, classes and hosts that hold a large share of all rows are joined by broadcast
    (``join_counted``), so that no task gets the rows of a large host's menu.

    A copy of a page adds the same to the vector of each of its tokens, so it changes
    no class; support counts different pages, so it lends none.
    """
    keyed = _keyed(pages)
    per_host = staged(keyed.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).withColumn("n", F.col("pages")), "hosts")
    tokens = staged(keyed.select("host", "page", "html").mapInArrow(_tokens, TOKENS), "tokens", "zstd")
    # The sum is taken of 62-bit numbers in decimals, so that it cannot overflow.
    vector = tokens.groupBy("host", "token").agg(F.count("*").alias("held"), F.sum(F.shiftright(F.xxhash64("page", "n"), 2).cast("decimal(20,0)")).alias("vector"))
    classes = staged(vector.where(F.col("held") >= MIN_PAGES).select("host", "token", "held", F.xxhash64("vector").alias("class")), "classes")
    # Copies of a page have the same members: a set has them once.
    held = join_counted(tokens, classes, ["host", "token"], "held", drop=("held",))
    members = held.groupBy("host", "page").agg(F.first("prose").alias("prose"), F.collect_set(F.struct("class", "token", "is_prose", "is_article", "places")).alias("members"))
    members = staged(members, "members", "zstd")
    orders = members.select("host", "prose", "members").mapInArrow(_orders, ORDERS)
    held = orders.groupBy("host", "class").agg(F.count("*").alias("support"), F.count("order").alias("ordered"), F.min("order").alias("a"), F.max("order").alias("b"), F.sum("differs").alias("differing"))
    common, differing = 2 * F.col("support") >= F.col("pages"), F.col("differing") >= MIN_PAGES
    valid = join_counted(held.where((F.col("support") >= MIN_PAGES) & (F.col("ordered") == F.col("support")) & (F.col("a") == F.col("b"))), per_host, ["host"], drop=("n",))
    valid = staged(valid.where(common | differing).select("host", "class", "support", (common & differing).alias("strong")), "valid")
    own = members.select("host", "page", F.explode("members").alias("m")).select("host", "page", "m.class", "m.token", "m.is_article", "m.places")
    nests = join_counted(own, valid.drop("strong"), ["host", "class"], "support").groupBy("host", "page").agg(F.collect_list(F.struct("class", "token", "places", "support")).alias("members")).select("host", "members").mapInArrow(_nests, NESTS)
    gaps = nests.groupBy("host", "class", "around").agg(F.min("gap").alias("a"), F.max("gap").alias("b"))
    stray = gaps.where("a <> b OR a < 0").select("host", "class").distinct()
    nested = staged(valid.join(stray, ["host", "class"], "left_anti"), "nested")
    kept = join_counted(own.drop("places"), nested, ["host", "class"], "support", drop=("support",)).where(~F.col("is_article") | F.col("strong"))
    return kept.groupBy("host", "page").agg(F.collect_set("token").alias("template"))


def extract_main(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_template (template tokens found in the page) for each row of pages.

    Pages travel compressed to meet their template tokens; a page of many copies is
    one key there, whose rows adaptive execution splits.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    keyed = _keyed(pages)
    shared = spark.sparkContext.broadcast(packing(keyed))
    rows = keyed.select("page_id", "url", "host", "page", F.arrow_udf(_pack(shared), "binary")("html").alias("packed"))
    rows = rows.join(templates(pages).hint("merge"), ["host", "page"], "left").select("page_id", "url", "packed", "template")
    return rows.mapInArrow(_extract(shared), "page_id bigint, url string, text string, n_chars bigint, n_template bigint")
