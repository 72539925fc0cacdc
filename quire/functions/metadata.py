"""Bibliographic sort keys and normalisers, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading articles by language; a blank or an apostrophe ends them (fixed values).
ARTICLES = {
    "eng": "A |The |An ",
    "epo": "La |L'|L´",
    "spa": "El |La |Lo |Los |Las |Un |Una |Unos |Unas ",
    "fra": "Le |La |L'|L´|L’|Les |Un |Une |Des |De (?:La )?|D'|D´|D’",
    "ita": "Lo |Il |L'|L´|La |Gli |I |Le |Uno |Un |Una |Un'|Un´|Dei |Degli |Delle |Del |Della |Dello |Dell'|Dell´",
    "por": "A |O |Os |As |Um |Uns |Uma |Umas ",
    "ron": "Un |O |Nişte ",
    "deu": "Der |Die |Das |Den |Ein |Eine |Einen |Dem |Des |Einem |Eines ",
    "nld": "De |Het |Een |'n |'s |Ene |Ener |Enes |Den |Der |Des |'t ",
    "swe": "En |Ett |Det |Den |De ",
    "tur": "Bir ",
    "afr": "'n |Die ",
    "ell": "O |I |To |Ta |Tus |Tis |'Enas |'Mia |'Ena |'Enan ",
    "hun": "A |Az |Egy ",
}
#: Two-letter names of those languages (fixed values); Polish has no articles.
ALIASES = {"en": "eng", "eo": "epo", "es": "spa", "fr": "fra", "pl": "pol", "it": "ita", "pt": "por", "ro": "ron", "de": "deu", "nl": "nld", "sv": "swe", "tr": "tur", "af": "afr", "el": "ell", "hu": "hun"}
#: Opening quotes with the closings that match them (fixed values).
QUOTES = {'"': '"', "'": "'", "“": "”“", "”": "”“", "„": "”“", "‚": "’‘", "’": "’‘", "‘": "’‘", "‹": "›", "›": "‹", "《": "》", "〈": "〉", "»": "«»", "«": "«»", "「": "」", "『": "』"}
#: Words that mark a corporate author, and name prefixes and suffixes (fixed values).
COPY_WORDS = "agency corporation company co. council committee inc. institute national society club team software games entertainment media studios".split()
NAME_PREFIXES = "mr mrs ms dr prof".split()
NAME_SUFFIXES = "jr sr inc ph.d phd md m.d i ii iii iv junior senior".split()
#: Right-to-left languages and their aliases (fixed values).
RTL = "ar arc dv fa he ku ps sd ug ur yi ara heb fas per urd yid iw ji".split()


def let(value: Column, body) -> Column:
    """body(value), with the value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def language_key(language: Column) -> Column:
    """Three-letter key of a language tag; unknown and missing ones are English."""
    known = {**{k: k for k in [*ARTICLES, "pol"]}, **ALIASES}
    short = lambda low: F.try_element_at(_map(ALIASES), F.left(low, F.lit(2)))
    return let(F.lower(F.coalesce(language, F.lit(""))), lambda low: F.coalesce(F.try_element_at(_map(known), low), short(low), F.lit("eng")))


def strip_quote(title: Column) -> Column:
    """Drop an opening quote, and a closing one only if it matches."""
    def bare(t: Column) -> Column:
        closings = F.try_element_at(_map(QUOTES), F.left(t, F.lit(1)))
        closed = (F.length(t) > 1) & F.contains(closings, F.right(t, F.lit(1)))
        return F.when(closings.isNull(), t).otherwise(F.substr(t, F.lit(2), F.length(t) - F.when(closed, 2).otherwise(1)))

    return let(title, bare)


def title_sort(title: Column, language: Column) -> Column:
    """The title with its leading article moved to the end."""
    patterns = {name: "(?iu)^(" + articles.replace(" ", r"\s+") + ")" for name, articles in ARTICLES.items()} | {"pol": "^()"}
    pattern = F.element_at(_map(patterns), language_key(language))
    moved = lambda bare, head: F.when(head == "", bare).otherwise(strip_quote(F.concat(F.substr(bare, F.length(head) + 1), F.lit(", "), head)))
    return let(strip_quote(F.trim(title)), lambda bare: F.trim(let(F.call_function("regexp_extract", bare, pattern, F.lit(1)), lambda head: moved(bare, head))))


def remove_brackets(text: Column) -> Column:
    """Text outside of (), [] and {}, counted by kind; closers alone are dropped, an open one takes the rest."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("r"), F.lit(0).alias("s"), F.lit(0).alias("c"))

    def step(a: Column, x: Column) -> Column:
        def count(old: Column, opening: str, closing: str) -> Column:
            return F.when(x == opening, old + 1).when((x == closing) & (old > 0), old - 1).otherwise(old)

        kept = (a["r"] + a["s"] + a["c"] == 0) & ~x.isin(*"()[]{}")
        return F.struct(
            F.when(kept, F.concat(a["out"], x)).otherwise(a["out"]).alias("out"), count(a["r"], "(", ")").alias("r"), count(a["s"], "[", "]").alias("s"), count(a["c"], "{", "}").alias("c")
        )

    return F.when(~text.rlike(r"[()\[\]{}]"), text).otherwise(F.aggregate(F.split(text, ""), state, step, lambda a: a["out"]))


def _turned(author: Column, bare: Column, tokens: Column, words: tuple[list[str], list[str], list[str]]) -> Column:
    copy_words, prefixes, suffixes = words
    dotted = lambda words: [*words, *(f"{w}." for w in words)]
    lower = F.transform(tokens, lambda t: F.lower(t))

    def order(places: Column) -> Column:
        first = F.array_min(F.filter(places, lambda k: ~F.lower(F.get(tokens, k)).isin(*dotted(prefixes))))
        last = F.array_max(F.filter(places, lambda k: ~F.lower(F.get(tokens, k)).isin(*dotted(suffixes))))
        return F.struct(first.alias("first"), last.alias("last"))

    def name(p: Column) -> Column:
        surname, given = F.get(tokens, p["last"]), F.array_join(F.slice(tokens, p["first"] + 1, F.greatest(p["last"] - p["first"], F.lit(0))), " ")
        rest = F.array_join(F.slice(tokens, p["last"] + 2, F.size(tokens)), " ")
        joined = F.concat(F.when(given != "", F.concat(surname, F.lit(", "), given)).otherwise(surname), F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise(F.lit("")))
        return F.when(p["last"] >= p["first"], joined).otherwise(author)

    stays = bare.contains(",") | (F.size(tokens) < 2) | F.arrays_overlap(lower, F.array(*map(F.lit, copy_words)))
    places = F.sequence(F.lit(0), F.size(tokens) - 1)
    return F.when(stays, author).otherwise(F.coalesce(let(order(places), name), author))


def author_sort(author: Column, copy_words: list[str] = COPY_WORDS, prefixes: list[str] = NAME_PREFIXES, suffixes: list[str] = NAME_SUFFIXES) -> Column:
    """``Last, First``; names with a comma, of one word or of a corporation stay. The three lists of words can be given."""
    sets = (copy_words, prefixes, suffixes)
    words = lambda bare: F.filter(F.split(bare, r"\s+"), lambda t: t != "")
    return let(F.coalesce(author, F.lit("")), lambda a: let(F.trim(remove_brackets(a)), lambda bare: let(words(bare), lambda tokens: _turned(a, bare, tokens, sets))))


def authors_sort(authors: Column) -> Column:
    return F.array_join(F.transform(authors, lambda a: author_sort(a)), " & ")


def effective_title_sort(title: Column, stored: Column, languages: Column) -> Column:
    """The stored key, else one of the title by the first language; null without a title."""
    return F.coalesce(F.nullif(stored, F.lit("")), F.when(F.nullif(title, F.lit("")).isNotNull(), title_sort(title, F.try_element_at(languages, F.lit(1)))))


def effective_author_sort(authors: Column, stored: Column) -> Column:
    """The stored key, else one of all authors; null without any."""
    return F.coalesce(F.nullif(stored, F.lit("")), F.when(F.size(F.coalesce(authors, F.array())) > 0, authors_sort(authors)))


def effective_layout(item_properties: Column, package_layout: Column) -> Column:
    """How a spine item is laid out: by its own override, else as the package says, else reflowable."""
    own = F.filter(F.coalesce(item_properties, F.array().cast("array<string>")), lambda p: p.isin("rendition:layout-reflowable", "rendition:layout-pre-paginated"))
    known = F.when(package_layout.isin("reflowable", "pre-paginated"), package_layout)
    return F.coalesce(F.regexp_replace(F.get(own, 0), "^rendition:layout-", ""), known, F.lit("reflowable"))


def natural_key(name: Column) -> Column:
    """A key that orders digit runs by value and everything else by code point."""
    runs = F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0))
    pad = lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 20, "0")).otherwise(x)
    return F.array_join(F.transform(runs, pad), "")


def is_rtl(language: Column) -> Column:
    return F.split(F.replace(F.lower(F.coalesce(language, F.lit(""))), F.lit("_"), F.lit("-")), "-")[0].isin(*RTL)


def series_index(raw: Column) -> Column:
    """A number; a comma may be its decimal point."""
    return F.replace(F.trim(raw), F.lit(","), F.lit(".")).try_cast("double")


def isbn(value: Column) -> Column:
    """Ten or thirteen characters without urn and hyphens; anything else stays as it is."""
    bare = F.upper(F.regexp_replace(F.regexp_replace(F.trim(value), "(?i)^(urn:)?isbn:?\\s*", ""), "[-\\s]", ""))
    return F.when(bare.rlike("^([0-9]{9}[0-9X]|[0-9]{13})$"), bare).otherwise(F.trim(value))


def split_authors(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, r"(?i)\s*;\s*|\s*\|\s*|\s+\band\b\s+"), lambda x: F.trim(x)), lambda x: x != "")


def partial_date(value: Column) -> Column:
    """yyyy, yyyy-mm or yyyy-mm-dd at the start of a value, as a date; null if there is no such day."""
    part = lambda k, default: F.when(F.regexp_extract(value, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", k) != "", F.regexp_extract(value, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", k)).otherwise(F.lit(default))
    text = F.concat_ws("-", part(1, "x"), F.lpad(part(2, "1"), 2, "0"), F.lpad(part(3, "1"), 2, "0"))
    return text.try_cast("date")


def clock_ms(value: Column) -> Column:
    """Milliseconds of a SMIL clock: h:mm:ss.fff, mm:ss, or a number with ms, s, min or h; null otherwise."""
    v = F.trim(value)
    number = lambda pattern, k: F.regexp_extract(v, pattern, k).try_cast("double")
    full, part, unit = r"^(\d+):([0-5]\d):([0-5]\d(?:\.\d+)?)$", r"^([0-5]?\d):([0-5]\d(?:\.\d+)?)$", r"^(\d+(?:\.\d+)?)(ms|s|min|h)?$"
    scale = F.when(v.endswith("ms"), 1).when(v.endswith("min"), 60_000).when(v.endswith("h"), 3_600_000).otherwise(1000)
    ms = F.when(v.rlike(full), (number(full, 1) * 3600 + number(full, 2) * 60 + number(full, 3)) * 1000).when(v.rlike(part), (number(part, 1) * 60 + number(part, 2)) * 1000).when(v.rlike(unit), number(unit, 1) * scale)
    return F.round(ms).cast("long")


def normalize_path(path: Column) -> Column:
    """Slashes forward, ``.`` and ``..`` resolved, none leading."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    step = lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolve_path(base: Column, href: Column) -> Column:
    """href against the folder of base."""
    return normalize_path(F.when(href.startswith("/"), href).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), href)))


def percent_decoded(text: Column) -> Column:
    """Decoded, or as it is where it does not decode; a plus stays a plus."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def localized(plain: Column, values: Column, language: Column) -> Column:
    """A plain text, else the value for the tag, for its base language, or the first one."""
    base = lambda c: F.split(F.lower(c), "-")[0]
    same = F.filter(F.map_entries(values), lambda e: base(e["key"]) == base(language))
    return F.coalesce(plain, F.try_element_at(values, language), F.get(same, 0)["value"], F.get(F.map_values(values), 0))


def merge_metadata(base: Column, overlay: Column, kinds: dict[str, str]) -> Column:
    """struct of the named fields: what the overlay has wins, lists as a whole, maps key by key."""
    def one(name: str, kind: str) -> Column:
        b, o = base[name], overlay[name]
        if kind == "list":
            return F.when(F.size(F.coalesce(o, F.array())) > 0, o).otherwise(b)
        if kind == "map":
            keep = F.map_filter(F.coalesce(b, o), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce(o, b)), k) | o.isNull())
            return F.when(b.isNull(), o).when(o.isNull(), b).otherwise(F.map_concat(keep, o))
        return F.coalesce(F.nullif(o, F.lit("")), b) if kind == "text" else F.coalesce(o, b)

    return F.struct(*[one(n, k).alias(n) for n, k in kinds.items()])
