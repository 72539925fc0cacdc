"""OPDS 2 publications: JSON checked against limits before it is decoded, then mapped; what is wrong says where, as a JSON pointer."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.shipping import arrow_udf

ACQUISITION = "http://opds-spec.org/acquisition"


@dataclass(frozen=True)
class Limits:
    max_bytes: int = 16 << 20
    max_depth: int = 64
    max_values: int = 250_000
    max_string: int = 1 << 20


class Invalid(ValueError):
    def __init__(self, message: str, pointer: str = ""):
        super().__init__(message)
        self.pointer = pointer


_LEXEME = re.compile(r'"((?:[^"\\]++|\\.)*+)"?|([\[{])|([\]}])|[^\s,:"\[\]{}]++', re.S)


def preflight(text: str, limits: Limits = Limits()) -> str | None:
    """What limit the source breaks, before any of it is decoded; None if none. Syntax is not checked."""
    if len(text.encode("utf-8", "surrogatepass")) > limits.max_bytes:
        return f"more than {limits.max_bytes} bytes"
    depth = values = 0
    for m in _LEXEME.finditer(text):
        if m[3]:
            depth = max(0, depth - 1)
            continue
        values += 1
        if values > limits.max_values:
            return f"more than {limits.max_values} values"
        if depth + 1 > limits.max_depth:
            return f"deeper than {limits.max_depth}"
        if m[2]:
            depth += 1
        elif m[1] is not None and len(m[1]) > limits.max_string and len(re.sub(r"\\(?:u[0-9a-fA-F]{4}|.)", ".", m[1], flags=re.S)) > limits.max_string:
            return f"a string longer than {limits.max_string}"
    return None


_RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):(\d\d)(?:\.\d+)?(?:[Zz]|[+-](\d\d):(\d\d))")


def rfc3339(value, pointer: str) -> str:
    """The value if it is a date-time of RFC 3339."""
    m = _RFC3339.fullmatch(value) if isinstance(value, str) else None
    if m is None or int(m[4]) > 23 or int(m[5]) > 59 or int(m[6]) > 59 or int(m[7] or 0) > 23 or int(m[8] or 0) > 59:
        raise Invalid("no RFC 3339 date-time", pointer)
    try:
        date(*map(int, m.group(1, 2, 3)))
    except ValueError:
        raise Invalid("no RFC 3339 date-time", pointer) from None
    return value


def _texts(value, pointer: str) -> list[str]:
    """Names in a string, an object with a name (plain or by language), or a list of these."""
    if value is None:
        return []
    if isinstance(value, list):
        return [x for k, v in enumerate(value) for x in _texts(v, f"{pointer}/{k}")]
    if isinstance(value, dict):
        named = value.get("name", value)
        if isinstance(named, dict):
            named = next((x for x in named.values() if isinstance(x, str)), None)
        value = named
    if not isinstance(value, str):
        raise Invalid("a string is wanted", pointer)
    return [value]


def _link(value, pointer: str) -> dict:
    if not isinstance(value, dict):
        raise Invalid("an object is wanted", pointer)
    if not isinstance(value.get("href"), str):
        raise Invalid("a string is wanted", f"{pointer}/href")
    rel = value.get("rel", [])
    rels = [rel] if isinstance(rel, str) else rel
    if not isinstance(rels, list) or not all(isinstance(r, str) for r in rels):
        raise Invalid("a relation is a string or a list of strings", f"{pointer}/rel")
    return {"href": value["href"], "type": value.get("type") if isinstance(value.get("type"), str) else None, "rels": rels}


def publication(text: str, limits: Limits = Limits()) -> dict:
    """title, authors, languages, identifier, modified, links; at least one link must be an acquisition."""
    if said := preflight(text, limits):
        raise Invalid(said)
    try:
        whole = json.loads(text)
    except ValueError as e:
        raise Invalid(f"no JSON: {e}") from None
    if not isinstance(whole, dict):
        raise Invalid("an object is wanted")
    meta = whole.get("metadata")
    if not isinstance(meta, dict):
        raise Invalid("an object is wanted", "/metadata")
    titles = _texts(meta.get("title"), "/metadata/title")
    if not titles:
        raise Invalid("a title is wanted", "/metadata/title")
    links = whole.get("links", [])
    if not isinstance(links, list):
        raise Invalid("a list is wanted", "/links")
    links = [_link(x, f"/links/{k}") for k, x in enumerate(links)]
    if not any(r.startswith(ACQUISITION) for x in links for r in x["rels"]):
        raise Invalid("an acquisition link is wanted", "/links")
    modified = meta.get("modified")
    return {
        "title": titles[0], "authors": _texts(meta.get("author"), "/metadata/author"), "languages": _texts(meta.get("language"), "/metadata/language"),
        "identifier": meta.get("identifier") if isinstance(meta.get("identifier"), str) else None, "modified": None if modified is None else rfc3339(modified, "/metadata/modified"), "links": links,
    }


PUBLICATION = "struct<title: string, authors: array<string>, languages: array<string>, identifier: string, modified: string, links: array<struct<href: string, type: string, rels: array<string>>>, error: string, pointer: string>"


def publications(source: Column) -> Column:
    """``publication`` as a struct column; what is refused has error and pointer."""
    link = pa.struct([("href", pa.string()), ("type", pa.string()), ("rels", pa.list_(pa.string()))])
    kind = pa.struct([("title", pa.string()), ("authors", pa.list_(pa.string())), ("languages", pa.list_(pa.string())), ("identifier", pa.string()), ("modified", pa.string()), ("links", pa.list_(link)), ("error", pa.string()), ("pointer", pa.string())])

    def run(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            try:
                out.append(None if v is None else publication(v))
            except Invalid as e:
                out.append({"error": str(e), "pointer": e.pointer})
        return pa.array(out, kind)

    return arrow_udf(run, PUBLICATION)(source)


def rfc3339_time(value: Column) -> Column:
    """The instant of an RFC 3339 date-time, in the JVM; null for anything else."""
    good = value.rlike(r"^\d{4}-\d{2}-\d{2}[Tt]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$")
    plain = F.upper(value)
    local = F.regexp_extract(plain, r"^([^T]*)T([^Z+-]*)", 0).try_cast("timestamp_ntz")
    sign = F.when(F.substring(plain, -6, 1) == "-", -1).otherwise(1)
    offset = F.when(plain.endswith("Z"), 0).otherwise(sign * (F.substring(plain, -5, 2).try_cast("int") * 60 + F.right(plain, F.lit(2)).try_cast("int")))
    return F.when(good, F.convert_timezone(F.lit("UTC"), F.current_timezone(), local - F.make_dt_interval(mins=offset)).cast("timestamp"))
