"""SQL names for what is not a built-in expression: ``register(spark)`` makes them callable from ``spark.sql``."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.operators import index, search
from quire.sources import archive, books

from . import locators, text
from quire.shipping import arrow_udf


def _plain_text(html: pa.Array) -> pa.Array:
    return pa.array([None if v is None else text.plain_text_of(v) for v in html.to_pylist()], pa.string())


def _document_text(html: pa.Array) -> pa.Array:
    return pa.array([None if v is None else text.document_text_of(v) for v in html.to_pylist()], pa.string())


def _index_terms(column: pa.Array) -> pa.Array:
    return pa.array([[t for t, _, _ in index.tokenize_text(v or "")] for v in column.to_pylist()], pa.list_(pa.string()))


def _find_spans(texts: pa.Array, queries: pa.Array, modes: pa.Array) -> pa.Array:
    known: dict[tuple, search.Query] = {}
    out = []
    for t, q, m in zip(texts.to_pylist(), queries.to_pylist(), modes.to_pylist()):
        if (q, m) not in known:
            known[q, m] = search.Query(q or "", m or "contains")
        out.append([{"start": a, "end": b} for a, b in known[q, m].spans(t)] if t and not known[q, m].empty else [])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def _cfi_normalized(values: pa.Array) -> pa.Array:
    return pa.array([str(c) if (c := locators.try_cfi(v)) else None for v in values.to_pylist()], pa.string())


def _decode_text(contents: pa.Array) -> pa.Array:
    return pa.array([None if v is None else books.decode_text(v) for v in contents.to_pylist()], pa.string())


def _html_meta(html: pa.Array) -> pa.Array:
    return pa.array([None if v is None else list(books.html_meta(v).items()) for v in html.to_pylist()], pa.map_(pa.string(), pa.string()))


class ZipEntries:
    """path, size and content of each entry of an archive; one that is refused gives no row."""

    def eval(self, content: bytes):
        try:
            for path, data in archive.entries(bytes(content)).items():
                yield path, len(data), data
        except (archive.Refused, TypeError):
            return


class SqliteTable:
    """Rows of a table of a database file, as JSON."""

    def eval(self, content: bytes, table: str):
        try:
            for row in books.sqlite_rows(bytes(content), table):
                number = row.pop("_rowid")
                yield number, json.dumps(row, default=lambda b: b.hex(), ensure_ascii=False)
        except (archive.Refused, TypeError):
            return


class Occurrences:
    """Every start of a quote in a text, overlapping ones too."""

    def eval(self, content: str, quote: str):
        at = -1
        while content and quote and (at := content.find(quote, at + 1)) >= 0:
            yield (at,)


SCALARS = {
    "plain_text": (_plain_text, "string"), "document_text": (_document_text, "string"), "index_terms": (_index_terms, "array<string>"), "find_spans": (_find_spans, search.SPANS),
    "cfi_normalized": (_cfi_normalized, "string"), "decode_text": (_decode_text, "string"), "html_meta": (_html_meta, "map<string,string>"),
}
TABLES = {"zip_entries": (ZipEntries, "path string, size bigint, content binary"), "sqlite_table": (SqliteTable, "number bigint, row string"), "occurrences": (Occurrences, "start int")}


def register(spark: SparkSession) -> list[str]:
    """Register all scalar and table functions; returns their names."""
    for name, (function, returns) in SCALARS.items():
        spark.udf.register(name, arrow_udf(function, returns))
    for name, (function, returns) in TABLES.items():
        spark.udtf.register(name, F.udtf(function, returnType=returns))
    return [*SCALARS, *TABLES]
