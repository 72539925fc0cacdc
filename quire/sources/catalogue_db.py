"""Library catalogues kept in SQLite: link tables joined to one row for each book."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import catalogue

from .archive import Refused
from .books import sqlite_rows
from quire.shipping import ship

#: Table -> the columns that are read of it (fixed values of the schema).
TABLES = {
    "books": ("id", "title", "sort", "timestamp", "series_index", "author_sort", "isbn", "path"), "authors": ("id", "name"), "series": ("id", "name"), "tags": ("id", "name"),
    "books_authors_link": ("id", "book", "author"), "books_series_link": ("id", "book", "series"), "books_tags_link": ("id", "book", "tag"), "identifiers": ("id", "book", "type", "val"), "data": ("id", "book", "format"),
}
NUMBERS = {"id", "book", "author", "series", "tag"}


def read_tables(files: DataFrame, path: str = "path", content: str = "content") -> dict[str, DataFrame]:
    """Table name -> rows (library, rowid and the table's columns); a table that a file lacks gives none."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for library, data in frame.itertuples(index=False):
                for name, columns in TABLES.items():
                    try:
                        found = sqlite_rows(bytes(data), name)
                    except Refused:
                        continue
                    rows += [(library, name, r["_rowid"], json.dumps({c: r.get(c) for c in columns}, default=str)) for r in found]
            yield pd.DataFrame(rows, columns=["library", "part", "rowid", "row"])

    ship(files.sparkSession)
    flat = files.select(F.col(path).alias("library"), content).mapInPandas(run, "library string, part string, rowid bigint, row string")
    out = {}
    for name, columns in TABLES.items():
        schema = ", ".join(f"{c} {'bigint' if c in NUMBERS else 'double' if c == 'series_index' else 'string'}" for c in columns)
        out[name] = flat.where(F.col("part") == name).select("library", "rowid", F.from_json("row", schema).alias("r")).select("library", "rowid", "r.*")
    return out


def read_catalogue(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """library, book_id, title, authors, tags, series, formats, identifiers and the other fields of each book."""
    t = read_tables(files, path, content)
    key = lambda df, item: F.struct(df["library"], df[item])  # noqa: E731  ids are a library's own

    def names(link: str, item: str, table: str) -> DataFrame:
        links, items = t[link], t[table]
        return catalogue.linked_names(links.select(key(links, "book").alias("k"), key(links, item).alias("item"), "rowid"), items.select(key(items, "id").alias("item"), "name"), "k", "item", "name", "rowid")

    b = t["books"]
    books = b.select(key(b, "id").alias("k"), F.col("id").alias("book_id"), "library", F.coalesce("title", F.lit("")).alias("title"), "sort", "author_sort", F.col("timestamp").try_cast("timestamp").alias("added_at"), "series_index", "isbn", "path")
    data, ids = t["data"], t["identifiers"]
    formats = data.groupBy(key(data, "book").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rowid", "format"))), lambda r: r["format"]).alias("names"))
    values = catalogue.last_values(ids.select(key(ids, "book").alias("k"), "type", "val", "rowid"), "k", "type", "val", "rowid")
    lists = {"authors": names("books_authors_link", "author", "authors"), "tags": names("books_tags_link", "tag", "tags"), "all_series": names("books_series_link", "series", "series"), "formats": formats}
    out = catalogue.assemble(books, "k", lists, {"identifiers": values})
    out = out.withColumn("series", F.try_element_at("all_series", F.lit(-1))).withColumn("identifiers", catalogue.backfilled(F.col("identifiers"), "isbn", F.col("isbn")))
    return out.drop("k", "all_series", "isbn")
