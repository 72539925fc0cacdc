"""Catalogue assembly: books with the names that link tables give them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linked_names(link: DataFrame, names: DataFrame, book: str, item: str, name: str, order: str) -> DataFrame:
    """book, names: the linked names in link order; a null name is an empty one."""
    met = link.join(names.select(item, F.coalesce(name, F.lit("")).alias("_name")), item)
    rows = F.sort_array(F.collect_list(F.struct(F.col(order), F.col("_name"))))
    return met.groupBy(book).agg(F.transform(rows, lambda r: r["_name"]).alias("names"))


def last_values(rows: DataFrame, book: str, key: str, value: str, order: str) -> DataFrame:
    """book, values: a map in which the last row of each key wins."""
    last = rows.groupBy(book, key).agg(F.max_by(value, order).alias("_v"))
    return last.groupBy(book).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), F.col("_v"))))).alias("values"))


def assemble(books: DataFrame, book: str, lists: dict[str, DataFrame], maps: dict[str, DataFrame] | None = None) -> DataFrame:
    """books with one list (or map) column for each side; a book that a side lacks gets an empty one."""
    for name, side in lists.items():
        books = books.join(side.select(book, F.col("names").alias(name)), book, "left")
        books = books.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    for name, side in (maps or {}).items():
        books = books.join(side.select(book, F.col("values").alias(name)), book, "left")
    return books


def backfilled(values: Column, key: str, value: Column) -> Column:
    """The map, with a value for ``key`` only if it has none and the value is not empty."""
    given = F.nullif(value, F.lit("")).isNotNull()
    missing = values.isNull() | ~F.map_contains_key(F.coalesce(values, F.create_map().cast("map<string,string>")), key)
    return F.when(given & missing, F.map_concat(F.coalesce(values, F.create_map().cast("map<string,string>")), F.create_map(F.lit(key), value))).otherwise(values)
