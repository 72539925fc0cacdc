"""Adapters: tables of texts and orders as books, sections, manifests and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sinks import index_store
from quire.sinks.shared import new_path

_STORED: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a book, its turns as sections."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("section_index"), "text")


def sections_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source as a book, its documents as sections."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("section_index"), "text", "lang")


def manifest_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a package, its lines as manifest items."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("item_id"), F.concat(F.lit("p"), F.col("l_partkey"), F.lit(".xhtml")).alias("href"), F.lit("application/xhtml+xml").alias("media_type"))


def entries_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that archives hold: those of parts below 40 in size."""
    return table(spark, sf_dir, "part").where("p_size < 40").select(F.concat(F.lit("p"), F.col("p_partkey"), F.lit(".xhtml")).alias("path"))


def stored_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, stats, terms) of the documents: written once in a session, and again if the table's files have changed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    held, status = files.getContentSummary(path), files.getFileStatus(path)
    key = (spark.sparkContext.applicationId, sf_dir, held.getLength(), held.getFileCount(), status.getModificationTime())
    if key not in _STORED:
        where = new_path(spark, "index")
        index_store.write(where, docs, ["doc_id"])
        _STORED[key] = where
    return index_store.read(spark, _STORED[key])
