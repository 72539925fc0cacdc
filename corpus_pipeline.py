"""Corpus pipeline: quality, line dedup, near duplicates, mixing, tokens.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and
works on all rows it gets.  All but the last return the columns they got, further
ones with clashing names among them, in their order.

Defined results, by stage:

* quality: null and empty texts go; a null doc_id is scored like any other;
  repeated rows are decided alike; very long texts are scored whole.
* line_dedup: a null text comes back as the empty one; a null doc_id is one document
  that precedes all others; repeated rows lose the same lines and all stay; a very
  long text keeps what is its own.
* near_duplicates: of each class the least doc_id stays (a null one first), of
  repeated rows one; texts without words (null, empty) are one class.
* mixing: rows are drawn by a hash of (doc_id, text), so repeated rows are drawn
  alike; rows without words have ratio 1.
* pieces: a row for each row; null and empty texts have no tokens.

An empty table passes all stages and stays empty; ties are settled by each operator
as its module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import drop_stages, own_stages, staged, table
from quire.llm.line_dedup import drop_common_lines
from quire.llm.mixing import drawn
from quire.llm.near_dups import one_of_each
from quire.llm.pieces import encoded
from quire.llm.quality import keep_good

#: The hashes that decide are not SQL's, so no SQL gives these rows; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; a document that loses text gets its new length."""
    return drop_common_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least doc_id."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with probabilities calibrated to the target weights."""
    return drawn(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every document left."""
    return encoded(docs).select("doc_id", "n_chars", "n_tokens", "token_ids")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("pieces", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again, and what it read is dropped."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with own_stages() as used:
            docs = staged(stage(spark, docs, sf_dir), name)
        drop_stages(spark, before + used[:-1])
        before = used[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
