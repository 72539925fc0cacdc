"""Incremental building: each micro-batch adds to tables that batch queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import index


def index_stream(sections: DataFrame, keys: list[str], out: str, checkpoint: str, text: str = "text", limits: index.Limits = index.Limits()) -> StreamingQuery:
    """Index new sections as they come: ``out``/postings and ``out``/stats grow by one folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so no section counts twice.
    """
    def add(batch: DataFrame, number: int) -> None:
        postings, stats = index.build(batch, keys, text, limits)
        postings.write.mode("overwrite").parquet(f"{out}/postings/batch={number}")
        stats.write.mode("overwrite").parquet(f"{out}/stats/batch={number}")

    return sections.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, out: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(postings, stats); a section that came again is taken from its last batch alone."""
    postings, stats = (spark.read.parquet(f"{out}/{part}") for part in ("postings", "stats"))
    last = stats.groupBy(*keys).agg(F.max_by("tokens", "batch").alias("tokens"), F.max("batch").alias("batch"))
    return postings.join(last.drop("tokens"), [*keys, "batch"], "left_semi").drop("batch"), last.drop("batch")


def latest(events: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """Newest record of each key over a stream (complete mode) or a table."""
    columns = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(stamp, *[c for c in columns if c != stamp])).alias("r")).select(*key, "r.*")


def windowed_counts(events: DataFrame, stamp: str, kind: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events for each window and kind; with a watermark, so state stays bounded on a stream."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, size), kind).agg(F.count("*").alias("n"))
