"""Index export and import: three tables, trusted only if their identity and texts agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import text_revision
from quire.operators.index import IDENTITY, Limits, posted, unfolded, vocabulary
from quire.sinks.shared import drop

SCHEMA_VERSION = 2


def write(path: str, sections: DataFrame, keys: list[str], text: str = "text", limits: Limits = Limits()) -> None:
    """Build an index into ``path``: postings and vocabulary sorted by term, and stats.

    Texts are read once, into a table of the folder that is dropped at the end.  Terms
    are dealt by range together with the section, so a frequent term takes several files.
    """
    spark = sections.sparkSession
    own = f"{path}/_sections"
    sections.select(*keys, posted(F.col(text)).alias("p")).write.option("compression", "zstd").parquet(own)
    read = spark.read.parquet(own)
    read.select(*keys, F.col("p.tokens").cast("bigint").alias("tokens")).write.parquet(f"{path}/stats")
    postings = unfolded(read, keys, limits)
    postings.repartitionByRange("term", *keys).sortWithinPartitions("term", *keys).write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(f"{path}/postings")
    vocabulary(spark.read.parquet(f"{path}/postings")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    drop(spark, [own])


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, stats, terms) of a written index."""
    return tuple(spark.read.parquet(f"{path}/{part}") for part in ("postings", "stats", "terms"))


class Incompatible(Exception):
    """A stored index that does not belong to the live texts."""


def export(path: str, sections: DataFrame, postings: DataFrame, stats: DataFrame, keys: list[str], identity: dict[str, str | None], text: str = "text") -> None:
    """Write postings, stats with each section's text digest, and one row of identity; an incomplete index is refused."""
    missing = sections.select(*keys).join(stats.select(*keys), keys, "left_anti")
    if not missing.isEmpty():
        raise Incompatible("the index lacks sections")
    postings.write.parquet(f"{path}/postings")
    stats.join(sections.select(*keys, text_revision(F.col(text)).alias("revision")), keys).write.parquet(f"{path}/stats")
    row = [(SCHEMA_VERSION, *[identity.get(n) for n in IDENTITY])]
    sections.sparkSession.createDataFrame(row, "version int, " + ", ".join(f"{n} string" for n in IDENTITY)).coalesce(1).write.parquet(f"{path}/identity")


def load(spark: SparkSession, path: str, sections: DataFrame, keys: list[str], identity: dict[str, str | None], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings, stats), or Incompatible: version, identity and every text digest must agree."""
    stored = spark.read.parquet(f"{path}/identity").first()
    if stored["version"] != SCHEMA_VERSION:
        raise Incompatible(f"schema version {stored['version']}")
    if any(stored[n] != identity.get(n) for n in IDENTITY):
        raise Incompatible("another identity")
    stats = spark.read.parquet(f"{path}/stats")
    live = sections.select(*keys, text_revision(F.col(text)).alias("revision"))
    both = [*keys, "revision"]
    if not live.join(stats, both, "left_anti").isEmpty() or not stats.join(live, both, "left_anti").isEmpty():
        raise Incompatible("a text has changed")
    return spark.read.parquet(f"{path}/postings"), stats.drop("revision")


def wire(rows: DataFrame) -> DataFrame:
    """Rows as JSON, one each."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


COVERAGE = "eligible bigint, indexed bigint, failed bigint, pending bigint, tokens bigint, occurrences bigint, terms bigint, is_complete boolean"


def results_json(hits: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row of JSON: the hits of a query, which its limit bounds, in their order, and what of the sections was searched."""
    order = F.struct(-F.col("score"), *[c for c in hits.columns if c != "score"])
    ranked = hits.agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct(*hits.columns).alias("hit")))), lambda x: x["hit"]).alias("hits"))
    counters = coverage.select(F.struct(*[x.split()[0] for x in COVERAGE.split(", ")]).alias("coverage"))
    return ranked.crossJoin(counters).select(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("v"), "coverage", "hits")).alias("json"))


def results_of(rows: DataFrame, hit: str, json: str = "json") -> DataFrame:
    """coverage and hits of ``results_json``; ``hit`` is the schema of one. Null where the JSON is of another version or its counters are none."""
    read = rows.select(F.from_json(json, f"v int, coverage struct<{', '.join(f'{n}: {t}' for n, t in (x.split() for x in COVERAGE.split(', ')))}>, hits array<struct<{hit}>>").alias("r"))
    c = F.col("r.coverage")
    good = (F.col("r.v") == SCHEMA_VERSION) & (c["indexed"] + c["failed"] + c["pending"] == c["eligible"]) & F.col("r.hits").isNotNull()
    for name in ("eligible", "indexed", "failed", "pending", "tokens", "occurrences", "terms"):
        good = good & (c[name] >= 0)
    return read.select(F.when(good, c).alias("coverage"), F.when(good, F.col("r.hits")).alias("hits"))
