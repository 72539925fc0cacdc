"""Codecs round trip, and refuse what does not fit."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from quire.functions.text import text_revision
from quire.sinks import codecs


def test_annotations(spark):
    at = datetime(2020, 1, 2)
    h = spark.createDataFrame([("u", "h2", 1, 0, 2, "x", "a", "b", at, None), ("u", "h1", 0, 5, 9, "y", "", "", at, "n")], f"owner string, {codecs.HIGHLIGHT}")
    b = spark.createDataFrame([("u", "b", "t", 0, 3, at, None), ("w", "c", "t", 1, 1, at, None)], f"owner string, {codecs.BOOKMARK}")
    rows = {r["owner"]: r for r in codecs.annotations_json(h, b, "owner").select("owner", "json", codecs.annotations_of(F.col("json")).alias("back")).collect()}
    assert [x["id"] for x in rows["u"]["back"]["highlights"]] == ["h1", "h2"] and rows["u"]["back"]["bookmarks"][0]["created_at"] == at
    assert rows["w"]["back"]["highlights"] == []
    other = spark.createDataFrame([(json.dumps({"v": 2, "highlights": [], "bookmarks": []}),), ("bad",)], "j string")
    assert [r[0] for r in other.select(codecs.annotations_of(F.col("j"))).collect()] == [None, None]


def test_anchors_and_snapshots(spark):
    df = spark.createDataFrame([("é text",)], "t string")
    lit = F.lit
    anchor = codecs.anchor_json(lit(1), lit(0), lit(1), text_revision(F.col("t")), lit("é"), lit(""), lit(" text"))
    bad = codecs.anchor_json(lit(1), lit(2), lit(1), text_revision(F.col("t")), lit("é"), lit(""), lit(""))
    snap = codecs.snapshot_json(lit("b"), lit(0), lit("p"), F.col("t"))
    row = df.select(codecs.anchor_of(anchor).alias("a"), codecs.anchor_of(bad).alias("b"), codecs.snapshot_of(snap).alias("s"), codecs.snapshot_of(F.replace(snap, lit("text"), lit("next"))).alias("c")).first()
    assert row["a"]["quote"] == "é" and row["b"] is None and row["s"]["text"] == "é text" and row["c"] is None


def test_position_list(spark):
    df = spark.createDataFrame([("b", 2, 0.5, 0.5), ("b", 1, 0.0, 0.0)], "book string, position int, progression double, total_progression double")
    got = json.loads(codecs.position_list_json(df, "book").first()["json"])
    assert got["total"] == 2 and [p["position"] for p in got["positions"]] == [1, 2]
