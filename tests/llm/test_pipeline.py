"""The pipeline's stages on small tables."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.conftest import DOCS, passage  # noqa: E402
from tests.llm.test_corpus_operators import near_brute  # noqa: E402
from tests.llm.test_text_operators import lines_brute, quality_rows, sha  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels = quality_rows(240)
    rows += [(1000 + k, passage(31, 80) + f" end{k}", "en", "t", 0) for k in range(4)] + [(1100 + k, "A line that all of these documents share\n" + passage(40 + k, 30), "de", "t", 0) for k in range(4)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    named = dict(pipeline.STAGES)
    as_rows = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "pieces"]
    kept = named["quality"](spark, docs, folder)
    assert kept.columns == docs.columns and 100 < kept.count() < docs.count()
    lines = named["line_dedup"](spark, docs, folder)
    assert sorted((r[0], sha(r[1])) for r in as_rows(lines)) == sorted((r[0], r[3]) for r in lines_brute(as_rows(docs)))
    one = named["near_duplicates"](spark, docs, folder)
    assert sorted(r[0] for r in as_rows(one)) == sorted({r[1] for r in near_brute(as_rows(docs))})
    mixed = named["mixing"](spark, docs, folder)
    assert mixed.columns == docs.columns and 0 < mixed.count() < docs.count()
    assert named["pieces"](spark, docs, folder).count() == docs.count()


def test_odd_rows_stage_by_stage(spark, folder, rows):
    """Nulls, empty and very long texts, repeated rows and columns with clashing names, against plain Python."""
    from collections import Counter

    from quire.llm import mixing, pieces, quality
    from tests.llm.conftest import CLASHES

    rows = [*rows, (77, passage(90, 30_000), "en", "src1", None)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, "w", 3, "s", 4, "h", "l") for r in rows], f"{DOCS}, {CLASHES}")
    named = dict(pipeline.STAGES)
    out = {n: named[n](spark, docs, folder) for n in ("quality", "line_dedup", "near_duplicates", "mixing")}
    assert all(f.columns == docs.columns for f in out.values())
    got = {n: [tuple(r) for r in f.collect()] for n, f in out.items()}
    assert all(r[5:] == ("x", 1, 2, "w", 3, "s", 4, "h", "l") for f in got.values() for r in f)
    report = quality.quality_report(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("kept").collect()
    assert Counter(r[0] for r in got["quality"]) == Counter(r["doc_id"] for r in report) and all(r[1] for r in got["quality"])
    want = sorted((repr(r[0]), r[3]) for r in lines_brute(rows))
    assert sorted((repr(r[0]), sha(r[1])) for r in got["line_dedup"]) == want
    low = -(1 << 63)
    assert Counter(low if r[0] is None else r[0] for r in got["near_duplicates"]) == Counter({r[1] for r in near_brute(rows)})
    drawn = Counter(map(repr, (tuple(r)[:5] for r in mixing.mix(docs).where("_drawn").select(*docs.columns).collect())))
    assert Counter(repr(r[:5]) for r in got["mixing"]) == drawn
    tokens = named["pieces"](spark, docs, folder).collect()
    lattice = pieces.Lattice(pieces.PieceTable.load())
    assert Counter(repr((r["doc_id"], r["n_tokens"], list(r["token_ids"]))) for r in tokens) == Counter(repr((r[0], len(x := lattice.encode(r[1] or "").tolist()), x)) for r in rows)


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "pieces":
            rows = docs.collect()
            docs = spark.createDataFrame(rows, docs.schema)
    want = sorted(map(repr, map(tuple, docs.collect())))
    assert sorted(map(repr, map(tuple, pipeline.run(spark, folder).collect()))) == want


def test_run(spark, folder):
    out = pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_chars", "n_tokens", "token_ids"] and out.count() > 0


def test_empty_and_clashing(spark, folder):
    docs = spark.createDataFrame([], f"{DOCS}, row string, `set` int")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        assert name == "pieces" or out.columns == docs.columns


def test_mixing_stage_does_not_depend_on_how_many_texts_are_taken_at_a_time(spark, monkeypatch):
    from quire.llm import mixing
    from tests.llm.test_text_operators import topic_docs

    docs = spark.createDataFrame(topic_docs(), DOCS)
    taken = lambda: sorted(r["doc_id"] for r in pipeline.mixing(spark, docs, "").collect())
    whole = taken()
    monkeypatch.setattr(mixing, "TOPIC_DOCS", 2)
    assert taken() == whole


def test_quality_stage_learns_from_every_label(spark, tmp_path):
    """48,000 labels: counts, curve and weights by plain Python over all of them."""
    import math
    import random
    import zlib
    from collections import Counter

    import numpy as np

    from quire.llm import quality
    from tests.llm.test_text_operators import grams_brute

    r = random.Random(21)
    texts = [passage(200 + k, 8) for k in range(30)]
    rows = [(k, texts[k % 30], "en", "s", 0) for k in range(48_000)]
    labels = [(k, int(r.random() < (k % 30 + 1) / 32), 0) for k in range(48_000)]
    docs = spark.createDataFrame(rows, DOCS)
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    part = [zlib.crc32(str(k).encode()) % 4 for k in range(48_000)]
    taught = Counter(k % 30 for k, q, _ in labels if q and part[k] < 2)
    counts, grams = np.zeros((2, 2 * quality.BUCKETS)), [grams_brute(t) for t in texts]
    for t, own in enumerate(grams):
        np.add.at(counts, (0, own), 1600)
        np.add.at(counts, (1, own), taught[t])
    ratio = quality.log_ratio(counts)
    rate = [ratio[own].sum() / len(t.encode()) for t, own in zip(texts, grams)]
    held = [(rate[k % 30], bool(q)) for k, q, _ in labels if part[k] == 3]
    a, b, prior = quality.curve(*map(np.array, zip(*held)))
    out = quality.quality_report(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    want = [-math.log1p(math.exp(-a - b * x)) - math.log(prior) for x in rate]
    assert len(out) == 48_000 and max(abs(x["log_weight"] - want[x["doc_id"] % 30]) for x in out) < 1e-9
    assert sorted(x["doc_id"] for x in pipeline.quality(spark, docs, str(tmp_path)).collect()) == sorted(x["doc_id"] for x in out if x["kept"])
