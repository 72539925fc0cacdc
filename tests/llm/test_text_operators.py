"""Operators on single texts and lines against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import fingerprints, langid, line_dedup, media, mixing, pieces, quality

SPACE = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def sortable(rows):
    return sorted(map(repr, rows))


def lines_brute(rows):
    no_id = -(1 << 63)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders[key(line)].add(no_id if r[0] is None else r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        own = no_id if r[0] is None else r[0]
        gone = [len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and own != max(holders[key(x)]) for x in lines]
        out.append((r[0], len(lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone) if not g))))
    return out


def test_line_dedup(docs, rows, empty, clashing):
    want = sortable(lines_brute(rows))
    assert sortable(map(tuple, line_dedup.line_dedup_report(docs).collect())) == want
    assert sortable(map(tuple, line_dedup.line_dedup_report(clashing).collect())) == want
    assert line_dedup.line_dedup_report(empty).count() == 0
    out = line_dedup.drop_common_lines(clashing)
    assert out.columns == clashing.columns
    assert sortable((r["doc_id"], sha(r["text"])) for r in out.collect()) == sortable((w[0], w[3]) for w in lines_brute(rows))
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_lines_are_split_once(docs, spark):
    """All that is asked of lines reads their hashes; texts are split again only where their lines are put together."""
    for out in (line_dedup.line_dedup_report(docs), line_dedup.drop_common_lines(docs)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" in plan and "Generate" not in plan


def test_line_ends(spark):
    ends = ["", *SPACE, "\u00a0", "\u2028", "\x1c", "\x85", "\u3000", " \u00a0 ", "\x0b\t \r\x0c"]
    lines = [a + b + c for a in ends for b in ("", "x", "a \t b", "é") for c in ends]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_dedup.stripped(F.col("line"))).collect()
    assert [tuple(r) for r in got] == [(x, x.strip(SPACE)) for x in lines]


def xx(values: list[int], seed: int = 42) -> int:
    for v in values:
        seed = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed=seed)
    return seed


def sketch_brute(text: str) -> list[int]:
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not hashes:
        return []
    shingles = [xx(hashes[k : k + 5]) for k in range(len(hashes) - 4)] if len(hashes) >= 5 else [xx(hashes)]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    low = sorted({h for h in shingles if h >> (64 - fingerprints.SCALE_BITS) == 0})
    return low or [min(shingles, key=signed)]


def printed(sketch: list[int]) -> str:
    return " ".join(f"{'~' if h >> (64 - fingerprints.SCALE_BITS) else ''}{h % (1 << 64):X}" for h in sketch)


def text_hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def test_fingerprints(docs, rows, empty, clashing):
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1])))
    want = []
    for k, (doc_id, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = map(sketch_brute, (text, edited, following))
        near = lambda x, y: 1.0 if not x and not y else len(set(x) & set(y)) / len(set(x) | set(y))
        want.append((doc_id, len(text), sha(edited), printed(a), printed(b), near(a, b), near(a, c)))
    got = fingerprints.fingerprint_report(docs).drop("contained_edited", "contained_next")
    assert sortable(map(tuple, got.collect())) == sortable(want)
    assert fingerprints.fingerprint_report(clashing).count() == len(rows)
    assert fingerprints.fingerprint_report(empty).count() == 0


def test_next_row_over_many_ranges(spark, monkeypatch):
    """Evenly and unevenly spread ids, null ids and repeated ids; buckets stay small."""
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 4)
    r = random.Random(4)
    ids = r.sample(range(10**9), 300) + list(range(5, 400)) + [None] * 200 + [2 * 10**9] * 40
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(x["doc_id"], x["text"]): x["next_text"] for x in fingerprints.with_next(df, ["text"]).collect()}
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, text_hash(x[1])))
    assert got == {a: b[1] for a, b in zip(rows, rows[1:] + rows[:1])}
    sizes = fingerprints.bucketed(df.selectExpr("*", "xxhash64(text) AS _th")).groupBy("_b").count().toPandas()["count"]
    assert sizes.max() <= 48


def test_sketches_of_parts_merge(spark):
    """The merged sketch of any parts is that of their joined shingles, also where a part keeps nothing."""
    words = [f"w{k}" for k in range(120)]
    parts = [" ".join(words[k : k + 9]) for k in range(0, 112, 5)]
    df = fingerprints.with_sketch(spark.createDataFrame([(p,) for p in parts + [" ".join(words[: 9 + 5 * (len(parts) - 1)])]], "t string"), "t", "s")
    *of_parts, whole = [x["s"] for x in df.collect()]
    assert any(not s["kept"] for s in of_parts)
    pairs = spark.createDataFrame([(of_parts[0], of_parts[1])], "a struct<kept: array<bigint>, least: bigint>, b struct<kept: array<bigint>, least: bigint>")
    for s in of_parts[1:]:
        first = pairs.select(fingerprints.merged("a", "b").alias("a")).first()["a"]
        pairs = spark.createDataFrame([(first, s)], pairs.schema)
    assert pairs.select(fingerprints.merged("a", "b").alias("m")).first()["m"] == whole


def test_containment_between_unequal_documents(spark):
    text = " ".join(f"w{k}" for k in range(8000))
    part = " ".join(f"w{k}" for k in range(1000, 2000))
    df = fingerprints.with_sketch(fingerprints.with_sketch(spark.createDataFrame([(text, part)], "a string, b string"), "a", "sa"), "b", "sb")
    contained, near = df.select(fingerprints.contained("sa", "sb"), fingerprints.near("sa", "sb")).first()
    assert contained == 1.0 and abs(near - 996 / 7996) < 0.04


def test_media_report(docs, rows, empty, clashing):
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        blob = b"RIFF" + (36 + len(payload)).to_bytes(4, "little") + b"WAVEfmt \x10\0\0\0\1\0\1\0" + (8000).to_bytes(4, "little") * 2 + b"\1\0\x08\0data" + len(payload).to_bytes(4, "little") + payload
        feature = f"audio/wav;rate=8000;bits=8;frames={len(payload)};crc={zlib.crc32(payload):08x};embedded=0"
        want.append((r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
    assert sortable(map(tuple, media.media_report(docs).collect())) == sortable(want)
    assert sortable(map(tuple, media.media_report(clashing).collect())) == sortable(want)
    assert media.media_report(empty).count() == 0
    kept = {(x["doc_id"], media.wav_samples(x["media"])[: x["n_bytes"]].decode()) for x in media.stored(docs).collect()}
    assert kept == {(r[0], r[1] or "") for r in rows}


def test_media_inside_stored_texts(spark):
    """A text that is a PDF from end to end, and one that holds one, are carved from the stored column."""
    inner = pdf().decode()
    rows = spark.createDataFrame([(1, inner), (2, f"see {inner} there"), (3, "none")], "doc_id bigint, text string")
    got = {x["doc_id"]: (x["media_type"], [tuple(e) for e in x["embedded"]]) for x in media.sniff_column(media.stored(rows), "media").collect()}
    assert got == {1: ("audio/wav", [(44, len(inner), "application/pdf")]), 2: ("audio/wav", [(48, len(inner), "application/pdf")]), 3: ("audio/wav", [])}


def pdf(updates: int = 1) -> bytes:
    out = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n"
    for _ in range(updates):
        out += b"xref\n0 1\ntrailer <<>>\nstartxref\n%d\n%%%%EOF\n" % len(out)
    return out[:-1]


def ogg_page(body: bytes, number: int) -> bytes:
    head = b"OggS\0\2" + bytes(8) + b"abcd" + number.to_bytes(4, "little")
    tail = bytes([len(body)]) + body
    page, crc = head + bytes(4) + b"\1" + tail, 0
    for byte in page:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return head + crc.to_bytes(4, "little") + b"\1" + tail


def flac() -> bytes:
    def crc(data, poly, width):
        r = 0
        for byte in data:
            r ^= byte << width - 8
            for _ in range(8):
                r = (r << 1 ^ (poly if r >> width - 1 else 0)) & (1 << width) - 1
        return r.to_bytes(width // 8, "big")

    info = (192).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 384).to_bytes(8, "big") + bytes(16)
    out = b"fLaC\x80\0\0\x22" + info
    for k in range(2):  # two frames of one constant sample each
        head = bytes([0xFF, 0xF8, 0x14, 0x02, k])
        head += crc(head, 0x07, 8)
        frame = head + b"\0\x41\x42"
        out += frame + crc(frame, 0x8005, 16)
    return out


def test_lengths_are_confirmed(spark):
    import gzip
    import io
    import zipfile

    with zipfile.ZipFile(z := io.BytesIO(), "w") as f:
        f.writestr("a", "text")
    ogg = ogg_page(b"one", 0) + ogg_page(b"two", 1)
    magic = media.automaton()
    for blob, kind in ((pdf(1), "application/pdf"), (pdf(3), "application/pdf"), (flac(), "audio/flac"), (ogg, "audio/ogg"), (gzip.compress(b"x" * 200_000), "application/gzip"), (z.getvalue(), "application/zip"), (png(), "image/png")):
        assert media.sniff(blob, None, magic) == (kind, []), kind
        assert media.sniff(b"some text " + blob + b" and more " * 30, "text/plain", magic) == ("text/plain", [(10, len(blob), kind)]), kind
    broken = bytearray(ogg)
    broken[-1] ^= 1
    assert media.sniff(b"x" + bytes(broken), "text/plain", magic)[1] == [(1, len(ogg) // 2, "audio/ogg")]
    assert media.sniff(pdf()[:-9] + b"9999\n%%EOF", None, magic)[0] == "application/octet-stream"


@pytest.mark.parametrize("piece", [b"%PDF-1.4 ", b"PK\3\4", b"\xff\xd8\xff\xda\0\2", b"\x1f\x8b\x08\0", b"GIF89a", b"RIFF", b"BM", b"startxref\n1\n%%EOF ", b"PK\5\6" + bytes(18), ogg_page(b"x", 0), b"fLaC"])
def test_sniffing_takes_time_in_proportion(piece):
    import time

    begun = time.perf_counter()
    media.sniff(b"-" + piece * ((1 << 20) // len(piece)), "text/plain", media.automaton())
    assert time.perf_counter() - begun < 10


def png() -> bytes:
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing_corrects_and_carves(spark):
    gif = b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    wav, broken = media.as_wav(b"abc"), png()[:-3] + b"xyz"
    blobs = [
        (png(), "image/jpeg", "image/png", []),
        (b"text BM RIFF PK\3\4 ftyp %PDF- OggS fLaC", "text/plain", "text/plain", []),
        (b"junk" + png() + b"more" + gif, "text/plain", "text/plain", [(4, len(png()), "image/png"), (8 + len(png()), len(gif), "image/gif")]),
        (broken, "image/png", "application/octet-stream", []),
        (media.as_wav(b"1234" + png()), None, "audio/wav", [(48, len(png()), "image/png")]),
        (wav, "audio/mpeg", "audio/wav", []), (b"", "image/png", "application/x-empty", []), (None, None, "application/x-empty", []),
    ]
    df = spark.createDataFrame([(k, b[0], b[1]) for k, b in enumerate(blobs)], "k int, blob binary, said string")
    for r in media.sniff_column(df, "blob", "said").collect():
        assert (r["media_type"], [tuple(x) for x in r["embedded"]]) == blobs[r["k"]][2:], r["k"]
    assert media.wav_samples(wav) == b"abc"


def test_mixing_meets_its_marginals(docs, rows, empty, clashing, monkeypatch):
    out = mixing.mix(docs, token_share=0.5).toPandas()
    total = out._tokens.sum()
    assert abs((out._tokens * out._probability).sum() / total - 0.5) < 1e-6
    fitted = out._tokens * out._ratio
    for side, power in (("source", 0.5), ("lang", 0.7), ("_topic", 0.5)):
        held = out.groupby(out[side].astype(object).where(out[side].notna(), "none")).apply(lambda g: g._tokens.sum(), include_groups=False)
        now = fitted.groupby(out[side].astype(object).where(out[side].notna(), "none")).sum()
        held = held[held > 0]
        goal = (held / total) ** power / ((held / total) ** power).sum()
        assert (abs(now[goal.index] / total - goal) < 0.05).all()
    monkeypatch.setattr(mixing, "TOPIC_DOCS", 20)
    one = lambda n: mixing.mix(docs, token_share=0.5, topic=F.length(F.coalesce("text", F.lit(""))) % 3, driver_cells=n).toPandas()
    monkeypatch.setattr(mixing.rake, "__defaults__", (4,))
    monkeypatch.setattr(mixing, "ROUNDS", 4)
    out, frames = one(50_000), one(0)
    assert abs(out._gap[0] - frames._gap[0]) < 1e-9
    key = ["doc_id", "_tokens", "_ratio", "_probability"]
    a, b = (x[key].sort_values(key).reset_index(drop=True) for x in (out, frames))
    assert np.allclose(a.fillna(-1), b.fillna(-1), atol=1e-6)
    assert mixing.mixing_report(clashing).count() == len(rows)
    assert mixing.drawn(clashing).columns == clashing.columns
    assert mixing.mixing_report(empty).count() == 0


def test_raking_with_given_targets():
    keys = [(s, l, t) for s in "ab" for l in "xyz" for t in range(2)]
    tokens = np.arange(1.0, 13.0)
    ratio, gap = mixing.rake(keys, tokens, [1, 1, 1], [{"a": 0.8, "b": 0.2}, {"x": 0.5, "y": 0.3, "z": 0.2}, None])
    assert gap < 1e-8
    weight = ratio * tokens / tokens.sum()
    assert abs(sum(w for w, k in zip(weight, keys) if k[0] == "a") - 0.8) < 1e-8
    assert abs(sum(w for w, k in zip(weight, keys) if k[1] == "y") - 0.3) < 1e-8
    sums = lambda s: (tokens[s * ratio >= 1].sum(), (tokens * ratio)[s * ratio < 1].sum())
    for share in (0.01, 0.3, 0.7, 0.999):
        scale = mixing.draw_scale(sums, share * tokens.sum())
        assert abs((tokens * np.minimum(1, scale * ratio)).sum() / tokens.sum() - share) < 1e-9
    assert (mixing.draw_scale(sums, 2 * tokens.sum()) * ratio >= 1 - 1e-9).all()
    # Targets that contradict each other leave a gap, and it is told.
    assert mixing.rake([("a", "x"), ("b", "y")], np.ones(2), [1, 1], [{"a": 0.9, "b": 0.1}, {"x": 0.1, "y": 0.9}])[1] > 0.5


def topic_docs(n=240):
    r = random.Random(12)
    themes = [[f"{t}{k}" for k in range(40)] for t in ("sea", "sky", "law")]
    tongues = {"en": ["the", "of", "and"], "de": ["der", "und", "zu"]}
    rows = []
    for k in range(n):
        lang = ("en", "de")[k // 3 % 2]
        rows.append((k, " ".join(r.choice(themes[k % 3]) + " " + r.choice(tongues[lang]) for _ in range(40)), lang, f"s{k % 4}", 0))
    return rows


def test_topics_are_themes_and_not_languages(spark, monkeypatch):
    from tests.llm.conftest import DOCS

    monkeypatch.setattr(mixing, "TOPICS", 3)
    rows = topic_docs()
    got = {x["doc_id"]: x["_topic"] for x in mixing.described(spark.createDataFrame(rows, DOCS)).collect()}
    by_theme = [Counter(got[k] for k in range(t, 240, 3)).most_common(1)[0] for t in range(3)]
    assert len({t for t, _ in by_theme}) == 3 and sum(n for _, n in by_theme) >= 235


def test_mixing_report_against_brute_force(spark):
    """Every column of every row, from the topics on, by plain Python."""
    from tests.llm.conftest import DOCS

    rows = topic_docs() + [(900, None, "en", "s1", 0), (901, "  ", None, None, 0), (902, "alone here", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    topics = mixing.learn_topics(docs)
    n = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    def topic(r):
        held = np.unique([int(h >> 52) for h in mixing.hashed_words(*mixing.bytes_of(mixing.pa.array([r[1] or ""])))[0].tolist()]).astype(int)
        if not len(held):
            return 0
        point = np.zeros(mixing.TOPIC_BUCKETS)
        point[held] = topics.weight[held]
        point /= np.linalg.norm(point)
        return int((point @ topics.centres - topics.means.get(r[2], topics.usual)).argmax())
    cell = {r[0]: (r[3], r[2], topic(r)) for r in rows}
    held = Counter()
    for d, c in cell.items():
        held[c] += n[d]
    weight = {c: x / sum(held.values()) for c, x in held.items() if x}
    goals = []
    for axis, power in enumerate((0.5, 0.7, 0.5)):
        side = Counter()
        for c, x in weight.items():
            side[c[axis]] += x
        raw = {k: x**power for k, x in side.items()}
        goals.append({k: x / sum(raw.values()) for k, x in raw.items()})
    before = dict(weight)
    for _ in range(mixing.ROUNDS):
        for axis, goal in enumerate(goals):
            now = Counter()
            for c, x in weight.items():
                now[c[axis]] += x
            weight = {c: x * goal[c[axis]] / now[c[axis]] for c, x in weight.items()}
    ratio = {c: weight[c] / before[c] for c in weight}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(held[c] * min(1, mid * ratio[c]) for c in ratio) < mixing.TOKEN_SHARE * sum(held.values()) else (low, mid)
    def unit(d, text):
        h = xxhash.xxh64_intdigest(d.to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(mixing.SEED.to_bytes(4, "little"), seed=42))
        return ((xxhash.xxh64_intdigest(text.encode(), seed=h) if text is not None else h) >> 11) / 2**53 + 2.0**-54
    for x in mixing.mixing_report(docs).collect():
        r = next(r for r in rows if r[0] == x["doc_id"])
        chance = min(1.0, high * ratio.get(cell[r[0]], 1.0))
        assert (x["topic"], x["n_tokens"]) == (cell[r[0]][2], n[r[0]])
        assert abs(x["ratio"] - ratio.get(cell[r[0]], 1.0)) < 1e-6 and abs(x["probability"] - chance) < 1e-6
        assert x["drawn"] == (unit(r[0], r[1]) < chance)


def test_topics_come_from_every_row(spark, monkeypatch):
    """Weights, means and centres over 2,400 different texts and their copies by plain Python; the same in any order, with means in a table too."""
    from tests.llm.conftest import DOCS

    monkeypatch.setattr(mixing, "TOPICS", 3)
    rows = [(k, f"{t} own{k}", lang, s, 0) for k, t, lang, s, _ in topic_docs(2400)]
    rows += [(k, t, None, None, 0) for k, t, *_ in rows[:90]] + [(1, None, "xx", None, 0), (2, " ", "en", None, 0), (3, "one of its language", "yy", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    topics = mixing.learn_topics(docs)
    held = [np.unique([int(h >> 52) for h in mixing.hashed_words(*mixing.bytes_of(mixing.pa.array([r[1] or ""])))[0].tolist()]).astype(int) for r in rows]
    points, langs = np.zeros((len(rows), mixing.TOPIC_BUCKETS)), np.array([str(r[2]) for r in rows])
    for point, b in zip(points, held):
        point[b] = 1
    full = points.any(1)
    points, langs = points[full], langs[full]
    weight = np.log((1 + len(points)) / (1 + points.sum(0)))
    assert np.allclose(topics.weight, weight)
    points *= weight
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    means = {x: points[langs == x].mean(0) for x in set(langs)}
    assert set(topics.means) == {"en", "de", None, "yy"} and all(np.allclose(topics.means[x], means[str(x)] @ topics.centres, atol=1e-6) for x in topics.means)
    assert np.allclose(topics.usual, points.mean(0) @ topics.centres, atol=1e-6)
    rest = points - np.array([means[x] for x in langs])
    own = (rest @ topics.centres).argmax(1)
    for j in range(3):
        assert np.allclose(rest[own == j].sum(0) / np.linalg.norm(rest[own == j].sum(0)), topics.centres[:, j], atol=1e-5)
    moved, table = mixing.learn_topics(docs.repartition(5, "doc_id")), mixing.learn_topics(docs, few=0)
    assert np.array_equal(moved.centres, topics.centres) and moved.means.keys() == topics.means.keys()
    assert np.allclose(table.centres, topics.centres, atol=1e-5) and all(np.allclose(table.means[x], topics.means[x], atol=1e-5) for x in topics.means)
    alone = mixing.learn_topics(spark.createDataFrame([(k, f"word{k}", f"l{k}", "s", 0) for k in range(5)], DOCS))
    assert alone.centres.shape == (mixing.TOPIC_BUCKETS, 1) and not alone.centres.any()


def drawn_first(*steps: int, beside: list[str]) -> str:
    """A text that is drawn before all of ``beside`` in these steps of finding first centres, even if it is eight times less distant."""

    def scores(texts: list[str], step: int) -> np.ndarray:
        bucket, ends, _ = mixing.word_buckets(mixing.pa.array(texts))
        word = mixing.mixed(bucket.astype(np.uint64) + np.uint64((step + 1) * mixing.TOPIC_BUCKETS))
        return -np.log(((mixing.mixed(np.add.reduceat(word, ends[:-1])) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53))

    texts = [f"left{k} right{k}" for k in range(20_000)]
    ahead = np.logical_and.reduce([scores(texts, s) < scores(beside, s).min() / 8 for s in steps])
    return texts[int(np.flatnonzero(ahead)[0])]


def test_first_centres_are_found_behind_any_number_of_rows_that_cannot_be_one(spark, monkeypatch):
    """Many copies of a text that is all of its language, and many languages with the same two texts, are drawn first."""
    from tests.llm.conftest import DOCS

    monkeypatch.setattr(mixing, "TOPICS", 3)
    some = topic_docs(12)
    copy = drawn_first(0, beside=[r[1] for r in some])
    docs = spark.createDataFrame(some + [(100 + k, copy, "xx", "s", 0) for k in range(200)], DOCS).repartition(1)
    found = mixing.learn_topics(docs)
    assert found.centres.shape[1] == 3 and found.centres.any(0).all()
    one = drawn_first(0, 2, beside=[r[1] for r in some])
    other = drawn_first(1, beside=[r[1] for r in some])
    docs = spark.createDataFrame(some + [(100 + k, (one, other)[k % 2], f"l{k // 2}", "s", 0) for k in range(200)], DOCS).repartition(1)
    found, table = mixing.learn_topics(docs), mixing.learn_topics(docs, few=0)
    assert found.centres.shape[1] == 3 and np.allclose(found.centres, table.centres, atol=1e-5)


def test_pieces_agree_with_the_library(docs, rows, empty, clashing, spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(5)
    alphabet = list("abcdefghijklmnopqrstuvwxyz  \n\t.,!?-0123456789ABCDEéßñüçÉ漢字日ﬁ▁😀") + ["http", "tion", "ing ", "    "]
    texts = [x[1] for x in rows] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = pieces.encoded(frame).collect()
    for x in got:
        assert x["token_ids"] == model.encode(texts[x["doc_id"]] or ""), texts[x["doc_id"]]
        assert x["round_trip"] and x["n_tokens"] == len(x["token_ids"])
    back = {x["doc_id"]: x["text"] for x in pieces.decoded(pieces.encoded(frame)).collect()}
    assert all(back[k] == (t or "").replace("▁", " ") for k, t in enumerate(texts))
    assert pieces.encoded(clashing).count() == len(rows) and pieces.encoded(empty).count() == 0


def test_unigram_fold_takes_the_best_sum():
    table = pieces.PieceTable([("<unk>", 0.0, "unknown"), ("▁a", -2.0, "normal"), ("▁", -1.0, "normal"), ("ab", -1.5, "normal"), ("▁ab", -2.6, "normal"), ("a", -3.0, "normal"), ("b", -3.0, "normal")], bpe=False)
    lattice = pieces.Lattice(table)
    assert lattice.encode("ab").tolist() == [2, 3]
    assert lattice.encode("a").tolist() == [1]


def brute_phrases(text: str, train: str) -> int:
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in train:
            n += 1
        count, at = count + 1, at + n
    return count


def as_symbols(text: str, table) -> np.ndarray:
    return langid.symbols(np.frombuffer(text.encode("utf-32-le"), np.uint32), table)


def test_cross_parsing_against_brute_force():
    r = random.Random(7)
    scripts = {"en": "abcd ", "fr": "cdef ", "zz": [chr(0x4E00 + k) for k in range(900)]}
    texts = {x: ["".join(r.choice(alphabet) for _ in range(300))] for x, alphabet in scripts.items()}
    table = langid.symbol_table(texts)
    parser = langid.Parser(texts, table)
    train = {k: "".join(map(chr, as_symbols(v[0], table))) for k, v in texts.items()}
    rows = [as_symbols("".join(r.choice("abcdefgh " + texts["zz"][0][:40]) for _ in range(r.randint(0, 200))), table) for _ in range(40)]
    for row, own in zip(rows, parser.phrases(rows)):
        text = "".join(map(chr, row))
        assert own.tolist() == [brute_phrases(text, train[k]) if len(text) else 0 for k in texts]


@pytest.mark.parametrize("most", [1 << 20, 2_000])
def test_predictions_against_brute_force(spark, monkeypatch, most):
    """lang_pred and score of all rows, in one pass and with a pass for each language; every letter keeps its identity."""
    from tests.llm.conftest import DOCS

    monkeypatch.setattr(langid, "MODEL_SYMBOLS", most)
    r = random.Random(11)
    scripts = {"aa": [chr(0x4E00 + k) for k in range(400)], "bb": [chr(0x4E00 + k) for k in range(300, 700)], "cc": list("abcdefghij"), "dd": list("fghijklmno")}
    text = lambda x: "".join(r.choice(scripts[x]) + (" " if r.random() < 0.2 else "") for _ in range(r.randint(20, 90)))
    data = [(k, text(list(scripts)[k % 4]), list(scripts)[k % 4], "s", 0) for k in range(120)] + [(k, text("cc") + text("aa"), None, "s", 0) for k in range(200, 210)]
    data.append(data[3])  # a repeated row is learned from once
    out = langid.identify(spark.createDataFrame(data, DOCS)).collect()
    learned = {x: " ".join(t for _, t in sorted({(d[0], d[1]) for d in data if d[2] == x and zlib.crc32(str(d[0]).encode()) % 4 != 2})) for x in scripts}
    table = langid.symbol_table({k: [v] for k, v in learned.items()})
    train = {k: "".join(map(chr, as_symbols(v, table))) for k, v in learned.items()}
    want = []
    for d in data:
        own = "".join(map(chr, as_symbols(d[1], table)))
        per = [len(own) / brute_phrases(own, t) for t in train.values()]
        want.append((d[0], zlib.crc32(str(d[0]).encode()) % 4 == 2, list(train)[per.index(max(per))], round(max(per) / sum(per), 9)))
    assert sorted((x[0], x[1], x[2], round(x[3], 9)) for x in out) == sorted(want)


def test_samples_are_whole_rows():
    rows = [(1, 1, 40_000), (2, 2, 30_000), (3, 3, 20_000), (4, 4, 90_000)]
    assert langid.fitting(rows) == [rows[0], rows[2]]
    assert langid.fitting([rows[3], (5, 5, 80_000)]) == [(5, 5, 80_000)]


def test_languages_held_out(spark, empty, clashing, rows):
    from tests.llm.conftest import DOCS

    r = random.Random(8)
    words = {"en": "the of and that with from ing".split(), "de": "der und ich nicht ein schen zu".split(), "fr": "le que dans est une pour eau".split()}
    text = lambda lang, n: " ".join("".join(r.choice(words[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    data = [(k, text(lang := list(words)[k % 3], 30), lang, "s", 0) for k in range(300)]
    data += [(1000, None, "en", "s", 0), (1001, "12 %% 34", "en", "s", 0), (None, text("de", 500) * 5, None, "s", 0)]
    out = langid.identify(spark.createDataFrame(data, DOCS)).collect()
    truth = {d[0]: d[2] for d in data if d[0] is not None and d[0] < 1000}
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in out if x["doc_id"] is not None)
    assert sum(x["lang_pred"] == truth[x["doc_id"]] for x in out if x["doc_id"] in truth) == 300
    assert {x["doc_id"]: x["lang_pred"] for x in out if x["doc_id"] in (1000, 1001, None)} == {1000: "und", 1001: "und", None: "de"}
    assert all(0 <= x["score"] <= 1 for x in out)
    assert langid.identify(empty).count() == 0 and langid.identify(clashing).count() == len(rows)


VOCABULARY = [a + b + c for a in ("ri", "sto", "mor", "wal", "lig", "un") for b in ("ver", "ne", "ning", "king", "ht", "der") for c in ("", "s", "ly")]


def quality_rows(n=600):
    r = random.Random(9)
    good = lambda: " ".join(r.choice(VOCABULARY) for _ in range(r.randint(5, 60)))
    bad = lambda: " ".join(w + r.choice(["%%%", "$$$", "###"]) for w in good().split())
    texts = [bad() if k % 6 == 0 else " ".join([r.choice(good().split())] * 40) if k % 6 == 3 else good() for k in range(n)]
    return [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], [(k, int(k % 6 not in (0, 3)), 0) for k in range(0, n, 2)]


def test_quality_keeps_the_clean_and_only_them(spark):
    from tests.llm.conftest import DOCS

    rows, labels = quality_rows()
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = quality.quality_report(docs, known).collect()
    assert sum(x["kept"] != (x["doc_id"] % 6 not in (0, 3)) for x in out) <= 6
    assert quality.keep_good(docs, known).count() == sum(x["kept"] for x in out)


def grams_brute(text: str) -> list[int]:
    raw, mask = text.encode(), (1 << 64) - 1
    mix, base = int(quality._MIX), int(quality._BASE)
    out = [(int.from_bytes(raw[k : k + 4], "big") * mix & mask) >> 50 for k in range(len(raw) - 3)]
    words = [sum((b + 1) * pow(base, k + 1, 1 << 64) for k, b in enumerate(w)) * mix & mask for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    for a, b in zip(words, words[1:]):
        step = (b - a) & mask
        out.append(quality.BUCKETS + (((step ^ (step >> 29)) * mix & mask) >> 50))
    return out


def test_quality_against_brute_force(spark):
    """Counts, ratios, weights, keys and the draw of every row by plain Python; another seed draws others among equals."""
    from tests.llm.conftest import DOCS

    rows, labels = quality_rows()
    rows += [(9000, "", "en", "s", 0), (9001, None, "en", "s", 0), rows[1]]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    part = {d: zlib.crc32(str(d).encode()) % 4 for d, _, _ in labels}
    counts = np.zeros((2, 2 * quality.BUCKETS))
    for d, text, *_ in rows:
        for g in grams_brute(text or ""):
            counts[0, g] += 1
            counts[1, g] += (d, 1, 0) in labels and part[d] < 2
    ratio = quality.log_ratio(counts)
    rate = {d: sum(ratio[g] for g in grams_brute(t or "")) / max(1, len((t or "").encode())) for d, t, *_ in rows}
    learned = [(rate[d], bool(q)) for d, q, _ in labels if part[d] == 3]
    a, b, prior = quality.curve(np.array([x for x, _ in learned]), np.array([q for _, q in learned]))
    sure = {d: 1 / (1 + math.exp(-a - b * x)) for d, x in rate.items()}

    def key(d, text, seed):
        h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), seed=42)
        h = xxhash.xxh64_intdigest(text.encode(), seed=xxhash.xxh64_intdigest(d.to_bytes(8, "little"), seed=h))
        return math.log(sure[d] / prior) - math.log(-math.log(((h >> 11) + 0.5) / 2**53))

    drawn = {}
    for seed in (quality.SEED, 99):
        keys = [key(d, t, seed) if t else None for d, t, *_ in rows]
        k = round(sum(sure[d] for d, t, *_ in rows if t))
        least = sorted((x for x in keys if x is not None), reverse=True)[k - 1]
        drawn[seed] = sortable((r[0], x is not None and x >= least) for r, x in zip(rows, keys))
        got = quality.quality_report(docs, known, seed=seed).collect()
        assert sortable((x["doc_id"], x["kept"]) for x in got) == drawn[seed]
        assert all(abs(x["log_weight"] - math.log(sure[x["doc_id"]] / prior)) < 1e-6 for x in got)
    least, keys = quality.resample(docs.select("doc_id", "text"), known, k=200, seed=1)
    other, more = quality.resample(docs.select("doc_id", "text"), known, k=200, seed=2)
    one, two = ({x["doc_id"] for x in f.where(f"gumbel_key >= {y!r}").collect()} for f, y in ((keys, least), (more, other)))
    # 200 of about 400 of like weight: two draws share half of what they hold.
    assert 60 <= len(one & two) <= 140


def test_quality_learns_alike_however_its_labels_are_joined(spark, monkeypatch):
    """Labels broadcast and ratios fitted on the driver, or a bitmap, shuffles and sums; a doc_id of many rows, labels without documents."""
    from tests.llm.conftest import DOCS

    rows, labels = quality_rows()
    rows += [rows[1]] * 300 + [(2, "another text of document two", "en", "s", 0), (None, "no id", "en", "s", 0), (9000, None, "en", "s", 0)]
    labels += [(k, k % 2, 0) for k in range(20_000, 20_400)] + [(9000, 1, 0), (None, 1, 0), (8, 0, 0), (10, None, 0)]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    report = lambda: sorted(map(tuple, quality.quality_report(docs, known).collect()), key=repr)
    few = report()
    monkeypatch.setattr(quality, "FEW_LABELS", 0)
    many = report()
    assert [(d, k) for d, _, _, k in few] == [(d, k) for d, _, _, k in many] and len(few) == len(rows)
    assert all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(few, many))


def test_curve_is_the_optimum():
    r = np.random.Generator(np.random.PCG64(3))
    rate, good = r.normal(0, 0.1, 400), r.random(400) < 0.7
    rate += 0.1 * good
    a, b, prior = quality.curve(rate, good)
    assert prior == good.mean() and b > 0
    loss = lambda a, b: np.logaddexp(0, a + b * rate).sum() - good @ (a + b * rate) + quality.SLOPE_PRIOR * (b * rate.std()) ** 2 / 2
    assert all(loss(a, b) <= loss(a + x, b + y) + 1e-9 for x in (-0.01, 0, 0.01) for y in (-0.1, 0, 0.1))
    assert quality.curve(rate, np.ones(400, bool)) is None


def test_quality_defined_cases(spark, docs, rows, empty, clashing):
    known = spark.createDataFrame([(0, 1, 0), (9, 1, 0), (None, 1, 0), (5, None, None), (15, 0, 1), (0, 1, 1)], "doc_id bigint, quality int, toxic int")
    none = known.limit(0)
    out = quality.quality_report(docs, known).collect()
    assert len(out) == len(rows) and not any(x["kept"] for x in out if x["doc_id"] in (3, 4))
    assert quality.keep_good(clashing, known).columns == clashing.columns
    assert quality.quality_report(empty, known).count() == 0
    assert sum(x["kept"] for x in quality.quality_report(docs, none).collect()) == sum(bool(r[1]) for r in rows)


def test_gram_counts():
    texts = ["ab ab cd", "", "x", "ab ab ab ab"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0] + [len(t) for t in texts])
    _, byte_rows, words, word_rows = quality.grams(raw, bounds)
    assert Counter(byte_rows.tolist()) == {0: 5, 3: 8} and Counter(word_rows.tolist()) == {0: 2, 3: 3}
    assert len({b for b, r in zip(words.tolist(), word_rows.tolist()) if r == 3}) == 1


@pytest.mark.parametrize("k", [1, 2, 57, 999, 1000, 5000])
def test_kth_largest_is_exact(spark, k):
    r = random.Random(k)
    values = [r.choice([0.0, r.gauss(0, 1), r.gauss(0, 1e6)]) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert quality.kth_largest(df, "v", k, few=16) == sorted(values, reverse=True)[min(k, 1000) - 1]
