"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic); raking scales the cells by
turns until every marginal has its target.  A cell's weight divided by its
tokens is its ratio; a document is drawn with probability min(1, scale x ratio),
where scale is solved so that the expected tokens are a given share of all.

Targets are given as name -> share for each marginal, or follow from the data:
a group's share is raised to a power below 1, which lifts small groups.  Targets
that contradict each other (a source all in one language, say) cannot all be met;
``gap`` in the report is the largest distance of a marginal from its target.

Without a topic column topics are found here: texts are sets of hashed words,
weighted by rarity, as vectors of length 1; what a vector has beyond the mean of its
language is clustered (k-means, ``TOPICS`` centres, by likeness to them), so that topics
are not languages again.  Rarities, means, first centres and centres come from every row
that has words: the buckets of all texts are written once, and each round reads them all,
until no centre moves or ``TOPIC_ROUNDS`` rounds are done.  Sums are of whole numbers, so they do not depend on the order of rows.  Every text is
assigned to the nearest centre.

Cells up to ``DRIVER_CELLS`` in number (they are counted first) are raked on the
driver and joined by broadcast; more of them are raked by Spark, and joined so that
cells with many rows are broadcast and the others shuffled.  Both ways take the
same steps and give the same numbers.

Defined results: a null source or language is a group of its own; null and empty
texts and texts without words have no tokens, topic 0, and their cells ratio 1;
repeated rows are drawn alike, since the draw is a hash of (doc_id, text); rows of
one cell (ties) have one probability; very long texts are read whole; an empty
table gives an empty result; further columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bytes_of, hashed_words, join_counted, mixed, packed, staged, unstage, whole_text, words

TOPICS = 8
TOPIC_BUCKETS = 1 << 12
TOPIC_ROUNDS = 30
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
TOKEN_SHARE = 0.6
ROUNDS = 200
CLOSE = 1e-9
DRIVER_CELLS = 50_000
#: Texts whose buckets are marked at a time; topics are learned from all texts.
TOPIC_DOCS = 500
#: Up to so many languages have their means on the driver, else in a table.
TOPIC_LANGS = 128
#: Tasks of a round at most: each sends the driver its sums, 32 kB a centre.
MOST_TASKS = 256
#: Rows that a task names at a time for the next centre; if none of them can be one, it names those that follow.
FAR_ROWS = 64
SEED = 2


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different word buckets of the texts in order, each text's bounds among them, and its number of words."""
    hashes, ends = hashed_words(*bytes_of(texts))
    bucket, parts, sizes = (hashes >> np.uint64(52)).astype(np.int64), [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    for at in range(0, len(texts), TOPIC_DOCS):
        own = ends[at : at + TOPIC_DOCS + 1]
        held = np.zeros((len(own) - 1) * TOPIC_BUCKETS, bool)
        held[np.repeat(np.arange(0, len(held), TOPIC_BUCKETS), np.diff(own)) + bucket[own[0] : own[-1]]] = True
        place = np.flatnonzero(held)
        parts.append((place % TOPIC_BUCKETS).astype(np.uint16))
        sizes.append(np.diff(np.searchsorted(place, np.arange(0, len(held) + 1, TOPIC_BUCKETS))))
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), np.diff(ends)


def _featured(docs: DataFrame) -> DataFrame:
    """The columns of docs but its text, with n (words) and buckets (16-bit numbers), written."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("n long, buckets binary")
    def found(texts: pa.Array) -> pa.Array:
        bucket, ends, n = word_buckets(texts)
        held = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * 2).astype(np.int32)), pa.py_buffer(bucket)])
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), held], ["n", "buckets"])

    rest = [c for c in docs.columns if c != "text"]
    return staged(docs.select(*rest, found(whole_text()).alias("_f")).select(*rest, "_f.n", "_f.buckets"), "buckets")


def _unpacked(held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a batch of ``_featured``, and each row's bounds among them."""
    held = held.cast(pa.large_binary())
    _, offsets, data = held.buffers()
    ends = np.frombuffer(offsets, np.int64)[held.offset : held.offset + len(held) + 1] // 2 if len(held) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint16)[ends[0] : ends[-1]], ends - ends[0]


def _by_language(langs: pa.Array) -> tuple[list[str | None], np.ndarray]:
    """The languages of a batch, and the place of each row's among them."""
    coded = langs.cast(pa.string()).dictionary_encode(null_encoding="encode")
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


class Topics:
    """Weights of the word buckets, centres, and what the mean of each language (of all: ``usual``) has of each centre."""

    def __init__(self, weight: np.ndarray, centres: np.ndarray, means: dict, usual: np.ndarray):
        self.weight, self.centres, self.means, self.usual = weight, centres, means, usual
        self._table = np.ascontiguousarray(np.column_stack([weight[:, None] * centres, weight * weight]).T, np.float32)

    def near(self, bucket: np.ndarray, ends: np.ndarray, langs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows with words, the length of each one's vector, and how much of each centre it has beyond its language."""
        full = np.flatnonzero(np.diff(ends))
        if not len(full):
            return full, np.zeros(0), np.zeros((0, self.centres.shape[1]))
        at = bucket.astype(np.intp)
        sums = np.stack([np.add.reduceat(column.take(at), ends[full]) for column in self._table], 1).astype(float)
        size = np.maximum(np.sqrt(sums[:, -1]), 1e-12)
        names, own = _by_language(langs)
        return full, size, sums[:, :-1] / size[:, None] - np.array([self.means.get(x, self.usual) for x in names])[own[full]]

    def assign(self, bucket: np.ndarray, ends: np.ndarray, langs: pa.Array) -> np.ndarray:
        """Topic of each row."""
        out = np.zeros(len(ends) - 1, np.int32)
        full, _, near = self.near(bucket, ends, langs)
        out[full] = near.argmax(1)
        return out


#: Sums of vectors are taken in whole numbers of this part, so that no order of rows changes them.
PART = float(1 << 24)
FOUND = "k int, lang string, n long, score double, data binary"


def _pass(held: DataFrame, work) -> DataFrame:
    """What ``work`` yields, as tuples of ``FOUND``, for the (langs, buckets, bounds) of each task's batches."""

    def run(batches):
        mine = ((b.column(0), *_unpacked(b.column(1))) for b in batches)
        rows = work(mine)
        kind = pa.schema([("k", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("score", pa.float64()), ("data", pa.binary())])
        while some := list(islice(rows, 64)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), kind)], schema=kind)

    return held.select("lang", "buckets").coalesce(min(MOST_TASKS, 2 * held.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, FOUND)


def _holders(batches):
    """Rows with words, and of these how many hold each bucket."""
    n, held = 0, np.zeros(TOPIC_BUCKETS, np.int64)
    for _, bucket, ends in batches:
        n += np.count_nonzero(np.diff(ends))
        held += np.bincount(bucket, minlength=TOPIC_BUCKETS)
    yield None, None, int(n), None, held.tobytes()


def _vector_sums(bucket: np.ndarray, ends: np.ndarray, weight: np.ndarray, full: np.ndarray, size: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sum of the unit vectors of each group of rows, in ``PART``."""
    count = np.diff(ends)[full]
    value = np.rint(weight.take(bucket) * np.repeat(PART / size, count))
    return np.bincount(bucket + np.repeat(group * TOPIC_BUCKETS, count), value, groups * TOPIC_BUCKETS).reshape(groups, TOPIC_BUCKETS)


def _language_sums(topics: Topics):
    """For each language its rows and the sum of their vectors; a language may come several times."""

    def work(batches):
        sums, n = {}, {}
        for langs, bucket, ends in batches:
            full, size, _ = topics.near(bucket, ends, langs)
            names, own = _by_language(langs)
            for at in range(0, len(names), 64):
                some = (own[full] >= at) & (own[full] < at + 64)
                keep = np.repeat(some, np.diff(ends)[full])
                group, count = own[full][some] - at, np.diff(ends)[full][some]
                if not len(group):
                    continue
                got = _vector_sums(bucket[keep], np.concatenate(([0], np.cumsum(count))), topics.weight, np.arange(len(count)), size[some], group, min(64, len(names) - at))
                for j in np.unique(group):
                    x = names[at + j]
                    sums[x] = sums.get(x, 0) + got[j]
                    n[x] = n.get(x, 0) + int((group == j).sum())
                if len(sums) > 256:
                    yield from ((None, x, n[x], None, sums[x].astype(np.int64).tobytes()) for x in sums)
                    sums, n = {}, {}
        yield from ((None, x, n[x], None, sums[x].astype(np.int64).tobytes()) for x in sums)

    return work


def _far_rows(topics: Topics, step: int, alone: frozenset, after: tuple | None = None):
    """Rows drawn by how little they are like any centre: least -log(unit) / distance first, the unit a hash of the row.

    Only rows that follow ``after`` in this order, of equal rows one, and none of languages
    ``alone``.  A task that may have more marks its last by 1 in ``n``.
    """

    def work(batches):
        best = set()
        for langs, bucket, ends in batches:
            full, _, near = topics.near(bucket, ends, langs)
            if not len(full):
                continue
            word = mixed(bucket.astype(np.uint64) + np.uint64((step + 1) * TOPIC_BUCKETS))
            unit = ((mixed(np.add.reduceat(word, ends[full])) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
            far = np.maximum(1 - near.max(1, initial=0), 1e-9)
            score, (names, lang) = -np.log(unit) / far, _by_language(langs)
            some = np.array([x not in alone for x in names])[lang[full]]
            if after is not None:
                some &= score >= after[0]
            if len(best) == FAR_ROWS:
                some &= score <= max(best)[0]
            order, new = np.flatnonzero(some)[np.argsort(score[some], kind="stable")], set()
            for j in order:
                if len(new) >= FAR_ROWS and score[j] > max(new)[0]:
                    break
                x = names[lang[full[j]]]
                key = float(score[j]), bucket[ends[full[j]] : ends[full[j] + 1]].tobytes(), x is not None, x or ""
                if after is None or key > after:
                    new.add(key)
            best = set(sorted(best | new)[:FAR_ROWS])
        for at, (score, data, named, x) in enumerate(sorted(best), 1):
            yield None, x if named else None, int(at == FAR_ROWS), score, data

    return work


def _centre_sums(topics: Topics):
    """For each centre the sum of the vectors nearest to it, and the number of these in each language."""

    def work(batches):
        k = topics.centres.shape[1]
        sums, n = np.zeros((k, TOPIC_BUCKETS)), Counter()
        for langs, bucket, ends in batches:
            full, size, near = topics.near(bucket, ends, langs)
            if not len(full):
                continue
            own = near.argmax(1)
            sums += _vector_sums(bucket, ends, topics.weight, full, size, own, k)
            names, lang = _by_language(langs)
            pairs, count = np.unique(lang[full].astype(np.int64) * k + own, return_counts=True)
            for x, c in zip(pairs.tolist(), count.tolist()):
                n[names[x // k], x % k] += c
        yield from ((j, None, None, None, sums[j].astype(np.int64).tobytes()) for j in range(k))
        yield from ((j, x, c, None, None) for (x, j), c in n.items())

    return work


def _summed(rows) -> np.ndarray:
    return np.sum([np.frombuffer(r["data"], np.int64) for r in rows], axis=0, dtype=np.int64)


class _FewMeans:
    """Means of the languages on the driver."""

    def __init__(self, rows: DataFrame, langs: dict[str | None, int]):
        self.names = sorted(langs, key=repr)
        at, sums = {x: i for i, x in enumerate(self.names)}, np.zeros((len(langs), TOPIC_BUCKETS), np.int64)
        for r in rows.toLocalIterator():
            sums[at[r["lang"]]] += np.frombuffer(r["data"], np.int64)
        self.at, self.means = at, sums / PART / np.array([langs[x] for x in self.names])[:, None]

    def drop(self) -> None:
        pass

    def of(self, lang: str | None) -> np.ndarray:
        return self.means[self.at[lang]]

    def shares(self, centres: np.ndarray) -> dict:
        return dict(zip(self.names, self.means @ centres))

    def sums(self, found: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
        """From the rows of ``_centre_sums``: the vectors' sums, and the sums of their languages' means."""
        vectors, n = np.zeros((k, TOPIC_BUCKETS), np.int64), np.zeros((k, len(self.names)))
        for r in found.collect():
            if r["data"] is not None:
                vectors[r["k"]] += np.frombuffer(r["data"], np.int64)
            else:
                n[r["k"], self.at[r["lang"]]] += r["n"]
        return vectors / PART, n @ self.means


class _ManyMeans:
    """The same for languages too many for the driver: a table (lang, bucket, mean)."""

    def __init__(self, rows: DataFrame, langs: DataFrame):
        @F.arrow_udf("array<struct<bucket: int, v: long>>")
        def entries(data: pa.Array) -> pa.Array:
            sums = [np.frombuffer(x, np.int64) for x in data.to_pylist()]
            held = [np.flatnonzero(x) for x in sums]
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(held).astype(np.int32)), pa.array(np.concatenate([x[h] for x, h in zip(sums, held)]))], ["bucket", "v"])
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(h) for h in held]))).astype(np.int32)), pairs)

        sums = rows.select("lang", F.explode(entries("data")).alias("e")).groupBy("lang", "e.bucket").agg(F.sum("e.v").alias("v"))
        langs = langs.select(F.col("lang").alias("_l"), "count")
        means = sums.join(langs, F.col("lang").eqNullSafe(F.col("_l"))).select("lang", "bucket", (F.col("v") / F.lit(PART) / F.col("count")).alias("mean"))
        self.means = staged(means, "means")

    def drop(self) -> None:
        unstage(self.means)

    def of(self, lang: str | None) -> np.ndarray:
        out = np.zeros(TOPIC_BUCKETS)
        for r in self.means.where(F.col("lang").eqNullSafe(F.lit(lang))).collect():
            out[r["bucket"]] = r["mean"]
        return out

    def shares(self, centres: np.ndarray) -> dict:
        table = self.means.sparkSession.createDataFrame([(b, c) for b, c in enumerate(centres.tolist())], "bucket int, c array<double>")
        part = [F.sum(F.round(F.col("mean") * F.col("c")[j] * F.lit(2.0**40)).cast("long")).alias(f"c{j}") for j in range(centres.shape[1])]
        return {r[0]: np.array(r[1:]) / 2.0**40 for r in self.means.join(F.broadcast(table), "bucket").groupBy("lang").agg(*part).toLocalIterator()}

    def sums(self, found: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
        found, vectors, means = staged(found, "found"), np.zeros((k, TOPIC_BUCKETS), np.int64), np.zeros((k, TOPIC_BUCKETS))
        for r in found.where("data IS NOT NULL").toLocalIterator():
            vectors[r["k"]] += np.frombuffer(r["data"], np.int64)
        n = found.where("data IS NULL").groupBy("k", F.col("lang").alias("_l")).agg(F.sum("n").alias("n"))
        part = F.sum(F.round(F.col("mean") * F.col("n") * F.lit(PART)).cast("long"))
        for r in self.means.join(n, F.col("lang").eqNullSafe(F.col("_l"))).groupBy("k", "bucket").agg(part.alias("v")).collect():
            means[r["k"], r["bucket"]] = r["v"] / PART
        unstage(found)
        return vectors / PART, means


def _unit(vector: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vector)
    return vector / size if size > 1e-6 else np.zeros_like(vector)


def _learned(held: DataFrame, few: int | None = None) -> Topics:
    """Topics of the rows of ``_featured``: every number is a sum over all of them."""
    counts = _pass(held, _holders).collect()
    n = sum(r["n"] for r in counts)
    weight = np.log((1 + n) / (1 + _summed(counts))) if counts else np.zeros(TOPIC_BUCKETS)
    none = Topics(weight, np.zeros((TOPIC_BUCKETS, 1)), {}, np.zeros(1))
    if not n:
        return none
    few = TOPIC_LANGS if few is None else few
    text = F.xxhash64("buckets")
    langs = staged(held.where("n > 0").groupBy("lang").agg(F.count("*").alias("count"), (F.min(text) == F.max(text)).alias("alone")), "langs")
    # Languages of one text: none of their rows differs from the mean.
    alone = frozenset(r["lang"] for r in langs.where("alone").select("lang").collect())
    some, rows = langs.limit(few + 1).collect(), staged(_pass(held, _language_sums(none)), "sums")
    means = _ManyMeans(rows, langs) if len(some) > few else _FewMeans(rows, {r["lang"]: r["count"] for r in some})
    unstage(rows)

    def topics(centres: np.ndarray) -> Topics:
        return Topics(weight, centres, means.shares(centres) if centres.shape[1] else {}, np.zeros(centres.shape[1]))

    def next_centre(centres: np.ndarray) -> np.ndarray | None:
        """What the first row drawn that differs from its language and from the centres has beyond its language; None if no row does."""
        after, known = None, topics(centres)
        while True:
            found = _pass(held, _far_rows(known, centres.shape[1], alone, after)).collect()
            drawn = sorted({(r["score"], bytes(r["data"]), r["lang"] is not None, r["lang"] or "") for r in found})
            # What follows the end of a task that may have more is not known yet.
            ends = [(r["score"], bytes(r["data"]), r["lang"] is not None, r["lang"] or "") for r in found if r["n"]]
            after = min(ends, default=None)
            for key in drawn if after is None else drawn[: drawn.index(after) + 1]:
                point, bucket = np.zeros(TOPIC_BUCKETS), np.frombuffer(key[1], np.uint16)
                point[bucket] = weight[bucket]
                new = _unit(_unit(point) - means.of(key[3] if key[2] else None))
                if new.any() and (not centres.size or (new @ centres).max() < 1 - 1e-6):
                    return new
            if after is None:
                return None

    centres = np.zeros((TOPIC_BUCKETS, 0))
    while centres.shape[1] < TOPICS and (new := next_centre(centres)) is not None:
        centres = np.column_stack([centres, new])
    unstage(langs)
    if not centres.size:
        means.drop()
        return none
    for _ in range(TOPIC_ROUNDS):
        vectors, usual = means.sums(_pass(held, _centre_sums(topics(centres))), centres.shape[1])
        new = np.column_stack([x if (x := _unit(v - u)).any() else c for v, u, c in zip(vectors, usual, centres.T)])
        same, centres = np.allclose(new, centres), new
        if same:
            break
    out = topics(centres)
    out.usual = vectors.sum(0) / n @ centres
    means.drop()
    return out


def learn_topics(docs: DataFrame, few: int | None = None) -> Topics:
    """Topics of docs (text, lang), from all rows; word buckets are written, and sums over them reach the driver."""
    held = _featured(docs.select("text", F.col("lang").cast("string").alias("lang")))
    out = _learned(held, few)
    unstage(held)
    return out


def _assigned(held: DataFrame, topics: Topics) -> Column:
    """Topic of each row of ``_featured``."""
    shared = held.sparkSession.sparkContext.broadcast(topics)

    @F.arrow_udf("int")
    def found(buckets: pa.Array, langs: pa.Array) -> pa.Array:
        return pa.array(shared.value.assign(*_unpacked(buckets), langs), pa.int32())

    return found("buckets", "lang")


def _with_topics(docs: DataFrame, topics: Topics) -> DataFrame:
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(topics)

    @F.arrow_udf("topic int, tokens double")
    def found(texts: pa.Array, langs: pa.Array) -> pa.Array:
        bucket, ends, n = word_buckets(texts)
        return pa.StructArray.from_arrays([pa.array(shared.value.assign(bucket, ends, langs), pa.int32()), pa.array(n.astype(float))], ["topic", "tokens"])

    lang = F.col("lang").cast("string")
    return docs.withColumn("_found", found(whole_text(), lang)).withColumns({"_topic": F.col("_found.topic"), "_tokens": F.col("_found.tokens")}).drop("_found")


def described(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """docs with _topic and _tokens."""
    if topic is not None:
        return docs.withColumn("_topic", topic).withColumn("_tokens", F.size(words(whole_text())).cast("double"))
    return _with_topics(docs, learn_topics(docs.select("text", "lang")))


def wanted(tokens: dict, power: float, given: dict | None) -> dict:
    """name -> share, over the names that have tokens."""
    raw = {k: (given.get(k, 0.0) if given else (v / sum(tokens.values())) ** power) for k, v in tokens.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total else {k: 1 / len(raw) for k in raw}


def rake(keys: list[tuple], tokens: np.ndarray, powers: list[float], given: list[dict | None], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Ratio of fitted to present weight for each cell, and the largest distance of a marginal from its target."""
    weight, sides = tokens / tokens.sum(), []
    for axis, (power, fixed) in enumerate(zip(powers, given)):
        names = sorted({k[axis] for k in keys}, key=repr)
        place = {n: i for i, n in enumerate(names)}
        code = np.array([place[k[axis]] for k in keys])
        target = wanted(dict(zip(names, np.bincount(code, tokens, len(names)))), power, fixed)
        sides.append((code, np.array([target[n] for n in names])))
    for _ in range(rounds):
        worst = 0.0
        for code, target in sides:
            now = np.bincount(code, weight, len(target))
            worst = max(worst, float(np.abs(now - target).max()))
            weight = weight * np.divide(target, now, out=np.zeros_like(target), where=now > 0)[code]
        if worst < CLOSE:
            break
    gap = max(float(np.abs(np.bincount(code, weight, len(target)) - target).max()) for code, target in sides)
    return weight / (tokens / tokens.sum()), gap


def draw_scale(sums, goal: float) -> float:
    """The scale s at which sum(tokens x min(1, s x ratio)) is ``goal``, or at which all that can be drawn is.

    ``sums(s)`` gives the tokens of the cells with s x ratio >= 1, and the sum of tokens x ratio of the others.
    The sum is concave and made of straight pieces, so Newton steps from below reach the solution exactly.
    """
    scale = 0.0
    while True:
        full, rest = sums(scale)
        if rest <= 0 or (new := (goal - full) / rest) <= scale:
            return scale or 1.0
        scale = new


def _rake_frames(cells: DataFrame, names: list[str], powers: list[float], given: list[dict | None]) -> tuple[DataFrame, float]:
    """``rake`` for cells too many for the driver: each round is three small aggregates and joins."""
    total = cells.agg(F.sum("tokens")).first()[0]
    now = cells.withColumn("weight", F.col("tokens") / F.lit(total))
    targets = []
    for name, power, fixed in zip(names, powers, given):
        side = cells.groupBy(name).agg(F.sum("tokens").alias("t"))
        if fixed is None:
            goal = F.pow(F.col("t") / F.lit(total), F.lit(power))
        else:
            goal = F.coalesce(F.get(F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv]), F.col(name)), F.lit(0.0))
        side = side.withColumn("goal", goal)
        whole = side.agg(F.sum("goal")).first()[0]
        targets.append(staged(side.select(F.col(name).alias("_n"), (F.col("goal") / F.lit(whole)).alias("goal")), "target"))
    now = staged(now, "cells")
    for _ in range(ROUNDS):
        before, worst = now, 0.0
        for name, goal in zip(names, targets):
            side = now.groupBy(F.col(name).alias("_m")).agg(F.sum("weight").alias("w"))
            side = side.join(goal, F.col("_m").eqNullSafe(F.col("_n"))).select("_n", (F.col("goal") / F.col("w")).alias("factor"), F.abs(F.col("goal") - F.col("w")).alias("off"))
            side = staged(side, "side")
            worst = max(worst, side.agg(F.max("off")).first()[0])
            now = now.join(side, F.col(name).eqNullSafe(F.col("_n"))).select(*names, "tokens", (F.col("weight") * F.col("factor")).alias("weight"))
            now = staged(now, "cells")
        unstage(before)
        if worst < CLOSE:
            break
    gap = max(now.groupBy(F.col(n).alias("_m")).agg(F.sum("weight").alias("w")).join(goal, F.col("_m").eqNullSafe(F.col("_n"))).agg(F.max(F.abs(F.col("goal") - F.col("w")))).first()[0] for n, goal in zip(names, targets))
    return now.withColumn("ratio", F.col("weight") * F.lit(total) / F.col("tokens")), gap


def _cell(names: list[str]) -> Column:
    """One text for each cell, nulls told apart: JSON leaves them out."""
    return F.to_json(F.struct(*names))


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, token_share: float = TOKEN_SHARE, topic: Column | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """docs with _topic, _tokens, _ratio, _probability, _gap and _drawn."""
    spark, names = docs.sparkSession, ["source", "lang", "_topic"]
    if topic is None:
        held = _featured(docs.select("text", "source", F.col("lang").cast("string").alias("lang")))
        topics = _learned(held)
        counted = held.select("source", "lang", _assigned(held, topics).alias("_topic"), F.col("n").cast("double").alias("_tokens"))
        rows = _with_topics(docs, topics)
    else:
        rows = counted = described(docs, topic)
    cells = staged(counted.groupBy(*names).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("n")), "cells")
    if topic is None:
        unstage(held)
    powers, given = list(POWERS.values()), [(targets or {}).get(k) for k in POWERS]
    scale, gap, full = 1.0, 0.0, cells.where("tokens > 0")
    if cells.count() <= driver_cells:
        got = full.collect()
        ratio, tokens = np.zeros(0), np.array([r["tokens"] for r in got], float)
        if got:
            ratio, gap = rake([tuple(r[n] for n in names) for r in got], tokens, powers, given)
            scale = draw_scale(lambda s: (tokens[s * ratio >= 1].sum(), (tokens * ratio)[s * ratio < 1].sum()), token_share * tokens.sum())
        fitted = spark.createDataFrame([(*(r[n] for n in names), float(x)) for r, x in zip(got, ratio)], "_s string, _l string, _t int, _ratio double")
        rows = rows.join(F.broadcast(fitted), F.col("source").eqNullSafe(F.col("_s")) & F.col("lang").eqNullSafe(F.col("_l")) & F.col("_topic").eqNullSafe(F.col("_t")), "left").drop("_s", "_l", "_t")
    else:
        raked, gap = _rake_frames(full.drop("n"), names, powers, given)

        def sums(s: float) -> tuple[float, float]:
            out = raked.agg(F.sum(F.when(F.lit(s) * F.col("ratio") >= 1, F.col("tokens"))), F.sum(F.when(F.lit(s) * F.col("ratio") < 1, F.col("tokens") * F.col("ratio")))).first()
            return out[0] or 0.0, out[1] or 0.0

        scale = draw_scale(sums, token_share * raked.agg(F.sum("tokens")).first()[0])
        ratios = raked.select(_cell(names).alias("_cell"), F.col("ratio").alias("_ratio"))
        cells = staged(cells.select(_cell(names).alias("_cell"), "n").join(ratios, "_cell", "left"), "cells")
        rows = join_counted(rows.withColumn("_cell", _cell(names)), cells, ["_cell"], drop=("n",)).drop("_cell")
    rows = rows.withColumn("_ratio", F.coalesce("_ratio", F.lit(1.0))).withColumn("_probability", F.least(F.lit(1.0), F.lit(scale) * F.col("_ratio"))).withColumn("_gap", F.lit(gap))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "text"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return rows.withColumn("_drawn", unit < F.col("_probability"))


def mixing_report(docs: DataFrame) -> DataFrame:
    out = mix(docs.select("doc_id", "text", "source", "lang"))
    return out.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").cast("long").alias("n_tokens"), F.col("_ratio").alias("ratio"), F.col("_probability").alias("probability"), F.col("_drawn").alias("drawn"), F.col("_gap").alias("gap"))


def drawn(docs: DataFrame) -> DataFrame:
    """The documents drawn, with the columns they came with."""
    return mix(packed(docs, "doc_id", "text", "source", "lang")).where("_drawn").select("row.*")
