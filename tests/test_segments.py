"""Lines and blocks from the places of words."""

import math
import random

import numpy as np

from quire.operators import segments


def page(turn=0.0, seed=1):
    """Two columns of two paragraphs of three lines of eight words, shuffled; truth: (column, paragraph, line)."""
    words, r = [], random.Random(seed)
    for c in range(2):
        for p in range(2):
            for line in range(3):
                for k in range(8):
                    x, y = c * 300 + k * 24.0, p * 120 + line * 22.0
                    words.append({"x": x * math.cos(turn) - y * math.sin(turn), "y": x * math.sin(turn) + y * math.cos(turn), "w": 18.0, "h": 10.0, "truth": (c, p, line)})
    r.shuffle(words)
    return words


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_lines_and_blocks():
    words = page()
    line = segments.lines_of(words)
    block = segments.blocks_of(words, line)
    assert same_partition(line.tolist(), [w["truth"] for w in words]) and same_partition(block.tolist(), [w["truth"][:2] for w in words])
    # Lines count from the top and, at one height, from the left.
    assert [line[k] for k, w in enumerate(words) if w["truth"] == (1, 0, 0)] == [1] * 8
    assert abs(segments.orientation(words)) < math.pi / 12


def test_turned_page():
    words = page(math.radians(88))
    assert same_partition(segments.lines_of(words).tolist(), [w["truth"] for w in words])


def test_components_and_small_pages():
    r = np.random.Generator(np.random.PCG64(2))
    a, b = r.integers(0, 300, 200), r.integers(0, 300, 200)
    label = list(range(300))
    for _ in range(300):
        for x, y in zip(a, b):
            label[x] = label[y] = min(label[x], label[y])
    assert segments.components(300, a, b).tolist() == label
    assert segments.lines_of([{"x": 1.0, "y": 2.0, "w": 3.0, "h": 4.0}]).tolist() == [0]
    one = [{"x": 0.0, "y": 0.0, "w": 5.0, "h": 5.0}, {"x": 0.0, "y": 0.0, "w": 5.0, "h": 5.0}]
    assert segments.blocks_of(one, segments.lines_of(one)).tolist() == [0, 0]


def test_lines_and_ranges_of_canonical_texts(spark):
    from quire.operators import canonical

    source = spark.createDataFrame([("p", 0, "a", 1.0), ("p", 1, "head", None), ("p", 2, "a", 1.0), ("p", 3, "b", 2.0), ("q", 0, "x", 1.0)], "page string, line_no int, text string, y double")
    lines = spark.createDataFrame([("p", 0, "a", 1.0), ("p", 1, "a", 1.0), ("p", 2, "head", None), ("p", 3, "new", 9.0)], source.schema)
    got = {(r["page"], r["line_no"]): r["source_line"] for r in canonical.aligned_lines(lines, source, ["page"], ["text", "y"]).collect()}
    assert got == {("p", 0): 2, ("p", 1): 0, ("p", 2): 1, ("p", 3): None}
    ranges = spark.createDataFrame([("p", 1, 1, 3, "head"), ("p", 3, 0, 1, None), ("q", 0, 0, 1, None), ("p", 9, 0, 1, None), ("p", 0, 0, 2, None)], "page string, line_no int, start int, end int, expected string")
    got = {(r["page"], r["line_no"]): (r["outcome"], r["reason"], r["offset"]) for r in canonical.mapped_ranges(ranges, source, lines, ["page"], ["text", "y"]).collect()}
    assert got == {("p", 1): ("mapped", None, 5), ("p", 3): ("missing", "line-dropped", None), ("q", 0): ("unsupported", "no-canonical-text", None), ("p", 9): ("missing", "line-out-of-range", None), ("p", 0): ("missing", "bounds", None)}
    other = spark.createDataFrame([("p", "xx ab yy ab", "ab"), ("q", "ab", "ab"), ("r", "none", "ab")], "page string, target string, line_text string")
    asked = other.selectExpr("page", "line_text", "1 AS start", "2 AS end")
    got = {r["page"]: (r["outcome"], r["offsets"]) for r in canonical.mapped_into(asked, other, ["page"]).collect()}
    assert got == {"p": ("ambiguous", [4, 10]), "q": ("mapped", [1]), "r": ("missing", [])}
