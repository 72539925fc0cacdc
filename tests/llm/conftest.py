import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = "row string, _id int, _th int, words string, n int, `set` string, edge int, host string, lines string"


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def cases() -> list[tuple]:
    """Nulls, empty and very long texts, ties, copies, near copies, repeated rows."""
    base, shared = passage(1, 120), passage(2, 60)
    words = base.split()
    near = " ".join(words[:60] + ["other"] + words[61:])
    texts = [
        base, base, near, None, "", "   \n\t ", "one", "one two three four", "line\n" * 30, passage(3, 20_000), passage(4, 40) + "\n" + shared + "\n" + passage(5, 40),
        passage(6, 10) + "\n" + shared + "\n" + passage(7, 90), "Shared LINE of more than twenty chars \nown " + passage(8, 9), "shared line of MORE than twenty chars\n" + passage(9, 9),
        "\tshared line of more than twenty chars", "é日本 ÀÉ " + passage(10, 50), "x" * 3000, "word " * 200, shared, "ends with newline\n", near.upper(),
    ]
    langs = ["en", "de", None, "fr"]
    rows = [(k, t, langs[k % 4], f"src{k % 3}" if k % 5 else None, len(t) if t else 0) for k, t in enumerate(texts)]
    rows.append((None, "a row without an id " + passage(11, 30), "en", "src1", None))
    rows += [rows[2], rows[3], rows[10]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def rows():
    return cases()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "w", 3, "s", 4, "h", "l") for r in rows], f"{DOCS}, {CLASHES}")
