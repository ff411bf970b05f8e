"""Small document tables with awkward rows: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

import pytest

WORDS = "the of river stone light water garden window morning paper bridge letter market forest silver quiet".split()
CLASHES = ["row", "fp", "rep", "key", "cell", "block", "_id", "_text", "size", "range", "draw", "target", "grams", "pos", "l", "s", "a", "piece", "length", "host", "node", "component", "c0"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", str(rng.randrange(90))]) for _ in range(n))


def awkward():
    rng = random.Random(3)
    shared = prose(rng, 60)
    texts = [None, "", " \t\n", "123 456", "One", "ÀÉ ß   x", "a" * 400, "a" * 1300, "line one\nline one\n\nline two\nline one", shared, shared, shared + " x", "Zz " + shared[7:],
             prose(rng, 40) + shared + prose(rng, 40), "née " * 300, "MIT License and the Apache\nLicense; general public license. mit license", "general\x00public license mit  license",
             prose(rng, 20000), "<|endoftext|> marks " + prose(rng, 30), "日本語のテキスト " * 40, "x y\x0bz\x0cq\x85r", prose(rng, 9), prose(rng, 10)]
    texts += [prose(rng, rng.randrange(1, 300)) for _ in range(30)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 7 % 101, t, [None, "en", "fr", ""][i % 4], [None, "s1", "é", "", "s2"][i % 5], None if t is None else len(t)))
    rows += [rows[9], rows[9], rows[0]]                    # repeated rows
    rows.append((None, shared, None, None, None))          # no id
    return [(*r, *[f"clash {k}" for k in range(len(CLASHES))]) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
