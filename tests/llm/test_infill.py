"""Fill-in-middle against string slicing, and back."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from winback.llm import infill


def plain_python(doc_id, text, seed=1, plain=10, spm=20):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    x = [int(h[i: i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((x[0] % (len(text) + 1), x[1] % (len(text) + 1)))
    if not text or any(m in text for m in infill.MARKS) or x[2] % 100 >= 100 - plain:
        return doc_id, len(text), "plain", None, None, text, text
    p, m, s = text[:a], text[a:b], text[b:]
    if x[3] % 100 < spm:
        return doc_id, len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}", text


def awkward():
    rng = random.Random(5)
    bits = ["<", "<P", "P>", ">", "<S", "<M", "M>", "é", "日", "😀", "a", " ", "\n", "<P>", "<S>", "<M>"]
    texts = ["".join(rng.choices(bits, [4] * 13 + [0.2] * 3, k=rng.randrange(0, 12))) for _ in range(400)] + ["😀" * 5000, "x" * 300_000, "<P>" * 4, None, ""]
    return [(i if i % 50 else None, t) for i, t in enumerate(texts)]


def columns(df):
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")


@pytest.mark.parametrize("move, rows_at_once", [(infill.MOVE_BYTES, infill.MOVE_ROWS), (40, 7)])
def test_documents(docs, rows, monkeypatch, move, rows_at_once):
    monkeypatch.setattr(infill, "MOVE_BYTES", move)
    monkeypatch.setattr(infill, "MOVE_ROWS", rows_at_once)
    got = Counter(tuple(r) for r in columns(infill.restored(infill.transformed(docs))).collect())
    assert got == Counter(plain_python(r[0], r[1]) for r in rows)


def test_marks_and_wide_characters(spark):
    data = awkward()
    got = Counter(tuple(r) for r in columns(infill.restored(infill.transformed(spark.createDataFrame(data, "doc_id long, text string").repartition(4), 7, 25, 50))).collect())
    assert got == Counter(plain_python(*r, 7, 25, 50) for r in data)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty(no_docs):
    assert infill.restored(infill.transformed(no_docs)).collect() == []


def test_displacement_of_empty_parts():
    # parts of 2, 0, 3 and 0 bytes; the empty ones move nothing
    assert infill.displaced(5, np.array([0, 2, 2, 5]), np.array([3, 9, -2, 4])).tolist() == [3, 4, 0, 1, 2]


def test_foreign_output_is_an_error():
    raw = np.frombuffer(b"no marks", np.uint8)
    with pytest.raises(ValueError):
        infill.gathered(raw, np.array([0, 8]), np.array([infill.PSM]))
