"""Helpers: components, runs of bytes, hashes of spans."""

import random

import numpy as np
import pyarrow as pa

from winback.llm import common


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(500, k) for k in range(501, 900)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(-5, 60), (7, 7)] + [(5000, k) for k in range(2000, 2300)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in label.items() if n != c or any(n in e and e[0] != e[1] for e in edges)}


def test_components_empty(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_text_bytes_and_slices():
    column = pa.array(["ab", None, "", "é", "xyz"])
    for part, texts in ((column, ["ab", "", "", "é", "xyz"]), (column.slice(1, 3), ["", "", "é"]), (column.cast(pa.large_string()), ["ab", "", "", "é", "xyz"])):
        raw, at = common.text_bytes(part)
        assert [raw[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:])] == texts
    assert list(common.slices(np.array([0, 2, 2, 2, 4, 7]), 3)) == [(0, 3), (3, 4), (4, 5)]
    assert list(common.slices(np.array([0]))) == []
    assert list(common.slices(np.zeros(8, np.int64), 3, 3)) == [(0, 3), (3, 6), (6, 7)]


def test_runs_stay_in_rows():
    raw = np.frombuffer(b"ab cd ef", np.uint8)
    start, end = common.runs(common.NOT_SPACE[raw], np.array([0, 1, 1, 5, 8]))
    assert list(zip(start.tolist(), end.tolist())) == [(0, 1), (1, 2), (3, 5), (6, 8)]


def test_span_hashes_depend_on_bytes_alone():
    raw = np.frombuffer(b"banana bandana ban\x00ba", np.uint8)
    spans = [(a, b) for a in range(len(raw)) for b in range(a, len(raw) + 1)]
    h = common.span_hashes(raw, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    names = {}
    for (a, b), x in zip(spans, h.tolist()):
        names.setdefault(raw[a:b].tobytes(), set()).add(x)
    assert all(len(v) == 1 for v in names.values()) and len({v for s in names.values() for v in s}) == len(names)


def test_forest():
    assert common.forest(6, np.array([4, 2]), np.array([2, 5])).tolist() == [0, 1, 2, 3, 2, 2]
