"""Embedding near-dedup against all pairs in double precision."""

from collections import Counter

import numpy as np
import pytest

from winback.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node string, tile string, n string, first string, dim string"


def table(rng, dim=24):
    base = rng.normal(size=(60, dim))
    near = [b + rng.normal(size=dim) * s for b in base[:25] for s in (0.05, 0.25, 0.33)]
    chain = [base[30] + k * 0.12 * base[31] for k in range(12)]
    vecs = [*base, *near, *chain, base[0], base[0], base[1] * 3.5, -base[2]]
    rows = [(int(i), [float(x) for x in np.float32(v)]) for i, v in zip(rng.permutation(1000)[: len(vecs)] - 20, vecs)]
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0]]
    rows += [(2000 + k, v) for k, v in enumerate(bad)]
    rows += [rows[0], (None, rows[0][1]), (None, [9.0, -1.0, 2.0])]
    return [(i, v, k % 3, *["clash"] * 5) for k, (i, v) in enumerate(rows)]


def brute(rows, threshold):
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, *_ in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                link[i, j] = link[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold
    label = np.arange(n)
    reach = link | np.eye(n, dtype=bool)
    for _ in range(n):
        label = np.array([label[reach[i]].min() for i in range(n)])
    out = []
    for i, (vid, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        # rows of one vec_id are one name
        part = min(ids) if vid is not None else None
        out.append((vid, int(link[i].sum()), part, vid is not None and vid == part))
    return out


@pytest.mark.parametrize("tile, strip", [(4096, 512), (16, 5)])
def test_links(spark, monkeypatch, tile, strip):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "STRIP", strip)
    rows = table(np.random.default_rng(4))
    got = Counter(tuple(r) for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    want = Counter(brute(rows, 0.95))
    assert got == want, ((got - want).most_common(4), (want - got).most_common(4))


def test_boxes_drop_no_link(spark, monkeypatch):
    """Clustered vectors, small tiles: far tiles are not compared, and nothing is lost."""
    monkeypatch.setattr(vectors, "TILE", 8)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16))
    rows = [(k, [float(x) for x in np.float32(centres[k % 12] + rng.normal(size=16) * 0.04)], 0, *["c"] * 5) for k in range(240)]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks = vectors.tiles(vectors.folded(df)[1])
    n = blocks.count()
    assert vectors.near_tiles(blocks, 0.95).count() < n * (n + 1) // 2
    assert Counter(tuple(r) for r in vectors.near_duplicates(df).collect()) == Counter(brute(rows, 0.95))


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pairs_of_tiles_move_no_vectors(spark, monkeypatch):
    """Pairs of tiles are shuffled as numbers, so disk follows the table and not the pairs; cells that hold fewer tiles than they meet read them again."""
    monkeypatch.setattr(vectors, "TILE", 8)
    plans, columns, cut = {}, {}, vectors.cut

    def watched(df, name):
        plans[name] = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" not in x]
        columns[name] = df.columns
        return cut(df, name)
    monkeypatch.setattr(vectors, "cut", watched)
    rows = table(np.random.default_rng(5))
    got = Counter(tuple(r) for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == Counter(brute(rows, 0.95))
    assert not [x for x in plans["vector-links"] if any(f"{c}#" in x for c in ("given", "turned", "nodes"))]
    assert all("vec" not in c for c in columns.values()), columns      # tiles alone keep vectors


def test_copies_share_a_part_whatever_is_beside_them():
    rng = np.random.default_rng(1)
    x, axis = np.float32(rng.normal(size=(301, 37))).astype(float), rng.normal(size=37)
    whole = vectors.along(x, axis)
    assert all(vectors.along(x[k: k + n], axis).tolist() == whole[k: k + n].tolist() for k in range(0, 300, 7) for n in (1, 2, 5))
    assert np.allclose(whole, vectors.unit(x) @ axis, atol=1e-4)
