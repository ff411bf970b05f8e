"""Hard negatives against all pairs in whole numbers, and the curve and bounds behind the blocks."""

from collections import Counter
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from winback.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, tile string, block string, ids string, dim string, id string"


def table(rng, dim=12):
    centres = rng.normal(size=(6, dim))
    vecs = [centres[k % 6] * 0.3 + rng.normal(size=dim) * (0.02 if k % 3 else 0.4) for k in range(260)]
    rows = [(k, [float(x) for x in np.float32(v)], int(rng.integers(3)) if k % 2 else 0) for k, v in enumerate(vecs)]
    rows += [(1000 + 10 * k, rows[5][1], k % 2) for k in range(30)]               # copies under other ids and labels
    rows += [rows[0], rows[0], rows[20], (-40, rows[3][1], 1), (30, rows[7][1], 2)]   # repeated rows, one id with two vectors
    bad = [None, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    rows += [(2000 + 10 * k, v, 0) for k, v in enumerate(bad)] + [(2100, rows[1][1], None), (None, rows[1][1], 0)]
    rows += [(3000 + k, [float(k - 5), 2.0], k % 2) for k in range(0, 25)] + [(3100, [], 0), (3110, [], 0), (3120, [], 1)]
    rows += [(4000, [9e30] * dim, 0), (4010, [-9e30] * dim, 0), (4020, [1e5] * dim, 1)]
    rows += [(5000, [0.0] * dim, 0), (5010, [0.0] * dim, 7), (5020, [1.0] * 3, 0), (5030, [1.0] * 3, 9)]
    return [(i, v, lab, *["clash"] * 5) for i, v, lab in rows]


def brute(rows, positives=5, take=5, low=80, high=100, every=10):
    use = [(i, lab, [floor(max(-65536.0, min(65536.0, x)) * 256) for x in v]) for i, v, lab, *_ in rows
           if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, lab, v) in enumerate(use):
        if i % every:
            continue
        others = [(-sum(x * y for x, y in zip(v, w)), j, m == lab) for b, (j, m, w) in enumerate(use) if b != a and len(w) == len(v)]
        for p, pid, _ in sorted(x for x in others if x[2])[:positives]:
            hard = sorted(x[:2] for x in others if not x[2] and low * -p <= 100 * -x[0] <= high * -p)[:take]
            out += [(i, pid, r + 1, n, -p, -s) for r, (s, n) in enumerate(hard)]
    return Counter(out)


@pytest.mark.parametrize("block, tile, run, zones", [(512, 1024, 32, 1024), (8, 5, 2, 3)])
def test_all_pairs(spark, monkeypatch, block, tile, run, zones):
    for name, value in (("BLOCK", block), ("TILE", tile), ("RUN", run), ("ZONES", zones)):
        monkeypatch.setattr(negatives, name, value)
    rows = table(np.random.default_rng(6))
    got = Counter(tuple(r) for r in negatives.mined(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0).collect())
    want = brute(rows)
    assert len(want) > 300
    assert got == want, ((got - want).most_common(3), (want - got).most_common(3))


def test_other_windows(spark):
    rows = table(np.random.default_rng(7))[:200]
    got = Counter(tuple(r) for r in negatives.mined(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, 2, 3, 33, 91).collect())
    assert got == brute(rows, 2, 3, 33, 91)


def test_empty(spark):
    assert negatives.mined(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1, *["c"] * 5)], SCHEMA)
    assert negatives.mined(alone, F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.mined(alone, F.lit(False)).collect() == []


def test_blocks_are_left_out(spark, monkeypatch):
    """Clusters far apart: most blocks are in no anchor's windows, and nothing is lost."""
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "TILE", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 8))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(k, [float(x) for x in np.float32(centres[k % 16] + rng.normal(size=8) * 0.02)], k // 16 % 3, *["c"] * 5) for k in range(960)]
    df = spark.createDataFrame(rows, SCHEMA)
    stored = negatives.blocks(negatives.usable(df, F.col("vec_id") % 10 == 0))
    first = negatives.tiles(stored, 6)
    assert negatives.chosen(first, stored, True).count() * 2 < first.count() * stored.count()
    assert Counter(tuple(r) for r in negatives.mined(df, F.col("vec_id") % 10 == 0).collect()) == brute(rows)


@pytest.mark.parametrize("axes, bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_takes_single_steps(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    place = negatives.hilbert(grid, bits)
    assert sorted(place.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, x = rng.integers(-200, 200, (9, 5)), rng.integers(-200, 200, (40, 5))
    least, greatest = negatives.bounds(a, x.min(0)[None], x.max(0)[None])
    scores = a @ x.T
    assert (least[:, 0] <= scores.min(1)).all() and (greatest[:, 0] >= scores.max(1)).all()


def test_percent_is_exact():
    scores = np.array([0, 1, 99, 101, -7, 1 << 61, -(1 << 61)])
    assert negatives.percent(scores, 80, True).tolist() == [-(-80 * int(s) // 100) for s in scores]
    assert negatives.percent(scores, 80, False).tolist() == [80 * int(s) // 100 for s in scores]
