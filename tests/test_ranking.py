"""Table-wide orderings against plain Python, with the range cut forced on small data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from winback.functions import ranking as R


@pytest.fixture(params=["one_range", "many_ranges"])
def cut(request, monkeypatch):
    monkeypatch.setattr(R, "range_count", lambda spark: 40 if request.param == "many_ranges" else 1)


def frame(spark, n=500, hot=True):
    rng = random.Random(7)
    rows = [(i, 0.0 if hot and i % 3 == 0 else round(rng.random() * 50, 1), f"g{0 if i % 3 == 0 else i % 7}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "customer_id long, v double, g string").repartition(5)


def test_running_totals(spark, cut):
    rows, df = frame(spark)
    got = R.ordered_totals(df, [("v", True), ("customer_id", False)], {"k": F.lit(1), "s": F.col("v")}).collect()
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    total, want = 0.0, {}
    for k, r in enumerate(order, 1):
        total += r[1]
        want[r[0]] = (k, round(total, 6))
    assert {r["customer_id"]: (r["k"], round(r["s"], 6)) for r in got} == want


def test_running_totals_per_group(spark, cut):
    rows, df = frame(spark)
    got = {r["customer_id"]: r["k"] for r in R.ordered_totals(df, [("v", False), ("customer_id", False)], {"k": F.lit(1)}, by=["g"]).collect()}
    want = {}
    for g in {r[2] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[2] == g), key=lambda r: (r[1], r[0])), 1):
            want[r[0]] = k
    assert got == want


def test_rank_pct_average_ties(spark, cut):
    rows, df = frame(spark)
    got = {r["customer_id"]: r["p"] for r in R.with_rank_pct(df, {"v": "p"}).collect()}
    v = np.array([r[1] for r in rows])
    for cid, x, _ in rows:
        below, same = (v < x).sum(), (v == x).sum()
        assert got[cid] == pytest.approx((below + (same + 1) / 2) / len(v))


def test_quantiles_interpolate(spark, cut):
    rows, df = frame(spark)
    probs = [0.0, 0.01, 0.25, 0.5, 0.8, 0.99, 1.0]
    assert R.quantile_values(df, "v", probs) == pytest.approx(list(np.quantile([r[1] for r in rows], probs)))
    by = {r["g"]: r["q0"] for r in R.exact_quantiles(df, ["v"], [0.5], by=["g"]).collect()}
    for g in by:
        assert by[g] == pytest.approx(np.median([r[1] for r in rows if r[2] == g]))


@pytest.mark.parametrize("n,want", [(4, "LMHH"), (5, "LLMHH"), (7, "LLMMHHH")])
def test_terciles_of_small_sizes(spark, n, want):
    df = spark.range(1, n + 1).select(R.tercile(F.col("id"), n).alias("t"), "id")
    assert "".join(r["t"][0] for r in df.orderBy("id").collect()) == want


def test_previous_row_over_day_bounds(spark):
    rows = [(1, "2024-01-01 10:00:00", "a"), (1, "2024-01-01 11:00:00", "b"), (1, "2024-01-05 09:00:00", "c"), (2, "2024-01-02 00:00:00", "x")]
    df = spark.createDataFrame(rows, "customer_id long, t string, e string").withColumn("t", F.col("t").cast("timestamp"))
    got = {(r["customer_id"], r["e"]): r["p"] for r in R.previous_in_key(df, ["customer_id"], "t", {"e": "p"}).collect()}
    assert got == {(1, "a"): None, (1, "b"): "a", (1, "c"): "b", (2, "x"): None}


def test_plan_does_not_grow_with_the_rows(spark, monkeypatch):
    plans = []
    for n in (50, 30_000):
        df = spark.range(n).select(F.col("id").alias("customer_id"), (F.col("id") * 7919 % 30_011).cast("double").alias("v"))
        got = R.ordered_totals(df, [("v", True), ("customer_id", False)], {"k": F.lit(1)})
        assert tuple(got.agg(F.min("k"), F.max("k"), F.count_distinct("k")).first()) == (1, n, n)
        plans.append(len(got._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(plans[0] - plans[1]) < 50


def test_cdf_of_columns_of_different_reach(spark, cut):
    rows = [(i, float(i % 5), None if i % 3 else float(-i)) for i in range(200)]
    df = spark.createDataFrame(rows, "customer_id long, a double, b double")
    got = {(r["col"], r["value"]): (r["n_value"], r["n_upto"], r["n_total"]) for r in R.value_cdf(df, ["a", "b"]).collect()}
    for c, k in (("a", 1), ("b", 2)):
        v = [r[k] for r in rows if r[k] is not None]
        assert {x: y for (col, x), y in got.items() if col == c} == {x: (v.count(x), sum(y <= x for y in v), len(v)) for x in set(v)}


def test_descending_keys_of_any_type(spark, cut):
    """NULL comes last; long numbers keep all digits; texts and times turn round."""
    n = 80
    rows = [(i, None if i % 9 == 0 else (1 << 60) + i % 7, None if i % 5 == 0 else "ab"[: i % 3] + "é" * (i % 2), None if i % 4 == 0 else float(i % 6)) for i in range(n)]
    df = spark.createDataFrame(rows, "customer_id long, big long, t string, x double").withColumn("at", F.timestamp_seconds(F.col("customer_id") % 11))
    for k, name in ((1, "big"), (2, "t"), (3, "x")):
        for down in (True, False):
            got = {r["customer_id"]: r["k"] for r in R.ordered_totals(df, [(name, down), ("customer_id", False)], {"k": F.lit(1)}).collect()}
            known = sorted((r for r in rows if r[k] is not None), key=lambda r: r[0])
            known.sort(key=lambda r: r[k].encode() if isinstance(r[k], str) else r[k], reverse=down)
            order = known + [r for r in rows if r[k] is None]
            assert got == {r[0]: i for i, r in enumerate(order, 1)}, (name, down)
    got = {r["customer_id"]: r["k"] for r in R.ordered_totals(df, [("at", True), ("customer_id", False)], {"k": F.lit(1)}).collect()}
    assert got == {i: k for k, i in enumerate(sorted(range(n), key=lambda i: (-(i % 11), i)), 1)}
