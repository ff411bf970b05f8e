"""Selection, recommendation and rank measures against brute force on small frames."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from winback.functions import ranking
from winback.operators import budget as B
from winback.operators import cohort, recommend, survival, uplift
from winback.operators import policy as P


def walk(rows, budget, high_cap=10**9, cap=10**9):
    """The row-by-row walk the rounds must equal."""
    used, spent, high, out = set(), 0.0, 0, []
    for place, cid, cost, kind in rows:
        if len(out) >= cap:
            break
        if cid in used or cost <= 0 or spent + cost > budget or (kind == "high" and high >= high_cap):
            continue
        out.append(place)
        used.add(cid)
        spent += cost
        high += kind == "high"
    return out


@pytest.mark.parametrize("seed", range(2))
def test_greedy_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(25), float(rng.choice([0, 3, 5, 8, 13, 21])), rng.choice(["low", "mid", "high"])) for i in range(1, 81)]
    df = spark.createDataFrame(rows, "place long, customer_id long, coupon_cost double, intervention_intensity string")
    budgets = [7, 40, 111, 5000]
    for high_cap, cap in ((None, None), (3, None), (4, 9)):
        got = B.greedy(df, budgets, high_cap, cap).select("budget", "place").collect()
        for b in budgets:
            assert sorted(r["place"] for r in got if r["budget"] == b) == walk(rows, b, high_cap or 10**9, cap or 10**9)


def test_greedy_skips_then_takes_a_cheaper_action(spark):
    rows = [(1, 1, 6.0, "mid"), (2, 2, 7.0, "high"), (3, 3, 2.0, "low"), (4, 2, 2.0, "low"), (5, 4, 1.0, "low")]
    df = spark.createDataFrame(rows, "place long, customer_id long, coupon_cost double, intervention_intensity string")
    assert sorted(r["place"] for r in B.greedy(df, [10]).collect()) == [1, 3, 4]


def test_budget_grid():
    assert B.budget_grid(5_000_000)[:3] == [0, 1_000_000, 2_000_000]
    assert 5_500_000 in B.budget_grid(5_500_000) and 6_500_000 in B.budget_grid(5_500_000)
    assert min(B.budget_grid(40_000_000)) == 0 and B.budget_grid(40_000_000)[1] == 30_000_000


def test_flat_column_scales_to_zero(spark):
    from winback.functions.scalars import minmax
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "customer_id long, a double, b double")
    m = minmax(df, "a", "b")
    assert [tuple(r) for r in df.select(m["a"], m["b"]).collect()] == [(0.0, 0.0), (0.0, 1.0)]


def test_window_edges_and_change_rate(spark):
    from winback.functions.scalars import change_rate, in_window
    df = spark.createDataFrame([("2024-01-13 00:00:00",), ("2024-01-13 00:00:01",), ("2024-01-20 00:00:00",), ("2024-01-20 00:00:01",)], "t string").withColumn("t", F.col("t").cast("timestamp"))
    end = F.lit("2024-01-20").cast("timestamp")
    assert [r[0] for r in df.select(in_window(F.col("t"), end, 7)).collect()] == [False, True, True, False]
    assert spark.range(1).select(change_rate(F.lit(3), F.lit(0))).first()[0] == 0.0


@pytest.mark.parametrize("k, chunk", [(1, 64), (3, 2), (5, 2), (3, 1)])
def test_recommend_equals_all_pairs(spark, monkeypatch, k, chunk):
    monkeypatch.setattr(recommend, "CHUNK", chunk)
    rng = random.Random(3)
    cats = [f"c{i}" for i in range(6)]
    people = [(i, rng.choice("ab"), rng.choice("xy"), round(rng.random(), 2)) for i in range(12)]
    pref = [(i, c, round(rng.random() * 9, 2)) for i, c in itertools.product(range(12), cats) if rng.random() < (1.0 if i == 0 else 0.3)]
    view = [(i, c, round(rng.random() * 3, 2)) for i, c in itertools.product(range(12), cats) if rng.random() < 0.2]
    seg = [(p, u, c, round(rng.random() * 90, 1)) for p, u, c in itertools.product("ab", "xy", cats) if rng.random() < 0.7]
    glob = [(c, round(rng.random() * 500, 1)) for c in cats]
    got = recommend.recommend(
        spark.createDataFrame(people, "customer_id long, persona string, uplift_segment string, coupon_affinity double"),
        spark.createDataFrame(pref, "customer_id long, item_category string, customer_pref_score double"),
        spark.createDataFrame(view, "customer_id long, item_category string, view_score double"),
        spark.createDataFrame(seg, "persona string, uplift_segment string, item_category string, segment_popularity double"),
        spark.createDataFrame(glob, "item_category string, global_popularity double"), k).collect()

    def scale(vals):
        lo, hi = min(vals), max(vals)
        return [0.0 if hi - lo < 1e-9 else (v - lo) / (hi - lo) for v in vals]
    for cid, persona, up, aff in people:
        cols = [scale([dict(((c2, v) for i2, c2, v in t if i2 == cid)).get(c, 0.0) for c in cats]) for t in (pref, view)]
        cols.append(scale([dict(((c2, v) for p2, u2, c2, v in seg if (p2, u2) == (persona, up))).get(c, 0.0) for c in cats]))
        cols.append(scale([dict(glob).get(c, 0.0) for c in cats]))
        score = [round(sum(w * x[i] for w, x in zip((0.5, 0.15, 0.2, 0.15), cols)) + 0.05 * aff, 9) for i in range(len(cats))]
        want = [c for _, c in sorted(zip(score, cats), key=lambda t: (-t[0], t[1]))][:k]
        assert [r["recommended_category"] for r in sorted((r for r in got if r["customer_id"] == cid), key=lambda r: r["recommendation_rank"])] == want


@pytest.mark.parametrize("ranges", [1, 9])
def test_concordance_equals_pairs(spark, monkeypatch, ranges):
    for module in (ranking, survival):
        monkeypatch.setattr(module, "range_count", lambda spark: ranges)
    rng = random.Random(11)
    rows = [(i, rng.randint(1, 9), rng.randint(0, 1), round(rng.random(), 1)) for i in range(70)]
    num = den = 0.0
    for a in rows:
        for b in rows:
            if a[2] and (b[1] > a[1] or (b[1] == a[1] and not b[2])):
                den += 1
                num += 1.0 if a[3] > b[3] else 0.5 if a[3] == b[3] else 0.0
    df = spark.createDataFrame(rows, "customer_id long, duration_days int, event_observed int, h double")
    assert survival.concordance(df, "h") == pytest.approx(num / den)


def test_cox_orders_risk(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        t = int(rng.expovariate(0.02 * 2.718 ** (0.9 * x))) + 1
        rows.append((i, min(t, 90), int(t <= 90), x, z))
    df = spark.createDataFrame(rows, "customer_id long, duration_days int, event_observed int, x double, z double")
    m = survival.cox_fit(df, ["x", "z"])
    assert m["beta"][0] > 0.5 and abs(m["beta"][1]) < 0.2
    s = survival.cox_predict(df, m)
    assert survival.concordance(s, "predicted_hazard_ratio") > 0.68
    bad = s.where("survival_prob_30d < survival_prob_60d OR survival_prob_60d < survival_prob_90d OR survival_prob_1d > 1").count()
    assert bad == 0


def test_qini_and_area(spark):
    rows = [(1, 0.9, 1.0, 1.0), (2, 0.8, 0.0, 0.0), (3, 0.7, 0.0, 1.0), (4, 0.1, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "customer_id long, s double, retained double, treatment_flag double")
    q = uplift.qini(df, "s").orderBy("k").collect()
    assert [round(r["qini_gain"], 6) for r in q] == [1.0, 2.0, 1.5, 0.0]
    g, f = [r["qini_gain"] for r in q], [r["fraction"] for r in q]
    area = sum((f[i] - f[i - 1]) * (g[i] + g[i - 1]) / 2 for i in range(1, 4))
    assert uplift.auuc(uplift.qini(df, "s")) == pytest.approx(area)


def test_compress_and_no_history(spark):
    ev = [(1, f"2024-01-01 0{i}:00:00", i, k) for i, k in enumerate("aabba")] + [(2, "2023-01-01 00:00:00", 9, "a")]
    e = spark.createDataFrame(ev, "customer_id long, event_time string, event_id long, event_type string").withColumn("event_time", F.col("event_time").cast("timestamp"))
    anchors = spark.createDataFrame([(1, "2024-01-01 23:00:00"), (2, "2024-01-01 00:00:00")], "customer_id long, t string").select("customer_id", F.col("t").cast("timestamp").alias("behavior_anchor_time"))
    got = {r["customer_id"]: r["pattern"] for r in cohort.last_patterns(e, anchors, ["event_id"]).collect()}
    assert got == {1: "a > b > a", 2: "no_history"}


def test_churn_run(spark):
    runs = {1: "AACCAC", 2: "CCCCCC", 3: "CCCCCA"}
    rows = [(c, f"2024-01-{i + 1:02d}", {"A": "active", "C": "churn_risk"}[s]) for c, t in runs.items() for i, s in enumerate(t)]
    s = spark.createDataFrame(rows, "customer_id long, d string, current_status string").select("customer_id", F.col("d").cast("date").alias("snapshot_date"), "current_status")
    got = {r["customer_id"]: str(r["final_churn_start_date"]) for r in cohort.final_churn_start(s).collect()}
    assert got == {1: "2024-01-06", 2: "2024-01-01"}


def test_cohort_gap_and_return(spark):
    c = spark.createDataFrame([(1, "2024-01"), (2, "2024-01")], "customer_id long, acquisition_month string")
    e = spark.createDataFrame([(1, "2024-01-05", "purchase"), (1, "2024-04-05", "purchase"), (2, "2024-02-05", "purchase")], "customer_id long, t string, event_type string").select(
        "customer_id", F.col("t").cast("timestamp").alias("event_time"), "event_type")
    t = cohort.retention(c, e, {"purchase_only": ["purchase"]}, periods=5)
    rate = lambda m: [r["retention_rate"] for r in t.where(F.col("retention_mode") == m).orderBy("period").collect()]
    assert rate("point") == [1.0, 0.5, 0.0, 0.5, None] and rate("rolling") == [1.0, 1.0, 0.5, 0.5, None]


def test_uplift_segment_rule(spark):
    rows = [(-0.1, 0.9), (0.05, 0.6), (0.01, 0.6), (0.05, 0.2)]
    df = spark.createDataFrame(rows, "u double, p double").select(P.uplift_segment(F.col("u"), F.col("p")))
    assert [r[0] for r in df.collect()] == ["Sleeping Dogs", "Persuadables", "Lost Causes", "Sure Things"]
