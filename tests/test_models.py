"""Fitted models on small made-up customers: bounds, directions and hold-outs that SQL can't state."""

import math
import random

import pytest
from pyspark.sql import functions as F

from winback.operators import churn, clv, survival, uplift


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(8)
    rows = []
    for i in range(700):
        x, z, flag = rng.random(), rng.random(), i % 2
        kept = rng.random() < 0.2 + 0.5 * x * flag + 0.1 * z
        rows.append((i, x, z, None if i % 40 == 0 else rng.random(), "ab"[i % 2], float(flag), float(kept), float(rng.random() < 0.15 + 0.7 * z)))
    return spark.createDataFrame(rows, "customer_id long, x double, z double, gap double, persona string, treatment_flag double, retained double, label double").cache()


def test_churn_model(people):
    model, best, report = churn.train(people, ["x", "z", "gap"], ["persona"], folds=2, depths=(3,), sizes=(8,))
    assert best in report and all(0.6 < r["cv_auc"] <= 1 and 0.6 < r["test_auc"] <= 1 for r in report.values())
    scored = churn.score(model, people, ["x", "z", "gap"])
    lo, hi = scored.agg(F.min("churn_score"), F.max("churn_score")).first()
    assert 0 <= lo < hi <= 1
    top = churn.importances(model, scored, 99)
    assert top[0][0].startswith("z") and sum(v for _, v in top) == pytest.approx(1.0)
    some = churn.score(model, people, ["x", "z", "gap"], changed=people.where("customer_id < 5"))
    assert sorted(r[0] for r in some.select("customer_id").collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("learner", [uplift.s_learner, uplift.t_learner, uplift.dr_learner])
def test_uplift_learners(people, learner):
    """Treatment helps in proportion to x, so the upper half gains more."""
    got = learner(people, ["x", "z"], ["persona"], trees=12)
    assert got.count() == people.count()
    r = got.agg(F.min("predicted_uplift").alias("lo"), F.max("predicted_uplift").alias("hi"), F.avg(F.when(F.col("x") > 0.5, F.col("predicted_uplift"))).alias("a"),
                F.avg(F.when(F.col("x") <= 0.5, F.col("predicted_uplift"))).alias("b")).first()
    assert -1 <= r["lo"] <= r["hi"] <= 1 and r["a"] > r["b"]


def test_lifetime_value_on_unseen_customers(spark):
    rng = random.Random(4)
    cols = ", ".join(f"{c} double" for c in clv.NUMERIC)
    rows = [(i, "p", 10.0 * v + rng.random(), *[float(v)] * len(clv.NUMERIC)) for i, v in ((i, rng.random() * 50) for i in range(400))]
    df = spark.createDataFrame(rows, f"customer_id long, persona string, future_spend double, {cols}")
    pred, report = clv.fit_predict(df, df, ["persona"], trees=10)
    assert report["r2"] > 0.8 and report["mae"] <= report["rmse"] < 80
    assert pred.count() == 400 and pred.where("predicted_clv_12m < 0").isEmpty()


def test_survival_falls_with_time_and_risk(spark):
    rng = random.Random(6)
    rows = []
    for i in range(500):
        x = rng.gauss(0, 1)
        t = int(rng.expovariate(0.02 * math.exp(0.8 * x))) + 1
        rows.append((i, min(t, 90), int(t <= 90), x))
    df = spark.createDataFrame(rows, "customer_id long, duration_days int, event_observed int, x double")
    got = survival.cox_predict(df, survival.cox_fit(df, ["x"])).toPandas().sort_values("x")
    days = [f"survival_prob_{d}d" for d in (1, 30, 60, 90)]
    assert (got[days].diff(axis=1).iloc[:, 1:] <= 1e-12).all().all() and got[days].min().min() >= 0 and got[days].max().max() <= 1
    assert (got[days].diff().iloc[1:] <= 1e-12).all().all() and (got["predicted_median_time_to_churn_days"].diff().iloc[1:] <= 0).all()


def test_survival_encoding(spark):
    rows = [(i, None if i % 10 == 0 else float(i % 7), "common" if i % 2 else "other" if i % 4 else None) for i in range(200)] + [(500 + k, 1.0, f"odd{k}") for k in range(20)]
    df = spark.createDataFrame(rows, "customer_id long, x double, kind string")
    got, cols = survival.encode(df, ["x"], ["kind"])
    levels = {c for c in cols if c.startswith("kind_")}
    assert {"kind_common", "kind_other", "kind_unknown"} <= levels and len(levels) <= 9
    assert got.where("x IS NULL").isEmpty() and got.where("customer_id = 10").first()["x"] == 2.0 + (sorted(v for _, v, _ in rows if v is not None)[len([1 for _, v, _ in rows if v is not None]) // 2] - 2.0)
