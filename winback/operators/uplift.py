"""Uplift learners, their ranking curves, and the dose response of the offer intensity."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winback.functions.ranking import ordered_totals, quantile_values
from winback.functions.scalars import clip, minmax, ratio, scalars, stable_unit
from winback.operators.churn import fitted_preprocess
from winback.sources.staging import cut

ARMS = ["control", "low", "mid", "high"]


def _forest(df: DataFrame, numeric: list[str], text: list[str], trees: int, seed: int) -> PipelineModel:
    return Pipeline(stages=[fitted_preprocess(df, numeric, text), RandomForestClassifier(labelCol="retained", numTrees=trees, maxDepth=5, seed=seed)]).fit(df)


def _p(model, df: DataFrame, name: str) -> DataFrame:
    keep = df.columns
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(name))


def s_learner(df: DataFrame, numeric: list[str], text: list[str], trees: int = 40, seed: int = 42, on: DataFrame | None = None) -> DataFrame:
    """One model with the treatment flag as a feature; the gain is the difference of two predictions. Fitted on df, applied to `on` (df itself where it isn't given)."""
    model, on = _forest(df, [*numeric, "treatment_flag"], text, trees, seed), df if on is None else on
    flag = F.col("treatment_flag")
    with_ = _p(model, on.withColumns({"_flag": flag, "treatment_flag": F.lit(1.0)}), "_p1")
    both = _p(model, with_.withColumn("treatment_flag", F.lit(0.0)), "_p0")
    return both.withColumn("treatment_flag", F.col("_flag")).withColumn("predicted_uplift", F.col("_p1") - F.col("_p0")).drop("_flag", "_p1", "_p0")


def _arms(df: DataFrame, numeric: list[str], text: list[str], trees: int, seed: int, on: DataFrame) -> DataFrame:
    """`on` with the outcome that a model of the treated (_p1) and one of the others (_p0) of df expect."""
    treated = _forest(df.where("treatment_flag = 1"), numeric, text, trees, seed)
    control = _forest(df.where("treatment_flag = 0"), numeric, text, trees, seed)
    return _p(control, _p(treated, on, "_p1"), "_p0")


def t_learner(df: DataFrame, numeric: list[str], text: list[str], trees: int = 40, seed: int = 42, on: DataFrame | None = None) -> DataFrame:
    both = _arms(df, numeric, text, trees, seed, df if on is None else on)
    return both.withColumn("predicted_uplift", F.col("_p1") - F.col("_p0")).drop("_p1", "_p0")


def dr_pseudo(df: DataFrame, p1: str, p0: str, propensity: float) -> Column:
    """Doubly robust pseudo-outcome with a constant propensity, held to +-0.5."""
    e = min(max(propensity, 0.05), 0.95)
    w, y = F.col("treatment_flag"), F.col("retained")
    return clip(F.col(p1) - F.col(p0) + w * (y - F.col(p1)) / e - (1 - w) * (y - F.col(p0)) / (1 - e), -0.5, 0.5)


def _gain_model(df: DataFrame, numeric: list[str], text: list[str], trees: int, seed: int):
    return Pipeline(stages=[fitted_preprocess(df, numeric, text), RandomForestRegressor(labelCol="_pseudo", numTrees=trees, maxDepth=5, seed=seed)]).fit(df)


def dr_learner(df: DataFrame, numeric: list[str], text: list[str], trees: int = 40, seed: int = 42, on: DataFrame | None = None) -> DataFrame:
    both = _arms(df, numeric, text, trees, seed, df)
    both = both.withColumn("_pseudo", dr_pseudo(both, "_p1", "_p0", scalars(df, w=F.avg("treatment_flag"))["w"]))
    on = df if on is None else on
    return _gain_model(both, numeric, text, trees, seed).transform(on).select(*on.columns, F.col("prediction").alias("predicted_uplift"))


LEARNERS = {"s_learner": s_learner, "t_learner": t_learner, "dr_learner": dr_learner}
FOLDS = 3


def fold(folds: int) -> Column:
    """The fold of a customer, by a hash of its id: all its rows are in one."""
    return F.pmod(F.xxhash64("customer_id", F.lit("fold")), F.lit(folds)).cast("int")


def settled(df: DataFrame) -> DataFrame:
    """The rows where and in the order that their customer decides: a forest draws its bootstrap by partition and place, so a repeated fit is the same."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "customer_id").sortWithinPartitions("customer_id")


def cross_fitted(df: DataFrame, learner: str, numeric: list[str], text: list[str], folds: int = FOLDS, trees: int = 40, seed: int = 42) -> DataFrame:
    """df with `predicted_uplift`, every customer scored by models that have not seen it.

    The doubly robust learner is held out twice: the arms' models that make a customer's pseudo-outcome are fitted without its fold, and so is the model of the pseudo-outcomes
    that scores it.
    """
    d = cut(df.withColumn("_fold", fold(folds)), "folds")
    parts = [(settled(d.where(F.col("_fold") != k)), d.where(F.col("_fold") == k)) for k in range(folds)]
    if learner != "dr_learner":
        return reduce(DataFrame.unionByName, [LEARNERS[learner](train, numeric, text, trees, seed, on=held) for train, held in parts]).drop("_fold")
    share = scalars(df, w=F.avg("treatment_flag"))["w"]
    both = reduce(DataFrame.unionByName, [_arms(train, numeric, text, trees, seed, held) for train, held in parts])
    both = cut(both.withColumn("_pseudo", dr_pseudo(both, "_p1", "_p0", share)), "pseudo-outcomes")
    scored = [_gain_model(settled(both.where(F.col("_fold") != k)), numeric, text, trees, seed).transform(both.where(F.col("_fold") == k)) for k in range(folds)]
    return reduce(DataFrame.unionByName, [x.select(*df.columns, F.col("prediction").alias("predicted_uplift")) for x in scored])


def qini(df: DataFrame, score: str, outcome: str = "retained", flag: str = "treatment_flag") -> DataFrame:
    """Cumulative gain along the score, highest first, with the random line. Exact over the whole table."""
    w, y = F.col(flag), F.col(outcome)
    run = ordered_totals(df.select("customer_id", score, outcome, flag), [(score, True), ("customer_id", False)], {
        "k": F.lit(1), "nt": w, "nc": 1 - w, "yt": y * w, "yc": y * (1 - w)})
    run = run.withColumn("qini_gain", (ratio(F.col("yt"), F.col("nt")) - ratio(F.col("yc"), F.col("nc"))) * F.col("k"))
    tot = scalars(df, n=F.count(F.lit(1)), nt=F.sum(w), yt=F.sum(y * w), yc=F.sum(y * (1 - w)))
    n, nt = tot["n"], tot["nt"] or 0
    last = ((tot["yt"] / nt if nt else 0.0) - (tot["yc"] / (n - nt) if n > nt else 0.0)) * n
    return run.select("customer_id", "k", (F.col("k") / F.lit(n)).alias("fraction"), "qini_gain",
                      (F.lit(last) * (F.col("k") - 1) / F.lit(max(n - 1, 1))).alias("random_gain"))


def auuc(curve: DataFrame) -> float:
    """Area under the gain. Steps are all 1/n wide, so the trapezoids need no ordering."""
    s = curve.agg(F.sum("qini_gain").alias("s"), F.count(F.lit(1)).alias("n"), F.min_by("qini_gain", "k").alias("a"), F.max_by("qini_gain", "k").alias("b")).first()
    return (s["s"] - (s["a"] + s["b"]) / 2) / s["n"] if s["n"] else 0.0


def select_learner(scored: dict[str, DataFrame], band: float = 0.02, floor: float = 0.05) -> tuple[str, dict[str, float]]:
    """Best area; falls back to the two-model learner when too few customers are above the neutral band."""
    areas = {k: auuc(qini(v, "predicted_uplift")) for k, v in scored.items()}
    best = max(areas, key=areas.get)
    above = scalars(scored[best], a=F.avg((F.col("predicted_uplift") > band).cast("double")))["a"]
    return ("t_learner" if above < floor and "t_learner" in scored else best), areas


def persuadables_deltas(df: DataFrame, cols: list[str]) -> DataFrame:
    hit = F.col("uplift_segment") == "Persuadables"
    aggs = [f.alias(n) for c in cols for n, f in ((f"p_{c}", F.avg(F.when(hit, F.col(c)))), (f"a_{c}", F.avg(c)))]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.coalesce(f"p_{c}", F.lit(0.0)), 4).alias("persuadables_mean"), F.round(f"a_{c}", 4).alias("overall_mean"),
                                        F.round(F.coalesce(f"p_{c}", F.lit(0.0)) - F.col(f"a_{c}"), 4).alias("delta")) for c in cols])).alias("r")
    return df.agg(*aggs).select(rows).select("r.*")


def persuadables_profiles(df: DataFrame, cols: list[str], n: int = 3) -> DataFrame:
    """Most common values of each text column among the persuadable customers."""
    from pyspark.sql import Window
    p = df.where(F.col("uplift_segment") == "Persuadables")
    total = max(p.count(), 1)
    vals = p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])).alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return vals.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("column", "value", "rank", F.round(F.col("n") / total, 4).alias("share"))


def exposure_window(outcomes: DataFrame, exposures: DataFrame, horizon: int = 60) -> DataFrame:
    gap = F.datediff("exposure_time", "assigned_at")
    hit = exposures.select("customer_id", "exposure_time").join(outcomes.select("customer_id", "assigned_at"), "customer_id").where((gap >= 0) & (gap <= min(horizon, 30)))
    n = hit.groupBy("customer_id").agg(F.count(F.lit(1)).alias("dose_exposure_count"))
    return outcomes.join(n, "customer_id", "left").withColumn("dose_exposure_count", F.coalesce("dose_exposure_count", F.lit(0)))


def dose_label(df: DataFrame) -> DataFrame:
    """Terciles of the offer strength among treated customers; the others are the control."""
    t = df.where("treatment_flag = 1")
    m = minmax(t, "coupon_cost", "dose_exposure_count")
    strength = F.round(0.75 * m["coupon_cost"] + 0.25 * m["dose_exposure_count"], 9)
    q1, q2 = quantile_values(t.withColumn("_s", strength), "_s", [1 / 3, 2 / 3])
    arm = F.when(strength <= q1, "low").when(strength <= q2, "mid").otherwise("high")
    return df.withColumn("dose_intensity", F.when(F.col("treatment_flag") == 1, arm).otherwise("control"))


def stratified(df: DataFrame, strata: list[str], rows: int, salt: int = 911) -> DataFrame:
    """Exact proportional quota per stratum in the order of a fixed draw; all rows when they fit."""
    n = df.count()
    if n <= rows:
        return df
    d = df.withColumn("_draw", stable_unit(F.col("customer_id"), salt))
    r = ordered_totals(d, [("_draw", False), ("customer_id", False)], {"_k": F.lit(1)}, by=strata)
    size = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    quota = F.greatest(F.bround(F.col("_n") * F.lit(rows) / F.lit(n), 0), F.lit(1))
    return r.join(size, strata).where(F.col("_k") <= quota).drop("_draw", "_k", "_n")


def arm_summary(df: DataFrame) -> DataFrame:
    g = df.groupBy("dose_intensity").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("retained").alias("r"), F.avg("coupon_cost").alias("c"), F.avg("dose_exposure_count").alias("x"), F.avg("revenue_post").alias("v"))
    base = scalars(df, r=F.avg(F.when(F.col("dose_intensity") == "control", F.col("retained"))), c=F.avg(F.when(F.col("dose_intensity") == "mid", F.col("coupon_cost"))))
    return g.select("dose_intensity", "samples", F.round("r", 6).alias("retention_rate"), F.round("c", 2).alias("avg_coupon_cost"), F.round("x", 4).alias("avg_exposure_count"),
                    F.round("v", 2).alias("avg_revenue_post"), F.round(F.col("r") - F.lit(base["r"]), 6).alias("effect_prior"),
                    F.round(F.col("c") / F.lit(max(base["c"] or 1.0, 1.0)), 6).alias("cost_multiplier"))


def dose_effects(df: DataFrame, numeric: list[str], text: list[str], min_rows: int = 80) -> DataFrame:
    """Outcome model per arm, then a ridge on the held difference to the control; constant where data is thin.

    The rows are written first: every fit reads them, and would join (and broadcast) what they come from again.
    """
    df = cut(df, "dose-rows")
    counts = {r["dose_intensity"]: (r["n"], r["y"]) for r in df.groupBy("dose_intensity").agg(F.count(F.lit(1)).alias("n"), F.avg("retained").alias("y")).collect()}
    prep = fitted_preprocess(df, numeric, text)
    out = prep.transform(df).select(*df.columns, "features")
    for arm in ARMS:
        n, y = counts.get(arm, (0, None))
        if n < min_rows or y in (0.0, 1.0):
            out = out.withColumn(f"p_{arm}", F.lit(float(y or 0.0)))
            continue
        lr = LogisticRegression(labelCol="retained", regParam=0.01, maxIter=50).fit(out.where(F.col("dose_intensity") == arm))
        out = lr.transform(out).withColumn(f"p_{arm}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    for arm in ARMS[1:]:
        out = out.withColumn(f"_d_{arm}", clip(F.col(f"p_{arm}") - F.col("p_control"), -0.35, 0.75))
        ridge = LinearRegression(labelCol=f"_d_{arm}", regParam=0.1, elasticNetParam=0.0, solver="normal").fit(out)
        out = ridge.transform(out).withColumn(f"effect_{arm}", clip(F.col("prediction"), -0.35, 0.75)).drop("prediction", f"_d_{arm}")
    return out.drop("features")
