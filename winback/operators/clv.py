"""Lifetime value: anchored order windows, future spend, forest prediction."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winback.functions.ranking import exact_quantiles, quantile_values
from winback.functions.scalars import ratio, stable_unit
from winback.operators.churn import fitted_preprocess

WINDOWS = (30, 90, 180)
NUMERIC = [f"w{w}_{m}" for w in WINDOWS for m in ("orders", "spend", "avg_order")] + ["tenure_days", "spend_velocity", "order_velocity"]


def anchor_features(customers: DataFrame, orders: DataFrame, anchor: str) -> DataFrame:
    """Order windows [anchor - (w - 1), anchor] by whole days, in one pass."""
    day, a = F.to_date("order_time"), F.lit(anchor).cast("date")
    aggs = []
    for w in WINDOWS:
        hit = (day >= F.date_sub(a, w - 1)) & (day <= a)
        aggs += [F.count_if(hit).alias(f"w{w}_orders"), F.sum(F.when(hit, F.col("net_amount")).otherwise(0.0)).alias(f"w{w}_spend")]
    g = orders.where((day <= a) & (day >= F.date_sub(a, max(WINDOWS) - 1))).groupBy("customer_id").agg(*aggs)
    j = customers.where(F.to_date("signup_date") <= a).join(g, "customer_id", "left")
    j = j.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for w in WINDOWS for c in (f"w{w}_orders", f"w{w}_spend")})
    j = j.withColumn("tenure_days", F.greatest(F.datediff(a, "signup_date"), F.lit(0)))
    span = F.greatest(F.col("tenure_days").cast("double"), F.lit(1.0))
    return j.withColumns({**{f"w{w}_avg_order": ratio(F.col(f"w{w}_spend"), F.col(f"w{w}_orders")) for w in WINDOWS},
                          "spend_velocity": F.col("w180_spend") / span, "order_velocity": F.col("w180_orders") / span})


def future_spend(base: DataFrame, orders: DataFrame, anchor: str, horizon: int = 180) -> DataFrame:
    day, a = F.to_date("order_time"), F.lit(anchor).cast("date")
    g = orders.where((day > a) & (day <= F.date_add(a, horizon))).groupBy("customer_id").agg(F.sum("net_amount").alias("future_spend"))
    return base.join(g, "customer_id", "left").withColumn("future_spend", F.coalesce("future_spend", F.lit(0.0)))


def fit_predict(train: DataFrame, now: DataFrame, text: list[str], trees: int = 40, seed: int = 42) -> tuple[DataFrame, dict[str, float]]:
    """Forest on the earlier anchor, scored at the later one; the year is twice the half-year prediction. One customer in five is held out for the report."""
    cast = lambda d: d.withColumns({c: F.col(c).cast("double") for c in NUMERIC})
    known = cast(train).withColumn("_held", stable_unit(F.col("customer_id"), 613) < 0.2)
    model = Pipeline(stages=[fitted_preprocess(known.where("NOT _held"), NUMERIC, text), RandomForestRegressor(labelCol="future_spend", numTrees=trees, maxDepth=6, seed=seed)]).fit(known.where("NOT _held"))
    unseen = model.transform(known.where("_held"))
    report = {m: RegressionEvaluator(labelCol="future_spend", metricName=m).evaluate(unseen) for m in ("mae", "rmse", "r2")}
    return model.transform(cast(now)).select("customer_id", (2 * F.greatest("prediction", F.lit(0.0))).alias("predicted_clv_12m")), report


def high_value(df: DataFrame, col: str, name: str = "is_high_value_top20pct", p: float = 0.80) -> DataFrame:
    return df.withColumn(name, (F.col(col) >= F.lit(quantile_values(df, col, [p])[0])).cast("int"))


def distribution(df: DataFrame, col: str) -> DataFrame:
    q = exact_quantiles(df, [col], [0.0, 0.5, 0.8, 0.95, 1.0]).first()
    cut = F.lit(q["q2"])
    return df.agg(F.lit(q["q0"]).alias("min"), F.lit(q["q1"]).alias("median"), F.round(F.avg(col), 4).alias("mean"), F.lit(q["q2"]).alias("p80"),
                  F.lit(q["q3"]).alias("p95"), F.lit(q["q4"]).alias("max"), F.round(F.avg((F.col(col) >= cut).cast("double")), 6).alias("high_value_share"))
