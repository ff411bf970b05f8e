"""Per-customer value and risk scores: RFM, churn proxy, personas, segments, economics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winback.functions.ranking import quantile_values, with_rank_pct
from winback.functions.scalars import clip, ratio, scalars, sigmoid, stable_unit
from winback.sources.staging import cut


def rfm(orders: DataFrame, as_of: str | None = None) -> DataFrame:
    """Recency in whole days to the table's last order (or to as_of), order count and net spend."""
    if as_of:
        orders = orders.where(F.col("order_time") <= F.lit(as_of).cast("timestamp"))
        end = F.lit(as_of).cast("timestamp")
    else:
        end = F.lit(scalars(orders, t=F.max("order_time"))["t"])
    return orders.groupBy("customer_id").agg(
        F.greatest(F.datediff(end, F.max("order_time")), F.lit(0)).alias("recency_days"),
        F.count(F.lit(1)).alias("frequency"),
        F.round(F.sum("net_amount"), 4).alias("monetary"))


# Weights of the seven risk terms.
RISK_WEIGHTS = {
    "recency": 0.28,
    "inactivity": 0.20,
    "low_frequency": 0.16,
    "low_monetary": 0.12,
    "support": 0.12,
    "discount": 0.06,
    "engagement": 0.06,
}


def _logit(p: float) -> float:
    p = min(max(p, 0.02), 0.98)
    return math.log(p / (1.0 - p))


def churn_proxy(summary: DataFrame, label: str | None = None) -> DataFrame:
    """Add churn_probability: blended risk ranks pushed through a logit around the base rate.

    The small tie-breaking term is a fixed function of the customer id, so reruns agree.
    """
    ranked = with_rank_pct(summary, {"recency_days": "_rr", "inactivity_days": "_ri", "frequency": "_rf", "monetary": "_rm"})
    pct = {c: clip(F.coalesce(F.col(c), F.lit(0.5)), 0.001, 0.999) for c in ("_rr", "_ri", "_rf", "_rm")}
    terms = {
        "recency": pct["_rr"], "inactivity": pct["_ri"],
        "low_frequency": 1 - pct["_rf"], "low_monetary": 1 - pct["_rm"],
        "support": clip(F.coalesce("support_contact_propensity", F.lit(0.1)), 0.0, 1.0),
        "discount": clip(F.coalesce("discount_dependency_score", F.lit(0.0)), 0.0, 1.0),
        "engagement": F.lit(0.5),
    }
    blend = sum((F.lit(w) * terms[n] for n, w in RISK_WEIGHTS.items()), F.lit(0.0))
    # written once: the ranks are read by the averages, the second ranking and the result
    scored = cut(ranked.withColumn("_behaviour", F.round(clip(blend, 0.01, 0.99), 9)).select(
        "customer_id", "_behaviour", *([label] if label else [])), "risk-blend")
    jitter = (stable_unit(F.col("customer_id")) - 0.5) * 0.0866
    if label:
        got = scalars(scored, b=F.avg("_behaviour"), y=F.avg(label))
        rate = min(max(got["y"], 0.03), 0.97)
        shifted = F.round(F.col("_behaviour") + 0.35 * (F.col(label) - F.lit(rate)), 9)
        slope, high = 2.35, 0.98
        extra = 1.10 * (F.col(label) - F.lit(rate)) + 0.75 * (F.col("_behaviour") - F.lit(got["b"]))
    else:
        got = scalars(scored, b=F.avg("_behaviour"))
        rate = min(max(0.06 + 0.34 * got["b"], 0.08), 0.36)
        shifted = F.col("_behaviour")
        slope, high = 2.15, 0.82
        extra = 0.65 * (F.col("_behaviour") - F.lit(got["b"]))
    scored = with_rank_pct(scored.withColumn("_shifted", shifted), {"_shifted": "_rs"})
    logit = F.lit(_logit(rate)) + F.lit(slope) * (clip(F.col("_rs"), 0.001, 0.999) - 0.5) + extra + jitter
    prob = F.round(clip(sigmoid(clip(logit, -18.0, 18.0)), 0.02, high), 9)
    return summary.join(scored.select("customer_id", prob.alias("churn_probability")), "customer_id")


def persona(summary: DataFrame, name: str = "persona_rule") -> DataFrame:
    """Persona from spend and frequency ranks, then churn and recency."""
    spread = scalars(summary, s=F.stddev("monetary"))["s"] or 0.0
    if spread <= 0:
        return summary.withColumn(name, F.lit("regular_loyal"))
    r = with_rank_pct(summary, {"monetary": "_m", "frequency": "_f"})
    rule = (F.when((F.col("_m") >= 0.80) & (F.col("_f") >= 0.70), "vip_loyal")
            .when((F.col("_m") >= 0.50) & (F.col("_f") >= 0.50), "regular_loyal")
            .when(F.col("churn_probability") >= 0.60, "churn_progressing")
            .when((F.col("recency_days") <= 30) & (F.col("frequency") <= 2), "new_signup")
            .when(F.col("_m") < 0.30, "price_sensitive").otherwise("explorer"))
    return r.withColumn(name, rule).drop("_m", "_f")


def uplift_quadrant(churn: Column, monetary: Column, median: float) -> Column:
    high = monetary > F.lit(median)
    return (F.when((churn >= 0.45) & high, "Persuadables").when((churn < 0.45) & high, "Sure Things")
            .when(churn >= 0.45, "Lost Causes").otherwise("Sleeping Dogs"))


def with_uplift_quadrant(summary: DataFrame, name: str = "uplift_segment") -> DataFrame:
    median = quantile_values(summary, "monetary", [0.5])[0]
    return summary.withColumn(name, uplift_quadrant(F.col("churn_probability"), F.col("monetary"), median))


def value_scores(summary: DataFrame) -> DataFrame:
    """clv, uplift, offer cost, expected profit and return."""
    churn, money, freq = F.col("churn_probability"), F.col("monetary"), F.col("frequency")
    draw = 0.08 + 0.17 * (stable_unit(F.col("customer_id"), 31337) - 0.5)
    uplift = F.round(clip(draw + 0.05 * (churn - 0.5), -0.15, 0.42), 9)
    keep = clip(1.15 - churn, 0.20, 1.15)
    clv = F.round(clip(money * (1.30 + 1.25 * keep) + freq * F.greatest(ratio(money, freq), F.lit(20000.0)) * 0.55, 15000.0), 2)
    out = summary.withColumn("uplift_score", uplift).withColumn("clv", clv)
    out = out.withColumn("coupon_cost", F.floor(clip(money * 0.0025, 3000.0, 30000.0)).cast("double"))
    out = out.withColumn("expected_incremental_profit", F.round(F.greatest(F.col("clv") * F.col("uplift_score"), F.lit(-50000.0)), 4))
    return out.withColumn("expected_roi", F.round(ratio(F.col("expected_incremental_profit") - F.col("coupon_cost"), F.col("coupon_cost")), 6))


def discount_scores(total_discount: Column, total_amount: Column, exposures: Column) -> dict[str, Column]:
    """Discount dependency, fatigue, pressure and the effect penalty."""
    dep = clip(total_discount / F.greatest(total_amount, F.lit(1.0)), 0.0, 1.0)
    fatigue = clip(exposures / F.lit(3.0), 0.0, 2.0)
    pressure = clip(0.65 * dep + 0.35 * fatigue / 2, 0.0, 1.0)
    return {"discount_dependency_score": F.round(dep, 9), "coupon_fatigue_score": F.round(fatigue, 9),
            "discount_pressure_score": F.round(pressure, 9),
            "discount_effect_penalty": F.round(clip(1 - 0.25 * pressure, 0.5, 1.0), 9)}


def calibrate(scored: DataFrame, raw: str, churned: Column, name: str = "churn_probability") -> DataFrame:
    """Logistic of the score rank around one minus the realised churn share, held to 0.15..0.25."""
    share = min(max(scalars(scored, y=F.avg(churned.cast("double")))["y"], 0.15), 0.25)
    r = with_rank_pct(scored, {raw: "_p"})
    return r.withColumn(name, F.round(sigmoid((F.col("_p") - (1 - share)) / 0.10), 9)).drop("_p")


def offline_summary(summary: DataFrame, churn_days: int) -> DataFrame:
    """Summary scores from terms scaled by their 95th percentile, calibrated to the realised churn share."""
    top = {c: max(quantile_values(summary, c, [0.95])[0] or 0.0, 1.0) for c in ("recency_days", "frequency", "monetary")}
    scaled = {c: F.least(F.col(c) / F.lit(q), F.lit(1.0)) for c, q in top.items()}
    falling = lambda c: (F.col(c) < 0).cast("double")
    raw = clip(0.34 * scaled["recency_days"] + 0.20 * (1 - scaled["frequency"]) + 0.16 * (1 - scaled["monetary"])
               + 0.13 * falling("visit_change_rate") + 0.13 * falling("purchase_change_rate")
               + 0.04 * clip(F.col("inactivity_days") / float(churn_days), 0.0, 1.0), 0.01, 0.99)
    s = calibrate(summary.drop("churn_probability").withColumn("_raw", F.round(raw, 9)), "_raw", F.col("inactivity_days") >= churn_days)
    pressure = F.greatest(F.col("coupon_fatigue_score") * 0.55 + 0.60 * F.col("discount_dependency_score"), F.lit(0.0))
    penalty = clip(1 - 0.08 * pressure, 0.55, 1.0)
    u = F.col("uplift_score")
    keep = clip(1.15 - F.col("churn_probability"), 0.20, 1.15)
    clv = F.greatest(F.col("monetary") * (1.30 + 1.25 * keep) + F.col("frequency") * F.greatest(ratio(F.col("monetary"), F.col("frequency")), F.lit(20000.0)) * 0.55, F.lit(15000.0))
    s = s.withColumns({"clv": clv, "discount_pressure_score": pressure, "discount_effect_penalty": penalty})
    return s.withColumn("expected_incremental_profit", F.greatest(F.col("clv") * u * F.col("discount_effect_penalty"), F.lit(-50000.0))).withColumn(
        "uplift_segment", F.when(u >= 0.12, "Persuadables").when(u >= 0.02, "Sure Things").when(u >= -0.03, "Lost Causes").otherwise("Sleeping Dogs")).drop("_raw")
