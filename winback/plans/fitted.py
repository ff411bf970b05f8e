"""The decision path with fitted models in it: held-out uplift, proportional hazards and learned doses in the place of the formula scores.

The formula scores of `summary` and `decision` stay the plan that SQL can repeat; this one takes the same tables and operators and differs in where the numbers come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winback import params
from winback.functions.ranking import with_rank_pct
from winback.operators import budget as B
from winback.operators import experiment as E
from winback.operators import policy as P
from winback.operators import survival as S
from winback.operators import uplift as U
from winback.sources import adapters as A
from winback.sources.staging import cut

NUMBERS = ["recency_days", "frequency", "monetary", "price_sensitivity", "coupon_affinity"]
RISKS = [*NUMBERS, "support_contact_propensity", "discount_pressure_score"]
TEXTS = ["persona"]


def _frame(summary: DataFrame, columns: list[str]) -> DataFrame:
    return summary.select("customer_id", *[F.col(c).cast("double").alias(c) for c in columns], *TEXTS)


def uplift_scores(spark: SparkSession, d: str, summary: DataFrame, trees: int = 20) -> DataFrame:
    """(customer_id, predicted_uplift) from the read-out of the last campaign, held out by folds."""
    o = E.outcomes(A.assignments(spark, d), A.orders(spark, d)).select("customer_id", F.col("treatment_flag").cast("double").alias("treatment_flag"), F.col("retained").cast("double").alias("retained"))
    frame = cut(_frame(summary, NUMBERS).join(o, "customer_id"), "uplift-frame")
    return U.cross_fitted(frame, "dr_learner", NUMBERS, TEXTS, trees=trees).select("customer_id", "predicted_uplift")


def survival_scores(spark: SparkSession, d: str, summary: DataFrame) -> DataFrame:
    """Hazard, survival and risk group of every customer, from a fit on those at risk at the landmark."""
    act = S.activity(A.order_events(spark, d), A.orders(spark, d))
    rows = S.landmark_rows(S.gap_events(act, A.customers(spark, d), params.AS_OF_ORDERS, params.HORIZON_DAYS, params.CHURN_DAYS), params.AS_OF_ORDERS, params.HORIZON_DAYS)
    frame, columns = S.encode(_frame(summary, RISKS).join(rows, "customer_id", "left"), RISKS, TEXTS)
    frame = cut(frame, "survival-frame")
    known = frame.where(F.col("duration_days").isNotNull())
    keep = [r["col"] for r in S.encoded_stats(known, columns).where("verdict = 'keep'").orderBy(F.desc("variance")).limit(140).collect()]
    scored = S.cox_predict(frame.select("customer_id", *keep), S.cox_fit(known.select("duration_days", "event_observed", *keep), keep), params.HORIZON_DAYS).drop(*keep)
    ranked = with_rank_pct(cut(scored, "survival-scores"), {"predicted_hazard_ratio": "risk_percentile"})
    risk = F.when(F.col("risk_percentile") <= 1 / 3, "Low Risk").when(F.col("risk_percentile") <= 2 / 3, "Mid Risk").otherwise("High Risk")
    return ranked.withColumn("risk_group", risk)


def dose_scores(spark: SparkSession, d: str, summary: DataFrame) -> DataFrame:
    """(customer_id, effect_low, effect_mid, effect_high) of the campaign's doses."""
    doses = U.dose_label(cut(U.exposure_window(E.outcomes(A.assignments(spark, d), A.orders(spark, d)), A.exposures(spark, d)), "dose-outcomes"))
    frame = _frame(summary, NUMBERS).join(doses.select("customer_id", "dose_intensity", F.col("retained").cast("double").alias("retained")), "customer_id")
    return U.dose_effects(cut(frame, "dose-frame"), NUMBERS, TEXTS).select("customer_id", "effect_low", "effect_mid", "effect_high")


def actions(summary: DataFrame, gain: DataFrame, time: DataFrame, doses: DataFrame) -> DataFrame:
    """Priced offers whose effect is the learned one of their dose. Economics that the summary derived from the formula uplift are made anew."""
    base = summary.drop("uplift_score", "uplift_segment", "expected_incremental_profit", "expected_roi").join(gain.withColumnRenamed("predicted_uplift", "uplift_score"), "customer_id", "left")
    base = base.withColumn("uplift_segment", P.uplift_segment(F.coalesce("uplift_score", F.lit(0.0)), F.col("churn_probability")))
    base = base.withColumns({c: F.lit(None).cast("double") for c in ("expected_incremental_profit", "expected_roi")})
    offers = P.explode_intensities(P.action_base(P.budgetable(base), time)).join(doses, "customer_id", "left")
    effect = F.coalesce(F.when(F.col("intervention_intensity") == "low", F.col("effect_low")).when(F.col("intervention_intensity") == "mid", F.col("effect_mid")).otherwise(F.col("effect_high")), F.col("uplift_score"))
    return P.learned_effect(offers, effect).drop("effect_low", "effect_mid", "effect_high")


def selected(pool: DataFrame, budget: float = params.BUDGET) -> DataFrame:
    """Whom to contact, from a pool of fitted offers."""
    ranked = B.rank_pool(pool, P.POOL_ORDER)
    return B.greedy(ranked, [budget], high_cap=B.high_share_cap(ranked.count()))
