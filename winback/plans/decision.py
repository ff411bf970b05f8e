"""The decision job: scored customers to candidate actions to the selected list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winback import params
from winback.functions.ranking import placed
from winback.operators import budget as B
from winback.operators import policy as P
from winback.plans.summary import customer_summary, survival_scores
from winback.sources.staging import staged


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Scored customers with tenure, uplift segment and the named value segment."""
    s = customer_summary(spark, d)
    end = F.lit(params.AS_OF_ORDERS).cast("timestamp")
    s = s.withColumn("tenure_days", F.greatest(F.datediff(end, "signup_date"), F.lit(0))).withColumn(
        "uplift_segment", P.uplift_segment(F.col("uplift_score"), F.col("churn_probability")))
    return P.value_uplift_segments(s)


def offline_actions(spark: SparkSession, d: str) -> DataFrame:
    """Strategy-priced actions of every customer."""
    def build() -> DataFrame:
        base = staged(spark, d, "segments", lambda: segments(spark, d))
        acts = P.heuristic_effect(P.explode_intensities(P.action_base(P.with_strategy(base), survival_scores(spark, d))))
        return P.with_priority(staged(spark, d, "offline_effects", lambda: acts))
    return staged(spark, d, "offline_actions", build)


def api_actions(spark: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        base = P.budgetable(customer_summary(spark, d))
        return P.heuristic_effect(P.explode_intensities(P.action_base(base, survival_scores(spark, d))))
    return staged(spark, d, "api_actions", build)


def pool(spark: SparkSession, d: str) -> DataFrame:
    """The ranked candidate pool, written once for all budgets."""
    def build() -> DataFrame:
        return placed(P.candidate_pool(api_actions(spark, d), params.RISK_THRESHOLD), P.POOL_ORDER)
    return staged(spark, d, "ranked_pool", build)


def selected(spark: SparkSession, d: str, budgets: list[int] | None = None, customer_cap: int | None = None) -> DataFrame:
    ranked = pool(spark, d)
    cap = B.high_share_cap(customer_cap or ranked.count())
    return B.greedy(ranked, budgets or [params.BUDGET], high_cap=cap, customer_cap=customer_cap)


def selected_once(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, d, "selected", lambda: selected(spark, d))


def offline_pool(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, d, "ranked_offline", lambda: placed(P.offline_pool(offline_actions(spark, d)), P.OFFLINE_ORDER))


def offline_selected(spark: SparkSession, d: str, budgets: list[int]) -> DataFrame:
    ranked = offline_pool(spark, d)
    cap = B.high_share_cap(ranked.agg(F.count_distinct("customer_id")).first()[0])
    return B.greedy(ranked, budgets, high_cap=cap)
