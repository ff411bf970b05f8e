"""From triggers to queued actions under a shared budget and a daily capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winback.functions.ranking import placed
from winback.operators.budget import greedy
from winback.sources.staging import cut


def action_choices(triggers: DataFrame, actions: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Each triggered customer's possible actions in order of preference (three per customer, fewer when used before)."""
    t = triggers.groupBy("customer_id").agg(F.max_by(F.struct("event_time", "event_id", "churn_score", "reasons"), F.struct("event_time", "event_id")).alias("t"))
    a = actions.where((F.col("coupon_cost") > 0) & (F.col("expected_incremental_profit") > 0))
    if used is not None:
        a = a.join(used.select("customer_id", "intervention_intensity"), ["customer_id", "intervention_intensity"], "left_anti")
    j = a.join(t.select("customer_id", "t.*"), "customer_id")
    w = Window.partitionBy("customer_id")

    def scaled(c):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi - lo < 1e-12, 0.0).otherwise((c - lo) / (hi - lo))
    j = j.withColumn("action_priority", 0.34 * scaled(F.col("expected_incremental_profit")) + 0.28 * scaled(F.greatest("expected_roi", F.lit(0.0)))
                     + 0.23 * F.col("timing_urgency_score") + 0.15 * F.col("churn_score"))
    j = j.withColumn("choice", F.row_number().over(w.orderBy(F.desc(F.round("action_priority", 9)), F.desc("expected_incremental_profit"), F.desc("expected_roi"), "coupon_cost")))
    return j.select("customer_id", "event_time", "event_id", "reasons", "churn_score", "intervention_intensity", "coupon_cost", "expected_incremental_profit",
                    "expected_roi", "action_priority", "choice")


def closed_loop(choices: DataFrame, budget: float, capacity: int) -> DataFrame:
    """Queue in trigger order while budget and capacity last; each customer gets its best action that still fits.

    This is the budget walk with trigger time first and preference second. A customer left over is deferred for the channel if the
    places had run out by its turn, else for the budget.
    """
    ranked = cut(placed(choices, [("event_time", False), ("event_id", False), ("customer_id", False), ("choice", False)]), "loop")
    taken = greedy(ranked.drop("intervention_intensity").withColumn("intervention_intensity", F.lit("none")), [budget], customer_cap=capacity).select("customer_id", "place")
    got = ranked.join(taken.select("place"), "place").select("customer_id", "intervention_intensity", "coupon_cost", F.lit("queued").alias("action_queue_status"), "place")
    n, last = got.agg(F.count(F.lit(1)), F.max("place")).first()
    late = F.col("place") > F.lit(last if n >= capacity else None).cast("long")
    rest = ranked.where("choice = 1").join(taken.select("customer_id"), "customer_id", "left_anti").select(
        "customer_id", "intervention_intensity", "coupon_cost", F.when(late, "deferred_channel_guardrail").otherwise("deferred_budget_guardrail").alias("action_queue_status"))
    got = got.drop("place")
    return got.unionByName(rest)
