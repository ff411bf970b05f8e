"""Live tables: counters, scores, actions and queue per customer. The same functions serve batch and micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winback.functions.scalars import literal_map

# The counter that each event type adds to.
COUNTERS = {
    "visit": "visit_7d", "login": "visit_7d", "page_view": "browse_7d", "browse": "browse_7d", "search": "search_7d",
    "add_to_cart": "add_to_cart_7d", "remove_from_cart": "cart_remove_7d", "purchase": "purchase_30d", "support_contact": "support_30d",
    "refund": "refund_30d", "coupon_open": "coupon_open_30d", "coupon_redeem": "coupon_redeem_30d",
}
COUNTER_NAMES = list(dict.fromkeys(COUNTERS.values()))
# Base cost per category and multiplier per intensity.
ACTION_COST = {"benefit": 7000.0, "coupon": 7000.0, "crm": 12000.0, "message": 1500.0, "upsell": 4000.0, "monitoring": 0.0}
COST_SCALE = {"none": 0.0, "low": 0.70, "medium": 1.00, "mid": 1.00, "high": 1.65}


def counter_aggs() -> list[Column]:
    """Cumulative counters. Their names promise 7 and 30 days but nothing ever expires; see sliding_counters."""
    kinds = {c: [k for k, v in COUNTERS.items() if v == c] for c in COUNTER_NAMES}
    return [
        F.max("event_time").alias("last_event_time"), *[F.count_if(F.col("event_type").isin(*k)).alias(c) for c, k in kinds.items()],
        F.sum(F.when(F.col("event_type") == "purchase", F.col("amount")).otherwise(0.0)).alias("revenue_30d"),
        F.min("event_time").alias("first_seen_at"), F.count(F.lit(1)).alias("event_count_total")]


def feature_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("customer_id").agg(*counter_aggs())


def sliding_counters(events: DataFrame, days: int = 7, slide: int = 1) -> DataFrame:
    """What the counter names promise: counts in true sliding windows."""
    w = F.window("event_time", f"{days} days", f"{slide} day")
    return events.groupBy("customer_id", w.alias("w")).agg(
        F.col("w.end").alias("window_end"), F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "visit").alias("visits"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases")).drop("w")


def risk_band(score: Column, cold: Column | None = None) -> Column:
    band = (F.when(score >= 0.85, "critical").when(score >= 0.70, "high").when(score >= 0.50, "medium").when(score.isNotNull(), "low"))
    return band if cold is None else F.when(cold, "new").otherwise(band)


def live_scores(state: DataFrame, known: DataFrame) -> DataFrame:
    """Scores for the customers in `state`: a rule for new customers, the stored score for known ones."""
    j = state.join(known, "customer_id", "left")
    cold = F.col("known").isNull()
    n, rev = F.greatest("event_count_total", F.lit(1)), F.coalesce("revenue_30d", F.lit(0.0))
    churn = F.when(cold, F.least(F.greatest(0.60 - 0.06 * n, F.lit(0.15)), F.lit(0.70))).otherwise(F.col("churn_probability"))
    clv = F.when(cold, F.when(rev > 0, rev * 6.0).otherwise(50000.0)).otherwise(F.col("clv"))
    uplift = F.when(cold, 0.12).otherwise(F.col("uplift_score"))
    s = j.select("customer_id", churn.alias("churn_score"), clv.alias("clv"), uplift.alias("uplift_score"), "coupon_cost", cold.cast("int").alias("is_cold"),
                 (cold & (n < 5)).cast("int").alias("is_new_customer"), F.coalesce("persona", F.lit("new_signup")).alias("persona"), "uplift_segment",
                 F.col("last_event_time").alias("scored_at"), "event_count_total")
    profit = F.col("clv") * F.col("uplift_score")
    return s.withColumns({"expected_incremental_profit": profit, "expected_roi": F.when(F.col("coupon_cost") > 0, profit / F.col("coupon_cost")),
                          "risk_segment": risk_band(F.col("churn_score"), F.col("is_cold") == 1)})


def with_policy(s: DataFrame) -> DataFrame:
    """Action, category and intensity from the score rules."""
    churn, up, roi = (F.coalesce(c, F.lit(0.0)) for c in ("churn_score", "uplift_score", "expected_roi"))
    risk = F.lower(F.coalesce("risk_segment", F.lit("")))
    pick = lambda a, c, i: F.struct(F.lit(a).alias("recommended_action"), F.lit(c).alias("recommended_category"), F.lit(i).alias("intervention_intensity"))
    top, high, mid = (churn >= 0.85) | (risk == "critical"), (churn >= 0.70) | (risk == "high"), (churn >= 0.50) | (risk == "medium")
    rule = (F.when(top & (up >= 0.03) & (roi >= 1.0), pick("high_value_retention_benefit", "benefit", "high"))
            .when(top, pick("priority_human_followup", "crm", "high"))
            .when(high & (up >= 0.02), pick("personalized_retention_offer", "benefit", "medium"))
            .when(high, pick("retention_message", "message", "medium"))
            .when(mid, pick("light_retention_message", "message", "low"))
            .when((up >= 0.05) & (roi >= 1.0), pick("low_risk_upsell_offer", "upsell", "low"))
            .otherwise(pick("monitor_only", "monitoring", "none")))
    return s.withColumn("_p", rule).select("*", "_p.*").drop("_p")


def with_action_cost(p: DataFrame) -> DataFrame:
    """Unit cost of the action, and the return on it."""
    base = literal_map(ACTION_COST, F.col("recommended_category"), 5000.0) * literal_map(COST_SCALE, F.col("intervention_intensity"), 1.0)
    implied = F.when(F.col("expected_roi") > 0, F.greatest(F.col("expected_incremental_profit") / F.col("expected_roi"), F.lit(0.0)))
    cost = F.greatest(base, F.coalesce(implied, F.lit(0.0)))
    capped = (F.col("clv") > 0) & F.col("recommended_category").isin("coupon", "crm", "upsell")
    p = p.withColumn("action_cost", F.round(F.when(capped, F.least(cost, F.greatest(F.col("clv") * 0.08, F.lit(1000.0)))).otherwise(cost), 2))
    return p.withColumn("action_roi", F.when(F.col("expected_incremental_profit").isNotNull() & (F.col("action_cost") > 0),
                                             F.col("expected_incremental_profit") / F.col("action_cost")).otherwise(F.col("expected_roi")))


def priority(roi: str = "action_roi") -> Column:
    mass = F.greatest("churn_score", F.lit(0.0)) * F.greatest("clv", F.lit(0.0)) * F.greatest("uplift_score", F.lit(0.0))
    known = F.col("churn_score").isNotNull() & F.col("clv").isNotNull() & F.col("uplift_score").isNotNull()
    return F.coalesce(F.col("expected_incremental_profit"), F.when(known, mass), F.col(roi), F.col("churn_score"), F.lit(0.0))


def queue_rule(threshold: float = 0.5, min_roi: float = 0.0, min_profit: float = 0.0) -> Column:
    return ((F.coalesce("churn_score", F.lit(0.0)) >= threshold) & (F.coalesce(F.col("action_roi"), F.lit(min_roi)) >= min_roi)
            & (F.coalesce(F.col("expected_incremental_profit"), F.lit(min_profit)) >= min_profit))


def live_actions(scores: DataFrame, threshold: float = 0.5, min_roi: float = 0.0, min_profit: float = 0.0) -> DataFrame:
    p = with_action_cost(with_policy(scores))
    return p.withColumn("priority_score", priority()).withColumn("should_queue", queue_rule(threshold, min_roi, min_profit).cast("int"))


def replace_slice(table: DataFrame, fresh: DataFrame, keys: DataFrame, source_type: str) -> DataFrame:
    """Drop the touched customers' rows of one source type, add the fresh ones."""
    old = table.join(keys.select("customer_id", F.lit(source_type).alias("source_type")).distinct(), ["customer_id", "source_type"], "left_anti")
    return old.unionByName(fresh.withColumn("source_type", F.lit(source_type)), allowMissingColumns=True)


def upsert(table: DataFrame, fresh: DataFrame, key: str = "customer_id") -> DataFrame:
    """New values win, NULLs keep the old ones, unknown keys are added."""
    cols = [c for c in table.columns if c != key]
    f = fresh.select(key, *[F.col(c).alias(f"_n_{c}") if c in fresh.columns else F.lit(None).alias(f"_n_{c}") for c in cols])
    return table.join(f, key, "full").select(key, *[F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) for c in cols])


def outer_merge(parts: list[DataFrame], key: str = "customer_id") -> DataFrame:
    """Chain of full joins on the key where the earlier frame's value wins."""
    out = parts[0]
    for p in parts[1:]:
        both = [c for c in p.columns if c in out.columns and c != key]
        r = p.select(key, *[F.col(c).alias(f"_r_{c}") if c in both else F.col(c) for c in p.columns if c != key])
        out = out.join(r, key, "full").withColumns({c: F.coalesce(F.col(c), F.col(f"_r_{c}")) for c in both}).drop(*[f"_r_{c}" for c in both])
    return out


def uplift_bucket(score: Column) -> Column:
    return (F.when(score.isNull(), "unknown_segment").when(score >= 0.08, "very_high_uplift").when(score >= 0.05, "high_uplift")
            .when(score >= 0.02, "medium_uplift").when(score >= 0.0, "low_uplift").otherwise("negative_uplift"))


def investment(df: DataFrame) -> Column:
    """Cost columns in order, else profit / return."""
    costs = [F.when(F.col(c) > 0, F.col(c)) for c in ("action_cost", "coupon_cost", "queued_coupon_cost", "strategy_cost") if c in df.columns]
    return F.coalesce(*costs, F.try_divide(F.col("expected_incremental_profit"), F.col("expected_roi")), F.lit(0.0))


def score_summary(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    c = F.col("churn_score")
    return scores.agg(
        F.count(F.lit(1)).alias("scored_customers"), F.round(F.avg(c), 6).alias("avg_churn_score"), F.count_if(c >= threshold).alias("high_risk_customers"),
        F.count_if(c >= 0.85).alias("critical_band"), F.count_if((c >= 0.70) & (c < 0.85)).alias("high_band"), F.count_if((c >= 0.50) & (c < 0.70)).alias("medium_band"),
        F.count_if(c < 0.50).alias("low_band"), F.round(F.min(c), 6).alias("min_churn_score"), F.round(F.max(c), 6).alias("max_churn_score"))


def drift(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    c = F.col("churn_score")
    return scores.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("stddev"),
                      F.count_if(c >= threshold).alias("high_risk"), F.date_format(F.max("scored_at"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


def ts_normalise(text: Column) -> Column:
    """Repair odd timestamp texts (trailing dot or colon, short offsets, Z) and parse to UTC; bad ones become NULL."""
    t = F.regexp_replace(F.trim(text), r"\s+", " ")
    t = F.regexp_replace(t, r"([T ]\d{2}:\d{2}:\d{2})[.:]$", "$1")
    t = F.regexp_replace(t, r"([T ]\d{2}:\d{2}\S*[+-]\d{2}):?$", "$1:00")
    t = F.regexp_replace(t, r"([T ]\d{2}:\d{2}\S*[+-]\d{2})(\d{2})$", "$1:$2")
    t = F.regexp_replace(t, r"Z$", "+00:00")
    return F.try_to_timestamp(t)
