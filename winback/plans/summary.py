"""The customer summary job: order, exposure and event tables to one scored row per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winback import params
from winback.functions.ranking import with_rank_pct
from winback.functions.scalars import change_rate, in_window, ratio
from winback.operators import scores
from winback.sources import adapters
from winback.sources.staging import staged


def base_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts and amounts as of the order date: every window in one pass per source table."""
    end = F.lit(params.AS_OF_ORDERS).cast("timestamp")
    o = adapters.orders(spark, d).where(F.col("order_time") <= end)
    per_order = o.groupBy("customer_id").agg(
        F.datediff(end, F.max("order_time")).alias("recency_days"), F.count(F.lit(1)).alias("frequency"),
        F.round(F.sum("net_amount"), 4).alias("monetary"),
        F.count_if(in_window(F.col("order_time"), end, 30)).alias("purchase_last_30"),
        F.count_if(in_window(F.col("order_time"), end - F.expr("INTERVAL 30 DAYS"), 30)).alias("purchase_prev_30"),
        F.sum("discount_amount").alias("_disc"), F.sum("gross_amount").alias("_gross"))
    e = adapters.order_events(spark, d).where((F.col("event_time") <= end) & (F.col("event_type") != "purchase"))
    t = F.col("event_time")
    per_event = e.groupBy("customer_id").agg(
        F.count_if(in_window(t, end, 7)).alias("visits_last_7"),
        F.count_if(in_window(t, end - F.expr("INTERVAL 7 DAYS"), 7)).alias("visits_prev_7"),
        F.count_if(F.col("event_type") == "support_contact").alias("_support"), F.count(F.lit(1)).alias("_events"),
        F.max("event_time").alias("_last_event"))
    x = adapters.exposures(spark, d).where(F.col("exposure_time") <= end).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("exposure_count"))
    c = adapters.customers(spark, d)
    j = c.join(per_order, "customer_id", "left").join(per_event, "customer_id", "left").join(x, "customer_id", "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    disc = scores.discount_scores(F.coalesce("_disc", F.lit(0.0)), F.coalesce("_gross", F.lit(0.0)), zero("exposure_count"))
    recency = F.coalesce("recency_days", F.lit(999))
    return j.select(
        *c.columns, recency.alias("recency_days"), zero("frequency").alias("frequency"),
        F.coalesce("monetary", F.lit(0.0)).alias("monetary"),
        zero("visits_last_7").alias("visits_last_7"), zero("visits_prev_7").alias("visits_prev_7"),
        F.round(change_rate(zero("visits_last_7"), zero("visits_prev_7")), 9).alias("visit_change_rate"),
        zero("purchase_last_30").alias("purchase_last_30"), zero("purchase_prev_30").alias("purchase_prev_30"),
        F.round(change_rate(zero("purchase_last_30"), zero("purchase_prev_30")), 9).alias("purchase_change_rate"),
        F.round(ratio(zero("_support"), zero("_events")), 9).alias("support_contact_propensity"),
        zero("exposure_count").alias("exposure_count"),
        F.least(recency, F.coalesce(F.datediff(end, F.col("_last_event")), F.lit(999))).alias("inactivity_days"),
        *[v.alias(n) for n, v in disc.items()],
        (recency >= params.CHURN_DAYS).cast("double").alias("churn_label_observed"))


def customer_summary(spark: SparkSession, d: str) -> DataFrame:
    """The full scored summary, written once and shared by every later job."""
    def build() -> DataFrame:
        base = staged(spark, d, "summary_base", lambda: base_summary(spark, d))
        s = staged(spark, d, "summary_churn", lambda: scores.churn_proxy(base, "churn_label_observed"))
        return scores.with_uplift_quadrant(scores.value_scores(s))
    return staged(spark, d, "summary", build)


def survival_scores(spark: SparkSession, d: str) -> DataFrame:
    """Survival columns from the churn score, for use where no fitted hazard model is at hand.

    A constant monthly hazard: S(t) = (1 - p)^(t/30).
    """
    def build() -> DataFrame:
        s = customer_summary(spark, d)
        mean = s.agg(F.avg("churn_probability")).first()[0]
        p = F.col("churn_probability")
        live = 1 - p
        days = F.ceil(F.round(30 * F.log(F.lit(0.5)) / F.log(live), 6))
        out = s.select(
            "customer_id", F.round(p / F.lit(mean), 9).alias("predicted_hazard_ratio"),
            F.least(days, F.lit(params.HORIZON_DAYS)).cast("double").alias("predicted_median_time_to_churn_days"),
            *[F.round(F.pow(live, F.lit(t / 30.0)), 9).alias(f"survival_prob_{t}d") for t in (1, 30, 60, 90)])
        out = with_rank_pct(out, {"predicted_hazard_ratio": "_p"})
        return out.withColumn("risk_percentile", F.round("_p", 9)).drop("_p").withColumn(
            "risk_group", F.when(F.col("risk_percentile") <= 1 / 3, "Low Risk")
            .when(F.col("risk_percentile") <= 2 / 3, "Mid Risk").otherwise("High Risk"))
    return staged(spark, d, "survival", build)
