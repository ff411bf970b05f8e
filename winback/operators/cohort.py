"""Monthly cohorts and the journey of customers who left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winback.functions.ranking import exact_quantiles, previous_in_key
from winback.functions.scalars import month_number, ratio, scalars
from winback.sources.staging import cut

# Event types of each activity definition.
DEFINITIONS = {
    "all_activity": ["visit", "page_view", "search", "add_to_cart", "remove_from_cart", "purchase", "support_contact", "coupon_open", "coupon_redeem"],
    "core_engagement": ["visit", "page_view", "search", "add_to_cart", "purchase"],
    "purchase_only": ["purchase"],
    "purchase_or_redeem": ["purchase", "coupon_redeem"],
}
# The event types that can anchor a churn, and those counted before it.
MEANINGFUL = ["visit", "page_view", "search", "add_to_cart", "remove_from_cart", "purchase", "support_contact"]
PRE_CHURN = ["remove_from_cart", "support_contact", "add_to_cart", "search", "purchase", "coupon_open", "coupon_redeem", "visit", "page_view"]
# The five journey stages.
STAGES = ["가입", "첫구매", "재구매", "충성", "이탈"]


def retention(customers: DataFrame, events: DataFrame, definitions: dict[str, list[str]] | None = None, modes=("point", "rolling"),
              periods: int = 7, end_month: int | None = None, min_events: int = 1) -> DataFrame:
    """Cohort x period retention for several activity definitions and both modes, in one pass over the events.

    Events are folded to customer and month with a count per definition, and written: no step multiplies them by the definitions.
    """
    definitions = definitions or DEFINITIONS
    base = customers.where("acquisition_month IS NOT NULL").select("customer_id", F.col("acquisition_month").alias("cohort_month")).dropDuplicates(["customer_id"])
    base = base.withColumn("c", F.substring("cohort_month", 1, 4).cast("int") * 12 + F.substring("cohort_month", 6, 2).cast("int"))
    # one row a customer and month holds the counts of all definitions
    names, m = list(definitions), month_number(F.col("event_time"))
    monthly = cut(events.groupBy("customer_id", m.alias("m")).agg(*[F.count_if(F.col("event_type").isin(*t)).alias(f"n{i}") for i, t in enumerate(definitions.values())]), "months")
    split = lambda cells: F.explode(F.array(*[F.struct(F.lit(k).alias("activity_definition"), cells(i).alias("x")) for i, k in enumerate(names)])).alias("s")
    ends = monthly.agg(*[F.max(F.when(F.col(f"n{i}") > 0, F.col("m"))).alias(f"e{i}") for i in range(len(names))]).select(split(lambda i: F.col(f"e{i}"))).select(
        "s.activity_definition", F.col("s.x").alias("end_m")).where("end_m IS NOT NULL")
    kept = monthly.join(base, "customer_id").withColumn("period", F.col("m") - F.col("c")).where((F.col("period") >= 0) & (F.col("period") < periods))
    hit = lambda i: (F.col(f"n{i}") > 0) & (F.col(f"n{i}") >= min_events)
    point = kept.groupBy("cohort_month", "period").agg(*[F.count_if(hit(i)).alias(f"h{i}") for i in range(len(names))]).select(
        "cohort_month", "period", split(lambda i: F.col(f"h{i}"))).select("s.activity_definition", "cohort_month", "period", F.col("s.x").alias("hits")).withColumn("retention_mode", F.lit("point"))
    last = kept.groupBy("customer_id", "cohort_month").agg(*[F.max(F.when(hit(i), F.col("period"))).alias(f"l{i}") for i in range(len(names))])
    last = last.select("cohort_month", split(lambda i: F.col(f"l{i}"))).select("s.activity_definition", "cohort_month", F.col("s.x").alias("period")).where("period IS NOT NULL")
    last = last.groupBy("activity_definition", "cohort_month", "period").agg(F.count(F.lit(1)).alias("hits"))
    # customers whose last active period is p count for every period up to p
    rolling = last.select("activity_definition", "cohort_month", F.explode(F.sequence(F.lit(0), "period")).alias("period"), "hits").groupBy(
        "activity_definition", "cohort_month", "period").agg(F.sum("hits").alias("hits")).withColumn("retention_mode", F.lit("rolling"))
    sizes = base.groupBy("cohort_month", "c").agg(F.count(F.lit(1)).alias("cohort_size"))
    grid = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("period"))
    grid = grid.select("*", F.explode(F.array(*[F.lit(k) for k in definitions])).alias("activity_definition")).select(
        "*", F.explode(F.array(*[F.lit(m) for m in modes])).alias("retention_mode"))
    grid = grid.join(ends, "activity_definition", "left")
    end = F.lit(end_month) if end_month is not None else F.coalesce("end_m", "c")
    observed = F.col("period") <= F.greatest(end - F.col("c"), F.lit(0))
    j = grid.join(point.unionByName(rolling), ["activity_definition", "cohort_month", "period", "retention_mode"], "left")
    count = F.when(observed, F.when(F.col("period") == 0, F.col("cohort_size")).otherwise(F.coalesce("hits", F.lit(0))))
    return j.select("cohort_month", "period", "cohort_size", count.alias("retained_customers"), F.round(count / F.col("cohort_size"), 9).alias("retention_rate"),
                    observed.alias("observed"), "activity_definition", "retention_mode", F.lit(min_events).alias("min_events_per_period"))


def upload_retention(customers: DataFrame, events: DataFrame, periods: int = 7) -> DataFrame:
    """The upload variant: month steps from the cohort's first signup day. Both modes carry the same count, so its
    rolling rows are not rolling; use retention() for that."""
    base = customers.where("acquisition_month IS NOT NULL").select("customer_id", F.col("acquisition_month").alias("cohort_month"), "signup_date")
    sizes = base.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"), F.to_date(F.min("signup_date")).alias("start"))
    days = events.groupBy("customer_id", F.to_date("event_time").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    hit = days.join(base.select("customer_id", "cohort_month"), "customer_id").join(sizes, "cohort_month").where(F.col("day") >= F.col("start"))
    # the largest p with add_months(start, p) <= day
    guess = F.floor(F.months_between("day", "start")).cast("int")
    p = F.when(F.add_months("start", guess + 1) <= F.col("day"), guess + 1).when(F.add_months("start", guess) > F.col("day"), guess - 1).otherwise(guess)
    hit = hit.withColumn("period", p).where(F.col("period") < periods)
    member = F.explode(F.array_compact(F.array(*[F.when(F.col("event_type").isin(*DEFINITIONS[k]), F.lit(k)) for k in ("all_activity", "core_engagement", "purchase_only")]))).alias("activity_definition")
    got = hit.select("customer_id", "cohort_month", "period", member).distinct().groupBy("cohort_month", "period", "activity_definition").agg(F.count(F.lit(1)).alias("hits"))
    grid = sizes.select("cohort_month", "cohort_size", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("period")).select(
        "*", F.explode(F.array(*[F.lit(k) for k in ("all_activity", "core_engagement", "purchase_only")])).alias("activity_definition"))
    n = F.when(F.col("period") == 0, F.col("cohort_size")).otherwise(F.coalesce("hits", F.lit(0)))
    return grid.join(got, ["cohort_month", "period", "activity_definition"], "left").select(
        "cohort_month", "period", "cohort_size", "activity_definition", n.alias("retained_customers"), F.round(n / F.col("cohort_size"), 9).alias("retention_rate"),
        F.explode(F.array(F.lit("rolling"), F.lit("point"))).alias("retention_mode"))


def pick(table: DataFrame, definition: str = "core_engagement", mode: str = "rolling", min_size: int = 0, observed_only: bool = True) -> DataFrame:
    t = table.where((F.col("activity_definition") == definition) & (F.col("retention_mode") == mode) & (F.col("cohort_size") >= min_size))
    return t.where("observed") if observed_only else t


def milestones(curve: DataFrame, at=(1, 3, 6, 12)) -> DataFrame:
    return curve.where(F.col("period").isin(*at)).select("cohort_month", "period", "retention_rate", (1 - F.col("retention_rate")).alias("churn_rate"))


def summary(curve: DataFrame) -> DataFrame:
    """Cohort counts, average retention, the period all mature cohorts share, best and worst cohort."""
    per = curve.groupBy("cohort_month").agg(F.max("cohort_size").alias("size"), F.max("period").alias("last_p"), F.max_by("retention_rate", "period").alias("last_r"))
    shared = per.agg(F.min(F.when(F.col("last_p") >= 1, F.col("last_p"))).alias("p")).first()["p"]
    shared = 0 if shared is None else shared
    a = per.agg(F.count(F.lit(1)).alias("cohort_count"), F.round(F.avg("size"), 6).alias("avg_cohort_size"), F.round(F.avg("last_r"), 6).alias("last_observed_avg_retention"),
                F.max_by("cohort_month", F.struct("last_r", "cohort_month")).alias("best_last_cohort"), F.min_by("cohort_month", F.struct("last_r", "cohort_month")).alias("worst_last_cohort"))
    at = F.col("period") == shared
    b = curve.agg(F.count_distinct("period").alias("observed_periods"), F.round(F.avg(F.when(F.col("period") == 1, F.col("retention_rate"))), 6).alias("month1_avg_retention"),
                  F.lit(shared).alias("comparable_period"), F.round(F.avg(F.when(at, F.col("retention_rate"))), 6).alias("comparable_avg_retention"),
                  F.max_by("cohort_month", F.when(at, F.struct("retention_rate", "cohort_month"))).alias("best_comparable_cohort"))
    return a.select("*", *[F.lit(v).alias(k) for k, v in b.first().asDict().items()])


def non_monotonic(curve: DataFrame) -> DataFrame:
    """Cohorts whose curve rises somewhere, with three or more observed points."""
    w = Window.partitionBy("cohort_month").orderBy("period")       # at most one row per period
    t = curve.withColumn("up", (F.col("retention_rate") - F.lag("retention_rate").over(w) > 1e-12).cast("int"))
    return t.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.sum("up"), F.lit(0)).alias("rises")).where("points >= 3 AND rises > 0")


def final_churn_start(snapshots: DataFrame) -> DataFrame:
    """Start of the last unbroken churn_risk run of customers that end in it."""
    per = snapshots.groupBy("customer_id").agg(
        F.max_by("current_status", "snapshot_date").alias("status"), F.max("snapshot_date").alias("final_snapshot_date"),
        F.max(F.when(F.col("current_status") != "churn_risk", F.col("snapshot_date"))).alias("calm")).where("status = 'churn_risk'")
    run = snapshots.join(per, "customer_id").where(F.col("calm").isNull() | (F.col("snapshot_date") > F.col("calm")))
    return run.groupBy("customer_id").agg(F.min("snapshot_date").alias("final_churn_start_date"), F.max("final_snapshot_date").alias("final_snapshot_date"))


def behaviour_anchor(events: DataFrame, churners: DataFrame) -> DataFrame:
    last = events.join(churners.select("customer_id"), "customer_id", "left_semi").groupBy("customer_id").agg(
        F.max(F.when(F.col("event_type").isin(*MEANINGFUL), F.col("event_time"))).alias("m"), F.max("event_time").alias("a"))
    source = F.when(F.col("m").isNotNull(), "last_meaningful_event").when(F.col("a").isNotNull(), "last_any_event").otherwise("final_churn_start_date")
    return churners.join(last, "customer_id", "left").select(
        *churners.columns, F.coalesce("m", "a", F.col("final_churn_start_date").cast("timestamp")).alias("behavior_anchor_time"), source.alias("anchor_source"))


def before_anchor(events: DataFrame, anchors: DataFrame, days: int = 30) -> DataFrame:
    j = events.join(anchors.select("customer_id", "behavior_anchor_time"), "customer_id")
    return j.where((F.col("event_time") <= F.col("behavior_anchor_time"))
                   & (F.col("event_time") >= F.col("behavior_anchor_time") - F.expr(f"INTERVAL {days} DAYS")))


def compress(events: DataFrame, tie: list[str]) -> DataFrame:
    """Drop events that repeat the type before them, per customer in time order."""
    p = previous_in_key(events, ["customer_id"], "event_time", {"event_type": "_before"}, tie)
    return p.where(F.col("_before").isNull() | (F.col("_before") != F.col("event_type"))).drop("_before")


def last_patterns(events: DataFrame, anchors: DataFrame, tie: list[str], n: int = 5) -> DataFrame:
    """The last n distinct steps before the anchor as text; no_history where there are none."""
    # written once: the steps before read their rows twice
    near = before_anchor(events, anchors).select("customer_id", "event_time", "event_type", *[c for c in tie if c not in ("event_time", "event_type")])
    seq = compress(cut(near, "before-anchor"), tie)
    w = Window.partitionBy("customer_id").orderBy(*[F.col(c).desc() for c in ["event_time", *tie]])
    tail = seq.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    text = tail.groupBy("customer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_rn")).alias("o"), "event_type"))), lambda x: x["event_type"]), " > ").alias("pattern"))
    return anchors.select("customer_id").join(text, "customer_id", "left").withColumn("pattern", F.coalesce("pattern", F.lit("no_history")))


def top_patterns(patterns: DataFrame, n: int = 5) -> DataFrame:
    total = max(patterns.count(), 1)
    top = patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("customer_count")).orderBy(F.desc("customer_count"), "pattern").limit(n)
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("customer_count"), "pattern")       # n rows
    return top.select(F.row_number().over(w).alias("rank"), "pattern", "customer_count", F.round(F.col("customer_count") / total, 6).alias("share_of_churn_customers"))


def pre_churn_counts(window: DataFrame, total: int) -> DataFrame:
    got = window.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("customer_id").alias("c"))
    names = window.sparkSession.createDataFrame([(k,) for k in PRE_CHURN], "event_type string")
    c = F.coalesce("c", F.lit(0))
    return names.join(got, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("event_count"), c.alias("customer_count"),
                                                        F.round(c / max(total, 1), 6).alias("customer_share"))


def funnel(customers: DataFrame, orders: DataFrame, churners: DataFrame) -> DataFrame:
    per = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    j = customers.select("customer_id").join(per, "customer_id", "left").join(churners.select("customer_id", F.lit(1).alias("gone")), "customer_id", "left")
    n = F.coalesce("n", F.lit(0))
    counts = j.agg(F.count(F.lit(1)).alias("s0"), F.count_if(n >= 1).alias("s1"), F.count_if(n >= 2).alias("s2"), F.count_if(n >= 3).alias("s3"), F.count("gone").alias("s4"))
    rows = [F.struct(F.lit(STAGES[i]).alias("stage"), F.col(f"s{i}").alias("customer_count"),
                     (F.lit(1.0) if i == 0 else F.round(F.col(f"s{i}") / F.greatest("s0", F.lit(1)), 6)).alias("stage_rate_from_signup"),
                     (F.lit(1.0) if i == 0 else F.round(F.col(f"s{i}") / F.greatest(F.col(f"s{i - 1}"), F.lit(1)), 6)).alias("transition_rate_from_prev"))
            for i in range(5)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def churn_stages(customers: DataFrame, orders: DataFrame, churners: DataFrame) -> DataFrame:
    """Stage reached and days from signup to the final churn run."""
    base = churners.select("customer_id", "final_churn_start_date").join(customers.select("customer_id", "signup_date"), "customer_id", "left")
    before = orders.join(churners.select("customer_id", "final_churn_start_date"), "customer_id").where(
        F.col("order_time") <= F.col("final_churn_start_date").cast("timestamp")).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    stage = F.when(n >= 3, STAGES[3]).when(n == 2, STAGES[2]).when(n == 1, STAGES[1]).otherwise(STAGES[0])
    t = base.join(before, "customer_id", "left").select(stage.alias("churn_stage"), F.greatest(F.datediff("final_churn_start_date", "signup_date"), F.lit(0)).alias("days"))
    total = scalars(t, n=F.count(F.lit(1)))["n"]
    med = exact_quantiles(t, ["days"], [0.5], by=["churn_stage"]).select("churn_stage", F.col("q0").alias("median_days_to_churn"))
    return t.groupBy("churn_stage").agg(F.count(F.lit(1)).alias("churned_customers"), F.round(F.avg("days"), 6).alias("avg_days_to_churn")).join(med, "churn_stage").withColumn(
        "share_of_churn_customers", F.round(ratio(F.col("churned_customers"), F.lit(total)), 6))
