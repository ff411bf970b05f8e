"""As-of features: one conditional aggregate per source table, half-open windows (end - d, end]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winback.functions.ranking import exact_quantiles, previous_in_key
from winback.functions.scalars import change_rate, clip, days_between, in_window, ratio, scalars
from winback.sources.staging import cut

# The standard event types, in alphabetical order.
EVENT_TYPES = ["add_to_cart", "coupon_open", "coupon_redeem", "other", "page_view", "purchase", "remove_from_cart", "search",
               "support_contact", "visit"]
# Event types that do not count as activity.
NON_ACTIVITY = ["ignore", "other", "unknown", "nan"]
# Statuses that mean a customer has left.
CHURN_STATUSES = ["churn_risk", "churned", "inactive", "cancelled", "canceled", "unsubscribed"]


def _ts(value: str) -> Column:
    return F.lit(value).cast("timestamp")


def _back(end: Column, days: int) -> Column:
    return end - F.expr(f"INTERVAL {days} DAYS")


def data_span(events: DataFrame, orders: DataFrame) -> DataFrame:
    """First and last activity over both tables, and the whole days between."""
    e = events.agg(F.min("event_time").alias("a"), F.max("event_time").alias("b"))
    o = orders.agg(F.min("order_time").alias("a"), F.max("order_time").alias("b"))
    u = e.unionByName(o).agg(F.min("a").alias("first_time"), F.max("b").alias("last_time"))
    return u.withColumn("span_days", F.floor(days_between(F.col("last_time"), F.col("first_time"))).cast("int"))


def adjust_horizon(span_days: int, requested: int) -> int:
    """Shorten the label horizon when the data does not cover it."""
    if span_days < 60:
        return 0
    if span_days < 90:
        return 30
    return max(30, span_days // 2) if span_days < 180 else requested


def event_features(events: DataFrame, as_of: str, short: int = 14, mid: int = 30, long: int = 90) -> DataFrame:
    """Window counts, last event, time-of-day shares, type mix and dominant type in one pass."""
    end, t, kind = _ts(as_of), F.col("event_time"), F.col("event_type")

    def n(event: str, days: int, back: int = 0) -> Column:
        return F.count_if((kind == event) & in_window(t, _back(end, back) if back else end, days))
    recent = in_window(t, end, long)
    hour, weekend = F.hour(t), F.weekday(t) >= 5
    aggs = [
        F.max(t).alias("last_event_time"),
        n("visit", short).alias(f"visits_{short}d"), n("visit", short, short).alias(f"visits_prev_{short}d"),
        n("purchase", short).alias(f"purchases_{short}d"), n("purchase", short, short).alias(f"purchases_prev_{short}d"),
        n("search", mid).alias(f"searches_{mid}d"), n("search", mid, mid).alias(f"searches_prev_{mid}d"),
        n("add_to_cart", mid).alias(f"add_to_cart_{mid}d"), n("add_to_cart", mid, mid).alias(f"add_to_cart_prev_{mid}d"),
        n("coupon_open", mid).alias(f"coupon_open_{mid}d"), n("coupon_open", mid, mid).alias(f"coupon_open_prev_{mid}d"),
        n("support_contact", mid).alias(f"support_contact_{mid}d"), n("visit", long).alias(f"visits_{long}d"),
        F.count_if(recent & (hour >= 18)).alias("_evening"), F.count_if(recent & (hour < 6)).alias("_night"),
        F.count_if(recent & (hour >= 9) & (hour < 18)).alias("_work"), F.count_if(recent & weekend).alias("_weekend"),
        F.count_if(recent).alias("_total"),
        *[F.count_if(recent & (kind == k)).alias(f"n_{k}") for k in EVENT_TYPES]]
    g = events.where(t <= end).groupBy("customer_id").agg(*aggs)
    top = F.array_max(F.array(*[F.struct(F.col(f"n_{k}").alias("n"), F.lit(-i).alias("i")) for i, k in enumerate(EVENT_TYPES)]))
    name = F.element_at(F.array(*[F.lit(k) for k in EVENT_TYPES]), 1 - top.getField("i"))
    share = lambda c: F.round(ratio(F.col(c), F.col("_total")), 6)
    return g.withColumns({
        f"visit_change_rate_{short}d": F.round(change_rate(F.col(f"visits_{short}d"), F.col(f"visits_prev_{short}d")), 6),
        f"purchase_change_rate_{short}d": F.round(change_rate(F.col(f"purchases_{short}d"), F.col(f"purchases_prev_{short}d")), 6),
        "evening_activity_ratio": share("_evening"), "night_activity_ratio": share("_night"),
        "workhour_activity_ratio": share("_work"), "weekend_activity_ratio": share("_weekend"),
        f"event_diversity_{long}d": sum(((F.col(f"n_{k}") > 0).cast("int") for k in EVENT_TYPES), F.lit(0)),
        f"dominant_event_type_{long}d": F.when(F.col("_total") > 0, name).otherwise("none"),
    }).drop("_evening", "_night", "_work", "_weekend", "_total")


def active_days(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """Distinct active days per customer, by way of one row per customer and day."""
    hit = events.where(in_window(F.col("event_time"), _ts(as_of), days)).groupBy("customer_id", F.to_date("event_time").alias("day")).count()
    return hit.groupBy("customer_id").agg(F.count(F.lit(1)).alias(f"active_days_{days}d"))


def order_features(orders: DataFrame, as_of: str, mid: int = 30, long: int = 90) -> DataFrame:
    """Order counts and spend per window, purchase cycle means, weekend share. The mean gap needs no ordering."""
    end, t = _ts(as_of), F.col("order_time")
    prev = in_window(t, _back(end, mid), mid)
    g = orders.where(t <= end).groupBy("customer_id").agg(
        F.max(t).alias("last_purchase_time"), F.min(t).alias("_first"), F.count(F.lit(1)).alias("_n"),
        F.count_if(in_window(t, end, mid)).alias(f"frequency_{mid}d"), F.count_if(prev).alias(f"frequency_prev_{mid}d"),
        F.count_if(in_window(t, end, long)).alias(f"frequency_{long}d"),
        F.sum(F.when(in_window(t, end, mid), F.col("net_amount")).otherwise(0.0)).alias(f"monetary_{mid}d"),
        F.sum(F.when(in_window(t, end, long), F.col("net_amount")).otherwise(0.0)).alias(f"monetary_{long}d"),
        F.avg("quantity").alias("avg_items_per_order_90d"), F.avg("coupon_used").alias("orders_with_coupon_ratio_90d"),
        F.count_if(in_window(t, end, long) & (F.weekday(t) >= 5)).alias("_weekend"))
    gap = F.when(F.col("_n") > 1, days_between(F.col("last_purchase_time"), F.col("_first")) / (F.col("_n") - 1))
    idle = days_between(end, F.col("last_purchase_time"))
    weekend = ratio(F.col("_weekend"), F.col(f"frequency_{long}d"))
    return g.select(
        "customer_id", "last_purchase_time", f"frequency_{mid}d", f"frequency_prev_{mid}d", f"frequency_{long}d",
        F.round(f"monetary_{mid}d", 4).alias(f"monetary_{mid}d"), F.round(f"monetary_{long}d", 4).alias(f"monetary_{long}d"),
        F.round(ratio(F.col(f"monetary_{long}d"), F.col(f"frequency_{long}d")), 6).alias(f"avg_order_value_{long}d"),
        F.round(gap, 6).alias("avg_purchase_gap_days"), F.round("avg_items_per_order_90d", 6).alias("avg_items_per_order_90d"),
        F.round("orders_with_coupon_ratio_90d", 6).alias("orders_with_coupon_ratio_90d"), F.round(idle, 6).alias("current_non_purchase_days"),
        F.round(ratio(idle, gap), 6).alias("purchase_cycle_anomaly"), F.round(weekend, 6).alias("weekend_purchase_ratio"),
        F.round(1 - weekend, 6).alias("weekday_purchase_ratio"))


def median_gap(orders: DataFrame, as_of: str) -> DataFrame:
    """Exact median days between consecutive orders of a customer."""
    hist = orders.where(F.col("order_time") <= _ts(as_of)).select("customer_id", "order_id", "order_time")
    gaps = previous_in_key(hist, ["customer_id"], "order_time", {"order_time": "prev"}, ["order_id"])
    gaps = gaps.where("prev IS NOT NULL").select("customer_id", days_between(F.col("order_time"), F.col("prev")).alias("gap"))
    q = exact_quantiles(gaps, ["gap"], [0.5], by=["customer_id"])
    return q.select("customer_id", F.round("q0", 6).alias("median_purchase_gap_days"))


def sessions(events: DataFrame, as_of: str, back: int = 60) -> DataFrame:
    """One row per customer session: start, length and counts by type."""
    kind = F.col("event_type")
    s = events.where(in_window(F.col("event_time"), _ts(as_of), back)).groupBy("customer_id", "session_id").agg(
        F.min("event_time").alias("session_start"), F.max("event_time").alias("_end"),
        *[F.count_if(kind == k).alias(k) for k in ("page_view", "search", "add_to_cart", "support_contact", "purchase")])
    return s.withColumn("session_duration_sec", (F.unix_micros("_end") - F.unix_micros("session_start")) / F.lit(1e6)).drop("_end")


def session_features(events: DataFrame, as_of: str, mid: int = 30) -> DataFrame:
    """Session means and medians for the recent and the previous window."""
    end = _ts(as_of)
    s = sessions(events, as_of, 2 * mid)
    now, old = in_window(F.col("session_start"), end, mid), in_window(F.col("session_start"), _back(end, mid), mid)
    dur = F.col("session_duration_sec")
    cols = {}
    for cond, tag in ((now, f"{mid}d"), (old, f"prev_{mid}d")):
        cols[f"avg_session_duration_sec_{tag}"] = F.avg(F.when(cond, dur))
        cols[f"pageviews_per_session_{tag}"] = F.avg(F.when(cond, F.col("page_view")))
        cols[f"searches_per_session_{tag}"] = F.avg(F.when(cond, F.col("search")))
        cols[f"support_contacts_per_session_{tag}"] = F.avg(F.when(cond, F.col("support_contact")))
        cols[f"sessions_{tag}"] = F.count_if(cond)
    g = s.groupBy("customer_id").agg(*[(F.round(c, 6) if not n.startswith("sessions") else c).alias(n) for n, c in cols.items()])
    marked = s.select("customer_id", F.when(now, dur).alias("m"), F.when(old, dur).alias("p"))
    q = exact_quantiles(marked, ["m", "p"], [0.5], by=["customer_id"]).groupBy("customer_id").agg(
        F.round(F.max(F.when(F.col("col") == "m", F.col("q0"))), 6).alias(f"median_session_duration_sec_{mid}d"),
        F.round(F.max(F.when(F.col("col") == "p", F.col("q0"))), 6).alias(f"median_session_duration_sec_prev_{mid}d"))
    return g.join(q, "customer_id", "left")


def session_conversion(events: DataFrame, orders: DataFrame, as_of: str, back: int = 60) -> DataFrame:
    """Purchase days per session with a search."""
    s = sessions(events, as_of, back).groupBy("customer_id").agg(F.count_if(F.col("search") > 0).alias("search_sessions_total"))
    o = (orders.where(in_window(F.col("order_time"), _ts(as_of), back)).groupBy("customer_id", F.to_date("order_time").alias("day")).count()
         .groupBy("customer_id").agg(F.count(F.lit(1)).alias("purchase_days_total")))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).alias(n)
    j = s.join(o, "customer_id", "full").select("customer_id", zero("search_sessions_total"), zero("purchase_days_total"))
    return j.withColumn("search_to_purchase_conversion_total", F.round(ratio(F.col("purchase_days_total"), F.col("search_sessions_total")), 6))


def recent_sequence(events: DataFrame, as_of: str, n: int = 10) -> DataFrame:
    """Last n event types in time order. The per-customer limit is applied before the shuffle."""
    w = Window.partitionBy("customer_id").orderBy(F.col("event_time").desc(), F.col("event_id").desc())
    top = events.where(F.col("event_time") <= _ts(as_of)).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    packed = F.array_sort(F.collect_list(F.struct("event_time", "event_id", "event_type")))
    return top.groupBy("customer_id").agg(F.array_join(F.transform(packed, lambda x: x["event_type"]), " > ").alias("recent_event_sequence"))


#: Steps of the clustering. A fixed number, so that a repeated run ends in the same place.
LLOYD_STEPS = 8


def event_mix(features: DataFrame) -> DataFrame:
    """(customer_id, mix): the share of each event type, for customers with an event."""
    total = sum((F.col(f"n_{t}") for t in EVENT_TYPES), F.lit(0))
    return features.withColumn("_t", total).where("_t > 0").select("customer_id", F.array(*[F.round(F.col(f"n_{t}") / F.col("_t"), 9) for t in EVENT_TYPES]).alias("mix"))


def _apart(a: Column, centre: list[float]) -> Column:
    return F.round(sum(((a[i] - F.lit(x)) * (a[i] - F.lit(x)) for i, x in enumerate(centre)), F.lit(0.0)), 9)


def _nearest(centres: list[list[float]]) -> Column:
    """(squared distance, number) of the nearest centre, the first of equally near ones."""
    return F.array_min(F.array(*[F.struct(_apart(F.col("mix"), c).alias("far"), F.lit(i).alias("id")) for i, c in enumerate(centres)]))


def behaviour_cluster(features: DataFrame, k: int = 6, steps: int = LLOYD_STEPS) -> DataFrame:
    """Clusters of the event type shares of a customer: k-means by plain aggregates.

    The first centre is the mix of the smallest customer_id, each further one the mix farthest from those before it (of the smallest customer_id among equally far ones). Then come a
    fixed number of steps, each one aggregate over all customers of which k means reach the driver; a centre without customers stays. Shares, distances and means are held to
    nine places, so the order of summing doesn't show.
    """
    mix = cut(event_mix(features), "event-mix")
    k = max(2, min(k, mix.limit(k + 1).count()))
    first = mix.agg(F.min_by("mix", "customer_id")).first()[0]
    if first is None:
        return mix.select("customer_id", F.lit(0).alias("behavior_cluster_id"))
    centres = [list(first)]
    while len(centres) < k:
        centres.append(list(mix.agg(F.max_by("mix", F.struct(_nearest(centres)["far"].alias("far"), (-F.col("customer_id")).alias("id")))).first()[0]))
    for _ in range(steps):
        means = mix.groupBy(_nearest(centres)["id"].alias("id")).agg(*[F.round(F.avg(F.col("mix")[i]), 9).alias(f"m{i}") for i in range(len(EVENT_TYPES))]).collect()
        for r in means:
            centres[r["id"]] = [r[f"m{i}"] for i in range(len(EVENT_TYPES))]
    return mix.select("customer_id", _nearest(centres)["id"].alias("behavior_cluster_id"))


def activity_snapshots(activity: DataFrame, amounts: DataFrame, end: str, step: int = 7, risk: int = 30) -> DataFrame:
    """Per-customer grid of snapshot dates with the state as of each date.

    `activity` holds visit and purchase rows, `amounts` the average order amount per customer. Activity is
    first folded to one row per customer and day, then to one per snapshot that it changes; only those pass the
    window, however busy the customer and however long the grid. Times count as of midnight, totals as of the end of the day.
    """
    last, t, kind = F.lit(end).cast("date"), F.col("event_time"), F.col("event_type")
    day = F.to_date("event_time")
    midnight = t == day.cast("timestamp")
    bought = kind == "purchase"
    days = activity.where(day <= last).groupBy("customer_id", day.alias("day")).agg(
        F.count_if(kind == "visit").alias("v"), F.count_if(bought).alias("p"), F.max(t).alias("at"), F.max(F.when(bought, t)).alias("pt"),
        F.max(F.when(midnight, t)).alias("a0"), F.max(F.when(midnight & bought, t)).alias("p0"))
    # a day counts from the first snapshot on or after it; on that day itself, times after midnight count from the next one
    days = days.withColumn("start", F.min("day").over(Window.partitionBy("customer_id")))
    days = days.withColumn("k", F.ceil(F.datediff("day", "start") / F.lit(float(step))).cast("int"))
    on_time = F.col("day") < F.least(F.expr(f"date_add(start, k * {step})"), last)
    slots = days.groupBy("customer_id", "start", "k").agg(
        F.sum("v").alias("v"), F.sum("p").alias("p"), F.max(F.when(on_time, F.col("at")).otherwise(F.col("a0"))).alias("a"),
        F.max(F.when(on_time, F.col("pt")).otherwise(F.col("p0"))).alias("b"), F.max("at").alias("at"), F.max("pt").alias("pt"))
    w = Window.partitionBy("customer_id").orderBy("k")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    final = F.ceil(F.datediff(last, F.col("start")) / F.lit(float(step))).cast("int")
    # the state of a slot holds until the one before the next slot: the grid is filled after the windows, not before them
    state = slots.select(
        "customer_id", "start", "k", "v", "p", F.coalesce(F.lead("k").over(w) - 1, final).alias("to"),
        F.sum("v").over(upto).alias("visits_total"), F.sum("p").over(upto).alias("purchases_total"),
        F.greatest(F.max("a").over(upto), F.max("at").over(before)).alias("first_visit"), F.max("at").over(upto).alias("next_visit"),
        F.greatest(F.max("b").over(upto), F.max("pt").over(before)).alias("first_purchase"), F.max("pt").over(upto).alias("next_purchase"))
    state = state.join(amounts, "customer_id", "left").withColumn("i", F.explode(F.sequence("k", "to")))
    own = F.col("i") == F.col("k")
    snap = F.least(F.expr(f"date_add(start, i * {step})"), last)
    gain = lambda c: F.when(own, F.least(F.col(c), F.lit(2)).cast("double")).otherwise(0.0)
    state = state.select(
        "customer_id", snap.alias("day"), "visits_total", "purchases_total", "avg_amount", gain("v").alias("gv"), gain("p").alias("gp"),
        F.when(own, F.col("first_visit")).otherwise(F.col("next_visit")).alias("last_visit_date"),
        F.when(own, F.col("first_purchase")).otherwise(F.col("next_purchase")).alias("last_purchase_date"))
    seen = F.coalesce("last_visit_date", F.col("day").cast("timestamp"))
    idle = F.greatest(F.floor(days_between(F.col("day").cast("timestamp"), seen)).cast("int"), F.lit(0))
    return state.select(
        "customer_id", F.col("day").alias("snapshot_date"), seen.alias("last_visit_date"), F.coalesce("last_purchase_date", seen).alias("last_purchase_date"),
        "visits_total", "purchases_total", F.round(F.col("purchases_total") * F.coalesce("avg_amount", F.lit(0.0)), 6).alias("monetary_total"),
        idle.alias("inactivity_days"), status(idle, max(round(risk / 2), 1), risk).alias("current_status"),
        F.col("gv").alias("recent_visit_score"), F.col("gp").alias("recent_purchase_score"))


def status(inactivity: Column, dormant: int = 14, risk: int = 30) -> Column:
    return F.when(inactivity >= risk, "churn_risk").when(inactivity >= dormant, "dormant").otherwise("active")


def summary_snapshots(summary: DataFrame, end: str, points: int = 12, step: int = 30, dormant: int = 14, risk: int = 30) -> DataFrame:
    """A back-dated grid from the summary, for uploads without history."""
    back = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("back")
    g = summary.select("customer_id", "inactivity_days", "frequency", "monetary", back)
    idle = F.greatest(F.col("inactivity_days") - F.col("back") * step, F.lit(0))
    return g.select("customer_id", F.date_sub(F.lit(end).cast("date"), F.col("back") * step).alias("snapshot_date"), idle.alias("inactivity_days"),
                    F.col("frequency").alias("purchases_total"), F.col("monetary").alias("monetary_total"), status(idle, dormant, risk).alias("current_status"))


def state_at(snapshots: DataFrame, as_of: str) -> DataFrame:
    """Last snapshot up to a date and the days its status has lasted."""
    h = snapshots.where(F.col("snapshot_date") <= F.lit(as_of).cast("date")).select("customer_id", "snapshot_date", "current_status", "inactivity_days")
    last = h.groupBy("customer_id").agg(F.max_by(F.struct("snapshot_date", "current_status", "inactivity_days"), "snapshot_date").alias("l"))
    j = h.join(last, "customer_id")
    # the run began right after the last snapshot with another status
    g = j.groupBy("customer_id").agg(F.first("l").alias("l"), F.max(F.when(F.col("current_status") != F.col("l.current_status"), F.col("snapshot_date"))).alias("brk"))
    start = (h.join(g, "customer_id").where(F.col("brk").isNull() | (F.col("snapshot_date") > F.col("brk")))
             .groupBy("customer_id").agg(F.first("l").alias("l"), F.min("snapshot_date").alias("s")))
    return start.select("customer_id", F.col("l.current_status").alias("current_journey_stage"), F.col("l.inactivity_days").alias("inactivity_days"),
                        (F.datediff("l.snapshot_date", "s") + 1).alias("journey_stage_days"))


def future_label(base: DataFrame, events: DataFrame, orders: DataFrame, snapshots: DataFrame, as_of: str, horizon: int) -> DataFrame:
    """1 when nothing happens in (as_of, as_of + horizon], or the last status there is a churn status."""
    start = _ts(as_of)
    end = start + F.expr(f"INTERVAL {horizon} DAYS")
    ahead = lambda c: (F.col(c) > start) & (F.col(c) <= end)
    act = (events.where(ahead("event_time") & ~F.lower("event_type").isin(*NON_ACTIVITY)).select("customer_id")
           .unionByName(orders.where(ahead("order_time")).select("customer_id")).groupBy("customer_id").agg(F.count(F.lit(1)).alias("_acts")))
    st = snapshots.where(ahead("snapshot_date")).groupBy("customer_id").agg(F.max_by("current_status", "snapshot_date").alias("_status"))
    j = base.join(act, "customer_id", "left").join(st, "customer_id", "left")
    gone = F.coalesce(F.lower("_status").isin(*CHURN_STATUSES), F.lit(False))
    return j.withColumn("label", (F.col("_acts").isNull() | gone).cast("int")).drop("_acts", "_status")


# Daily decay and increments of the activity scores.
DECAYS = {"recent_visit_score": (0.86, {"visit": 1.0}), "recent_purchase_score": (0.91, {"purchase": 1.5}),
          "recent_cart_abandon_score": (0.88, {"remove_from_cart": 1.0}), "recent_exposure_score": (0.90, {"exposure": 1.0})}


def decayed_scores(events: DataFrame, as_of: str) -> DataFrame:
    """Add-and-decay scores as one sum per score: each event counts decay ** (days before the as-of day)."""
    end = F.lit(as_of).cast("date")
    age = F.datediff(end, "event_time")
    cols = []
    for name, (decay, steps) in DECAYS.items():
        inc = sum((F.when(F.col("event_type") == k, v).otherwise(0.0) for k, v in steps.items()), F.lit(0.0))
        cols.append(F.round(F.sum(inc * F.pow(F.lit(decay), age)), 6).alias(name))
    return events.where(F.to_date("event_time") <= end).groupBy("customer_id").agg(*cols)


def fatigue_scores(orders: DataFrame, exposures: DataFrame, as_of: str, fatigue_decay: float = 0.94, dependency_decay: float = 0.96) -> DataFrame:
    """Coupon fatigue and discount dependency: decay per day, rise with offers, fall with organic orders, never below 0.

    The floor makes these an ordered fold. Rows are first summed per customer and day, and the fold runs over
    the days with activity.
    """
    end = F.lit(as_of).cast("date")
    x = exposures.select("customer_id", F.to_date("exposure_time").alias("day"), F.lit(1).alias("x"), F.lit(0).alias("o"), F.lit(0).alias("c"))
    o = orders.select("customer_id", F.to_date("order_time").alias("day"), F.lit(0).alias("x"), (1 - F.col("coupon_used")).alias("o"), F.col("coupon_used").alias("c"))
    days = x.unionByName(o).where(F.col("day") <= end).groupBy("customer_id", "day").agg(F.sum("x").alias("x"), F.sum("o").alias("o"), F.sum("c").alias("c"))
    seq = days.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("day", "x", "o", "c"))).alias("days"))
    start = F.struct(F.lit(None).cast("date").alias("day"), F.lit(0.0).alias("f"), F.lit(0.0).alias("d"))

    def step(acc: Column, row: Column) -> Column:
        gap = F.coalesce(F.datediff(row["day"], acc["day"]), F.lit(0))
        f = F.greatest(acc["f"] * F.pow(F.lit(fatigue_decay), gap) + row["x"] + 0.35 * row["c"] - 0.35 * row["o"], F.lit(0.0))
        d = F.greatest(acc["d"] * F.pow(F.lit(dependency_decay), gap) + 0.75 * row["c"] - 0.25 * row["o"], F.lit(0.0))
        return F.struct(row["day"].alias("day"), f.alias("f"), d.alias("d"))
    got = seq.select("customer_id", F.aggregate("days", start, step).alias("s"))
    gap = F.datediff(end, F.col("s.day"))
    return got.select("customer_id", F.round(F.col("s.f") * F.pow(F.lit(fatigue_decay), gap), 6).alias("coupon_fatigue_score"),
                      F.round(F.col("s.d") * F.pow(F.lit(dependency_decay), gap), 6).alias("discount_dependency_score"))


def exposure_eligible(summary: DataFrame, assignments: DataFrame, exposures: DataFrame, as_of: str, cooldown: int = 14,
                      max_exposures: int = 4, idle: int = 10) -> DataFrame:
    """Treated customers that may be sent an offer on the as-of day."""
    end = F.lit(as_of).cast("date")
    x = exposures.where(F.to_date("exposure_time") <= end).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("exposures"), F.max("exposure_time").alias("last_exposure"))
    j = assignments.where("treatment_flag = 1").join(summary.select("customer_id", "inactivity_days"), "customer_id").join(x, "customer_id", "left")
    ok = ((F.coalesce(F.datediff(end, "last_exposure"), F.lit(999)) >= cooldown) & (F.coalesce("exposures", F.lit(0)) < max_exposures)
          & ((F.col("inactivity_days") >= idle) | (F.to_date("assigned_at") == end)))
    return j.where(ok).select("customer_id", "inactivity_days", F.coalesce("exposures", F.lit(0)).alias("exposures"))


def resolve_label(computed: DataFrame, observed: str | None) -> tuple[DataFrame, str]:
    """Use the uploaded label when it has two values, else the computed one."""
    if observed and observed in computed.columns:
        kinds = scalars(computed, n=F.count_distinct((F.col(observed) >= 0.5).cast("int")))["n"]
        if kinds == 2:
            return computed.withColumn("label", F.coalesce((F.col(observed) >= 0.5).cast("int"), F.col("label"))), "uploaded_label"
    return computed, "future_activity_horizon"


def winsorise_impute(df: DataFrame, cols: list[str], text: list[str] | None = None) -> DataFrame:
    """Clip to the 1st and 99th percentile, then fill with the median; text NULLs become unknown."""
    q = {r["col"]: r for r in exact_quantiles(df, cols, [0.01, 0.5, 0.99]).collect()}
    out = {}
    for c in cols:
        lo, med, hi = (q[c]["q0"], q[c]["q1"], q[c]["q2"]) if c in q else (0.0, 0.0, 0.0)
        out[c] = F.coalesce(clip(F.col(c).cast("double"), lo, hi), F.lit(med))
    for c in text or []:
        out[c] = F.coalesce(F.col(c), F.lit("unknown"))
    return df.withColumns(out)


def exposure_features(exposures: DataFrame, as_of: str, mid: int = 30) -> DataFrame:
    """Coupons shown in the last window and the one before, and their cost."""
    end = _ts(as_of)
    before, t = end - F.expr(f"INTERVAL {mid} DAYS"), F.col("exposure_time")
    return exposures.groupBy("customer_id").agg(
        F.count_if(in_window(t, end, mid)).alias(f"exposure_count_{mid}d"), F.count_if(in_window(t, before, mid)).alias(f"exposure_count_prev_{mid}d"),
        F.sum(F.when(in_window(t, end, mid), F.col("coupon_cost")).otherwise(0)).cast("double").alias(f"coupon_cost_{mid}d"))


def feature_matrix(customers: DataFrame, events: DataFrame, orders: DataFrame, as_of: str, short: int = 14, mid: int = 30,
                   long: int = 90, n_recent: int = 10, exposures: DataFrame | None = None, parts: list[DataFrame] | None = None) -> DataFrame:
    """The joined per-customer feature table. Each part is aggregated to one row per customer before it is joined; `parts` are further
    tables with one row per customer (states, clusters)."""
    end = _ts(as_of)
    out = customers
    for part in (event_features(events, as_of, short, mid, long), active_days(events, as_of, mid), order_features(orders, as_of, mid, long),
                 median_gap(orders, as_of), session_features(events, as_of, mid), session_conversion(events, orders, as_of, 2 * mid),
                 recent_sequence(events, as_of, n_recent), *([exposure_features(exposures, as_of, mid)] if exposures is not None else []), *(parts or [])):
        out = out.join(part.select("customer_id", *[c for c in part.columns if c not in out.columns]), "customer_id", "left")
    counts = [c for c, t in out.dtypes if c not in customers.columns and t in ("bigint", "int")]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    conv = lambda tag: ratio(F.col(f"frequency_{tag}"), F.col(f"searches_{tag}"))
    cart = lambda tag: ratio(F.col(f"frequency_{tag}"), F.col(f"add_to_cart_{tag}"))
    d, p = f"{mid}d", f"prev_{mid}d"
    out = out.withColumns({
        "days_since_last_event": F.round(F.coalesce(days_between(end, F.col("last_event_time")), F.lit(999.0)), 6),
        "recency_days": F.round(F.coalesce(days_between(end, F.col("last_purchase_time")), F.lit(999.0)), 6),
        f"search_to_purchase_conversion_{d}": F.round(conv(d), 6), f"search_to_purchase_conversion_{p}": F.round(conv(p), 6),
        f"cart_to_purchase_rate_{d}": F.round(cart(d), 6), f"cart_to_purchase_rate_{p}": F.round(cart(p), 6),
        "search_purchase_conv_change_rate": F.round(change_rate(conv(d), conv(p)), 6),
        "cart_conversion_change_rate": F.round(change_rate(cart(d), cart(p)), 6),
        "session_duration_change_rate": F.round(change_rate(F.col(f"avg_session_duration_sec_{d}"), F.col(f"avg_session_duration_sec_{p}")), 6),
        "pageviews_change_rate": F.round(change_rate(F.col(f"pageviews_per_session_{d}"), F.col(f"pageviews_per_session_{p}")), 6),
        f"support_contact_rate_{d}": F.round(ratio(F.col(f"support_contact_{d}"), F.col(f"sessions_{d}")), 6),
        f"monetary_per_visit_{long}d": F.round(ratio(F.col(f"monetary_{long}d"), F.col(f"visits_{long}d")), 6),
        "recent_event_sequence": F.coalesce("recent_event_sequence", F.lit("no_history")),
        f"dominant_event_type_{long}d": F.coalesce(f"dominant_event_type_{long}d", F.lit("none"))})
    if exposures is not None:
        opened = lambda tag: ratio(F.col(f"coupon_open_{tag}"), F.col(f"exposure_count_{tag}"))
        out = out.withColumns({
            f"coupon_cost_{d}": F.coalesce(f"coupon_cost_{d}", F.lit(0.0)), f"coupon_open_rate_{d}": F.round(opened(d), 6), f"coupon_open_rate_{p}": F.round(opened(p), 6),
            "coupon_response_change_rate": F.round(change_rate(opened(d), opened(p)), 6)})
    return out.drop("last_event_time", "last_purchase_time")
