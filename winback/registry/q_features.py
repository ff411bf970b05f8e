"""As-of features."""

from pyspark.sql import functions as F

from winback import params
from winback.functions.scalars import scalars
from winback.operators import features as X
from winback.operators import scores
from winback.plans.summary import customer_summary
from winback.registry.core import cte, query
from winback.sources import adapters as A
from winback.sources.staging import staged

S, M, L, END = params.SHORT, params.MID, params.LONG, params.AS_OF_EVENTS
T0 = f"TIMESTAMP '{END}'"


def win(ts, days, back=0, end=T0):
    return f"{ts} > {end} - INTERVAL {days + back} DAY AND {ts} <= {end} - INTERVAL {back} DAY"


def n(kind, days, back=0):
    return f"count(*) FILTER (event_type = '{kind}' AND {win('event_time', days, back)})"


def rate(a, b):
    return f"round(CASE WHEN coalesce({b}, 0) = 0 OR {a} IS NULL THEN 0.0 ELSE ({a} - {b}) / {b} END, 6)::DOUBLE"


def div(a, b, r=6):
    return f"round(coalesce({a} / nullif({b}, 0), 0.0), {r})::DOUBLE"


TYPES = X.EVENT_TYPES
cte("c_evt", f"""SELECT customer_id, max(event_time) last_event_time,
  {n('visit', S)} visits_{S}d, {n('visit', S, S)} visits_prev_{S}d, {n('purchase', S)} purchases_{S}d, {n('purchase', S, S)} purchases_prev_{S}d,
  {n('search', M)} searches_{M}d, {n('search', M, M)} searches_prev_{M}d, {n('add_to_cart', M)} add_to_cart_{M}d, {n('add_to_cart', M, M)} add_to_cart_prev_{M}d,
  {n('coupon_open', M)} coupon_open_{M}d, {n('coupon_open', M, M)} coupon_open_prev_{M}d, {n('support_contact', M)} support_contact_{M}d, {n('visit', L)} visits_{L}d,
  {', '.join(f"{n(t, L)} n_{t}" for t in TYPES)},
  count(*) FILTER ({win('event_time', L)}) total, count(*) FILTER ({win('event_time', L)} AND hour(event_time) >= 18) ev, count(*) FILTER ({win('event_time', L)} AND hour(event_time) < 6) ni,
  count(*) FILTER ({win('event_time', L)} AND hour(event_time) BETWEEN 9 AND 17) wo, count(*) FILTER ({win('event_time', L)} AND isodow(event_time) >= 6) we,
  count(DISTINCT event_type) FILTER ({win('event_time', L)}) event_diversity_{L}d, count(DISTINCT event_time::DATE) FILTER ({win('event_time', M)}) active_days
FROM c_events WHERE event_time <= {T0} GROUP BY 1""")
cte("c_dom", f"""SELECT customer_id, event_type dominant FROM (SELECT customer_id, event_type, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, event_type) rn
  FROM c_events WHERE {win('event_time', L)} GROUP BY 1, 2) WHERE rn = 1""")
cte("c_ord", f"""SELECT customer_id, max(order_time) last_purchase_time, count(*) FILTER ({win('order_time', M)}) frequency_{M}d, count(*) FILTER ({win('order_time', M, M)}) frequency_prev_{M}d,
  count(*) FILTER ({win('order_time', L)}) frequency_{L}d, round(coalesce(sum(net_amount) FILTER ({win('order_time', M)}), 0.0), 4) monetary_{M}d,
  round(coalesce(sum(net_amount) FILTER ({win('order_time', L)}), 0.0), 4) monetary_{L}d, round(avg(quantity), 6) avg_items_per_order_90d, round(avg(coupon_used), 6) orders_with_coupon_ratio_90d,
  count(*) FILTER ({win('order_time', L)} AND isodow(order_time) >= 6) we, avg(gap) gap, median(gap) mgap, epoch_us({T0}) - epoch_us(max(order_time)) idle_us
FROM (SELECT *, (epoch_us(order_time) - epoch_us(lag(order_time) OVER (PARTITION BY customer_id ORDER BY order_time, order_id))) / 86400000000.0::DOUBLE gap FROM c_event_orders WHERE order_time <= {T0}) GROUP BY 1""")
cte("c_sess", f"""SELECT customer_id, session_id, min(event_time) session_start, (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 1000000.0::DOUBLE dur,
  count(*) FILTER (event_type = 'page_view') page_view, count(*) FILTER (event_type = 'search') search, count(*) FILTER (event_type = 'add_to_cart') add_to_cart,
  count(*) FILTER (event_type = 'support_contact') support_contact, count(*) FILTER (event_type = 'purchase') purchase
FROM c_events WHERE {win('event_time', 2 * M)} GROUP BY 1, 2""")


def sess(tag, back):
    f = f"FILTER ({win('session_start', M, back)})"
    return (f"round(avg(dur) {f}, 6) avg_session_duration_sec_{tag}, round(median(dur) {f}, 6) median_session_duration_sec_{tag}, round(avg(page_view) {f}, 6) pageviews_per_session_{tag}, "
            f"round(avg(search) {f}, 6) searches_per_session_{tag}, round(avg(support_contact) {f}, 6) support_contacts_per_session_{tag}, count(*) {f} sessions_{tag}")


cte("c_sessf", f"SELECT customer_id, {sess(f'{M}d', 0)}, {sess(f'prev_{M}d', M)} FROM c_sess GROUP BY 1")
cte("c_seq", f"""SELECT customer_id, string_agg(event_type, ' > ' ORDER BY event_time, event_id) recent_event_sequence FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY event_time DESC, event_id DESC) rn
  FROM c_events WHERE event_time <= {T0}) WHERE rn <= 10 GROUP BY 1""")
cte("c_conv", f"""SELECT customer_id, coalesce(ss, 0) search_sessions_total, coalesce(pd, 0) purchase_days_total, {div('coalesce(pd, 0)', 'coalesce(ss, 0)')} search_to_purchase_conversion_total
FROM (SELECT customer_id, count(*) FILTER (search > 0) ss FROM c_sess GROUP BY 1) FULL JOIN (SELECT customer_id, count(DISTINCT order_time::DATE) pd FROM c_event_orders WHERE {win('order_time', 2 * M)} GROUP BY 1) USING (customer_id)""")


def events(spark, d):
    return A.events(spark, d)


def evt(spark, d):
    return X.event_features(A.events(spark, d), END, S, M, L)


@query("window_count", f"""SELECT customer_id, visits_{S}d, visits_prev_{S}d, purchases_{S}d, purchases_prev_{S}d, searches_{M}d, searches_prev_{M}d, add_to_cart_{M}d, coupon_open_{M}d, support_contact_{M}d, visits_{L}d FROM c_evt""")
def window_count(spark, d):
    return evt(spark, d).select("customer_id", f"visits_{S}d", f"visits_prev_{S}d", f"purchases_{S}d", f"purchases_prev_{S}d", f"searches_{M}d",
                                f"searches_prev_{M}d", f"add_to_cart_{M}d", f"coupon_open_{M}d", f"support_contact_{M}d", f"visits_{L}d")


@query("window_sum", f"SELECT customer_id, frequency_{M}d, frequency_prev_{M}d, frequency_{L}d, monetary_{M}d, monetary_{L}d, {div(f'monetary_{L}d', f'frequency_{L}d')} avg_order_value_{L}d FROM c_ord")
def window_sum(spark, d):
    return X.order_features(A.event_orders(spark, d), END, M, L).select(
        "customer_id", f"frequency_{M}d", f"frequency_prev_{M}d", f"frequency_{L}d", f"monetary_{M}d", f"monetary_{L}d", f"avg_order_value_{L}d")


@query("window_distinct_days", f"SELECT customer_id, active_days active_days_{M}d FROM c_evt WHERE active_days > 0")
def window_distinct_days(spark, d):
    return X.active_days(A.events(spark, d), END, M)


@query("rate_change", f"SELECT customer_id, {rate(f'visits_{S}d', f'visits_prev_{S}d')} visit_change_rate_{S}d, {rate(f'purchases_{S}d', f'purchases_prev_{S}d')} purchase_change_rate_{S}d FROM c_evt")
def rate_change(spark, d):
    return evt(spark, d).select("customer_id", f"visit_change_rate_{S}d", f"purchase_change_rate_{S}d")


@query("days_since", f"""SELECT c.customer_id, round(coalesce((epoch_us({T0}) - epoch_us(last_event_time)) / 86400000000.0::DOUBLE, 999.0), 6) days_since_last_event,
  round(coalesce(idle_us / 86400000000.0::DOUBLE, 999.0), 6) recency_days, greatest(date_diff('day', signup_date::DATE, DATE '{END}'), 0) customer_age_days
FROM c_customers c LEFT JOIN c_evt USING (customer_id) LEFT JOIN c_ord USING (customer_id)""")
def days_since(spark, d):
    from winback.functions.scalars import days_between
    end = F.lit(END).cast("timestamp")
    e = A.events(spark, d).where(F.col("event_time") <= end)
    last = e.groupBy("customer_id").agg(F.max("event_time").alias("le"), F.max(F.when(F.col("event_type") == "purchase", F.col("event_time"))).alias("lp"))
    gap = lambda c: F.round(F.coalesce(days_between(end, F.col(c)), F.lit(999.0)), 6)
    return A.customers(spark, d).join(last, "customer_id", "left").select(
        "customer_id", gap("le").alias("days_since_last_event"), gap("lp").alias("recency_days"),
        F.greatest(F.datediff(end, "signup_date"), F.lit(0)).alias("customer_age_days"))


@query("purchase_cycle", f"""SELECT customer_id, round(gap, 6) avg_purchase_gap_days, round(mgap, 6) median_purchase_gap_days, avg_items_per_order_90d, orders_with_coupon_ratio_90d,
  round(idle_us / 86400000000.0::DOUBLE, 6) current_non_purchase_days, {div('(idle_us / 86400000000.0::DOUBLE)', 'gap')} purchase_cycle_anomaly FROM c_ord""")
def purchase_cycle(spark, d):
    o = A.event_orders(spark, d)
    return X.order_features(o, END, M, L).join(X.median_gap(o, END), "customer_id", "left").select(
        "customer_id", "avg_purchase_gap_days", "median_purchase_gap_days", "avg_items_per_order_90d", "orders_with_coupon_ratio_90d",
        "current_non_purchase_days", "purchase_cycle_anomaly")


@query("session_table", "SELECT customer_id, session_id, round(dur, 6) session_duration_sec, page_view, search, add_to_cart, support_contact, purchase FROM c_sess")
def session_table(spark, d):
    return X.sessions(A.events(spark, d), END, 2 * M).select("customer_id", "session_id", F.round("session_duration_sec", 6).alias("session_duration_sec"),
                                                             "page_view", "search", "add_to_cart", "support_contact", "purchase")


@query("session_features", "SELECT * FROM c_sessf")
def session_features(spark, d):
    return X.session_features(A.events(spark, d), END, M)


@query("session_conversion", "SELECT * FROM c_conv")
def session_conversion(spark, d):
    return X.session_conversion(A.events(spark, d), A.event_orders(spark, d), END, 2 * M)


def fm(spark, d):
    """The feature table with exposures."""
    def build():
        return X.feature_matrix(A.customers(spark, d).select("customer_id", "persona", "signup_date"), A.events(spark, d), A.event_orders(spark, d), END, S, M, L, exposures=A.exposures(spark, d))
    return staged(spark, d, "features", build)


_xwin = ", ".join(f"count(*) FILTER ({win('exposure_time', M, back)}) x{i}" for i, back in enumerate((0, M)))


@query("conversion_rates", f"""SELECT c.customer_id, {div(f'frequency_{M}d', f'searches_{M}d')} search_to_purchase_conversion_{M}d, {div(f'frequency_prev_{M}d', f'searches_prev_{M}d')} search_to_purchase_conversion_prev_{M}d,
  {div(f'frequency_{M}d', f'add_to_cart_{M}d')} cart_to_purchase_rate_{M}d,
  {rate(f'coalesce(frequency_{M}d / nullif(searches_{M}d, 0), 0)', f'coalesce(frequency_prev_{M}d / nullif(searches_prev_{M}d, 0), 0)')} search_purchase_conv_change_rate,
  {div(f'coupon_open_{M}d', 'x0')} coupon_open_rate_{M}d, {div(f'coupon_open_prev_{M}d', 'x1')} coupon_open_rate_prev_{M}d,
  {rate(f'coalesce(coupon_open_{M}d / nullif(x0, 0), 0)', f'coalesce(coupon_open_prev_{M}d / nullif(x1, 0), 0)')} coupon_response_change_rate
FROM c_customers c LEFT JOIN c_evt USING (customer_id) LEFT JOIN c_ord USING (customer_id) LEFT JOIN (SELECT customer_id, {_xwin} FROM c_exposures GROUP BY 1) USING (customer_id)""")
def conversion_rates(spark, d):
    return fm(spark, d).select("customer_id", f"search_to_purchase_conversion_{M}d", f"search_to_purchase_conversion_prev_{M}d", f"cart_to_purchase_rate_{M}d",
                               "search_purchase_conv_change_rate", f"coupon_open_rate_{M}d", f"coupon_open_rate_prev_{M}d", "coupon_response_change_rate")


_win = lambda c, end, n: f"{c} > {end} - INTERVAL {n} DAY AND {c} <= {end}"
_END = f"TIMESTAMP '{params.AS_OF_ORDERS}'"


@query("exposure_features", f"""SELECT customer_id, count(*) FILTER ({_win('exposure_time', _END, 30)}) exposure_count_30d, count(*) FILTER ({_win('exposure_time', f"({_END} - INTERVAL 30 DAY)", 30)}) exposure_count_prev_30d,
 coalesce(sum(coupon_cost) FILTER ({_win('exposure_time', _END, 30)}), 0)::DOUBLE coupon_cost_30d FROM c_exposures GROUP BY 1""")
def exposure_features(spark, d):
    return X.exposure_features(A.exposures(spark, d), params.AS_OF_ORDERS, 30)


@query("recent_sequence", "SELECT * FROM c_seq")
def recent_sequence(spark, d):
    return X.recent_sequence(A.events(spark, d), END)


_K, _N = 6, len(TYPES)
cte("c_mix", f"SELECT customer_id, [{', '.join(f'round(n_{t} / t::DOUBLE, 9)' for t in TYPES)}]::DOUBLE[] mix FROM (SELECT *, {' + '.join(f'n_{t}' for t in TYPES)} t FROM c_evt) WHERE t > 0")


def _far(centre):
    return "round(" + " + ".join(f"(mix[{i}] - {centre}[{i}]) * (mix[{i}] - {centre}[{i}])" for i in range(1, _N + 1)) + ", 9)::DOUBLE"


# centres: each the mix farthest from those before, then the means of what is nearest to them, step by step
cte("c_centre_1", "SELECT [arg_min(mix, customer_id)] cs FROM c_mix")
for _k in range(2, _K + 1):
    cte(f"c_centre_{_k}", f"SELECT list_append(cs, mix) cs FROM c_mix, c_centre_{_k - 1} ORDER BY least({', '.join(_far(f'cs[{j}]') for j in range(1, _k))}, 1e9::DOUBLE) DESC, customer_id LIMIT 1")


def _assigned(centres):
    far = f"[{', '.join(_far(f'cs[{j}]') for j in range(1, _K + 1))}]"
    return f"SELECT customer_id, mix, cs, (list_position({far}, list_min({far})) - 1)::INTEGER id FROM c_mix, {centres}"


cte("c_step_0", f"SELECT cs FROM c_centre_{_K}")
for _k in range(1, X.LLOYD_STEPS + 1):
    cte(f"c_step_{_k}", f"""SELECT list(coalesce(m, p.cs[i]) ORDER BY i) cs FROM (SELECT unnest(range(1, {_K + 1})) i) CROSS JOIN c_step_{_k - 1} p
 LEFT JOIN (SELECT id, [{', '.join(f'round(avg(mix[{i}]), 9)' for i in range(1, _N + 1))}]::DOUBLE[] m FROM ({_assigned(f'c_step_{_k - 1}')}) GROUP BY id) ON id = i - 1""")
cte("c_cluster", f"SELECT customer_id, id behavior_cluster_id FROM ({_assigned(f'c_step_{X.LLOYD_STEPS}')})")


@query("behaviour_cluster", "SELECT * FROM c_cluster")
def behaviour_cluster(spark, d):
    return staged(spark, d, "behaviour_cluster", lambda: X.behaviour_cluster(staged(spark, d, "event_features", lambda: evt(spark, d))))


@query("dominant_event", f"SELECT customer_id, coalesce(dominant, 'none') dominant_event_type_{L}d FROM c_evt LEFT JOIN c_dom USING (customer_id)")
def dominant_event(spark, d):
    return evt(spark, d).select("customer_id", f"dominant_event_type_{L}d")


@query("time_of_day_ratios", f"""SELECT customer_id, {div('ev', 'total')} evening_activity_ratio, {div('ni', 'total')} night_activity_ratio, {div('wo', 'total')} workhour_activity_ratio,
  {div('e.we', 'total')} weekend_activity_ratio, event_diversity_{L}d::INTEGER event_diversity_{L}d, {div('o.we', f'frequency_{L}d')} weekend_purchase_ratio FROM c_evt e JOIN c_ord o USING (customer_id)""")
def time_of_day_ratios(spark, d):
    o = X.order_features(A.event_orders(spark, d), END, M, L).select("customer_id", "weekend_purchase_ratio")
    return evt(spark, d).join(o, "customer_id").select("customer_id", "evening_activity_ratio", "night_activity_ratio", "workhour_activity_ratio",
                                                       "weekend_activity_ratio", f"event_diversity_{L}d", "weekend_purchase_ratio")


@query("data_span", """SELECT strftime(min(t), '%Y-%m-%d') first_day, strftime(max(t), '%Y-%m-%d') last_day, floor((epoch_us(max(t)) - epoch_us(min(t))) / 86400000000.0::DOUBLE)::INTEGER span_days
FROM (SELECT event_time t FROM c_order_events UNION ALL SELECT order_time FROM c_orders)""")
def data_span(spark, d):
    return X.data_span(A.order_events(spark, d), A.orders(spark, d)).select(
        F.date_format("first_time", "yyyy-MM-dd").alias("first_day"), F.date_format("last_time", "yyyy-MM-dd").alias("last_day"), "span_days")


HORIZON = "CASE WHEN span < 60 THEN 0 WHEN span < 90 THEN 30 WHEN span < 180 THEN greatest(30, span // 2) ELSE 45 END"
SPANS = """(SELECT 'events' source, floor((epoch_us(max(event_time)) - epoch_us(min(event_time))) / 86400000000.0::DOUBLE)::INTEGER span, max(event_time) t FROM c_events
UNION ALL SELECT 'orders', floor((epoch_us(max(order_time)) - epoch_us(min(order_time))) / 86400000000.0::DOUBLE)::INTEGER, max(order_time) FROM c_orders)"""


def _spans(spark, d):
    for name, df, col in (("events", A.events(spark, d), "event_time"), ("orders", A.orders(spark, d), "order_time")):
        got = scalars(df, a=F.min(col), b=F.max(col))
        span = int((got["b"] - got["a"]).total_seconds() // 86400)
        yield name, span, X.adjust_horizon(span, 45), got["b"]


@query("horizon_adjust", f"SELECT source, span span_days, ({HORIZON})::INTEGER horizon_days FROM {SPANS}")
def horizon_adjust(spark, d):
    return spark.createDataFrame([(a, b, c) for a, b, c, _ in _spans(spark, d)], "source string, span_days int, horizon_days int")


@query("as_of_resolve", f"SELECT source, strftime(t - ({HORIZON})::INTEGER * INTERVAL 1 DAY, '%Y-%m-%d') as_of FROM {SPANS}")
def as_of_resolve(spark, d):
    """Latest activity less the horizon, cut to the day."""
    rows = spark.createDataFrame([(a, c, t) for a, _, c, t in _spans(spark, d)], "source string, h int, t timestamp")
    return rows.select("source", F.date_format(F.date_sub(F.to_date("t"), F.col("h")), "yyyy-MM-dd").alias("as_of"))


def snapshots(spark, d):
    def build():
        e = A.order_events(spark, d).where(F.col("event_type").isin("visit", "purchase"))
        amounts = A.orders(spark, d).groupBy("customer_id").agg((F.sum("net_amount") / F.count(F.lit(1))).alias("avg_amount"))
        return X.activity_snapshots(e, amounts, params.SNAPSHOT_END, step=30, risk=params.CHURN_DAYS)
    return staged(spark, d, "snapshots", build)


cte("c_snapshots", f"""SELECT customer_id, day snapshot_date, coalesce(lv, day) last_visit_date, coalesce(lp, lv, day) last_purchase_date, coalesce(v, 0) visits_total, coalesce(p, 0) purchases_total,
  round(coalesce(p, 0) * avg_amount, 6) monetary_total, greatest(date_diff('day', coalesce(lv, day), day), 0)::INTEGER inactivity_days,
  CASE WHEN date_diff('day', coalesce(lv, day), day) >= 180 THEN 'churn_risk' WHEN date_diff('day', coalesce(lv, day), day) >= 90 THEN 'dormant' ELSE 'active' END current_status
FROM (SELECT g.customer_id, g.day, max(a.event_time)::DATE lv, (max(a.event_time) FILTER (a.event_type = 'purchase'))::DATE lp, count(*) FILTER (a.event_type = 'visit') v, count(*) FILTER (a.event_type = 'purchase') p
  FROM (SELECT DISTINCT customer_id, day FROM (SELECT customer_id, unnest(generate_series(f, TIMESTAMP '{params.SNAPSHOT_END}', INTERVAL 30 DAY))::DATE AS day FROM c_first UNION ALL SELECT customer_id, DATE '{params.SNAPSHOT_END}' FROM c_first)) g
  JOIN c_act a ON a.customer_id = g.customer_id AND a.event_time <= g.day GROUP BY 1, 2)
JOIN (SELECT customer_id, sum(net_amount) / count(*) avg_amount FROM c_orders GROUP BY 1) USING (customer_id)""")
cte("c_act", f"SELECT customer_id, event_time, event_type FROM c_order_events WHERE event_type IN ('visit', 'purchase') AND event_time <= TIMESTAMP '{params.SNAPSHOT_END}'")
cte("c_first", "SELECT customer_id, min(event_time)::DATE::TIMESTAMP f FROM c_act GROUP BY 1")
DS = lambda c: f"strftime({c}, '%Y-%m-%d') {c}"
FD = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)


@query("activity_snapshots", f"SELECT customer_id, {DS('snapshot_date')}, {DS('last_visit_date')}, {DS('last_purchase_date')}, visits_total, purchases_total, monetary_total, inactivity_days, current_status FROM c_snapshots")
def activity_snapshots(spark, d):
    return snapshots(spark, d).select("customer_id", FD("snapshot_date"), FD("last_visit_date"), FD("last_purchase_date"), "visits_total", "purchases_total",
                                      "monetary_total", "inactivity_days", "current_status")


@query("summary_snapshots", """SELECT customer_id, strftime(DATE '2000-12-31' - b * 30, '%Y-%m-%d') snapshot_date, greatest(inactivity_days - b * 30, 0)::INTEGER inactivity_days, frequency purchases_total, monetary monetary_total,
  CASE WHEN inactivity_days - b * 30 >= 180 THEN 'churn_risk' WHEN inactivity_days - b * 30 >= 90 THEN 'dormant' ELSE 'active' END current_status FROM c_summary, (SELECT unnest(range(12))::INTEGER b)""")
def summary_snapshots(spark, d):
    s = X.summary_snapshots(customer_summary(spark, d), params.AS_OF_ORDERS, dormant=90, risk=180)
    return s.withColumn("snapshot_date", F.date_format("snapshot_date", "yyyy-MM-dd"))


cte("c_state_at", f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY snapshot_date DESC) rn FROM c_snapshots WHERE snapshot_date <= DATE '{params.AS_OF_ORDERS}'),
l AS (SELECT customer_id, snapshot_date d, current_status s, inactivity_days i FROM h WHERE rn = 1), b AS (SELECT l.customer_id, max(h.snapshot_date) FILTER (current_status <> s) brk FROM l JOIN h USING (customer_id) GROUP BY 1)
SELECT customer_id, any_value(s) current_journey_stage, any_value(i) inactivity_days, (any_value(d) - min(snapshot_date) FILTER (brk IS NULL OR snapshot_date > brk) + 1)::INTEGER journey_stage_days FROM h JOIN l USING (customer_id) JOIN b USING (customer_id) GROUP BY 1""")


@query("state_at_asof", "SELECT * FROM c_state_at")
def state_at_asof(spark, d):
    return X.state_at(snapshots(spark, d), params.AS_OF_ORDERS)


cte("c_label", f"""SELECT c.customer_id, (a.customer_id IS NULL OR coalesce(st IN ('churn_risk', 'churned', 'inactive', 'cancelled', 'canceled', 'unsubscribed'), false))::INTEGER AS label
FROM c_customers c LEFT JOIN (SELECT DISTINCT customer_id FROM c_order_events WHERE event_time > TIMESTAMP '{params.AS_OF_ORDERS}' AND event_time <= TIMESTAMP '{params.AS_OF_ORDERS}' + INTERVAL 90 DAY) a USING (customer_id)
LEFT JOIN (SELECT customer_id, arg_max(current_status, snapshot_date) st FROM c_snapshots WHERE snapshot_date > DATE '{params.AS_OF_ORDERS}' AND snapshot_date <= DATE '{params.AS_OF_ORDERS}' + 90 GROUP BY 1) USING (customer_id)
WHERE signup_date <= TIMESTAMP '{params.AS_OF_ORDERS}'""")


def label(spark, d):
    base = A.customers(spark, d).where(F.col("signup_date") <= F.lit(params.AS_OF_ORDERS).cast("timestamp")).select("customer_id")
    return X.future_label(base, A.order_events(spark, d), A.orders(spark, d), snapshots(spark, d), params.AS_OF_ORDERS, params.HORIZON_DAYS)


@query("future_label", "SELECT * FROM c_label")
def future_label(spark, d):
    return label(spark, d)


@query("label_resolve", """SELECT customer_id, (churn_label_observed >= 0.5)::INTEGER AS label, 'uploaded_label' label_source FROM c_label JOIN c_summary USING (customer_id)""")
def label_resolve(spark, d):
    j = label(spark, d).join(customer_summary(spark, d).select("customer_id", "churn_label_observed"), "customer_id")
    out, source = X.resolve_label(j, "churn_label_observed")
    return out.select("customer_id", "label", F.lit(source).alias("label_source"))


@query("summary_enrich", f"""SELECT c.customer_id, coalesce(round(monetary_{L}d, 4), monetary) monetary, coalesce(round(avg_items_per_order_90d, 6), frequency::DOUBLE) items_or_frequency, churn_probability
FROM c_summary c LEFT JOIN c_ord USING (customer_id)""")
def summary_enrich(spark, d):
    """Feature rows joined to the summary; existing columns are gap-filled, new ones are added."""
    f = X.order_features(A.event_orders(spark, d), END, M, L).select("customer_id", F.col(f"monetary_{L}d").alias("m"), F.col("avg_items_per_order_90d").alias("i"))
    s = customer_summary(spark, d).select("customer_id", "monetary", "frequency", "churn_probability")
    return s.join(f, "customer_id", "left").select("customer_id", F.coalesce("m", "monetary").alias("monetary"),
                                                   F.coalesce("i", F.col("frequency").cast("double")).alias("items_or_frequency"), "churn_probability")


W = ["purchase_cycle_anomaly", "avg_purchase_gap_days", f"monetary_{L}d", f"avg_session_duration_sec_{M}d"]
cte("c_wraw", f"""SELECT c.customer_id, {div('(idle_us / 86400000000.0::DOUBLE)', 'gap')} * CASE WHEN o.customer_id IS NULL THEN NULL ELSE 1 END purchase_cycle_anomaly, round(gap, 6) avg_purchase_gap_days, monetary_{L}d, avg_session_duration_sec_{M}d
FROM c_customers c LEFT JOIN c_ord o USING (customer_id) LEFT JOIN c_sessf USING (customer_id)""")


@query("winsorise_impute", "SELECT customer_id, " + ", ".join(
    f"round(CASE WHEN {c} IS NULL THEN (SELECT median({c}) FROM c_wraw) ELSE least(greatest({c}, (SELECT quantile_cont({c}, 0.01) FROM c_wraw)), (SELECT quantile_cont({c}, 0.99) FROM c_wraw)) END, 6) {c}" for c in W) + " FROM c_wraw")
def winsorise_impute(spark, d):
    w = X.winsorise_impute(fm(spark, d).select("customer_id", *W), W)
    return w.select("customer_id", *[F.round(c, 6).alias(c) for c in W])


@query("feature_matrix", f"""SELECT c.customer_id, persona, coalesce(visits_{S}d, 0) visits_{S}d, coalesce(purchases_{S}d, 0) purchases_{S}d, coalesce(frequency_{M}d, 0) frequency_{M}d, monetary_{M}d,
  coalesce(active_days, 0) active_days_{M}d, round(gap, 6) avg_purchase_gap_days, round(mgap, 6) median_purchase_gap_days, avg_session_duration_sec_{M}d, median_session_duration_sec_{M}d,
  coalesce(sessions_{M}d, 0) sessions_{M}d, {div(f'support_contact_{M}d', f'sessions_{M}d')} support_contact_rate_{M}d, {div(f'monetary_{L}d', f'visits_{L}d')} monetary_per_visit_{L}d,
  {rate(f'avg_session_duration_sec_{M}d', f'avg_session_duration_sec_prev_{M}d')} session_duration_change_rate, coalesce(recent_event_sequence, 'no_history') recent_event_sequence, coalesce(dominant, 'none') dominant_event_type_{L}d
FROM c_customers c LEFT JOIN c_evt USING (customer_id) LEFT JOIN c_ord USING (customer_id) LEFT JOIN c_sessf USING (customer_id) LEFT JOIN c_seq USING (customer_id) LEFT JOIN c_dom USING (customer_id)""")
def feature_matrix(spark, d):
    return fm(spark, d).select(
        "customer_id", "persona", f"visits_{S}d", f"purchases_{S}d", f"frequency_{M}d", f"monetary_{M}d", f"active_days_{M}d", "avg_purchase_gap_days", "median_purchase_gap_days",
        f"avg_session_duration_sec_{M}d", f"median_session_duration_sec_{M}d", f"sessions_{M}d", f"support_contact_rate_{M}d", f"monetary_per_visit_{L}d",
        "session_duration_change_rate", "recent_event_sequence", f"dominant_event_type_{L}d")


@query("feature_matrix_full", f"""SELECT c.customer_id, CASE WHEN total IS NOT NULL THEN {div('ev', 'total')} END evening_activity_ratio, CASE WHEN total IS NOT NULL THEN {div('e.we', 'total')} END weekend_activity_ratio,
 CASE WHEN frequency_{L}d IS NOT NULL THEN {div('o.we', f'frequency_{L}d')} END weekend_purchase_ratio,
 behavior_cluster_id, current_journey_stage, journey_stage_days FROM c_customers c LEFT JOIN c_evt e USING (customer_id) LEFT JOIN c_ord o USING (customer_id) LEFT JOIN c_cluster USING (customer_id) LEFT JOIN c_state_at USING (customer_id)""")
def feature_matrix_full(spark, d):
    """The feature table with behaviour cluster and state beside it."""
    full = fm(spark, d).join(behaviour_cluster(spark, d), "customer_id", "left").join(state_at_asof(spark, d).drop("inactivity_days"), "customer_id", "left")
    return full.select("customer_id", "evening_activity_ratio", "weekend_activity_ratio", "weekend_purchase_ratio", "behavior_cluster_id", "current_journey_stage", "journey_stage_days")


def _pct(col):
    from winback.registry.tables import rank_pct
    return rank_pct(col)


cte("c_off_raw", """SELECT *, round(least(greatest(0.34 * least(recency_days / greatest((SELECT quantile_cont(recency_days, 0.95) FROM c_summary), 1.0), 1.0)
  + 0.20 * (1 - least(frequency / greatest((SELECT quantile_cont(frequency, 0.95) FROM c_summary), 1.0), 1.0)) + 0.16 * (1 - least(monetary / greatest((SELECT quantile_cont(monetary, 0.95) FROM c_summary), 1.0), 1.0))
  + 0.13 * (visit_change_rate < 0)::INTEGER + 0.13 * (purchase_change_rate < 0)::INTEGER + 0.04 * least(inactivity_days / 180.0, 1.0), 0.01), 0.99)::DOUBLE, 9) raw FROM c_summary""")
cte("c_offline", f"""SELECT customer_id, churn, uplift_score, greatest(monetary * (1.30 + 1.25 * least(greatest(1.15 - churn, 0.20), 1.15)) + frequency * greatest(CASE WHEN frequency = 0 THEN 0.0 ELSE monetary / frequency END, 20000.0) * 0.55, 15000.0) clv, pressure,
  CASE WHEN uplift_score >= 0.12 THEN 'Persuadables' WHEN uplift_score >= 0.02 THEN 'Sure Things' WHEN uplift_score >= -0.03 THEN 'Lost Causes' ELSE 'Sleeping Dogs' END uplift_segment
FROM (SELECT *, round(1 / (1 + exp(-(({_pct('raw')} - (1 - (SELECT least(greatest(avg((inactivity_days >= 180)::INTEGER), 0.15), 0.25) FROM c_summary))) / 0.10))), 9) churn,
  coupon_fatigue_score * 0.55 + 0.60 * discount_dependency_score pressure FROM c_off_raw)""")


@query("summary_offline", """SELECT customer_id, round(churn, 6) churn_probability, round(clv, 4) clv, round(pressure, 6) discount_pressure_score,
  round(greatest(clv * uplift_score * least(greatest(1 - 0.08 * pressure, 0.55), 1.0), -50000.0), 4) expected_incremental_profit, uplift_segment FROM c_offline""")
def summary_offline(spark, d):
    return scores.offline_summary(customer_summary(spark, d), params.CHURN_DAYS).select(
        "customer_id", F.round("churn_probability", 6).alias("churn_probability"), F.round("clv", 4).alias("clv"),
        F.round("discount_pressure_score", 6).alias("discount_pressure_score"), F.round("expected_incremental_profit", 4).alias("expected_incremental_profit"), "uplift_segment")


@query("churn_calibrate", f"""SELECT customer_id, round(1 / (1 + exp(-(({_pct('inactivity_days')} - (1 - (SELECT least(greatest(avg(churn_label_observed), 0.15), 0.25) FROM c_summary))) / 0.10))), 6) calibrated FROM c_summary""")
def churn_calibrate(spark, d):
    s = customer_summary(spark, d).select("customer_id", "inactivity_days", "churn_label_observed")
    return scores.calibrate(s, "inactivity_days", F.col("churn_label_observed"), "c").select("customer_id", F.round("c", 6).alias("calibrated"))


def _inc(name):
    decay, steps = X.DECAYS[name]
    case = " ".join(f"WHEN '{k}' THEN {v}" for k, v in steps.items())
    return f"round(sum((CASE event_type {case} ELSE 0.0 END) * pow({decay}::DOUBLE, date_diff('day', event_time::DATE, DATE '{END}'))), 6) {name}"


@query("decayed_activity_scores", f"SELECT customer_id, {', '.join(_inc(k) for k in X.DECAYS)} FROM c_events WHERE event_time::DATE <= DATE '{END}' GROUP BY 1")
def decayed_activity_scores(spark, d):
    return X.decayed_scores(A.events(spark, d), END)


@query("decayed_fatigue_scores", f"""WITH RECURSIVE days AS (SELECT customer_id, day, sum(x) x, sum(o) o, sum(c) c, row_number() OVER (PARTITION BY customer_id ORDER BY day) rn FROM (
  SELECT customer_id, exposure_time::DATE AS day, 1 x, 0 o, 0 c FROM c_exposures UNION ALL SELECT customer_id, order_time::DATE, 0, 1 - coupon_used, coupon_used FROM c_orders) WHERE day <= DATE '{params.AS_OF_ORDERS}' GROUP BY 1, 2),
w(customer_id, rn, day, f, g) AS (SELECT customer_id, rn, day, greatest(x + 0.35::DOUBLE * c - 0.35::DOUBLE * o, 0.0)::DOUBLE, greatest(0.75::DOUBLE * c - 0.25::DOUBLE * o, 0.0)::DOUBLE FROM days WHERE rn = 1
 UNION ALL SELECT w.customer_id, d.rn, d.day, greatest(w.f * pow(0.94::DOUBLE, d.day - w.day) + d.x + 0.35::DOUBLE * d.c - 0.35::DOUBLE * d.o, 0.0), greatest(w.g * pow(0.96::DOUBLE, d.day - w.day) + 0.75::DOUBLE * d.c - 0.25::DOUBLE * d.o, 0.0)
 FROM w JOIN days d ON d.customer_id = w.customer_id AND d.rn = w.rn + 1)
SELECT customer_id, round(arg_max(f, rn) * pow(0.94::DOUBLE, DATE '{params.AS_OF_ORDERS}' - max(day)), 6) coupon_fatigue_score, round(arg_max(g, rn) * pow(0.96::DOUBLE, DATE '{params.AS_OF_ORDERS}' - max(day)), 6) discount_dependency_score FROM w GROUP BY 1""")
def decayed_fatigue_scores(spark, d):
    return X.fatigue_scores(A.orders(spark, d), A.exposures(spark, d), params.AS_OF_ORDERS)


@query("status_classify", "SELECT customer_id, inactivity_days, CASE WHEN inactivity_days >= 180 THEN 'churn_risk' WHEN inactivity_days >= 90 THEN 'dormant' ELSE 'active' END current_status FROM c_summary")
def status_classify(spark, d):
    return customer_summary(spark, d).select("customer_id", "inactivity_days", X.status(F.col("inactivity_days"), 90, 180).alias("current_status"))


@query("exposure_eligibility", f"""SELECT customer_id, inactivity_days, coalesce(n, 0) exposures FROM c_assign JOIN (SELECT customer_id, inactivity_days FROM c_summary) USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) n, max(exposure_time)::DATE le FROM c_exposures WHERE exposure_time <= TIMESTAMP '{params.AS_OF_ORDERS}' GROUP BY 1) USING (customer_id)
WHERE treatment_flag = 1 AND coalesce(DATE '{params.AS_OF_ORDERS}' - le, 999) >= 14 AND coalesce(n, 0) < 4 AND (inactivity_days >= 10 OR assigned_at::DATE = DATE '{params.AS_OF_ORDERS}')""")
def exposure_eligibility(spark, d):
    return X.exposure_eligible(customer_summary(spark, d), A.assignments(spark, d), A.exposures(spark, d), params.AS_OF_ORDERS)
