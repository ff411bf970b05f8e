"""Cohorts and journeys, on the order time line."""

from pyspark.sql import functions as F

from winback.operators import cohort as C
from winback.registry.core import cte, query
from winback.registry.q_features import snapshots
from winback.sources import adapters as A
from winback.sources.staging import staged

TYPES = ", ".join(f"('{k}', '{t}')" for k, v in C.DEFINITIONS.items() for t in v)
cte("c_defs", f"SELECT * FROM (VALUES {TYPES}) v(activity_definition, event_type)")
cte("c_monthly", """SELECT activity_definition, customer_id, year(event_time) * 12 + month(event_time) m, count(*) n FROM c_order_events JOIN c_defs USING (event_type) GROUP BY ALL""")
cte("c_cbase", "SELECT customer_id, acquisition_month cohort_month, substr(acquisition_month, 1, 4)::INTEGER * 12 + substr(acquisition_month, 6, 2)::INTEGER c FROM c_customers WHERE acquisition_month IS NOT NULL")
cte("c_active", "SELECT activity_definition, cohort_month, customer_id, m - c period FROM c_monthly JOIN c_cbase USING (customer_id) WHERE m - c BETWEEN 0 AND 6")
cte("c_cgrid", """SELECT *, period <= greatest(e - c, 0) observed FROM (SELECT cohort_month, c, count(*) cohort_size FROM c_cbase GROUP BY 1, 2), (SELECT unnest(range(7)) period),
 (SELECT activity_definition, max(m) e FROM c_monthly GROUP BY 1), (VALUES ('point'), ('rolling')) v(retention_mode)""")
cte("c_cohort", """SELECT cohort_month, period, cohort_size, CASE WHEN observed THEN (CASE WHEN period = 0 THEN cohort_size ELSE n END) END retained_customers,
 round(CASE WHEN observed THEN (CASE WHEN period = 0 THEN cohort_size ELSE n END) END / cohort_size, 9)::DOUBLE retention_rate, observed, activity_definition, retention_mode
FROM (SELECT g.cohort_month, g.period, cohort_size, observed, g.activity_definition, g.retention_mode, count(DISTINCT a.customer_id) n FROM c_cgrid g
 LEFT JOIN c_active a ON a.cohort_month = g.cohort_month AND a.activity_definition = g.activity_definition AND (CASE WHEN retention_mode = 'point' THEN a.period = g.period ELSE a.period >= g.period END) GROUP BY ALL)""")
cte("c_curve", "SELECT * FROM c_cohort WHERE activity_definition = 'core_engagement' AND retention_mode = 'rolling' AND observed")
cte("c_point", "SELECT * FROM c_cohort WHERE activity_definition = 'core_engagement' AND retention_mode = 'point' AND observed")


def cohorts(spark, d):
    return staged(spark, d, "cohorts", lambda: C.retention(A.customers(spark, d), A.order_events(spark, d)))


@query("cohort_all", "SELECT *, 1 min_events_per_period FROM c_cohort")
def cohort_all(spark, d):
    return cohorts(spark, d)


@query("cohort_retention", "SELECT *, 1 min_events_per_period FROM c_cohort WHERE activity_definition = 'purchase_only' AND retention_mode = 'point'")
def cohort_retention(spark, d):
    return C.retention(A.customers(spark, d), A.order_events(spark, d), {"purchase_only": ["purchase"]}).where("retention_mode = 'point'")


@query("cohort_upload_variant", """SELECT cohort_month, period, cohort_size, activity_definition, CASE WHEN period = 0 THEN cohort_size ELSE n END retained_customers,
 round((CASE WHEN period = 0 THEN cohort_size ELSE n END) / cohort_size, 9)::DOUBLE retention_rate, retention_mode FROM (
SELECT cohort_month, period, cohort_size, activity_definition, count(DISTINCT CASE WHEN t.event_type IS NOT NULL THEN e.customer_id END) n
FROM (SELECT acquisition_month cohort_month, count(*) cohort_size, min(signup_date)::DATE s FROM c_customers WHERE acquisition_month IS NOT NULL GROUP BY 1) k CROSS JOIN (SELECT unnest(range(7))::INTEGER period)
CROSS JOIN (VALUES ('all_activity'), ('core_engagement'), ('purchase_only')) v(activity_definition)
LEFT JOIN (SELECT acquisition_month am, customer_id, event_time, event_type FROM c_order_events JOIN c_customers USING (customer_id)) e
 ON am = cohort_month AND event_time >= s + to_months(period) AND event_time < s + to_months(period + 1)
LEFT JOIN c_defs t USING (activity_definition, event_type) GROUP BY ALL) CROSS JOIN (VALUES ('rolling'), ('point')) w(retention_mode)""")
def cohort_upload_variant(spark, d):
    return C.upload_retention(A.customers(spark, d), A.order_events(spark, d))


@query("cohort_milestones", "SELECT cohort_month, period, retention_rate, 1 - retention_rate churn_rate FROM c_curve WHERE period IN (1, 3, 6, 12)")
def cohort_milestones(spark, d):
    return C.milestones(C.pick(cohorts(spark, d)))


@query("cohort_average_curve", "SELECT period, round(avg(retention_rate), 6) avg_retention, count(*) cohorts FROM c_curve GROUP BY 1")
def cohort_average_curve(spark, d):
    return C.pick(cohorts(spark, d)).groupBy("period").agg(F.round(F.avg("retention_rate"), 6).alias("avg_retention"), F.count(F.lit(1)).alias("cohorts"))


@query("cohort_pivot", "SELECT cohort_month, " + ", ".join(f'max(retention_rate) FILTER (period = {p}) AS "p{p}"' for p in range(7)) + " FROM c_curve GROUP BY 1")
def cohort_pivot(spark, d):
    t = C.pick(cohorts(spark, d)).groupBy("cohort_month").pivot("period", list(range(7))).agg(F.first("retention_rate"))
    return t.select("cohort_month", *[F.col(str(p)).alias(f"p{p}") for p in range(7)])


@query("cohort_filter", "SELECT cohort_month, period, cohort_size, retained_customers, retention_rate FROM c_curve WHERE cohort_size >= 20")
def cohort_filter(spark, d):
    return C.pick(cohorts(spark, d), min_size=20).select("cohort_month", "period", "cohort_size", "retained_customers", "retention_rate")


@query("cohort_summary", """WITH per AS (SELECT cohort_month, max(cohort_size) size, max(period) lp, arg_max(retention_rate, period) lr FROM c_curve GROUP BY 1), s AS (SELECT coalesce(min(lp) FILTER (lp >= 1), 0) p FROM per)
SELECT (SELECT count(*) FROM per) cohort_count, (SELECT round(avg(size), 6) FROM per) avg_cohort_size, (SELECT round(avg(lr), 6) FROM per) last_observed_avg_retention,
 (SELECT cohort_month FROM per ORDER BY lr DESC, cohort_month DESC LIMIT 1) best_last_cohort, (SELECT cohort_month FROM per ORDER BY lr, cohort_month LIMIT 1) worst_last_cohort,
 count(DISTINCT period) observed_periods, round(avg(retention_rate) FILTER (period = 1), 6) month1_avg_retention, (SELECT p::INTEGER FROM s) comparable_period,
 round(avg(retention_rate) FILTER (period = (SELECT p FROM s)), 6) comparable_avg_retention,
 (SELECT cohort_month FROM c_curve WHERE period = (SELECT p FROM s) ORDER BY retention_rate DESC, cohort_month DESC LIMIT 1) best_comparable_cohort FROM c_curve""")
def cohort_summary(spark, d):
    return C.summary(C.pick(cohorts(spark, d)))


@query("cohort_non_monotonic", """SELECT * FROM (SELECT cohort_month, count(*) points, count(*) FILTER (up) rises FROM (SELECT *, retention_rate - lag(retention_rate) OVER (PARTITION BY cohort_month ORDER BY period) > 1e-12 up FROM c_point) GROUP BY 1) WHERE points >= 3 AND rises > 0""")
def cohort_non_monotonic(spark, d):
    return C.non_monotonic(C.pick(cohorts(spark, d), mode="point"))


cte("c_churners", """SELECT customer_id, min(snapshot_date) final_churn_start_date, max(fs) final_snapshot_date FROM c_snapshots JOIN (SELECT customer_id, max(snapshot_date) fs, arg_max(current_status, snapshot_date) st,
 max(snapshot_date) FILTER (current_status <> 'churn_risk') calm FROM c_snapshots GROUP BY 1) USING (customer_id) WHERE st = 'churn_risk' AND (calm IS NULL OR snapshot_date > calm) GROUP BY 1""")
IN = ", ".join(f"'{t}'" for t in C.MEANINGFUL)
cte("c_anchor", f"""SELECT customer_id, final_churn_start_date, coalesce(m, a, final_churn_start_date) behavior_anchor_time, CASE WHEN m IS NOT NULL THEN 'last_meaningful_event' WHEN a IS NOT NULL THEN 'last_any_event' ELSE 'final_churn_start_date' END anchor_source
FROM c_churners LEFT JOIN (SELECT customer_id, max(event_time) FILTER (event_type IN ({IN})) m, max(event_time) a FROM c_order_events GROUP BY 1) USING (customer_id)""")
cte("c_pre", "SELECT e.* FROM c_order_events e JOIN c_anchor USING (customer_id) WHERE event_time <= behavior_anchor_time AND event_time >= behavior_anchor_time - INTERVAL 30 DAY")
cte("c_comp", "SELECT * FROM (SELECT *, lag(event_type) OVER (PARTITION BY customer_id ORDER BY event_time, event_id, event_type) b FROM c_pre) WHERE b IS NULL OR b <> event_type")
cte("c_pat", """SELECT customer_id, coalesce(pattern, 'no_history') pattern FROM c_churners LEFT JOIN (SELECT customer_id, string_agg(event_type, ' > ' ORDER BY rn DESC) pattern FROM
 (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY event_time DESC, event_id DESC, event_type DESC) rn FROM c_comp) WHERE rn <= 5 GROUP BY 1) USING (customer_id)""")
TIE = ["event_id", "event_type"]
D = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)


def churners(spark, d):
    return staged(spark, d, "churners", lambda: C.final_churn_start(snapshots(spark, d)))


def anchors(spark, d):
    return staged(spark, d, "anchors", lambda: C.behaviour_anchor(A.order_events(spark, d), churners(spark, d)))


@query("churn_run_start", "SELECT customer_id, strftime(final_churn_start_date, '%Y-%m-%d') final_churn_start_date, strftime(final_snapshot_date, '%Y-%m-%d') final_snapshot_date FROM c_churners")
def churn_run_start(spark, d):
    return churners(spark, d).select("customer_id", D("final_churn_start_date"), D("final_snapshot_date"))


@query("behaviour_anchor", "SELECT customer_id, strftime(behavior_anchor_time, '%Y-%m-%d') behavior_anchor_time, anchor_source FROM c_anchor")
def behaviour_anchor(spark, d):
    return anchors(spark, d).select("customer_id", D("behavior_anchor_time"), "anchor_source")


@query("sequence_compress", "SELECT customer_id, strftime(event_time, '%Y-%m-%d') event_time, event_id, event_type FROM c_comp")
def sequence_compress(spark, d):
    return C.compress(C.before_anchor(A.order_events(spark, d), anchors(spark, d)), TIE).select("customer_id", D("event_time"), "event_id", "event_type")


@query("churn_patterns", "SELECT * FROM c_pat")
def churn_patterns(spark, d):
    return C.last_patterns(A.order_events(spark, d), anchors(spark, d), TIE)


@query("churn_top_patterns", "SELECT row_number() OVER (ORDER BY count(*) DESC, pattern)::INTEGER AS rank, pattern, count(*) customer_count, round(count(*) / (SELECT count(*) FROM c_pat), 6)::DOUBLE share_of_churn_customers FROM c_pat GROUP BY pattern ORDER BY 3 DESC, 2 LIMIT 5")
def churn_top_patterns(spark, d):
    return C.top_patterns(staged(spark, d, "patterns", lambda: C.last_patterns(A.order_events(spark, d), anchors(spark, d), TIE)))


PRE = ", ".join(f"('{t}')" for t in C.PRE_CHURN)


@query("pre_churn_events", f"SELECT k event_type, count(event_type) event_count, count(DISTINCT customer_id) customer_count, round(count(DISTINCT customer_id) / (SELECT count(*) FROM c_churners), 6)::DOUBLE customer_share FROM (VALUES {PRE}) v(k) LEFT JOIN c_pre ON event_type = k GROUP BY 1")
def pre_churn_events(spark, d):
    a = anchors(spark, d)
    return C.pre_churn_counts(C.before_anchor(A.order_events(spark, d), a), a.count())


FUN = """WITH n AS (SELECT customer_id, count(order_id) n FROM c_customers LEFT JOIN c_orders USING (customer_id) GROUP BY 1), k AS (SELECT count(*) s0, count(*) FILTER (n >= 1) s1, count(*) FILTER (n >= 2) s2, count(*) FILTER (n >= 3) s3, (SELECT count(*) FROM c_churners) s4 FROM n)
""" + " UNION ALL ".join(f"SELECT '{C.STAGES[i]}' stage, s{i} customer_count, " + ("1.0::DOUBLE stage_rate_from_signup, 1.0::DOUBLE transition_rate_from_prev" if i == 0 else f"round(s{i} / greatest(s0, 1), 6)::DOUBLE, round(s{i} / greatest(s{i - 1}, 1), 6)::DOUBLE") + " FROM k" for i in range(5))


@query("journey_funnel", FUN)
def journey_funnel(spark, d):
    return C.funnel(A.customers(spark, d), A.orders(spark, d), churners(spark, d))


@query("churn_stage_timing", f"""SELECT churn_stage, count(*) churned_customers, round(avg(days), 6) avg_days_to_churn, median(days)::DOUBLE median_days_to_churn, round(count(*) / (SELECT count(*) FROM c_churners), 6)::DOUBLE share_of_churn_customers
FROM (SELECT customer_id, greatest(date_diff('day', any_value(signup_date)::DATE, any_value(final_churn_start_date)), 0) AS days,
 CASE WHEN count(order_id) >= 3 THEN '{C.STAGES[3]}' WHEN count(order_id) = 2 THEN '{C.STAGES[2]}' WHEN count(order_id) = 1 THEN '{C.STAGES[1]}' ELSE '{C.STAGES[0]}' END churn_stage
FROM (SELECT h.customer_id, h.final_churn_start_date, k.signup_date, o.order_id FROM c_churners h JOIN c_customers k USING (customer_id) LEFT JOIN c_orders o ON o.customer_id = h.customer_id AND o.order_time <= h.final_churn_start_date) GROUP BY 1) GROUP BY 1""")
def churn_stage_timing(spark, d):
    return C.churn_stages(A.customers(spark, d), A.orders(spark, d), churners(spark, d))
