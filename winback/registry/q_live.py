"""Live tables over the event time line: counters, scores, policy, queue and the queries on them."""

from pyspark.sql import functions as F

from winback import params
from winback.functions.scalars import scalars
from winback.operators import budget as B
from winback.operators import live as V
from winback.plans.summary import customer_summary
from winback.registry.core import cte, query
from winback.registry.q_decide import R6, walk_sql
from winback.registry.q_report import row
from winback.sources import adapters as A
from winback.sources.staging import staged

_by = {c: ", ".join(f"'{k}'" for k, v in V.COUNTERS.items() if v == c) for c in V.COUNTER_NAMES}
COUNT_SQL = ", ".join(f"count(*) FILTER (event_type IN ({k})) {c}" for c, k in _by.items())
cte("c_state", f"""SELECT customer_id, max(event_time) last_event_time, {COUNT_SQL}, coalesce(sum(amount) FILTER (event_type = 'purchase'), 0.0) revenue_30d, min(event_time) first_seen_at, count(*) event_count_total FROM c_events GROUP BY 1""")
cte("c_known", "SELECT customer_id, 1 known, churn_probability, clv, uplift_score, coupon_cost, persona, uplift_segment FROM c_summary WHERE frequency > 5")
cte("c_scores", """SELECT *, clv * uplift_score expected_incremental_profit, CASE WHEN coupon_cost > 0 THEN clv * uplift_score / coupon_cost END expected_roi,
 CASE WHEN is_cold = 1 THEN 'new' WHEN churn_score >= 0.85 THEN 'critical' WHEN churn_score >= 0.70 THEN 'high' WHEN churn_score >= 0.50 THEN 'medium' ELSE 'low' END risk_segment
FROM (SELECT s.customer_id, CASE WHEN known IS NULL THEN least(greatest(0.60 - 0.06 * greatest(event_count_total, 1), 0.15), 0.70)::DOUBLE ELSE churn_probability END churn_score,
 CASE WHEN known IS NULL THEN (CASE WHEN revenue_30d > 0 THEN revenue_30d * 6.0 ELSE 50000.0 END) ELSE clv END clv, CASE WHEN known IS NULL THEN 0.12::DOUBLE ELSE uplift_score END uplift_score, coupon_cost,
 (known IS NULL)::INTEGER is_cold, (known IS NULL AND event_count_total < 5)::INTEGER is_new_customer, coalesce(persona, 'new_signup') persona, uplift_segment, last_event_time scored_at, event_count_total
 FROM (SELECT * FROM c_state UNION ALL SELECT customer_id, TIMESTAMP '2024-01-01', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0.0, TIMESTAMP '2024-01-01', 1 FROM c_customers WHERE customer_id NOT IN (SELECT customer_id FROM c_state)) s LEFT JOIN c_known k USING (customer_id))""")
_churn, _up, _roi = "coalesce(churn_score, 0.0)", "coalesce(uplift_score, 0.0)", "coalesce(expected_roi, 0.0)"


def rule(i):
    vals = [("high_value_retention_benefit", "benefit", "high"), ("priority_human_followup", "crm", "high"), ("personalized_retention_offer", "benefit", "medium"),
            ("retention_message", "message", "medium"), ("light_retention_message", "message", "low"), ("low_risk_upsell_offer", "upsell", "low"), ("monitor_only", "monitoring", "none")]
    v = [f"'{x[i]}'" for x in vals]
    return (f"CASE WHEN {_churn} >= 0.85 OR risk_segment = 'critical' THEN (CASE WHEN {_up} >= 0.03 AND {_roi} >= 1 THEN {v[0]} ELSE {v[1]} END) WHEN {_churn} >= 0.70 OR risk_segment = 'high' THEN (CASE WHEN {_up} >= 0.02 THEN {v[2]} ELSE {v[3]} END) "
            f"WHEN {_churn} >= 0.50 OR risk_segment = 'medium' THEN {v[4]} WHEN {_up} >= 0.05 AND {_roi} >= 1 THEN {v[5]} ELSE {v[6]} END")


_base = "CASE recommended_category " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in V.ACTION_COST.items()) + " ELSE 5000.0::DOUBLE END"
_scale = "CASE intervention_intensity " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in V.COST_SCALE.items()) + " ELSE 1.0::DOUBLE END"
_cost = f"greatest({_base} * {_scale}, coalesce(CASE WHEN expected_roi > 0 THEN greatest(expected_incremental_profit / expected_roi, 0.0) END, 0.0))"
cte("c_policy", f"SELECT *, {rule(0)} recommended_action, {rule(1)} recommended_category, {rule(2)} intervention_intensity FROM c_scores")
cte("c_actions", f"""SELECT *, (churn_score >= 0.5 AND coalesce(action_roi, 0.0) >= 0 AND coalesce(expected_incremental_profit, 0.0) >= 0)::INTEGER should_queue, expected_incremental_profit priority_score FROM (
SELECT *, CASE WHEN action_cost > 0 THEN expected_incremental_profit / action_cost ELSE expected_roi END action_roi FROM (
SELECT *, round(CASE WHEN clv > 0 AND recommended_category IN ('coupon', 'crm', 'upsell') THEN least({_cost}, greatest(clv * 0.08, 1000.0)) ELSE {_cost} END, 2) action_cost FROM c_policy))""")


def state(spark, d):
    """Counters of the customers seen in the stream; the others start from an empty state."""
    def build():
        seen = V.feature_counters(A.events(spark, d))
        rest = A.customers(spark, d).select("customer_id").join(seen, "customer_id", "left_anti")
        start = F.lit("2024-01-01").cast("timestamp")
        empty = rest.select("customer_id", start.alias("last_event_time"), *[F.lit(0).cast("long").alias(c) for c in V.COUNTER_NAMES], F.lit(0.0).alias("revenue_30d"),
                            start.alias("first_seen_at"), F.lit(1).cast("long").alias("event_count_total"))
        return seen.unionByName(empty)
    return staged(spark, d, "live_state", build)


def known(spark, d):
    """Stored scores: of customers with more than five orders by the as-of day. The others have too little history and are scored as new ones."""
    return customer_summary(spark, d).where("frequency > 5").select(
        "customer_id", F.lit(1).alias("known"), "churn_probability", "clv", "uplift_score", "coupon_cost", "persona", "uplift_segment")


def scores(spark, d):
    return staged(spark, d, "live_scores", lambda: V.live_scores(state(spark, d), known(spark, d)))


def actions(spark, d):
    return staged(spark, d, "live_actions", lambda: V.live_actions(scores(spark, d)))


TS = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
STS = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S') {c}"


@query("feature_counters", f"SELECT customer_id, {STS('last_event_time')}, {', '.join(V.COUNTER_NAMES)}, round(revenue_30d, 4) revenue_30d, {STS('first_seen_at')}, event_count_total FROM c_state")
def feature_counters(spark, d):
    s = V.feature_counters(A.events(spark, d))
    return s.select("customer_id", TS("last_event_time"), *V.COUNTER_NAMES, F.round("revenue_30d", 4).alias("revenue_30d"), TS("first_seen_at"), "event_count_total")


def sliding_sql(n):
    return f"""SELECT customer_id, {n} AS days, strftime(we, '%Y-%m-%d') window_end, count(*) events, count(*) FILTER (event_type = 'visit') visits, count(*) FILTER (event_type = 'purchase') purchases
FROM (SELECT *, date_trunc('day', event_time) + (unnest(range(1, {n + 1})))::INTEGER * INTERVAL 1 DAY we FROM c_events) GROUP BY 1, 2, 3"""


@query("sliding_counters", f"{sliding_sql(7)} UNION ALL {sliding_sql(30)}")
def sliding_counters(spark, d):
    e = A.events(spark, d)
    both = V.sliding_counters(e, 7).withColumn("days", F.lit(7)).unionByName(V.sliding_counters(e, 30).withColumn("days", F.lit(30)))
    return both.withColumn("window_end", F.date_format("window_end", "yyyy-MM-dd"))


@query("cold_start_score", "SELECT customer_id, round(churn_score, 6) churn_score, round(clv, 4) clv, round(uplift_score, 6) uplift_score, is_new_customer FROM c_scores WHERE is_cold = 1")
def cold_start_score(spark, d):
    return scores(spark, d).where("is_cold = 1").select("customer_id", *R6("churn_score"), F.round("clv", 4).alias("clv"), *R6("uplift_score"), "is_new_customer")


@query("risk_band", "SELECT customer_id, risk_segment FROM c_scores")
def risk_band(spark, d):
    return scores(spark, d).select("customer_id", "risk_segment")


@query("live_policy", "SELECT customer_id, recommended_action, recommended_category, intervention_intensity FROM c_policy")
def live_policy(spark, d):
    return V.with_policy(scores(spark, d)).select("customer_id", "recommended_action", "recommended_category", "intervention_intensity")


@query("live_action_cost", "SELECT customer_id, action_cost, round(action_roi, 6) action_roi FROM c_actions")
def live_action_cost(spark, d):
    return V.with_action_cost(V.with_policy(scores(spark, d))).select("customer_id", "action_cost", *R6("action_roi"))


@query("live_priority", "SELECT customer_id, round(priority_score, 4) priority_score, row_number() OVER (ORDER BY priority_score DESC, customer_id) place FROM c_actions")
def live_priority(spark, d):
    from winback.functions.ranking import ordered_totals
    t = ordered_totals(actions(spark, d).select("customer_id", "priority_score"), [("priority_score", True), ("customer_id", False)], {"place": F.lit(1)})
    return t.select("customer_id", F.round("priority_score", 4).alias("priority_score"), "place")


@query("live_queue_rule", "SELECT customer_id, should_queue FROM c_actions")
def live_queue_rule(spark, d):
    return actions(spark, d).select("customer_id", "should_queue")


@query("live_actions", "SELECT customer_id, recommended_action, intervention_intensity, action_cost, round(priority_score, 4) priority_score, risk_segment FROM c_actions WHERE should_queue = 1")
def live_actions(spark, d):
    return actions(spark, d).where("should_queue = 1").select("customer_id", "recommended_action", "intervention_intensity", "action_cost",
                                                              F.round("priority_score", 4).alias("priority_score"), "risk_segment")


@query("live_score_summary", """SELECT count(*) scored_customers, round(avg(churn_score), 6) avg_churn_score, count(*) FILTER (churn_score >= 0.5) high_risk_customers, count(*) FILTER (churn_score >= 0.85) critical_band,
 count(*) FILTER (churn_score >= 0.70 AND churn_score < 0.85) high_band, count(*) FILTER (churn_score >= 0.50 AND churn_score < 0.70) medium_band, count(*) FILTER (churn_score < 0.50) low_band, round(min(churn_score), 6) min_churn_score, round(max(churn_score), 6) max_churn_score FROM c_scores""")
def live_score_summary(spark, d):
    return V.score_summary(scores(spark, d))


@query("live_queries", "SELECT customer_id, round(churn_score, 6) churn_score, risk_segment FROM c_scores ORDER BY churn_score DESC NULLS LAST, scored_at DESC, customer_id LIMIT 200")
def live_queries(spark, d):
    return scores(spark, d).orderBy(F.desc_nulls_last("churn_score"), F.desc("scored_at"), "customer_id").limit(200).select("customer_id", *R6("churn_score"), "risk_segment")


@query("live_queries_events", f"SELECT event_id, customer_id, event_type, {STS('event_time')} FROM c_events WHERE event_type = 'support_contact' ORDER BY event_time DESC NULLS LAST, event_id DESC LIMIT 200".replace("strftime(event_time", "strftime(c_events.event_time").replace("ORDER BY event_time", "ORDER BY c_events.event_time"))
def live_queries_events(spark, d):
    e = A.events(spark, d).where("event_type = 'support_contact'").orderBy(F.desc_nulls_last("event_time"), F.desc("event_id")).limit(200)
    return e.select("event_id", "customer_id", "event_type", TS("event_time"))


@query("live_queries_states", f"SELECT customer_id, event_count_total, {STS('last_event_time')} FROM c_state ORDER BY c_state.last_event_time DESC NULLS LAST, customer_id LIMIT 100")
def live_queries_states(spark, d):
    s = V.feature_counters(A.events(spark, d)).orderBy(F.desc_nulls_last("last_event_time"), "customer_id").limit(100)
    return s.select("customer_id", "event_count_total", TS("last_event_time"))


@query("live_queries_queue", "SELECT customer_id, recommended_action, round(priority_score, 4) priority_score FROM c_actions WHERE should_queue = 1 AND recommended_category = 'benefit' ORDER BY c_actions.priority_score DESC NULLS LAST, customer_id LIMIT 100")
def live_queries_queue(spark, d):
    q = actions(spark, d).where("should_queue = 1 AND recommended_category = 'benefit'").orderBy(F.desc_nulls_last("priority_score"), "customer_id").limit(100)
    return q.select("customer_id", "recommended_action", F.round("priority_score", 4).alias("priority_score"))


@query("new_customers", f"SELECT s.customer_id, s.event_count_total, strftime(s.first_seen_at, '%Y-%m-%d %H:%M:%S') first_seen_at, round(churn_score, 6) churn_score, risk_segment FROM c_state s JOIN c_scores USING (customer_id) WHERE is_cold = 1")
def new_customers(spark, d):
    s = V.feature_counters(A.events(spark, d)).select("customer_id", "event_count_total", TS("first_seen_at"))
    return s.join(scores(spark, d).where("is_cold = 1").select("customer_id", *R6("churn_score"), "risk_segment"), "customer_id")


@query("live_counts", "SELECT (SELECT count(*) FROM c_events) events, (SELECT count(*) FROM c_state) states, (SELECT count(*) FROM c_scores) scores, (SELECT count(*) FROM c_actions WHERE should_queue = 1) queued, (SELECT count(*) FROM c_actions WHERE recommended_action <> 'monitor_only') candidates, (SELECT strftime(max(event_time), '%Y-%m-%d %H:%M:%S') FROM c_events) latest_event, (SELECT strftime(max(scored_at), '%Y-%m-%d %H:%M:%S') FROM c_scores) latest_score")
def live_counts(spark, d):
    text = lambda c: F.date_format(F.max(c), "yyyy-MM-dd HH:mm:ss")
    a = scalars(actions(spark, d), q=F.count_if(F.col("should_queue") == 1), c=F.count_if(F.col("recommended_action") != "monitor_only"))
    s = scalars(scores(spark, d), n=F.count(F.lit(1)), t=text("scored_at"))
    e = scalars(A.events(spark, d), n=F.count(F.lit(1)), c=F.count_distinct("customer_id"), t=text("event_time"))
    return row(spark, {"events": e["n"], "states": e["c"], "scores": s["n"], "queued": a["q"], "candidates": a["c"]}).withColumns({"latest_event": F.lit(e["t"]), "latest_score": F.lit(s["t"])})


@query("drift_check", "SELECT count(*) n, round(avg(churn_score), 6) mean, round(stddev_samp(churn_score), 6) stddev, count(*) FILTER (churn_score >= 0.5) high_risk, strftime(max(scored_at), '%Y-%m-%d %H:%M:%S') latest FROM c_scores")
def drift_check(spark, d):
    return V.drift(scores(spark, d))


@query("recent_refresh", "SELECT customer_id, recommended_action, action_cost FROM c_actions WHERE customer_id IN (SELECT customer_id FROM c_scores ORDER BY scored_at DESC, customer_id LIMIT 100)")
def recent_refresh(spark, d):
    """Actions again for the 100 latest-scored customers."""
    latest = scores(spark, d).orderBy(F.desc("scored_at"), "customer_id").limit(100)
    return V.live_actions(latest).select("customer_id", "recommended_action", "action_cost")


@query("job_log", "SELECT * FROM (SELECT 'score' job, count(*) result_rows, 'success' status FROM c_scores UNION ALL SELECT 'actions', count(*), 'success' FROM c_actions UNION ALL SELECT 'drift', 1, 'success')")
def job_log(spark, d):
    """Each refresh job appends start, finish and result to a log table; the log is then read."""
    from winback.plans.jobs import logged
    from winback.sources.staging import new_path
    path = new_path(spark, "job-log")
    logged(spark, path, "score", lambda: scores(spark, d).count())
    logged(spark, path, "actions", lambda: actions(spark, d).count())
    logged(spark, path, "drift", lambda: V.drift(scores(spark, d)).count())
    return spark.read.parquet(path).select("job", "result_rows", "status")


@query("live_dimensions", """SELECT customer_id, coalesce(nullif(persona, ''), 'unknown') persona, CASE WHEN uplift_segment IS NOT NULL THEN uplift_segment WHEN uplift_score >= 0.08 THEN 'very_high_uplift' WHEN uplift_score >= 0.05 THEN 'high_uplift'
 WHEN uplift_score >= 0.02 THEN 'medium_uplift' WHEN uplift_score >= 0 THEN 'low_uplift' ELSE 'negative_uplift' END uplift_segment FROM c_scores""")
def live_dimensions(spark, d):
    """Persona and segment restored from a nested JSON payload under several names, else derived from the score."""
    p = scores(spark, d).select("customer_id", "uplift_score", F.to_json(F.struct(F.struct(F.col("persona").alias("customer_persona")).alias("profile"),
                                                                                  F.struct(F.col("uplift_segment").alias("segment")).alias("uplift"))).alias("payload"))
    v = F.parse_json("payload")
    first = lambda *paths: F.coalesce(*[F.try_variant_get(v, x, "string") for x in paths])
    seg = F.nullif(first("$.uplift_segment", "$.uplift.segment", "$.profile.uplift_segment"), F.lit("unknown_segment"))
    return p.select("customer_id", F.coalesce(F.nullif(first("$.persona", "$.profile.persona", "$.profile.customer_persona"), F.lit("")), F.lit("unknown")).alias("persona"),
                    F.coalesce(seg, V.uplift_bucket(F.col("uplift_score"))).alias("uplift_segment"))


@query("uplift_buckets", "SELECT CASE WHEN uplift_score >= 0.08 THEN 'very_high_uplift' WHEN uplift_score >= 0.05 THEN 'high_uplift' WHEN uplift_score >= 0.02 THEN 'medium_uplift' WHEN uplift_score >= 0 THEN 'low_uplift' ELSE 'negative_uplift' END bucket, count(*) customers FROM c_summary GROUP BY 1")
def uplift_buckets(spark, d):
    return customer_summary(spark, d).groupBy(V.uplift_bucket(F.col("uplift_score")).alias("bucket")).agg(F.count(F.lit(1)).alias("customers"))


@query("investment_derive", "SELECT customer_id, round(coalesce(CASE WHEN action_cost > 0 THEN action_cost END, CASE WHEN coupon_cost > 0 THEN coupon_cost END, expected_incremental_profit / nullif(expected_roi, 0), 0.0), 4) investment FROM c_actions")
def investment_derive(spark, d):
    a = actions(spark, d)
    return a.select("customer_id", F.round(V.investment(a), 4).alias("investment"))


cte("c_live_pool", """SELECT *, action_cost coupon_cost, row_number() OVER (ORDER BY priority_score DESC, action_roi DESC, customer_id) rn FROM (SELECT * EXCLUDE (coupon_cost) FROM c_actions WHERE should_queue = 1 AND action_cost > 0 AND expected_incremental_profit > 0)""")


@query("live_budget_reselect", walk_sql("c_live_pool", "[2000000]", "(SELECT greatest(1, floor(count(*) * 0.35)) FROM c_live_pool)") + "SELECT customer_id, recommended_action, coupon_cost, round(priority_score, 4) priority_score FROM c_sel")
def live_budget_reselect(spark, d):
    q = actions(spark, d).where("should_queue = 1 AND action_cost > 0 AND expected_incremental_profit > 0").withColumn("coupon_cost", F.col("action_cost"))
    ranked = B.rank_pool(q, [("priority_score", True), ("action_roi", True), ("customer_id", False)])
    return B.greedy(ranked, [2_000_000], high_cap=B.high_share_cap(ranked.count())).select("customer_id", "recommended_action", "coupon_cost", F.round("priority_score", 4).alias("priority_score"))


@query("sink_replace_slice", """SELECT source_type, recommended_category, count(*) AS n FROM (SELECT 'seed' source_type, recommended_category FROM c_actions UNION ALL SELECT 'live', recommended_category FROM c_actions WHERE scored_at >= TIMESTAMP '2024-01-30' OR should_queue = 1) GROUP BY 1, 2""")
def sink_replace_slice(spark, d):
    """Seed rows stay; the live rows of touched customers are deleted and written afresh."""
    a = actions(spark, d).select("customer_id", "recommended_category", "should_queue", "scored_at")
    table = a.withColumn("source_type", F.lit("seed")).unionByName(a.where("should_queue = 1").withColumn("source_type", F.lit("live")))
    fresh = a.where((F.col("scored_at") >= F.lit("2024-01-30").cast("timestamp")) | (F.col("should_queue") == 1))
    return V.replace_slice(table, fresh, fresh, "live").groupBy("source_type", "recommended_category").agg(F.count(F.lit(1)).alias("n"))


@query("seed_live_from_batch", f"""SELECT s.customer_id, s.persona, round(s.churn_probability, 6) churn_score, s.clv, e.visits_{params.SHORT}d visits, v.risk_group FROM c_summary s LEFT JOIN c_evt e USING (customer_id) LEFT JOIN c_survival v USING (customer_id)""")
def seed_live_from_batch(spark, d):
    """Summary, features and survival merged on the customer; the first table with a value wins."""
    from winback.plans.summary import survival_scores
    from winback.registry.q_features import evt
    m = V.outer_merge([customer_summary(spark, d), evt(spark, d).select("customer_id", F.col(f"visits_{params.SHORT}d").alias("visits")), survival_scores(spark, d)])
    return m.select("customer_id", "persona", F.round("churn_probability", 6).alias("churn_score"), "clv", "visits", "risk_group")


@query("sink_live_upsert", """SELECT customer_id, round(coalesce(n.churn_score, o.churn_probability), 6) churn_score, o.clv FROM c_summary o FULL JOIN (SELECT customer_id, CASE WHEN is_cold = 1 THEN churn_score END churn_score FROM c_scores WHERE customer_id < 100000000) n USING (customer_id)""")
def sink_live_upsert(spark, d):
    """New scores over the stored table; a NULL score keeps the stored one."""
    table = customer_summary(spark, d).select("customer_id", F.col("churn_probability").alias("churn_score"), "clv")
    fresh = scores(spark, d).select("customer_id", F.when(F.col("is_cold") == 1, F.col("churn_score")).alias("churn_score"))
    return V.upsert(table, fresh).select("customer_id", *R6("churn_score"), "clv")


@query("live_key_normalise", "SELECT customer_id, max(event_id) last_event_id FROM c_events GROUP BY 1")
def live_key_normalise(spark, d):
    """Text keys to numbers, bad keys dropped, last row per key kept."""
    from winback.functions.ranking import latest_rows
    e = A.events(spark, d).select(F.when(F.col("event_id") % 97 == 0, F.concat(F.lit(" "), F.col("customer_id").cast("string"))).otherwise(F.col("customer_id").cast("string")).alias("user_key"), "event_id")
    bad = e.limit(0).unionByName(e.select(F.lit("n/a").alias("user_key"), "event_id"))
    key = F.try_to_number(F.trim("user_key"), F.lit("999999999999999")).cast("long")
    t = e.unionByName(bad).withColumn("customer_id", key).where("customer_id IS NOT NULL").select("customer_id", F.col("event_id").alias("last_event_id"))
    return latest_rows(t, ["customer_id"], [F.col("last_event_id")])


@query("alias_pick", "SELECT customer_id, round(churn_probability, 6) churn, clv AS amount FROM c_summary")
def alias_pick(spark, d):
    """First existing column among names, then the first non-NULL value row by row."""
    from winback.functions.scalars import first_of
    s = customer_summary(spark, d).withColumnRenamed("churn_probability", "churn_score")
    return s.select("customer_id", F.round(first_of(s, ["churn_probability", "churn_score", "risk_score"]), 6).alias("churn"), first_of(s, ["predicted_clv_12m", "clv", "monetary"]).alias("amount"))




@query("ts_normalise", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE strftime(event_time, '%Y-%m-%d %H:%M:%S') END parsed FROM c_events")
def ts_normalise(spark, d):
    """Event times written in five odd ways (one of them broken), repaired and parsed."""
    t = F.col("event_time")
    plain, iso = F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    odd = (F.when(F.col("event_id") % 5 == 0, F.concat(plain, F.lit("."))).when(F.col("event_id") % 5 == 1, F.concat(iso, F.lit("Z")))
           .when(F.col("event_id") % 5 == 2, F.concat(plain, F.lit("+00"))).when(F.col("event_id") % 5 == 3, F.concat(iso, F.lit("+0000"))).otherwise("bad"))
    return A.events(spark, d).select("event_id", F.date_format(V.ts_normalise(odd), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("realtime_overview", "SELECT risk_segment, count(*) customers, count(*) FILTER (should_queue = 1) queued, round(avg(churn_score), 6) mean_score FROM c_actions GROUP BY 1")
def realtime_overview(spark, d):
    return actions(spark, d).groupBy("risk_segment").agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("should_queue") == 1).alias("queued"),
                                                         F.round(F.avg("churn_score"), 6).alias("mean_score"))


