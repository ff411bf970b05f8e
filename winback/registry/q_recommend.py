"""Recommendations and explanations, with history from the event time line."""

from pyspark.sql import functions as F

from winback import params
from winback.functions.ranking import ordered_totals
from winback.operators import explain as X
from winback.operators import policy as P
from winback.operators import recommend as R
from winback.plans import decision as D
from winback.plans.summary import customer_summary, survival_scores
from winback.registry.core import cte, query
from winback.registry.q_decide import API_WALK, R6
from winback.registry.q_features import M, fm
from winback.registry.tables import rank_pct
from winback.sources import adapters as A
from winback.sources.staging import staged

WALK = API_WALK.strip()
VIEW = ", ".join(f"'{v}'" for v in R.VIEW_EVENTS)
cte("c_ev_cat", "SELECT *, 'C' || (k % 8)::VARCHAR item_category FROM c_events")
cte("c_pref", "SELECT customer_id, item_category, sum(net_amount * exp(-greatest(floor((epoch_us((SELECT max(order_time) FROM c_event_orders)) - epoch_us(order_time)) / 86400000000.0::DOUBLE), 0) / 90.0::DOUBLE) + quantity * 5000.0) customer_pref_score FROM c_event_orders GROUP BY 1, 2")
cte("c_segpop", "SELECT persona, uplift_segment, item_category, sum(net_amount) + count(*) * 3000.0::DOUBLE segment_popularity FROM c_event_orders LEFT JOIN c_summary USING (customer_id) GROUP BY 1, 2, 3")
cte("c_globpop", "SELECT item_category, sum(net_amount) + count(*) * 2000.0::DOUBLE global_popularity FROM c_event_orders GROUP BY 1")
cte("c_seen", f"SELECT * FROM c_ev_cat WHERE event_type IN ({VIEW})")
cte("c_view", "SELECT customer_id, item_category, sum(exp(-greatest(floor((epoch_us((SELECT max(event_time) FROM c_seen)) - epoch_us(event_time)) / 86400000000.0::DOUBLE), 0) / 60.0::DOUBLE)) view_score FROM c_seen GROUP BY 1, 2")


def nrm(c):
    w = "OVER (PARTITION BY customer_id)"
    return f"CASE WHEN max({c}) {w} - min({c}) {w} < 1e-9 THEN 0.0 ELSE ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w}) END"


cte("c_recs", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, item_category)::INTEGER r FROM (
 SELECT *, round(0.50 * {nrm('p')} + 0.15 * {nrm('v')} + 0.20 * {nrm('s')} + 0.15 * {nrm('g')} + 0.05 * coupon_affinity, 9) score FROM (
 SELECT c.customer_id, c.persona, c.uplift_segment, coupon_affinity, k.item_category, coalesce(customer_pref_score, 0.0) p, coalesce(view_score, 0.0) v, coalesce(segment_popularity, 0.0) s, coalesce(global_popularity, 0.0) g
 FROM c_summary c CROSS JOIN (SELECT item_category FROM c_globpop UNION SELECT item_category FROM c_view) k LEFT JOIN c_pref USING (customer_id, item_category) LEFT JOIN c_view USING (customer_id, item_category)
 LEFT JOIN c_segpop x ON x.persona = c.persona AND x.uplift_segment = c.uplift_segment AND x.item_category = k.item_category LEFT JOIN c_globpop y ON y.item_category = k.item_category
 WHERE churn_probability >= 0.45))) WHERE r <= 3""")
TAGS = """CASE WHEN p <= 0 AND v <= 0 AND s <= 0 THEN 'global_popularity' ELSE concat_ws(', ', CASE WHEN p > 0 THEN 'own_purchase_history' END, CASE WHEN v > 0 THEN 'recent_browse_signal' END, CASE WHEN s > 0 THEN 'segment_popularity' END) END"""


def ev_cat(spark, d):
    return A.events(spark, d).withColumn("item_category", F.concat(F.lit("C"), (F.col("k") % 8).cast("string")))


def recs(spark, d):
    def build():
        o, s = A.event_orders(spark, d), customer_summary(spark, d)
        return R.recommend(R.targets(s, None), R.category_preference(o), R.recent_interest(ev_cat(spark, d)), R.segment_popularity(s, o), R.global_popularity(o))
    return staged(spark, d, "recommendations", build)


@query("category_preference", "SELECT customer_id, item_category, round(customer_pref_score, 4) customer_pref_score FROM c_pref")
def category_preference(spark, d):
    return R.category_preference(A.event_orders(spark, d)).withColumn("customer_pref_score", F.round("customer_pref_score", 4))


@query("segment_popularity", "SELECT persona, uplift_segment, item_category, round(segment_popularity, 4) segment_popularity FROM c_segpop")
def segment_popularity(spark, d):
    return R.segment_popularity(customer_summary(spark, d), A.event_orders(spark, d)).withColumn("segment_popularity", F.round("segment_popularity", 4))


@query("global_popularity", "SELECT item_category, round(global_popularity, 4) global_popularity FROM c_globpop")
def global_popularity(spark, d):
    return R.global_popularity(A.event_orders(spark, d)).withColumn("global_popularity", F.round("global_popularity", 4))


@query("recent_interest", "SELECT customer_id, item_category, round(view_score, 6) view_score FROM c_view")
def recent_interest(spark, d):
    return R.recent_interest(ev_cat(spark, d)).withColumn("view_score", F.round("view_score", 6))


def flat(c):
    return f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0 ELSE {rank_pct(c)} END"


@query("rec_targets", f"""{WALK} SELECT customer_id, round(rp, 6) recommendation_priority, round(priority_score, 6) target_priority_score,
 row_number() OVER (ORDER BY priority_score DESC, expected_incremental_profit DESC, expected_roi DESC, rp DESC, intervention_window_days, clv DESC, customer_id) place
FROM (SELECT *, least(0.30 * {flat('priority_score')} + 0.22 * churn_probability + 0.14 * {flat('uplift_score')} + 0.14 * {flat('clv')} + 0.10 * {flat('greatest(expected_roi, 0.0)')} + 0.10 * timing_urgency_score, 1.0) rp FROM c_sel)""")
def rec_targets(spark, d):
    t = R.targets(customer_summary(spark, d), D.selected_once(spark, d))
    t = ordered_totals(t, R.TARGET_ORDER, {"place": F.lit(1)})
    return t.select("customer_id", *R6("recommendation_priority", "target_priority_score"), "place")


@query("recommend_topk", "SELECT customer_id, persona, uplift_segment, r recommendation_rank, item_category recommended_category, round(score, 6) recommendation_score FROM c_recs")
def recommend_topk(spark, d):
    return recs(spark, d).drop("reason_tags").withColumn("recommendation_score", F.round("recommendation_score", 6))


@query("rec_reasons", f"SELECT customer_id, item_category recommended_category, {TAGS} reason_tags FROM c_recs")
def rec_reasons(spark, d):
    return recs(spark, d).select("customer_id", "recommended_category", "reason_tags")


FIN = {"C0": "deposit", "C1": "loan", "C2": "credit_card", "C3": "savings", "C4": "fund", "C5": "insurance"}
_cat = "CASE item_category " + " ".join(f"WHEN '{k}' THEN '{R.FINANCE_CATEGORIES[v]}'" for k, v in FIN.items()) + " ELSE item_category END"
_tags = TAGS
for _k, _v in R.FINANCE_REASONS.items():
    _tags = _tags.replace(_k, _v)


@query("rec_finance_labels", f"SELECT customer_id, r recommendation_rank, {_cat} recommended_category, {_tags} reason_tags FROM c_recs")
def rec_finance_labels(spark, d):
    """Category codes named after finance products, then put into finance words."""
    from winback.functions.scalars import literal_map
    r = recs(spark, d).withColumn("recommended_category", F.coalesce(literal_map(FIN, F.col("recommended_category")), F.col("recommended_category")))
    return R.finance_labels(r).select("customer_id", "recommendation_rank", "recommended_category", "reason_tags")


@query("rec_summary", """SELECT coalesce(item_category, 'ALL') recommended_category, count(*) recommendations, count(DISTINCT customer_id) customers_covered, round(count(*) / count(DISTINCT customer_id), 3)::DOUBLE per_customer FROM c_recs GROUP BY ROLLUP (item_category)""")
def rec_summary(spark, d):
    """Rows and coverage per category; ALL is the total."""
    return recs(spark, d).rollup("recommended_category").agg(
        F.count(F.lit(1)).alias("recommendations"), F.count_distinct("customer_id").alias("customers_covered"),
        F.round(F.count(F.lit(1)) / F.count_distinct("customer_id"), 3).alias("per_customer")).withColumn(
        "recommended_category", F.coalesce("recommended_category", F.lit("ALL")))


@query("rec_rank_live", """SELECT customer_id, item_category recommended_category, r recommendation_rank, round(score, 6) recommendation_score, round(max(score) OVER (PARTITION BY customer_id), 6) customer_best FROM c_recs WHERE r <= 2""")
def rec_rank_live(spark, d):
    return R.rerank(recs(spark, d), 2).select("customer_id", "recommended_category", "recommendation_rank", *R6("recommendation_score", "customer_best"))


PCT = {"inactivity_days": "s.inactivity_days", "recency_days": "s.recency_days", "visit_change_rate": "s.visit_change_rate", "purchase_change_rate": "s.purchase_change_rate",
       "support_contact": f"coalesce(e.support_contact_{M}d, 0)", "purchase_cycle_anomaly": "coalesce(idle_us / 86400000000.0::DOUBLE / nullif(gap, 0), 0)",
       "uplift_score": "s.uplift_score", "coupon_affinity": "s.coupon_affinity", "clv": "s.clv", "timing_urgency_score": "t.timing_urgency_score",
       "discount_pressure_score": "s.discount_pressure_score", "coupon_fatigue_score": "s.coupon_fatigue_score"}
cte("c_exp_base", "SELECT s.customer_id, s.persona, s.uplift_segment, s.churn_probability, s.expected_roi, " + ", ".join(
    (f"round({v}, 6)::DOUBLE {k}" if k == "purchase_cycle_anomaly" else f"{v} {k}") for k, v in PCT.items())
    + " FROM c_summary s JOIN c_timed_api t USING (customer_id) LEFT JOIN c_evt e USING (customer_id) LEFT JOIN c_ord USING (customer_id) WHERE s.churn_probability >= 0.5")
cte("c_exp_pct", "SELECT *, " + ", ".join(f"{rank_pct(k)} pct_{k}" for k in PCT) + " FROM c_exp_base")


def _cells(rules, field):
    parts = []
    for col, way, cut, code, text in rules:
        if col in PCT:
            op = ">=" if way == "high" else "<="
            parts.append(f"CASE WHEN round(pct_{col}, 9) {op} {cut} THEN '{ {'code': code, 'text': text, 'col': col}[field] }' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def _join(rules, field, n, sep, extra=None):
    lst = _cells(rules, field)
    text = f"array_to_string(list_slice({lst}, 1, {n}), '{sep}')"
    return text if extra is None else f"CASE WHEN len({lst}) = 0 THEN {extra} ELSE {text} END"


fr = lambda i: f"CASE WHEN churn_probability >= 0.5 THEN '{X.FALLBACK_RISK[i]}' ELSE '' END"
fl = lambda i: f"CASE WHEN expected_roi > 0 THEN '{X.FALLBACK_LEVER[i]}' ELSE '' END"
cte("c_exp", f"""SELECT customer_id, persona, uplift_segment, {_join(X.RISK, 'code', 3, ', ', fr(0))} risk_reason_codes, {_join(X.RISK, 'text', 3, ' / ', fr(1))} risk_reason_text,
 {_join(X.LEVER, 'code', 2, ', ', fl(0))} action_reason_codes, {_join(X.LEVER, 'text', 2, ' / ', fl(1))} action_reason_text,
 {_join(X.GUARD, 'code', 2, ', ')} guardrail_codes, {_join(X.GUARD, 'text', 2, ' / ', f"'{X.NO_GUARD}'")} guardrail_text FROM c_exp_pct""")


def exp_base(spark, d):
    def build():
        s = P.with_timing(customer_summary(spark, d).where(F.col("churn_probability") >= params.RISK_THRESHOLD), survival_scores(spark, d))
        f = fm(spark, d).select("customer_id", F.col(f"support_contact_{M}d").alias("support_contact"), "purchase_cycle_anomaly")
        sel = D.selected_once(spark, d).select("customer_id", "intervention_intensity")
        return X.percentiles(s.join(f, "customer_id", "left").join(sel, "customer_id", "left"))
    return staged(spark, d, "explain_base", build)


@query("percentile_frame", "SELECT customer_id, " + ", ".join(f"round(pct_{k}, 6) pct_{k}" for k in PCT) + " FROM c_exp_pct")
def percentile_frame(spark, d):
    return exp_base(spark, d).select("customer_id", *R6(*[f"pct_{k}" for k in PCT]))


@query("explain_rules", "SELECT * FROM c_exp")
def explain_rules(spark, d):
    return X.explain(exp_base(spark, d)).drop("dominant_features", "recommended_action_note")


@query("explain_counts", "SELECT code, count(*) customers FROM (SELECT unnest(string_split(risk_reason_codes, ', ')) code FROM c_exp) WHERE code <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def explain_counts(spark, d):
    return X.reason_counts(X.explain(exp_base(spark, d)))


def _texts(conds, names, n, none):
    lst = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in zip(conds, names)) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({lst}) = 0 THEN '{none}' ELSE array_to_string(list_slice({lst}, 1, {n}), ', ') END"


WHY = ["s.churn_probability >= 0.6", "s.uplift_score >= 0.02", "s.clv >= 1000000", "x.intervention_window_days <= 7", "s.expected_roi >= 0.3", "s.coupon_affinity >= 0.7 AND s.price_sensitivity >= 0.7", "s.exposure_count >= 3"]
CARE = ["s.exposure_count >= 3", "s.price_sensitivity >= 0.8", "s.support_contact_propensity >= 0.5", "lower(v.risk_group) LIKE 'high%'"]


@query("customer_explanations", f"""{WALK} SELECT s.customer_id, s.persona, {_texts(WHY, X.REASONS, 4, X.NO_REASON)} selection_reason, {_texts(CARE, X.WATCH, 3, X.NO_WATCH)} watchout, x.intervention_intensity, r.item_category recommended_category, v.risk_group
FROM c_summary s LEFT JOIN c_sel x USING (customer_id) LEFT JOIN (SELECT * FROM c_recs WHERE r = 1) r USING (customer_id) LEFT JOIN c_survival v USING (customer_id)""")
def customer_explanations(spark, d):
    s = customer_summary(spark, d)
    x = D.selected_once(spark, d).select("customer_id", "intervention_intensity", "intervention_window_days")
    r = recs(spark, d).where("recommendation_rank = 1").select("customer_id", "recommended_category")
    v = survival_scores(spark, d).select("customer_id", "risk_group")
    j = s.join(x, "customer_id", "left").join(r, "customer_id", "left").join(v, "customer_id", "left")
    return X.customer_reasons(j).select("customer_id", "persona", "selection_reason", "watchout", "intervention_intensity", "recommended_category", "risk_group")
