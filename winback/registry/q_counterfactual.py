"""Counterfactual comparison of five actions per customer."""

from pyspark.sql import functions as F

from winback import params
from winback.functions.ranking import ordered_totals
from winback.operators import counterfactual as K
from winback.operators import policy as P
from winback.plans import decision as D
from winback.plans.summary import customer_summary, survival_scores
from winback.registry.core import cte, query
from winback.registry.q_decide import API_WALK, R6, timing_sql
from winback.registry.tables import mm
from winback.sources.staging import staged

WALK = API_WALK.strip()
cte("c_timed_cf", timing_sql("c_summary"))
cte("c_cf_in", "SELECT * REPLACE (least(greatest(uplift_score, -0.30), 0.60) AS uplift_score) FROM c_timed_cf WHERE churn_probability >= 0.5")
cte("c_cf", f"""SELECT *, 0.34 * churn_probability + 0.26 * greatest(uplift_score, 0.0) + 0.20 * {mm('clv')} + 0.20 * timing_urgency_score rank_score,
 least(greatest(0.82 + 0.22 * {mm('coupon_affinity')} + 0.22 * {mm('price_sensitivity')} + 0.12 * timing_urgency_score - 0.18 * {mm('discount_pressure_score')}, 0.25), 1.35) fit_coupon_5000,
 least(greatest(0.78 + 0.25 * {mm('clv')} + 0.18 * churn_probability + 0.14 * timing_urgency_score - 0.08 * {mm('coupon_affinity')}, 0.25), 1.35) fit_consult_call,
 least(greatest(0.68 + 0.18 * greatest(uplift_score, 0.0) + 0.12 * (1 - {mm('discount_pressure_score')}) + 0.10 * (1 - timing_urgency_score), 0.25), 1.35) fit_push_email FROM c_cf_in""")


def _scen():
    parts = []
    for i, (n, label, cost, mult, channel) in enumerate(K.ACTIONS):
        if n == "no_action":
            lift, treated, opt = "0.0", "churn_probability", "0.0"
        elif n == "wait_7d":
            treated = "least(churn_probability + least(7.0 / intervention_window_days, 1.0) * (0.05 + 0.22 * timing_urgency_score + 0.20 * churn_probability), 1.0)"
            lift, opt = f"churn_probability - {treated}", "0.018 * clv * (1 - timing_urgency_score) * greatest(uplift_score, 0.0)"
        else:
            lift = f"least(least(greatest(uplift_score * {mult}::DOUBLE * least(greatest(churn_timing_weight, 0.60), 1.60) * fit_{n}, -0.25), 0.45), churn_probability)"
            treated, opt = f"least(greatest(churn_probability - {lift}, 0.0), 1.0)", "0.0"
        parts.append(f"SELECT *, {i} idx, '{n}' action_id, '{label}' action_label, '{channel}' channel, {cost}::DOUBLE action_cost, ({treated})::DOUBLE treated, ({lift})::DOUBLE lift, ({opt})::DOUBLE opt FROM c_cf")
    return f"SELECT *, clv * (1 - treated) + opt - action_cost net FROM ({' UNION ALL '.join(parts)})"


cte("c_scen", _scen())
cte("c_best", f"""SELECT *, CASE WHEN score >= 0.74 THEN '{K.SURE}' WHEN score >= 0.50 THEN '{K.FAIR}' ELSE '{K.WEAK}' END confidence FROM (
SELECT customer_id, any_value(churn_probability) churn_probability, any_value(uplift_score) uplift_score, any_value(clv) clv, arg_min(action_id, r) best_action_id, arg_min(action_label, r) final_recommendation, max(net) best_net,
 max(net) - max(net) FILTER (idx = 0) gain, max(net) - max(net) FILTER (r = 2) margin,
 least(0.55 * 1.0 + 0.25 * least((max(net) - max(net) FILTER (r = 2)) / any_value(clv), 0.35) / 0.35 + 0.20 * least(abs(any_value(uplift_score)), 0.20) / 0.20, 1.0)::DOUBLE score
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY net DESC, idx) r FROM c_scen) GROUP BY 1)""")


def base(spark, d):
    def build():
        p = K.pool(customer_summary(spark, d), D.selected_once(spark, d), params.RISK_THRESHOLD)
        return K.with_rank_score(P.with_timing(p, survival_scores(spark, d)))
    return staged(spark, d, "cf_base", build)


def best(spark, d):
    return staged(spark, d, "cf_best", lambda: K.best_actions(base(spark, d)))


@query("cf_pool", f"""{WALK} SELECT customer_id, row_number() OVER (ORDER BY rank_score DESC, churn_probability DESC, clv DESC, customer_id) place, round(rank_score, 6) rank_score, intervention_intensity
FROM c_cf LEFT JOIN (SELECT customer_id, intervention_intensity FROM c_sel) USING (customer_id)""")
def cf_pool(spark, d):
    t = ordered_totals(base(spark, d), [("rank_score", True), ("churn_probability", True), ("clv", True), ("customer_id", False)], {"place": F.lit(1)})
    return t.select("customer_id", "place", *R6("rank_score"), "intervention_intensity")


@query("cf_action_fit", "SELECT customer_id, round(fit_coupon_5000, 6) fit_coupon_5000, round(fit_consult_call, 6) fit_consult_call, round(fit_push_email, 6) fit_push_email FROM c_cf")
def cf_action_fit(spark, d):
    b = base(spark, d)
    return b.select("customer_id", *[F.round(v, 6).alias(f"fit_{k}") for k, v in K.action_fits(b).items()])


@query("cf_scenarios", """SELECT customer_id, action_id, action_label, channel, action_cost, round(treated, 6) treated_churn_probability, round(lift, 6) estimated_retention_lift, round(opt, 2) option_value,
 round(net, 2) expected_net_profit, round(net - clv * (1 - churn_probability), 2) incremental_vs_no_action, CASE WHEN action_cost > 0 THEN round((net - clv * (1 - churn_probability)) / action_cost, 6) END expected_roi FROM c_scen""")
def cf_scenarios(spark, d):
    s = K.scenarios(base(spark, d))
    return s.select("customer_id", "action_id", "action_label", "channel", "action_cost", *R6("treated_churn_probability", "estimated_retention_lift"),
                    *[F.round(c, 2).alias(c) for c in ("option_value", "expected_net_profit", "incremental_vs_no_action")], *R6("expected_roi"))


@query("cf_best_action", "SELECT customer_id, best_action_id, final_recommendation, round(best_net, 2) best_expected_net_profit, round(gain, 2) incremental_vs_no_action, round(margin, 2) decision_margin FROM c_best")
def cf_best_action(spark, d):
    return best(spark, d).select("customer_id", "best_action_id", "final_recommendation",
                                 *[F.round(c, 2).alias(c) for c in ("best_expected_net_profit", "incremental_vs_no_action", "decision_margin")])


@query("cf_confidence", f"SELECT customer_id, round(score, 6) confidence_score, confidence, (confidence <> '{K.SURE}' OR abs(gain) < clv * 0.02)::INTEGER ab_test_recommended FROM c_best")
def cf_confidence(spark, d):
    return best(spark, d).select("customer_id", *R6("confidence_score"), "confidence", "ab_test_recommended")


DELTA = "(CASE WHEN gain >= 0 THEN '+' ELSE '-' END || format('{:,}', round_even(abs(gain), 0)::BIGINT) || '원')"


@query("cf_reason", f"""SELECT customer_id, CASE WHEN final_recommendation = '{K.ACTIONS[0][1]}' THEN '{K.REASON_NONE}'
 WHEN final_recommendation = '{K.ACTIONS[4][1]}' THEN '{K.REASON_WAIT[0]}' || printf('%.1f%%', churn_probability * 100) || '{K.REASON_WAIT[1]}' || printf('%.3f', uplift_score) || '{K.REASON_WAIT[2]}'
 ELSE final_recommendation || '{K.REASON_GAIN[0]}' || {DELTA} || '{K.REASON_GAIN[1]}' || CASE confidence WHEN '{K.WEAK}' THEN '{K.REASON_TAIL[K.WEAK]}' WHEN '{K.FAIR}' THEN '{K.REASON_TAIL[K.FAIR]}' ELSE '{K.REASON_TAIL[K.SURE]}' END END recommendation_reason FROM c_best""")
def cf_reason(spark, d):
    b = best(spark, d)
    return b.select("customer_id", K.reason(b).alias("recommendation_reason"))


@query("cf_summary", f"""SELECT final_recommendation, count(*) customers, round(avg(gain), 2) avg_gain, round(sum(gain), 2) total_gain, count(*) FILTER (gain > 0) positive,
 count(*) FILTER (confidence <> '{K.SURE}' OR abs(gain) < clv * 0.02) ab_tests, round(avg(score), 4) avg_confidence FROM c_best GROUP BY ROLLUP (final_recommendation)""")
def cf_summary(spark, d):
    """Counts and gains per best action; the row without an action is the total."""
    return best(spark, d).rollup("final_recommendation").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.avg("incremental_vs_no_action"), 2).alias("avg_gain"), F.round(F.sum("incremental_vs_no_action"), 2).alias("total_gain"),
        F.count_if(F.col("incremental_vs_no_action") > 0).alias("positive"), F.count_if(F.col("ab_test_recommended") == 1).alias("ab_tests"),
        F.round(F.avg("confidence_score"), 4).alias("avg_confidence"))
