"""Timing, segments, actions, budget and allocation."""

from pyspark.sql import functions as F

from winback import params
from winback.functions.scalars import minmax, ratio
from winback.operators import budget as B
from winback.operators import policy as P
from winback.plans import decision as D
from winback.plans.summary import customer_summary, survival_scores
from winback.registry.core import cte, query
from winback.registry.tables import mm

R6 = lambda *cols: [F.round(c, 6).alias(c) for c in cols]


def sql_map(values, key, default="NULL"):
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {default} END"


def timing_sql(base: str) -> str:
    w = "intervention_window_days"
    pick = lambda a, b, c, e: f"CASE WHEN {w} <= 14 THEN '{a}' WHEN {w} <= 30 THEN '{b}' WHEN {w} <= 60 THEN '{c}' ELSE '{e}' END"
    return f"""
SELECT *, {pick(*P.WINDOW_TEXTS, P.watch_text(90))} recommended_intervention_window,
  {pick('immediate', 'near_term', 'planned', 'monitor')} timing_priority_bucket
FROM (SELECT * EXCLUDE (u), round(u, 6) timing_urgency_score, round(0.85 + 0.60 * u, 6) churn_timing_weight,
  least(greatest(round_even(predicted_median_time_to_churn_days, 0)::INTEGER, 1), 90) intervention_window_days
FROM (SELECT b.*, predicted_hazard_ratio, predicted_median_time_to_churn_days, risk_percentile, risk_group,
  survival_prob_30d short_term_survival_probability, 1 - survival_prob_30d short_term_churn_probability,
  survival_prob_60d mid_term_survival_probability, 1 - survival_prob_60d mid_term_churn_probability,
  least(greatest(0.45 * risk_percentile + 0.35 * (1 - survival_prob_30d) + 0.20 * (1 - predicted_median_time_to_churn_days / 90), 0.0), 1.0) u
FROM {base} b JOIN c_survival USING (customer_id)))"""


def actions_sql(base: str, seg: str) -> str:
    """Heuristic effect of each intensity; base carries strategy_cost and coupon_cost is recomputed."""
    rows = ", ".join(f"('{k}', {v['cost_multiplier']}::DOUBLE, {v['base_effect'] * v['timing_weight']!r}::DOUBLE, {v['elasticity']}::DOUBLE, {v['discount_drag']}::DOUBLE)"
                     for k, v in P.INTENSITIES.items())
    bias = "CASE intervention_intensity " + " ".join(
        f"WHEN '{k}' THEN coalesce({sql_map({s: v[i] for s, v in P.SEGMENT_BIAS.items()}, seg)}, {sql_map({s: v[i] for s, v in P.UPLIFT_BIAS.items()}, 'uplift_segment')}, 1.0)::DOUBLE"
        for i, k in enumerate(P.INTENSITIES)) + " END"
    return f"""
SELECT *, greatest(expected_incremental_profit + coupon_cost, 0.0) expected_revenue,
  expected_incremental_profit / (CASE WHEN coupon_cost > 0 THEN coupon_cost ELSE 1.0 END) expected_roi
FROM (SELECT * EXCLUDE (ready, press, fit, e, el, dr), greatest(base_profit * churn_timing_weight * intensity_effect_multiplier - (coupon_cost - strategy_cost), -coupon_cost) expected_incremental_profit
FROM (SELECT *, least(greatest(e * segment_intensity_bias * fit * (1 + el * (ready - 0.5)) * fatigue_guardrail_multiplier, 0.30), 1.25) intensity_effect_multiplier
FROM (SELECT *, round(strategy_cost * cm, 2) coupon_cost, {bias} segment_intensity_bias,
  least(greatest(1 - dr * discount_norm, 0.55), 1.0) fatigue_guardrail_multiplier,
  CASE intervention_intensity WHEN 'low' THEN 0.86 + 0.18 * least(greatest(0.55 * aff + 0.45 * upl, 0.0), 1.0) + 0.08 * (1 - press)
   WHEN 'mid' THEN 0.94 + 0.12 * ready + 0.06 * press
   ELSE 0.72 + 0.18 * ready + 0.16 * press + 0.08 * aff + 0.06 * price - 0.14 * (1 - ready) END fit
FROM (SELECT *, least(greatest(0.38 * aff + 0.20 * price + 0.22 * upl + 0.20 * timing_urgency_score, 0.0), 1.0) ready,
  least(greatest(0.55 * timing_urgency_score + 0.25 * risk_percentile + 0.20 * (1 - window_rank_score), 0.0), 1.0) press
FROM (SELECT * EXCLUDE (coupon_cost, expected_incremental_profit, expected_roi), greatest(expected_incremental_profit, 0.0) base_profit, {mm('coupon_affinity')} aff, {mm('price_sensitivity')} price, {mm('uplift_score')} upl,
  {mm('intervention_window_days')} window_rank_score, {mm('discount_pressure_score')} discount_norm FROM {base})
CROSS JOIN (VALUES {rows}) v(intervention_intensity, cm, e, el, dr)))))"""


cte("c_budgetable", """
SELECT * EXCLUDE (expected_roi, expected_incremental_profit, uplift_score, coupon_cost, p, u, sc), p expected_incremental_profit, u uplift_score, sc strategy_cost, coupon_cost,
  CASE WHEN expected_roi > 0 THEN expected_roi ELSE coalesce(p / nullif(sc, 0), 0) END expected_roi
FROM (SELECT *, coalesce(CASE WHEN expected_incremental_profit > 0 THEN expected_incremental_profit END, CASE WHEN expected_roi > 0 THEN expected_roi * sc END, clv * u * greatest(churn_probability, 0.5)) p
FROM (SELECT *, greatest(coalesce(CASE WHEN uplift_score > 0 THEN uplift_score END, CASE WHEN expected_incremental_profit > 0 THEN expected_incremental_profit / clv END, 0.03), 0.001) u,
  greatest(coupon_cost, 1.0) sc FROM c_summary))""")
cte("c_timed_api", timing_sql("c_budgetable"))
cte("c_api_actions", actions_sql("c_timed_api", "''"))
cte("c_segments", """
SELECT * EXCLUDE (uplift_segment, us, cut, kind), us uplift_segment, (clv >= cut)::INTEGER is_high_value_top20pct,
  (tenure_days < 90 OR persona = 'new_signup')::INTEGER is_new_customer, greatest(uplift_score, 0.0) * clv retention_priority_score,
  CASE WHEN tenure_days < 90 OR persona = 'new_signup' THEN 'New Customers' ELSE (CASE WHEN clv >= cut THEN 'High Value-' ELSE 'Low Value-' END) || kind END customer_segment
FROM (SELECT *, CASE us WHEN 'Persuadables' THEN 'Persuadables' WHEN 'Sure Things' THEN 'Sure Things' ELSE 'Lost Causes' END kind FROM (
SELECT *, greatest(date_diff('day', signup_date::DATE, DATE '2000-12-31'), 0) tenure_days, (SELECT quantile_cont(clv, 0.8) FROM c_summary) cut,
  CASE WHEN uplift_score < 0 THEN 'Sleeping Dogs' WHEN uplift_score > 0.02 AND churn_probability >= 0.5 THEN 'Persuadables'
   WHEN churn_probability >= 0.5 THEN 'Lost Causes' ELSE 'Sure Things' END us FROM c_summary))""")
cte("c_strategy", f"""
SELECT *, {sql_map({k: v[0] for k, v in P.STRATEGIES.items()}, 'customer_segment')} strategy_name,
  {sql_map({k: v[1] for k, v in P.STRATEGIES.items()}, 'customer_segment')}::DOUBLE strategy_cost,
  greatest({sql_map({k: v[2] for k, v in P.STRATEGIES.items()}, 'customer_segment')}, 0.1)::DOUBLE strategy_effect_multiplier FROM c_segments""")
cte("c_timed_off", timing_sql("c_strategy"))
cte("c_off_effects", actions_sql("c_timed_off", "customer_segment"))
cte("c_off_actions", f"""
SELECT *, 0.55 * priority_score + 0.45 * opt selection_score FROM (
SELECT *, 0.26 * {mm('expected_roi')} + 0.24 * {mm('expected_incremental_profit')} + 0.14 * churn_probability + 0.10 * greatest(uplift_score, 0.0)
 + 0.12 * timing_urgency_score + 0.08 * (1 - window_rank_score) + 0.06 * {mm('clv')} - 0.08 * discount_norm priority_score, {mm('optimization_score')} opt
FROM (SELECT *, expected_incremental_profit / (CASE WHEN coupon_cost > 0 THEN coupon_cost ELSE 1.0 END) optimization_score FROM c_off_effects))""")
cte("c_off_pool", """
SELECT *, row_number() OVER (ORDER BY selection_score DESC, priority_score DESC, optimization_score DESC, timing_urgency_score DESC, expected_revenue DESC, retention_priority_score DESC, customer_id, coupon_cost) rn
FROM c_off_actions WHERE coupon_cost > 0 AND expected_revenue > 0 AND expected_incremental_profit > 0 AND uplift_segment <> 'Sleeping Dogs'""")
cte("c_pool", f"""
SELECT *, row_number() OVER (ORDER BY selection_score DESC, priority_score DESC, optimization_score DESC, timing_urgency_score DESC, expected_roi DESC,
  expected_incremental_profit DESC, intervention_window_days, coupon_cost, customer_id) rn
FROM (SELECT *, 0.55 * priority_score + 0.45 * optimization_rank_score selection_score FROM (
SELECT *, 0.18 * roi_rank_score + 0.18 * profit_rank_score + 0.14 * churn_probability + 0.10 * uplift_score + 0.10 * clv_rank_score
 + 0.12 * timing_rank_score + 0.08 * window_score + 0.10 * fit_rank_score priority_score
FROM (SELECT *, {mm('expected_roi')} roi_rank_score, {mm('expected_incremental_profit')} profit_rank_score, {mm('clv')} clv_rank_score,
 {mm('timing_urgency_score')} timing_rank_score, 1 - ({mm('intervention_window_days')}) window_score,
 {mm('intensity_effect_multiplier')} fit_rank_score, {mm('optimization_score')} optimization_rank_score
FROM (SELECT *, coalesce(expected_incremental_profit / nullif(coupon_cost, 0), 0.0) optimization_score FROM c_api_actions)
WHERE churn_probability >= 0.5 AND uplift_score > 0 AND expected_incremental_profit > 0 AND coupon_cost > 0 AND uplift_segment <> 'Sleeping Dogs')))""")


def walk_sql(pool: str, budgets: str, high_cap: str, cap: str = "1000000000") -> str:
    """The row-by-row walk, as a recursive statement that gives the picked rows per budget."""
    return f"""
WITH RECURSIVE w(budget, rn, spent, high, n, used, pick) AS (
  SELECT budget::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0::BIGINT, 0::BIGINT, []::BIGINT[], false FROM (SELECT unnest({budgets}) budget)
  UNION ALL
  SELECT budget, rn, CASE WHEN ok THEN spent + coupon_cost ELSE spent END, CASE WHEN ok AND hi THEN high + 1 ELSE high END,
    CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN list_append(used, customer_id) ELSE used END, ok
  FROM (SELECT w.budget, p.rn, spent, high, n, used, p.customer_id, p.coupon_cost, p.intervention_intensity = 'high' hi,
     NOT list_contains(used, p.customer_id) AND spent + p.coupon_cost <= w.budget AND n < {cap}
       AND (p.intervention_intensity <> 'high' OR high < {high_cap}) ok
   FROM w JOIN {pool} p ON p.rn = w.rn + 1)),
c_sel AS (SELECT w.budget, p.* FROM w JOIN {pool} p ON p.rn = w.rn WHERE pick)"""


OFF_CAP = "(SELECT greatest(1, floor(count(DISTINCT customer_id) * 0.35)) FROM c_off_pool)"
API_CAP = "(SELECT greatest(1, floor(count(*) * 0.35)) FROM c_pool)"
API_WALK = walk_sql("c_pool", "[5000000]", API_CAP)
SEL_COLS = ["customer_id", "intervention_intensity", "coupon_cost", "expected_incremental_profit", "expected_roi", "selection_score"]


@query("survival_timing", """SELECT customer_id, predicted_hazard_ratio, predicted_median_time_to_churn_days, round(risk_percentile, 6) risk_percentile, risk_group,
  round(short_term_churn_probability, 6) short_term_churn_probability, round(mid_term_churn_probability, 6) mid_term_churn_probability,
  timing_urgency_score, churn_timing_weight, intervention_window_days, recommended_intervention_window, timing_priority_bucket FROM c_timed_api""")
def survival_timing(spark, d):
    t = P.with_timing(customer_summary(spark, d).select("customer_id"), survival_scores(spark, d))
    return t.select("customer_id", "predicted_hazard_ratio", "predicted_median_time_to_churn_days", *R6("risk_percentile"), "risk_group",
                    *R6("short_term_churn_probability", "mid_term_churn_probability"), "timing_urgency_score", "churn_timing_weight",
                    "intervention_window_days", "recommended_intervention_window", "timing_priority_bucket")


@query("churn_timing_table", """SELECT customer_id, predicted_median_time_to_churn_days expected_days_to_churn, round(short_term_churn_probability, 6) churn_probability_30d,
  clv, round(clv * short_term_churn_probability, 2) expected_loss_30d,
  strftime(DATE '2000-12-31' + predicted_median_time_to_churn_days::INTEGER, '%Y-%m-%d') expected_churn_date,
  row_number() OVER (ORDER BY predicted_median_time_to_churn_days, clv * short_term_churn_probability DESC, clv DESC, customer_id) place FROM c_timed_api""")
def churn_timing_table(spark, d):
    from winback.functions.ranking import ordered_totals
    t = P.with_timing(customer_summary(spark, d).select("customer_id", "clv"), survival_scores(spark, d))
    t = t.select("customer_id", F.col("predicted_median_time_to_churn_days").alias("expected_days_to_churn"), "short_term_churn_probability",
                 "clv", (F.col("clv") * F.col("short_term_churn_probability")).alias("loss"))
    t = ordered_totals(t, [("expected_days_to_churn", False), ("loss", True), ("clv", True), ("customer_id", False)], {"place": F.lit(1)})
    day = F.date_add(F.lit(params.AS_OF_ORDERS).cast("date"), F.col("expected_days_to_churn").cast("int"))
    return t.select("customer_id", "expected_days_to_churn", F.round("short_term_churn_probability", 6).alias("churn_probability_30d"), "clv",
                    F.round("loss", 2).alias("expected_loss_30d"), F.date_format(day, "yyyy-MM-dd").alias("expected_churn_date"), "place")


@query("value_uplift_segment", "SELECT customer_id, tenure_days, is_high_value_top20pct, is_new_customer, uplift_segment, customer_segment, "
       "round(retention_priority_score, 2) retention_priority_score FROM c_segments")
def value_uplift_segment(spark, d):
    return D.segments(spark, d).select("customer_id", "tenure_days", "is_high_value_top20pct", "is_new_customer", "uplift_segment",
                                       "customer_segment", F.round("retention_priority_score", 2).alias("retention_priority_score"))


@query("segment_summary", """SELECT customer_segment segment_name, count(*) customer_count, round(avg(clv), 2) avg_clv, round(avg(churn_probability), 6) avg_churn_probability,
  round(avg(uplift_score), 6) avg_uplift, round(avg(retention_priority_score), 2) avg_priority_score,
  round(count(*) / (SELECT count(*) FROM c_segments), 6)::DOUBLE customer_ratio FROM c_segments GROUP BY 1""")
def segment_summary(spark, d):
    s = D.segments(spark, d)
    total = s.count()
    return s.groupBy(F.col("customer_segment").alias("segment_name")).agg(
        F.count(F.lit(1)).alias("customer_count"), F.round(F.avg("clv"), 2).alias("avg_clv"),
        F.round(F.avg("churn_probability"), 6).alias("avg_churn_probability"), F.round(F.avg("uplift_score"), 6).alias("avg_uplift"),
        F.round(F.avg("retention_priority_score"), 2).alias("avg_priority_score"),
        F.round(F.count(F.lit(1)) / F.lit(total), 6).alias("customer_ratio"))


@query("strategy_map", "SELECT customer_id, customer_segment, strategy_name, strategy_cost, strategy_effect_multiplier FROM c_strategy")
def strategy_map(spark, d):
    return P.with_strategy(D.segments(spark, d)).select("customer_id", "customer_segment", "strategy_name", "strategy_cost", "strategy_effect_multiplier")


@query("budgetable_fill", """SELECT customer_id, churn_probability, clv, round(uplift_score, 6) uplift_score, strategy_cost, coupon_cost,
  round(expected_incremental_profit, 6) expected_incremental_profit, round(expected_roi, 6) expected_roi, uplift_segment FROM c_budgetable""")
def budgetable_fill(spark, d):
    return P.budgetable(customer_summary(spark, d)).select(
        "customer_id", "churn_probability", "clv", *R6("uplift_score"), "strategy_cost", "coupon_cost",
        *R6("expected_incremental_profit", "expected_roi"), "uplift_segment")


@query("action_candidates", """SELECT customer_id || '::' || intervention_intensity action_id, customer_id, intervention_intensity, coupon_cost,
  round(expected_revenue, 2) expected_revenue, round(expected_incremental_profit, 2) expected_incremental_profit, round(expected_roi, 6) expected_roi,
  round(priority_score, 6) priority_score, round(selection_score, 6) selection_score FROM c_off_actions""")
def action_candidates(spark, d):
    return D.offline_actions(spark, d).select(
        "action_id", "customer_id", "intervention_intensity", "coupon_cost", F.round("expected_revenue", 2).alias("expected_revenue"),
        F.round("expected_incremental_profit", 2).alias("expected_incremental_profit"), *R6("expected_roi", "priority_score", "selection_score"))


@query("effect_heuristic", """SELECT customer_id, intervention_intensity, segment_intensity_bias, round(fatigue_guardrail_multiplier, 6) fatigue_guardrail_multiplier,
  round(intensity_effect_multiplier, 6) intensity_effect_multiplier FROM c_off_effects""")
def effect_heuristic(spark, d):
    return D.offline_actions(spark, d).select("customer_id", "intervention_intensity", "segment_intensity_bias",
                                              *R6("fatigue_guardrail_multiplier", "intensity_effect_multiplier"))


@query("effect_learned", f"""SELECT customer_id, intervention_intensity, round(eff, 6) dose_response_incremental_effect,
  round(least(greatest(abs(eff) / greatest(abs(uplift_score), 0.02), 0.20), 2.50), 6) intensity_effect_multiplier,
  round(greatest(greatest(eff * strategy_effect_multiplier * clv * churn_timing_weight, 0.0) * least(greatest(1 - 0.18 * discount_norm, 0.55), 1.0) - coupon_cost, -coupon_cost), 2) expected_incremental_profit
FROM (SELECT *, least(greatest(uplift_score * (CASE intervention_intensity WHEN 'low' THEN 0.8 WHEN 'mid' THEN 1.0 ELSE 1.15 END)::DOUBLE, -0.35), 0.75) eff FROM c_off_effects)""")
def effect_learned(spark, d):
    """Learned-effect economics with the per-arm effect read off the uplift score (arm prior 0.8 / 1.0 / 1.15)."""
    base = P.action_base(P.with_strategy(D.segments(spark, d)), survival_scores(spark, d))
    kind = F.col("intervention_intensity")
    effect = F.col("uplift_score") * F.when(kind == "low", 0.8).when(kind == "mid", 1.0).otherwise(1.15)
    return P.learned_effect(P.explode_intensities(base), effect).select(
        "customer_id", "intervention_intensity", *R6("dose_response_incremental_effect", "intensity_effect_multiplier"),
        F.round("expected_incremental_profit", 2).alias("expected_incremental_profit"))


@query("minmax_norm", f"""SELECT customer_id, round({mm('clv')}, 6) clv_norm, round({mm('uplift_score')}, 6) uplift_norm,
  round({mm('frequency')}, 6) frequency_norm FROM c_summary""")
def minmax_norm(spark, d):
    s = customer_summary(spark, d)
    m = minmax(s, "clv", "uplift_score", "frequency")
    return s.select("customer_id", F.round(m["clv"], 6).alias("clv_norm"), F.round(m["uplift_score"], 6).alias("uplift_norm"),
                    F.round(m["frequency"], 6).alias("frequency_norm"))


@query("candidate_pool", """SELECT rn place, customer_id, intervention_intensity, coupon_cost, round(expected_incremental_profit, 2) expected_incremental_profit,
  round(priority_score, 6) priority_score, round(selection_score, 6) selection_score FROM c_pool""")
def candidate_pool(spark, d):
    return D.pool(spark, d).select("place", "customer_id", "intervention_intensity", "coupon_cost",
                                   F.round("expected_incremental_profit", 2).alias("expected_incremental_profit"),
                                   *R6("priority_score", "selection_score"))


def _selected_cols(df):
    return df.select("customer_id", "intervention_intensity", "coupon_cost", F.round("expected_incremental_profit", 2).alias("expected_incremental_profit"),
                     *R6("expected_roi", "selection_score"))


SQL_SEL = ("SELECT customer_id, intervention_intensity, coupon_cost, round(expected_incremental_profit, 2) expected_incremental_profit, "
           "round(expected_roi, 6) expected_roi, round(selection_score, 6) selection_score FROM c_sel")


@query("greedy_budget", f"{API_WALK} {SQL_SEL}")
def greedy_budget(spark, d):
    return _selected_cols(D.selected_once(spark, d))


@query("greedy_budget_capped", walk_sql("c_pool", "[5000000]", "35", "100") + SQL_SEL)
def greedy_budget_capped(spark, d):
    """The same walk with at most 100 customers, and 35 % of them on high intensity."""
    return _selected_cols(D.selected(spark, d, customer_cap=100))


@query("greedy_budget_offline", walk_sql("c_off_pool", "[5000000]", OFF_CAP) + SQL_SEL)
def greedy_budget_offline(spark, d):
    return _selected_cols(D.offline_selected(spark, d, [params.BUDGET]))


@query("greedy_prefix", "SELECT customer_id, rn place, coupon_cost, round(c, 2) running_cost FROM (SELECT *, sum(coupon_cost) OVER (ORDER BY rn) c FROM c_pool) WHERE c <= 5000000")
def greedy_prefix(spark, d):
    kept = B.within_budget(D.pool(spark, d), [("place", False)], params.BUDGET)
    return kept.select("customer_id", "place", "coupon_cost", F.round("running_cost", 2).alias("running_cost"))


cte("c_base_pool", f"""SELECT *, 'none' intervention_intensity, row_number() OVER (ORDER BY s DESC, expected_roi DESC, expected_incremental_profit DESC, churn_probability DESC, clv DESC, customer_id) rn
 FROM (SELECT *, 0.40 * {mm('expected_roi')} + 0.25 * {mm('expected_incremental_profit')} + 0.15 * churn_probability + 0.10 * {mm('uplift_score')} + 0.10 * {mm('clv')} s
 FROM c_summary WHERE churn_probability >= 0.5 AND uplift_score > 0 AND coupon_cost > 0 AND expected_incremental_profit > 0)""")


def _baseline(spark, d):
    ranked = B.rank_pool(P.baseline_pool(customer_summary(spark, d), params.RISK_THRESHOLD), P.BASELINE_ORDER)
    return B.greedy(ranked, [params.BUDGET])


@query("baseline_engine", walk_sql("c_base_pool", "[5000000]", "1000000000")
       + "SELECT customer_id, coupon_cost, round(s, 6) baseline_priority_score, expected_incremental_profit FROM c_sel")
def baseline_engine(spark, d):
    return _baseline(spark, d).select("customer_id", "coupon_cost", *R6("baseline_priority_score"), "expected_incremental_profit")


_W2 = walk_sql("c_base_pool", "[5000000]", "1000000000").replace("WITH RECURSIVE w(", ", w2(").replace("FROM w JOIN", "FROM w2 w JOIN").replace("c_sel AS", "c_sel2 AS")
_ENG = ", 1 uses_churn, 1 uses_uplift, 1 uses_value, {t} uses_timing, {t} uses_intensity"


@query("engine_compare_factors", f"""{API_WALK}{_W2} SELECT 'baseline' engine, count(*) targeted, round(sum(coupon_cost), 2) spent, round(sum(expected_incremental_profit), 2) profit{_ENG.format(t=0)} FROM c_sel2
UNION ALL SELECT 'enhanced', count(*), round(sum(coupon_cost), 2), round(sum(expected_incremental_profit), 2){_ENG.format(t=1)} FROM c_sel""")
def engine_compare_factors(spark, d):
    """Totals of the older and the current engine, with the factors each of them weighs."""
    new = D.selected_once(spark, d)
    pick = lambda df, name, timing: df.agg(
        F.lit(name).alias("engine"), F.count(F.lit(1)).alias("targeted"), F.round(F.sum("coupon_cost"), 2).alias("spent"),
        F.round(F.sum("expected_incremental_profit"), 2).alias("profit"), F.lit(1).alias("uses_churn"), F.lit(1).alias("uses_uplift"),
        F.lit(1).alias("uses_value"), F.lit(timing).alias("uses_timing"), F.lit(timing).alias("uses_intensity"))
    return pick(_baseline(spark, d), "baseline", 0).unionByName(pick(new, "enhanced", 1))


SEG_GRID = """, g AS (SELECT uplift_segment, intervention_intensity FROM (SELECT DISTINCT uplift_segment FROM c_summary) CROSS JOIN (VALUES ('low'), ('mid'), ('high')) v(intervention_intensity))
SELECT uplift_segment, intervention_intensity, count(DISTINCT customer_id) customer_count, round(coalesce(sum(coupon_cost), 0.0), 2) allocated_budget,
  round(coalesce(sum(expected_revenue), 0.0), 2) expected_revenue, round(coalesce(sum(expected_incremental_profit), 0.0), 2) expected_profit,
  round(coalesce((sum(expected_revenue) - sum(coupon_cost)) / nullif(sum(coupon_cost), 0), 0.0), 6)::DOUBLE expected_roi
FROM g LEFT JOIN c_sel USING (uplift_segment, intervention_intensity) GROUP BY 1, 2"""


@query("segment_allocation", API_WALK + SEG_GRID)
def segment_allocation(spark, d):
    return B.allocation_grid(D.selected_once(spark, d), customer_summary(spark, d), "uplift_segment")


@query("allocation_rollup", API_WALK + """SELECT uplift_segment, intervention_intensity, count(DISTINCT customer_id) customer_count, round(sum(coupon_cost), 2) allocated_budget,
  round(sum(expected_incremental_profit), 2) expected_profit FROM c_sel GROUP BY ROLLUP (uplift_segment, intervention_intensity) HAVING uplift_segment IS NOT NULL""")
def allocation_rollup(spark, d):
    return B.allocation_rollup(D.selected_once(spark, d), "uplift_segment")


@query("budget_what_if", walk_sql("c_off_pool", "[2500000, 5000000, 10000000]", OFF_CAP) + """
SELECT CASE budget WHEN 2500000 THEN '50%' WHEN 5000000 THEN '100%' ELSE '200%' END scenario, budget, round(sum(coupon_cost), 2) spent, round(budget - sum(coupon_cost), 2) remaining,
  count(*) num_targeted, round(sum(expected_revenue), 2) expected_revenue, round((sum(expected_revenue) - sum(coupon_cost)) / sum(coupon_cost), 6) expected_roi FROM c_sel GROUP BY budget""")
def budget_what_if(spark, d):
    plan = {"50%": params.BUDGET // 2, "100%": params.BUDGET, "200%": params.BUDGET * 2}
    return B.scenario_totals(D.offline_selected(spark, d, list(plan.values())), plan)


GRID = B.budget_grid(params.BUDGET)
SENS = walk_sql("c_pool", str([b for b in GRID if b]), API_CAP) + f""",
t AS (SELECT g.budget, round(coalesce(sum(coupon_cost), 0.0), 4) c, round(coalesce(sum(expected_incremental_profit), 0.0), 4) p, count(DISTINCT customer_id) n
  FROM (SELECT unnest({GRID})::BIGINT budget) g LEFT JOIN c_sel USING (budget) GROUP BY 1),
u AS (SELECT *, CASE WHEN c > 0 THEN p / c ELSE 0.0 END roi FROM t),
v AS (SELECT *, budget - lag(budget) OVER o db, c - lag(c) OVER o dc, p - lag(p) OVER o dp, n - lag(n) OVER o dn, lag(roi) OVER o roi0 FROM u WINDOW o AS (ORDER BY budget)),
s AS (SELECT budget, round(c, 2) spent, round(greatest(budget - c, 0.0), 2) remaining, n target_count, round(p, 2) expected_incremental_profit, round(roi, 6) average_roi,
  coalesce(dn, 0) added_target_count, round(coalesce(dp, 0.0), 2) added_profit, round(coalesce(dp * 1000000 / db, 0.0), 2) marginal_profit_per_1m,
  round(CASE WHEN dc > 0 THEN dp / dc ELSE 0.0 END, 6) marginal_roi,
  CASE WHEN db IS NULL THEN '{B.STATUS_TEXTS['start']}' WHEN round(dp, 6) <= 0 AND dn <= 0 THEN '{B.STATUS_TEXTS['saturated']}'
   WHEN (CASE WHEN dc > 0 THEN dp / dc ELSE 0.0 END) < 0.2 THEN '{B.STATUS_TEXTS['weak']}' WHEN roi < roi0 THEN '{B.STATUS_TEXTS['falling']}'
   WHEN (CASE WHEN dc > 0 THEN dp / dc ELSE 0.0 END) >= roi THEN '{B.STATUS_TEXTS['grow']}' ELSE '{B.STATUS_TEXTS['steady']}' END budget_status FROM v)
"""


def _sensitivity(spark, d):
    return B.sensitivity(D.selected(spark, d, [b for b in GRID if b]), GRID)


@query("budget_sensitivity", SENS + "SELECT * FROM s")
def budget_sensitivity(spark, d):
    return _sensitivity(spark, d)


@query("budget_sensitivity_points", SENS + """, e AS (SELECT greatest(max(marginal_profit_per_1m) * 0.15, 0.0) edge FROM s)
SELECT max(spent) FILTER (budget = 5000000) current_spent, max(target_count) FILTER (budget = 5000000) current_target_count,
  max(average_roi) FILTER (budget = 5000000) current_average_roi, max(added_profit) FILTER (budget = 6000000) next_step_profit_gain,
  coalesce(min(budget) FILTER (budget > 0 AND marginal_profit_per_1m <= edge AND added_target_count <= 0), min(budget) FILTER (budget > 0 AND marginal_profit_per_1m <= edge)) saturation_budget,
  min(budget) FILTER (budget > 0 AND (marginal_roi < 0.2 OR marginal_profit_per_1m <= 0)) low_efficiency_budget FROM s, e""")
def budget_sensitivity_points(spark, d):
    from winback.sources.staging import cut
    return B.sensitivity_points(cut(_sensitivity(spark, d), "sensitivity"), params.BUDGET)


@query("budget_summary", API_WALK + """SELECT 5000000 budget, round(sum(coupon_cost), 2) spent, round(5000000 - sum(coupon_cost), 2) remaining, count(*) num_targeted,
  (SELECT count(DISTINCT customer_id) FROM c_pool) candidate_customers, (SELECT count(*) FROM c_pool) candidate_actions, (sum(coupon_cost) >= 4900000)::INTEGER budget_binding,
  round(sum(expected_incremental_profit), 2) expected_incremental_profit, round(sum(expected_incremental_profit) / sum(coupon_cost), 6) overall_roi,
  count(*) FILTER (intervention_intensity = 'low') low_count, count(*) FILTER (intervention_intensity = 'mid') mid_count, count(*) FILTER (intervention_intensity = 'high') high_count,
  round(avg(discount_pressure_score), 6) avg_selected_discount_pressure, round(avg(fatigue_guardrail_multiplier), 6) avg_selected_fatigue_guardrail_multiplier FROM c_sel""")
def budget_summary(spark, d):
    return B.selection_summary(D.selected_once(spark, d), D.pool(spark, d), params.BUDGET)


@query("intensity_mix", API_WALK + """SELECT i intervention_intensity, count(customer_id) customer_count, round(count(customer_id) / greatest((SELECT count(*) FROM c_sel), 1), 6)::DOUBLE share
 FROM (VALUES ('low'), ('mid'), ('high')) v(i) LEFT JOIN c_sel ON intervention_intensity = i GROUP BY 1""")
def intensity_mix(spark, d):
    s = D.selected_once(spark, d)
    counts = s.agg(*[F.count_if(F.col("intervention_intensity") == k).alias(k) for k in B.INTENSITY_NAMES], F.count(F.lit(1)).alias("n"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("intervention_intensity"), F.col(k).alias("customer_count"),
                                                      F.round(ratio(F.col(k), F.col("n")), 6).alias("share")) for k in B.INTENSITY_NAMES])).alias("r")).select("r.*")
