"""Experiments, audit and reporting queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winback import params
from winback.functions.ranking import ordered_totals, quantile_values
from winback.functions.scalars import ratio, scalars
from winback.operators import experiment as E
from winback.plans import decision as D
from winback.plans.summary import customer_summary, survival_scores
from winback.registry.core import cte, query
from winback.registry.q_decide import API_WALK, R6
from winback.registry.q_features import snapshots
from winback.registry.tables import rank_pct, unit
from winback.sources import adapters as A
from winback.sources.staging import staged

WALK = API_WALK.strip()
cte("c_out", """SELECT a.*, count(order_id) orders_post, coalesce(sum(net_amount), 0.0) revenue_post, (count(order_id) > 0)::INTEGER retained FROM c_assign a
LEFT JOIN (SELECT customer_id cid, order_id, order_time, net_amount FROM c_orders) o ON cid = customer_id AND date_diff('day', assigned_at::DATE, order_time::DATE) BETWEEN 0 AND 60 GROUP BY ALL""")
cte("c_arm", """SELECT max(n) FILTER (treatment_flag = 1)::DOUBLE nt, max(n) FILTER (treatment_flag = 0)::DOUBLE nc, max(k) FILTER (treatment_flag = 1)::DOUBLE kt, max(k) FILTER (treatment_flag = 0)::DOUBLE kc,
 max(c) FILTER (treatment_flag = 1) ct, max(r) FILTER (treatment_flag = 1) rt, max(r) FILTER (treatment_flag = 0) rc
FROM (SELECT treatment_flag, count(*) n, sum(retained) k, sum(coupon_cost) c, avg(revenue_post) r FROM c_out GROUP BY 1)""")
cte("c_rates", "SELECT *, (nt - kt) / nt pt, (nc - kc) / nc pc, (nt - kt + nc - kc) / (nt + nc) pool FROM c_arm")


def outcomes(spark, d):
    return staged(spark, d, "outcomes", lambda: E.outcomes(A.assignments(spark, d), A.orders(spark, d)))


def arms(spark, d):
    a = E.arms(outcomes(spark, d))
    return a["treatment"], a["control"]


def row(spark, values: dict, digits: int = 6) -> DataFrame:
    kinds = {k: ("long" if isinstance(v, int) else "double") for k, v in values.items()}
    return spark.createDataFrame([tuple(v if v is None or isinstance(v, int) else round(v, digits) for v in values.values())],
                                 ", ".join(f"{k} {t}" for k, t in kinds.items()))


@query("post_window_outcome", "SELECT customer_id, treatment_group, orders_post, round(revenue_post, 4) revenue_post, retained FROM c_out")
def post_window_outcome(spark, d):
    return outcomes(spark, d).select("customer_id", "treatment_group", "orders_post", F.round("revenue_post", 4).alias("revenue_post"), "retained")


@query("ab_two_proportion", """SELECT round(pt, 6) treatment_rate, round(pc, 6) control_rate, round(pt - pc, 6) difference, round((pt - pc) / sqrt(greatest(pool * (1 - pool) * (1 / nt + 1 / nc), 1e-12)), 6) z_stat,
 round(pt - pc - 1.96 * sqrt(greatest(pt * (1 - pt) / nt + pc * (1 - pc) / nc, 1e-12)), 6) ci_low, round(pt - pc + 1.96 * sqrt(greatest(pt * (1 - pt) / nt + pc * (1 - pc) / nc, 1e-12)), 6) ci_high FROM c_rates""")
def ab_two_proportion(spark, d):
    """Churn share of treated and control."""
    t, c = arms(spark, d)
    got = E.two_proportion(t["n"] - t["kept"], t["n"], c["n"] - c["kept"], c["n"])
    got.pop("p_value")
    return row(spark, got)


def phi(z):
    """Normal distribution function by Simpson's rule: DuckDB has no error function."""
    step = f"(({z}) / 2000)"
    return (f"(0.5 + {step} / 3 * (SELECT sum((CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(i * {step}, 2) / 2)) FROM (SELECT unnest(range(2001)) i)) / sqrt(2 * pi()))")


_Z = "abs((pt - pc) / sqrt(greatest(pool * (1 - pool) * (1 / nt + 1 / nc), 1e-12)))"
_CHI = """(SELECT sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) FROM (SELECT unnest([nt - kt, kt, nc - kc, kc]) o, unnest([nt * pool, nt * (1 - pool), nc * pool, nc * (1 - pool)]) e FROM c_rates))"""
_SE0 = "sqrt(greatest((pt + pc) / 2 * (1 - (pt + pc) / 2) * (1 / nt + 1 / nc), 1e-12))"
_SE1 = "sqrt(greatest(pt * (1 - pt) / nt + pc * (1 - pc) / nc, 1e-12))"


@query("ab_p_values", f"SELECT round(2 * (1 - {phi('z')}), 6) z_p_value, round(2 * (1 - {phi('c')}), 6) chi_p_value FROM (SELECT {_Z} z, sqrt({_CHI}) c FROM c_rates)")
def ab_p_values(spark, d):
    t, c = arms(spark, d)
    x = (t["n"] - t["kept"], t["n"], c["n"] - c["kept"], c["n"])
    return row(spark, {"z_p_value": E.two_proportion(*x)["p_value"], "chi_p_value": E.chi_square(*x)["p_value"]})


@query("ab_chi_square", """SELECT round(sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e), 6) chi2 FROM (
 SELECT unnest([nt - kt, kt, nc - kc, kc]) o, unnest([nt * pool, nt * (1 - pool), nc * pool, nc * (1 - pool)]) e FROM c_rates)""")
def ab_chi_square(spark, d):
    t, c = arms(spark, d)
    return row(spark, {"chi2": E.chi_square(t["n"] - t["kept"], t["n"], c["n"] - c["kept"], c["n"])["chi2"]})


@query("ab_power", """SELECT ceil(pow(1.959963984540054::DOUBLE * sqrt(2 * (pt + pc) / 2 * (1 - (pt + pc) / 2)) + 0.8416212335729143::DOUBLE * sqrt(pc * (1 - pc) + pt * (1 - pt)), 2) / greatest(pow(pt - pc, 2), 1e-9))::BIGINT required_n,
 round((1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE) * sqrt(2 * pc * (1 - pc) / least(nt, nc)), 6) mde FROM c_rates""")
def ab_power(spark, d):
    t, c = arms(spark, d)
    got = E.power(1 - c["kept"] / c["n"], 1 - t["kept"] / t["n"], c["n"], t["n"])
    return row(spark, {"required_n": got["required_n"], "mde": got["mde"]})


@query("ab_achieved_power", f"SELECT round({phi('a')} + 1 - {phi('b')}, 6) achieved_power FROM (SELECT (-1.959963984540054::DOUBLE * {_SE0} - abs(pt - pc)) / {_SE1} a, (1.959963984540054::DOUBLE * {_SE0} - abs(pt - pc)) / {_SE1} b FROM c_rates)")
def ab_achieved_power(spark, d):
    t, c = arms(spark, d)
    return row(spark, {"achieved_power": E.power(1 - c["kept"] / c["n"], 1 - t["kept"] / t["n"], c["n"], t["n"])["achieved_power"]})


@query("ab_business", """SELECT round(kt / nt - kc / nc, 6) retention_lift, round((kt / nt - kc / nc) * nt, 4) incremental_customers, round(ct, 2) cost_total,
 CASE WHEN kt / nt - kc / nc > 0 THEN round(ct / ((kt / nt - kc / nc) * nt), 2) END cost_per_incremental, round((rt - rc) * nt, 2) incremental_revenue,
 round((rt - rc) * nt - ct, 2) incremental_profit, round(((rt - rc) * nt - ct) / ct, 6) incremental_roi FROM c_arm""")
def ab_business(spark, d):
    t, c = arms(spark, d)
    b = E.business(t, c)
    digits = {"retention_lift": 6, "incremental_customers": 4, "incremental_roi": 6}
    return row(spark, {k: None if v is None else round(v, digits.get(k, 2)) for k, v in b.items()})


@query("experiment_overview", """SELECT nt::BIGINT treatment_n, nc::BIGINT control_n, round(kt / nt - kc / nc, 6) incremental_retention, round((SELECT sum(coupon_cost) FROM c_exposures), 2) coupon_spend_total,
 round((rt - rc) * nt, 2) incremental_revenue, """ + ", ".join(f"(SELECT round(avg(retained) FILTER (dose_intensity = '{a}') - avg(retained) FILTER (dose_intensity = 'control'), 6) FROM c_dose) {a}_dose_effect" for a in ("low", "mid", "high")) + " FROM c_arm")
def experiment_overview(spark, d):
    from winback.registry.q_models import dose
    t, c = arms(spark, d)
    spend = scalars(A.exposures(spark, d), s=F.sum("coupon_cost"))["s"]
    b = E.business(t, c)
    mean = lambda k: F.avg(F.when(F.col("dose_intensity") == k, F.col("retained")))
    effects = scalars(dose(spark, d), **{f"{k}_dose_effect": F.round(mean(k) - mean("control"), 6) for k in ("low", "mid", "high")})
    return row(spark, {"treatment_n": t["n"], "control_n": c["n"], "incremental_retention": b["retention_lift"], "coupon_spend_total": round(spend, 2),
                       "incremental_revenue": round(b["incremental_revenue"], 2), **effects})


@query("treatment_assign", f"""SELECT customer_id, persona, uplift_segment, (row_number() OVER (PARTITION BY persona, uplift_segment ORDER BY {unit('customer_id', 4177)}, customer_id)
 <= round_even(count(*) OVER (PARTITION BY persona, uplift_segment) * 0.5::DOUBLE, 0))::INTEGER treatment_flag FROM c_summary""")
def treatment_assign(spark, d):
    return E.assign(customer_summary(spark, d).select("customer_id", "persona", "uplift_segment"), ["persona", "uplift_segment"])


BAL = ["price_sensitivity", "coupon_affinity", "support_contact_propensity", "monetary"]
cte("c_bal", "SELECT s.*, treatment_flag FROM c_summary s JOIN (SELECT customer_id, treatment_flag FROM c_assign) USING (customer_id)")


@query("smd_balance", " UNION ALL ".join(f"""SELECT '{x}' covariate, round(s, 6) smd, (abs(s) > 0.1)::INTEGER unbalanced FROM (SELECT (avg({x}) FILTER (treatment_flag = 1) - avg({x}) FILTER (treatment_flag = 0))
 / sqrt((var_samp({x}) FILTER (treatment_flag = 1) + var_samp({x}) FILTER (treatment_flag = 0)) / 2) s FROM c_bal)""" for x in BAL))
def smd_balance(spark, d):
    j = customer_summary(spark, d).join(A.assignments(spark, d).select("customer_id", "treatment_flag"), "customer_id")
    return E.balance(j, BAL)


STEPS = {"visit": ["visit"], "browse": ["page_view", "search"], "support": ["support_contact"], "purchase": ["purchase"]}


@query("reach_funnel", " UNION ALL ".join(f"""SELECT '{k}' step, count(DISTINCT customer_id) users, round(count(DISTINCT customer_id) / (SELECT count(*) FROM c_customers), 6)::DOUBLE user_rate
 FROM c_events WHERE event_type IN ({', '.join(repr(x) for x in v)})""" for k, v in STEPS.items()))
def reach_funnel(spark, d):
    """Users per step: events are first folded to customer and type, so the distinct count runs on that."""
    total = A.customers(spark, d).count()
    pairs = A.events(spark, d).select("customer_id", "event_type").distinct()
    per = pairs.groupBy("customer_id").agg(*[F.max(F.col("event_type").isin(*v).cast("int")).alias(k) for k, v in STEPS.items()])
    sums = per.agg(*[F.sum(k).alias(k) for k in STEPS])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(k).alias("users"), F.round(F.col(k) / F.lit(total), 6).alias("user_rate")) for k in STEPS])).alias("r")).select("r.*")


@query("spearman_alignment", f"""SELECT round(corr(a, b), 6) churn_vs_inactivity, round(corr(c, e), 6) exposure_vs_fatigue FROM (SELECT {rank_pct('churn_probability')} a, {rank_pct('inactivity_days')} b, {rank_pct('exposure_count')} c, {rank_pct('coupon_fatigue_score')} e FROM c_summary)""")
def spearman_alignment(spark, d):
    s = customer_summary(spark, d)
    a = E.spearman(s, "churn_probability", "inactivity_days").first()[0]
    b = E.spearman(s, "exposure_count", "coupon_fatigue_score").first()[0]
    return row(spark, {"churn_vs_inactivity": a, "exposure_vs_fatigue": b})


@query("top_decile_lift", """SELECT round(avg((inactivity_days >= 30)::INTEGER) FILTER (churn_probability >= (SELECT quantile_cont(churn_probability, 0.9) FROM c_summary)), 6) top_decile_churn, round(avg((inactivity_days >= 30)::INTEGER), 6) overall_churn FROM c_summary""")
def top_decile_lift(spark, d):
    got = E.decile_lift(customer_summary(spark, d), "churn_probability", F.col("inactivity_days") >= 30)
    return row(spark, {"top_decile_churn": got["top"], "overall_churn": got["overall"]})


@query("churn_status", "SELECT count(*) total_customers, count(*) FILTER (churn_probability >= 0.5) at_risk_customers, round(count(*) FILTER (churn_probability >= 0.5) / count(*), 6)::DOUBLE risk_rate, round(avg(churn_probability), 6) avg_churn_prob FROM c_summary")
def churn_status(spark, d):
    risk = F.count_if(F.col("churn_probability") >= params.RISK_THRESHOLD)
    return customer_summary(spark, d).agg(F.count(F.lit(1)).alias("total_customers"), risk.alias("at_risk_customers"),
                                          F.round(risk / F.count(F.lit(1)), 6).alias("risk_rate"), F.round(F.avg("churn_probability"), 6).alias("avg_churn_prob"))


@query("churn_risk_list", "SELECT customer_id, round(churn_probability, 6) churn_probability, clv FROM c_summary WHERE churn_probability >= 0.5 ORDER BY churn_probability DESC, clv DESC")
def churn_risk_list(spark, d):
    return customer_summary(spark, d).where(F.col("churn_probability") >= params.RISK_THRESHOLD).orderBy(F.desc("churn_probability"), F.desc("clv")).select(
        "customer_id", *R6("churn_probability"), "clv")


@query("top_value", "SELECT customer_id, round(clv * uplift_score, 4) value_score FROM c_summary ORDER BY clv * uplift_score DESC, clv DESC, customer_id LIMIT 100")
def top_value(spark, d):
    s = customer_summary(spark, d).withColumn("v", F.col("clv") * F.col("uplift_score"))
    return s.orderBy(F.desc("v"), F.desc("clv"), "customer_id").limit(100).select("customer_id", F.round("v", 4).alias("value_score"))


@query("retention_targets", """WITH t AS (SELECT * FROM c_summary WHERE churn_probability >= 0.5 AND uplift_score > 0.08 AND clv > (SELECT median(clv) FROM c_summary) AND uplift_segment <> 'Sleeping Dogs')
SELECT customer_id, round(0.45 * churn_probability + 0.25 * uplift_score + 0.30 * clv / (SELECT greatest(max(clv), 1.0) FROM t), 6) priority_score FROM t""")
def retention_targets(spark, d):
    s = customer_summary(spark, d)
    med = quantile_values(s, "clv", [0.5])[0]
    t = s.where((F.col("churn_probability") >= params.RISK_THRESHOLD) & (F.col("uplift_score") > 0.08) & (F.col("clv") > med) & (F.col("uplift_segment") != "Sleeping Dogs"))
    top = max(scalars(t, m=F.max("clv"))["m"] or 1.0, 1.0)
    return t.select("customer_id", F.round(0.45 * F.col("churn_probability") + 0.25 * F.col("uplift_score") + 0.30 * F.col("clv") / top, 6).alias("priority_score"))


@query("distribution", "SELECT 'persona' AS dimension, persona AS name, count(*) AS n, round(count(*) / (SELECT count(*) FROM c_summary), 6)::DOUBLE AS share FROM c_summary GROUP BY 2 UNION ALL SELECT 'region', region, count(*), round(count(*) / (SELECT count(*) FROM c_summary), 6)::DOUBLE FROM c_summary GROUP BY 2 UNION ALL SELECT 'uplift_segment', uplift_segment, count(*), round(count(*) / (SELECT count(*) FROM c_summary), 6)::DOUBLE FROM c_summary GROUP BY 2")
def distribution(spark, d):
    s = customer_summary(spark, d)
    total = s.count()
    dims = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c), F.lit("Unknown")).alias("name")) for c in ("persona", "region", "uplift_segment")])).alias("x")
    return s.select(dims).groupBy("x.dimension", "x.name").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / F.lit(total), 6))


@query("customer_page", "SELECT customer_id, persona, clv FROM c_summary WHERE persona = 'BUILDING' AND churn_probability >= 0.3 ORDER BY clv DESC, customer_id LIMIT 50 OFFSET 20")
def customer_page(spark, d):
    """Second page of a filtered, sorted list."""
    s = customer_summary(spark, d).where((F.col("persona") == "BUILDING") & (F.col("churn_probability") >= 0.3))
    return s.orderBy(F.desc("clv"), "customer_id").offset(20).limit(50).select("customer_id", "persona", "clv")


@query("dashboard_summary", f"""{WALK} SELECT (SELECT count(*) FROM c_summary) total_customers, (SELECT count(*) FROM c_summary WHERE churn_probability >= 0.5) at_risk_customers, (SELECT round(avg(churn_probability), 6) FROM c_summary) avg_churn_prob,
 count(*) targeted, round(sum(coupon_cost), 2) spent, round(sum(expected_incremental_profit), 2) expected_profit FROM c_sel""")
def dashboard_summary(spark, d):
    a = customer_summary(spark, d).agg(F.count(F.lit(1)).alias("total_customers"), F.count_if(F.col("churn_probability") >= 0.5).alias("at_risk_customers"),
                                       F.round(F.avg("churn_probability"), 6).alias("avg_churn_prob"))
    b = D.selected_once(spark, d).agg(F.count(F.lit(1)).alias("targeted"), F.round(F.sum("coupon_cost"), 2).alias("spent"), F.round(F.sum("expected_incremental_profit"), 2).alias("expected_profit"))
    return a.select("*", *[F.lit(v).alias(k) for k, v in b.first().asDict().items()])


@query("segment_stats", """SELECT uplift_segment, count(*) customers, round(avg(uplift_score), 6) avg_uplift, round(avg(clv), 2) avg_clv, round(sum(expected_incremental_profit), 2) total_profit, count(*) FILTER (churn_probability >= 0.5) at_risk FROM c_summary GROUP BY 1""")
def segment_stats(spark, d):
    return customer_summary(spark, d).groupBy("uplift_segment").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.avg("uplift_score"), 6).alias("avg_uplift"), F.round(F.avg("clv"), 2).alias("avg_clv"),
        F.round(F.sum("expected_incremental_profit"), 2).alias("total_profit"), F.count_if(F.col("churn_probability") >= 0.5).alias("at_risk"))


@query("ops_overview", "SELECT event_type stage, count(*) events, round(count(*) / (SELECT count(*) FROM c_events), 6)::DOUBLE share FROM c_events GROUP BY 1")
def ops_overview(spark, d):
    e = A.events(spark, d)
    total = e.count()
    return e.groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("events")).withColumn("share", F.round(F.col("events") / F.lit(total), 6))


@query("ops_persona", "SELECT persona, count(*) customers, round(avg(churn_probability), 6) avg_churn_probability, round(avg(uplift_score), 6) avg_uplift_score, round(avg(clv), 2) avg_clv FROM c_summary GROUP BY 1")
def ops_persona(spark, d):
    return customer_summary(spark, d).groupBy("persona").agg(F.count(F.lit(1)).alias("customers"), F.round(F.avg("churn_probability"), 6).alias("avg_churn_probability"),
                                                             F.round(F.avg("uplift_score"), 6).alias("avg_uplift_score"), F.round(F.avg("clv"), 2).alias("avg_clv"))


RESPONSES = "count(*) FILTER (event_type = 'coupon_open') opens, count(*) FILTER (event_type = 'coupon_redeem') redeems"
cte("c_responses", f"SELECT customer_id, {RESPONSES} FROM c_events GROUP BY 1")


def _responses(spark, d):
    """Summary rows with the coupons a customer opened and redeemed."""
    r = A.events(spark, d).groupBy("customer_id").agg(*[F.count_if(F.col("event_type") == k).alias(n) for n, k in (("opens", "coupon_open"), ("redeems", "coupon_redeem"))])
    return customer_summary(spark, d).join(r, "customer_id", "left").na.fill(0, ["opens", "redeems"])


@query("coupon_risk", """SELECT persona, count(*) customers, count(*) FILTER (exposure_count > 0) exposed, count(*) FILTER (exposure_count >= 3) high_exposure, round(avg(exposure_count), 6) avg_exposure, round(avg(expected_roi), 4) avg_expected_roi,
 round(avg(churn_probability), 6) avg_churn_probability, round(coalesce(sum(opens), 0) / nullif(sum(exposure_count), 0), 6)::DOUBLE open_rate, round(coalesce(sum(redeems), 0) / nullif(sum(exposure_count), 0), 6)::DOUBLE redeem_rate,
 CASE WHEN count(*) FILTER (exposure_count >= 3) / count(*) >= 0.15 THEN '주의' ELSE '양호' END exposure_flag FROM c_summary LEFT JOIN c_responses USING (customer_id) GROUP BY 1""")
def coupon_risk(spark, d):
    n, hi = F.count(F.lit(1)), F.count_if(F.col("exposure_count") >= 3)
    shown = F.nullif(F.sum("exposure_count"), F.lit(0))
    return _responses(spark, d).groupBy("persona").agg(
        n.alias("customers"), F.count_if(F.col("exposure_count") > 0).alias("exposed"), hi.alias("high_exposure"), F.round(F.avg("exposure_count"), 6).alias("avg_exposure"),
        F.round(F.avg("expected_roi"), 4).alias("avg_expected_roi"), F.round(F.avg("churn_probability"), 6).alias("avg_churn_probability"),
        F.round(F.sum("opens") / shown, 6).alias("open_rate"), F.round(F.sum("redeems") / shown, 6).alias("redeem_rate"), F.when(hi / n >= 0.15, "주의").otherwise("양호").alias("exposure_flag"))


@query("coupon_risk_flags", """SELECT 'effect_prior' issue, CASE WHEN (SELECT avg(retained) FILTER (dose_intensity = 'high') - avg(retained) FILTER (dose_intensity = 'control') FROM c_dose) < 0 THEN '주의' ELSE '양호' END status
 UNION ALL SELECT 'high_exposure_share', CASE WHEN count(*) FILTER (exposure_count >= 3) / count(*) >= 0.15 THEN '주의' ELSE '양호' END FROM c_summary
 UNION ALL SELECT 'redeem_rate', CASE WHEN coalesce(sum(redeems), 0) / nullif(sum(exposure_count), 0) < 0.02 THEN '주의' ELSE '양호' END FROM c_summary LEFT JOIN c_responses USING (customer_id)""")
def coupon_risk_flags(spark, d):
    from winback.registry.q_models import dose
    arm = scalars(dose(spark, d), h=F.avg(F.when(F.col("dose_intensity") == "high", F.col("retained"))), c=F.avg(F.when(F.col("dose_intensity") == "control", F.col("retained"))))
    s = scalars(_responses(spark, d), n=F.count(F.lit(1)), hi=F.count_if(F.col("exposure_count") >= 3), r=F.sum("redeems"), x=F.sum("exposure_count"))
    bad = [("effect_prior", arm["h"] is not None and arm["c"] is not None and arm["h"] < arm["c"]), ("high_exposure_share", s["n"] and s["hi"] / s["n"] >= 0.15), ("redeem_rate", s["x"] and s["r"] / s["x"] < 0.02)]
    return spark.createDataFrame([(k, "주의" if b else "양호") for k, b in bad], "issue string, status string")


@query("ops_headline", """SELECT count(*) customers, count(*) FILTER (churn_probability >= 0.5) at_risk, round(avg(churn_probability), 6) avg_churn_probability, round(sum(clv), 2) total_clv,
 round(sum(expected_incremental_profit), 2) expected_incremental_profit, (SELECT count(*) FROM c_events) events, (SELECT count(*) FROM c_orders) orders, (SELECT count(*) FROM c_exposures) exposures FROM c_summary""")
def ops_headline(spark, d):
    n = {k: f(spark, d).agg(F.count(F.lit(1)).alias("n")).scalar() for k, f in (("events", A.events), ("orders", A.orders), ("exposures", A.exposures))}
    top = customer_summary(spark, d).agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(F.col("churn_probability") >= 0.5).alias("at_risk"), F.round(F.avg("churn_probability"), 6).alias("avg_churn_probability"),
        F.round(F.sum("clv"), 2).alias("total_clv"), F.round(F.sum("expected_incremental_profit"), 2).alias("expected_incremental_profit"))
    return top.select("*", *[v.alias(k) for k, v in n.items()])


SETS = {"customer_summary": "c_summary", "customers": "c_customers", "events": "c_events", "orders": "c_orders", "campaign_exposures": "c_exposures", "state_snapshots": "c_snapshots", "treatment_assignments": "c_assign"}


def _sets(spark, d):
    return {"customer_summary": customer_summary(spark, d), "customers": A.customers(spark, d), "events": A.events(spark, d), "orders": A.orders(spark, d),
            "campaign_exposures": A.exposures(spark, d), "state_snapshots": snapshots(spark, d), "treatment_assignments": A.assignments(spark, d)}


@query("data_diagnostics", " UNION ALL ".join(f"""SELECT '{k}' dataset, count(*) AS n_rows, count(DISTINCT customer_id) unique_customers, (SELECT count(*) FROM (SELECT DISTINCT customer_id FROM {v} WHERE customer_id NOT IN (SELECT customer_id FROM c_summary))) orphan_customers,
 count(*) FILTER (customer_id IS NULL) null_customers, count(customer_id) - count(DISTINCT customer_id) repeated_rows, round((SELECT count(*) FROM c_summary WHERE customer_id IN (SELECT customer_id FROM {v})) / (SELECT count(*) FROM c_summary), 6)::DOUBLE coverage FROM {v}""" for k, v in SETS.items()))
def data_diagnostics(spark, d):
    """Rows, customers, orphans, missing and repeated ids and the share of known customers per table. Each table is folded to one row per customer first."""
    known = customer_summary(spark, d).select("customer_id", F.lit(1).alias("k"))
    total = known.count()
    parts = []
    for name, df in _sets(spark, d).items():
        per = df.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).join(known, "customer_id", "left")
        named = F.col("customer_id").isNotNull()
        parts.append(per.agg(F.lit(name).alias("dataset"), F.sum("n").alias("n_rows"), F.count_if(named).alias("unique_customers"), F.count_if(named & F.col("k").isNull()).alias("orphan_customers"),
                             F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("null_customers"), F.sum(F.when(named, F.col("n") - 1)).alias("repeated_rows"),
                             F.round(F.count(F.col("k")) / F.lit(total), 6).alias("coverage")))
    return reduce(DataFrame.unionByName, parts)


NUM = ["churn_probability", "uplift_score", "clv", "monetary"]


@query("numeric_summary", " UNION ALL ".join(f"SELECT '{c}' AS col, round(min({c}), 4) lo, round(avg({c}), 4) mean, round(median({c}), 4) median, round(max({c}), 4) hi FROM c_summary" for c in NUM))
def numeric_summary(spark, d):
    from winback.functions.ranking import exact_quantiles
    s = customer_summary(spark, d)
    q = exact_quantiles(s, NUM, [0.5]).select("col", F.round("q0", 4).alias("median"))
    a = s.agg(*[f(c).alias(f"{n}_{c}") for c in NUM for n, f in (("lo", F.min), ("mean", F.avg), ("hi", F.max))])
    rows = a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), *[F.round(f"{n}_{c}", 4).alias(n) for n in ("lo", "mean", "hi")]) for c in NUM])).alias("r")).select("r.*")
    return rows.join(q, "col")


@query("table_snapshot", "SELECT customer_id, persona, clv, (SELECT count(*) FROM c_summary) table_rows FROM c_summary ORDER BY customer_id LIMIT 20")
def table_snapshot(spark, d):
    s = customer_summary(spark, d)
    return s.orderBy("customer_id").limit(20).select("customer_id", "persona", "clv", F.lit(s.count()).alias("table_rows"))


@query("survival_top", "SELECT customer_id, predicted_hazard_ratio, predicted_median_time_to_churn_days, risk_group FROM c_survival ORDER BY predicted_hazard_ratio DESC, customer_id LIMIT 50")
def survival_top(spark, d):
    return survival_scores(spark, d).orderBy(F.desc("predicted_hazard_ratio"), "customer_id").limit(50).select(
        "customer_id", "predicted_hazard_ratio", "predicted_median_time_to_churn_days", "risk_group")


@query("uplift_economics", "SELECT customer_id, round(uplift_score * clv, 4) expected_profit, round((uplift_score * clv - coupon_cost) / greatest(coupon_cost, 1e-9), 6) expected_roi FROM c_summary")
def uplift_economics(spark, d):
    p = F.col("uplift_score") * F.col("clv")
    return customer_summary(spark, d).select("customer_id", F.round(p, 4).alias("expected_profit"),
                                             F.round((p - F.col("coupon_cost")) / F.greatest("coupon_cost", F.lit(1e-9)), 6).alias("expected_roi"))


@query("target_schema_fill", """SELECT customer_id, round(expected_incremental_profit, 4) expected_incremental_profit, round(churn_probability * greatest(uplift_score, 0.0), 9) priority_score, round(churn_probability * greatest(uplift_score, 0.0), 9) selection_score FROM c_summary""")
def target_schema_fill(spark, d):
    """Target columns a frame lacks, from their substitutes: selection <- priority <- churn times uplift."""
    s = customer_summary(spark, d)
    pr = F.col("priority_score") if "priority_score" in s.columns else F.col("churn_probability") * F.greatest("uplift_score", F.lit(0.0))
    sel = F.col("selection_score") if "selection_score" in s.columns else pr
    return s.select("customer_id", F.round("expected_incremental_profit", 4).alias("expected_incremental_profit"), F.round(pr, 9).alias("priority_score"), F.round(sel, 9).alias("selection_score"))


@query("dataset_match", f"""{WALK} SELECT round((SELECT count(*) FROM (SELECT customer_id FROM c_sel INTERSECT SELECT customer_id FROM c_events)) / (SELECT count(DISTINCT customer_id) FROM c_sel), 6)::DOUBLE overlap,
 ((SELECT count(*) FROM (SELECT customer_id FROM c_sel INTERSECT SELECT customer_id FROM c_events)) / (SELECT count(DISTINCT customer_id) FROM c_sel) >= 0.80)::INTEGER same_dataset""")
def dataset_match(spark, d):
    a = D.selected_once(spark, d).select("customer_id").distinct()
    both = a.intersect(A.events(spark, d).select("customer_id")).agg(F.count(F.lit(1)).alias("b"))
    j = both.withColumn("n", F.lit(a.count()))
    return j.select(F.round(ratio(F.col("b"), F.col("n")), 6).alias("overlap"), (ratio(F.col("b"), F.col("n")) >= 0.80).cast("int").alias("same_dataset"))


@query("metric_column_dedupe", "SELECT customer_id, churn_probability, uplift_score, predicted_median_time_to_churn_days FROM c_summary JOIN c_survival USING (customer_id)")
def metric_column_dedupe(spark, d):
    """Columns made double by a join are dropped by name at plan time."""
    s = customer_summary(spark, d).select("customer_id", "churn_probability", "uplift_score")
    v = survival_scores(spark, d).select("customer_id", "predicted_median_time_to_churn_days").join(
        s.select("customer_id", F.col("churn_probability").alias("churn_probability_x"), F.col("uplift_score").alias("uplift_score_selected")), "customer_id")
    return drop_repeated(s.join(v, "customer_id"))


def drop_repeated(df: DataFrame) -> DataFrame:
    base = set(df.columns)
    again = [c for c in df.columns for suffix in ("_x", "_y", "_selected", "_summary", "_target") if c.endswith(suffix) and c[: -len(suffix)] in base]
    return df.drop(*again)


@query("saved_results", f"""{WALK} SELECT 'uplift' section, uplift_segment AS item, count(*)::BIGINT n, round(sum(clv), 2) amount FROM c_summary GROUP BY 2
UNION ALL SELECT 'budget', intervention_intensity, count(*), round(sum(coupon_cost), 2) FROM c_sel GROUP BY 2 UNION ALL SELECT 'allocation', uplift_segment, count(*), round(sum(expected_incremental_profit), 2) FROM c_sel GROUP BY 2""")
def saved_results(spark, d):
    """One report of the uplift table, the fresh selection and its allocation."""
    part = lambda df, name, key, amount: df.groupBy(F.col(key).alias("item")).agg(F.lit(name).alias("section"), F.count(F.lit(1)).alias("n"), F.round(F.sum(amount), 2).alias("amount"))
    sel = D.selected_once(spark, d)
    return part(customer_summary(spark, d), "uplift", "uplift_segment", "clv").unionByName(part(sel, "budget", "intervention_intensity", "coupon_cost")).unionByName(
        part(sel, "allocation", "uplift_segment", "expected_incremental_profit"))


@query("priority_rank", "SELECT customer_id, row_number() OVER (ORDER BY churn_probability DESC, customer_id) place, round(sum(clv) OVER (ORDER BY churn_probability DESC, customer_id), 2) running_clv FROM c_summary")
def priority_rank(spark, d):
    """Table-wide rank and running total, by range-cut totals."""
    t = ordered_totals(customer_summary(spark, d).select("customer_id", "churn_probability", "clv"), [("churn_probability", True), ("customer_id", False)],
                       {"place": F.lit(1), "running_clv": F.col("clv")})
    return t.select("customer_id", "place", F.round("running_clv", 2).alias("running_clv"))
