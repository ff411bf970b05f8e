"""Churn, uplift, lifetime value and survival models, and the measures on stored scores."""

from pyspark.sql import functions as F

from winback import params
from winback.functions.ranking import with_rank_pct
from winback.operators import churn as C
from winback.operators import clv as L
from winback.operators import policy as P
from winback.operators import survival as S
from winback.operators import uplift as U
from winback.plans import decision as D
from winback.plans.summary import customer_summary, survival_scores
from winback.registry.core import cte, query
from winback.registry.q_decide import R6
from winback.registry.q_features import fm, label, snapshots
from winback.registry.q_report import outcomes, row
from winback.registry.tables import mm, rank_pct, unit
from winback.sources import adapters as A
from winback.sources.staging import staged, version

NUM = ["frequency", "monetary", "price_sensitivity", "coupon_affinity", "support_contact_propensity", "discount_pressure_score", "account_balance", "exposure_count"]
TEXT = ["persona", "region"]
cte("c_train", "SELECT s.*, l.label FROM c_summary s JOIN c_label l USING (customer_id)")


def train_frame(spark, d):
    return staged(spark, d, "train_frame", lambda: customer_summary(spark, d).join(label(spark, d), "customer_id"))


def count_sql(cols, table):
    return " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) AS n, count(DISTINCT {c}::VARCHAR) n_distinct FROM {table}" for c in cols)


COLS = ["frequency", "monetary", "recency_days", "inactivity_days", "churn_probability", "uplift_score", "expected_roi", "price_sensitivity", "region", "persona", "churn_label_observed", "label"]
KEPT = [c for c in COLS if c not in C.leaks_by_name(COLS, "future_activity_horizon")]
STRICT = [c for c in COLS if c not in C.leaks_strict(COLS, "inactivity_rule")]


@query("leak_by_name", count_sql(["frequency", "monetary", "recency_days", "inactivity_days", "price_sensitivity", "region", "persona"], "c_train"))
def leak_by_name(spark, d):
    """Counts of the columns that survive the name filter (recency is allowed for a future label)."""
    t = train_frame(spark, d)
    return C.column_counts(t, [c for c in COLS if c not in C.leaks_by_name([x for x in COLS if x in t.columns], "future_activity_horizon")])


@query("leak_strict", count_sql(["frequency", "monetary", "price_sensitivity", "region", "persona", "churn_label_observed", "label"], "c_train"))
def leak_strict(spark, d):
    t = train_frame(spark, d)
    return C.column_counts(t, [c for c in COLS if c not in C.leaks_strict(COLS, "inactivity_rule")])


@query("leak_identifier", "SELECT col, n, n_distinct, (col = 'name_key' OR (col LIKE '%sequence%' AND n_distinct > 50) OR (n_distinct > 50 AND n_distinct / n >= 0.5))::INTEGER is_identifier FROM ("
       + count_sql(["persona", "region", "acquisition_month"], "c_customers") + " UNION ALL SELECT 'name_key', count(*), count(DISTINCT c_name) FROM customer UNION ALL SELECT 'recent_event_sequence', (SELECT count(*) FROM customer), count(DISTINCT s) FROM (SELECT recent_event_sequence s FROM c_seq UNION ALL SELECT 'no_history'))")
def leak_identifier(spark, d):
    f = A.customers(spark, d).join(fm(spark, d).select("customer_id", "recent_event_sequence"), "customer_id", "left")
    n = A.table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name_key"))
    return C.identifiers(f.join(n, "customer_id"), ["persona", "region", "acquisition_month", "name_key", "recent_event_sequence"])


def auc_sql(c, y, t):
    return (f"SELECT '{c}' AS col, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE auc "
            f"FROM (SELECT {y} y, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE r FROM {t})")


PROXY = ["frequency", "monetary", "recency_days", "churn_label_observed"]
cte("c_auc", " UNION ALL ".join(auc_sql(c, "label", "c_train") for c in PROXY))


@query("leak_target_proxy", """SELECT col, round(greatest(auc, 1 - auc), 6) separation, (greatest(auc, 1 - auc) >= 0.995)::INTEGER is_proxy FROM c_auc
UNION ALL SELECT 'persona', round(sum(greatest(p, n - p)) / sum(n), 6)::DOUBLE, (sum(greatest(p, n - p)) / sum(n) >= 0.995)::INTEGER FROM (SELECT persona, sum(label) p, count(*) n FROM c_train GROUP BY 1)""")
def leak_target_proxy(spark, d):
    return C.target_proxies(train_frame(spark, d), PROXY, ["persona"]).withColumn("separation", F.round("separation", 6))


@query("datetime_parts", "SELECT customer_id, year(signup_date)::INTEGER signup_date_year, month(signup_date)::INTEGER signup_date_month, (isodow(signup_date) - 1)::INTEGER signup_date_dayofweek FROM c_customers")
def datetime_parts(spark, d):
    return C.date_parts(A.customers(spark, d).select("customer_id", "signup_date"), ["signup_date"])


@query("drop_constant", "SELECT col, n_distinct FROM (" + count_sql(["persona", "region", "purchase_prev_30", "frequency"], "c_summary") + ") WHERE n_distinct > 1")
def drop_constant(spark, d):
    """Columns that have more than one value."""
    return C.column_counts(customer_summary(spark, d), ["persona", "region", "purchase_prev_30", "frequency"]).where("n_distinct > 1").select("col", "n_distinct")


SALTS = [101 + 7919 * i for i in range(50)]
_gap = ", ".join(f"avg(label) FILTER ({unit('customer_id', s)} < 0.2) t{i}" for i, s in enumerate(SALTS))


@query("group_split", f"""WITH g AS (SELECT avg(label) a, {_gap} FROM c_train), o AS (SELECT unnest([{', '.join(f'abs(t{i} - a)' for i in range(50))}]) gap, unnest(range(50)) i FROM g),
b AS (SELECT 101 + 7919 * i salt FROM o ORDER BY gap, i LIMIT 1) SELECT customer_id, label, (((((customer_id % 1000003) * 7919 + (SELECT salt FROM b)) % 1000003) / 1000003.0::DOUBLE) < 0.2)::INTEGER is_test FROM c_train""")
def group_split(spark, d):
    return C.group_split(train_frame(spark, d))[0].select("customer_id", "label", "is_test")


@query("class_balance", "SELECT customer_id, round(CASE WHEN label = 1 THEN n / (2.0 * p) ELSE n / (2.0 * (n - p)) END, 9)::DOUBLE class_weight FROM c_train, (SELECT count(*)::DOUBLE n, sum(label)::DOUBLE p FROM c_train)")
def class_balance(spark, d):
    return C.class_weight(train_frame(spark, d)).select("customer_id", F.round("class_weight", 9).alias("class_weight"))


@query("roc_auc", "SELECT col, round(auc, 6) auc FROM (" + " UNION ALL ".join(auc_sql(c, "label", "c_train") for c in ("churn_probability", "recency_days", "frequency", "monetary")) + ")")
def roc_auc(spark, d):
    return C.rank_auc(train_frame(spark, d), ["churn_probability", "recency_days", "frequency", "monetary"]).withColumn("auc", F.round("auc", 6))


cte("c_prc", """SELECT *, tp / (tp + fp) prec, tp / total rec, pos / total step FROM (SELECT s, pos, sum(pos) OVER (ORDER BY s DESC)::DOUBLE tp, sum(n - pos) OVER (ORDER BY s DESC)::DOUBLE fp, (SELECT sum(label) FROM c_train)::DOUBLE total
 FROM (SELECT churn_probability s, sum(label) pos, count(*) n FROM c_train GROUP BY 1))""")


def pr(spark, d):
    return staged(spark, d, "pr_curve", lambda: C.with_value(C.curve(train_frame(spark, d), "churn_probability")))


@query("pr_curve", "SELECT round(s, 9) threshold, tp::BIGINT tp, fp::BIGINT fp, (total - tp)::BIGINT fn, round(prec, 6) AS \"precision\", round(rec, 6) recall FROM c_prc")
def pr_curve(spark, d):
    return pr(spark, d).select(F.round("threshold", 9).alias("threshold"), "tp", "fp", "fn", *R6("precision", "recall"))


@query("average_precision", "SELECT round(sum(step * prec), 6) average_precision FROM c_prc")
def average_precision(spark, d):
    return pr(spark, d).agg(F.round(C.average_precision(pr(spark, d)), 6).alias("average_precision"))


@query("threshold_by_value", "SELECT round(s, 9) threshold, tp::BIGINT tp, fp::BIGINT fp, tp * 120000 - fp * 18000 - (total - tp) * 60000 business_value FROM c_prc ORDER BY 4 DESC, s LIMIT 1")
def threshold_by_value(spark, d):
    return pr(spark, d).orderBy(F.desc("business_value"), "threshold").limit(1).select(F.round("threshold", 9).alias("threshold"), "tp", "fp", "business_value")


_MODELS = {}


def trained(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        _MODELS[key] = C.train(train_frame(spark, d), NUM, TEXT)
    return _MODELS[key]


@query("grid_cv")
def grid_cv(spark, d):
    _, best, report = trained(spark, d)
    return spark.createDataFrame([(k, float(r["cv_auc"]), float(r["test_auc"]), int(k == best)) for k, r in report.items()], "model string, cv_auc double, test_auc double, selected int")


@query("preprocess_pipeline")
def preprocess_pipeline(spark, d):
    """Imputed, indexed and one-hot encoded feature vector of every customer."""
    from pyspark.ml.functions import vector_to_array
    t = train_frame(spark, d).withColumns({c: F.col(c).cast("double") for c in NUM})
    return C.fitted_preprocess(t, NUM, TEXT).transform(t).select("customer_id", vector_to_array("features").alias("features"))


@query("feature_importance")
def feature_importance(spark, d):
    model, _, _ = trained(spark, d)
    s = C.score(model, train_frame(spark, d), NUM)
    top = C.importances(model, s)
    total = sum(v for _, v in top) or 1.0
    return spark.createDataFrame([(n, v, v / total) for n, v in top], "feature string, importance double, importance_share double")


@query("importance_share")
def importance_share(spark, d):
    return feature_importance(spark, d).select("feature", F.round("importance_share", 6).alias("importance_share"))


@query("model_score_batch")
def model_score_batch(spark, d):
    """Saved pipeline read back, applied to the customers seen in the event stream."""
    from pyspark.ml import PipelineModel

    from winback.sources.staging import new_path
    path = new_path(spark, "churn-model")
    trained(spark, d)[0].write().overwrite().save(path)
    model = PipelineModel.load(path)
    return C.score(model, customer_summary(spark, d), NUM, changed=A.events(spark, d).select("customer_id")).select("customer_id", F.round("churn_score", 6).alias("churn_score"))


# uplift -------------------------------------------------------------------------------------------------------------

cte("c_upl", "SELECT s.*, o.treatment_flag, o.retained, o.revenue_post, o.assigned_at, o.coupon_cost offer_cost FROM c_summary s JOIN (SELECT customer_id, treatment_flag, retained, revenue_post, assigned_at, coupon_cost FROM c_out) o USING (customer_id)")
cte("c_qini", """SELECT customer_id, k, k / n::DOUBLE fraction, g qini_gain, (k - 1) / (n - 1)::DOUBLE * last_value(g) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) random_gain FROM (
SELECT *, (coalesce(yt / nullif(nt, 0), 0) - coalesce(yc / nullif(nc, 0), 0)) * k g FROM (SELECT customer_id, row_number() OVER o k, sum(treatment_flag) OVER o nt, sum(1 - treatment_flag) OVER o nc, sum(retained * treatment_flag) OVER o yt,
 sum(retained * (1 - treatment_flag)) OVER o yc, count(*) OVER () n FROM c_upl WINDOW o AS (ORDER BY uplift_score DESC, customer_id)))""")
UNUM = ["recency_days", "frequency", "monetary", "price_sensitivity", "coupon_affinity", "churn_probability"]


def upl(spark, d):
    def build():
        o = outcomes(spark, d).select("customer_id", F.col("treatment_flag").cast("double").alias("treatment_flag"), F.col("retained").cast("double").alias("retained"),
                                      "revenue_post", "assigned_at", F.col("coupon_cost").alias("offer_cost"))
        s = customer_summary(spark, d)
        return s.withColumns({c: F.col(c).cast("double") for c in UNUM}).join(o, "customer_id")
    return staged(spark, d, "uplift_frame", build)


def qini_rows(spark, d):
    return staged(spark, d, "qini", lambda: U.qini(upl(spark, d), "uplift_score"))


@query("qini_curve", "SELECT customer_id, k, round(fraction, 9) fraction, round(qini_gain, 6) qini_gain, round(random_gain, 6) random_gain FROM c_qini")
def qini_curve(spark, d):
    return qini_rows(spark, d).select("customer_id", "k", F.round("fraction", 9).alias("fraction"), *R6("qini_gain", "random_gain"))


@query("auuc", "SELECT round(sum((fraction - pf) * (qini_gain + pg) / 2), 6) auuc FROM (SELECT *, lag(fraction) OVER (ORDER BY k) pf, lag(qini_gain) OVER (ORDER BY k) pg FROM c_qini)")
def auuc(spark, d):
    return row(spark, {"auuc": U.auuc(qini_rows(spark, d))})


@query("uplift_curve", "SELECT customer_id, round(qini_gain / fraction, 6) uplift FROM c_qini")
def uplift_curve(spark, d):
    return qini_rows(spark, d).select("customer_id", F.round(F.col("qini_gain") / F.col("fraction"), 6).alias("uplift"))


def learned(spark, d, name):
    """Held-out scores of one learner."""
    return staged(spark, d, f"{name}_scored", lambda: U.cross_fitted(upl(spark, d), name, UNUM, ["persona"]))


def _uplift(spark, d, name):
    return learned(spark, d, name).select("customer_id", F.round("predicted_uplift", 6).alias("predicted_uplift"))


@query("s_learner")
def s_learner(spark, d):
    return _uplift(spark, d, "s_learner")


@query("t_learner")
def t_learner(spark, d):
    return _uplift(spark, d, "t_learner")


@query("dr_learner")
def dr_learner(spark, d):
    return _uplift(spark, d, "dr_learner")


@query("learner_select")
def learner_select(spark, d):
    best, areas = U.select_learner({name: learned(spark, d, name) for name in U.LEARNERS})
    return spark.createDataFrame([(k, float(v), int(k == best)) for k, v in areas.items()], "learner string, auuc double, selected int")


@query("uplift_segment", "SELECT customer_id, uplift_segment FROM c_segments")
def uplift_segment(spark, d):
    return customer_summary(spark, d).select("customer_id", P.uplift_segment(F.col("uplift_score"), F.col("churn_probability")).alias("uplift_segment"))


PCOL = ["uplift_score", "churn_probability", "coupon_affinity", "price_sensitivity", "tenure_days", "frequency", "monetary", "inactivity_days"]


@query("persuadables_profile", " UNION ALL ".join(f"""SELECT '{c}' feature, round(coalesce(avg({c}) FILTER (uplift_segment = 'Persuadables'), 0.0), 4) persuadables_mean, round(avg({c}), 4) overall_mean,
 round(coalesce(avg({c}) FILTER (uplift_segment = 'Persuadables'), 0.0) - avg({c}), 4) delta FROM c_segments""" for c in PCOL))
def persuadables_profile(spark, d):
    return U.persuadables_deltas(D.segments(spark, d), PCOL)


@query("persuadables_top_values", """SELECT "column", value, r AS rank, share FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INTEGER r, round(n / sum(n) OVER (PARTITION BY "column"), 4)::DOUBLE share FROM (
 SELECT 'persona' AS "column", persona AS value, count(*) n FROM c_segments WHERE uplift_segment = 'Persuadables' GROUP BY 2 UNION ALL SELECT 'region', region, count(*) FROM c_segments WHERE uplift_segment = 'Persuadables' GROUP BY 2)) WHERE r <= 3""")
def persuadables_top_values(spark, d):
    return U.persuadables_profiles(D.segments(spark, d), ["persona", "region"])


cte("c_dose0", """SELECT o.*, coalesce(n, 0) dose_exposure_count FROM c_out o LEFT JOIN (SELECT x.customer_id, count(*) n FROM c_exposures x JOIN (SELECT customer_id, assigned_at FROM c_assign) a USING (customer_id)
 WHERE date_diff('day', assigned_at::DATE, exposure_time::DATE) BETWEEN 0 AND 30 GROUP BY 1) USING (customer_id)""")
cte("c_dose", f"""SELECT c.*, CASE WHEN treatment_flag = 0 THEN 'control' WHEN strength <= (SELECT quantile_cont(strength, 1/3.0::DOUBLE) FROM c_str) THEN 'low' WHEN strength <= (SELECT quantile_cont(strength, 2/3.0::DOUBLE) FROM c_str) THEN 'mid' ELSE 'high' END dose_intensity
FROM c_dose0 c LEFT JOIN (SELECT customer_id, strength FROM c_str) USING (customer_id)""")
cte("c_str", f"SELECT customer_id, round(0.75 * ({mm('coupon_cost')}) + 0.25 * ({mm('dose_exposure_count')}), 9)::DOUBLE strength FROM c_dose0 WHERE treatment_flag = 1")


def dose(spark, d):
    return staged(spark, d, "dose", lambda: U.dose_label(staged(spark, d, "dose0", lambda: U.exposure_window(outcomes(spark, d), A.exposures(spark, d)))))


@query("exposure_window", "SELECT customer_id, dose_exposure_count FROM c_dose0")
def exposure_window(spark, d):
    return U.exposure_window(outcomes(spark, d), A.exposures(spark, d)).select("customer_id", "dose_exposure_count")


@query("dose_label", "SELECT customer_id, dose_intensity FROM c_dose")
def dose_label(spark, d):
    return dose(spark, d).select("customer_id", "dose_intensity")


@query("stratified_sample", f"""SELECT customer_id, dose_intensity, retained FROM (SELECT *, row_number() OVER (PARTITION BY dose_intensity, retained ORDER BY {unit('customer_id', 911)}, customer_id) k,
 greatest(round_even(count(*) OVER (PARTITION BY dose_intensity, retained) * 800 / (count(*) OVER ())::DOUBLE, 0), 1) q FROM c_dose) WHERE k <= q""")
def stratified_sample(spark, d):
    return U.stratified(dose(spark, d), ["dose_intensity", "retained"], 800).select("customer_id", "dose_intensity", "retained")


@query("dose_arm_summary", """SELECT dose_intensity, count(*) samples, round(avg(retained), 6) retention_rate, round(avg(coupon_cost), 2) avg_coupon_cost, round(avg(dose_exposure_count), 4) avg_exposure_count, round(avg(revenue_post), 2) avg_revenue_post,
 round(avg(retained) - (SELECT avg(retained) FROM c_dose WHERE dose_intensity = 'control'), 6) effect_prior, round(avg(coupon_cost) / (SELECT greatest(avg(coupon_cost), 1.0) FROM c_dose WHERE dose_intensity = 'mid'), 6) cost_multiplier FROM c_dose GROUP BY 1""")
def dose_arm_summary(spark, d):
    return U.arm_summary(dose(spark, d))


def dose_scored(spark, d):
    def build():
        s = customer_summary(spark, d).select("customer_id", *[F.col(c).cast("double").alias(c) for c in UNUM], "persona")
        t = dose(spark, d).select("customer_id", "dose_intensity", F.col("retained").cast("double").alias("retained")).join(s, "customer_id")
        return U.dose_effects(t, UNUM, ["persona"])
    return staged(spark, d, "dose_scored", build)


@query("dose_arm_models")
def dose_arm_models(spark, d):
    return dose_scored(spark, d).select("customer_id", *R6(*[f"p_{a}" for a in U.ARMS]))


@query("dose_effect_predict")
def dose_effect_predict(spark, d):
    return dose_scored(spark, d).select("customer_id", *R6("effect_low", "effect_mid", "effect_high"))


@query("effect_learned_dose")
def effect_learned_dose(spark, d):
    """Learned-effect economics with the effect of each offer from the fitted dose response; the uplift score stands in where a customer has no fit."""
    from winback.operators import policy as P
    from winback.plans import decision as D
    from winback.plans.summary import survival_scores
    base = P.action_base(P.with_strategy(D.segments(spark, d)), survival_scores(spark, d))
    fitted = dose_scored(spark, d).select("customer_id", "effect_low", "effect_mid", "effect_high")
    kind = F.col("intervention_intensity")
    effect = F.coalesce(F.when(kind == "low", F.col("effect_low")).when(kind == "mid", F.col("effect_mid")).otherwise(F.col("effect_high")), F.col("uplift_score"))
    return P.learned_effect(P.explode_intensities(base).join(fitted, "customer_id", "left"), effect).select(
        "customer_id", "intervention_intensity", *R6("dose_response_incremental_effect", "intensity_effect_multiplier"), F.round("expected_incremental_profit", 2).alias("expected_incremental_profit"))


# lifetime value -----------------------------------------------------------------------------------------------------

ANCHOR = "2000-12-31"


def clv_sql(w):
    f = f"FILTER (order_time::DATE >= DATE '{ANCHOR}' - {w - 1} AND order_time::DATE <= DATE '{ANCHOR}')"
    return f"count(*) {f} w{w}_orders, round(coalesce(sum(net_amount) {f}, 0.0), 4) w{w}_spend"


cte("c_anch", f"SELECT customer_id, {', '.join(clv_sql(w) for w in L.WINDOWS)} FROM c_orders GROUP BY 1")


@query("clv_anchor_features", f"""SELECT customer_id, {', '.join(f'coalesce(w{w}_orders, 0) w{w}_orders, coalesce(w{w}_spend, 0.0) w{w}_spend' for w in L.WINDOWS)}, date_diff('day', signup_date::DATE, DATE '{ANCHOR}') tenure_days,
 round(coalesce(w180_spend, 0.0) / greatest(date_diff('day', signup_date::DATE, DATE '{ANCHOR}'), 1), 4) spend_velocity FROM c_customers LEFT JOIN c_anch USING (customer_id) WHERE signup_date <= TIMESTAMP '{ANCHOR}'""")
def clv_anchor_features(spark, d):
    f = L.anchor_features(A.customers(spark, d), A.orders(spark, d), ANCHOR)
    return f.select("customer_id", *[x for w in L.WINDOWS for x in (F.col(f"w{w}_orders"), F.round(f"w{w}_spend", 4).alias(f"w{w}_spend"))], F.col("tenure_days").cast("long").alias("tenure_days"),
                    F.round("spend_velocity", 4).alias("spend_velocity"))


@query("clv_future_target", f"""SELECT c.customer_id, round(coalesce(sum(net_amount), 0.0), 4) future_spend FROM c_customers c LEFT JOIN c_orders o ON o.customer_id = c.customer_id AND order_time::DATE > DATE '{ANCHOR}' AND order_time::DATE <= DATE '{ANCHOR}' + 180
WHERE signup_date <= TIMESTAMP '{ANCHOR}' GROUP BY 1""")
def clv_future_target(spark, d):
    base = A.customers(spark, d).where(F.to_date("signup_date") <= F.lit(ANCHOR).cast("date")).select("customer_id")
    return L.future_spend(base, A.orders(spark, d), ANCHOR).select("customer_id", F.round("future_spend", 4).alias("future_spend"))


@query("clv_fit_predict")
def clv_fit_predict(spark, d):
    c, o = A.customers(spark, d), A.orders(spark, d)
    train = L.future_spend(L.anchor_features(c, o, "2000-12-31"), o, "2000-12-31")
    return L.fit_predict(train, L.anchor_features(c, o, params.SNAPSHOT_END), ["persona"])[0].withColumn("predicted_clv_12m", F.round("predicted_clv_12m", 2))


@query("clv_fit_report")
def clv_fit_report(spark, d):
    """Errors on customers that were not fitted."""
    c, o = A.customers(spark, d), A.orders(spark, d)
    train = L.future_spend(L.anchor_features(c, o, "2000-12-31"), o, "2000-12-31")
    report = L.fit_predict(train, train, ["persona"])[1]
    return spark.createDataFrame([(k, float(v)) for k, v in report.items()], "measure string, value double")


@query("high_value_top20", "SELECT customer_id, (clv >= (SELECT quantile_cont(clv, 0.8) FROM c_summary))::INTEGER is_high_value_top20pct FROM c_summary")
def high_value_top20(spark, d):
    return L.high_value(customer_summary(spark, d), "clv").select("customer_id", "is_high_value_top20pct")


@query("distribution_report", """SELECT min(clv) AS min, median(clv) AS median, round(avg(clv), 4) mean, quantile_cont(clv, 0.8) p80, quantile_cont(clv, 0.95) p95, max(clv) AS max,
 round(avg((clv >= (SELECT quantile_cont(clv, 0.8) FROM c_summary))::INTEGER), 6) high_value_share FROM c_summary""")
def distribution_report(spark, d):
    return L.distribution(customer_summary(spark, d), "clv")


# survival -----------------------------------------------------------------------------------------------------------

LM = f"TIMESTAMP '{params.AS_OF_ORDERS}'"
cte("c_actv", "SELECT DISTINCT customer_id, activity_time FROM (SELECT customer_id, event_time activity_time FROM c_order_events WHERE event_type IN ('visit', 'purchase') UNION ALL SELECT customer_id, order_time FROM c_orders)")
cte("c_risk", f"SELECT customer_id, coalesce(l, CASE WHEN signup_date <= {LM} THEN signup_date END, {LM}) l FROM c_customers LEFT JOIN (SELECT customer_id, max(activity_time) l FROM c_actv WHERE activity_time <= {LM} GROUP BY 1) USING (customer_id)")
cte("c_gap", f"""SELECT customer_id, min(CASE WHEN (nx IS NULL OR t + INTERVAL 180 DAY < nx) AND t + INTERVAL 180 DAY <= {LM} + INTERVAL 90 DAY THEN greatest(t + INTERVAL 180 DAY, {LM} + INTERVAL 1 DAY) END) event_date
FROM (SELECT *, lead(t) OVER (PARTITION BY customer_id ORDER BY t) nx FROM (SELECT customer_id, l t FROM c_risk WHERE l + INTERVAL 180 DAY > {LM} UNION ALL
 SELECT a.customer_id, activity_time FROM c_actv a JOIN c_risk r ON r.customer_id = a.customer_id AND r.l + INTERVAL 180 DAY > {LM} WHERE activity_time > {LM} AND activity_time <= {LM} + INTERVAL 90 DAY)) GROUP BY 1""")
cte("c_land", f"SELECT customer_id, CASE WHEN event_date IS NULL THEN 90 ELSE greatest(date_diff('day', {LM}::DATE, event_date::DATE), 1) END::INTEGER duration_days, (event_date IS NOT NULL)::INTEGER event_observed FROM c_gap")
cte("c_surv", "SELECT l.*, predicted_hazard_ratio h FROM c_land l JOIN c_survival USING (customer_id)")


def gap(spark, d):
    act = S.activity(A.order_events(spark, d), A.orders(spark, d))
    return staged(spark, d, "gap_events", lambda: S.gap_events(act, A.customers(spark, d), params.AS_OF_ORDERS, params.HORIZON_DAYS, params.CHURN_DAYS))


def land(spark, d):
    return staged(spark, d, "landmark", lambda: S.landmark_rows(gap(spark, d), params.AS_OF_ORDERS, params.HORIZON_DAYS).join(survival_scores(spark, d).select("customer_id", "predicted_hazard_ratio"), "customer_id"))


@query("scan_activity", "SELECT customer_id, count(*) activities, strftime(max(activity_time), '%Y-%m-%d') last_activity FROM c_actv GROUP BY 1")
def scan_activity(spark, d):
    return S.activity(A.order_events(spark, d), A.orders(spark, d)).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("activities"), F.date_format(F.max("activity_time"), "yyyy-MM-dd").alias("last_activity"))


@query("gap_event_dates", "SELECT customer_id, strftime(event_date, '%Y-%m-%d') event_date FROM c_gap")
def gap_event_dates(spark, d):
    return gap(spark, d).withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))


@query("landmark_dataset", "SELECT * FROM c_land")
def landmark_dataset(spark, d):
    return S.landmark_rows(gap(spark, d), params.AS_OF_ORDERS, params.HORIZON_DAYS)


@query("landmark_status_events", f"""SELECT customer_id, CASE WHEN e IS NULL THEN 90 ELSE greatest(e - DATE '{params.AS_OF_ORDERS}', 1) END::INTEGER duration_days, (e IS NOT NULL)::INTEGER event_observed FROM c_customers
LEFT JOIN (SELECT customer_id, min(snapshot_date) e FROM c_snapshots WHERE snapshot_date > DATE '{params.AS_OF_ORDERS}' AND snapshot_date <= DATE '{params.AS_OF_ORDERS}' + 90 AND current_status IN ('churn_risk', 'churned') GROUP BY 1) USING (customer_id)""")
def landmark_status_events(spark, d):
    e = S.status_events(snapshots(spark, d), A.customers(spark, d), params.AS_OF_ORDERS, params.HORIZON_DAYS)
    return S.landmark_rows(e, params.AS_OF_ORDERS, params.HORIZON_DAYS)


@query("rare_collapse", """WITH n AS (SELECT acquisition_month v, count(*) n FROM (SELECT coalesce(acquisition_month, 'unknown') acquisition_month FROM c_customers) GROUP BY 1), k AS (SELECT v FROM (SELECT v FROM n ORDER BY n DESC, v LIMIT 8) UNION SELECT v FROM n WHERE n / (SELECT sum(n) FROM n) >= 0.03)
SELECT CASE WHEN v IN (SELECT v FROM k) THEN v ELSE '__rare__' END acquisition_month, sum(n)::BIGINT customers FROM n GROUP BY 1""")
def rare_collapse(spark, d):
    return S.rare_collapse(A.customers(spark, d), "acquisition_month", 8, 0.03).groupBy("acquisition_month").agg(F.count(F.lit(1)).alias("customers"))


SNUM = ["recency_days", "frequency", "monetary", "price_sensitivity", "coupon_affinity", "support_contact_propensity", "discount_pressure_score"]


def surv_frame(spark, d):
    def build():
        s = customer_summary(spark, d).select("customer_id", *SNUM, "persona")
        return land(spark, d).join(s, "customer_id")
    return staged(spark, d, "survival_frame", build)


@query("encoded_filter", " UNION ALL ".join(f"""SELECT '{c}' AS col, round(stddev_samp({e}), 4) std, CASE WHEN var_samp({e}) <= 1e-4 THEN 'low_variance' ELSE 'keep' END verdict FROM c_land JOIN c_summary USING (customer_id)"""
       for c, e in [*[(c, f"{c}::DOUBLE") for c in SNUM], *[(f"persona_{p}", f"(persona = '{p}')::INTEGER") for p in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]]))
def encoded_filter(spark, d):
    f, cols = S.encode(surv_frame(spark, d), SNUM, ["persona"])
    return S.encoded_stats(f, cols).select("col", F.round(F.sqrt("variance"), 4).alias("std"), "verdict")


@query("survival_frame", "SELECT customer_id, duration_days, event_observed, frequency::DOUBLE frequency, (persona = 'BUILDING')::INTEGER::DOUBLE persona_building FROM c_land JOIN c_summary USING (customer_id)")
def survival_frame(spark, d):
    f, _ = S.encode(surv_frame(spark, d), SNUM, ["persona"])
    return f.select("customer_id", "duration_days", "event_observed", "frequency", F.col("persona_BUILDING").alias("persona_building"))


_COX = {}


def cox(spark, d):
    key = (spark.sparkContext.applicationId, d, version(spark, d))
    if key not in _COX:
        f, cols = S.encode(surv_frame(spark, d), SNUM, ["persona"])
        keep = [r["col"] for r in S.encoded_stats(f, cols).where("verdict = 'keep'").orderBy(F.desc("variance")).limit(140).collect()]
        f = staged(spark, d, "cox_input", lambda: f.select("customer_id", "duration_days", "event_observed", *keep))
        _COX[key] = (S.cox_fit(f, keep), f)
    return _COX[key]


@query("cox_fit")
def cox_fit(spark, d):
    m, f = cox(spark, d)
    scored = S.cox_predict(f, m, params.HORIZON_DAYS)
    return row(spark, {"penalty": float(m["penalty"]), "features": len(m["cols"]), "c_index": S.concordance(scored, "predicted_hazard_ratio")})


@query("coefficients_table")
def coefficients_table(spark, d):
    return S.coefficients(spark, cox(spark, d)[0])


@query("survival_predict")
def survival_predict(spark, d):
    m, f = cox(spark, d)
    s = S.cox_predict(f, m, params.HORIZON_DAYS)
    return s.select("customer_id", *R6("predicted_hazard_ratio", "survival_prob_1d", "survival_prob_30d", "survival_prob_60d", "survival_prob_90d"), "predicted_median_time_to_churn_days")


@query("risk_percentile", f"SELECT customer_id, round({rank_pct('predicted_hazard_ratio')}, 9) risk_percentile FROM c_survival")
def risk_percentile(spark, d):
    r = with_rank_pct(survival_scores(spark, d).select("customer_id", "predicted_hazard_ratio"), {"predicted_hazard_ratio": "p"})
    return r.select("customer_id", F.round("p", 9).alias("risk_percentile"))


TERC = "CASE WHEN 3 * (r - 1) < n - 1 THEN 'Low Risk' WHEN 3 * (r - 1) < 2 * (n - 1) THEN 'Mid Risk' ELSE 'High Risk' END"
cte("c_terc", f"SELECT customer_id, duration_days, event_observed, {TERC} risk_group FROM (SELECT *, row_number() OVER (ORDER BY h, customer_id) r, count(*) OVER () n FROM c_surv)")


@query("risk_terciles", "SELECT customer_id, risk_group FROM c_terc")
def risk_terciles(spark, d):
    return S.with_terciles(land(spark, d), "predicted_hazard_ratio").select("customer_id", "risk_group")


@query("kaplan_meier", """SELECT risk_group, duration_days, events, at_risk, round(CASE WHEN dead = 1 THEN 0.0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER (PARTITION BY risk_group ORDER BY duration_days)) END, 6) survival FROM (
SELECT *, max((events >= at_risk)::INTEGER) OVER (PARTITION BY risk_group ORDER BY duration_days) dead FROM (SELECT risk_group, duration_days, sum(event_observed)::BIGINT events, (sum(count(*)) OVER (PARTITION BY risk_group ORDER BY duration_days DESC))::BIGINT at_risk FROM c_terc GROUP BY 1, 2))""")
def kaplan_meier(spark, d):
    return S.kaplan_meier(S.with_terciles(land(spark, d), "predicted_hazard_ratio"), "risk_group").withColumn("survival", F.round("survival", 6))


@query("concordance_index", """SELECT round(sum(CASE WHEN a.h > b.h THEN 1.0 WHEN a.h = b.h THEN 0.5 ELSE 0.0 END) / count(*), 6)::DOUBLE c_index FROM c_surv a JOIN c_surv b ON a.event_observed = 1 AND (b.duration_days > a.duration_days OR (b.duration_days = a.duration_days AND b.event_observed = 0))""")
def concordance_index(spark, d):
    return row(spark, {"c_index": S.concordance(land(spark, d), "predicted_hazard_ratio")})
