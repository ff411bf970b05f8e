"""Customer summary, scores and upload profiling."""

from pyspark.sql import functions as F

from winback.functions import vocab as V
from winback.functions.scalars import scalars
from winback.operators import ingest as I
from winback.operators import scores
from winback.plans import summary as plan
from winback.registry import tables as T
from winback.registry.core import cte, query
from winback.sources import adapters as A


@query("rfm", "SELECT customer_id, date_diff('day', max(order_time)::DATE, (SELECT max(order_time) FROM c_orders)::DATE) recency_days, "
       "count(*) frequency, round(sum(net_amount), 4) monetary FROM c_orders GROUP BY 1")
def rfm(spark, d):
    return scores.rfm(A.orders(spark, d))


@query("customer_summary_build", "SELECT * REPLACE (strftime(signup_date, '%Y-%m-%d') AS signup_date) FROM c_summary")
def customer_summary_build(spark, d):
    return plan.customer_summary(spark, d).withColumn("signup_date", F.date_format("signup_date", "yyyy-MM-dd"))


# uploads ------------------------------------------------------------------------------------------------------------

RAW = "CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN upper(event_type) || ' Item' WHEN 2 THEN 'x_' || event_type || '!' ELSE event_type || ' / report_issue' END"
cte("c_upload", f"""SELECT event_id, CASE WHEN event_id % 50 = 7 THEN NULL ELSE user_id END customer_id, ts::TIMESTAMP event_time, {RAW} action, value amount, (props->>'$.k')::INTEGER k,
 (((props->>'$.k')::INTEGER % 20) * 0.25)::DOUBLE discount_amount, CASE (props->>'$.k')::INTEGER % 4 WHEN 0 THEN 'yes' WHEN 1 THEN '0' WHEN 2 THEN '1' ELSE 'no' END coupon_used,
 CASE WHEN (props->>'$.k')::INTEGER % 3 = 0 THEN 'camp-' || ((props->>'$.k')::INTEGER % 9)::VARCHAR END campaign_id, (props->>'$.k')::INTEGER * 10 session_duration, (props->>'$.k')::INTEGER % 7 page_views,
 CASE WHEN event_type = 'error' THEN 'defect' ELSE 'none' END refund_reason, CASE (props->>'$.k')::INTEGER % 5 WHEN 0 THEN 'Dormant' WHEN 1 THEN 'churned' ELSE 'active' END status FROM events""")
KEY = "customer_id IS NOT NULL"


def upload(spark, d):
    """An uploaded event file: the event table with odd event names, gaps, discounts, flags and texts."""
    e = A.table(spark, d, "events")
    k, t = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    raw = (F.when(F.col("event_id") % 4 == 0, t).when(F.col("event_id") % 4 == 1, F.concat(F.upper(t), F.lit(" Item")))
           .when(F.col("event_id") % 4 == 2, F.concat(F.lit("x_"), t, F.lit("!"))).otherwise(F.concat(t, F.lit(" / report_issue"))))
    return e.select(
        "event_id", F.when(F.col("event_id") % 50 != 7, F.col("user_id")).alias("customer_id"), F.col("ts").cast("timestamp").alias("event_time"), raw.alias("action"), F.col("value").alias("amount"), k.alias("k"),
        ((k % 20) * 0.25).alias("discount_amount"), F.when(k % 4 == 0, "yes").when(k % 4 == 1, "0").when(k % 4 == 2, "1").otherwise("no").alias("coupon_used"),
        F.when(k % 3 == 0, F.concat(F.lit("camp-"), (k % 9).cast("string"))).alias("campaign_id"), (k * 10).alias("session_duration"), (k % 7).alias("page_views"),
        F.when(t == "error", "defect").otherwise("none").alias("refund_reason"), F.when(k % 5 == 0, "Dormant").when(k % 5 == 1, "churned").otherwise("active").alias("status"))


def keyed(spark, d):
    return upload(spark, d).where("customer_id IS NOT NULL")


UCOLS = ["event_id", "customer_id", "action", "campaign_id", "refund_reason", "status", "page_views"]


@query("column_profile", " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) AS n, count(DISTINCT {c}) n_distinct, round(count(*) FILTER ({c} IS NULL) / count(*), 6)::DOUBLE missing_rate, CASE WHEN typeof(max({c})) = 'VARCHAR' THEN 'text' ELSE 'number' END AS kind, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c}::VARCHAR v FROM c_upload WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) samples FROM c_upload" for c in UCOLS))
def column_profile(spark, d):
    return I.profile(upload(spark, d).select(*UCOLS))


ROLE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS col, '{r}' AS role, {s}::DOUBLE confidence, (SELECT count(*) FROM c_upload WHERE {c} IS NOT NULL) filled" for c, r, s in [
    ("event_id", "customer_id", 0.7), ("customer_id", "customer_id", 1.0), ("event_time", "timestamp", 1.0), ("action", "event_type", 1.0), ("amount", "amount", 1.0), ("campaign_id", "customer_id", 0.7), ("status", "churn_flag", 1.0)])


@query("column_role_detect", ROLE_SQL)
def column_role_detect(spark, d):
    """Detected role per column, with how many rows fill it."""
    u = upload(spark, d).select("event_id", "customer_id", "event_time", "action", "amount", "campaign_id", "status")
    found = {c: (r, s) for c, r, s in I.roles(u)}
    a = u.agg(*[F.count(c).alias(c) for c in u.columns])
    rows = [F.struct(F.lit(c).alias("col"), F.lit(found[c][0]).alias("role"), F.lit(float(found[c][1])).alias("confidence"), F.col(c).alias("filled")) for c in u.columns]
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query("relevance_score", "SELECT 0.9::DOUBLE + 0.05::DOUBLE relevance, (count(*) >= 10)::INTEGER is_valid, count(*) AS n FROM c_upload".replace("0.9::DOUBLE + 0.05::DOUBLE", "0.95::DOUBLE"))
def relevance_score(spark, d):
    u = upload(spark, d).select("event_id", "customer_id", "event_time", "action", "amount", "campaign_id", "status")
    r = I.relevance(I.roles(u))
    return u.agg(F.lit(r).alias("relevance"), ((F.count(F.lit(1)) >= 10) & F.lit(r >= 0.25 and len(u.columns) >= 2)).cast("int").alias("is_valid"), F.count(F.lit(1)).alias("n"))


@query("irrelevance_check", "SELECT 'upload' source, count(*) AS n, 0 rejected FROM c_upload UNION ALL SELECT 'sensor', count(*), 1 FROM c_upload")
def irrelevance_check(spark, d):
    u = upload(spark, d)
    sensor = u.select(F.col("amount").alias("temperature"), F.col("k").alias("humidity"), F.col("page_views").alias("voltage"))
    one = lambda name, df: df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"), F.lit(int(I.irrelevant(df.columns))).alias("rejected"))
    return one("upload", u).unionByName(one("sensor", sensor))


@query("quality_warnings", "SELECT 'mostly_missing' note, 'campaign_id' detail WHERE (SELECT count(*) FILTER (campaign_id IS NULL) / count(*) FROM c_upload) > 0.5 UNION ALL SELECT 'transaction_level', 'customer_id' WHERE (SELECT count(DISTINCT customer_id) / count(*) FROM c_upload) < 0.5")
def quality_warnings(spark, d):
    return I.warnings(upload(spark, d).select("customer_id", "action", "campaign_id"), "customer_id")


@query("validate_many", "SELECT 'events' source, count(*) AS n, count(DISTINCT customer_id) ids FROM c_upload UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey) FROM orders")
def validate_many(spark, d):
    files = {"events": upload(spark, d).select("customer_id", "action"), "orders": A.table(spark, d, "orders").select(F.col("o_custkey").alias("customer_id"), "o_orderstatus")}
    parts = [I.profile(df).where("col = 'customer_id'").select(F.lit(name).alias("source"), "n", F.col("n_distinct").alias("ids")) for name, df in files.items()]
    return parts[0].unionByName(parts[1])


@query("looks_datetime", "SELECT 'day_text' AS col, 1.0::DOUBLE pattern_share, 1.0::DOUBLE parsed_share, 1 is_datetime FROM c_upload HAVING count(*) > 0 UNION ALL SELECT 'action', 0.0, 0.0, 0 FROM c_upload HAVING count(*) > 0")
def looks_datetime(spark, d):
    u = upload(spark, d).select("action", F.date_format("event_time", "yyyy-MM-dd").alias("day_text"))
    return I.looks_datetime(u, ["day_text", "action"])


SYN = ", ".join(f"('{s}', '{std}', {i})" for i, (s, std) in enumerate((s, std) for std, words in V.EVENT_VALUES.items() for s in words))
cte("c_vals", "SELECT action, count(*) n, trim(regexp_replace(regexp_replace(lower(trim(action)), '[^a-z0-9가-힣]', '_', 'g'), '_+', '_', 'g'), '_') v FROM c_upload GROUP BY 1")
cte("c_vmap", f"""SELECT action, n, coalesce((SELECT arg_min(t, i) FROM (VALUES {SYN}) x(s, t, i) WHERE s = v), (SELECT arg_min(t, -length(s) * 10000 + i) FROM (VALUES {SYN}) y(s, t, i) WHERE length(s) >= 4 AND contains(v, s)), 'other') event_type FROM c_vals""")


@query("event_standardise", "SELECT event_id, event_type standard_type FROM c_upload JOIN c_vmap USING (action)")
def event_standardise(spark, d):
    return I.standardise(upload(spark, d).select("event_id", "action"), "action").select("event_id", "standard_type")


@query("event_mapping_report", "SELECT event_type, sum(n)::BIGINT AS \"rows\", count(*) distinct_values, round(sum(n) / (SELECT count(*) FROM c_upload), 6)::DOUBLE AS share, round(1 - coalesce((SELECT sum(n) FROM c_vmap WHERE event_type = 'other'), 0) / (SELECT sum(n) FROM c_vmap), 4)::DOUBLE AS coverage_rate FROM c_vmap GROUP BY 1")
def event_mapping_report(spark, d):
    return I.mapping_report(I.event_map(upload(spark, d), "action"))


@query("event_mapping_unmapped", "SELECT action AS value, n FROM c_vmap WHERE event_type = 'other'")
def event_mapping_unmapped(spark, d):
    """Raw values that no word of the vocabulary explains."""
    return I.event_map(upload(spark, d), "action").where("event_type = 'other'").select("value", "n")


@query("event_mapping_preview", "SELECT action AS value, n, event_type FROM c_vmap")
def event_mapping_preview(spark, d):
    """Value, count and type, with the limit of the preview left to the caller."""
    return I.event_map(upload(spark, d), "action")


@query("recommend_churn_days", """SELECT least(greatest(round_even(median(g) * 1.75, 0), 7), 180)::INTEGER recommended_days FROM (SELECT customer_id, avg(gap) g FROM (SELECT customer_id, (epoch_us(event_time) - epoch_us(lag(event_time) OVER (PARTITION BY customer_id ORDER BY event_time, event_id))) / 86400000000.0::DOUBLE gap
 FROM c_upload WHERE customer_id IS NOT NULL) WHERE gap > 0 AND gap <= 365 GROUP BY 1)""")
def recommend_churn_days(spark, d):
    days = I.churn_days(keyed(spark, d))
    return spark.createDataFrame([(days,)], "recommended_days int")


@query("id_factorise", "SELECT user_key, row_number() OVER (ORDER BY f) customer_id FROM (SELECT 'U' || customer_id user_key, min(event_id) f FROM c_upload WHERE customer_id IS NOT NULL GROUP BY 1)")
def id_factorise(spark, d):
    t = keyed(spark, d).select(F.concat(F.lit("U"), F.col("customer_id").cast("string")).alias("user_key"), "event_id")
    return I.factorise(t, "user_key", "event_id").select("user_key", "customer_id")


@query("granularity_detect", "SELECT count(DISTINCT customer_id) ids, count(*) AS \"rows\", CASE WHEN count(DISTINCT customer_id) / count(*) < 0.5 THEN 'transaction' ELSE 'customer' END AS level FROM c_upload WHERE customer_id IS NOT NULL")
def granularity_detect(spark, d):
    return I.granularity(keyed(spark, d), "customer_id")


cte("c_ext", """SELECT customer_id, round(avg(page_views), 6) ext_num__page_views_mean, sum(page_views)::DOUBLE ext_num__page_views_sum, min(page_views)::DOUBLE ext_num__page_views_min, max(page_views)::DOUBLE ext_num__page_views_max,
 arg_min(campaign_id, event_id) FILTER (campaign_id IS NOT NULL) ext_cat__campaign_id_mode, count(DISTINCT campaign_id) ext_num__campaign_id_nunique,
 round((epoch_us((SELECT max(event_time) FROM c_upload WHERE customer_id IS NOT NULL)) - epoch_us(max(event_time))) / 86400000000.0::DOUBLE, 6) ext_num__event_time_days_since_last FROM c_upload WHERE customer_id IS NOT NULL GROUP BY 1""")


def ext(spark, d):
    e = I.external_features(keyed(spark, d), ["page_views"], ["campaign_id"], ["event_time"], "event_id")
    return e.drop("ext_date__event_time_first", "ext_date__event_time_last").withColumns({c: F.round(c, 6) for c in ("ext_num__page_views_mean", "ext_num__event_time_days_since_last")})


@query("ext_features", "SELECT * FROM c_ext")
def ext_features(spark, d):
    return ext(spark, d)


@query("ext_attach", "SELECT s.customer_id, s.persona, e.customer_id IS NOT NULL AS has_ext, ext_num__page_views_sum, 'up' ext_uploaded__persona FROM c_summary s LEFT JOIN c_ext e USING (customer_id) WHERE e.customer_id IS NOT NULL UNION ALL SELECT customer_id, persona, false, NULL, NULL FROM c_summary WHERE customer_id NOT IN (SELECT customer_id FROM c_ext)")
def ext_attach(spark, d):
    """Left join of the upload features; a clashing name is prefixed."""
    e = ext(spark, d).withColumns({"persona": F.lit("up"), "has": F.lit(True)})
    t = I.attach(plan.customer_summary(spark, d).select("customer_id", "persona"), e)
    return t.select("customer_id", "persona", F.coalesce("has", F.lit(False)).alias("has_ext"), "ext_num__page_views_sum", "ext_uploaded__persona")


@query("summary_reconcile_dupes", "SELECT customer_id, round(avg(k), 6) risk_score, max(amount) amount, arg_max(status, event_id) AS status FROM c_upload WHERE customer_id IS NOT NULL GROUP BY 1")
def summary_reconcile_dupes(spark, d):
    t = keyed(spark, d).select("customer_id", "event_id", F.col("k").alias("risk_score"), "amount", "status")
    return I.reconcile(t, "event_id").withColumn("risk_score", F.round("risk_score", 6))


YES = "(coupon_used IN ('yes', '1'))::INTEGER"
cte("c_known_cols", f"""SELECT *, greatest(e, u)::BIGINT coupon_exposure_count, least(greatest(disc / greatest(amt, 1.0), 0.0), 1.0) dep FROM (SELECT customer_id, sum(amount) amt, sum(discount_amount) disc, sum((campaign_id IS NOT NULL)::INTEGER) e, sum({YES})::BIGINT u,
 avg(session_duration) sess, avg(page_views) pages, mode(refund_reason ORDER BY refund_reason) dummy, count(*) FILTER (refund_reason = 'defect') bad, count(*) FILTER (refund_reason = 'none') good FROM c_upload WHERE customer_id IS NOT NULL GROUP BY 1)""".replace(" mode(refund_reason ORDER BY refund_reason) dummy,", ""))


@query("known_columns_coalesce", """SELECT customer_id, round(amt, 4) monetary, coupon_exposure_count, u coupon_redeem_count, round(dep, 6) discount_dependency_score, round(least(coupon_exposure_count / 3.0, 2.0), 6)::DOUBLE coupon_fatigue_score,
 round(least(0.65 * dep + 0.35 * least(coupon_exposure_count / 3.0::DOUBLE, 2.0) / 2, 1.0), 6) discount_pressure_score, round(least(0.35 + 0.8 * dep, 1.0), 6) price_sensitivity, round(u / greatest(coupon_exposure_count, 1), 6)::DOUBLE coupon_redeem_rate_uploaded,
 round(sess, 6) avg_session_duration_sec_uploaded, CASE WHEN bad >= good THEN 'defect' ELSE 'none' END refund_reason, (CASE WHEN bad >= good THEN 0.65 ELSE 0.1 END)::DOUBLE support_contact_propensity FROM c_known_cols""")
def known_columns_coalesce(spark, d):
    k = I.known_columns(keyed(spark, d))
    r = lambda c, n=6: F.round(c, n).alias(c)
    return k.select("customer_id", r("monetary", 4), "coupon_exposure_count", "coupon_redeem_count", r("discount_dependency_score"), r("coupon_fatigue_score"), r("discount_pressure_score"),
                    r("price_sensitivity"), r("coupon_redeem_rate_uploaded"), r("avg_session_duration_sec_uploaded"), "refund_reason", "support_contact_propensity")


@query("flag_sum", f"SELECT customer_id, sum({YES})::BIGINT used, sum((campaign_id IS NOT NULL)::INTEGER)::BIGINT campaigns FROM c_upload WHERE customer_id IS NOT NULL GROUP BY 1")
def flag_sum(spark, d):
    return keyed(spark, d).groupBy("customer_id").agg(F.sum(I.flag(F.col("coupon_used"))).alias("used"), F.sum(I.flag(F.col("campaign_id"), True)).alias("campaigns"))


def _mode(col, source):
    """The commonest text of each customer, ties to the first in the alphabet."""
    return f"(SELECT customer_id, {col} FROM (SELECT customer_id, {col}, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, {col}) k FROM {source} WHERE {col} IS NOT NULL GROUP BY customer_id, {col}) WHERE k = 1)"


cte("c_bank", """SELECT o_custkey customer_id, c_acctbal balance, o_totalprice card_amount, (600 + c_custkey % 200)::DOUBLE credit_score, CASE WHEN c_acctbal < 0 THEN 30 ELSE 0 END dpd, (o_orderkey % 3)::INTEGER app_login_count,
 c_custkey % 48 relationship_months, o_totalprice * 2 outstanding_balance, o_orderpriority account_type, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END relationship_status, c_mktsegment credit_grade,
 CASE o_orderstatus WHEN 'F' THEN 'Mobile App' WHEN 'O' THEN 'Web' ELSE 'call' END channel, (o_orderkey % 11)::INTEGER points_used, c_custkey % 7 orders_count, c_custkey % 900 customer_age_days, o_orderpriority payment_method
 FROM orders JOIN customer ON c_custkey = o_custkey""")


def bank(spark, d):
    """Account rows under names other than the first of each family."""
    o, c = A.table(spark, d, "orders"), A.table(spark, d, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.select(F.col("o_custkey").alias("customer_id"), F.col("c_acctbal").alias("balance"), F.col("o_totalprice").alias("card_amount"), (600 + F.col("c_custkey") % 200).cast("double").alias("credit_score"),
                    F.when(F.col("c_acctbal") < 0, 30).otherwise(0).alias("dpd"), (F.col("o_orderkey") % 3).cast("int").alias("app_login_count"), (F.col("c_custkey") % 48).alias("relationship_months"),
                    (F.col("o_totalprice") * 2).alias("outstanding_balance"), F.col("o_orderpriority").alias("account_type"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("relationship_status"),
                    F.col("c_mktsegment").alias("credit_grade"), F.when(F.col("o_orderstatus") == "F", "Mobile App").when(F.col("o_orderstatus") == "O", "Web").otherwise("call").alias("channel"),
                    (F.col("o_orderkey") % 11).cast("int").alias("points_used"), (F.col("c_custkey") % 7).alias("orders_count"), (F.col("c_custkey") % 900).alias("customer_age_days"), F.col("o_orderpriority").alias("payment_method"))


@query("finance_enrich", f"""SELECT b.*, coalesce(p.account_type, 'unknown') financial_product, coalesce(s.relationship_status, 'unknown') account_status, coalesce(g.credit_grade, 'unknown') risk_grade FROM (
 SELECT customer_id, max(balance) account_balance_current, round(sum(card_amount), 4) card_spend_total, max(credit_score) credit_score, max(dpd)::DOUBLE delinquency_days, sum(app_login_count)::DOUBLE digital_login_count,
 max(relationship_months)::DOUBLE tenure_months, round(max(outstanding_balance), 4) loan_balance, CASE WHEN max(balance) < 0 THEN 0.55 ELSE 0.1 END::DOUBLE service_contact_propensity,
 round(least(greatest((750 - max(credit_score)) / 350.0, 0), 1), 6)::DOUBLE credit_risk_score, round(least(ln(1 + greatest(max(balance), 0.0)) / 16.0, 1.0), 6) balance_value_score FROM c_bank GROUP BY 1) b
 LEFT JOIN {_mode("account_type", "c_bank")} p USING (customer_id) LEFT JOIN {_mode("relationship_status", "c_bank")} s USING (customer_id) LEFT JOIN {_mode("credit_grade", "c_bank")} g USING (customer_id)""")
def finance_enrich(spark, d):
    r = lambda c, n=6: F.round(c, n).alias(c)
    return I.finance(bank(spark, d)).select(
        "customer_id", "account_balance_current", r("card_spend_total", 4), "credit_score", "delinquency_days", "digital_login_count", "tenure_months", r("loan_balance", 4), "service_contact_propensity",
        r("credit_risk_score"), r("balance_value_score"), "financial_product", "account_status", "risk_grade")


@query("known_columns_profile", f"""SELECT b.*, coalesce(c.channel, 'unknown') acquisition_channel, CASE WHEN lower(c.channel) LIKE '%app%' THEN 'mobile' WHEN lower(c.channel) LIKE '%web%' THEN 'web' ELSE coalesce(c.channel, 'unknown') END device_type,
 coalesce(p.payment_method, 'unknown') payment_method FROM (SELECT customer_id, max(orders_count)::DOUBLE frequency, max(customer_age_days)::DOUBLE customer_age_days_uploaded, sum(points_used)::DOUBLE point_used_total FROM c_bank GROUP BY 1) b
 LEFT JOIN {_mode("channel", "c_bank")} c USING (customer_id) LEFT JOIN {_mode("payment_method", "c_bank")} p USING (customer_id)""")
def known_columns_profile(spark, d):
    return I.known_columns(bank(spark, d)).select("customer_id", "frequency", "customer_age_days_uploaded", "point_used_total", "acquisition_channel", "device_type", "payment_method")


_fin = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.FINANCE_EVENTS.items()) + f" ELSE '{V.FINANCE_OTHER}' END"


@query("finance_alias", f"SELECT event_id transaction_id, customer_id financial_customer_id, {_fin} financial_event_type, amount transaction_amount FROM c_events")
def finance_alias(spark, d):
    e = A.events(spark, d)
    return e.select(F.col("event_id").alias("transaction_id"), F.col("customer_id").alias("financial_customer_id"), I.finance_event_names(F.col("event_type")).alias("financial_event_type"), F.col("amount").alias("transaction_amount"))


@query("churn_label_infer", """SELECT customer_id, max(CASE lower(trim(status)) WHEN 'dormant' THEN 0.5 WHEN 'churned' THEN 1.0 ELSE 0.0 END)::DOUBLE flag_label,
 (floor((epoch_us((SELECT max(event_time) FROM c_upload WHERE customer_id IS NOT NULL)) - epoch_us(max(event_time))) / 86400000000.0::DOUBLE) >= 1)::INTEGER::DOUBLE silence_label FROM c_upload WHERE customer_id IS NOT NULL GROUP BY 1""")
def churn_label_infer(spark, d):
    u = keyed(spark, d)
    latest = scalars(u, t=F.max("event_time"))["t"]
    return u.groupBy("customer_id").agg(F.max(I.churn_label(F.col("status"), None, None, 0)).alias("flag_label"), I.churn_label(None, F.max("event_time"), F.lit(latest), 1).alias("silence_label"))


@query("churn_proxy_score", "SELECT customer_id, round(churn_probability, 6) churn_probability FROM c_churn")
def churn_proxy_score(spark, d):
    return plan.customer_summary(spark, d).select("customer_id", F.round("churn_probability", 6).alias("churn_probability"))


@query("churn_proxy_unlabelled", f"""SELECT customer_id, round(round(least(greatest(1 / (1 + exp(-(ln(rate / (1 - rate)) + 2.15 * ({T.clip(T.rank_pct('behaviour'), 0.001, 0.999)} - 0.5) + 0.65 * (behaviour - mb) + ({T.unit('customer_id')} - 0.5) * 0.0866))), 0.02), 0.82), 9), 6) churn_probability
FROM (SELECT *, least(greatest(0.06 + 0.34 * mb, 0.08), 0.36)::DOUBLE rate FROM (SELECT *, avg(behaviour) OVER () mb FROM c_behaviour))""")
def churn_proxy_unlabelled(spark, d):
    """The same score when the upload carries no label: a cautious prior instead of the label rate."""
    from winback.sources.staging import staged
    base = staged(spark, d, "summary_base", lambda: plan.base_summary(spark, d))
    return scores.churn_proxy(base).select("customer_id", F.round("churn_probability", 6).alias("churn_probability"))


@query("persona_assign", f"""SELECT customer_id, CASE WHEN m >= 0.80 AND f >= 0.70 THEN 'vip_loyal' WHEN m >= 0.50 AND f >= 0.50 THEN 'regular_loyal' WHEN churn_probability >= 0.60 THEN 'churn_progressing'
 WHEN recency_days <= 30 AND frequency <= 2 THEN 'new_signup' WHEN m < 0.30 THEN 'price_sensitive' ELSE 'explorer' END persona_rule FROM (SELECT *, {T.rank_pct('monetary')} m, {T.rank_pct('frequency')} f FROM c_summary)""")
def persona_assign(spark, d):
    return scores.persona(plan.customer_summary(spark, d)).select("customer_id", "persona_rule")


@query("uplift_quadrant", "SELECT customer_id, uplift_segment FROM c_summary")
def uplift_quadrant(spark, d):
    return scores.with_uplift_quadrant(plan.customer_summary(spark, d)).select("customer_id", "uplift_segment")


@query("derived_value_scores", "SELECT customer_id, clv, coupon_cost, expected_incremental_profit, expected_roi, visit_change_rate, purchase_change_rate FROM c_summary")
def derived_value_scores(spark, d):
    s = scores.value_scores(plan.customer_summary(spark, d))
    return s.select("customer_id", "clv", "coupon_cost", "expected_incremental_profit", "expected_roi", "visit_change_rate", "purchase_change_rate")


@query("events_extract", "SELECT event_id, customer_id, event_type, customer_id::VARCHAR || '_' || strftime(event_time, '%Y%m%d') session_id FROM c_upload JOIN c_vmap USING (action) WHERE customer_id IS NOT NULL")
def events_extract(spark, d):
    return I.extract_events(upload(spark, d)).select("event_id", "customer_id", "event_type", "session_id")


@query("orders_from_events", f"""SELECT 'ORD-' || event_id order_id, customer_id, round(amount, 2) gross_amount, round(least(discount_amount, amount), 2) discount_amount, {YES} coupon_used FROM c_upload JOIN c_vmap USING (action) WHERE customer_id IS NOT NULL AND event_type = 'purchase'""")
def orders_from_events(spark, d):
    e = I.extract_events(upload(spark, d))
    o = I.orders_from_events(e)
    return o.select("order_id", "customer_id", "gross_amount", "discount_amount", "coupon_used")
