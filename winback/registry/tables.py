"""The canonical tables as common table expressions over the raw tables."""

from winback.registry.core import cte

UNIT = "((({k} % 1000003) * 7919 + {salt}) % 1000003) / 1000003.0::DOUBLE"


def unit(key: str, salt: int = 12289) -> str:
    return UNIT.format(k=key, salt=salt)


def rank_pct(col: str, part: str = "") -> str:
    """Average-tie percentile rank."""
    p = f"PARTITION BY {part} " if part else ""
    tie = f"PARTITION BY {part + ', ' if part else ''}{col}"
    total = f"PARTITION BY {part}" if part else ""
    return f"((rank() OVER ({p}ORDER BY {col}) + (count(*) OVER ({tie}) - 1) / 2.0) / count(*) OVER ({total}))::DOUBLE"


def mm(col: str) -> str:
    """Min-max scale over the whole frame, 0 when flat."""
    return (f"CASE WHEN max({col}) OVER () - min({col}) OVER () < 1e-12 THEN 0.0 "
            f"ELSE ({col} - min({col}) OVER ()) / (max({col}) OVER () - min({col}) OVER ()) END")


def clip(x: str, lo=None, hi=None) -> str:
    out = x if lo is None else f"greatest({x}, {lo})"
    return out if hi is None else f"least({out}, {hi})"


cte("c_lines", """
SELECT l_orderkey, sum(l_extendedprice) gross, sum(l_extendedprice * l_discount) disc, sum(l_quantity)::INTEGER qty,
       max((l_discount >= 0.08)::INTEGER) coupon,
       sum(l_discount) sd, count(*) nl, sum((l_discount >= 0.05)::INTEGER) nd
FROM lineitem GROUP BY 1""")
cte("c_topline", """
SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity) rn FROM lineitem) WHERE rn = 1""")
cte("c_orders", """
SELECT o_orderkey order_id, o_custkey customer_id, o_orderdate::TIMESTAMP order_time, coalesce(p_type, 'UNKNOWN') item_category,
  coalesce(qty, 0) quantity, round(coalesce(gross, o_totalprice), 2) gross_amount, round(coalesce(disc, 0.0), 4) discount_amount,
  round(round(coalesce(gross, o_totalprice), 2) - round(coalesce(disc, 0.0), 4), 4) net_amount, coalesce(coupon, 0) coupon_used,
  o_orderpriority priority
FROM orders LEFT JOIN c_lines a ON a.l_orderkey = o_orderkey LEFT JOIN c_topline b ON b.l_orderkey = o_orderkey
LEFT JOIN part ON p_partkey = b.l_partkey""")
cte("c_order_events", """
SELECT order_id::VARCHAR event_id, customer_id, order_time event_time, 'purchase' event_type FROM c_orders
UNION ALL
SELECT concat_ws('-', l_orderkey, l_partkey, l_linenumber), customer_id, l_shipdate::TIMESTAMP,
  CASE WHEN l_discount >= 0.08 THEN 'coupon_open' WHEN l_returnflag = 'R' THEN 'support_contact'
       WHEN l_returnflag = 'A' THEN 'page_view' ELSE 'visit' END
FROM lineitem JOIN c_orders ON order_id = l_orderkey""")
cte("c_customers", """
SELECT c_custkey customer_id, c_mktsegment persona, r_name region, c_acctbal account_balance, signup_date,
  strftime(signup_date, '%Y-%m') acquisition_month,
  round(coalesce(sd / nl * 10, 0.5), 9) price_sensitivity, round(coalesce(nd / nl, 0.5), 9) coupon_affinity
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT o_custkey, min(o_orderdate)::TIMESTAMP signup_date, sum(sd) sd, sum(nl)::DOUBLE nl, sum(nd)::DOUBLE nd
  FROM orders LEFT JOIN c_lines ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey""")
cte("c_assign", """
SELECT customer_id, CASE WHEN customer_id % 2 = 1 THEN 'treatment' ELSE 'control' END treatment_group,
  (customer_id % 2)::INTEGER treatment_flag, round(3000 + 12000 * coupon_affinity, 2) coupon_cost, assigned_at
FROM c_customers JOIN (SELECT customer_id, max(order_time) + INTERVAL 1 DAY assigned_at FROM (SELECT customer_id, order_time,
   row_number() OVER (PARTITION BY customer_id ORDER BY order_time, order_id) rn FROM c_orders) WHERE rn <= 2 GROUP BY 1) USING (customer_id)""")
cte("c_exposures", """
SELECT order_id exposure_id, customer_id, order_time exposure_time, coupon_cost FROM c_orders
JOIN c_assign USING (customer_id) WHERE treatment_flag = 1 AND priority IN ('1-URGENT', '2-HIGH')""")
cte("c_events", """
SELECT event_id, user_id customer_id, ts::TIMESTAMP event_time,
  CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'search' WHEN 'signup' THEN 'visit'
    WHEN 'error' THEN 'support_contact' WHEN 'purchase' THEN 'purchase' ELSE 'other' END event_type,
  user_id::VARCHAR || '_' || strftime(ts, '%Y%m%d') session_id, value amount, (props->>'$.k')::INTEGER k
FROM events""")
cte("c_event_orders", """
SELECT event_id order_id, customer_id, event_time order_time, 'C' || (k % 8)::VARCHAR item_category, k % 5 + 1 quantity,
  amount net_amount, (k >= 80)::INTEGER coupon_used FROM c_events WHERE event_type = 'purchase'""")

E = "TIMESTAMP '2000-12-31'"
cte("c_summary_base", f"""
SELECT c.*, coalesce(recency_days, 999) recency_days, coalesce(frequency, 0) frequency, coalesce(monetary, 0.0) monetary,
  coalesce(visits_last_7, 0) visits_last_7, coalesce(visits_prev_7, 0) visits_prev_7,
  round(CASE WHEN coalesce(visits_prev_7, 0) = 0 THEN 0.0 ELSE (visits_last_7 - visits_prev_7) / visits_prev_7 END, 9)::DOUBLE visit_change_rate,
  coalesce(purchase_last_30, 0) purchase_last_30, coalesce(purchase_prev_30, 0) purchase_prev_30,
  round(CASE WHEN coalesce(purchase_prev_30, 0) = 0 THEN 0.0 ELSE (purchase_last_30 - purchase_prev_30) / purchase_prev_30 END, 9)::DOUBLE purchase_change_rate,
  round(coalesce(support / nullif(n_events, 0), 0.0), 9)::DOUBLE support_contact_propensity,
  coalesce(exposure_count, 0) exposure_count,
  least(coalesce(recency_days, 999), coalesce(date_diff('day', last_event::DATE, DATE '2000-12-31'), 999)) inactivity_days,
  round(dep, 9) discount_dependency_score, round(fatigue, 9) coupon_fatigue_score,
  round(least(greatest(0.65 * dep + 0.35 * fatigue / 2, 0.0), 1.0), 9) discount_pressure_score,
  round(least(greatest(1 - 0.25 * least(greatest(0.65 * dep + 0.35 * fatigue / 2, 0.0), 1.0), 0.5), 1.0), 9) discount_effect_penalty,
  (coalesce(recency_days, 999) >= 180)::INTEGER::DOUBLE churn_label_observed
FROM c_customers c LEFT JOIN (
  SELECT customer_id, date_diff('day', max(order_time)::DATE, DATE '2000-12-31') recency_days, count(*) frequency,
    round(sum(net_amount), 4) monetary,
    count(*) FILTER (order_time > {E} - INTERVAL 30 DAY) purchase_last_30,
    count(*) FILTER (order_time > {E} - INTERVAL 60 DAY AND order_time <= {E} - INTERVAL 30 DAY) purchase_prev_30
  FROM c_orders WHERE order_time <= {E} GROUP BY 1) USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) FILTER (event_time > {E} - INTERVAL 7 DAY) visits_last_7,
    count(*) FILTER (event_time > {E} - INTERVAL 14 DAY AND event_time <= {E} - INTERVAL 7 DAY) visits_prev_7,
    count(*) FILTER (event_type = 'support_contact') support, count(*) n_events, max(event_time) last_event
  FROM c_order_events WHERE event_time <= {E} AND event_type <> 'purchase' GROUP BY 1) USING (customer_id)
LEFT JOIN (SELECT cc.customer_id, count(exposure_id) exposure_count FROM c_customers cc LEFT JOIN c_exposures x
    ON x.customer_id = cc.customer_id AND exposure_time <= {E} GROUP BY 1) USING (customer_id)
LEFT JOIN (SELECT cc.customer_id, least(greatest(coalesce(sum(discount_amount), 0.0) / greatest(coalesce(sum(gross_amount), 0.0), 1.0), 0.0), 1.0) dep
    FROM c_customers cc LEFT JOIN c_orders o ON o.customer_id = cc.customer_id AND order_time <= {E} GROUP BY 1) USING (customer_id)
LEFT JOIN (SELECT cc.customer_id, least(count(exposure_id) / 3.0::DOUBLE, 2.0) fatigue FROM c_customers cc LEFT JOIN c_exposures x
    ON x.customer_id = cc.customer_id AND exposure_time <= {E} GROUP BY 1) USING (customer_id)""")

_BEHAVIOUR = f"""round(least(greatest(
  0.28::DOUBLE * {clip(rank_pct('recency_days'), 0.001, 0.999)} + 0.20::DOUBLE * {clip(rank_pct('inactivity_days'), 0.001, 0.999)}
  + 0.16::DOUBLE * (1 - {clip(rank_pct('frequency'), 0.001, 0.999)}) + 0.12::DOUBLE * (1 - {clip(rank_pct('monetary'), 0.001, 0.999)})
  + 0.12::DOUBLE * support_contact_propensity + 0.06::DOUBLE * discount_dependency_score + 0.06::DOUBLE * 0.5, 0.01), 0.99), 9)"""
cte("c_behaviour", f"SELECT *, {_BEHAVIOUR} behaviour FROM c_summary_base")
cte("c_churn", f"""
SELECT * EXCLUDE (behaviour, rate, mb, shifted),
  round(least(greatest(1 / (1 + exp(-(ln(least(greatest(rate, 0.02), 0.98) / (1 - least(greatest(rate, 0.02), 0.98)))
    + 2.35 * ({clip(rank_pct('shifted'), 0.001, 0.999)} - 0.5) + 1.10 * (churn_label_observed - rate) + 0.75 * (behaviour - mb)
    + ({unit('customer_id')} - 0.5) * 0.0866))), 0.02), 0.98), 9) churn_probability
FROM (SELECT *, round(behaviour + 0.35 * (churn_label_observed - rate), 9) shifted FROM (
  SELECT *, least(greatest(avg(churn_label_observed) OVER (), 0.03), 0.97)::DOUBLE rate, avg(behaviour) OVER () mb FROM c_behaviour))""")
cte("c_summary", f"""
SELECT * EXCLUDE (med), round(greatest(clv * uplift_score, -50000), 4) expected_incremental_profit,
  round((round(greatest(clv * uplift_score, -50000), 4) - coupon_cost) / coupon_cost, 6) expected_roi,
  CASE WHEN churn_probability >= 0.45 AND monetary > med THEN 'Persuadables' WHEN churn_probability < 0.45 AND monetary > med THEN 'Sure Things'
       WHEN churn_probability >= 0.45 THEN 'Lost Causes' ELSE 'Sleeping Dogs' END uplift_segment
FROM (SELECT *, round(least(greatest(0.08 + 0.17 * ({unit('customer_id', 31337)} - 0.5) + 0.05 * (churn_probability - 0.5), -0.15), 0.42), 9) uplift_score,
  round(greatest(monetary * (1.30 + 1.25 * least(greatest(1.15 - churn_probability, 0.20), 1.15))
    + frequency * greatest(CASE WHEN frequency = 0 THEN 0.0 ELSE monetary / frequency END, 20000.0) * 0.55, 15000.0), 2) clv,
  floor(least(greatest(monetary * 0.0025, 3000.0), 30000.0))::DOUBLE coupon_cost,
  (SELECT quantile_cont(monetary, 0.5) FROM c_churn) med FROM c_churn)""")
cte("c_survival", f"""
SELECT *, CASE WHEN risk_percentile <= 1/3 THEN 'Low Risk' WHEN risk_percentile <= 2/3 THEN 'Mid Risk' ELSE 'High Risk' END risk_group
FROM (SELECT *, round({rank_pct('predicted_hazard_ratio')}, 9) risk_percentile FROM (
SELECT customer_id, round(churn_probability / (SELECT avg(churn_probability) FROM c_summary), 9) predicted_hazard_ratio,
  least(ceil(round(30 * ln(0.5::DOUBLE) / ln(1 - churn_probability), 6)), 90)::DOUBLE predicted_median_time_to_churn_days,
  round(pow(1 - churn_probability, 1/30.0::DOUBLE), 9) survival_prob_1d, round(pow(1 - churn_probability, 1.0), 9) survival_prob_30d,
  round(pow(1 - churn_probability, 2.0), 9) survival_prob_60d, round(pow(1 - churn_probability, 3.0), 9) survival_prob_90d
FROM c_summary))""")
