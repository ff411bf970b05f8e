"""What each action would be worth for a customer: five scenarios, the best one, and how sure we are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winback.functions.scalars import clip, first_of, minmax, scalars

# Action, label, cost, uplift multiplier, channel.
ACTIONS = [
    ("no_action", "무개입", 0.0, 0.0, "none"),
    ("coupon_5000", "5,000원 혜택", 5000.0, 1.00, "benefit"),
    ("consult_call", "상담 전화", 12000.0, 1.18, "call_center"),
    ("push_email", "푸시/이메일", 800.0, 0.42, "owned_message"),
    ("wait_7d", "7일 대기", 0.0, 0.0, "defer"),
]
# Confidence labels.
SURE, FAIR, WEAK = "높음", "중간", "낮음"
# Reason texts. {a} is the action, {d} the gain, {c} the churn share, {u} the uplift.
REASON_NONE = "개입 비용이 효과보다 크거나 고객 반응 가능성이 낮아, 지금은 아무 조치를 하지 않는 편이 예상 순이익이 가장 높습니다."
REASON_WAIT = ("지금 바로 개입하기보다 7일 동안 고객 행동을 더 지켜보는 편이 예상 순이익이 높습니다. 현재 이탈 가능성은 ", ", 개입 반응 가능성은 ", " 수준입니다.")
REASON_GAIN = ("을 선택하면 아무것도 하지 않을 때보다 ", " 정도 나아질 것으로 보입니다. ")
REASON_TAIL = {
    WEAK: "다만 신뢰도가 낮으므로 바로 전체 고객에게 적용하지 말고 A/B 검증이나 검증용 미개입군을 함께 두는 것이 좋습니다.",
    FAIR: "신뢰도는 중간 수준이므로 실험군과 대조군을 함께 운영해 실제 효과를 확인하는 것이 안전합니다.",
    SURE: "입력 신호가 비교적 충분해 우선 실행 후보로 볼 수 있습니다.",
}


def pool(customers: DataFrame, selected: DataFrame, threshold: float) -> DataFrame:
    """Selected and at-risk customers, one row each, with the selected action's columns added."""
    base = customers.withColumns({
        "churn_probability": clip(first_of(customers, ["churn_probability", "realtime_churn_score", "churn_score"]), 0.0, 1.0),
        "uplift_score": clip(first_of(customers, ["uplift_score", "expected_uplift"]), -0.30, 0.60),
        "clv": F.greatest(first_of(customers, ["predicted_clv_12m", "clv", "monetary"]), F.lit(0.0))})
    extra = selected.select("customer_id", F.lit(1).alias("was_selected"), F.col("intervention_intensity"), F.col("priority_score"),
                            F.col("selection_score"))
    j = base.join(extra, "customer_id", "left")
    return j.where((F.col("churn_probability") >= threshold) | F.col("was_selected").isNotNull())


def with_rank_score(timed: DataFrame) -> DataFrame:
    """Clamp the timing columns and add the rank score that orders the pool."""
    t = timed.withColumns({"timing_urgency_score": clip(F.col("timing_urgency_score"), 0.0, 1.0),
                           "churn_timing_weight": clip(F.col("churn_timing_weight"), 0.60, 1.60),
                           "intervention_window_days": clip(F.col("intervention_window_days").cast("double"), 1.0)})
    m = minmax(t, "clv")["clv"]
    return t.withColumn("rank_score", 0.34 * F.col("churn_probability") + 0.26 * F.greatest(F.col("uplift_score"), F.lit(0.0))
                        + 0.20 * m + 0.20 * F.col("timing_urgency_score"))


def action_fits(base: DataFrame) -> dict[str, Column]:
    m = minmax(base, "clv", "coupon_affinity", "price_sensitivity", "discount_pressure_score")
    p, u, urg = F.col("churn_probability"), F.col("uplift_score"), F.col("timing_urgency_score")
    tired = m["discount_pressure_score"]
    raw = {
        "coupon_5000": 0.82 + 0.22 * m["coupon_affinity"] + 0.22 * m["price_sensitivity"] + 0.12 * urg - 0.18 * tired,
        "consult_call": 0.78 + 0.25 * m["clv"] + 0.18 * p + 0.14 * urg - 0.08 * m["coupon_affinity"],
        "push_email": 0.68 + 0.18 * F.greatest(u, F.lit(0.0)) + 0.12 * (1 - tired) + 0.10 * (1 - urg)}
    return {k: clip(v, 0.25, 1.35) for k, v in raw.items()}


def _with_outcomes(base: DataFrame) -> DataFrame:
    """Add lift_*, treated_*, option_* and net_* for every action, one layer of columns at a time."""
    p, v, u = F.col("churn_probability"), F.col("clv"), F.col("uplift_score")
    w, urg, days = F.col("churn_timing_weight"), F.col("timing_urgency_score"), F.col("intervention_window_days")
    b = base.withColumns({f"fit_{k}": f for k, f in action_fits(base).items()})
    lift, treated, option = {}, {}, {}
    for name, _, _, mult, _ in ACTIONS:
        option[f"option_{name}"] = F.lit(0.0)
        lift[f"lift_{name}"] = F.lit(0.0)
        if name == "wait_7d":
            risk = F.least(7.0 / days, F.lit(1.0)) * (0.05 + 0.22 * urg + 0.20 * p)
            lift[f"lift_{name}"] = p - F.least(p + risk, F.lit(1.0))
            option[f"option_{name}"] = F.greatest(0.018 * v * (1 - urg) * F.greatest(u, F.lit(0.0)), F.lit(0.0))
        elif name != "no_action":
            lift[f"lift_{name}"] = F.least(F.greatest(u * mult * w * F.col(f"fit_{name}"), F.lit(-0.25)), F.lit(0.45), p)
        treated[f"treated_{name}"] = F.least(F.greatest(p - F.col(f"lift_{name}"), F.lit(0.0)), F.lit(1.0))
    nets = {f"net_{n}": v * (1 - F.col(f"treated_{n}")) + F.col(f"option_{n}") - cost for n, _, cost, _, _ in ACTIONS}
    return b.withColumns({**lift, **option}).withColumns(treated).withColumns(nets)


def scenarios(base: DataFrame) -> DataFrame:
    """Customer x action rows."""
    got = _with_outcomes(base)
    rows = F.array(*[F.struct(
        F.lit(n).alias("action_id"), F.lit(label).alias("action_label"), F.lit(channel).alias("channel"), F.lit(cost).alias("action_cost"),
        F.col(f"treated_{n}").alias("treated_churn_probability"), F.col(f"lift_{n}").alias("estimated_retention_lift"),
        F.col(f"option_{n}").alias("option_value"), F.col(f"net_{n}").alias("expected_net_profit"),
        (F.col(f"net_{n}") - F.col("net_no_action")).alias("incremental_vs_no_action")) for n, label, cost, _, channel in ACTIONS])
    s = got.select("customer_id", "churn_probability", F.explode(rows).alias("s")).select("customer_id", "churn_probability", "s.*")
    return s.withColumn("estimated_churn_delta", F.col("treated_churn_probability") - F.col("churn_probability")).withColumn(
        "expected_roi", F.when(F.col("action_cost") > 0, F.col("incremental_vs_no_action") / F.col("action_cost")))


def best_actions(base: DataFrame) -> DataFrame:
    """One row per customer: best action, gain, margin to the second best, confidence and the A/B flag."""
    b = _with_outcomes(base)
    nets = [F.col(f"net_{a[0]}") for a in ACTIONS]
    top = F.array_max(F.array(*[F.struct(n.alias("net"), F.lit(-i).alias("i")) for i, n in enumerate(nets)]))
    ids, labels = F.array(*[F.lit(a[0]) for a in ACTIONS]), F.array(*[F.lit(a[1]) for a in ACTIONS])
    b = b.withColumns({"_top": top, "_second": F.element_at(F.sort_array(F.array(*nets), asc=False), 2)})
    signals = {"churn_probability": 0.18, "uplift_score": 0.18, "clv": 0.16, "intervention_window_days": 0.13, "timing_urgency_score": 0.10}
    have = scalars(base, **{c: F.count(c) for c in signals})
    known = 0.25 + sum(w for c, w in signals.items() if have[c])
    value = F.when(F.col("clv") > 0, F.col("clv")).otherwise(1.0)
    b = b.withColumn("decision_margin", F.greatest(F.col("_top.net") - F.col("_second"), F.lit(0.0)))
    score = (0.55 * known + 0.25 * F.least(F.col("decision_margin") / value, F.lit(0.35)) / 0.35
             + 0.20 * F.least(F.abs("uplift_score"), F.lit(0.20)) / 0.20)
    b = b.withColumns({
        "best_action_id": F.element_at(ids, 1 - F.col("_top.i")), "final_recommendation": F.element_at(labels, 1 - F.col("_top.i")),
        "best_expected_net_profit": F.col("_top.net"), "incremental_vs_no_action": F.col("_top.net") - F.col("net_no_action"),
        "confidence_score": F.least(score, F.lit(1.0))})
    b = b.withColumn("confidence", F.when(F.col("confidence_score") >= 0.74, SURE).when(F.col("confidence_score") >= 0.50, FAIR).otherwise(WEAK))
    small = F.abs("incremental_vs_no_action") < value * 0.02
    return b.withColumn("ab_test_recommended", ((F.col("confidence") != SURE) | small).cast("int")).drop("_top", "_second")


def reason(best: DataFrame) -> Column:
    gain = F.col("incremental_vs_no_action")
    delta = F.concat(F.when(gain >= 0, "+").otherwise("-"), F.format_number(F.abs(gain), 0), F.lit("원"))
    act = F.col("final_recommendation")
    tail = F.when(F.col("confidence") == WEAK, REASON_TAIL[WEAK]).when(F.col("confidence") == FAIR, REASON_TAIL[FAIR]).otherwise(REASON_TAIL[SURE])
    wait = F.concat(F.lit(REASON_WAIT[0]), F.format_string("%.1f%%", F.col("churn_probability") * 100), F.lit(REASON_WAIT[1]),
                    F.format_string("%.3f", F.col("uplift_score")), F.lit(REASON_WAIT[2]))
    return (F.when(act == ACTIONS[0][1], REASON_NONE).when(act == ACTIONS[4][1], wait)
            .otherwise(F.concat(act, F.lit(REASON_GAIN[0]), delta, F.lit(REASON_GAIN[1]), tail)))
