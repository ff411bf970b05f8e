"""Reasons in words: percentile rules for risk, lever and guardrail, and threshold reasons per customer."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winback.functions.ranking import with_rank_pct

# Rule column, direction, percentile, code, text.
RISK = [
    ("inactivity_days", "high", 0.80, "extended_inactivity", "장기간 비활성 상태가 이어졌습니다."),
    ("recency_days", "high", 0.80, "purchase_recency_drop", "최근 구매 공백이 길어졌습니다."),
    ("visit_change_rate", "low", 0.20, "visit_decline", "최근 방문 빈도가 눈에 띄게 감소했습니다."),
    ("purchase_change_rate", "low", 0.20, "purchase_decline", "최근 구매 빈도가 감소했습니다."),
    ("support_contact", "high", 0.80, "support_contact_spike", "문의/불만성 접촉이 증가했습니다."),
    ("cart_conversion_change_rate", "low", 0.20, "cart_conversion_drop", "장바구니에서 구매로 이어지는 전환이 약해졌습니다."),
    ("purchase_cycle_anomaly", "high", 0.80, "purchase_cycle_break", "평소 구매 주기 대비 이탈 징후가 커졌습니다."),
]
# Levers.
LEVER = [
    ("uplift_score", "high", 0.70, "high_uplift", "개입 시 행동을 바꿀 가능성이 상대적으로 높습니다."),
    ("coupon_affinity", "high", 0.70, "coupon_affinity", "쿠폰/프로모션 반응 성향이 높습니다."),
    ("clv", "high", 0.75, "high_clv", "고객 생애가치가 높아 방어 우선순위가 큽니다."),
    ("timing_urgency_score", "high", 0.70, "timing_urgent", "개입 시점을 늦추면 효과가 빠르게 떨어질 수 있습니다."),
]
# Guardrails.
GUARD = [
    ("discount_pressure_score", "high", 0.75, "discount_pressure", "프로모션 과다 노출 위험이 커 강한 쿠폰 개입은 비효율적일 수 있습니다."),
    ("coupon_fatigue_score", "high", 0.75, "coupon_fatigue", "최근 혜택 노출이 누적돼 반응 피로가 관찰됩니다."),
    ("brand_sensitivity", "high", 0.70, "brand_sensitivity", "브랜드/정가 훼손 민감도가 높아 공격적 할인은 주의가 필요합니다."),
]
# Texts where no rule holds, and the note on intensity.
FALLBACK_RISK = ("high_churn_score", "예측 이탈 점수가 높습니다.")
FALLBACK_LEVER = ("positive_expected_roi", "예상 ROI가 양수여서 개입 타당성이 있습니다.")
NO_GUARD = "특별한 과다혜택 경고 신호는 크지 않습니다."
CAP_NOTE = "고강도 개입 전 빈도 캡 필요"
# Threshold reasons and watch-outs.
REASONS = ["이탈 위험이 높음", "개입 반응 가능성이 큼", "고객 가치가 높음", "개입 시한이 촉박함", "예상 ROI가 양호함", "할인 반응성이 높은 편", "최근 쿠폰 노출이 누적됨"]
NO_REASON = "핵심 신호를 종합해 관찰 대상에 포함"
WATCH = ["과도한 쿠폰 학습 가능성", "할인 없이는 반응 저하 가능", "서비스 이슈형 대응 검토", "단기 이탈 가속 주의"]
NO_WATCH = "가격·서비스·타이밍 리스크를 함께 점검"


def rule_columns(df: DataFrame) -> dict[str, str]:
    """Rule name -> the frame's column for it; features of a window carry its days at the end, the shortest window counts."""
    out = {}
    for name, *_ in RISK + LEVER + GUARD:
        windows = sorted(int(m[1]) for c in df.columns if (m := re.fullmatch(rf"{name}_(\d+)d", c)))
        if name in df.columns:
            out[name] = name
        elif windows:
            out[name] = f"{name}_{windows[0]}d"
    return out


def percentiles(df: DataFrame) -> DataFrame:
    """Average-tie percentile of every rule column the frame has, NULL as 0."""
    cols = rule_columns(df)
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols.values()})
    return with_rank_pct(filled, {c: f"pct_{name}" for name, c in cols.items()})


def _hits(df: DataFrame, rules: list[tuple], extra: Column | None = None) -> Column:
    cells = []
    for col, way, cut, code, text in rules:
        if f"pct_{col}" in df.columns:
            # ranks are multiples of 1/(2n): rounding keeps a rank on the threshold on the right side
            p = F.round(f"pct_{col}", 9)
            hit = p >= cut if way == "high" else p <= cut
            cells.append(F.when(hit, F.struct(F.lit(code).alias("code"), F.lit(col).alias("col"), F.lit(text).alias("text"))))
    found = F.array_compact(F.array(*cells))
    return found if extra is None else F.when(F.size(found) == 0, F.array_compact(F.array(extra))).otherwise(found)


def explain(ranked: DataFrame) -> DataFrame:
    """First 3 / 2 / 2 risk, lever and guardrail hits, their texts, and the action note."""
    made = lambda code, col, text: F.struct(F.lit(code).alias("code"), F.lit(col).alias("col"), F.lit(text).alias("text"))
    t = ranked.withColumns({
        "_r": _hits(ranked, RISK, F.when(F.col("churn_probability") >= 0.5, made(FALLBACK_RISK[0], "churn_probability", FALLBACK_RISK[1]))),
        "_l": _hits(ranked, LEVER, F.when(F.col("expected_roi") > 0, made(FALLBACK_LEVER[0], "expected_roi", FALLBACK_LEVER[1]))),
        "_g": _hits(ranked, GUARD)})
    take = lambda c, n, f, sep: F.array_join(F.transform(F.slice(c, 1, n), lambda x: x[f]), sep)
    capped = (F.size("_g") > 0) & (F.col("intervention_intensity") == "high")
    return t.select(
        "customer_id", "persona", "uplift_segment", take("_r", 3, "code", ", ").alias("risk_reason_codes"), take("_r", 3, "text", " / ").alias("risk_reason_text"),
        take("_l", 2, "code", ", ").alias("action_reason_codes"), take("_l", 2, "text", " / ").alias("action_reason_text"),
        take("_g", 2, "code", ", ").alias("guardrail_codes"), F.when(F.size("_g") == 0, NO_GUARD).otherwise(take("_g", 2, "text", " / ")).alias("guardrail_text"),
        F.array_join(F.concat(F.transform(F.slice("_r", 1, 2), lambda x: x["col"]), F.transform(F.slice("_l", 1, 2), lambda x: x["col"])), ", ").alias("dominant_features"),
        F.when(capped, CAP_NOTE).otherwise("").alias("recommended_action_note"))


def reason_counts(explained: DataFrame, n: int = 10) -> DataFrame:
    codes = explained.select(F.explode(F.split("risk_reason_codes", ", ")).alias("code")).where("code <> ''")
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("customers")).orderBy(F.desc("customers"), "code").limit(n)


def _texts(flags: list[Column], names: list[str], n: int, none: str) -> Column:
    found = F.array_compact(F.array(*[F.when(f, F.lit(t)) for f, t in zip(flags, names)]))
    return F.when(F.size(found) == 0, none).otherwise(F.array_join(F.slice(found, 1, n), ", "))


def customer_reasons(df: DataFrame) -> DataFrame:
    """Selection reason (first 4) and watch-out (first 3) from plain thresholds."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    why = [c("churn_probability") >= 0.6, c("uplift_score") >= 0.02, c("clv") >= 1_000_000, F.coalesce(F.col("intervention_window_days") <= 7, F.lit(False)),
           c("expected_roi") >= 0.3, (c("coupon_affinity") >= 0.7) & (c("price_sensitivity") >= 0.7), c("exposure_count") >= 3]
    care = [c("exposure_count") >= 3, c("price_sensitivity") >= 0.8, c("support_contact_propensity") >= 0.5,
            F.coalesce(F.lower("risk_group").startswith("high"), F.lit(False))]
    return df.withColumn("selection_reason", _texts(why, REASONS, 4, NO_REASON)).withColumn("watchout", _texts(care, WATCH, 3, NO_WATCH))
