"""Timing, segments, actions and scores: what each candidate (customer, action) pair is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winback.functions.ranking import quantile_values
from winback.functions.scalars import clip, col_or_lit, first_of, literal_map, minmax, ratio

# Offer profile of each intensity.
INTENSITIES = {
    "low": {"label": "저강도", "cost_multiplier": 0.65, "base_effect": 0.88, "timing_weight": 0.96, "elasticity": 0.28, "discount_drag": 0.08},
    "mid": {"label": "중강도", "cost_multiplier": 1.00, "base_effect": 1.00, "timing_weight": 1.00, "elasticity": 0.22, "discount_drag": 0.14},
    "high": {"label": "고강도", "cost_multiplier": 1.45, "base_effect": 0.98, "timing_weight": 1.02, "elasticity": 0.18, "discount_drag": 0.22},
}

# Segment bias per intensity (low, mid, high), by customer segment and by uplift segment.
SEGMENT_BIAS = {
    "High Value-Persuadables": (0.95, 1.08, 1.18),
    "High Value-Sure Things": (1.05, 0.92, 0.78),
    "High Value-Lost Causes": (0.88, 0.80, 0.68),
    "Low Value-Persuadables": (1.10, 0.98, 0.84),
    "Low Value-Sure Things": (1.06, 0.90, 0.74),
    "Low Value-Lost Causes": (0.82, 0.72, 0.58),
    "New Customers": (1.02, 0.94, 0.86),
}
UPLIFT_BIAS = {
    "Persuadables": (1.02, 1.08, 1.12),
    "Sure Things": (1.04, 0.92, 0.76),
    "Lost Causes": (0.84, 0.74, 0.60),
    "Sleeping Dogs": (0.84, 0.74, 0.60),
}

# Strategy name, cost and effect multiplier of each segment.
STRATEGIES = {
    "High Value-Persuadables": ("VIP 고객 전담 상담 및 맞춤 혜택 안내", 30000.0, 1.15),
    "High Value-Sure Things": ("충성 고객 감사 안내", 8000.0, 0.15),
    "High Value-Lost Causes": ("담당자 심층 상담", 12000.0, 0.10),
    "Low Value-Persuadables": ("맞춤 혜택 안내", 7000.0, 0.85),
    "Low Value-Lost Causes": ("미개입 관찰", 0.0, 0.0),
    "Low Value-Sure Things": ("가벼운 재방문 안내", 3000.0, 0.05),
    "New Customers": ("가입 초기 이용 안내", 5000.0, 0.20),
}
DEFAULT_STRATEGY = "기본 고객 유지 혜택 안내"

# Contact window texts up to 14, 30 and 60 days; later ones are watched.
WINDOW_TEXTS = ("14일 이내 즉시 연락", "15~30일 안에 연락", "31~60일 안에 계획적으로 연락")


def watch_text(horizon: int) -> str:
    return f"{min(horizon, 60)}일 이후 관찰"


def uplift_segment(uplift: Column, churn: Column, band: float = 0.02) -> Column:
    return (F.when(uplift < 0, "Sleeping Dogs").when((uplift > band) & (churn >= 0.5), "Persuadables")
            .when(churn >= 0.5, "Lost Causes").otherwise("Sure Things"))


def with_timing(df: DataFrame, survival: DataFrame | None, horizon: int = 90) -> DataFrame:
    """Attach survival columns and turn them into urgency, weight, contact window and bucket."""
    if survival is None:
        fixed = {"predicted_hazard_ratio": 1.0, "predicted_median_time_to_churn_days": float(horizon), "risk_percentile": 0.0,
                 "risk_group": "Unknown", "short_term_survival_probability": 1.0, "short_term_churn_probability": 0.0,
                 "mid_term_survival_probability": 1.0, "mid_term_churn_probability": 0.0, "timing_urgency_score": 0.0,
                 "churn_timing_weight": 1.0, "intervention_window_days": horizon,
                 "recommended_intervention_window": watch_text(horizon), "timing_priority_bucket": "monitor"}
        return df.withColumns({n: F.lit(v) for n, v in fixed.items()})
    days = sorted(int(c[14:-1]) for c in survival.columns if c.startswith("survival_prob_"))
    h = max(days) if days else horizon

    def nearest(target: int) -> Column:
        if not days:
            return F.lit(1.0)
        best = min(days, key=lambda v: (abs(v - min(target, h)), v))
        return clip(F.coalesce(F.col(f"survival_prob_{best}d"), F.lit(1.0)), 0.0, 1.0)

    out = df.join(survival, "customer_id", "left")
    hazard = clip(F.coalesce("predicted_hazard_ratio", F.lit(1.0)), 0.0)
    fallback = minmax(out, risk=F.log1p(hazard))["risk"]
    median = clip(F.coalesce("predicted_median_time_to_churn_days", F.lit(float(h))), 1.0, float(h))
    out = out.withColumns({
        "predicted_hazard_ratio": hazard, "predicted_median_time_to_churn_days": median,
        "risk_percentile": clip(F.coalesce("risk_percentile", fallback), 0.0, 1.0),
        "risk_group": F.coalesce("risk_group", F.lit("Unknown")),
        "short_term_survival_probability": nearest(30), "mid_term_survival_probability": nearest(60)})
    urgency = clip(0.45 * F.col("risk_percentile") + 0.35 * (1 - F.col("short_term_survival_probability"))
                   + 0.20 * (1 - clip(F.col("predicted_median_time_to_churn_days") / float(h), 0.0, 1.0)), 0.0, 1.0)
    window = clip(F.bround("predicted_median_time_to_churn_days", 0).cast("int"), 1, h)
    out = out.withColumns({
        "short_term_churn_probability": 1 - F.col("short_term_survival_probability"),
        "mid_term_churn_probability": 1 - F.col("mid_term_survival_probability"),
        "timing_urgency_score": F.round(urgency, 6), "churn_timing_weight": F.round(0.85 + 0.60 * urgency, 6),
        "intervention_window_days": window})
    w = F.col("intervention_window_days")
    names = lambda a, b, c, d: F.when(w <= 14, a).when(w <= 30, b).when(w <= 60, c).otherwise(d)
    return out.withColumns({
        "recommended_intervention_window": names(*WINDOW_TEXTS, watch_text(h)),
        "timing_priority_bucket": names("immediate", "near_term", "planned", "monitor")}).drop(
        *[f"survival_prob_{t}d" for t in days])


def value_uplift_segments(df: DataFrame, clv: str = "clv", uplift: str = "uplift_score") -> DataFrame:
    """Seven named segments from tenure, the top fifth by value, and the uplift segment."""
    cut = quantile_values(df, clv, [0.8])[0]
    seg = F.col("uplift_segment")
    kind = F.when(seg == "Persuadables", "Persuadables").when(seg.isin("Lost Causes", "Sleeping Dogs"), "Lost Causes").otherwise("Sure Things")
    new = (F.coalesce("tenure_days", F.lit(0)) < 90) | (F.col("persona") == "new_signup")
    return (df.withColumn("is_high_value_top20pct", (F.col(clv) >= F.lit(cut)).cast("int"))
            .withColumn("is_new_customer", F.coalesce(new, F.lit(False)).cast("int"))
            .withColumn("retention_priority_score", F.greatest(F.col(uplift), F.lit(0.0)) * F.col(clv))
            .withColumn("customer_segment", F.when(F.col("is_new_customer") == 1, "New Customers").otherwise(
                F.concat(F.when(F.col("is_high_value_top20pct") == 1, "High Value-").otherwise("Low Value-"), kind))))


def with_strategy(df: DataFrame) -> DataFrame:
    seg = F.col("customer_segment")
    return df.withColumns({
        "strategy_name": F.coalesce(literal_map({k: v[0] for k, v in STRATEGIES.items()}, seg), F.lit(DEFAULT_STRATEGY)),
        "strategy_cost": F.coalesce(literal_map({k: v[1] for k, v in STRATEGIES.items()}, seg), F.lit(0.0)),
        "strategy_effect_multiplier": F.coalesce(
            F.greatest(literal_map({k: v[2] for k, v in STRATEGIES.items()}, seg), F.lit(0.1)), F.lit(1.0))})


def budgetable(df: DataFrame) -> DataFrame:
    """Fill missing or zero economics from their aliases, then from each other, in a fixed order."""
    pos = lambda *n: first_of(df, list(n), positive=True)
    above = lambda c: F.when(c > 0, c)
    churn = clip(F.coalesce(first_of(df, ["churn_probability", "churn_score", "risk_score"]), F.lit(0.0)), 0.0, 1.0)
    money = above(first_of(df, ["monetary"]) * 6.0)
    clv = F.greatest(F.coalesce(pos("clv", "predicted_clv_12m", "predicted_clv", "customer_lifetime_value", "ltv"), money,
                                F.lit(50000.0)), F.lit(1.0))
    profit = pos("expected_incremental_profit", "expected_profit", "incremental_profit", "expected_net_profit")
    roi = pos("expected_roi", "roi")
    uplift = F.greatest(F.coalesce(pos("uplift_score", "uplift", "incremental_response", "treatment_effect"),
                                   above(profit / clv), F.lit(0.03)), F.lit(0.001))
    cost = F.greatest(F.coalesce(pos("strategy_cost", "coupon_cost", "action_cost", "intervention_cost", "cost"),
                                 above(F.try_divide(profit, roi)), clip(clv * 0.12, 10000.0, 80000.0)), F.lit(1.0))
    coupon = F.coalesce(pos("coupon_cost"), cost)
    gain = F.greatest(F.coalesce(profit, above(roi * cost), clv * uplift * F.greatest(churn, F.lit(0.50))), F.lit(0.0))
    seg = F.trim(F.col("uplift_segment")) if "uplift_segment" in df.columns else F.lit(None).cast("string")
    blank = seg.isNull() | F.lower(seg).isin("", "nan", "none", "unknown", "live", "unknown_segment")
    inferred = F.when(~(gain > 0), "Lost Causes").when(uplift < 0.02, "Sure Things").otherwise("Persuadables")
    return df.withColumns({
        "churn_probability": churn, "clv": clv, "uplift_score": uplift, "strategy_cost": cost, "coupon_cost": coupon,
        "expected_incremental_profit": gain, "expected_roi": F.coalesce(roi, ratio(gain, cost)),
        "uplift_segment": F.when(blank, inferred).otherwise(seg)})


def action_base(df: DataFrame, survival: DataFrame | None) -> DataFrame:
    """One row per customer, ready to be offered each intensity."""
    if "strategy_name" not in df.columns:
        df = df.withColumn("strategy_name", F.lit(DEFAULT_STRATEGY))
    if "strategy_effect_multiplier" not in df.columns:
        df = df.withColumn("strategy_effect_multiplier", F.lit(1.0))
    if "strategy_cost" not in df.columns:
        df = df.withColumn("strategy_cost", F.greatest(col_or_lit(df, "coupon_cost", 0.0), F.lit(0.0)))
    base = with_timing(df, survival)
    scaled = minmax(base, coupon_affinity_norm=col_or_lit(base, "coupon_affinity", 0.0),
                    price_sensitivity_norm=col_or_lit(base, "price_sensitivity", 0.0),
                    uplift_score_norm=F.col("uplift_score"), window_rank_score=F.col("intervention_window_days"),
                    discount_norm=col_or_lit(base, "discount_pressure_score", 0.0),
                    brand_norm=col_or_lit(base, "brand_sensitivity", 0.0))
    return base.withColumns(scaled).withColumn("base_net_incremental_profit", F.greatest(F.col("expected_incremental_profit"), F.lit(0.0)))


def explode_intensities(base: DataFrame, cost_multipliers: dict[str, float] | None = None) -> DataFrame:
    """Customer x {low, mid, high}, with the price of each offer."""
    learned = cost_multipliers or {}
    seg = col_or_lit(base, "customer_segment", "")
    offers = []
    for i, (name, p) in enumerate(INTENSITIES.items()):
        bias = F.coalesce(literal_map({k: v[i] for k, v in SEGMENT_BIAS.items()}, seg),
                          literal_map({k: v[i] for k, v in UPLIFT_BIAS.items()}, F.col("uplift_segment")), F.lit(1.0))
        mult = min(max(learned[name], 0.35), 2.10) if name in learned else p["cost_multiplier"]
        offers.append(F.struct(
            F.lit(name).alias("intervention_intensity"), F.lit(p["label"]).alias("intervention_intensity_label"),
            F.lit(mult).alias("intensity_cost_multiplier"), F.lit(p["base_effect"] * p["timing_weight"]).alias("_effect"),
            F.lit(p["elasticity"]).alias("_elastic"), F.lit(p["discount_drag"]).alias("_drag"), bias.alias("segment_intensity_bias")))
    keep = [c for c in base.columns if c != "coupon_cost"]
    out = base.select(*keep, F.explode(F.array(*offers)).alias("_o")).select(*keep, "_o.*")
    return out.withColumn("coupon_cost", F.round(F.col("strategy_cost") * F.col("intensity_cost_multiplier"), 2)).withColumn(
        "action_id", F.concat_ws("::", F.col("customer_id").cast("string"), "intervention_intensity"))


def heuristic_effect(actions: DataFrame) -> DataFrame:
    """Profit of each offer from readiness, urgency, segment bias, intensity fit and the fatigue guard."""
    aff, price, upl = F.col("coupon_affinity_norm"), F.col("price_sensitivity_norm"), F.col("uplift_score_norm")
    urg, win = F.col("timing_urgency_score"), F.col("window_rank_score")
    ready = clip(0.38 * aff + 0.20 * price + 0.22 * upl + 0.20 * urg, 0.0, 1.0)
    press = clip(0.55 * urg + 0.25 * F.col("risk_percentile") + 0.20 * (1 - win), 0.0, 1.0)
    gentle = clip(0.55 * aff + 0.45 * upl, 0.0, 1.0)
    kind = F.col("intervention_intensity")
    fit = (F.when(kind == "low", 0.86 + 0.18 * gentle + 0.08 * (1 - press))
           .when(kind == "mid", 0.94 + 0.12 * ready + 0.06 * press)
           .otherwise(0.72 + 0.18 * ready + 0.16 * press + 0.08 * aff + 0.06 * price - 0.14 * (1 - ready)))
    guard = clip(1 - F.col("_drag") * F.col("discount_norm") - 0.06 * F.col("brand_norm"), 0.55, 1.0)
    mult = clip(F.col("_effect") * F.col("segment_intensity_bias") * fit * (1 + F.col("_elastic") * (ready - 0.5)) * guard, 0.30, 1.25)
    out = actions.withColumns({"fatigue_guardrail_multiplier": guard, "intensity_effect_multiplier": mult})
    cost = F.col("coupon_cost")
    gain = F.greatest(F.col("base_net_incremental_profit") * F.col("churn_timing_weight") * F.col("intensity_effect_multiplier")
                      - (cost - F.col("strategy_cost")), -cost)
    return _with_return(out.withColumn("expected_incremental_profit", gain))


def learned_effect(actions: DataFrame, effect: Column) -> DataFrame:
    """Profit of each offer from a fitted dose response, the value basis, timing and the fatigue guard."""
    basis = F.greatest(F.coalesce(*[F.col(c) for c in ("predicted_clv_12m", "clv") if c in actions.columns], F.lit(0.0)), F.lit(0.0))
    cost = F.col("coupon_cost")
    guard = clip(1 - 0.18 * F.col("discount_norm") - 0.05 * F.col("brand_norm"), 0.55, 1.0)
    out = actions.withColumns({"dose_response_incremental_effect": clip(effect, -0.35, 0.75), "fatigue_guardrail_multiplier": guard})
    eff = F.col("dose_response_incremental_effect")
    revenue = F.greatest(eff * F.col("strategy_effect_multiplier") * basis * F.col("churn_timing_weight"), F.lit(0.0))
    out = out.withColumn("intensity_effect_multiplier", clip(F.abs(eff) / F.greatest(F.abs(F.col("uplift_score")), F.lit(0.02)), 0.20, 2.50))
    return _with_return(out.withColumn("expected_incremental_profit",
                                       F.greatest(revenue * F.col("fatigue_guardrail_multiplier") - cost, -cost)))


def _with_return(out: DataFrame) -> DataFrame:
    cost, gain = F.col("coupon_cost"), F.col("expected_incremental_profit")
    return out.withColumns({"expected_revenue": F.greatest(gain + cost, F.lit(0.0)),
                            "expected_roi": gain / F.when(cost > 0, cost).otherwise(1.0)})


def with_priority(actions: DataFrame) -> DataFrame:
    """Priority, return per cost and selection score of the offline optimiser."""
    value = F.coalesce(*[F.col(c) for c in ("predicted_clv_12m", "clv") if c in actions.columns])
    actions = actions.withColumn("optimization_score", ratio(F.col("expected_incremental_profit"),
                                                             F.when(F.col("coupon_cost") > 0, F.col("coupon_cost")).otherwise(1.0)))
    s = minmax(actions, roi_rank_score=F.col("expected_roi"), profit_rank_score=F.col("expected_incremental_profit"),
               value_rank_score=value, opt=F.col("optimization_score"))
    opt = s.pop("opt")
    out = actions.withColumns(s)
    priority = (0.26 * F.col("roi_rank_score") + 0.24 * F.col("profit_rank_score") + 0.14 * clip(F.col("churn_probability"), 0.0, 1.0)
                + 0.10 * F.greatest(F.col("uplift_score"), F.lit(0.0)) + 0.12 * F.col("timing_urgency_score")
                + 0.08 * (1 - F.col("window_rank_score")) + 0.06 * F.col("value_rank_score") - 0.08 * F.col("discount_norm"))
    return out.withColumn("priority_score", priority).withColumn("selection_score", 0.55 * F.col("priority_score") + 0.45 * opt)


def candidate_pool(actions: DataFrame, threshold: float) -> DataFrame:
    """Actions worth considering, with the seven scaled scores of the budget question."""
    a = actions.withColumn("optimization_score", ratio(F.col("expected_incremental_profit"), F.col("coupon_cost")))
    a = a.where((F.col("churn_probability") >= threshold) & (F.col("uplift_score") > 0) & (F.col("expected_incremental_profit") > 0)
                & (F.col("coupon_cost") > 0) & (F.coalesce("uplift_segment", F.lit("")) != "Sleeping Dogs"))
    s = minmax(a, roi_rank_score=F.col("expected_roi"), profit_rank_score=F.col("expected_incremental_profit"),
               clv_rank_score=F.col("clv"), timing_rank_score=F.col("timing_urgency_score"), win=F.col("intervention_window_days"),
               intensity_fit_rank_score=F.col("intensity_effect_multiplier"), optimization_rank_score=F.col("optimization_score"))
    win = s.pop("win")
    # a flat window column scales to 0, so its reverse is 1
    out = a.withColumns(s).withColumn("window_rank_score", 1 - win)
    priority = (0.18 * F.col("roi_rank_score") + 0.18 * F.col("profit_rank_score") + 0.14 * F.col("churn_probability")
                + 0.10 * F.col("uplift_score") + 0.10 * F.col("clv_rank_score") + 0.12 * F.col("timing_rank_score")
                + 0.08 * F.col("window_rank_score") + 0.10 * F.col("intensity_fit_rank_score"))
    return out.withColumn("priority_score", priority).withColumn(
        "selection_score", 0.55 * F.col("priority_score") + 0.45 * F.col("optimization_rank_score"))


# Orders of selection: (column, descending).
POOL_ORDER = [("selection_score", True), ("priority_score", True), ("optimization_score", True), ("timing_urgency_score", True),
              ("expected_roi", True), ("expected_incremental_profit", True), ("intervention_window_days", False),
              ("coupon_cost", False), ("customer_id", False)]
OFFLINE_ORDER = [("selection_score", True), ("priority_score", True), ("optimization_score", True), ("timing_urgency_score", True),
                 ("expected_revenue", True), ("retention_priority_score", True), ("customer_id", False), ("coupon_cost", False)]
BASELINE_ORDER = [("baseline_priority_score", True), ("expected_roi", True), ("expected_incremental_profit", True),
                  ("churn_probability", True), ("clv", True), ("customer_id", False)]


def offline_pool(actions: DataFrame) -> DataFrame:
    return actions.where((F.col("coupon_cost") > 0) & (F.col("expected_revenue") > 0) & (F.col("expected_incremental_profit") > 0)
                         & (F.coalesce("uplift_segment", F.lit("")) != "Sleeping Dogs"))


def baseline_pool(summary: DataFrame, threshold: float) -> DataFrame:
    """The older five-term policy: one row per customer."""
    c = summary.where((F.col("churn_probability") >= threshold) & (F.col("uplift_score") > 0) & (F.col("coupon_cost") > 0)
                      & (F.col("expected_incremental_profit") > 0))
    s = minmax(c, "expected_roi", "expected_incremental_profit", "uplift_score", "clv")
    return c.withColumn("baseline_priority_score", 0.40 * s["expected_roi"] + 0.25 * s["expected_incremental_profit"]
                        + 0.15 * F.col("churn_probability") + 0.10 * s["uplift_score"] + 0.10 * s["clv"])
