"""Spending a fixed budget: exact greedy selection as a few rounds of running totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winback.functions.ranking import ordered_totals, placed
from winback.functions.scalars import ratio
from winback.sources.staging import cut

INTENSITY_NAMES = ["low", "mid", "high"]


def rank_pool(pool: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    """Give each candidate its place in the selection order, and write the pool for the rounds to share."""
    return cut(placed(pool, order), "pool")


def greedy(ranked: DataFrame, budgets: list[float], high_cap: int | None = None, customer_cap: int | None = None, width: int = 1 << 17) -> DataFrame:
    """Walk the candidates in order, skip what does not fit, take one action per customer.

    All budgets are settled together. One round takes, per budget, every customer's first action that
    still fits in the next stretch of places, adds up cost in order, and accepts everything before the first row that
    breaks a limit. That row is skipped for good, as the money left only shrinks. After the first break the money
    left is below the dearest action, so few rounds follow. A stretch without a break is taken whole and the next is twice
    as long, so a walk reads what its money reaches, and all of the pool in a few rounds where the money lasts.
    """
    if "intervention_intensity" not in ranked.columns:
        ranked = ranked.withColumn("intervention_intensity", F.lit("none"))
    thin = ranked.select("place", "customer_id", F.col("coupon_cost").alias("cost"),
                         (F.lower("intervention_intensity") == "high").cast("int").alias("high")).where("cost > 0")
    big = 1 << 60
    end = ranked.agg(F.max("place").alias("n"), F.min(F.when(F.col("coupon_cost") > 0, F.col("coupon_cost"))).alias("low")).first()
    places, cheapest = end["n"] or 0, end["low"]
    states = {int(b): {"left": float(b), "high": big if high_cap is None else high_cap,
                       "cap": big if not customer_cap else customer_cap, "last": 0, "width": width} for b in budgets if b > 0}
    taken: list[DataFrame] = []
    if cheapest is None:
        states = {}
    while states:
        st = F.explode(F.array(*[F.struct(
            F.lit(b).alias("budget"), F.lit(s["left"]).alias("left"), F.lit(s["high"]).alias("high_left"),
            F.lit(s["cap"]).alias("cap_left"), F.lit(s["last"]).alias("last"), F.lit(s["last"] + s["width"]).alias("upto")) for b, s in states.items()])).alias("s")
        lo, hi = min(s["last"] for s in states.values()), max(s["last"] + s["width"] for s in states.values())
        near = thin.where((F.col("place") > lo) & (F.col("place") <= hi) & (F.col("cost") <= max(s["left"] for s in states.values())))
        fits = near.select("*", st).select("place", "customer_id", "cost", "high", "s.*").where(
            (F.col("place") > F.col("last")) & (F.col("place") <= F.col("upto")) & (F.col("cost") <= F.col("left"))
            & ((F.col("high") == 0) | (F.col("high_left") > 0)))
        if taken:
            done = reduce(DataFrame.unionByName, taken).select("budget", "customer_id")
            fits = fits.join(done, ["budget", "customer_id"], "left_anti")
        # the place is unique, so a plain minimum finds a customer's first action
        one = Window.partitionBy("budget", "customer_id")
        first = fits.withColumn("_first", F.min("place").over(one)).where("place = _first").drop("_first")
        run = ordered_totals(first, [("place", False)], {"sum_cost": F.col("cost"), "sum_high": F.col("high"), "sum_n": F.lit(1)},
                             by=["budget"], dense=places)
        # the totals only grow along the order, so the rows that keep all limits are the ones before the first break
        fits_all = ((F.col("sum_cost") <= F.col("left")) & (F.col("sum_high") <= F.col("high_left")) & (F.col("sum_n") <= F.col("cap_left")))
        run = cut(run.withColumn("ok", fits_all), "round")
        got = {r["budget"]: r for r in run.groupBy("budget").agg(
            F.min(F.when(~F.col("ok"), F.col("place"))).alias("stop"), F.max(F.when(F.col("ok"), F.col("sum_cost"))).alias("c"),
            F.max(F.when(F.col("ok"), F.col("sum_high"))).alias("h"), F.count_if(F.col("ok")).alias("n")).collect()}
        if any(r["n"] for r in got.values()):
            taken.append(run.where("ok").select("budget", "customer_id", "place"))
        nxt = {}
        for b, s in states.items():
            r, s = got.get(b), dict(s)
            if r is not None:
                s.update(left=s["left"] - (r["c"] or 0.0), high=s["high"] - (r["h"] or 0), cap=s["cap"] - r["n"])
            if r is not None and r["stop"] is not None:
                s["last"] = r["stop"]
            else:           # no break so far: the next stretch is twice as long
                s.update(last=s["last"] + s["width"], width=2 * s["width"])
            if s["last"] < places and s["cap"] > 0 and s["left"] >= cheapest:
                nxt[b] = s
        states = nxt
    if not taken:
        return ranked.withColumn("budget", F.lit(0)).limit(0)
    chosen = reduce(DataFrame.unionByName, taken).select("budget", "place")
    return ranked.join(chosen, "place")


def high_share_cap(n: int, share: float = 0.35) -> int:
    return max(1, int(max(n, 1) * share))


def within_budget(ranked: DataFrame, order: list[tuple[str, bool]], budget: float) -> DataFrame:
    """Rows kept while the running cost stays within the budget."""
    run = ordered_totals(ranked, order, {"running_cost": F.col("coupon_cost")})
    return run.where(F.col("running_cost") <= budget)


def allocation_grid(selected: DataFrame, segments: DataFrame, seg_col: str) -> DataFrame:
    """Segment x intensity table of customers, spend, revenue and profit, empty cells kept."""
    grid = segments.select(seg_col).distinct().select(
        seg_col, F.explode(F.array(*[F.lit(i) for i in INTENSITY_NAMES])).alias("intervention_intensity"))
    got = selected.groupBy(seg_col, "intervention_intensity").agg(
        F.count_distinct("customer_id").alias("customer_count"), F.sum("coupon_cost").alias("allocated_budget"),
        F.sum("expected_revenue").alias("expected_revenue"), F.sum("expected_incremental_profit").alias("expected_profit"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    return grid.join(got, [seg_col, "intervention_intensity"], "left").select(
        seg_col, "intervention_intensity", F.coalesce("customer_count", F.lit(0)).alias("customer_count"),
        F.round(zero("allocated_budget"), 2).alias("allocated_budget"), F.round(zero("expected_revenue"), 2).alias("expected_revenue"),
        F.round(zero("expected_profit"), 2).alias("expected_profit"),
        F.round(ratio(zero("expected_revenue") - zero("allocated_budget"), zero("allocated_budget")), 6).alias("expected_roi"))


def allocation_rollup(selected: DataFrame, seg_col: str) -> DataFrame:
    """Segment x intensity rows and segment totals in one pass; NULL intensity marks the total."""
    return selected.rollup(seg_col, "intervention_intensity").agg(
        F.count_distinct("customer_id").alias("customer_count"), F.round(F.sum("coupon_cost"), 2).alias("allocated_budget"),
        F.round(F.sum("expected_incremental_profit"), 2).alias("expected_profit")).where(F.col(seg_col).isNotNull())


def scenario_totals(selected: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """One row per named budget."""
    spark = selected.sparkSession
    names = spark.createDataFrame([(k, v) for k, v in budgets.items()], "scenario string, budget long")
    got = selected.groupBy("budget").agg(F.sum("coupon_cost").alias("c"), F.sum("expected_revenue").alias("r"),
                                         F.count(F.lit(1)).alias("n"))
    spent, rev = F.coalesce("c", F.lit(0.0)), F.coalesce("r", F.lit(0.0))
    return names.join(got, "budget", "left").select(
        "scenario", "budget", F.round(spent, 2).alias("spent"), F.round(F.col("budget") - spent, 2).alias("remaining"),
        F.coalesce("n", F.lit(0)).alias("num_targeted"), F.round(rev, 2).alias("expected_revenue"),
        F.round(ratio(rev - spent, spent), 6).alias("expected_roi"))


def budget_grid(base: int, step: int = 1_000_000) -> list[int]:
    """Budgets to compare: whole steps around the current budget, plus zero, itself and one step more."""
    lo = 0 if base <= 30 * step else max(0, base - 10 * step)
    hi = max(10 * step, base + 5 * step) if base <= 30 * step else base + 10 * step
    return sorted({0, base, base + step, *range(lo, hi + step, step)})


# Status texts of a budget step.
STATUS_TEXTS = {
    "start": "기준 구간",
    "saturated": "포화 또는 낭비 주의",
    "weak": "효율 낮음",
    "falling": "ROI 하락 시작",
    "grow": "확대 검토 가능",
    "steady": "점진 확대 가능",
}


def sensitivity(selected: DataFrame, budgets: list[int]) -> DataFrame:
    """Spend, profit and the marginal gain of each budget over the one before."""
    spark = selected.sparkSession
    grid = spark.createDataFrame([(int(b),) for b in budgets], "budget long")
    got = selected.groupBy("budget").agg(F.sum("coupon_cost").alias("c"), F.sum("expected_incremental_profit").alias("p"),
                                         F.count_distinct("customer_id").alias("n"))
    t = grid.join(got, "budget", "left").select("budget", *[F.round(F.coalesce(F.col(x), F.lit(0.0)), 4).alias(x) for x in "cp"],
                                                F.coalesce("n", F.lit(0)).alias("n"))
    t = t.withColumn("roi", ratio(F.col("p"), F.col("c")))
    w = Window.partitionBy(F.lit(1)).orderBy("budget")      # the budget grid: a few dozen rows
    prev = lambda n: F.lag(n).over(w)
    t = t.withColumns({"db": F.col("budget") - prev("budget"), "dc": F.col("c") - prev("c"), "dp": F.col("p") - prev("p"),
                       "dn": F.col("n") - prev("n"), "roi0": prev("roi")})
    t = t.withColumn("per", ratio(F.col("dp") * 1_000_000, F.col("db"))).withColumn(
        "mroi", F.when(F.col("dc") > 0, F.col("dp") / F.col("dc")).otherwise(0.0))
    status = (F.when(F.col("db").isNull(), STATUS_TEXTS["start"])
              .when((F.round("dp", 6) <= 0) & (F.col("dn") <= 0), STATUS_TEXTS["saturated"])
              .when(F.col("mroi") < 0.2, STATUS_TEXTS["weak"]).when(F.col("roi") < F.col("roi0"), STATUS_TEXTS["falling"])
              .when(F.col("mroi") >= F.col("roi"), STATUS_TEXTS["grow"]).otherwise(STATUS_TEXTS["steady"]))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    return t.select(
        "budget", F.round("c", 2).alias("spent"), F.round(F.greatest(F.col("budget") - F.col("c"), F.lit(0.0)), 2).alias("remaining"),
        F.col("n").alias("target_count"), F.round("p", 2).alias("expected_incremental_profit"), F.round("roi", 6).alias("average_roi"),
        F.coalesce("dn", F.lit(0)).alias("added_target_count"), F.round(zero("dp"), 2).alias("added_profit"),
        F.round("per", 2).alias("marginal_profit_per_1m"), F.round(zero("mroi"), 6).alias("marginal_roi"), status.alias("budget_status"))


def sensitivity_points(table: DataFrame, base: int, step: int = 1_000_000) -> DataFrame:
    """Current row, next gain, saturation budget and first low-efficiency budget of a sensitivity table."""
    top = table.agg(F.max("marginal_profit_per_1m")).first()[0] or 0.0
    edge = max(top * 0.15, 0.0)
    low = (F.col("budget") > 0) & (F.col("marginal_profit_per_1m") <= edge)
    return table.agg(
        F.max(F.when(F.col("budget") == base, F.col("spent"))).alias("current_spent"),
        F.max(F.when(F.col("budget") == base, F.col("target_count"))).alias("current_target_count"),
        F.max(F.when(F.col("budget") == base, F.col("average_roi"))).alias("current_average_roi"),
        F.max(F.when(F.col("budget") == base + step, F.col("added_profit"))).alias("next_step_profit_gain"),
        F.coalesce(F.min(F.when(low & (F.col("added_target_count") <= 0), F.col("budget"))),
                   F.min(F.when(low, F.col("budget")))).alias("saturation_budget"),
        F.min(F.when((F.col("budget") > 0) & ((F.col("marginal_roi") < 0.2) | (F.col("marginal_profit_per_1m") <= 0)),
                     F.col("budget"))).alias("low_efficiency_budget"))


def selection_summary(selected: DataFrame, pool: DataFrame, budget: int) -> DataFrame:
    """Totals, return, intensity counts and guard statistics of one selection."""
    kind = lambda k: F.count_if(F.col("intervention_intensity") == k)
    spent = F.coalesce(F.sum("coupon_cost"), F.lit(0.0))
    gain = F.coalesce(F.sum("expected_incremental_profit"), F.lit(0.0))
    n = pool.agg(F.count_distinct("customer_id").alias("c"), F.count(F.lit(1)).alias("a")).first()
    return selected.agg(
        F.lit(budget).alias("budget"), F.round(spent, 2).alias("spent"), F.round(budget - spent, 2).alias("remaining"),
        F.count(F.lit(1)).alias("num_targeted"), F.lit(n["c"]).alias("candidate_customers"), F.lit(n["a"]).alias("candidate_actions"),
        (spent >= budget * 0.98).cast("int").alias("budget_binding"), F.round(gain, 2).alias("expected_incremental_profit"),
        F.round(ratio(gain, spent), 6).alias("overall_roi"), kind("low").alias("low_count"), kind("mid").alias("mid_count"),
        kind("high").alias("high_count"), F.round(F.avg("discount_pressure_score"), 6).alias("avg_selected_discount_pressure"),
        F.round(F.avg("fatigue_guardrail_multiplier"), 6).alias("avg_selected_fatigue_guardrail_multiplier"))
