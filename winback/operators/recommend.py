"""Category recommendations: what a customer bought and looked at, what the segment and everyone buys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winback.functions.ranking import with_rank_pct
from winback.functions.scalars import scalars
from winback.sources.staging import cut

# Event types that show interest.
VIEW_EVENTS = ["view", "browse", "page_view", "search", "product_view", "add_to_cart"]
# Finance names of common product categories.
FINANCE_CATEGORIES = {
    "fashion": "카드/소비", "beauty": "예·적금", "personal_care": "생활금융", "grocery": "입출금계좌", "sports": "대출", "health": "보험/연금",
    "electronics": "디지털금융", "home": "주거금융", "books": "금융교육/콘텐츠", "kids": "가족금융", "pet": "펫보험/특화상품",
    "deposit": "예금", "savings": "적금", "checking": "입출금계좌", "account": "입출금계좌", "credit_card": "신용카드", "debit_card": "체크카드",
    "card": "카드", "loan": "대출", "mortgage": "주택담보대출", "insurance": "보험", "pension": "연금", "fund": "펀드", "investment": "투자상품",
}
# Finance names of the reason tags.
FINANCE_REASONS = {
    "own_purchase_history": "고객 본인의 과거 금융거래 이력",
    "recent_browse_signal": "최근 금융상품 조회 신호",
    "segment_popularity": "유사 금융고객군 선호",
    "global_popularity": "전체 금융고객 선호",
}


def _age_days(latest, ts: Column) -> Column:
    micros = F.unix_micros(F.lit(latest)) - F.unix_micros(ts)
    return F.greatest(F.floor(micros / F.lit(86400000000.0)), F.lit(0))


def category_preference(orders: DataFrame) -> DataFrame:
    latest = scalars(orders, t=F.max("order_time"))["t"]
    score = F.col("net_amount") * F.exp(-_age_days(latest, F.col("order_time")) / 90.0) + F.col("quantity") * 5000.0
    return orders.groupBy("customer_id", "item_category").agg(F.sum(score).alias("customer_pref_score"))


def segment_popularity(summary: DataFrame, orders: DataFrame) -> DataFrame:
    # folded to customer and category before the join, so busy customers do not widen it
    per = orders.groupBy("customer_id", "item_category").agg(F.sum("net_amount").alias("s"), F.count(F.lit(1)).alias("n"))
    j = per.join(summary.select("customer_id", "persona", "uplift_segment"), "customer_id", "left")
    return j.groupBy("persona", "uplift_segment", "item_category").agg((F.sum("s") + F.sum("n") * 3000.0).alias("segment_popularity"))


def global_popularity(orders: DataFrame) -> DataFrame:
    return orders.groupBy("item_category").agg((F.sum("net_amount") + F.count(F.lit(1)) * 2000.0).alias("global_popularity"))


def recent_interest(events: DataFrame) -> DataFrame:
    seen = events.where(F.lower("event_type").isin(*VIEW_EVENTS) & F.col("item_category").isNotNull())
    latest = scalars(seen, t=F.max("event_time"))["t"]
    return seen.groupBy("customer_id", "item_category").agg(F.sum(F.exp(-_age_days(latest, F.col("event_time")) / 60.0)).alias("view_score"))


def targets(summary: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """Selected customers with fresh columns over stale ones, or the at-risk fallback, with their priority."""
    if chosen is None:
        t = with_rank_pct(summary.where(F.col("churn_probability") >= 0.45), {"uplift_score": "_u", "clv": "_c"})
        p = 0.45 * F.col("churn_probability") + 0.25 * F.col("_u") + 0.30 * F.col("_c")
        return t.withColumn("recommendation_priority", p).withColumn("target_priority_score", p).drop("_u", "_c")
    fresh = [c for c in ("churn_probability", "clv", "uplift_score", "priority_score", "expected_incremental_profit", "expected_roi",
                         "timing_urgency_score", "intervention_window_days", "coupon_cost") if c in chosen.columns]
    j = summary.join(chosen.select("customer_id", *[F.col(c).alias(f"{c}_t") for c in fresh]), "customer_id")
    j = j.withColumns({c: F.coalesce(F.col(f"{c}_t"), F.col(c)) if c in summary.columns else F.col(f"{c}_t") for c in fresh}).drop(*[f"{c}_t" for c in fresh])
    j = j.withColumn("_roi0", F.greatest("expected_roi", F.lit(0.0)))
    r = with_rank_pct(j, {"priority_score": "_p", "uplift_score": "_u", "clv": "_c", "_roi0": "_r"})
    flat = scalars(j, **{k: (F.min(c) == F.max(c)) for k, c in (("_p", "priority_score"), ("_u", "uplift_score"), ("_c", "clv"), ("_r", "_roi0"))})
    rank = lambda k: F.lit(0.0) if flat[k] else F.col(k)
    p = (0.30 * rank("_p") + 0.22 * F.col("churn_probability") + 0.14 * rank("_u") + 0.14 * rank("_c") + 0.10 * rank("_r")
         + 0.10 * F.col("timing_urgency_score"))
    return r.withColumn("recommendation_priority", F.least(p, F.lit(1.0))).withColumn("target_priority_score", F.col("priority_score")).drop("_p", "_u", "_c", "_r", "_roi0")


# Order of the target list: (column, descending).
TARGET_ORDER = [("target_priority_score", True), ("expected_incremental_profit", True), ("expected_roi", True), ("recommendation_priority", True),
                ("intervention_window_days", False), ("clv", True), ("customer_id", False)]


#: Categories of a segment's list that a customer reads at once.
CHUNK = 64


def unseen_heads(c: DataFrame, lists: DataFrame, chunks: int, k: int) -> DataFrame:
    """c with `found`: the first k categories of its segment's list that are not in its own `seen`.

    The list comes in chunks; a round hands the next one, of one row a segment, to the customers that still need it. A customer is done once it has k, or once what follows in the list can no
    longer reach `theta`, its own k-th best score. So what a customer reads depends on its own categories and scores only.
    """
    todo, done = c.withColumn("found", F.expr("CAST(array() AS array<struct<place:int,item_category:string,segment_popularity:double,base_score:double>>)")), []
    for n in range(chunks):
        head = F.broadcast(lists.where(F.col("chunk") == n).select("persona", "uplift_segment", "items"))  # segments x CHUNK entries, whatever the number of categories
        fresh = F.filter("items", lambda x: ~F.coalesce(F.array_contains(F.col("seen"), x["item_category"]), F.lit(False)))
        todo = todo.join(head, ["persona", "uplift_segment"]).withColumn("found", F.slice(F.concat("found", fresh), 1, k))
        if n == chunks - 1:
            return reduce(DataFrame.unionByName, [*done, todo.drop("items")])
        reach = F.round(F.element_at("items", -1)["base_score"] + 0.05 * F.coalesce("coupon_affinity", F.lit(0.0)), 9)
        todo = cut(todo.withColumn("ended", (F.size("found") >= k) | F.coalesce(reach < F.col("theta"), F.lit(False))).drop("items"), "heads")
        done.append(todo.where("ended").drop("ended"))
        todo = todo.where(~F.col("ended")).drop("ended")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done)
    return todo


def recommend(customers: DataFrame, pref: DataFrame, view: DataFrame, segment: DataFrame, everyone: DataFrame, k: int = 3) -> DataFrame:
    """Top-k categories per customer over all categories, without pairing every customer with every category.

    A category the customer never bought or viewed scores by segment and overall popularity only, so among
    those the order is the same for a whole segment. Two sorted lists are walked: the customer's own categories, and its segment's
    until it has k unseen ones or their bound is below the k-th own score.
    """
    cats = everyone.select("item_category").unionByName(pref.select("item_category")).unionByName(view.select("item_category")).distinct()
    n_all = cats.count()
    pops = scalars(cats.join(everyone, "item_category", "left").select(F.coalesce("global_popularity", F.lit(0.0)).alias("g")), lo=F.min("g"), hi=F.max("g"))

    def scaled(x: Column, lo, hi) -> Column:
        return F.when(hi - lo < 1e-9, 0.0).otherwise((x - lo) / (hi - lo))
    # personas times uplift segments, both fixed vocabularies: each category is listed once a segment, spread over the categories
    segs = [F.struct(F.lit(r[0]).alias("persona"), F.lit(r[1]).alias("uplift_segment")) for r in customers.select("persona", "uplift_segment").distinct().collect()]
    seg_cat = cats.withColumn("seg", F.explode(F.array(*segs))).select("seg.persona", "seg.uplift_segment", "item_category") if segs else cats.selectExpr(
        "CAST(NULL AS string) persona", "CAST(NULL AS string) uplift_segment", "item_category").limit(0)
    seg_cat = seg_cat.join(segment, ["persona", "uplift_segment", "item_category"], "left").join(everyone, "item_category", "left").select(
        "persona", "uplift_segment", "item_category", F.coalesce("segment_popularity", F.lit(0.0)).alias("segment_popularity"),
        F.coalesce("global_popularity", F.lit(0.0)).alias("global_popularity"))
    w = Window.partitionBy("persona", "uplift_segment")
    base = (0.20 * scaled(F.col("segment_popularity"), F.min("segment_popularity").over(w), F.max("segment_popularity").over(w))
            + 0.15 * scaled(F.col("global_popularity"), F.lit(pops["lo"]), F.lit(pops["hi"])))
    seg_cat = seg_cat.withColumn("base_score", base)
    seg_cat = cut(seg_cat.withColumn("place", F.row_number().over(w.orderBy(F.desc("base_score"), "item_category"))), "segment-lists")
    chunk = F.floor((F.col("place") - 1) / CHUNK).cast("int").alias("chunk")
    lists = seg_cat.groupBy("persona", "uplift_segment", chunk).agg(F.array_sort(F.collect_list(F.struct("place", "item_category", "segment_popularity", "base_score"))).alias("items"))
    own = pref.join(view, ["customer_id", "item_category"], "full").select(
        "customer_id", "item_category", F.coalesce("customer_pref_score", F.lit(0.0)).alias("p"), F.coalesce("view_score", F.lit(0.0)).alias("v"))
    span = own.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_own"), F.min("p").alias("plo"), F.max("p").alias("phi"), F.min("v").alias("vlo"), F.max("v").alias("vhi"))
    c = customers.select("customer_id", "persona", "uplift_segment", "coupon_affinity").join(span, "customer_id", "left").withColumn("n_own", F.coalesce("n_own", F.lit(0)))
    full = F.col("n_own") >= n_all                # only then can the smallest own value be above zero
    lo = lambda x: F.when(full, F.coalesce(F.col(x), F.lit(0.0))).otherwise(0.0)
    c = c.withColumns({"plo": lo("plo"), "vlo": lo("vlo"), "phi": F.coalesce("phi", F.lit(0.0)), "vhi": F.coalesce("vhi", F.lit(0.0))})
    score = F.round(0.50 * scaled(F.col("p"), F.col("plo"), F.col("phi")) + 0.15 * scaled(F.col("v"), F.col("vlo"), F.col("vhi")) + F.col("base_score")
                    + 0.05 * F.coalesce("coupon_affinity", F.lit(0.0)), 9)
    columns = ["customer_id", "persona", "uplift_segment", "item_category", "p", "v", "segment_popularity", "recommendation_score"]
    top = Window.partitionBy("customer_id").orderBy(F.desc("recommendation_score"), "item_category")
    # own categories beyond the k best can't be among the k best of all
    mine = own.join(c, "customer_id").join(seg_cat.drop("place"), ["persona", "uplift_segment", "item_category"]).withColumn("recommendation_score", score)
    best = mine.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k)
    theta = best.groupBy("customer_id").agg(F.min(F.when(F.col("_r") == k, F.col("recommendation_score"))).alias("theta"))
    seen = own.groupBy("customer_id").agg(F.collect_set("item_category").alias("seen"))
    asked = c.join(seen, "customer_id", "left").join(theta, "customer_id", "left")
    heads = unseen_heads(asked, lists, max(1, -(-n_all // CHUNK)), k).select(*c.columns, F.explode("found").alias("h"), F.lit(0.0).alias("p"), F.lit(0.0).alias("v"))
    heads = heads.select("*", "h.item_category", "h.segment_popularity", "h.base_score").withColumn("recommendation_score", score)
    j = best.select(*columns).unionByName(heads.select(*columns))
    return j.withColumn("recommendation_rank", F.row_number().over(top)).where(F.col("recommendation_rank") <= k).select(
        "customer_id", "persona", "uplift_segment", "recommendation_rank", F.col("item_category").alias("recommended_category"),
        "recommendation_score", reasons().alias("reason_tags"))


def reasons() -> Column:
    hits = F.array_compact(F.array(F.when(F.col("p") > 0, "own_purchase_history"), F.when(F.col("v") > 0, "recent_browse_signal"),
                                   F.when(F.col("segment_popularity") > 0, "segment_popularity")))
    return F.when(F.size(hits) == 0, "global_popularity").otherwise(F.array_join(hits, ", "))


def finance_labels(recs: DataFrame) -> DataFrame:
    """Finance words for category and reason tags; unknown values stay."""
    from winback.functions.scalars import literal_map
    key = F.regexp_replace(F.lower(F.trim("recommended_category")), "[ -]", "_")
    parts = F.transform(F.split("reason_tags", ", "), lambda x: F.coalesce(literal_map(FINANCE_REASONS, x), x))
    return recs.withColumn("recommended_category", F.coalesce(literal_map(FINANCE_CATEGORIES, key), F.col("recommended_category"))).withColumn(
        "reason_tags", F.array_join(parts, ", "))


def rerank(recs: DataFrame, k: int) -> DataFrame:
    """Keep k stored rows per customer by score, and order customers by their best score."""
    w = Window.partitionBy("customer_id").orderBy(F.desc("recommendation_score"), "recommended_category")
    best = recs.groupBy("customer_id").agg(F.max("recommendation_score").alias("customer_best"))
    return recs.withColumn("recommendation_rank", F.row_number().over(w)).where(F.col("recommendation_rank") <= k).join(best, "customer_id")
