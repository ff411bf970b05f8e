"""Uploads: profile, column roles, standard events, per-customer features from unknown columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winback.functions import vocab
from winback.functions.ranking import exact_quantiles, previous_in_key
from winback.functions.scalars import clip, days_between, literal_map, ratio, scalars
from winback.operators.churn import column_counts
from winback.sources.staging import cut

ROLE_WEIGHTS = {"customer_id": 0.35, "timestamp": 0.25, "event_type": 0.15, "amount": 0.10, "churn_flag": 0.10, "category": 0.05}


def slug(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9가-힣_]", "_", name.strip().lower())).strip("_")


def value_kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "flag" if isinstance(t, T.BooleanType) else "text"


def profile(df: DataFrame, samples: int = 3) -> DataFrame:
    """Per column: rows, missing share, distinct values, kind and its first values in order. One row per distinct value is counted, not one set per column."""
    t = column_counts(df, df.columns)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(value_kind(df.schema[c].dataType)).alias("kind"), F.col(c).cast("string").alias("v")) for c in df.columns])).alias("p")
    long = df.select(pairs).select("p.*")
    miss = long.groupBy("col", "kind").agg(F.count_if(F.col("v").isNull()).alias("missing"))
    first = Window.partitionBy("col").orderBy("v")
    some = (long.where("v IS NOT NULL").groupBy("col", "v").agg(F.lit(1).alias("_o")).withColumn("k", F.row_number().over(first)).where(F.col("k") <= samples)
            .groupBy("col").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("samples")))
    return t.join(miss, "col").join(some, "col", "left").select("col", "n", "n_distinct", F.round(F.col("missing") / F.col("n"), 6).alias("missing_rate"), "kind", "samples")


def looks_datetime(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of values with a date pattern and share that parse, over the whole column."""
    aggs = []
    for c in cols:
        s = F.col(c).cast("string")
        aggs += [F.avg(s.rlike(vocab.DATE_PATTERN).cast("double")).alias(f"a|{c}"), F.avg(F.try_to_timestamp(s).isNotNull().cast("double")).alias(f"b|{c}")]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(f"`a|{c}`"), F.lit(0.0)).alias("pattern_share"),
                                        F.coalesce(F.col(f"`b|{c}`"), F.lit(0.0)).alias("parsed_share")) for c in cols])).alias("r")
    t = df.agg(*aggs).select(rows).select("r.*")
    return t.withColumn("is_datetime", ((F.col("pattern_share") >= 0.60) & (F.col("parsed_share") >= 0.70)).cast("int"))


def role_by_name(column: str) -> tuple[str, float]:
    """Best role of a column name: the same word scores 1.0, a part of one 0.7; earlier roles win ties."""
    n = slug(column)
    scores = [(1.0 if n in words else 0.7 if any(w in n or n in w for w in words) else 0.0, role) for role, words in vocab.ROLES.items()]
    top = max(s for s, _ in scores)
    return (next(r for s, r in scores if s == top), top) if top > 0 else ("unknown", 0.0)


def roles(df: DataFrame) -> list[tuple[str, str, float]]:
    """Role and confidence per column: by name, else by what the values look like."""
    named = [(c, *role_by_name(c)) for c in df.columns]
    open_cols = [c for c, _, s in named if s < 0.5]
    if not open_cols:
        return named
    types = dict(df.dtypes)
    numbers = ("int", "bigint", "double", "float", "smallint")
    stats = {r["col"]: r for r in column_counts(df, open_cols).collect()}
    dates = {r["col"]: r["is_datetime"] for r in looks_datetime(df, open_cols).collect()}
    binary = scalars(df, **{c: F.min(F.coalesce(F.col(c).cast("string").isin("0", "1", "0.0", "1.0", "true", "false", "yes", "no", "Y", "N"), F.lit(True))) for c in open_cols})
    out = []
    for c, role, s in named:
        if s < 0.5:
            r = stats[c]
            if types[c] in numbers and r["n_distinct"] / max(r["n"], 1) > 0.9:
                role, s = "potential_id", 0.3
            elif types[c] == "string" and dates.get(c):
                role, s = "timestamp", 0.6
            elif binary[c]:
                role, s = "potential_binary", 0.3
        out.append((c, role, s))
    return out


def relevance(found: list[tuple[str, str, float]]) -> float:
    best: dict[str, float] = {}
    for _, role, s in found:
        best[role] = max(best.get(role, 0.0), s)
    return round(sum(w * best.get(r, 0.0) for r, w in ROLE_WEIGHTS.items()), 6)


def irrelevant(columns: list[str], limit: int = 3) -> bool:
    return sum(slug(c) in vocab.SENSOR_WORDS for c in columns) >= limit


def warnings(df: DataFrame, id_col: str) -> DataFrame:
    """Quality notes: mostly missing columns, and what the duplicate ids mean."""
    p = profile(df)
    half = p.where(F.col("missing_rate") > 0.5).select(F.lit("mostly_missing").alias("note"), F.col("col").alias("detail"))
    one = p.where(F.col("col") == id_col).select(
        F.when(F.col("n_distinct") / F.col("n") < 0.5, "transaction_level").when(F.col("n_distinct") < F.col("n"), "duplicate_ids").alias("note"),
        F.col("col").alias("detail")).where("note IS NOT NULL")
    return half.unionByName(one)


def _flat(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9가-힣]", "_"), "_+", "_"), F.lit("_"))


def standard_type(value: Column) -> Column:
    """Standard event type of a raw value: the exact word, else the longest known word (4 letters or more) inside it."""
    pairs = [(s, std) for std, words in vocab.EVENT_VALUES.items() for s in words]
    words = {s: std for s, std in reversed(pairs)}
    exact = F.expr("map(" + ", ".join(f"'{k}', '{t}'" for k, t in words.items()) + ")")
    parts = sorted(((len(s), -i, s, std) for i, (s, std) in enumerate(pairs) if len(s) >= 4), reverse=True)
    known = F.expr("array(" + ", ".join(f"struct('{s}' AS s, '{std}' AS t)" for _, _, s, std in parts) + ")")

    def found(v: Column) -> Column:
        inside = F.get(F.filter(known, lambda p: F.contains(v, p["s"])), F.lit(0)).getField("t")
        return F.when(v == "", "other").otherwise(F.coalesce(F.try_element_at(exact, v), inside, F.lit("other")))
    # inside a transform the flattened value is worked out once, not once for every word
    return F.when(value.isNull(), "other").otherwise(F.get(F.transform(F.array(_flat(value)), found), F.lit(0)))


def event_map(df: DataFrame, col: str) -> DataFrame:
    """(value, count, type): the mapping is worked out once per distinct value and written, so that a filter on the type isn't pushed below the count, to every row."""
    counted = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return cut(counted.withColumn("event_type", standard_type(F.col("value"))), "event-map")


def standardise(df: DataFrame, col: str, out: str = "standard_type") -> DataFrame:
    m = event_map(df, col).select(F.col("value").alias("_v"), F.col("event_type").alias(out))
    return df.join(m, df[col].eqNullSafe(m["_v"]), "left").drop("_v")


def mapping_report(m: DataFrame) -> DataFrame:
    total = scalars(m, n=F.sum("n"))["n"] or 1
    known = 1 - (scalars(m.where("event_type = 'other'"), n=F.sum("n"))["n"] or 0) / total
    return m.groupBy("event_type").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_values")).withColumn("share", F.round(F.col("rows") / F.lit(total), 6)).withColumn(
        "coverage_rate", F.lit(round(known, 4)))


def churn_days(df: DataFrame, min_customers: int = 3, default: int = 30) -> int:
    """Median over customers of the mean gap between activities, times 1.75, within 7 to 180 days."""
    g = previous_in_key(df.select("customer_id", "event_time", "event_id"), ["customer_id"], "event_time", {"event_time": "prev"}, ["event_id"])
    gap = days_between(F.col("event_time"), F.col("prev"))
    per = g.where(F.col("prev").isNotNull() & (gap > 0) & (gap <= 365)).groupBy("customer_id").agg(F.avg(gap).alias("mean_gap"))
    if per.limit(min_customers).count() < min_customers:
        return default
    med = exact_quantiles(per, ["mean_gap"], [0.5]).first()["q0"]
    return int(min(max(round(med * 1.75), 7), 180))


def factorise(df: DataFrame, key: str, position: str) -> DataFrame:
    """1-based codes in order of first appearance; numeric keys would be kept as they are."""
    from winback.functions.ranking import ordered_totals
    first = df.groupBy(key).agg(F.min(position).alias("_first"))
    return ordered_totals(first, [("_first", False)], {"customer_id": F.lit(1).cast("long")}).drop("_first")


def external_features(df: DataFrame, numeric: list[str], text: list[str], dates: list[str], position: str) -> DataFrame:
    """Unknown columns to per-customer features, in one aggregate with generated expressions."""
    aggs = []
    for c in numeric:
        v = F.col(c).cast("double")
        aggs += [f(v).alias(f"ext_num__{slug(c)}_{n}") for n, f in (("mean", F.avg), ("sum", F.sum), ("min", F.min), ("max", F.max))]
    for c in dates:
        aggs += [F.min(c).alias(f"ext_date__{slug(c)}_first"), F.max(c).alias(f"ext_date__{slug(c)}_last")]
    for c in text:
        aggs.append(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(f"ext_cat__{slug(c)}_mode"))
    out = df.groupBy("customer_id").agg(*aggs)
    if dates:
        top = scalars(df, **{c: F.max(c) for c in dates})
        out = out.withColumns({f"ext_num__{slug(c)}_days_since_last": F.coalesce(days_between(F.lit(top[c]), F.col(f"ext_date__{slug(c)}_last")), F.lit(999.0)) for c in dates})
    for c in text:      # distinct texts per customer through one row per (customer, text)
        k = df.where(F.col(c).isNotNull()).groupBy("customer_id", c).agg(F.lit(1).alias("_o")).groupBy("customer_id").agg(F.count(F.lit(1)).alias(f"ext_num__{slug(c)}_nunique"))
        out = out.join(k, "customer_id", "left").withColumn(f"ext_num__{slug(c)}_nunique", F.coalesce(f"ext_num__{slug(c)}_nunique", F.lit(0)))
    return out


def attach(summary: DataFrame, ext: DataFrame) -> DataFrame:
    clash = [c for c in ext.columns if c in summary.columns and c != "customer_id"]
    return summary.join(ext.withColumnsRenamed({c: f"ext_uploaded__{c}" for c in clash}), "customer_id", "left")


def reconcile(df: DataFrame, position: str) -> DataFrame:
    """One row per customer: means for scores, maxima for amounts, the last row for the rest, chosen by words in the name."""
    means = ("probability", "score", "rate", "roi", "affinity", "sensitivity", "propensity")
    maxima = ("monetary", "amount", "clv", "cost", "profit", "frequency", "count", "total")
    types = dict(df.dtypes)

    def rule(c: str) -> Column:
        if types[c] != "string":
            if any(w in c for w in means):
                return F.avg(c)
            if any(w in c for w in maxima):
                return F.max(c)
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(position)))
    return df.groupBy("customer_id").agg(*[rule(c).alias(c) for c in df.columns if c not in ("customer_id", position)])


def flag(raw: Column, nonblank: bool = False) -> Column:
    """1 where a number is above zero or a text means yes; or simply where there is any text."""
    s = F.trim(raw.cast("string"))
    if nonblank:
        return (raw.isNotNull() & (s != "")).cast("int")
    num = s.try_cast("double")
    return F.coalesce((num > 0).cast("int"), F.lower(F.coalesce(s, F.lit(""))).isin(*vocab.TRUTHY).cast("int"))


def first_name(df: DataFrame, names: list[str]) -> str | None:
    low = {c.lower(): c for c in df.columns}
    return next((low[n] for n in names if n in low), None)


def commonest(df: DataFrame, column: str, name: str) -> DataFrame:
    """(customer_id, name): the commonest text of each customer, ties to the first in the alphabet, without holding all texts of a customer."""
    n = df.where(F.col(column).isNotNull()).groupBy("customer_id", F.col(column).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy("customer_id").agg(F.min_by("_v", F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))).alias(name))


def known_columns(df: DataFrame) -> DataFrame:
    """Common upload columns under their many names to standard per-customer columns."""
    at = {k: first_name(df, names) for k, names in vocab.KNOWN_COLUMNS.items()}
    number = lambda k: F.coalesce(F.col(at[k]).try_cast("double"), F.lit(0.0))
    aggs = [F.sum(number("amount")).alias("_amount") if at["amount"] else F.lit(0.0).alias("_amount"),
            F.sum(number("discount")).alias("_disc") if at["discount"] else F.lit(0.0).alias("_disc")]
    aggs.append(F.sum(flag(F.col(at["exposure"])) if at["exposure"] else flag(F.col(at["campaign"]), True) if at["campaign"] else F.lit(0)).alias("_exp"))
    aggs.append(F.sum(flag(F.col(at["redeem"])) if at["redeem"] else flag(F.col(at["discount"])) if at["discount"] else F.lit(0)).alias("_red"))
    for k, f, name in (("session", F.avg, "avg_session_duration_sec_uploaded"), ("pages", F.avg, "pageviews_per_session_uploaded"), ("order_count", F.max, "frequency"),
                       ("registration_days", F.max, "customer_age_days_uploaded"), ("points", F.sum, "point_used_total")):
        if at[k]:
            aggs.append(F.coalesce(f(F.col(at[k]).try_cast("double")), F.lit(0.0)).alias(name))
    reason = at["reason"]
    g = df.groupBy("customer_id").agg(*aggs)
    if at["registration_days"]:
        g = g.withColumn("customer_age_days_uploaded", F.greatest("customer_age_days_uploaded", F.lit(0.0)))
    for k, name in (("reason", "refund_reason"), ("channel", "acquisition_channel"), *[(x, x) for x in ("gender", "age_group", "payment_method", "delivery_type")]):
        if at[k]:
            g = g.join(commonest(df, at[k], name), "customer_id", "left")
            if k != "reason":
                g = g.withColumn(name, F.coalesce(name, F.lit("unknown")))
    if at["channel"]:
        low = F.lower("acquisition_channel")
        g = g.withColumn("device_type", F.when(low.rlike("mobile|app|ios|android"), "mobile").when(low.rlike("web|pc|desktop"), "web").otherwise(F.col("acquisition_channel")))
    exposures = F.greatest("_exp", "_red")
    dep = clip(F.col("_disc") / F.greatest("_amount", F.lit(1.0)), 0.0, 1.0)
    g = g.withColumns({"coupon_exposure_count": exposures, "discount_dependency_score": dep})
    fatigue = clip(F.col("coupon_exposure_count") / F.lit(3.0), 0.0, 2.0)
    g = g.withColumns({
        "monetary": F.col("_amount"), "coupon_redeem_count": F.col("_red"), "discount_amount_total": F.col("_disc"), "coupon_fatigue_score": fatigue,
        "coupon_redeem_rate_uploaded": F.col("_red") / F.greatest("coupon_exposure_count", F.lit(1)),
        "price_sensitivity": clip(0.35 + 0.8 * F.col("discount_dependency_score"), 0.0, 1.0),
        "coupon_affinity": clip(0.30 + 0.7 * F.col("discount_dependency_score"), 0.0, 1.0)})
    pressure = clip(0.65 * F.col("discount_dependency_score") + 0.35 * F.col("coupon_fatigue_score") / 2, 0.0, 1.0)
    g = g.withColumn("discount_pressure_score", pressure).withColumn("discount_effect_penalty", clip(1 - 0.25 * F.col("discount_pressure_score"), 0.5, 1.0))
    if reason:
        issue = ~F.lower(F.coalesce("refund_reason", F.lit("none"))).isin(*vocab.NO_ISSUE)
        g = g.withColumn("support_contact_propensity", F.when(issue, 0.65).otherwise(0.1))
    return g.drop("_amount", "_disc", "_exp", "_red")


def finance(df: DataFrame) -> DataFrame:
    """Finance numbers (sums for totals and counts, else maxima) and texts under their many names, with the signals made of them."""
    numbers = {k: c for k, names in vocab.FINANCE_NUMBERS.items() if (c := first_name(df, names))}
    texts = {k: c for k, names in vocab.FINANCE_TEXTS.items() if (c := first_name(df, names))}
    gather = lambda k: F.sum if k.endswith(("_total", "_count")) else F.max
    g = df.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_rows"), *[F.coalesce(gather(k)(F.col(c).try_cast("double")), F.lit(0.0)).alias(k) for k, c in numbers.items()]).drop("_rows")
    for name, c in texts.items():
        g = g.join(commonest(df, c, name), "customer_id", "left").withColumn(name, F.coalesce(name, F.lit("unknown")))
    if "delinquency_days" in numbers:
        contact = F.when(F.col("delinquency_days") > 0, 0.55).otherwise(0.1)
        g = g.withColumns({"service_contact_propensity": contact, "support_contact_propensity": contact})
    if "credit_score" in numbers:
        g = g.withColumn("credit_risk_score", clip((750 - F.col("credit_score")) / 350, 0.0, 1.0))
    if balance := next((k for k in ("account_balance_current", "avg_balance") if k in numbers), None):
        g = g.withColumn("balance_value_score", clip(F.log1p(F.greatest(F.col(balance), F.lit(0.0))) / 16.0, 0.0, 1.0))
    return g


def finance_event_names(kind: Column) -> Column:
    return F.coalesce(literal_map(vocab.FINANCE_EVENTS, kind), F.lit(vocab.FINANCE_OTHER))


def churn_label(text: Column | None, last: Column, latest: Column, days: int) -> Column:
    """The uploaded flag as 0..1, else silence of `days` or more."""
    if text is None:
        return (F.floor(days_between(latest, last)) >= days).cast("double")
    return F.coalesce(literal_map(vocab.CHURN_TEXTS, F.lower(F.trim(text))), F.lit(0.0))


def extract_events(df: DataFrame) -> DataFrame:
    """Rows with a key, a time and a wanted type; the session is the customer's day."""
    t = standardise(df, "action", "event_type").where(F.col("customer_id").isNotNull() & F.col("event_time").isNotNull() & ~F.col("event_type").isin("ignore", "skip"))
    return t.withColumn("session_id", F.concat_ws("_", F.col("customer_id").cast("string"), F.date_format("event_time", "yyyyMMdd")))


def orders_from_events(events: DataFrame) -> DataFrame:
    """Purchase events with their amounts; the discount is at most the amount."""
    p = events.where(F.col("event_type") == "purchase")
    amount, disc = F.coalesce("amount", F.lit(0.0)), F.coalesce("discount_amount", F.lit(0.0))
    cut = F.least(disc, amount)
    return p.select(F.concat(F.lit("ORD-"), F.col("event_id").cast("string")).alias("order_id"), "customer_id", F.col("event_time").alias("order_time"), F.round(amount, 2).alias("gross_amount"),
                    F.round(cut, 2).alias("discount_amount"), F.round(amount - cut, 2).alias("net_amount"), flag(F.col("coupon_used")).alias("coupon_used"))


def granularity(df: DataFrame, key: str) -> DataFrame:
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    t = per.agg(F.count(F.lit(1)).alias("ids"), F.sum("n").alias("rows"))
    return t.withColumn("level", F.when(ratio(F.col("ids"), F.col("rows")) < 0.5, "transaction").otherwise("customer"))
