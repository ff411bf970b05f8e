"""Churn model training: leakage guards, split, grids, ranking metrics, value threshold, scoring."""

from __future__ import annotations

import re
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winback.functions.ranking import ordered_totals, value_cdf
from winback.functions.scalars import scalars, stable_unit

# Columns that are the target, a score or an outcome.
LEAK_COLUMNS = {
    "label", "target", "target_label", "target_churn", "churn", "churn_flag", "churn_label", "churn_label_observed", "churn_probability",
    "churn_prob", "churn_score", "is_churn", "is_churned", "is_churner", "will_churn", "label_observed", "retention", "retention_label",
    "retention_rate", "retained", "is_retained", "rolling_retention", "survival", "survived", "inactive_label", "inactive_45d", "future_active",
    "future_activity", "future_purchase", "next_purchase", "next_event", "outcome", "observed_outcome", "prediction", "predicted_label",
    "predicted_churn", "probability", "score", "risk_score", "rank_score", "selected_threshold", "uplift_score", "uplift_segment_true",
    "expected_roi", "expected_incremental_profit", "retention_probability", "retention_prob", "business_value", "current_journey_stage",
    "journey_stage", "customer_journey_stage", "lifecycle_stage", "customer_status", "risk_stage", "risk_segment", "risk_tier",
    "churn_risk_stage", "churn_segment", "inactivity_days", "inactive_days", "days_since_last_event", "days_since_last_activity",
    "recency_days", "current_non_purchase_days", "non_purchase_days", "days_from_simulation_start",
}
# Parts of names that mark such columns.
LEAK_TOKENS = ("target", "label", "churn", "retention", "retained", "survival", "outcome", "future_", "next_", "after_", "post_", "predicted",
               "prediction", "probability", "risk_score", "rank_score", "selected_threshold", "days_to_churn", "days_until_churn", "uplift_score",
               "expected_roi", "expected_incremental_profit")
# Recency proxies, and the label sources they leak.
PROXY_TOKENS = ("inactivity_days", "inactive_days", "days_since_last_event", "days_since_last_activity", "recency_days",
                "current_non_purchase_days", "non_purchase_days")
PROXY_SOURCES = {"inactivity_rule", "current_inactivity_rule", "inactivity_rule_current_snapshot_fallback", "uploaded_inactivity_rule_observed"}
# The second, fail-safe list.
STRICT_TOKENS = ("current_journey_stage", "journey_stage", "customer_journey_stage", "lifecycle_stage", "customer_status", "churn_risk", "at_risk",
                 "risk_stage", "risk_segment", "risk_tier", "churn_segment", "dormant", "base_visit_prob", "base_purchase_prob", "base_exposure_prob",
                 "visit_probability", "purchase_probability", "exposure_probability", "visit_prob", "purchase_prob", "exposure_prob",
                 "recent_visit_score", "recent_purchase_score", "recent_exposure_score", "churn_probability", "uplift_score", "expected_roi",
                 "expected_incremental_profit", "selection_score", "priority_score", "recommendation_score")
# Parts of names that mark identifiers.
ID_TOKENS = ("customer_id", "user_id", "member_id", "account_id", "client_id", "order_id", "invoice", "session_id", "event_id", "transaction_id",
             "email", "phone", "uuid", "name")


def _names(column: str) -> tuple[str, str]:
    return column.strip().lower(), re.sub(r"[^a-z0-9]+", "_", column.lower()).strip("_")


def _proxy(column: str) -> bool:
    return any(t in n for n in _names(column) for t in PROXY_TOKENS)


def leaks_by_name(columns: list[str], label_source: str = "") -> list[str]:
    from_inactivity = label_source.lower() in PROXY_SOURCES

    def bad(c: str) -> bool:
        if _proxy(c):
            return from_inactivity
        return any(n in LEAK_COLUMNS or any(t in n for t in LEAK_TOKENS) for n in _names(c))
    return [c for c in columns if bad(c)]


def leaks_strict(columns: list[str], label_source: str = "") -> list[str]:
    from_inactivity = label_source.lower() in PROXY_SOURCES
    return [c for c in columns if (from_inactivity and _proxy(c)) or any(t in n for n in _names(c) for t in STRICT_TOKENS)]


def column_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, n, n_distinct) by way of one row per distinct value, not one distinct set per column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in cols])).alias("p")
    vals = df.select(pairs).groupBy("p.col", "p.v").agg(F.count(F.lit(1)).alias("k"))
    return vals.groupBy("col").agg(F.sum("k").alias("n"), F.count("v").alias("n_distinct"))


def identifiers(df: DataFrame, text_cols: list[str], ratio: float = 0.50) -> DataFrame:
    """Columns that look like ids, by name or by how many distinct texts they hold."""
    t = column_counts(df, text_cols)
    by_name = F.lit(False)
    for tok in ID_TOKENS:
        by_name = by_name | F.lower("col").contains(tok)
    many = (F.col("n_distinct") > 50) & ((F.lower("col").contains("sequence")) | (F.col("n_distinct") / F.col("n") >= ratio))
    return t.withColumn("is_identifier", (by_name | many).cast("int"))


def rank_auc(df: DataFrame, cols: list[str], label: str = "label") -> DataFrame:
    """AUC of each column alone, by rank sums over distinct values (ties averaged)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value")) for c in cols])).alias("p")
    pos = df.select(label, pairs).select(label, "p.col", "p.value").where("value IS NOT NULL").groupBy("col", "value").agg(F.sum(label).alias("pos"))
    cdf = value_cdf(df, cols).join(pos, ["col", "value"])
    rank = F.col("n_upto") - (F.col("n_value") - 1) / 2
    g = cdf.groupBy("col").agg(F.sum(rank * F.col("pos")).alias("rs"), F.sum("pos").alias("n1"), F.max("n_total").alias("n"))
    n0 = F.col("n") - F.col("n1")
    return g.select("col", ((F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * n0)).alias("auc"))


def target_proxies(df: DataFrame, numeric: list[str], text: list[str], label: str = "label", cut: float = 0.995) -> DataFrame:
    """Separation of each column alone: AUC either way for numbers, weighted purity for text."""
    a = rank_auc(df, numeric, label).select("col", F.greatest(F.col("auc"), 1 - F.col("auc")).alias("separation"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit("__missing__")).alias("v")) for c in text])).alias("p")
    v = df.select(label, pairs).groupBy("p.col", "p.v").agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n"))
    b = v.groupBy("col").agg((F.sum(F.greatest(F.col("pos"), F.col("n") - F.col("pos"))) / F.sum("n")).alias("separation"))
    return a.unionByName(b).withColumn("is_proxy", (F.col("separation") >= cut).cast("int"))


def date_parts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Year, month and weekday (Monday = 0) in place of each date column."""
    out = {}
    for c in cols:
        out.update({f"{c}_year": F.year(c), f"{c}_month": F.month(c), f"{c}_dayofweek": F.weekday(c)})
    return df.withColumns(out).drop(*cols)


def group_split(df: DataFrame, label: str = "label", share: float = 0.2, tries: int = 50) -> tuple[DataFrame, int]:
    """Customer-level split: the salt, out of `tries`, whose test label rate is nearest to the overall rate."""
    rate = F.avg(label)
    tests = [F.avg(F.when(stable_unit(F.col("customer_id"), 101 + 7919 * i) < share, F.col(label))) for i in range(tries)]
    got = df.agg(rate.alias("all"), *[t.alias(f"t{i}") for i, t in enumerate(tests)]).first()
    gaps = [(abs(got[f"t{i}"] - got["all"]) if got[f"t{i}"] is not None else 1.0, i) for i in range(tries)]
    salt = 101 + 7919 * min(gaps)[1]
    return df.withColumn("is_test", (stable_unit(F.col("customer_id"), salt) < share).cast("int")), salt


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    n = scalars(df, n=F.count(F.lit(1)), p=F.sum(label))
    pos, neg = max(n["p"] or 0, 1), max(n["n"] - (n["p"] or 0), 1)
    return df.withColumn("class_weight", F.when(F.col(label) == 1, n["n"] / (2.0 * pos)).otherwise(n["n"] / (2.0 * neg)))


def preprocess(numeric: list[str], text: list[str]) -> list:
    """Median for numbers, an own level for unseen or missing text, one-hot, one vector."""
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__num" for c in numeric])]
    if text:
        stages += [StringIndexer(inputCols=text, outputCols=[f"{c}__idx" for c in text], handleInvalid="keep"),
                   OneHotEncoder(inputCols=[f"{c}__idx" for c in text], outputCols=[f"{c}__hot" for c in text], dropLast=False)]
    return stages + [VectorAssembler(inputCols=[f"{c}__num" for c in numeric] + [f"{c}__hot" for c in text], outputCol="features")]


def fitted_preprocess(df: DataFrame, numeric: list[str], text: list[str]) -> PipelineModel:
    """The fitted stages of preprocess(). Medians come from one aggregate: its sketches are merged by a shuffle, whereas Imputer sends the sketch of every partition and column to the driver."""
    middle = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), 0.5, 10000).alias(c) for c in numeric])
    imputer, *rest = preprocess(numeric, text)
    one = df.sparkSession.createDataFrame(middle.collect(), middle.schema)      # the median of one row is that row
    return Pipeline(stages=[imputer.fit(one), *rest]).fit(df)


def train(df: DataFrame, numeric: list[str], text: list[str], label: str = "label", folds: int = 5, seed: int = 42,
          depths=(3, 5), sizes=(20, 40)) -> tuple[PipelineModel, str, dict[str, dict[str, float]]]:
    """Two model families, a small grid each, customer-level folds; best by test AUC, then by fold AUC."""
    split, _ = group_split(df.withColumns({c: F.col(c).cast("double") for c in numeric}), label)
    data = class_weight(split.withColumn("label", F.col(label).cast("double")), "label").withColumn(
        "fold", F.floor(stable_unit(F.col("customer_id"), 577) * folds).cast("int"))
    fit, test = data.where("is_test = 0"), data.where("is_test = 1")
    auc = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    rf = RandomForestClassifier(labelCol="label", weightCol="class_weight", seed=seed)
    gbt = GBTClassifier(labelCol="label", weightCol="class_weight", seed=seed)
    grids = {"random_forest": (rf, ParamGridBuilder().addGrid(rf.maxDepth, list(depths)).addGrid(rf.numTrees, list(sizes)).build()),
             "gradient_boosting": (gbt, ParamGridBuilder().addGrid(gbt.maxDepth, list(depths)).addGrid(gbt.maxIter, list(sizes)).build())}
    # what a fold learns of the columns is learned once for all settings; only label, weight and features are kept
    def ready(rows: DataFrame) -> tuple[PipelineModel, DataFrame]:
        prep = fitted_preprocess(rows, numeric, text)
        return prep, prep.transform(rows).select("label", "class_weight", "features").persist(StorageLevel.MEMORY_AND_DISK)
    settings = [(k, est, i, m) for k, (est, grid) in grids.items() for i, m in enumerate(grid)]
    found: dict[tuple[str, int], list[float]] = {(k, i): [] for k, _, i, _ in settings}
    with ThreadPool(4) as pool:
        for f in range(folds):
            prep, seen = ready(fit.where(F.col("fold") != f))
            held = prep.transform(fit.where(F.col("fold") == f)).select("label", "features").persist(StorageLevel.MEMORY_AND_DISK)
            one = inheritable_thread_target(df.sparkSession)(lambda s, seen=seen, held=held: ((s[0], s[2]), auc.evaluate(s[1].fit(seen, s[3]).transform(held))))
            for key, value in pool.map(one, settings, chunksize=1):
                found[key].append(value)
            seen.unpersist()
            held.unpersist()
    report, best, name = {}, None, ""
    prep, seen = ready(fit)
    for k, (est, grid) in grids.items():
        means = [sum(found[k, i]) / folds for i in range(len(grid))]
        model = PipelineModel(stages=[*prep.stages, est.fit(seen, grid[means.index(max(means))])])
        report[k] = {"cv_auc": max(means), "test_auc": auc.evaluate(model.transform(test))}
        if best is None or (report[k]["test_auc"], report[k]["cv_auc"]) > (report[name]["test_auc"], report[name]["cv_auc"]):
            best, name = model, k
    seen.unpersist()
    return best, name, report


def importances(model: PipelineModel, scored: DataFrame, n: int = 10) -> list[tuple[str, float]]:
    """Largest feature importances with their names from the vector's attributes."""
    attrs = scored.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
    imp = model.stages[-1].featureImportances
    ranked = sorted(((names.get(int(i), f"f{int(i)}"), float(v)) for i, v in zip(imp.indices, imp.values)), key=lambda x: -x[1])
    return ranked[:n]


def score(model: PipelineModel, df: DataFrame, numeric: list[str], changed: DataFrame | None = None) -> DataFrame:
    """Score all, or only the changed, customers; missing features count as 0."""
    if changed is not None:
        df = df.join(changed.select("customer_id").distinct(), "customer_id", "left_semi")
    ready = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in numeric})
    return model.transform(ready).withColumn("churn_score", vector_to_array("probability")[1])


def curve(df: DataFrame, score_col: str, label: str = "label") -> DataFrame:
    """One row per distinct score, descending: running tp and fp, precision, recall."""
    per = df.groupBy(F.col(score_col).alias("threshold")).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n"))
    run = ordered_totals(per, [("threshold", True)], {"tp": F.col("pos"), "flagged": F.col("n")})
    total = scalars(df, p=F.sum(label))["p"] or 0
    return run.select("threshold", "tp", (F.col("flagged") - F.col("tp")).alias("fp"), (F.lit(total) - F.col("tp")).alias("fn"),
                      (F.col("tp") / F.col("flagged")).alias("precision"), (F.col("tp") / F.lit(max(total, 1))).alias("recall"),
                      (F.col("pos") / F.lit(max(total, 1))).alias("recall_step"))


def average_precision(c: DataFrame) -> Column:
    return F.sum(F.col("recall_step") * F.col("precision"))


def with_value(c: DataFrame, tp: float = 120000.0, fp: float = 18000.0, fn: float = 60000.0) -> DataFrame:
    return c.withColumn("business_value", F.col("tp") * tp - F.col("fp") * fp - F.col("fn") * fn)
