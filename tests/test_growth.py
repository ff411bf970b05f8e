"""What steps read, write and send must follow their input, not a grid, a pool or a number of fits."""

import datetime as dt
import re

from pyspark.sql import functions as F

from winback.functions import ranking, vocab
from winback.operators import budget, churn, cohort, features, ingest, uplift
from winback.sources import adapters
from winback.streaming import signals


def people(spark, n=400):
    k = F.col("customer_id")
    return spark.range(1, n + 1).withColumnRenamed("id", "customer_id").select(
        "customer_id", (k % 17).cast("double").alias("x"), F.when(k % 5 != 0, (k % 11).cast("double")).alias("gap"), F.concat(F.lit("p"), k % 3).alias("persona"),
        ((k % 17 > 8) | (k % 7 == 0)).cast("int").alias("label"))


def test_snapshot_grid_is_filled_after_the_windows(spark):
    act = spark.createDataFrame([(1, dt.datetime(2000, 1, 1), "visit"), (1, dt.datetime(2000, 1, 15, 9), "purchase"), (1, dt.datetime(2000, 1, 15), "visit"), (1, dt.datetime(2000, 3, 1), "visit"),
                                 (2, dt.datetime(2000, 3, 4, 5), "visit")], "customer_id long, event_time timestamp, event_type string")
    got = features.activity_snapshots(act, spark.createDataFrame([(1, 2.5)], "customer_id long, avg_amount double"), "2000-03-05", step=14, risk=30)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate") < plan.index("Window")
    rows = {(r["customer_id"], str(r["snapshot_date"])): r for r in got.collect()}
    assert sorted(d for c, d in rows if c == 1) == ["2000-01-01", "2000-01-15", "2000-01-29", "2000-02-12", "2000-02-26", "2000-03-05"]
    assert [d for c, d in rows if c == 2] and sorted(d for c, d in rows if c == 2) == ["2000-03-04", "2000-03-05"]
    on = rows[1, "2000-01-15"]          # the purchase at nine counts in the totals, and as a time from the next snapshot on
    assert (on["visits_total"], on["purchases_total"], on["monetary_total"]) == (2, 1, 2.5) and on["last_visit_date"] == on["last_purchase_date"] == dt.datetime(2000, 1, 15)
    assert rows[1, "2000-01-29"]["last_purchase_date"] == dt.datetime(2000, 1, 15, 9) and rows[1, "2000-01-29"]["recent_visit_score"] == 0.0
    assert rows[1, "2000-03-05"]["last_visit_date"] == dt.datetime(2000, 3, 1) and rows[1, "2000-03-05"]["recent_visit_score"] == 1.0


def test_a_walk_reads_the_stretch_its_money_reaches(spark, monkeypatch):
    n = 3000
    pool = spark.range(1, n + 1).select(F.col("id").alias("place"), (F.col("id") % 900).alias("customer_id"), (F.col("id") % 7 + 1).cast("double").alias("coupon_cost"),
                                        F.when(F.col("id") % 2 == 0, "high").otherwise("low").alias("intervention_intensity"))
    rows = [(r["place"], r["customer_id"], r["coupon_cost"], r["intervention_intensity"] == "high") for r in pool.orderBy("place").collect()]

    def walk(left, high):
        seen, got = set(), []
        for place, who, cost, strong in rows:
            if who not in seen and cost <= left and (not strong or high > 0):
                left, high = left - cost, high - strong
                seen.add(who)
                got.append(place)
        return got
    sizes, totals = [], budget.ordered_totals

    def counted(df, *args, **kw):
        sizes.append(df.count())
        return totals(df, *args, **kw)
    monkeypatch.setattr(budget, "ordered_totals", counted)
    for money in (37, 900, 100000):
        got = sorted(r["place"] for r in budget.greedy(pool, [money], high_cap=60, width=64).select("place").collect())
        assert got == walk(money, 60)
        if money == 37:
            assert max(sizes) <= 64


def test_months_hold_one_row_a_customer_and_month(spark, monkeypatch):
    sizes, cut = [], cohort.cut

    def counted(df, name):
        sizes.append(df.count())
        return cut(df, name)
    monkeypatch.setattr(cohort, "cut", counted)
    c = spark.createDataFrame([(1, "2000-01"), (2, "2000-01")], "customer_id long, acquisition_month string")
    e = spark.createDataFrame([(1, dt.datetime(2000, 1, 3), "visit"), (1, dt.datetime(2000, 1, 4), "purchase"), (1, dt.datetime(2000, 3, 4), "coupon_open"), (2, dt.datetime(2000, 2, 4), "purchase"), (3, dt.datetime(2000, 6, 1), "visit")],
                              "customer_id long, event_time timestamp, event_type string")
    t = {(r["activity_definition"], r["retention_mode"], r["period"]): r for r in cohort.retention(c, e).collect()}
    assert sizes == [4]
    assert t["all_activity", "point", 1]["retained_customers"] == 1 and t["all_activity", "rolling", 1]["retained_customers"] == 2
    assert t["purchase_only", "point", 2]["retained_customers"] is None and t["purchase_only", "point", 2]["observed"] is False
    assert t["core_engagement", "rolling", 5]["retained_customers"] == 0 and t["core_engagement", "rolling", 5]["observed"]


def test_columns_are_learned_once_a_fold(spark, monkeypatch):
    calls, fitted = [], churn.fitted_preprocess

    def counted(df, *args):
        calls.append(1)
        return fitted(df, *args)
    monkeypatch.setattr(churn, "fitted_preprocess", counted)
    _, best, report = churn.train(people(spark), ["x", "gap"], ["persona"], folds=2, depths=(2, 3), sizes=(3,))
    assert len(calls) == 3 and set(report) == {"random_forest", "gradient_boosting"} and all(r["cv_auc"] > 0.6 for r in report.values())


def test_medians_of_the_preparation(spark):
    t = people(spark)
    model = churn.fitted_preprocess(t, ["x", "gap"], ["persona"])
    seen = sorted(r["gap"] for r in t.where("gap IS NOT NULL").collect())
    assert model.stages[0].surrogateDF.first()["gap"] == seen[(len(seen) - 1) // 2]


def test_dose_fits_read_written_rows(spark):
    t = people(spark).withColumn("dose_intensity", F.element_at(F.array(*[F.lit(a) for a in uplift.ARMS]), (F.col("customer_id") % 4 + 1).cast("int")))
    side = t.select("customer_id", F.col("label").cast("double").alias("retained"))
    got = uplift.dose_effects(t.drop("label").join(side, "customer_id"), ["x", "gap"], ["persona"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 400


def test_ranges_do_not_write_the_key(spark, monkeypatch):
    columns, cut = [], ranking.cut

    def seen(df, name):
        columns.append(df.columns)
        return cut(df, name)
    monkeypatch.setattr(ranking, "cut", seen)
    got = ranking.ordered_totals(people(spark), [("x", True), ("customer_id", False)], {"k": F.lit(1)})
    assert [r["customer_id"] for r in got.orderBy("k").limit(2).collect()] == [16, 33] and "_key" not in columns[0]


def test_line_items_are_aggregated_once(spark, tmp_path, monkeypatch):
    d, day = str(tmp_path), lambda n: dt.datetime(1999, 1, n)
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    write("lineitem", [(1, 7, 3, 1, 1.0, 50.0, 0.1), (1, 5, 3, 2, 2.0, 50.0, 0.02), (1, 9, 3, 3, 1.0, 10.0, 0.06), (2, 9, 3, 1, 4.0, 30.0, 0.0)],
          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double")
    write("orders", [(1, 1, 5.0, day(3), "2-HIGH"), (2, 1, 5.0, day(9), "5-LOW"), (3, 2, 5.0, day(4), "5-LOW"), (4, 2, 5.0, day(4), "5-LOW"), (5, 2, 5.0, day(8), "5-LOW"), (6, 3, 8.0, day(6), "5-LOW")],
          "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string")
    write("part", [(5, "five"), (7, "seven"), (9, "nine")], "p_partkey long, p_type string")
    write("customer", [(k, "p", 0, 1.0) for k in range(1, 5)], "c_custkey long, c_mktsegment string, c_nationkey int, c_acctbal double")
    write("nation", [(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int")
    write("region", [(0, "r")], "r_regionkey int, r_name string")
    read, table = [], adapters.table

    def seen(spark, d, name):
        read.append(name)
        return table(spark, d, name)
    monkeypatch.setattr(adapters, "table", seen)
    c = {r["customer_id"]: r for r in adapters.customers(spark, d).collect()}
    o = {r["order_id"]: r for r in adapters.orders(spark, d).collect()}
    at = {r["customer_id"]: r["assigned_at"].day for r in adapters.assignments(spark, d).collect()}
    assert read.count("lineitem") == 1
    assert (o[1]["item_category"], o[1]["gross_amount"], o[1]["quantity"], o[1]["coupon_used"], o[3]["item_category"], o[6]["gross_amount"]) == ("five", 110.0, 4, 1, "UNKNOWN", 8.0)
    assert (c[1]["price_sensitivity"], c[1]["coupon_affinity"], c[3]["price_sensitivity"], c[4]["signup_date"]) == (0.45, 0.5, 0.5, None) and "lines" not in o[1]
    assert at == {1: 10, 2: 5, 3: 7}


def test_places_take_one_shuffle_of_the_rows(spark):
    t = people(spark).withColumn("persona", F.when(F.col("customer_id") % 4 != 0, F.col("persona")))
    order = [("gap", True), ("persona", False), ("customer_id", True)]
    got = ranking.placed(t, order)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.index("Window [") < plan.index("Aggregate [")      # over the ranges, not over the rows
    rows = sorted(t.collect(), key=lambda r: (r["gap"] is None, -(r["gap"] or 0), r["persona"] is None, r["persona"] or "", -r["customer_id"]))
    assert [r["customer_id"] for r in got.orderBy("place").collect()] == [r["customer_id"] for r in rows]
    assert sorted(r["place"] for r in got.collect()) == list(range(1, 401)) and got.columns == [*t.columns, "place"]
    assert ranking.placed(t.limit(0), order).count() == 0


def test_base_scores_are_joined_to_days(spark):
    ev = spark.createDataFrame([(c, 10 * c + i, dt.datetime(2024, 1, 1 + i // 2, i), "visit") for c in (1, 2, 3) for i in range(4)], "customer_id long, event_id long, event_time timestamp, event_type string")
    base = spark.createDataFrame([(1, 0.5), (3, 0.7)], "customer_id long, only_base double").withColumnRenamed("only_base", "base")
    got = signals.replay(ev, base)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("only_base") and sum("LogicalRDD" in line and "only_base" in line for line in plan.splitlines()) == 2      # the scores and each day's last one; with the events too, four
    rows = got.orderBy("event_id").collect()
    assert [r["event_id"] for r in rows] == [10, 11, 12, 13, 30, 31, 32, 33] and [r["seen"] for r in rows] == [1, 2, 3, 4] * 2
    assert rows[0]["previous_score"] == 0.5 and rows[4]["previous_score"] == 0.7 and rows[1]["previous_score"] == rows[0]["churn_score"]


def test_event_map_is_worked_out_once_per_value(spark):
    """A filter on the type reads the written map: the vocabulary isn't searched for every row. Nulls, blanks, exact words, longest words and unknown ones get their type."""
    values = [None, "", " -- ", "purchase", "Purchase Item", "x_view!", "zzz", "CLICK / report_issue"]
    rows = spark.createDataFrame([(values[k % len(values)],) for k in range(80)], "action string")
    m = ingest.event_map(rows, "action")
    words = [(w, t, i) for i, (w, t) in enumerate((w, t) for t, ws in vocab.EVENT_VALUES.items() for w in ws)]

    def by_hand(value):
        flat = re.sub("_+", "_", re.sub("[^a-z0-9가-힣]", "_", (value or "").strip().lower())).strip("_")
        inside = sorted((-len(w), i, t) for w, t, i in words if len(w) >= 4 and w in flat)
        return next((t for w, t, _ in words if w == flat), inside[0][2] if inside else "other") if flat else "other"
    assert {r["value"]: (r["n"], r["event_type"]) for r in m.collect()} == {v: (10, by_hand(v)) for v in values}
    other = m.where("event_type = 'other'")
    plan = other._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "Aggregate" not in plan, plan
    assert {r["value"] for r in other.collect()} == {v for v in values if by_hand(v) == "other"}
