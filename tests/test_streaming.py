"""Streams against their batch twins, late and repeated events, odd timestamps."""

import json

from pyspark.sql import functions as F

from winback.operators.live import feature_counters, ts_normalise, upsert
from winback.registry import q_stream
from winback.sources.staging import new_path
from winback.streaming import flow, keyed, signals

SF = "/root/testdata/sf0.001"


def test_stateful_stream_equals_batch(spark):
    cols = ["customer_id", "event_id", "seen", "reasons", *[F.round(c, 9).alias(c) for c in ("churn_score", "previous_score", *signals.NAMES)]]
    a, b = q_stream.streamed(spark, SF).select(*cols), q_stream.replayed(spark, SF).select(*cols)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0


def test_repeats_invalid_rows_and_missing_ids(spark, tmp_path):
    def ev(i, sid, kind="visit", t="2024-01-01T00:00:00Z"):
        return json.dumps({"customer_id": i, "event_type": kind, "event_time": t, "amount": 1.0, "source_event_id": sid})
    rows = [ev(1, "a"), ev(1, "a"), ev(2, "b"), ev(3, None), ev(3, None), ev(4, "c", "teleport"), "{broken", ev(None, "d")]
    spark.createDataFrame([(r,) for r in rows], "value string").write.parquet(str(tmp_path / "in"))
    raw = lambda: spark.readStream.schema("value string").parquet(str(tmp_path / "in"))
    good, _ = flow.live_events(raw())
    _, bad = flow.live_events(raw())
    assert spark.read.parquet(flow.run_available(flow.dedup(good), "t-dedup")).count() == 4
    assert spark.read.parquet(flow.run_available(bad, "t-bad")).count() == 3


def test_a_batch_run_twice_changes_nothing(spark, tmp_path):
    known = spark.createDataFrame([(1, 1, 0.7, 100.0, 0.1, 10.0, "p", "s")], "customer_id long, known int, churn_probability double, clv double, uplift_score double, coupon_cost double, persona string, uplift_segment string")
    ev = lambda t, n: spark.createDataFrame([(c, f"2024-01-0{t} 00:00:00", "visit", 0.0) for c in range(1, n)], "customer_id long, t string, event_type string, amount double").select(
        "customer_id", F.col("t").cast("timestamp").alias("event_time"), "event_type", "amount")
    tables = keyed.KeyedStore(spark, str(tmp_path))
    run = flow.live_flow(known, tables)
    run(feature_counters(ev(1, 4)), 0)
    for _ in range(2):
        run(feature_counters(ev(1, 3).unionByName(ev(2, 3))), 1)
    got = {r["customer_id"]: r["event_count_total"] for r in tables.read("state").collect()}
    assert got == {1: 2, 2: 2, 3: 1}
    assert tables.read("actions").count() == 3 and tables.versions() == [0, 1]


def test_odd_timestamps(spark):
    texts = ["2024-01-01 10:00:00.", "2024-01-01 10:00:00:", "2024-01-01 19:00:00+09", "2024-01-01T19:00:00+0900", "2024-01-01T10:00:00Z", " 2024-01-01  10:00:00 ", "bad", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in df.select("i", F.date_format(ts_normalise(F.col("t")), "yyyy-MM-dd HH:mm:ss")).orderBy("i").collect()]
    assert got == ["2024-01-01 10:00:00"] * 6 + [None, None]


def test_upsert_keeps_old_where_new_is_null(spark):
    old = spark.createDataFrame([(1, 0.1, 5.0), (2, 0.2, 6.0)], "customer_id long, a double, b double")
    new = spark.createDataFrame([(2, 0.9, None), (3, 0.3, 7.0)], "customer_id long, a double, b double")
    assert sorted(tuple(r) for r in upsert(old, new).collect()) == [(1, 0.1, 5.0), (2, 0.9, 6.0), (3, 0.3, 7.0)]


def test_a_history_of_years(spark):
    """Signals of events three and nine years apart are finite and equal the plain sums at that moment."""
    times = ["2015-01-01 00:00:00", "2020-01-01 08:00:00", "2020-01-01 20:00:00", "2020-01-03 20:00:00", "2023-01-01 00:00:00", "2023-01-02 06:30:00"]
    rows = [(1, k, t, kind) for k, (t, kind) in enumerate(zip(times, ["visit", "visit", "purchase", "coupon_redeem", "visit", "visit"]))]
    ev = spark.createDataFrame(rows, "customer_id long, event_id long, t string, event_type string").select("customer_id", "event_id", F.col("t").cast("timestamp").alias("event_time"), "event_type")
    base = spark.createDataFrame([(1, 0.5)], "customer_id long, base double")
    got = {str(r["event_time"]): r for r in signals.replay(ev, base).collect()}
    for t in times:
        want = signals.signals_at(ev, F.lit(t).cast("timestamp")).first()
        for n in signals.NAMES:
            assert abs(got[t][n] - want[n]) < 1e-12
        assert 0 < got[t]["churn_score"] < 0.9


def test_deferral_is_decided_at_the_customers_turn(spark):
    """Customer 2 is too dear while places are left; customer 4 comes after the last place went."""
    from winback.streaming.decisions import closed_loop
    rows = [(c, f"2024-01-01 00:00:0{c}", c, cost) for c, cost in ((1, 10.0), (2, 500.0), (3, 10.0), (4, 10.0))]
    ch = spark.createDataFrame(rows, "customer_id long, t string, event_id long, coupon_cost double").select(
        "customer_id", F.col("t").cast("timestamp").alias("event_time"), "event_id", F.lit("").alias("reasons"), F.lit(0.9).alias("churn_score"), F.lit("mid").alias("intervention_intensity"), "coupon_cost",
        F.lit(50.0).alias("expected_incremental_profit"), F.lit(1.0).alias("expected_roi"), F.lit(1.0).alias("action_priority"), F.lit(1).alias("choice"))
    got = {r["customer_id"]: r["action_queue_status"] for r in closed_loop(ch, 100.0, 2).collect()}
    assert got == {1: "queued", 2: "deferred_budget_guardrail", 3: "queued", 4: "deferred_channel_guardrail"}


def test_decay_in_one_go_equals_step_by_step():
    import numpy as np
    rng = np.random.default_rng(3)
    hours = np.cumsum(np.append(rng.random(50) * 40, rng.random(6) * 30000))
    hit = rng.random(len(hours)) < 0.5
    for half in (18.0, 96.0):
        value, last, want = 0.7, 0.0, []
        for h, x in zip(hours, hit):
            value = value * 0.5 ** ((h - last) / half) + x
            last = h
            want.append(value)
        assert np.allclose(signals.decayed(hours, hit, half, 0.7), want, rtol=1e-12, atol=1e-300)


def test_customers_together_equal_one_by_one():
    """Signals of a part's customers, one of them very busy, computed at once and customer by customer."""
    import numpy as np
    rng = np.random.default_rng(5)
    n = np.array([3, signals.BUSY + 40, 1, 17, 17])
    first = np.cumsum(n) - n
    hours = np.concatenate([np.cumsum(rng.random(k) * 30) for k in n])
    hit = (rng.random((len(hours), len(signals.NAMES))) < 0.3).astype(float)
    start = rng.random((len(n), len(signals.NAMES)))
    got = signals.decayed_together(hours, hit, first, n, start)
    for c, k in enumerate(n):
        here = slice(first[c], first[c] + k)
        for j, half in enumerate(signals.HALVES):
            assert np.allclose(got[here, j], signals.decayed(hours[here], hit[here, j], half, start[c, j]), rtol=1e-12, atol=1e-300)


def test_state_is_kept_by_parts_of_customers(spark, tmp_path):
    """The engine calls Python once a part, not once a customer; unknown customers, missing ids and missing customers keep their rows."""
    many = 3 * signals.PARTS
    base = spark.range(many).select(F.col("id").alias("customer_id"), (F.col("id") / many).alias("base"))
    rows = [(c, e, f"2024-01-01 00:00:{e % 60:02}", "visit") for e, c in enumerate([*range(0, many, 2), None, None, many + 5])] + [(4, None, "2024-01-02 00:00:00", "purchase"), (None, 9001, "2024-01-02 00:00:00", "visit")]
    spark.createDataFrame(rows, "customer_id long, event_id long, t string, event_type string").select("customer_id", "event_id", F.to_timestamp("t").alias("event_time"), "event_type").write.parquet(str(tmp_path / "in"))
    with flow.rocks(spark):
        s = signals.score_stream(spark.readStream.schema("customer_id long, event_id long, event_time timestamp, event_type string").parquet(str(tmp_path / "in")), base)
        path, seen = new_path(spark, "parts"), []
        q = s.writeStream.option("checkpointLocation", new_path(spark, "parts-check")).trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("append").parquet(path)).start()
        q.awaitTermination()
        seen = max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators)
    got = spark.read.parquet(path).where(F.col("event_type") != signals.SILENT)
    assert sorted((r["customer_id"] is None, r["customer_id"] or 0, r["event_id"] is None, r["event_id"] or 0) for r in got.collect()) == sorted((c is None, c or 0, e is None, e or 0) for c, e, _, _ in rows)
    assert got.where("customer_id = 6").first()["previous_score"] == 6 / many and got.where(f"customer_id = {many + 5}").first()["previous_score"] == 0.5
    assert got.where("customer_id IS NULL").agg(F.max("seen")).first()[0] == 3
    assert seen < many                  # values of the store: parts (and timers), not customers


def test_the_consumer_takes_a_bounded_number_of_batches(spark, monkeypatch):
    """Far more ticks than micro-batches; counts, decisions and bad events are those of the whole table."""
    monkeypatch.setattr(q_stream, "staged", lambda s, d, name, build: build())
    monkeypatch.setattr(q_stream, "TICK", 20)
    monkeypatch.setattr(q_stream, "BATCHES", 2)
    got = q_stream.consumed(spark, SF).first()
    good = q_stream.A.events(spark, SF).where("event_id % 97 <> 0").count()
    assert len(list(q_stream.KeyedStore(spark, f"{got['folder']}/scores").versions())) <= 3          # one more ends the timers
    assert (got["good"], got["bad"]) == (good, q_stream.A.events(spark, SF).count() - good)
    assert spark.read.parquet(f"{got['folder']}/ledger/log").count() == got["asked"] > 0
