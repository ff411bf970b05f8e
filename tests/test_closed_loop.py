"""The replaying source, timers and the closed loop: how events are cut into batches and where a stream breaks off change nothing."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from winback.sources import replay
from winback.sources.staging import cut, new_path
from winback.streaming import flow, signals
from winback.streaming.keyed import KeyedStore
from winback.streaming.ledger import INTENSITIES, Ledger, menus

ACTION = "customer_id long, intervention_intensity string, coupon_cost double, expected_incremental_profit double, expected_roi double, timing_urgency_score double"


def actions(rng, customers):
    return [(c, k, float(rng.choice([0, 10, 25, 40, 60])), float(rng.randrange(-5, 60)), rng.random() * 3 - 1, rng.random() * 1.2) for c in range(customers) for k in INTENSITIES]


def asks(rng, n, customers):
    """A third of all triggers are one customer's; customer 99 has no actions."""
    return [(rng.choice([0, 0, 0, *range(customers), 99]), e, f"2024-01-01 {e // 40 % 24:02}:{e % 40 // 2:02}:00", round(rng.random(), 3), "score_spike") for e in range(n)]


def triggers(spark, rows):
    return spark.createDataFrame(rows, "customer_id long, event_id long, t string, churn_score double, reasons string").select("customer_id", "event_id", F.to_timestamp("t").alias("event_time"), "churn_score", "reasons")


def by_hand(offers, rows, budget, capacity):
    """The rules, one trigger after the other."""
    left, room, state, log = budget, capacity, {}, []
    for customer, event, _, score, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        status, kind, cost, used = state.get(customer, ("idle", None, 0.0, set()))
        free = [a for a in offers if a[0] == customer and a[2] > 0 and a[3] > 0 and a[1] not in used and a[1] != kind]

        def scaled(i, low=None):
            v = [max(a[i], low) if low is not None else a[i] for a in free]
            return [0.0 if max(v) - min(v) < 1e-12 else (x - min(v)) / (max(v) - min(v)) for x in v]
        new = status, kind, cost, used
        if not free:
            new = "hold", kind, cost, used
        else:
            rank = [0.34 * p + 0.28 * r + 0.23 * min(max(a[5], 0.0), 1.0) for a, p, r in zip(free, scaled(3), scaled(4, 0.0))]
            best = [a for _, a in sorted(zip(rank, free), key=lambda x: (-round(x[0], 9), -x[1][3], -x[1][4], x[1][2], INTENSITIES.index(x[1][1])))]
            fits = [a for a in best if a[2] <= left] if left > 0 and room > 0 else []
            if fits:
                new = "queued", fits[0][1], fits[0][2], used | {fits[0][1]}
            else:
                new = "deferred_channel_guardrail" if left > 0 and room <= 0 else "deferred_budget_guardrail", best[0][1], best[0][2], used
        left += (cost if status == "queued" else 0) - (new[2] if new[0] == "queued" else 0)
        room += (status == "queued") - (new[0] == "queued")
        state[customer] = new
        log.append((event, customer, new[0], new[1], round(left, 6), room))
    return log


@pytest.mark.parametrize("batches, block", [(1, 50_000), (5, 16), (20, 50_000)])
def test_batches_and_repeats_spend_the_same(spark, tmp_path, batches, block):
    rng = random.Random(2)
    offers, rows = actions(rng, 12), asks(rng, 100, 12)
    budget, capacity = 160.0, 5
    menu = menus(spark.createDataFrame(offers, ACTION)).cache()
    ledger = Ledger(KeyedStore(spark, str(tmp_path), buckets=2), budget, capacity, block)
    cuts = [len(rows) * i // batches for i in range(batches + 1)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(2 if i == batches // 2 else 1):
            ledger.decide(triggers(spark, rows[a:b]), menu, i)
    got = [(r["event_id"], r["customer_id"], r["status"], r["intensity"], round(r["money_left"], 6), r["places_left"]) for r in ledger.log().orderBy("event_time", "event_id").collect()]
    assert got == by_hand(offers, rows, budget, capacity)
    assert {r[2] for r in got} == {"queued", "hold", "deferred_budget_guardrail", "deferred_channel_guardrail"}
    assert all(0 <= r[4] <= budget and 0 <= r[5] <= capacity for r in got)
    queued = ledger.queue().where("status = 'queued'").agg(F.sum("cost"), F.count("*")).first()
    assert budget - (queued[0] or 0) == pytest.approx(ledger.left()["money_left"]) and capacity - queued[1] == ledger.left()["places_left"]
    assert ledger.left()["asked_total"] == len(rows)


def test_a_batch_broken_between_blocks_goes_on(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    offers, rows = actions(rng, 8), asks(rng, 40, 8)
    menu = menus(spark.createDataFrame(offers, ACTION)).cache()
    ledger = Ledger(KeyedStore(spark, str(tmp_path), buckets=2), 200.0, 4, block=10)
    begin, calls = ledger.store.begin, []

    def breaks(version):
        calls.append(version)
        if len(calls) == 3:
            raise RuntimeError("the driver is lost")
        return begin(version)
    monkeypatch.setattr(ledger.store, "begin", breaks)
    with pytest.raises(RuntimeError):
        ledger.decide(triggers(spark, rows), menu, 0)
    ledger.decide(triggers(spark, rows), menu, 0)
    got = [(r["event_id"], r["status"], round(r["money_left"], 6)) for r in ledger.log().orderBy("event_time", "event_id").collect()]
    assert got == [(r[0], r[2], r[4]) for r in by_hand(offers, rows, 200.0, 4)]


def jobs_of(spark, work):
    """Spark jobs that a piece of work starts."""
    group = new_path(spark, "jobs")
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_small_batch_takes_few_jobs(spark, tmp_path):
    """What a micro-batch of one block costs is mostly jobs: its triggers aren't put in order by a job of their own, and what was written isn't counted by reading it."""
    rng = random.Random(3)
    offers, rows = actions(rng, 30), asks(rng, 400, 30)
    menu = cut(menus(spark.createDataFrame(offers, ACTION)), "test-menus")
    ledger = Ledger(KeyedStore(spark, str(tmp_path), buckets=4), 500.0, 9)
    written = [cut(triggers(spark, rows[k: k + 100]), "test-asks") for k in range(0, 400, 100)]
    jobs = [jobs_of(spark, lambda: ledger.decide(t, menu, i)) for i, t in enumerate(written)]
    assert max(jobs) <= 18, jobs
    got = [(r["event_id"], r["customer_id"], r["status"], r["intensity"], round(r["money_left"], 6), r["places_left"]) for r in ledger.log().orderBy("event_time", "event_id").collect()]
    assert got == by_hand(offers, rows, 500.0, 9)


def test_no_triggers(spark, tmp_path):
    ledger = Ledger(KeyedStore(spark, str(tmp_path)), 100.0, 4)
    ledger.decide(triggers(spark, []), menus(spark.createDataFrame([], ACTION)), 0)
    assert ledger.queue().collect() == [] and ledger.left()["money_left"] == 100.0


# ------------------------------------------------------------ source

def placed(spark, n=25, slot_rows=4):
    path = new_path(spark, "test-placed")
    events = spark.createDataFrame([(k, k % 3, f"2024-01-0{1 + k % 7} 00:00:00") for k in range(n)], "event_id long, customer_id long, t string").withColumn("event_time", F.to_timestamp("t")).drop("t")
    assert replay.prepare(events.repartition(3), ["event_time", "event_id"], path, slot_rows) == n
    return path


def test_restart_repeats_and_loses_nothing(spark):
    path, mark, checkpoint, out = placed(spark), new_path(spark, "mark"), new_path(spark, "check"), new_path(spark, "out")
    for rounds in (1, 1, 3):            # to the end, nothing more, then two further rounds from the same checkpoint
        flow.drained(replay.replay(spark, path, mark, 11, rounds, slot_rows=4), "r", checkpoint, out)
    got = spark.read.parquet(out)
    assert Counter(r[0] for r in got.select("event_id").collect()) == {k: 3 for k in range(25)}
    sizes = {r["batch_id"]: r["count"] for r in got.groupBy("batch_id").count().collect()}
    assert sum(sizes.values()) == 75 and max(sizes.values()) <= 11
    seen = [(r["batch_id"], r["round"], r["place"]) for r in got.select("batch_id", "round", "place").orderBy("round", "place").collect()]
    assert seen == sorted(seen)         # in order over batches and rounds


def test_a_micro_batch_takes_several_ticks(spark):
    """The number of micro-batches is bounded whatever the rows; ticks, rows and their order stay."""
    ticks = replay.backlog(25, 3, 2, 4)
    out = flow.drained(replay.replay(spark, placed(spark), new_path(spark, "mark"), 3, 2, slot_rows=4, ticks=ticks), "r")
    got = spark.read.parquet(out)
    assert Counter((r["round"], r["event_id"]) for r in got.collect()) == {(t, k): 1 for t in (0, 1) for k in range(25)}
    assert {r["tick"]: r["count"] for r in got.groupBy("tick").count().collect()} == {t: min(3, 50 - 3 * t) for t in range(17)}
    assert all(r["tick"] == (r["round"] * 25 + r["place"]) // 3 for r in got.collect())
    assert got.select("batch_id").distinct().count() <= 4
    assert replay.backlog(10**9, 4000, 2, 12) * 4000 * 12 >= 2 * 10**9 and replay.backlog(0, 5, 1, 12) == 1


def test_a_failed_batch_is_read_again(spark):
    path, mark, checkpoint = placed(spark), new_path(spark, "mark"), new_path(spark, "check")
    rows, broken = [], []

    def batch(b, i):
        if i == 2 and not broken:
            broken.append(i)
            raise RuntimeError("lost")
        rows.extend(r["event_id"] for r in b.collect())
    start = lambda: replay.replay(spark, path, mark, 6, 1, slot_rows=4).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()
    with pytest.raises(Exception, match="lost"):
        flow.drain(start())
    flow.drain(start())
    assert sorted(rows) == list(range(25))


def test_later_rounds_can_be_later_in_time(spark):
    out = flow.drained(replay.replay(spark, placed(spark, 8), new_path(spark, "mark"), 5, 2, slot_rows=4, shift_us=7 * signals.DAY_US), "r")
    days = {(r["round"], r["event_time"].day) for r in spark.read.parquet(out).collect()}
    assert days == {(0, d) for d in range(1, 8)} | {(1, d + 7) for d in range(1, 8)}


def test_an_empty_table_ends_at_once(spark):
    path = new_path(spark, "test-empty")
    spark.createDataFrame([], "event_id long, place long, slot long").write.parquet(path)
    q = replay.replay(spark, path, new_path(spark, "mark"), 5, 1).writeStream.option("checkpointLocation", new_path(spark, "check")).foreachBatch(lambda b, i: None).start()
    flow.drain(q)


# ------------------------------------------------------------ timers and consumer

def silent_events(rng):
    """Customers with gaps of up to 40 days, before and inside the stream, and one that never rests."""
    out, e = [], 0
    for customer in range(6):
        t = rng.randrange(5 * 86400)
        while t < 150 * 86400:
            out.append((customer, e, t, rng.choice(["visit", "purchase", "support_contact"])))
            e += 1
            t += rng.randrange(86400 if customer == 5 else 40 * 86400)
    return out


@pytest.mark.parametrize("rows", [10_000, 40])
def test_silences_of_stream_and_batch(spark, rows):
    rng = random.Random(7)
    ev = spark.createDataFrame(silent_events(rng), "customer_id long, event_id long, t long, event_type string").withColumn("event_time", F.timestamp_seconds("t")).drop("t")
    base = spark.createDataFrame([(c, 0.3 + 0.1 * c) for c in range(6)], "customer_id long, base double")
    path = new_path(spark, "test-silent")
    total = replay.prepare(ev, ["event_time", "event_id"], path)
    with flow.rocks(spark):
        s = replay.replay(spark, path, new_path(spark, "mark"), rows, 1, total).select("customer_id", "event_id", "event_time", "event_type")
        got = spark.read.parquet(flow.drained(signals.score_stream(s, base, "3 hours"), "silent"))
    end = ev.agg(F.max("event_time") - F.expr("INTERVAL 3 HOURS")).first()[0]
    want = signals.silences(signals.replay(ev, base), F.lit(end))
    cols = ["customer_id", "event_time", "seen", F.round("churn_score", 9), F.round("previous_score", 9)]
    fired = Counter(tuple(r) for r in got.where("event_type = 'inactivity'").select(*cols).collect())
    assert fired == Counter(tuple(r) for r in want.select(*cols).collect()) and len(fired) > 8
    assert got.where("event_type <> 'inactivity'").count() == total


def test_silences_of_customers_that_share_a_part(spark, monkeypatch):
    """A part's timer is at the earliest of its customers' times."""
    monkeypatch.setattr(signals, "PARTS", 2)
    test_silences_of_stream_and_batch(spark, 40)


def test_a_timer_that_is_early_stays():
    """Events put a part's next look off; its timer is set again only when there is none, or a later one."""
    calls = []

    class Handle:
        def deleteTimer(self, t):
            calls.append(("off", t))

        def registerTimer(self, t):
            calls.append(("on", t))
    processor = signals.SignalProcessor()
    processor._handle = Handle()
    state = np.zeros(2, signals.ROW)
    state["last"], state["silent"] = [5 * signals.DAY_US, 9 * signals.DAY_US], signals.FIRST_DAY
    due = (5 + signals.FIRST_DAY) * 86_400_000
    for timers in ([], [due + 1], [due], [due - 1]):
        processor._look_again(state, timers)
    state["silent"] = 0
    processor._look_again(state, [])
    assert calls == [("on", due), ("off", due + 1), ("on", due)]


def test_consumer_counts_keeps_and_resumes(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 2, 3, None]) if e % 11 == 0 else rng.choice([1, 2, 3]), e, "soon" if e % 7 == 0 else f"2024-01-01T{e // 4:02}:{e % 4 * 15:02}:00Z", rng.choice(["support_contact", "visit"])) for e in range(60)]
    ev = spark.createDataFrame(rows, "customer_id long, event_id long, timestamp string, event_type string")
    path, folder, mark, checkpoint = (new_path(spark, n) for n in ("consume-in", "consume", "mark", "check"))
    total = replay.prepare(ev, ["event_id"], path)
    base = spark.createDataFrame([(c, 0.6) for c in (1, 2, 3)], "customer_id long, base double")
    menu = menus(spark.createDataFrame([(c, k, 10.0 * (i + 1), 30.0, 1.0, 0.5) for c in (1, 2, 3) for i, k in enumerate(INTENSITIES)], ACTION)).cache()
    consumer = flow.Consumer(folder, base, menu, 65.0, 3, every=20, top=2)
    progress = flow.Progress(consumer.OBSERVED)
    spark.streams.addListener(progress)
    ask, broken = consumer.ledger.decide, []

    def breaks(*args):
        if not broken:
            broken.append(1)
            raise RuntimeError("lost between scores and ledger")
        ask(*args)
    consumer.ledger.decide = breaks
    stream = lambda: replay.replay(spark, path, mark, 25, 1, total).select("customer_id", "event_id", "timestamp", "event_type")
    with pytest.raises(Exception, match="lost"):
        consumer.run(stream(), checkpoint)
    consumer.run(stream(), checkpoint)
    spark.streams.removeListener(progress)
    bad = {e for c, e, t, _ in rows if t == "soon" or c is None}
    got = consumer.summary()
    assert (got["good"], got["bad"], got["snapshots"]) == (60 - len(bad), len(bad), (60 - len(bad)) // 20)
    assert {r["event_id"] for r in spark.read.parquet(f"{folder}/bad").collect()} == bad
    kept = {r["customer_id"]: r["seen"] for r in consumer.scores.read("scores").collect()}
    assert kept == Counter(c for c, e, _, _ in rows if e not in bad)
    assert 0 <= got["money_left"] <= 65 and got["asked_total"] == consumer.ledger.log().count() > 0
    assert spark.read.option("header", True).csv(f"{folder}/snapshots").count() >= 2
    assert progress.counts["good"] >= 60 - len(bad) and progress.counts["bad"] >= len(bad)
