"""Sources, sinks and streams. Streams run over what is there (available-now) and are compared with their batch twins."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winback import params
from winback.plans import decision as D
from winback.plans import jobs as J
from winback.plans.summary import customer_summary
from winback.registry.core import CTES, cte, query
from winback.registry.q_decide import R6
from winback.registry.q_features import fm
from winback.registry.q_live import COUNT_SQL, known
from winback.registry.q_report import SETS, _sets
from winback.sources import adapters as A
from winback.sources import catalog as C
from winback.sources import replay as R
from winback.sources.staging import staged_path, new_path, staged
from winback.streaming import decisions as Q
from winback.streaming import flow as W
from winback.streaming import ledger as L
from winback.streaming import signals as G
from winback.streaming.keyed import KeyedStore


def _orders_csv(spark, d):
    path = new_path(spark, "orders-csv")
    o = A.orders(spark, d).select(F.col("order_id").cast("string").alias("order_id"), "customer_id", "order_time", "item_category", "quantity", "gross_amount", "discount_amount", "net_amount", "coupon_used")
    C.write_tables({"orders": o}, path, "csv")
    return path


@query("scan_optional", "SELECT 'orders' table_name, count(*) AS n, round(sum(net_amount), 2) amount FROM c_orders UNION ALL SELECT 'events', 0, NULL FROM c_orders HAVING count(*) > 0")
def scan_optional(spark, d):
    """A CSV table that is there and one that is not."""
    path = _orders_csv(spark, d)
    o = C.read_optional(spark, f"{path}/orders.csv", C.SCHEMAS["orders"]).agg(F.lit("orders").alias("table_name"), F.count(F.lit(1)).alias("n"), F.round(F.sum("net_amount"), 2).alias("amount"))
    e = C.read_optional(spark, f"{path}/events.csv", C.SCHEMAS["events"]).agg(F.lit("events").alias("table_name"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("amount"))
    return o.unionByName(e)


def _written(spark, d):
    path = new_path(spark, "tables")
    C.write_tables({"customers": A.customers(spark, d), "orders": A.orders(spark, d), "events": A.events(spark, d)}, path)
    return path


@query("scan_canonical", "SELECT 'customers' table_name, count(*) AS n FROM c_customers UNION ALL SELECT 'events', count(*) FROM c_events UNION ALL SELECT 'orders', count(*) FROM c_orders")
def scan_canonical(spark, d):
    """The tables a catalogue finds in a folder, with their rows."""
    cat = C.Catalog(spark, _written(spark, d))
    names = [r["table_name"] for r in cat.available().where("present").collect()]
    parts = [cat.read(n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n")) for n in sorted(names)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("scan_csv_tsv", "SELECT CASE item_category WHEN 'UNKNOWN' THEN '기타' ELSE '상품 ' || item_category END category, count(*) AS n, sum(quantity)::BIGINT quantity FROM c_orders GROUP BY 1")
def scan_csv_tsv(spark, d):
    """A tab-separated file in a Korean encoding, written and found out again."""
    path = f"{new_path(spark, 'orders')}.tsv"
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    name = F.when(F.col("item_category") == "UNKNOWN", "기타").otherwise(F.concat(F.lit("상품 "), F.col("item_category")))
    A.orders(spark, d).select(name.alias("category"), "quantity").write.option("encoding", "cp949").option("sep", "\t").option("header", True).csv(path)
    t = C.read_text_table(spark, path, "category string, quantity int")
    return t.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query("scan_projected", "SELECT customer_id, net_amount FROM c_orders WHERE net_amount > 200000")
def scan_projected(spark, d):
    """Two columns and one pushed filter of a wide table."""
    return A.orders(spark, d).select("customer_id", "net_amount").where(F.col("net_amount") > 200000)


@query("scan_first_existing", "SELECT count(*) AS n FROM c_events")
def scan_first_existing(spark, d):
    path = _written(spark, d)
    return C.first_existing(spark, [f"{path}/nothing", f"{path}/events", f"{path}/orders"]).agg(F.count(F.lit(1)).alias("n"))


@query("scan_json_report", "SELECT persona, count(*) AS n FROM c_summary GROUP BY 1")
def scan_json_report(spark, d):
    path = new_path(spark, "report-json")
    customer_summary(spark, d).groupBy("persona").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.json(path)
    return spark.read.json(path).select("persona", "n")


@query("sink_tables", "SELECT 'csv' fmt, count(*) AS n FROM c_orders UNION ALL SELECT 'parquet', count(*) FROM c_orders")
def sink_tables(spark, d):
    csv, pq = _orders_csv(spark, d), _written(spark, d)
    a = C.read_optional(spark, f"{csv}/orders.csv", C.SCHEMAS["orders"]).agg(F.lit("csv").alias("fmt"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(spark.read.parquet(f"{pq}/orders").agg(F.lit("parquet").alias("fmt"), F.count(F.lit(1)).alias("n")))


PREPROCESSED = {**SETS, "cohort_retention": "c_retention_sink"}
cte("c_retention_sink", "SELECT cohort_month FROM (SELECT strftime(signup_date, '%Y-%m') cohort_month, count(*) FROM c_customers GROUP BY 1)")


@query("sink_preprocessed", " UNION ALL ".join(f"SELECT '{k}' AS dataset, count(*) AS n, (SELECT count(*) FROM c_orders)::VARCHAR order_rows FROM {v}" for k, v in PREPROCESSED.items()))
def sink_preprocessed(spark, d):
    """All eight tables and their metadata, written and read back."""
    path = new_path(spark, "preprocessed")
    months = A.customers(spark, d).groupBy(F.date_format("signup_date", "yyyy-MM").alias("cohort_month")).agg(F.count(F.lit(1)).alias("cohort_size"))
    tables = {**_sets(spark, d), "cohort_retention": months}
    C.write_preprocessed(tables, {"order_rows": tables["orders"].count(), "source": "upload"}, path)
    meta = spark.read.json(f"{path}/metadata").first()
    counts = [spark.read.parquet(f"{path}/{k}").agg(F.lit(k).alias("dataset"), F.count(F.lit(1)).alias("n"), F.lit(meta["order_rows"]).alias("order_rows")) for k in tables]
    return reduce(DataFrame.unionByName, counts)


@query("sink_feature_store", f"SELECT customer_id, coalesce(visits_{params.SHORT}d, 0) visits, '{params.AS_OF_EVENTS}' as_of FROM c_customers LEFT JOIN c_evt USING (customer_id)")
def sink_feature_store(spark, d):
    """Saved under its as-of day and read back by partition."""
    store = C.FeatureStore(spark, new_path(spark, "features"))
    f = fm(spark, d).select("customer_id", F.col(f"visits_{params.SHORT}d").alias("visits"))
    store.save("customer_features", f, params.AS_OF_EVENTS)
    got = store.load("customer_features", params.AS_OF_EVENTS)
    return got.select("customer_id", "visits", store.metadata("customer_features").select("as_of").scalar().alias("as_of"))


@query("source_event_files", "SELECT event_type, count(*) AS n, round(sum(amount), 4) amount FROM c_events WHERE event_type IN ('visit', 'search', 'purchase', 'support_contact') GROUP BY 1")
def source_event_files(spark, d):
    e = W.event_stream(spark, d).where(F.col("event_type").isin("visit", "search", "purchase", "support_contact"))
    t = spark.read.parquet(W.run_available(e, "replay"))
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("amount"))


def placed_events(spark, d):
    """The events in order of time, as the replaying source reads them. One in 97 has a text for its time that is none."""
    text = F.when(F.col("event_id") % 97 == 0, "no time").otherwise(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    e = A.events(spark, d).select("event_id", "customer_id", "event_time", "event_type", "amount", text.alias("timestamp"))
    return staged(spark, d, "placed_events_folder", lambda: _placed(spark, e)).first()


def _placed(spark, events):
    path = new_path(spark, "placed-events")
    total = R.prepare(events, ["event_time", "event_id"], path)
    return spark.createDataFrame([(path, total)], "path string, total long")


TICK = 4000
# Micro-batches that a replay of a whole table takes at most. Ticks stay as they are; a micro-batch takes several.
BATCHES = 12


def ticks(spark, d):
    """Two rounds of the replaying source, TICK rows a tick."""
    def build():
        at = placed_events(spark, d)
        return spark.read.parquet(W.drained(R.replay(spark, at["path"], new_path(spark, "replay-mark"), TICK, 2, at["total"], ticks=R.backlog(at["total"], TICK, 2, BATCHES)), "ticks"))
    return staged(spark, d, "ticks", build)


@query("source_event_replay", "SELECT round, event_type, count(*) AS n, round(sum(amount), 4) amount FROM c_events, (VALUES (0), (1)) r(round) WHERE event_type IN ('visit', 'search', 'purchase', 'support_contact') GROUP BY 1, 2")
def source_event_replay(spark, d):
    """The replaying source, started again at its end, by round and type."""
    t = ticks(spark, d).where(F.col("event_type").isin("visit", "search", "purchase", "support_contact"))
    return t.groupBy("round", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("amount"))


def _json_files(spark, d):
    def build():
        e = A.events(spark, d)
        kind = F.when(F.col("event_id") % 101 == 0, "teleport").otherwise(F.col("event_type"))
        body = F.to_json(F.struct("customer_id", kind.alias("event_type"), "event_time", "amount",
                                  F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("s-"), (F.col("event_id") - F.col("event_id") % 10).cast("string"))).alias("source_event_id")))
        return e.select(F.when(F.col("event_id") % 89 == 0, "{broken").otherwise(body).alias("value"))
    return staged_path(spark, d, "live_json", build)


def json_stream(spark, d):
    return spark.readStream.schema("value string").parquet(_json_files(spark, d))


@query("source_live_event", """SELECT CASE WHEN event_id % 89 = 0 OR event_id % 101 = 0 THEN 'invalid' ELSE 'valid' END verdict, count(*) AS n FROM c_events GROUP BY 1""")
def source_live_event(spark, d):
    good, bad = W.live_events(json_stream(spark, d))
    a = spark.read.parquet(W.run_available(good, "live-good")).agg(F.lit("valid").alias("verdict"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(spark.read.parquet(W.run_available(bad, "live-bad")).agg(F.lit("invalid").alias("verdict"), F.count(F.lit(1)).alias("n")))


@query("event_dedup", """SELECT count(DISTINCT CASE WHEN event_id % 7 <> 0 THEN event_id - event_id % 10 END) + count(*) FILTER (event_id % 7 = 0) AS n FROM c_events WHERE event_id % 89 <> 0 AND event_id % 101 <> 0""")
def event_dedup(spark, d):
    """Repeats of a source id are dropped; events without one pass."""
    good, _ = W.live_events(json_stream(spark, d))
    return spark.read.parquet(W.run_available(W.dedup(good), "dedup")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_feature_counters", f"SELECT customer_id, event_count_total, purchase_30d, round(revenue_30d, 4) revenue_30d FROM (SELECT customer_id, count(*) event_count_total, {COUNT_SQL}, coalesce(sum(amount) FILTER (event_type = 'purchase'), 0.0) revenue_30d FROM c_events GROUP BY 1)")
def stream_feature_counters(spark, d):
    """Running counters as an update-mode stream; the last version of each customer equals the batch."""
    path = W.run_available(W.counter_stream(W.event_stream(spark, d)), "counters", "update")
    return W.latest_counts(path, spark).select("customer_id", "event_count_total", "purchase_30d", F.round("revenue_30d", 4).alias("revenue_30d"))


@query("stream_sliding_counters", """SELECT strftime(we, '%Y-%m-%d') window_end, count(*) events, count(DISTINCT customer_id) customers FROM (SELECT *, date_trunc('day', event_time) + (unnest(range(1, 8)))::INTEGER * INTERVAL 1 DAY we FROM c_events)
WHERE we <= (SELECT max(event_time) - INTERVAL 1 DAY FROM c_events) GROUP BY 1""")
def stream_sliding_counters(spark, d):
    """Sliding windows the watermark has closed."""
    path = W.run_available(W.window_stream(W.event_stream(spark, d)), "windows")
    t = spark.read.parquet(path)
    return t.groupBy(F.date_format("window_end", "yyyy-MM-dd").alias("window_end")).agg(F.sum("events").alias("events"), F.count_distinct("customer_id").alias("customers"))


def base(spark, d):
    return customer_summary(spark, d).select("customer_id", F.col("churn_probability").alias("base"))


def replayed(spark, d):
    return staged(spark, d, "replayed", lambda: G.replay(A.events(spark, d).select("event_id", "customer_id", "event_time", "event_type", "amount"), base(spark, d)))


def streamed(spark, d):
    def build():
        with W.rocks(spark):
            e = W.event_stream(spark, d).select("customer_id", "event_id", "event_time", "event_type")
            return spark.read.parquet(W.run_available(G.score_stream(e, base(spark, d)), "signals")).where(F.col("event_type") != G.SILENT)
    return staged(spark, d, "streamed", build)


DEC = {n: f"sum(CASE WHEN b.event_type = '{k}' THEN pow(0.5::DOUBLE, (epoch_us(a.event_time) - epoch_us(b.event_time)) / 3600000000.0::DOUBLE / {h}) ELSE 0.0 END)" for n, k, h, _ in G.SIGNALS}
cte("c_replay", f"""SELECT a.customer_id, a.event_id, a.event_time, any_value(a.event_type) event_type, count(*) seen, {', '.join(f'{e} {n}' for n, e in DEC.items())} FROM c_events a JOIN c_events b ON b.customer_id = a.customer_id AND (b.event_time < a.event_time OR (b.event_time = a.event_time AND b.event_id <= a.event_id)) GROUP BY 1, 2, 3""")
RISK = " + ".join(f"{w}::DOUBLE * {n}" for n, _, _, w in G.SIGNALS)
cte("c_scored", f"SELECT *, coalesce(lag(churn_score) OVER (PARTITION BY customer_id ORDER BY event_time, event_id), base) previous_score FROM (SELECT r.*, base, least(greatest(base + 0.22::DOUBLE / (1 + exp(7.0 / 3)) + {RISK}, 0.001), 0.999) churn_score FROM c_replay r JOIN (SELECT customer_id, churn_probability base FROM c_summary) USING (customer_id))")
WHY = f"""concat_ws(', ', CASE WHEN churn_score >= 0.80 AND previous_score < 0.80 THEN 'critical_risk_cross' END, CASE WHEN churn_score >= 0.65 AND previous_score < 0.65 THEN 'risk_threshold_cross' END,
 CASE WHEN churn_score - previous_score >= 0.12 THEN 'score_spike' END, CASE WHEN event_type IN ('remove_from_cart', 'support_contact') AND churn_score >= 0.65 THEN event_type || '_event' END)"""
cte("c_trig", f"SELECT *, {WHY} reasons FROM c_scored")


@query("state_bootstrap", "SELECT customer_id, round(base, 6) base FROM (SELECT DISTINCT customer_id, base FROM c_scored)")
def state_bootstrap(spark, d):
    """The state each streamed customer started from: its first previous score."""
    return streamed(spark, d).groupBy("customer_id").agg(F.round(F.min_by("previous_score", "seen"), 6).alias("base"))


@query("decayed_signals", "SELECT customer_id, event_id, round(visit_signal, 6) visit_signal, round(search_signal, 6) search_signal, round(purchase_signal, 6) purchase_signal, round(support_signal, 6) support_signal FROM c_replay")
def decayed_signals(spark, d):
    return replayed(spark, d).select("customer_id", "event_id", *R6("visit_signal", "search_signal", "purchase_signal", "support_signal"))


@query("realtime_score", "SELECT customer_id, event_id, round(churn_score, 6) churn_score, round(previous_score, 6) previous_score, seen FROM c_scored")
def realtime_score(spark, d):
    """From the stateful stream itself."""
    return streamed(spark, d).select("customer_id", "event_id", *R6("churn_score", "previous_score"), "seen")


@query("reopt_trigger", "SELECT customer_id, event_id, reasons FROM c_trig WHERE reasons <> ''")
def reopt_trigger(spark, d):
    return replayed(spark, d).where("reasons <> ''").select("customer_id", "event_id", "reasons")


@query("realtime_trigger_counts", "SELECT reason, count(*) AS n, count(DISTINCT customer_id) customers FROM (SELECT customer_id, unnest(string_split(reasons, ', ')) reason FROM c_trig WHERE reasons <> '') GROUP BY 1")
def realtime_trigger_counts(spark, d):
    """How often each trigger fired, and for how many customers."""
    t = replayed(spark, d).where("reasons <> ''").select("customer_id", F.explode(F.split("reasons", ", ")).alias("reason"))
    per = t.groupBy("reason", "customer_id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("reason").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("customers"))


_LAST = ", ".join(f"round(avg({n}), 6) {n}" for n in G.NAMES)


@query("realtime_signal_means", f"SELECT count(*) customers, {_LAST} FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY seen DESC) last FROM c_replay) WHERE last = 1")
def realtime_signal_means(spark, d):
    """Mean signals over customers, each after its last event."""
    last = replayed(spark, d).groupBy("customer_id").agg(*[F.max_by(n, "seen").alias(n) for n in G.NAMES])
    return last.agg(F.count(F.lit(1)).alias("customers"), *[F.round(F.avg(n), 6).alias(n) for n in G.NAMES])


@query("trigger_log", "SELECT customer_id, event_id, event_type, round(churn_score, 6) churn_score, reasons FROM c_trig WHERE reasons <> ''")
def trigger_log(spark, d):
    """Trigger rows of the stateful stream."""
    return streamed(spark, d).where("reasons <> ''").select("customer_id", "event_id", "event_type", *R6("churn_score"), "reasons")


IDLE = f"(epoch_us(TIMESTAMP '{params.AS_OF_EVENTS}') - epoch_us(max(event_time))) / 86400000000.0::DOUBLE"
SIG0 = ", ".join(f"sum(CASE WHEN event_type = '{k}' THEN pow(0.5::DOUBLE, (epoch_us(TIMESTAMP '{params.AS_OF_EVENTS}') - epoch_us(event_time)) / 3600000000.0::DOUBLE / {h}) ELSE 0.0 END) {n}" for n, k, h, _ in G.SIGNALS)


@query("score_at_as_of", f"""SELECT customer_id, round(least(greatest(base + 0.22::DOUBLE / (1 + exp(-((idle - 7) / 3))) + {RISK}, 0.001), 0.999), 6) churn_score FROM (SELECT customer_id, {IDLE} idle, {SIG0} FROM c_events WHERE event_time <= TIMESTAMP '{params.AS_OF_EVENTS}' GROUP BY 1)
JOIN (SELECT customer_id, churn_probability base FROM c_summary) USING (customer_id)""")
def score_at_as_of(spark, d):
    """Scores at one moment, where the inactivity term does its work."""
    end = F.lit(params.AS_OF_EVENTS).cast("timestamp")
    s = G.signals_at(A.events(spark, d), end).join(base(spark, d), "customer_id")
    idle = (F.unix_micros(end) - F.unix_micros("last_event_time")) / F.lit(86400000000.0)
    return s.select("customer_id", F.round(G.score(F.col("base"), idle), 6).alias("churn_score"))


def nz(c):
    w = "OVER (PARTITION BY customer_id)"
    return f"CASE WHEN max({c}) {w} - min({c}) {w} < 1e-12 THEN 0.0 ELSE ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w}) END"


cte("c_choice", f"""SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY round(ap, 9) DESC, expected_incremental_profit DESC, expected_roi DESC, coupon_cost)::INTEGER choice FROM (
SELECT a.customer_id, intervention_intensity, coupon_cost, expected_incremental_profit, expected_roi, event_time, event_id, 0.34 * {nz('expected_incremental_profit')} + 0.28 * {nz('greatest(expected_roi, 0.0)')} + 0.23 * timing_urgency_score + 0.15 * churn_score ap
FROM (SELECT * FROM c_api_actions WHERE coupon_cost > 0 AND expected_incremental_profit > 0) a JOIN (SELECT customer_id, event_time, event_id, churn_score FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY event_time DESC, event_id DESC) rn FROM c_trig WHERE reasons <> '') WHERE rn = 1) t USING (customer_id))""")


def choices(spark, d):
    return staged(spark, d, "choices", lambda: Q.action_choices(replayed(spark, d).where("reasons <> ''"), D.api_actions(spark, d)))


@query("reopt_action", "SELECT customer_id, intervention_intensity, coupon_cost, round(ap, 6) action_priority FROM c_choice WHERE choice = 1")
def reopt_action(spark, d):
    return choices(spark, d).where("choice = 1").select("customer_id", "intervention_intensity", "coupon_cost", *R6("action_priority"))


LOOP_B, LOOP_C = 150_000, 40
cte("c_loop", "SELECT *, row_number() OVER (ORDER BY event_time, event_id, customer_id, choice) rn FROM c_choice")
LOOP = f"""WITH RECURSIVE w(rn, spent, n, used, pick) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0::BIGINT, []::BIGINT[], false UNION ALL
 SELECT rn, CASE WHEN ok THEN spent + coupon_cost ELSE spent END, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN list_append(used, customer_id) ELSE used END, ok FROM (
 SELECT p.rn, spent, n, used, p.customer_id, p.coupon_cost, NOT list_contains(used, p.customer_id) AND spent + p.coupon_cost <= {LOOP_B} AND n < {LOOP_C} ok FROM w JOIN c_loop p ON p.rn = w.rn + 1)),
q AS (SELECT customer_id, intervention_intensity, coupon_cost, 'queued' action_queue_status FROM w JOIN c_loop USING (rn) WHERE pick)
SELECT * FROM q UNION ALL SELECT customer_id, intervention_intensity, coupon_cost, CASE WHEN (SELECT count(*) FROM q) >= {LOOP_C} AND rn > (SELECT max(rn) FROM w WHERE pick) THEN 'deferred_channel_guardrail' ELSE 'deferred_budget_guardrail' END FROM c_loop WHERE choice = 1 AND customer_id NOT IN (SELECT customer_id FROM q)"""


@query("closed_loop_batch", LOOP)
def closed_loop_batch(spark, d):
    """All triggers as one batch, the last of each customer."""
    return Q.closed_loop(choices(spark, d), LOOP_B, LOOP_C)


SNAPSHOT_EVERY = 2500


def menu(spark, d):
    return staged(spark, d, "action_menus", lambda: L.menus(D.api_actions(spark, d)))


def consumed(spark, d):
    """(folder, counts) of the whole path as one stream, TICK events a tick and several ticks a micro-batch: bad timestamps, scores, triggers, closed loop, snapshots."""
    def build():
        folder = new_path(spark, "consumer")
        with ThreadPoolExecutor(1) as beside:  # the events are put in order while base scores and menus are made
            placed = beside.submit(inheritable_thread_target(spark)(placed_events), spark, d)
            c = _consumer(spark, d, folder)
            at = placed.result()
        c.run(R.replay(spark, at["path"], new_path(spark, "consumer-mark"), TICK, 1, at["total"], ticks=R.backlog(at["total"], TICK, 1, BATCHES)).drop("event_time"), new_path(spark, "consumer-checkpoint"))
        got = c.summary()
        return spark.createDataFrame([(folder, got["good"], got["bad"], got["snapshots"], got["asked_total"])], "folder string, good long, bad long, snapshots long, asked long")
    return staged(spark, d, "consumer_folder", build)


def _consumer(spark, d, folder):
    return W.Consumer(folder, base(spark, d), menu(spark, d), LOOP_B, LOOP_C, every=SNAPSHOT_EVERY)


cte("c_good", "SELECT * FROM c_events WHERE event_id % 97 <> 0")
for _name in ("c_replay", "c_scored", "c_trig"):
    cte(f"{_name}_good", CTES[_name].replace("c_events", "c_good").replace("FROM c_replay ", "FROM c_replay_good ").replace("FROM c_scored", "FROM c_scored_good"))
# what is open for each set of used intensities, best first
_N = lambda c: f"CASE WHEN max({c}) OVER w - min({c}) OVER w < 1e-12 THEN 0.0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"
cte("c_menu", f"""SELECT customer_id, mask, list({{'bit': bit, 'cost': cost}} ORDER BY round(priority, 9) DESC, profit DESC, roi DESC, cost, bit) items FROM (
SELECT *, 0.34 * {_N('profit')} + 0.28 * {_N('gain')} + 0.23 * urgency priority FROM (SELECT customer_id, mask, list_position(['low', 'mid', 'high'], intervention_intensity) - 1 bit, coupon_cost AS cost, expected_incremental_profit profit, expected_roi roi,
 greatest(expected_roi, 0.0) gain, greatest(least(timing_urgency_score, 1.0), 0.0) urgency FROM c_api_actions, range(8) m(mask) WHERE coupon_cost > 0 AND expected_incremental_profit > 0) WHERE (mask::INTEGER >> bit::INTEGER) & 1 = 0 WINDOW w AS (PARTITION BY customer_id, mask)) GROUP BY 1, 2""")
cte("c_ask", "SELECT *, row_number() OVER (ORDER BY event_time, event_id) rn FROM c_trig_good WHERE reasons <> ''")
_STATE = "STRUCT(s VARCHAR, b INTEGER, c DOUBLE, u INTEGER)"
WALK = f"""WITH RECURSIVE w(rn, customer_id, event_id, s, b, c, u, money, room, m) AS (
 SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, -1, 0.0::DOUBLE, 0, {LOOP_B}::DOUBLE, {LOOP_C}::BIGINT, MAP([]::BIGINT[], []::{_STATE}[]) UNION ALL
 SELECT rn, customer_id, event_id, s2, b2, c2, u2, money + CASE WHEN o.s = 'queued' THEN o.c ELSE 0 END - CASE WHEN s2 = 'queued' THEN c2 ELSE 0 END,
        room + (o.s = 'queued')::INTEGER - (s2 = 'queued')::INTEGER, map_concat(m, MAP([customer_id], [{{'s': s2, 'b': b2, 'c': c2, 'u': u2}}::{_STATE}]))
 FROM (SELECT *, CASE WHEN items IS NULL THEN o.b ELSE coalesce(pick, items[1]).bit::INTEGER END b2, CASE WHEN items IS NULL THEN o.c ELSE coalesce(pick, items[1]).cost END c2,
         CASE WHEN pick IS NOT NULL THEN o.u | (1 << pick.bit::INTEGER) ELSE o.u END u2,
         CASE WHEN items IS NULL THEN 'hold' WHEN pick IS NOT NULL THEN 'queued' WHEN money > 0 AND room <= 0 THEN 'deferred_channel_guardrail' ELSE 'deferred_budget_guardrail' END s2
   FROM (SELECT p.rn, p.customer_id, p.event_id, money, room, m, o, n.items, CASE WHEN money > 0 AND room > 0 THEN list_filter(n.items, lambda x: x.cost <= money)[1] END pick
     FROM (SELECT w.money, w.room, w.m, p.rn, p.customer_id, p.event_id, coalesce(w.m[p.customer_id], {{'s': 'idle', 'b': -1, 'c': 0.0, 'u': 0}}::{_STATE}) o FROM w JOIN c_ask p ON p.rn = w.rn + 1) p
     LEFT JOIN c_menu n ON n.customer_id = p.customer_id AND n.mask = (p.o.u | CASE WHEN p.o.b >= 0 THEN 1 << p.o.b ELSE 0 END)))),
done AS (SELECT rn, customer_id, event_id, s, CASE WHEN b >= 0 THEN ['low', 'mid', 'high'][b + 1] END AS intensity, c, money, room FROM w WHERE rn > 0)
"""


@query("closed_loop_guard", WALK + "SELECT customer_id, arg_max(s, rn) action_queue_status, arg_max({'i': intensity}, rn).i intervention_intensity, round(arg_max(c, rn), 4) coupon_cost, count(*) asked FROM done GROUP BY 1")
def closed_loop_guard(spark, d):
    """What the stream left in every customer's queue: one budget over all batches, each trigger in turn, replaced actions released."""
    ledger = _consumer(spark, d, consumed(spark, d).first()["folder"]).ledger
    return ledger.queue().select("customer_id", F.col("status").alias("action_queue_status"), F.col("intensity").alias("intervention_intensity"), F.round("cost", 4).alias("coupon_cost"), F.col("asked").cast("long").alias("asked"))


@query("closed_loop_ledger", WALK + "SELECT event_id, customer_id, s action_queue_status, intensity intervention_intensity, round(money, 4) money_left, room places_left FROM done")
def closed_loop_ledger(spark, d):
    """The decision on every trigger, with the money and places left after it."""
    log = _consumer(spark, d, consumed(spark, d).first()["folder"]).ledger.log()
    return log.select("event_id", "customer_id", F.col("status").alias("action_queue_status"), F.col("intensity").alias("intervention_intensity"), F.round("money_left", 4).alias("money_left"), "places_left")


def flowed(spark, d):
    def build():
        tables = KeyedStore(spark, new_path(spark, "live-flow"))
        W.run_available(W.counter_stream(W.event_stream(spark, d)), "flow", "update", W.live_flow(known(spark, d), tables))
        return tables.read("actions")
    return staged(spark, d, "flow_actions", build)


@query("live_event_flow", "SELECT customer_id, recommended_action, action_cost, round(churn_score, 6) churn_score, should_queue FROM c_actions WHERE customer_id IN (SELECT customer_id FROM c_events)")
def live_event_flow(spark, d):
    """The whole live path as one stream; its last table equals the batch actions of the customers seen."""
    return flowed(spark, d).select("customer_id", "recommended_action", "action_cost", *R6("churn_score"), "should_queue")


@query("stream_scored", "SELECT count(*) AS n, count(DISTINCT customer_id) customers, round(max(churn_score), 6) top_score FROM c_scored")
def stream_scored(spark, d):
    return streamed(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("customer_id").alias("customers"), F.round(F.max("churn_score"), 6).alias("top_score"))


@query("stream_consume", f"""SELECT count(*) FILTER (event_id % 97 <> 0) good, count(*) FILTER (event_id % 97 = 0) bad, count(*) FILTER (event_id % 97 <> 0) // {SNAPSHOT_EVERY} snapshots,
 (SELECT count(*) FROM c_ask) asked, (SELECT count(DISTINCT customer_id) FROM c_good) customers, (SELECT round(sum(s), 4) FROM (SELECT arg_max(churn_score, seen) s FROM c_scored_good GROUP BY customer_id)) score_sum FROM c_events""")
def stream_consume(spark, d):
    """The counts a consumer commits batch by batch, and the scores it keeps."""
    got = consumed(spark, d)
    kept = _consumer(spark, d, got.first()["folder"]).scores.read("scores").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("churn_score"), 4).alias("score_sum"))
    return got.select("good", "bad", "snapshots", "asked").crossJoin(kept)


@query("stream_bad_times", "SELECT event_id, customer_id, 'no time' AS \"timestamp\" FROM c_events WHERE event_id % 97 = 0")
def stream_bad_times(spark, d):
    """The side table of events that could not be placed in time."""
    return spark.read.parquet(f"{consumed(spark, d).first()['folder']}/bad").select("event_id", "customer_id", "timestamp")


@query("stream_tick", f"""SELECT pos // {TICK} tick, count(*) AS n, min(round) first_round, max(round) last_round, sum(event_id)::BIGINT event_ids FROM (
SELECT *, round * (count(*) OVER (PARTITION BY round)) + row_number() OVER (PARTITION BY round ORDER BY event_time, event_id) - 1 AS pos FROM c_events, (VALUES (0), (1)) r(round)) GROUP BY 1""")
def stream_tick(spark, d):
    """So many rows a tick in order of time, over the end of the table into the next round."""
    return ticks(spark, d).groupBy("tick").agg(F.count(F.lit(1)).alias("n"), F.min("round").alias("first_round"), F.max("round").alias("last_round"), F.sum("event_id").alias("event_ids"))


# Behind the last order by more than a day, so that no check falls on the watermark itself.
SILENCE_DELAY = "25 hours"


def order_silences(spark, d):
    """Customers whose orders stop, as the stream's timers find them."""
    def build():
        path, o = new_path(spark, "placed-orders"), A.orders(spark, d)
        total = R.prepare(o.select(F.col("order_id").alias("event_id"), "customer_id", F.col("order_time").alias("event_time"), F.lit("purchase").alias("event_type")), ["event_time", "event_id"], path)
        with W.rocks(spark):
            e = R.replay(spark, path, new_path(spark, "orders-mark"), -(-total // 4), 1, total).select("customer_id", "event_id", "event_time", "event_type")
            return spark.read.parquet(W.drained(G.score_stream(e, base(spark, d), SILENCE_DELAY), "silences")).where(F.col("event_type") == G.SILENT)
    return staged(spark, d, "order_silences", build)


cte("c_bought", "SELECT order_id event_id, customer_id, order_time event_time, lead(order_time) OVER (PARTITION BY customer_id ORDER BY order_time, order_id) AS next FROM c_orders")
cte("c_silent", f"""SELECT customer_id, event_id, base, seen, day, event_time + to_days(day::INTEGER) AS due, base + 0.22::DOUBLE / (1 + exp(-((day - 7) / 3.0::DOUBLE))) - 0.16::DOUBLE * p raw, p FROM (
SELECT a.customer_id, a.event_id, a.event_time, any_value(a.next) AS next, any_value(base) base, count(*) seen, day, sum(pow(0.5::DOUBLE, ((epoch_us(a.event_time) - epoch_us(b.event_time)) / 3600000000.0::DOUBLE + 24 * day) / 72.0)) p
FROM c_bought a JOIN (SELECT customer_id, churn_probability base FROM c_summary) USING (customer_id) JOIN c_bought b ON b.customer_id = a.customer_id AND (b.event_time < a.event_time OR (b.event_time = a.event_time AND b.event_id <= a.event_id)), range({G.FIRST_DAY}, {G.LAST_DAY + 1}) days(day)
WHERE a.event_time + to_days(day::INTEGER) <= coalesce(a.next, (SELECT max(event_time) - INTERVAL 25 HOUR FROM c_bought)) GROUP BY ALL)""")
SILENCE = f"SELECT customer_id, min(epoch_us(due)) at_us, min(day) AS day, round(arg_min(least(raw, 0.999), day), 6) churn_score, min(seen) seen FROM c_silent WHERE p <= 0.10 AND raw >= {G.RISK} GROUP BY customer_id, event_id"


@query("stream_inactivity", f"SELECT customer_id, at_us, churn_score, seen FROM ({SILENCE})")
def stream_inactivity(spark, d):
    """`extended_inactivity` as the stream fires it."""
    return order_silences(spark, d).select("customer_id", F.unix_micros("event_time").alias("at_us"), *R6("churn_score"), "seen")


@query("inactivity_at", f"SELECT customer_id, at_us, day, churn_score, seen FROM ({SILENCE})")
def inactivity_at(spark, d):
    """The batch twin of the timers."""
    e = A.orders(spark, d).select(F.col("order_id").alias("event_id"), "customer_id", F.col("order_time").alias("event_time"), F.lit("purchase").alias("event_type"))
    end = e.agg(F.max("event_time") - F.expr("INTERVAL 25 HOURS")).first()[0]
    got = G.silences(G.replay(e, base(spark, d)), F.lit(end))
    return got.select("customer_id", F.unix_micros("event_time").alias("at_us"), F.col("day").cast("long").alias("day"), *R6("churn_score"), "seen")


cte("c_rank", "SELECT customer_id, arg_max(churn_score, seen) churn_score FROM c_scored GROUP BY 1")


@query("realtime_top", "SELECT customer_id, round(churn_score, 6) churn_score FROM c_rank ORDER BY c_rank.churn_score DESC, customer_id LIMIT 25")
def realtime_top(spark, d):
    last = streamed(spark, d).groupBy("customer_id").agg(F.max_by("churn_score", "seen").alias("s"))
    return last.orderBy(F.desc("s"), "customer_id").limit(25).select("customer_id", F.round("s", 6).alias("churn_score"))


@query("sink_snapshot_topn", "SELECT customer_id, round(churn_score, 6) churn_score, (SELECT count(*) FROM c_rank WHERE churn_score >= 0.65) high_risk FROM c_rank ORDER BY c_rank.churn_score DESC, customer_id LIMIT 50")
def sink_snapshot_topn(spark, d):
    """Top 50 of the ranking written as CSV, with the counts beside it."""
    last = staged(spark, d, "stream_last", lambda: streamed(spark, d).groupBy("customer_id").agg(F.max_by("churn_score", "seen").alias("churn_score")))
    path = new_path(spark, "ranking")
    last.orderBy(F.desc("churn_score"), "customer_id").limit(50).write.option("header", True).csv(path)
    n = last.where("churn_score >= 0.65").count()
    return spark.read.schema("customer_id long, churn_score double").csv(path, header=True).select("customer_id", *R6("churn_score"), F.lit(n).alias("high_risk"))


def batch_run(spark, d):
    """The folder of one finished run of all stages."""
    def build():
        folder = new_path(spark, "batch-run")
        J.Run(spark, folder, d, J.batch_stages(spark, d)).go()
        return spark.createDataFrame([(folder,)], "folder string")
    return J.Run(spark, staged(spark, d, "batch_run_folder", build).first()["folder"], d, J.batch_stages(spark, d))


@query("stage_jobs", """SELECT 'summary' stage, count(*) AS n FROM c_summary UNION ALL SELECT 'segments', count(*) FROM c_segments UNION ALL SELECT 'pool', count(*) FROM c_pool UNION ALL SELECT 'cohorts', count(*) FROM c_cohort
UNION ALL SELECT 'uplift_model', count(*) FROM c_upl UNION ALL SELECT 'survival_model', count(*) FROM c_summary UNION ALL SELECT 'dose_model', count(*) FROM c_dose UNION ALL SELECT 'fitted_actions', 3 * count(*) FROM c_summary""")
def stage_jobs(spark, d):
    """Rows of every stage of the batch run, models included, whose number doesn't hang on what the models say."""
    return batch_run(spark, d).rows().where(~F.col("stage").isin("fitted_pool", "fitted_selected"))


@query("fitted_plan")
def fitted_plan(spark, d):
    """Whom to contact by the fitted models."""
    got = batch_run(spark, d).table("fitted_selected")
    return got.select("customer_id", "intervention_intensity", "coupon_cost", *R6("uplift_score", "expected_incremental_profit", "selection_score"))


@query("session_window_counts", "SELECT customer_id, count(*) sessions, max(n) longest FROM (SELECT customer_id, s, count(*) n FROM (SELECT *, sum(brk) OVER (PARTITION BY customer_id ORDER BY event_time, event_id) s FROM (SELECT *, (coalesce(epoch_us(event_time) - epoch_us(lag(event_time) OVER (PARTITION BY customer_id ORDER BY event_time, event_id)), 1e18) >= 7200000000)::INTEGER brk FROM c_events)) GROUP BY 1, 2) GROUP BY 1")
def session_window_counts(spark, d):
    """Sessions by a two-hour gap, the other session source."""
    s = A.events(spark, d).groupBy("customer_id", F.session_window("event_time", "2 hours")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("customer_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))
