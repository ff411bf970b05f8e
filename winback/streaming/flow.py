"""Streams: sources, dedup, counters, and the micro-batch that keeps the live tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from winback.operators import live
from winback.sources import adapters
from winback.sources.schemas import LIVE_EVENT, LIVE_EVENT_TYPES
from winback.sources.staging import new_path
from winback.streaming import signals
from winback.streaming.keyed import KeyedStore
from winback.streaming.ledger import Ledger


def event_stream(spark: SparkSession, d: str, files_per_batch: int = 1) -> DataFrame:
    """The event table as a file stream, with a timestamp the watermark accepts."""
    schema = adapters.table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(d)
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in adapters.RAW_EVENT_TYPES.items()], F.lit("other"))
    return raw.select("event_id", F.col("user_id").alias("customer_id"), F.col("ts").cast("timestamp").alias("event_time"), kind.alias("event_type"), F.col("value").alias("amount"))


def live_events(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON texts to typed events, and the ones that fail validation."""
    e = raw.select(F.col(column).alias("raw_text"), F.from_json(column, LIVE_EVENT).alias("e")).select("raw_text", "e.*")
    ok = F.col("customer_id").isNotNull() & F.col("event_time").isNotNull() & F.col("event_type").isin(*LIVE_EVENT_TYPES) & (F.coalesce("amount", F.lit(0.0)) >= 0)
    good = F.coalesce(ok, F.lit(False))
    return e.where(good).drop("raw_text"), e.where(~good).select("raw_text")


def dedup(events: DataFrame, key: str = "source_event_id", delay: str = "1 day") -> DataFrame:
    """Drop repeats of an id inside the watermark. Events without an id pass."""
    w = events.withWatermark("event_time", delay)
    return w.where(F.col(key).isNotNull()).dropDuplicatesWithinWatermark([key]).unionByName(w.where(F.col(key).isNull()))


def counter_stream(events: DataFrame) -> DataFrame:
    return events.groupBy("customer_id").agg(*live.counter_aggs())


def window_stream(events: DataFrame, days: int = 7, slide: int = 1, delay: str = "1 day") -> DataFrame:
    """Counts in true sliding windows; rows later than the watermark are dropped by Spark."""
    return live.sliding_counters(events.withWatermark("event_time", delay), days, slide)


def run_available(df: DataFrame, name: str, mode: str = "append", batch: Callable[[DataFrame, int], None] | None = None) -> str:
    """Run a stream over what is there now, to a table in the shared folder (or through `batch`), and give its path."""
    spark = df.sparkSession
    out, mark = new_path(spark, name), new_path(spark, f"{name}-checkpoint")

    def write(b: DataFrame, i: int) -> None:
        # the batch number in the path makes a repeated batch overwrite itself
        b.withColumn("batch_id", F.lit(i)).write.mode("overwrite").parquet(f"{out}/part={i}")
    q = df.writeStream.outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(batch or write).start()
    q.awaitTermination()
    return out


def latest_counts(path: str, spark: SparkSession) -> DataFrame:
    """Last version of each customer's row from an update-mode output."""
    return latest_of(spark.read.parquet(path))


def latest_of(t: DataFrame) -> DataFrame:
    rest = [c for c in t.columns if c not in ("customer_id", "batch_id", "part")]
    return t.groupBy("customer_id").agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select("customer_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def live_flow(known: DataFrame, tables: KeyedStore, threshold: float = 0.5) -> Callable[[DataFrame, int], None]:
    """Counters -> scores -> actions for the customers each micro-batch touches, as one version of the three tables.

    The counters come from an update-mode aggregate, so Spark's state store holds them and hands over only the
    customers that changed. A batch that is run again finds its version there and does nothing.
    """
    def batch(b: DataFrame, i: int) -> None:
        draft = tables.begin(i)
        if draft is None:
            return
        state = draft.put("state", b)
        scored = draft.put("scores", live.live_scores(state, known))
        draft.put("actions", live.live_actions(scored, threshold).withColumn("source_type", F.lit("live")))
        draft.commit()
    return batch


class Progress(StreamingQueryListener):
    """Adds up the observed counts of a stream's batches, for as long as the session lives."""

    def __init__(self, name: str) -> None:
        self.name, self.counts, self.batches = name, {}, set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        slot = (event.progress.id, event.progress.batchId)
        if row is not None and slot not in self.batches:
            self.batches.add(slot)
            for k, v in row.asDict().items():
                self.counts[k] = self.counts.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class Consumer:
    """Reads raw events (customer_id, event_id, timestamp as text, event_type) into scores, triggers and the closed loop.

    Events whose timestamp can't be read, or that have no customer, go to a table of their own, with the stream's other rows in one batch. Each batch commits its scores and
    counts as one version of a store and, side by side with it, its triggers as versions of the ledger's; both skip what they have, so a batch that is run again after a failure at any point
    ends what was begun. Whenever the number of good events passes a multiple of `every`, the ranking's first `top` customers are written as a snapshot.
    """

    OBSERVED = "consumed"

    def __init__(self, folder: str, base: DataFrame, menu: DataFrame, budget: float, capacity: int, every: int = 250, top: int = 200, delay: str = "1 day") -> None:
        spark = base.sparkSession
        self.folder, self.base, self.menu, self.every, self.top, self.delay = folder, base, menu, every, top, delay
        self.scores = KeyedStore(spark, f"{folder}/scores")
        self.ledger = Ledger(KeyedStore(spark, f"{folder}/ledger"), budget, capacity)

    def stream(self, raw: DataFrame) -> DataFrame:
        e = raw.withColumn("event_time", live.ts_normalise(F.col("timestamp")))
        ok = F.col("event_time").isNotNull() & F.col("customer_id").isNotNull()
        seen = e.observe(self.OBSERVED, F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))
        scored = signals.score_stream(seen.where(ok).select("customer_id", "event_id", "event_time", "event_type"), self.base, self.delay)
        bad = e.where(~ok).select(*[F.col(c) if c in ("customer_id", "event_id", "event_type") else F.lit(None).cast(scored.schema[c].dataType).alias(c) for c in scored.columns], "timestamp")
        return scored.withColumn("timestamp", F.lit(None).cast("string")).unionByName(bad)

    def batch(self, rows: DataFrame, i: int) -> None:
        spark = self.base.sparkSession
        rows.write.mode("overwrite").parquet(f"{self.folder}/batches/batch_id={i}")  # a repeated batch rewrites itself
        rows = spark.read.schema(rows.schema).parquet(f"{self.folder}/batches/batch_id={i}")
        # scores and decisions read the same written rows and nothing of one another
        with ThreadPoolExecutor(1) as beside:
            kept = beside.submit(inheritable_thread_target(rows.sparkSession)(self.keep), rows, i)
            self.ledger.decide(rows.where("event_time IS NOT NULL AND reasons <> ''"), self.menu, i)
            kept.result()

    def keep(self, rows: DataFrame, i: int) -> None:
        """Scores, counts and bad rows of one batch."""
        draft = self.scores.begin(i)
        if draft is None:
            return
        bad = F.col("event_time").isNull()
        own = ~bad & (F.col("event_type") != signals.SILENT)
        rows.where(bad).select("customer_id", "event_id", "event_type", "timestamp").write.mode("overwrite").parquet(f"{self.folder}/bad/batch_id={i}")
        n, m, last = rows.agg(F.count_if(own), F.count_if(bad), F.max(F.when(own, F.col("event_time")))).first()
        draft.put("scores", rows.where(own).groupBy("customer_id").agg(F.max_by(F.struct("churn_score", "event_time", "seen", *signals.NAMES), "seen").alias("r")).select("customer_id", "r.*"))
        old = draft.meta
        done = old.get("good", 0) + n
        draft.commit(good=done, bad=old.get("bad", 0) + m, last_event_at=str(last) if n else old.get("last_event_at"), snapshots=done // self.every)
        if done // self.every > old.get("snapshots", 0):
            self.snapshot(i)

    def snapshot(self, version: int) -> None:
        self.scores.read("scores", version).orderBy(F.desc("churn_score"), "customer_id").limit(self.top).write.mode("overwrite").option("header", True).csv(f"{self.folder}/snapshots/version={version}")

    def summary(self) -> dict:
        return {**{"good": 0, "bad": 0, "snapshots": 0, "last_event_at": None}, **self.scores.meta(), **self.ledger.left()}

    def run(self, raw: DataFrame, checkpoint: str) -> None:
        """Until the source has no more rows."""
        with rocks(raw.sparkSession):
            drain(self.stream(raw).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(self.batch).start())


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that stateful processors need, for the streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(q: StreamingQuery) -> None:
    """Waits until a stream of a source that ends has taken everything, then stops it."""
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def drained(df: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None) -> str:
    """As run_available, for sources that hand out a few rows a batch: runs until they have no more, and gives the path of the rows."""
    spark = df.sparkSession
    out, checkpoint = out or new_path(spark, name), checkpoint or new_path(spark, f"{name}-checkpoint")

    def write(b: DataFrame, i: int) -> None:
        b.withColumn("batch_id", F.lit(i)).write.mode("overwrite").parquet(f"{out}/part={i}")
    drain(df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).start())
    return out
