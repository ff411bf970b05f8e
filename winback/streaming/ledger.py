"""The closed loop: every trigger of a stream asks for an action, under one budget and one number of places.

A trigger takes the best action of its customer that was not used before and that the money left can pay; without money or places it is deferred, without
an unused action it is held. Either way what the customer had queued before is released. So every decision depends on all before it: the money and the
places left are one row that goes from block to block of triggers, in order of time. All that can be made side by side is: which actions a customer has
for every set of used ones, in order of preference, is a table made before the stream starts, and triggers are joined to it and to the customers'
states. What one task walks is a block of at most BLOCK slim rows. States, money and places of a block become visible as one version of a keyed store; a block
that is committed is never walked again, so a repeated batch takes nothing twice, and how events are cut into batches changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winback.functions.ranking import ordered_totals
from winback.sources.staging import cut
from winback.streaming.keyed import KeyedStore

#: Triggers walked by one task.
BLOCK = 50_000
#: Triggers are taken in this order, missing values last.
ORDER = ["event_time", "event_id", "customer_id"]
#: Intensities in the order of their bits.
INTENSITIES = ["low", "mid", "high"]
NAMES = {**dict(enumerate(INTENSITIES)), -1: None}
STATE = "customer_id long, status string, intensity string, cost double, priority double, used int, asked int, last_time timestamp"
OUTCOME = (f"{STATE}, event_id long, reasons string, churn_score double, place long, money_left double, places_left long, queued_total long, deferred_total long, held_total long")

#: Arrow's kinds of the columns that a walk makes.
ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}


def menus(actions: DataFrame) -> DataFrame:
    """(customer_id, menu): for each set of used intensities (a bit mask) the open actions from the best on, without the part of the priority that is the
    customer's score. Only actions that cost and gain something are offered; profit and return are scaled among the open ones."""
    bit = F.array_position(F.array(*map(F.lit, INTENSITIES)), F.col("intervention_intensity")).cast("int") - 1
    a = actions.where((F.col("coupon_cost") > 0) & (F.col("expected_incremental_profit") > 0)).select("customer_id", bit.alias("bit"), F.col("coupon_cost").alias("cost"),
        F.col("expected_incremental_profit").alias("profit"), F.col("expected_roi").alias("roi"), F.greatest(F.least("timing_urgency_score", F.lit(1.0)), F.lit(0.0)).alias("urgency"))
    masks = F.explode(F.sequence(F.lit(0), F.lit((1 << len(INTENSITIES)) - 1))).alias("mask")
    a = a.where("bit >= 0").select("*", masks).where(F.expr("(shiftright(mask, bit) & 1) = 0"))
    w = Window.partitionBy("customer_id", "mask")

    def scaled(c):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi - lo < 1e-12, 0.0).otherwise((c - lo) / (hi - lo))
    a = a.withColumn("priority", 0.34 * scaled(F.col("profit")) + 0.28 * scaled(F.greatest("roi", F.lit(0.0))) + 0.23 * F.col("urgency"))
    key = F.struct(-F.round("priority", 9), -F.col("profit"), -F.col("roi"), "cost", "bit")
    listed = a.groupBy("customer_id", "mask").agg(F.sort_array(F.collect_list(F.struct(key.alias("key"), F.struct("bit", "cost", "profit", "roi", "priority").alias("item")))).alias("l"))
    listed = listed.select("customer_id", "mask", F.transform("l", lambda x: x["item"]).alias("items"))
    return listed.groupBy("customer_id").agg(F.map_from_entries(F.collect_list(F.struct("mask", "items"))).alias("menu"))


def walked(rows: DataFrame, money: float, places: int, totals: tuple[int, int, int], before: int = 0) -> DataFrame:
    """The outcome of each trigger of a block, in ORDER, given what is left before it and how many triggers of the batch came before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, room, (queued, deferred, held), place = money, places, totals, before
        states: dict[int, tuple] = {}
        for b in batches:
            out, offers = [], opened(b.column("menu"))
            rows = zip(*[b.column(c).to_pylist() for c in ("customer_id", "churn_score", "status", "intensity", "cost", "priority", "used", "asked")])
            for row, (customer, churn, *kept) in enumerate(rows):
                status, intensity, cost, priority, used, asked = states.get(customer, kept if kept[0] is not None else ("idle", None, 0.0, 0.0, 0, 0))
                former = (status, cost)
                blocked = used | (1 << INTENSITIES.index(intensity) if intensity else 0)
                items = offers(row, blocked)
                if not items:
                    status = "hold"
                    held += 1
                else:
                    pick = None
                    if left > 0 and room > 0:
                        pick = next((x for x in items if x[1] <= left), None)
                    status = "queued" if pick is not None else "deferred_channel_guardrail" if left > 0 >= room else "deferred_budget_guardrail"
                    bit, cost, worth = pick if pick is not None else items[0]
                    intensity, priority = NAMES[bit], worth + 0.15 * churn
                    if pick is not None:
                        used |= 1 << bit
                        queued += former[0] != "queued"
                    else:
                        deferred += 1
                left += (former[1] if former[0] == "queued" else 0.0) - (cost if status == "queued" else 0.0)
                room += (former[0] == "queued") - (status == "queued")
                asked += 1
                place += 1
                states[customer] = (status, intensity, cost, priority, used, asked)
                out.append((status, intensity, cost, priority, used, asked, place, left, room, queued, deferred, held))
            if out:
                made = dict(zip(("status", "intensity", "cost", "priority", "used", "asked", "place", "money_left", "places_left", "queued_total", "deferred_total", "held_total"), zip(*out)))
                given = {"last_time": b.column("event_time")} | {c: b.column(c) for c in ("customer_id", "event_id", "reasons", "churn_score")}
                columns = [c.split() for c in OUTCOME.split(", ")]
                yield pa.RecordBatch.from_arrays([given[c] if c in given else pa.array(made[c], ARROW[kind]) for c, kind in columns], names=[c for c, _ in columns])

    return rows.coalesce(1).sortWithinPartitions(*[F.asc_nulls_last(c) for c in ORDER]).mapInArrow(run, OUTCOME)


def opened(menus: pa.MapArray) -> Callable[[int, int], list[tuple[int, float, float]]]:
    """Gives the (bit, cost, priority) open in a row's menu for a set of used intensities, best first; none for a row without a menu."""
    at, masks, lists = menus.offsets.to_numpy(), menus.keys.to_pylist(), menus.items
    ends, bits, costs, priorities = lists.offsets.to_numpy(), *[lists.values.field(c).to_pylist() for c in ("bit", "cost", "priority")]
    there = menus.is_valid().to_pylist()

    def offers(row: int, used: int) -> list[tuple[int, float, float]]:
        for k in range(at[row], at[row + 1]) if there[row] else ():
            if masks[k] == used:
                return [(bits[x], costs[x], priorities[x]) for x in range(ends[k], ends[k + 1])]
        return []
    return offers


class Ledger:
    """Money and places of a closed loop, and the state of every customer who asked. Reruns of a batch and of a block find them as they were left."""

    TABLE = "queue"

    def __init__(self, store: KeyedStore, budget: float, capacity: int, block: int = BLOCK) -> None:
        self.store, self.budget, self.capacity, self.block = store, float(budget), int(capacity), block

    def left(self) -> dict:
        return self.store.meta() or {"money_left": self.budget, "places_left": self.capacity, "queued_total": 0, "deferred_total": 0, "held_total": 0, "asked_total": 0}

    def decide(self, triggers: DataFrame, menu: DataFrame, batch_id: int) -> None:
        """triggers: customer_id, event_id, event_time, churn_score, reasons of one batch."""
        found = triggers.select("customer_id", "event_id", "event_time", "churn_score", "reasons")
        n = found.count()
        if n > self.block:
            found = cut(ordered_totals(found, [(c, False) for c in ORDER], {"place": F.lit(1).cast("long")}), "ledger-triggers")
        for k in range(-(-n // self.block)):
            draft = self.store.begin((batch_id << 20) + k)
            if draft is None:
                continue
            now, done_before = self.left(), k * self.block
            size = min(self.block, n - done_before)
            part = found if n <= self.block else found.where(F.col("place").between(done_before + 1, done_before + size)).drop("place")
            states = self.store.read(self.TABLE, keys=part, few=size <= self.store.buckets)
            if states is None:
                states = self.store.spark.createDataFrame([], STATE)
            # a block's customers are few beside all menus: those are cut to its own before they meet its rows
            own = menu.join(part.select("customer_id").distinct(), "customer_id", "left_semi")
            rows = part.join(own, "customer_id", "left").join(states.drop("last_time"), "customer_id", "left")
            path = f"{self.store.folder}/log/version={draft.version}"  # a repeated block rewrites its own
            walked(rows, now["money_left"], now["places_left"], (now["queued_total"], now["deferred_total"], now["held_total"]), done_before).write.mode("overwrite").parquet(path)
            done = self.store.spark.read.schema(OUTCOME).parquet(path)
            names = [c.split()[0] for c in STATE.split(", ")]
            draft.put(self.TABLE, done.groupBy("customer_id").agg(F.max_by(F.struct(*names[1:]), "place").alias("r")).select("customer_id", "r.*"))
            end = done.where(F.col("place") == done_before + size).select("money_left", "places_left", "queued_total", "deferred_total", "held_total").first()
            draft.commit(**end.asDict(), asked_total=now["asked_total"] + size)

    def queue(self) -> DataFrame:
        """The last state of every customer who asked."""
        got = self.store.read(self.TABLE)
        return self.store.spark.createDataFrame([], STATE) if got is None else got

    def log(self) -> DataFrame:
        """The outcome of every trigger, of committed blocks only."""
        last = self.store.manifest()["version"]
        return self.store.spark.read.schema(f"{OUTCOME}, version long").parquet(f"{self.store.folder}/log").where(F.col("version") <= last).withColumnRenamed("last_time", "event_time")
