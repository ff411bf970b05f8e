"""State per customer: nine decayed signals, the score, and the triggers that ask for a new action."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from winback.functions.ranking import previous_in_key

# Signal, its event type, half-life in hours, weight in the score.
SIGNALS = [
    ("visit_signal", "visit", 18.0, -0.09),
    ("browse_signal", "browse", 18.0, -0.04),
    ("search_signal", "search", 18.0, -0.05),
    ("cart_signal", "add_to_cart", 24.0, -0.07),
    ("cart_remove_signal", "remove_from_cart", 36.0, 0.06),
    ("purchase_signal", "purchase", 72.0, -0.16),
    ("support_signal", "support_contact", 72.0, 0.13),
    ("coupon_open_signal", "coupon_open", 36.0, -0.05),
    ("coupon_redeem_signal", "coupon_redeem", 96.0, -0.12),
]
NAMES = [s[0] for s in SIGNALS]
# Trigger limits.
CRITICAL, RISK, SPIKE = 0.80, 0.65, 0.12
# The inactivity rule looks at whole days of silence, from the first on which its limit of 0.75 can hold.
FIRST_DAY, LAST_DAY = 11, 30
DAY_US = 86_400_000_000
HALVES, WEIGHTS = np.array([s[2] for s in SIGNALS]), np.array([s[3] for s in SIGNALS])
#: Customers are dealt into so many parts by their hash, and a part's states are one value of the state store: calls between the engine and Python follow the parts, not the customers.
#: Fixed for the life of a checkpoint. Events without a customer are a part of their own.
PARTS, NOBODY = 1024, -1
#: Stands for a missing event_id, last in its order, so that the others stay whole numbers.
NO_EVENT = 2**63 - 1
#: Events of one customer in a batch above which the customer's signals are computed by themselves.
BUSY = 512
#: One customer's state. The whole days `silent` are those after which a silent customer is looked at next.
ROW = np.dtype([("customer_id", "i8"), ("base", "f8"), ("score", "f8"), ("last", "i8"), ("seen", "i8"), ("silent", "i8"), ("signals", "f8", (len(NAMES),))])
STATE = "states binary"
OUTPUT = ("customer_id long, event_id long, event_time timestamp, event_type string, churn_score double, previous_score double, "
          "reasons string, seen long, " + ", ".join(f"{n} double" for n in NAMES))


def inactivity(days: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-((days - 7.0) / 3.0)))


def signals_at(events: DataFrame, as_of: Column) -> DataFrame:
    """Signals at one moment as plain sums: an event still counts one half to the power of (its age / half-life)."""
    age = (F.unix_micros(as_of) - F.unix_micros("event_time")) / F.lit(3.6e9)
    return events.where(F.col("event_time") <= as_of).groupBy("customer_id").agg(
        *[F.sum(F.when(F.col("event_type") == kind, F.pow(F.lit(0.5), age / half)).otherwise(0.0)).alias(name) for name, kind, half, _ in SIGNALS],
        F.max("event_time").alias("last_event_time"), F.count(F.lit(1)).alias("seen"))


def score(base: Column, idle_days: Column) -> Column:
    risk = sum((F.lit(w) * F.col(n) for n, _, _, w in SIGNALS), F.lit(0.22) * inactivity(idle_days))
    return F.least(F.greatest(base + risk, F.lit(0.001)), F.lit(0.999))


def triggers(current: Column, previous: Column, kind: Column, idle: Column) -> Column:
    """Reasons for a new decision, in a fixed order; an empty text is none."""
    quiet = F.col("purchase_signal")
    cells = [
        F.when((current >= CRITICAL) & (previous < CRITICAL), "critical_risk_cross"), F.when((current >= RISK) & (previous < RISK), "risk_threshold_cross"),
        F.when(current - previous >= SPIKE, "score_spike"),
        F.when(kind.isin("remove_from_cart", "support_contact") & (current >= RISK), F.concat(kind, F.lit("_event"))),
        F.when((F.col("support_signal") >= 0.85) & (F.col("cart_remove_signal") >= 0.85) & (quiet <= 0.15), "support_and_cart_remove_without_purchase"),
        F.when((idle >= 0.75) & (quiet <= 0.10) & (current >= RISK), "extended_inactivity")]
    return F.array_join(F.array_compact(F.array(*cells)), ", ")


#: Shortest half-lives in a stretch of days; powers of two up to it stay far inside a double. What is older than the stretch before is below 2^-90 even of the longest half-life.
STRETCH = 500


def replay(events: DataFrame, base: DataFrame) -> DataFrame:
    """Batch twin of the stateful stream: the score after every event, with the triggers.

    Signals only decay and add. Inside a (customer, day) they are running sums of 2^(hours of the day / half-life), scaled back to the
    event's time, so a very busy customer is spread over its days. What earlier days carry over comes from one row a
    day: sums relative to the start of a stretch of days, plus the stretch before it, so no power
    overflows however long the history is. All signals share two windows.
    """
    day = F.to_date("event_time")
    start = F.unix_micros(F.col("_day").cast("timestamp"))
    e = events.withColumn("_day", day)

    def steps(rows: DataFrame) -> DataFrame:
        """What each event adds, made where it is summed and not shuffled."""
        rows = rows.withColumn("_h", (F.unix_micros("event_time") - start) / F.lit(3.6e9))
        return rows.withColumns({f"_x_{n}": F.when(F.col("event_type") == kind, F.pow(F.lit(2.0), F.col("_h") / half)).otherwise(0.0) for n, kind, half, _ in SIGNALS})
    daily = steps(e).groupBy("customer_id", "_day").agg(*[F.sum(f"_x_{n}").alias(f"_d_{n}") for n in NAMES], F.count(F.lit(1)).alias("_d_seen"))
    past = Window.partitionBy("customer_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    span = STRETCH * min(h for _, _, h, _ in SIGNALS)                      # hours of a stretch, one for all signals
    daily = daily.withColumns({"_c_seen": F.coalesce(F.sum("_d_seen").over(past), F.lit(0)), "_at": F.unix_date("_day") * 24.0})
    daily = daily.withColumn("_s", F.floor(F.col("_at") / span).cast("long")).withColumn("_into", F.col("_at") - F.col("_s") * span)
    here = Window.partitionBy("customer_id", "_s").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("customer_id").orderBy("_s").rangeBetween(-1, -1)
    halves = {n: half for n, _, half, _ in SIGNALS}
    daily = daily.withColumns({f"_w_{n}": F.col(f"_d_{n}") * F.pow(F.lit(2.0), F.col("_into") / half) for n, half in halves.items()})
    daily = daily.withColumns({f"_h_{n}": F.coalesce(F.sum(f"_w_{n}").over(here), F.lit(0.0)) for n in halves}).withColumns({f"_b_{n}": F.coalesce(F.sum(f"_w_{n}").over(before), F.lit(0.0)) for n in halves})
    daily = daily.withColumns({f"_c_{n}": F.pow(F.lit(2.0), -F.col("_into") / half) * (F.col(f"_h_{n}") + F.col(f"_b_{n}") * 2.0 ** -(span / half)) for n, half in halves.items()})
    inside = Window.partitionBy("customer_id", "_day").orderBy("event_time", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    # base scores come with the days, which lie by customers already; events are dealt once, by customer and day
    daily = daily.join(base, "customer_id")
    s = steps(e.join(daily.select("customer_id", "_day", "base", *[f"_c_{n}" for n in [*NAMES, "seen"]]), ["customer_id", "_day"]))
    s = s.withColumns({**{n: (F.sum(f"_x_{n}").over(inside) + F.col(f"_c_{n}")) * F.pow(F.lit(2.0), -F.col("_h") / half) for n, _, half, _ in SIGNALS},
                       "seen": F.count(F.lit(1)).over(inside) + F.col("_c_seen")})
    s = s.withColumn("churn_score", score(F.col("base"), F.lit(0.0))).select(*events.columns, "_day", "base", *NAMES, "seen", "churn_score")
    s = previous_in_key(s, ["customer_id"], "event_time", {"churn_score": "previous_score"}, ["event_id"], day="_day").drop("_day")
    s = s.withColumn("previous_score", F.coalesce("previous_score", "base"))
    return s.withColumn("reasons", triggers(F.col("churn_score"), F.col("previous_score"), F.col("event_type"), inactivity(F.lit(0.0))))


def decayed(hours: np.ndarray, hit: np.ndarray, half: float, start: float) -> np.ndarray:
    """A signal after each of a run of events: `hours` since the start never fall, `hit` tells which events add one, `start` is its value at hour 0."""
    out = np.empty(len(hours))
    part = np.floor(hours / (STRETCH * half)).astype(np.int64)
    at, value = 0.0, start
    for lo in np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist():
        hi = int(np.searchsorted(part, part[lo], "right"))
        since = (hours[lo:hi] - hours[lo]) / half
        value *= 0.5 ** ((hours[lo] - at) / half)
        out[lo:hi] = (value + np.cumsum(hit[lo:hi] * np.exp2(since))) * np.exp2(-since)
        at, value = float(hours[hi - 1]), float(out[hi - 1])
    return out


def silences(scored: DataFrame, until: Column) -> DataFrame:
    """Batch twin of the timers, from the rows of `replay`: customers who fall silent, at the first whole day of silence on which the inactivity rule holds, before their
    next event and up to `until`. One row for each such silence."""
    kept = ["event_id", "event_time", "churn_score", "seen", *NAMES]
    rows = scored.select("customer_id", "base", *kept)
    gaps = previous_in_key(rows, ["customer_id"], "event_time", {c: f"_p_{c}" for c in kept}, ["event_id"]).where("_p_event_time IS NOT NULL")
    inner = gaps.select("customer_id", "base", *[F.col(f"_p_{c}").alias(c) for c in kept], F.col("event_time").alias("next"))
    last = rows.groupBy("customer_id").agg(F.max_by(F.struct("base", *kept), F.struct("event_time", "event_id")).alias("r")).select("customer_id", "r.*", until.alias("next"))
    span = (F.unix_micros("next") - F.unix_micros("event_time")) / F.lit(float(DAY_US))
    quiet = inner.unionByName(last).where(span >= FIRST_DAY).withColumn("day", F.explode(F.sequence(F.lit(FIRST_DAY), F.least(F.lit(LAST_DAY), F.floor(span).cast("int")))))
    aged = quiet.withColumns({n: F.col(n) * F.pow(F.lit(0.5), F.col("day") * 24.0 / half) for n, _, half, _ in SIGNALS}).withColumn("previous_score", F.col("churn_score"))
    aged = aged.withColumn("churn_score", score(F.col("base"), F.col("day").cast("double")))
    hit = aged.where((inactivity(F.col("day").cast("double")) >= 0.75) & (F.col("purchase_signal") <= 0.10) & (F.col("churn_score") >= RISK))
    first = hit.groupBy("customer_id", "event_id").agg(F.min_by(F.struct("event_time", "day", "churn_score", "previous_score", "seen"), "day").alias("r"))
    at = F.timestamp_micros(F.unix_micros("r.event_time") + F.col("r.day") * F.lit(DAY_US))
    return first.select("customer_id", at.alias("event_time"), "r.day", "r.churn_score", "r.previous_score", "r.seen")


def decayed_together(hours: np.ndarray, hit: np.ndarray, first: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """All signals (a column each) after every event of many customers, whose rows follow one another: n[c] rows from first[c], `hours` since the customer's own start. The k-th
    events of all customers are taken at once; one with more than BUSY goes by itself, in one go."""
    out = np.empty(hit.shape)
    for c in np.flatnonzero(n > BUSY).tolist():
        here = slice(first[c], first[c] + n[c])
        for j, half in enumerate(HALVES):
            out[here, j] = decayed(hours[here], hit[here, j], half, float(start[c, j]))
    calm = np.flatnonzero(n <= BUSY)
    calm = calm[np.argsort(-n[calm], kind="stable")]
    value, at = start[calm], np.zeros(len(calm))
    for k in range(int(n[calm].max(initial=0))):
        m = int(np.searchsorted(-n[calm], -k))          # customers with more than k events
        rows = first[calm[:m]] + k
        value = value[:m] * np.exp2(-(hours[rows] - at[:m])[:, None] / HALVES) + hit[rows]
        at = hours[rows]
        out[rows] = value
    return out


class SignalProcessor(StatefulProcessor):
    """The state of a part of the customers, all of them at once. Events of a batch are applied in time order; the last time kept is a maximum, so a late
    event decays nothing and does not turn the clock back. A timer in event time looks at a customer after FIRST_DAY days of silence, and from then on day by day until the
    inactivity rule fires, the customer comes back or LAST_DAY is past; a part has one timer, at the earliest of its customers' times or before it. A silence that ended before the watermark saw it is
    found at the event that ended it, so triggers don't depend on how events are cut into batches. Rows of silences have no event_id, and change neither signals nor the score that the next event is compared with."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("signals", STATE)

    def _read(self) -> np.ndarray:
        """ROWs in the order of customers."""
        return np.frombuffer(bytes(self._state.get()[0]), ROW).copy() if self._state.exists() else np.zeros(0, ROW)

    def _write(self, state: np.ndarray) -> None:
        self._state.update((state.tobytes(),))

    @staticmethod
    def _customers(key, frame: pd.DataFrame) -> np.ndarray:
        return np.zeros(len(frame), np.int64) if key[0] == NOBODY else frame["customer_id"].to_numpy().astype(np.int64)

    @staticmethod
    def _joined(state: np.ndarray, customers: np.ndarray, base) -> np.ndarray:
        """The state with those of the customers that it has not yet."""
        who, at = np.unique(customers, return_index=True)
        keep = ~np.isin(who, state["customer_id"])
        more = np.zeros(int(keep.sum()), ROW)
        more["customer_id"] = who[keep]
        more["base"] = more["score"] = np.broadcast_to(base, len(customers))[at[keep]]
        out = np.concatenate([state, more])
        return out[np.argsort(out["customer_id"], kind="stable")]

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        self._write(self._joined(self._read(), self._customers(key, initial), initial["base"].to_numpy(dtype=float)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        ids = self._customers(key, frame)
        order = np.lexsort((frame["event_id"].to_numpy(), frame["event_time"].to_numpy(), ids))
        frame, ids = frame.take(order), ids[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        n = np.diff(np.append(first, len(ids)))
        state = self._joined(self._read(), ids, 0.5)
        at = np.searchsorted(state["customer_id"], ids[first])
        st = state[at]
        now = frame["event_time"].astype("datetime64[us]").astype("int64").to_numpy()
        last = np.where(st["seen"] > 0, st["last"], now[first])
        clock = np.maximum(now, np.repeat(last, n))
        kinds = frame["event_type"].to_numpy()
        hit = np.stack([kinds == kind for _, kind, _, _ in SIGNALS], axis=1).astype(float)
        sig = decayed_together((clock - np.repeat(last, n)) / 3.6e9, hit, first, n, st["signals"])
        base = np.repeat(st["base"], n)
        cur = np.clip(base + 0.22 / (1 + math.exp(7.0 / 3.0)) + sig @ WEIGHTS, 0.001, 0.999)
        before = np.append(0.0, cur[:-1])
        before[first] = st["score"]
        own = dict(zip(NAMES, sig.T))
        rules = [
            ("critical_risk_cross", (cur >= CRITICAL) & (before < CRITICAL)), ("risk_threshold_cross", (cur >= RISK) & (before < RISK)), ("score_spike", cur - before >= SPIKE),
            *[(f"{k}_event", (kinds == k) & (cur >= RISK)) for k in ("remove_from_cart", "support_contact")],
            ("support_and_cart_remove_without_purchase", (own["support_signal"] >= 0.85) & (own["cart_remove_signal"] >= 0.85) & (own["purchase_signal"] <= 0.15))]
        why = np.full(len(frame), "", object)
        for name, hits in rules:
            why[hits] = np.where(why[hits] == "", name, why[hits] + ", " + name)
        seen = np.repeat(st["seen"], n) + 1 + np.arange(len(ids)) - np.repeat(first, n)
        # silences that an event of this batch ended: of the state before it, and between its own events
        waiting = st["silent"] > 0
        gap = np.flatnonzero((np.diff(clock) >= FIRST_DAY * DAY_US) & (ids[1:] == ids[:-1]))
        inner = np.zeros(len(gap), ROW)
        for c, v in (("customer_id", ids[gap]), ("base", base[gap]), ("score", cur[gap]), ("last", clock[gap]), ("seen", seen[gap]), ("silent", FIRST_DAY), ("signals", sig[gap])):
            inner[c] = v
        _, quiet = self._fallen_silent(key, np.concatenate([st[waiting], inner]), np.concatenate([clock[first][waiting], clock[gap + 1]]))
        final = first + n - 1
        end = clock[final]
        state["silent"][at] = np.where((end != st["last"]) | (st["silent"] == 0), FIRST_DAY, st["silent"])
        for c, v in (("score", cur[final]), ("last", end), ("seen", seen[final]), ("signals", sig[final])):
            state[c][at] = v
        self._write(state)
        self._look_again(state, list(self._handle.listTimers()))
        if len(quiet):
            yield quiet
        event = frame["event_id"].to_numpy()
        yield pd.DataFrame({"customer_id": self._named(key, ids), "event_id": pd.arrays.IntegerArray(event.astype(np.int64), event == NO_EVENT), "event_time": frame["event_time"].to_numpy(), "event_type": kinds,
                            "churn_score": cur, "previous_score": before, "reasons": why, "seen": seen, **own})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, watermark = self._read(), timerValues.getCurrentWatermarkInMs() * 1000
        due = np.flatnonzero((state["silent"] > 0) & (state["last"] + state["silent"] * DAY_US <= watermark))
        found, quiet = self._fallen_silent(key, state[due], np.full(len(due), watermark))
        # the first day of silence after the watermark, 0 if the rule has held or that day is past the last one
        day = np.maximum(FIRST_DAY, (watermark - state["last"][due]) // DAY_US + 1)
        state["silent"][due] = np.where(found | (day > LAST_DAY), 0, day)
        self._write(state)
        self._look_again(state, [t for t in self._handle.listTimers() if t * 1000 > watermark])  # without the one that fired
        if len(quiet):
            yield quiet

    def _look_again(self, state: np.ndarray, timers: list[int]) -> None:
        """A part waits for the earliest of its customers' times. A timer that is too early, as events have put the times off, stays: it finds nobody silent and looks again."""
        wait = state[state["silent"] > 0]
        if not len(wait):
            return
        due = -(-int((wait["last"] + wait["silent"] * DAY_US).min()) // 1000)
        if timers and min(timers) <= due:
            return
        for t in timers:
            self._handle.deleteTimer(t)
        self._handle.registerTimer(due)

    @staticmethod
    def _named(key, customers: np.ndarray) -> pd.arrays.IntegerArray:
        return pd.arrays.IntegerArray(customers.astype(np.int64), np.full(len(customers), key[0] == NOBODY))

    @classmethod
    def _fallen_silent(cls, key, st: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
        """Which of the states fell silent: the first day, from the one a state waits for, on which the inactivity rule holds, no later than `until`; and the rows of those."""
        found, parts = np.zeros(len(st), bool), []
        for day in [] if not len(st) else range(FIRST_DAY, LAST_DAY + 1):
            at = np.flatnonzero(~found & (st["silent"] <= day) & (st["last"] + day * DAY_US <= until))
            if not len(at):
                continue
            idle = 1 / (1 + math.exp(-((day - 7.0) / 3.0)))
            sig = st["signals"][at] * 0.5 ** (day * 24.0 / HALVES)
            now = np.clip(st["base"][at] + 0.22 * idle + sig @ WEIGHTS, 0.001, 0.999)
            hit = (idle >= 0.75) & (sig[:, NAMES.index("purchase_signal")] <= 0.10) & (now >= RISK)
            at, sig, now = at[hit], sig[hit], now[hit]
            found[at] = True
            if len(at):
                parts.append(pd.DataFrame({"customer_id": cls._named(key, st["customer_id"][at]), "event_id": pd.array([None] * len(at), "Int64"),
                                           "event_time": (st["last"][at] + day * DAY_US).astype("datetime64[us]").astype("datetime64[ns]"), "event_type": SILENT, "churn_score": now, "previous_score": st["score"][at],
                                           "reasons": "extended_inactivity", "seen": st["seen"][at], **dict(zip(NAMES, sig.T))}))
        return found, pd.concat(parts) if parts else pd.DataFrame()

    def close(self) -> None:
        pass


#: The event type of rows that a silence made.
SILENT = "inactivity"


def _by_part(df: DataFrame) -> GroupedData:
    part = F.when(F.col("customer_id").isNull(), NOBODY).otherwise(F.pmod(F.xxhash64("customer_id"), F.lit(PARTS)).cast("int"))
    return df.withColumn("part", part).groupBy("part")


def score_stream(events: DataFrame, base: DataFrame, delay: str = "1 day") -> DataFrame:
    """Stateful stream of scores and triggers; `base` (customer_id, base) is the state each customer starts from. Silences are seen once the watermark, `delay` behind the
    latest event, has passed them; events behind the watermark are dropped."""
    e = events.withColumn("event_id", F.coalesce("event_id", F.lit(NO_EVENT))).withWatermark("event_time", delay)
    return _by_part(e).transformWithStateInPandas(
        SignalProcessor(), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime", initialState=_by_part(base))
