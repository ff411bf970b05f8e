"""Time to churn: gap events, proportional hazards on per-day sums, curves and rank measures."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winback.functions.ranking import exact_quantiles, ordered_totals, range_count, ranged, tercile


def activity(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Distinct (customer, time): visits and purchases when there are any, otherwise every event, and all orders."""
    core = events.where(F.col("event_type").isin("visit", "purchase"))
    used = core if not core.isEmpty() else events
    return used.select("customer_id", F.col("event_time").alias("activity_time")).unionByName(
        orders.select("customer_id", F.col("order_time").alias("activity_time"))).dropDuplicates()


def gap_events(act: DataFrame, customers: DataFrame, landmark: str, horizon: int, threshold: int) -> DataFrame:
    """Customers at risk at the landmark and the first day in the horizon their silence reaches the threshold.

    Times are folded to the first and last of each customer day: a gap of days cannot open inside a day.
    """
    lm = F.lit(landmark).cast("timestamp")
    end, wait = lm + F.expr(f"INTERVAL {horizon} DAYS"), F.expr(f"INTERVAL {threshold} DAYS")
    t = F.col("activity_time")
    past = act.where(t <= lm).groupBy("customer_id").agg(F.max(t).alias("last"))
    base = customers.join(past, "customer_id", "left").select("customer_id", F.coalesce("last", F.when(F.col("signup_date") <= lm, F.col("signup_date")), lm).alias("last"))
    base = base.where(F.col("last") + wait > lm)
    ahead = act.where((t > lm) & (t <= end)).groupBy("customer_id", F.to_date(t).alias("day")).agg(F.min(t).alias("a"), F.max(t).alias("b"))
    rows = base.select("customer_id", F.col("last").alias("a"), F.col("last").alias("b")).unionByName(
        ahead.join(base.select("customer_id"), "customer_id", "left_semi").select("customer_id", "a", "b"))
    nxt = F.lead("a").over(Window.partitionBy("customer_id").orderBy("a"))
    hit = F.col("b") + wait
    rows = rows.withColumn("n", nxt).withColumn("e", F.when((F.col("n").isNull() | (hit < F.col("n"))) & (hit <= end), F.greatest(hit, lm + F.expr("INTERVAL 1 DAY"))))
    return rows.groupBy("customer_id").agg(F.min("e").alias("event_date"))


def landmark_rows(at_risk: DataFrame, landmark: str, horizon: int) -> DataFrame:
    days = F.floor((F.unix_micros("event_date") - F.unix_micros(F.lit(landmark).cast("timestamp"))) / F.lit(86400000000.0)).cast("int")
    return at_risk.select("customer_id", F.when(F.col("event_date").isNotNull(), F.greatest(days, F.lit(1))).otherwise(horizon).alias("duration_days"),
                          F.col("event_date").isNotNull().cast("int").alias("event_observed"))


def status_events(snapshots: DataFrame, customers: DataFrame, landmark: str, horizon: int) -> DataFrame:
    """The other event source: the first churn_risk or churned snapshot in the horizon."""
    lm = F.lit(landmark).cast("date")
    hit = snapshots.where((F.col("snapshot_date") > lm) & (F.col("snapshot_date") <= F.date_add(lm, horizon)) & F.col("current_status").isin("churn_risk", "churned"))
    first = hit.groupBy("customer_id").agg(F.min("snapshot_date").cast("timestamp").alias("event_date"))
    return customers.select("customer_id").join(first, "customer_id", "left")


def rare_collapse(df: DataFrame, col: str, max_levels: int = 8, min_share: float = 0.01) -> DataFrame:
    """Keep the largest levels and those above a share; the rest become __rare__."""
    v = F.coalesce(F.col(col).cast("string"), F.lit("unknown"))
    counts = df.groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    # the largest levels by a bounded sort, the frequent ones by a filter
    top = counts.orderBy(F.desc("_n"), "_v").limit(max_levels).select("_v")
    keep = top.unionByName(counts.where(F.col("_n") / total >= min_share).select("_v")).distinct().withColumn("_keep", F.lit(1))
    return df.withColumn("_v", v).join(keep, "_v", "left").withColumn(col, F.when(F.col("_keep") == 1, F.col("_v")).otherwise("__rare__")).drop("_v", "_keep")


def encode(df: DataFrame, numeric: list[str], text: list[str]) -> tuple[DataFrame, list[str]]:
    """Numbers with NULLs as the median, and 0/1 level columns (first level dropped). Rare levels are collapsed first, so few levels reach the driver."""
    for c in text:
        df = rare_collapse(df, c)
    levels = {c: sorted(r[0] for r in df.select(c).distinct().collect() if r[0] is not None) for c in text}
    middle = {r["col"]: r["q0"] for r in exact_quantiles(df, numeric, [0.5]).collect()} if numeric else {}
    out = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(middle.get(c, 0.0)))) for c in numeric}
    for c, vals in levels.items():
        out.update({f"{c}_{v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for v in vals[1:]})
    return df.withColumns(out), list(out)


def encoded_stats(df: DataFrame, cols: list[str], event: str = "event_observed") -> DataFrame:
    """Per column: variance, mean, and the means and variances among events and censored rows, in one pass."""
    e, c = F.col(event) == 1, F.col(event) == 0
    aggs = []
    for x in cols:
        aggs += [F.var_samp(x).alias(f"v|{x}"), F.avg(x).alias(f"m|{x}"), F.min(x).alias(f"lo|{x}"), F.max(x).alias(f"hi|{x}"),
                 F.avg(F.when(e, F.col(x))).alias(f"me|{x}"), F.avg(F.when(c, F.col(x))).alias(f"mc|{x}"),
                 F.var_pop(F.when(e, F.col(x))).alias(f"ve|{x}"), F.var_pop(F.when(c, F.col(x))).alias(f"vc|{x}"),
                 F.count_if((F.col(x) != 0) & (F.col(x) != 1)).alias(f"nb|{x}")]
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("col"), *[F.col(f"`{k}|{x}`").cast("double").alias(k) for k in ("v", "m", "lo", "hi", "me", "mc", "ve", "vc", "nb")]) for x in cols])).alias("r")
    s = df.agg(*aggs).select(rows).select("r.*")
    separated = (F.col("nb") == 0) & (F.least("ve", "vc") < 1e-8) & (F.abs(F.col("me") - F.col("mc")) >= 0.20)
    reason = (F.when(F.coalesce("v", F.lit(0.0)) <= 1e-4, "low_variance").when((F.col("nb") == 0) & ~F.col("m").between(0.005, 0.995), "extreme_prevalence")
              .when(separated, "complete_separation").otherwise("keep"))
    return s.select("col", F.col("v").alias("variance"), F.col("m").alias("mean"), reason.alias("verdict"))


def cox_fit(df: DataFrame, cols: list[str], penalties=(0.1, 0.25, 0.5, 1.0), steps: int = 15) -> dict:
    """Newton steps for the penalised partial likelihood. Durations are whole days up to the horizon, so each step
    needs only per-day sums of e^xb, x e^xb and x x' e^xb; risk sets are sums over later days.

    One pass over the partitions makes the sums, Spark adds them up, and the driver solves a p x p system.
    """
    st = df.agg(*[f(F.col(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([st[f"m{i}"] or 0.0 for i in range(len(cols))])
    sd = np.array([st[f"s{i}"] or 1.0 for i in range(len(cols))])
    sd[sd < 1e-9] = 1.0
    p, n = len(cols), df.count()
    thin = df.select("duration_days", "event_observed", *[F.coalesce(F.col(c).cast("double"), F.lit(float(mean[i]))).alias(f"x{i}") for i, c in enumerate(cols)])
    iu = np.triu_indices(p)
    width = 2 + 2 * p + len(iu[0])

    def sums(beta: np.ndarray):
        def run(batches):
            acc: dict[int, np.ndarray] = {}
            for b in batches:
                x = (b[[f"x{i}" for i in range(p)]].to_numpy(float) - mean) / sd
                w = np.exp(np.clip(x @ beta, -30, 30))
                ev, day = b["event_observed"].to_numpy(float), b["duration_days"].to_numpy(int)
                for d in np.unique(day):
                    k = day == d
                    xs, ws, es = x[k], w[k], ev[k]
                    v = np.concatenate([[es.sum(), ws.sum()], es @ xs, ws @ xs, ((xs * ws[:, None]).T @ xs)[iu]])
                    acc[d] = acc.get(d, 0) + v
            for d, v in acc.items():
                yield pd.DataFrame({"day": d, "pos": np.arange(width), "val": v})
        per = thin.mapInPandas(run, "day int, pos int, val double").groupBy("day", "pos").agg(F.sum("val").alias("val")).toPandas()
        m = per.pivot(index="day", columns="pos", values="val").sort_index()
        return m.index.to_numpy(), m.to_numpy()

    for pen in penalties:
        beta, ok = np.zeros(p), True
        for _ in range(steps):
            _, m = sums(beta)
            late = m[::-1].cumsum(axis=0)[::-1]
            d, s0 = m[:, 0], late[:, 1]
            s1 = late[:, 2 + p:2 + 2 * p]
            grad = m[:, 2:2 + p].sum(axis=0) - (d / s0) @ s1 - pen * beta * n * 0.01
            hess = np.zeros((p, p))
            for t in range(len(d)):
                full = np.zeros((p, p))
                full[iu] = late[t, 2 + 2 * p:]
                full = full + full.T - np.diag(full.diagonal())
                a = s1[t] / s0[t]
                hess += d[t] * (full / s0[t] - np.outer(a, a))
            hess += np.eye(p) * pen * n * 0.01
            try:
                move = np.linalg.solve(hess, grad)
            except np.linalg.LinAlgError:
                ok = False
                break
            beta = beta + np.clip(move, -2, 2)
            if not np.isfinite(beta).all():
                ok = False
                break
            if np.abs(move).max() < 1e-6:
                break
        if ok:
            days, m = sums(beta)
            late = m[::-1].cumsum(axis=0)[::-1]
            h0 = np.cumsum(np.where(m[:, 0] > 0, m[:, 0] / late[:, 1], 0.0))
            return {"cols": cols, "mean": mean, "sd": sd, "beta": beta, "penalty": pen, "days": days, "h0": h0}
    raise RuntimeError("the proportional hazards fit did not converge at any penalty")


def cox_predict(df: DataFrame, model: dict, horizon: int = 90) -> DataFrame:
    """Relative hazard, survival at 1/30/60/90 days and the first day with survival of one half or less."""
    xb = sum((F.lit(float(b)) * (F.coalesce(F.col(c).cast("double"), F.lit(float(m))) - float(m)) / float(s)
              for c, b, m, s in zip(model["cols"], model["beta"], model["mean"], model["sd"])), F.lit(0.0))
    out = df.withColumn("predicted_hazard_ratio", F.exp(xb))
    days, h0 = model["days"], model["h0"]

    def at(t: int) -> float:
        k = np.searchsorted(days, t, side="right") - 1
        return float(h0[k]) if k >= 0 else 0.0
    base = F.array(*[F.struct(F.lit(int(d)).alias("d"), F.lit(float(h)).alias("h")) for d, h in zip(days, h0)])
    half = F.lit(math.log(2)) / F.col("predicted_hazard_ratio")
    first = F.array_min(F.transform(F.filter(base, lambda x: x["h"] >= half), lambda x: x["d"]))
    return out.withColumns({**{f"survival_prob_{t}d": F.exp(-F.lit(at(t)) * F.col("predicted_hazard_ratio")) for t in sorted({1, 30, 60, horizon})},
                            "predicted_median_time_to_churn_days": F.coalesce(first, F.lit(horizon)).cast("double")})


def coefficients(spark, model: dict) -> DataFrame:
    rows = sorted(((c, float(b), float(math.exp(b))) for c, b in zip(model["cols"], model["beta"])), key=lambda r: -abs(r[1]))
    return spark.createDataFrame(rows, "feature string, coefficient double, hazard_ratio double")


def with_terciles(df: DataFrame, hazard: str, name: str = "risk_group") -> DataFrame:
    n = df.count()
    r = ordered_totals(df, [(hazard, False), ("customer_id", False)], {"_r": F.lit(1)})
    return r.withColumn(name, tercile(F.col("_r"), n)).drop("_r")


def kaplan_meier(df: DataFrame, group: str) -> DataFrame:
    """Survival per group and day. The rows are first folded to group and day, so the windows are a few hundred rows."""
    per = df.groupBy(group, "duration_days").agg(F.sum("event_observed").alias("events"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy("duration_days")
    per = per.withColumn("at_risk", F.sum("n").over(w.rowsBetween(0, Window.unboundedFollowing)))
    step = F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk")))
    dead = F.max((F.col("events") >= F.col("at_risk")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    s = F.exp(F.sum(F.coalesce(step, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return per.select(group, "duration_days", "events", "at_risk", F.when(dead == 1, 0.0).otherwise(s).alias("survival"))


def ordered_pairs(rank: np.ndarray, score: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each row the weight of all rows of higher rank and lower score, rows of equal score counted by half. score is ascending.

    Two ranks differ first in one bit, so each pair is counted at that bit: among rows that agree above it, rows with the bit are summed in order of score.
    """
    out = np.zeros(len(rank))
    for bit in range(int(rank.max(initial=0)).bit_length()):
        group = rank >> (bit + 1)
        order = np.argsort(group, kind="stable")
        g, s, upper = group[order], score[order], (rank[order] >> bit & 1).astype(bool)
        total = np.append(0.0, np.cumsum(np.where(upper, weight[order], 0)))
        new = np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]))
        tie = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(g))
        start = np.searchsorted(g, g, "left")
        under = (total[first[tie]] + total[last[tie]]) / 2 - total[start]
        out[order[~upper]] += under[~upper]
    return out


def concordance(df: DataFrame, hazard: str) -> float:
    """Share of comparable pairs the hazard orders rightly, ties as one half. Exact, without forming pairs or copying rows.

    Rows are folded to (duration, event, score) and cut into score ranges. Of the lower ranges a range has to know one count for each day with an event: the rows at risk
    after that day, summed from the latest day down inside each range and then over the ranges, both by Spark. Inside a range pairs are counted bit by bit of the day's rank.
    """
    cells = df.where(F.col(hazard).isNotNull()).groupBy(F.col("duration_days").cast("int").alias("d"), (F.col("event_observed") == 1).cast("int").alias("e"), F.col(hazard).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    cells = ranged(cells, [F.col("s")]).withColumnRenamed("_range", "r")
    sums = cells.groupBy("r", "d", "e").agg(F.sum("n").alias("n"))
    # every range has a place for every day with an event: ranges follow the cluster, so this is days x partitions
    days = sums.where("e = 1").select("d").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(range_count(df.sparkSession) - 1))).alias("r"), "d", F.lit(1).alias("e"), F.lit(0).cast("long").alias("n"))
    # of one day, censored rows outlive those with the event
    grid = sums.unionByName(days).groupBy("r", "d", "e").agg(F.sum("n").alias("n")).withColumn("later", F.sum("n").over(Window.partitionBy("r").orderBy(F.desc("d"), "e").rowsBetween(Window.unboundedPreceding, -1)))
    grid = grid.where("e = 1").select("r", "d", F.coalesce("later", F.lit(0)).alias("later"))
    below = grid.withColumn("below", F.coalesce(F.sum("later").over(Window.partitionBy("d").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("every", F.sum("later").over(Window.partitionBy("d")))

    def run(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame({"c": [0.0], "a": [0.0]})
        part = part.sort_values("s")
        d, e, s, n = (part[x].to_numpy() for x in ("d", "e", "s", "n"))
        _, rank = np.unique(2 * d.astype(np.int64) + (e == 0), return_inverse=True)
        under = ordered_pairs(rank, s, n)
        hit = e == 1
        at = known.set_index("d").loc[d[hit]]
        return pd.DataFrame({"c": [float((n[hit] * (under[hit] + at["below"].to_numpy())).sum())], "a": [float((n[hit] * at["every"].to_numpy()).sum())]})
    got = cells.groupBy("r").cogroup(below.select("r", "d", "below", "every").groupBy("r")).applyInPandas(run, "c double, a double").agg(F.sum("c").alias("c"), F.sum("a").alias("a")).first()
    return got["c"] / got["a"] if got["a"] else 0.5
