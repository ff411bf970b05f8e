"""Orderings over a whole table without a one-task window.

Rows are dealt into value ranges by Spark's own range partitioning and written with the number of their range; every range is summed, and the total of the ranges
before it is added. There are as many ranges as the session deals partitions in a shuffle, however many rows there are, and their bounds are neither in the plan nor
in Python. As the range is written down, a recomputed task finds its rows where they were, and the result never depends on where the bounds happen to fall.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winback.sources.staging import cut


def range_count(spark: SparkSession) -> int:
    """Ranges follow the cluster, not the rows."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows, written with the number of their range (`_range`); ranges are in the order of the keys, and rows of equal keys share one."""
    dealt = df.repartitionByRange(range_count(df.sparkSession), *keys)
    return cut(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def _sort_value(df: DataFrame, name: str, descending: bool) -> Column:
    """A value that sorts ascending in the wanted order, in the column's own precision."""
    c, kind = F.col(name), df.schema[name].dataType
    if not descending:
        return c
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.bitwise_not(F.unix_micros(c.cast("timestamp")))
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(c)             # the order of -c, without overflow
    if isinstance(kind, T.StringType):      # hex digits turned round; the end mark puts a longer text before its own beginning
        return F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    return -c


def _order_key(df: DataFrame, order: list[tuple[str, bool]]) -> Column:
    """One sortable value of the (column, descending) pairs, NULL last."""
    return F.struct(*[x for i, (c, d) in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), _sort_value(df, c, d).alias(f"k{i}"))])


def placed(df: DataFrame, order: list[tuple[str, bool]], name: str = "place") -> DataFrame:
    """The rows with their place, from 1, in an order over the whole table that should end in a unique column; NULL comes last.

    Rows pass one shuffle: a range is sorted where it is dealt, and written with its number and the row's number in it; the rows of the ranges before are added.
    """
    key = _order_key(df, order)
    dealt = df.repartitionByRange(range_count(df.sparkSession), key).sortWithinPartitions(key)
    # an id is the number of the partition, 31 bits, and of the row in it, 33 bits
    rows = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_at", 33))
    before = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(offsets), "_range").select(*df.columns, (nth + F.col("_before")).alias(name))


def ordered_totals(df: DataFrame, order: list[tuple[str, bool]], totals: dict[str, Column],
                   by: list[str] | None = None, dense: int | None = None) -> DataFrame:
    """Running totals (current row included) in a given order, per `by` group or over the table.

    `order` holds (column, descending) pairs and should end in a unique column; NULL comes last either way. The input is read twice, for
    Spark's sample of keys and to write the ranges. With `dense` the only key is a whole number from 1 to that size, its range is computed and nothing is written.
    """
    by = by or []
    key = _order_key(df, order)
    work = df.withColumn("_key", key)
    for n, e in totals.items():
        work = work.withColumn(f"_t_{n}", e)
    if dense is not None:
        work = work.withColumn("_range", F.floor((F.col(order[0][0]) - 1) * range_count(df.sparkSession) / max(dense, 1)).cast("int"))
    else:
        # the key is made of columns of the row: it isn't written
        work = ranged(work.drop("_key"), [key]).withColumn("_key", key)
    run = Window.partitionBy(*by, "_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    inner = work.select("*", *[F.sum(f"_t_{n}").over(run).alias(f"_r_{n}") for n in totals])
    sums = work.groupBy(*by, "_range").agg(*[F.sum(f"_t_{n}").alias(f"_s_{n}") for n in totals])
    before = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "_range", *[
        F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals])
    if not by:                      # one row a range; with groups the optimiser decides by size
        offsets = F.broadcast(offsets)
    return inner.join(offsets, [*by, "_range"]).select(
        *df.columns, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in totals])


def value_cdf(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, col, value, n_value, n_upto, n_total) for every distinct non-NULL value of each column.

    Rows are pre-aggregated to distinct values before anything is ordered, so ties, however many,
    cost one row each. With `by` a group's distinct values are ordered in one window, which may spill; without it
    the table is cut into ranges.
    """
    by = by or []
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value"))
                                for c in cols])).alias("p")
    counts = (df.select(*by, pairs).select(*by, "p.col", "p.value").where("value IS NOT NULL")
              .groupBy(*by, "col", "value").agg(F.count(F.lit(1)).alias("n_value")))
    if by:
        group = Window.partitionBy(*by, "col")
        upto = group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        return counts.select(*by, "col", "value", "n_value", F.sum("n_value").over(upto).alias("n_upto"), F.sum("n_value").over(group).alias("n_total"))
    counts = ranged(counts, [F.col("col"), F.col("value")])
    run = Window.partitionBy("col", "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inner = counts.withColumn("_run", F.sum("n_value").over(run))
    sums = counts.groupBy("col", "_range").agg(F.sum("n_value").alias("_s"))
    grp = Window.partitionBy("col")
    offsets = sums.select("col", "_range",
                          F.coalesce(F.sum("_s").over(grp.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
                                     F.lit(0)).alias("_o"),
                          F.sum("_s").over(grp).alias("n_total"))
    return inner.join(offsets, ["col", "_range"]).select(
        "col", "value", "n_value", (F.col("_run") + F.col("_o")).alias("n_upto"), "n_total")


def with_rank_pct(df: DataFrame, cols: dict[str, str], key: str = "customer_id") -> DataFrame:
    """Add average-tie percentile ranks: {source column: new column}. NULL values get NULL.

    One long-format pass serves every column. The join back is on (column, value); a value shared by
    very many rows is a skewed join key that adaptive execution splits.
    """
    names = list(cols)
    cdf = value_cdf(df, names).select(
        "col", "value", ((F.col("n_upto") - (F.col("n_value") - 1) / 2) / F.col("n_total")).alias("_pct"))
    long = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value")) for c in names])).alias("p"))
    ranked = (long.select(key, "p.col", "p.value").join(cdf, ["col", "value"])
              .groupBy(key).agg(*[F.max(F.when(F.col("col") == c, F.col("_pct"))).alias(cols[c]) for c in names]))
    return df.join(ranked, key, "left")


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles: one row per (by, col) with columns q0, q1, ... in order of `probs`."""
    by = by or []
    cdf = value_cdf(df, cols, by)
    aggs = []
    for i, p in enumerate(probs):
        pos = (F.col("n_total") - 1) * F.lit(float(p))
        aggs += [F.min(F.when(F.col("n_upto") > F.floor(pos), F.col("value"))).alias(f"_lo{i}"),
                 F.min(F.when(F.col("n_upto") > F.ceil(pos), F.col("value"))).alias(f"_hi{i}"),
                 F.max(pos - F.floor(pos)).alias(f"_w{i}")]
    got = cdf.groupBy(*by, "col").agg(*aggs)
    return got.select(*by, "col", *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(f"q{i}")
        for i in range(len(probs))])


def quantile_values(df: DataFrame, col: str, probs: list[float]) -> list[float | None]:
    """Exact quantiles of one column as plain numbers."""
    row = exact_quantiles(df, [col], probs).first()
    return [None] * len(probs) if row is None else [row[f"q{i}"] for i in range(len(probs))]


def tercile(rank: Column, n) -> Column:
    """Low / Mid / High cut of a 1-based rank among n rows, equal to quantile cuts of the rank."""
    n = n if isinstance(n, Column) else F.lit(n)
    return (F.when(3 * (rank - 1) < n - 1, F.lit("Low Risk"))
            .when(3 * (rank - 1) < 2 * (n - 1), F.lit("Mid Risk")).otherwise(F.lit("High Risk")))


def previous_in_key(df: DataFrame, key: list[str], ts: str, carry: dict[str, str], tie: list[str] | None = None,
                    day: str | None = None) -> DataFrame:
    """Value of the previous row of the same key in time order: {source column: new column}.

    Windows run per (key, day), and the last row of each active day is handed to the next active day,
    so one very busy key is spread over its days instead of landing in a single task. `day` names a column that holds
    the day already: rows that lie by key and day are not dealt again.
    """
    tie = tie or []
    dated = df.withColumn("_day", F.col(day) if day else F.to_date(ts))
    work = dated
    order = [F.col(ts), *[F.col(t) for t in tie]]
    inside = Window.partitionBy(*key, "_day").orderBy(*order)
    packed = F.struct(*[F.col(c).alias(c) for c in carry])
    work = work.withColumn("_rn", F.row_number().over(inside)).withColumn("_prev", F.lag(packed).over(inside))
    last = (dated.groupBy(*key, "_day")
            .agg(F.max_by(packed, F.struct(*order)).alias("_last")))
    handed = last.select(*key, "_day", F.lag("_last").over(Window.partitionBy(*key).orderBy("_day")).alias("_hand"))
    joined = work.join(handed, [*key, "_day"], "left")
    pick = F.when(F.col("_rn") == 1, F.col("_hand")).otherwise(F.col("_prev"))
    return joined.withColumn("_pick", pick).select(
        *df.columns, *[F.col("_pick").getField(c).alias(n) for c, n in carry.items()])


def latest_rows(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by the given ascending order (map-side combined, no window)."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, *[F.col("_row").getField(c).alias(c) for c in rest])
