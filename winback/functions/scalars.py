"""Column expressions shared by the operators. All of them stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(col: Column, low=None, high=None) -> Column:
    """Bound a column; NULL stays NULL."""
    out = col if low is None else F.greatest(col, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(col.isNotNull(), out)


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den, or the default where the denominator is zero or either side is NULL."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(float(default)))


def change_rate(recent: Column, previous: Column) -> Column:
    return ratio(recent - previous, previous)


def sigmoid(col: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col))


def in_window(ts: Column, end: Column, days: float) -> Column:
    """Half-open window (end - days, end]."""
    seconds = int(days * 86400)
    return (ts > end - F.expr(f"INTERVAL {seconds} SECONDS")) & (ts <= end)


def days_between(end: Column, start: Column) -> Column:
    """Fractional days between two timestamps, at microsecond precision."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(86400000000.0)


def stable_unit(key: Column, salt: int = 12289) -> Column:
    """A fixed number in [0,1) for an integer key: the stand-in for a seeded random draw."""
    return ((key % 1000003) * 7919 + F.lit(salt).cast("long")) % 1000003 / F.lit(1000003.0)


def month_number(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def col_or_lit(df: DataFrame, name: str, default) -> Column:
    """The named column, NULLs filled, or the default when the frame does not have it."""
    if name in df.columns:
        return F.coalesce(F.col(name), F.lit(default))
    return F.lit(default)


def first_of(df: DataFrame, names: list[str], positive: bool = False) -> Column:
    """First non-NULL (or first positive) value over the alias columns that exist."""
    found = [F.col(n).cast("double") for n in names if n in df.columns]
    if positive:
        found = [F.when(c > 0, c) for c in found]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def literal_map(values: dict, key: Column, default=None) -> Column:
    """Look a key up in a small fixed table."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def scalars(df: DataFrame, **aggs: Column) -> dict:
    """One-row aggregate brought to the driver as plain values."""
    return df.agg(*[c.alias(n) for n, c in aggs.items()]).first().asDict()


def minmax(df: DataFrame, *cols: str, **exprs: Column) -> dict:
    """name -> column scaled to [0,1] by the frame's own minimum and maximum; 0 when flat.

    The minima and maxima come from one aggregate, so no window over the whole frame is needed.
    """
    items = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    items.update({n: F.coalesce(e.cast("double"), F.lit(0.0)) for n, e in exprs.items()})
    aggs = {}
    for n, e in items.items():
        aggs[f"lo_{n}"], aggs[f"hi_{n}"] = F.min(e), F.max(e)
    got = scalars(df, **aggs)
    out = {}
    for n, e in items.items():
        lo, hi = got[f"lo_{n}"], got[f"hi_{n}"]
        out[n] = F.lit(0.0) if lo is None or hi - lo < 1e-12 else (e - F.lit(lo)) / F.lit(hi - lo)
    return out
