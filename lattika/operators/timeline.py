"""Timed frames: running offsets, overlap, as-of lookups, streams' running estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(value: Column, keys: list[str], order: list[str]) -> Column:
    """Sum of the values before a row, 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def overlapping(start: Column, duration: Column, t0: int, t1: int) -> Column:
    """Frames that overlap [t0, t1)."""
    return (start < t1) & (start + duration > t0)


def nearest(df: DataFrame, keys: list[str], value: Column, target: Column, idx: str) -> DataFrame:
    """For each group, the index whose value is nearest to the target, the first of equals."""
    return df.groupBy(*keys).agg(F.min(F.struct(F.abs(value - target).alias("d"), F.col(idx).alias("i")))["i"].alias(idx))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with the value of the last right row at or before it (null if none), by one union and one running window."""
    a = left.withColumns({"_side": F.lit(1), value: F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*keys, at, value).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("_side = 1").drop("_side")


def exponential_average(df: DataFrame, keys: list[str], order: list[str], value: str, smoothing: float, seed: float) -> DataFrame:
    """estimate after all samples of each group: a * x + s * previous, a = 1 - s, from the seed.

    Groups are folded in order; a group's samples meet in one array, so keys must be of bounded length (one client's samples).
    """
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("_s"))
    fold = F.aggregate("_s", F.lit(float(seed)), lambda e, s: F.lit(1 - smoothing) * s[value] + F.lit(smoothing) * e)
    return rows.select(*keys, F.size("_s").cast("bigint").alias("n"), fold.alias("estimate"))


def trend(value: str, keys: list[str], order: list[str], last: int = 10) -> Column:
    """(last - first) / first of the last samples, within -1 and 1; 0 for one sample or a first value of 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(last - 1), 0)
    first = F.first(value).over(w)
    t = F.coalesce(F.try_divide(F.col(value) - first, first), F.lit(0.0))
    return F.when(F.count(value).over(w) < 2, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t)))


def confidence(value: str, keys: list[str], order: list[str], last: int = 10, least: int = 3) -> Column:
    """1 - coefficient of variation of the last samples, within 0 and 1; n / least while there are fewer."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(last - 1), 0)
    n = F.count(value).over(w)
    cv = F.coalesce(F.try_divide(F.stddev_pop(value).over(w), F.avg(value).over(w)), F.lit(0.5))
    return F.when(n < least, n / float(least)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cv)))


def congested(rtt: str, keys: list[str], order: list[str], threshold: float = 1.5) -> Column:
    """Whether the round trip is over the threshold times the least so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    low = F.min(rtt).over(w)
    return F.coalesce(F.try_divide(F.col(rtt), low) > threshold, F.lit(False))


def predict_bandwidth(estimate: Column, trend_: Column, congestion: Column) -> Column:
    """The next bandwidth: up by a fifth of the trend or down by three tenths of it, 0.7 of that if congested, 100,000 at least."""
    up = F.when(trend_ >= 0, 1 + 0.2 * trend_).otherwise(1 + 0.3 * trend_)
    return F.greatest(F.lit(100000), F.floor(estimate * up * F.when(congestion, 0.7).otherwise(1.0)))


def sessions(df: DataFrame, keys: list[str], at: str, timeout_seconds: int) -> DataFrame:
    """df with session: 0, 1, ... of each key; a new one begins after a silence longer than the timeout."""
    w = Window.partitionBy(*keys).orderBy(at)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    new = F.when(gap > timeout_seconds * 1_000_000, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")
