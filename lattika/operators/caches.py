"""Caches as tables: what stays after an eviction, an invalidation or an age limit, and what they report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evict_share(entries: DataFrame, keys: list[str], order: list[Column], share: float = 0.25) -> DataFrame:
    """Entries that stay once the first ``share`` of each group in this order, one at least, are gone: least recently used, or farthest first."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = entries.withColumn("_n", n).withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.filter(F.col("_at") > F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_n", "_at")


def squared_distance(center: list[Column], point: tuple[float, ...]) -> Column:
    out = F.lit(0.0)
    for c, p in zip(center, point, strict=True):
        out = out + (c - p) * (c - p)
    return out


def evict_levels(entries: DataFrame, level: Column, most: int) -> DataFrame:
    """Entries of levels above ``most``."""
    return entries.filter(level > most)


def evict_region(entries: DataFrame, lows: list[Column], highs: list[Column], region: list[tuple[float, float]]) -> DataFrame:
    """Entries whose boxes don't meet the region."""
    meets = F.lit(True)
    for lo, hi, (a, b) in zip(lows, highs, region, strict=True):
        meets = meets & (lo < b) & (hi > a)
    return entries.filter(~meets)


def evict_older(entries: DataFrame, accessed: Column, limit: Column, pinned: Column) -> DataFrame:
    """Entries that were used at or after the limit, or are pinned."""
    return entries.filter((accessed >= limit) | pinned)


def invalidate(entries: DataFrame, kind: Column, gone: list[str]) -> DataFrame:
    """Entries of other classes."""
    return entries.filter(~kind.isin(*gone))


def missing_for(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` that ``held`` lacks."""
    return wanted.join(held.select(*keys).distinct(), keys, "left_anti")


def coverage(df: DataFrame, keys: list[str], scale: Column) -> DataFrame:
    """keys, pixels, covered, percentage, mean and greatest scale of samples; a scale of 0 is outside, and without any inside the mean is 1."""
    on = scale > 0
    n, covered = F.count(F.lit(1)), F.count(F.when(on, 1))
    return df.groupBy(*keys).agg(n.alias("pixels"), covered.alias("covered"), (100.0 * covered / n).alias("percentage"), F.coalesce(F.avg(F.when(on, scale)), F.lit(1.0)).alias("mean_scale"), F.coalesce(F.max(F.when(on, scale)), F.lit(0.0)).alias("max_scale"))


def experience(df: DataFrame, keys: list[str], order: list[str], quality: str, last: int = 100) -> DataFrame:
    """keys, n, mean and population deviation of the last qualities of each group."""
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    rows = df.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= last)
    return rows.groupBy(*keys).agg(F.count(quality).alias("n"), F.avg(quality).alias("mean"), F.stddev_pop(quality).alias("deviation"))


def levels_held(entries: DataFrame, keys: list[str], level: str) -> DataFrame:
    """keys and the sorted distinct levels of each group."""
    return entries.groupBy(*keys).agg(F.array_sort(F.collect_set(level)).alias("levels"))


def prediction_quality(predicted: Column, actual: Column) -> tuple[Column, Column]:
    """Correct predictions of a set of tiles, and their share of the predicted ones (0 without any)."""
    hit = F.size(F.array_intersect(predicted, actual))
    return hit, F.coalesce(F.try_divide(hit.cast("double"), F.size(predicted).cast("double")), F.lit(0.0))
