"""Bounded caches from reuse distances: how many other items were used since an item's last use.

A least-recently-used cache of c entries holds an item exactly if fewer than c others came since, so one pass over the accesses
tells the hits of every capacity. A rewritten entry counts as used, as in caches that evict the oldest write.

A distance counts the accesses j in between whose own last use lies before the item's, that is, pairs that are smaller in both of two
coordinates. Groups of up to ``SHORT`` accesses move once, whole, and a task counts many of them at a time. Accesses of longer ones are cut into time ranges, at most ``RANGES`` a group: pairs whose ranges differ in both coordinates are a prefix sum over a table of ranges,
and the others share a range, in which a merge counts them. No task holds more than a range of a group, or its table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .slots import by_length, join_same, neighbours, running_sum, whole_groups
from .staging import staged

#: Accesses in a time range at least, and ranges of a group at most.
RANGE, RANGES = 4096, 2048
#: Accesses of a group that is counted whole, at most.
SHORT = 1 << 16
_NEVER = 1 << 62


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value, how many smaller ones stand before it: left halves are counted into right halves, size by size."""
    n = len(values)
    out, at = np.zeros(n, np.int64), np.arange(n)
    order = np.lexsort((-at, values))  # equal values: the later first, so none counts the other
    k = 0
    while 1 << k < n:
        pair = order >> (k + 1)
        rows = order[np.argsort(pair, kind="stable")]
        left = (rows >> k & 1) == 0
        seen = np.cumsum(left)
        pair = rows >> (k + 1)
        start = np.concatenate([[True], pair[1:] != pair[:-1]])
        before = np.maximum.accumulate(np.where(start, seen - left, 0))
        out[rows[~left]] += (seen - before)[~left]
        k += 1
    return out


def _in_range(rows: pd.DataFrame) -> pd.DataFrame:
    """A range's accesses with the pairs that lie within it, of the item's own access and of its next one."""
    rows = rows.sort_values("_i", kind="stable")
    rows["_own"] = smaller_before(rows["_prev"].to_numpy(np.int64))
    rows["_ahead"] = smaller_before(rows["_next_range"].to_numpy(np.int64))
    return rows


def _table(rows: pd.DataFrame) -> pd.DataFrame:
    """A group's cells (range, range of the last use, accesses) with the sum over cells that are smaller in both."""
    b, c = rows["_range"].to_numpy(np.int64), rows["_prev_range"].to_numpy(np.int64) + 1
    grid = np.zeros((b.max() + 2, c.max() + 2), np.int64)
    grid[b + 1, c + 1] = rows["_n"].to_numpy(np.int64)
    grid = grid.cumsum(0).cumsum(1)
    rows["_n"] = grid[b, c]
    return rows


def _count_whole(rows: pa.Table, starts: np.ndarray) -> pa.Table:
    """Distances of whole groups, one after another: an item's last use lies in its own group, so the groups before count as much on both sides of the difference."""
    sizes = np.diff(np.append(starts, rows.num_rows))
    last = rows.column("_prev").to_numpy()
    again = ~np.isnan(last) if last.dtype.kind == "f" else np.ones(len(last), bool)
    prev = np.where(again, np.nan_to_num(last).astype(np.int64) - 1 + np.repeat(starts, sizes), -1)
    distance = pa.array(smaller_before(prev) - prev - 1, pa.int64(), mask=~again)
    return rows.drop_columns(["_i", "_prev"]).append_column("distance", distance)


def _short_distances(accesses: DataFrame, keys: list[str], order: list[Column], item: Column) -> DataFrame:
    schema = StructType([*accesses.schema.fields, StructField("distance", LongType())])
    rows = accesses.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).withColumn("_item", item)
    rows = rows.withColumn("_prev", F.lag("_i").over(Window.partitionBy(*keys, "_item").orderBy("_i"))).drop("_item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return whole_groups(batches, _count_whole)

    return rows.sortWithinPartitions(*keys, "_i").mapInArrow(run, schema)


def reuse_distances(accesses: DataFrame, keys: list[str], slot: Column, order: list[Column], item: Column, least: int = RANGE, short: int = SHORT) -> DataFrame:
    """accesses with ``distance``: the distinct items of the group since the item's last access, null at its first.

    ``order`` must be a full order of a group's accesses that ``slot`` follows; null items are an item. Groups of up to ``short`` accesses are counted whole. Column names that begin with an underscore are the operator's.
    """
    few, many = by_length(accesses, keys, short)
    return _short_distances(few, keys, order, item).unionByName(_long_distances(many, keys, slot, order, item, least))


def _long_distances(accesses: DataFrame, keys: list[str], slot: Column, order: list[Column], item: Column, least: int) -> DataFrame:
    rows = running_sum(accesses.withColumn("_item", item), keys, slot, order, _i=F.lit(1).cast("long")).withColumn("_i", F.col("_i") - 1)
    rows = neighbours(staged(rows), [*keys, "_item"], slot, order, "_i", "_prev", "_next")
    sizes = rows.groupBy(*keys).agg(F.greatest(F.lit(least), F.ceil(F.count(F.lit(1)) / RANGES)).cast("long").alias("_size"))
    rows = staged(join_same(rows, sizes, keys))
    of = lambda c: F.floor(F.col(c) / F.col("_size")).cast("long")
    links = rows.select(*keys, "_i", F.coalesce("_prev", F.lit(-1)).cast("long").alias("_prev"), F.coalesce("_next", F.lit(_NEVER)).cast("long").alias("_next"), of("_i").alias("_range"), F.when(F.col("_prev").isNull(), -1).otherwise(of("_prev")).alias("_prev_range"), F.when(F.col("_next").isNull(), _NEVER).otherwise(of("_next")).alias("_next_range"))
    longs = lambda *names: [StructField(n, LongType()) for n in names]
    given = StructType([f for f in links.schema if f.name in keys])
    counted = links.groupBy(*keys, "_range").applyInPandas(_in_range, StructType([*given.fields, *longs("_i", "_prev", "_next", "_range", "_prev_range", "_next_range", "_own", "_ahead")]))
    counted = staged(counted)
    cells = links.groupBy(*keys, "_range", "_prev_range").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.groupBy(*keys).applyInPandas(_table, StructType([*given.fields, *longs("_range", "_prev_range", "_n")]))
    again = join_same(counted.filter("_prev >= 0"), cells, [*keys, "_range", "_prev_range"])
    parts = again.select(*keys, "_i", (F.col("_n") + F.col("_own") - F.col("_prev") - 1).alias("_part")).unionByName(
        counted.filter(F.col("_next") < _NEVER).select(*keys, F.col("_next").alias("_i"), F.when(F.col("_next_range") > F.col("_range"), F.col("_ahead")).otherwise(0).alias("_part")))
    parts = parts.groupBy(*keys, "_i").agg(F.sum("_part").alias("distance"))
    return join_same(rows.drop("_size", "_prev", "_next"), parts, [*keys, "_i"]).drop("_i", "_item")


def hit_curve(distances: DataFrame, keys: list[str]) -> DataFrame:
    """keys, capacity, hits and accesses: what a cache of each capacity at which hits are gained would have hit."""
    per = distances.groupBy(*keys, "distance").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)
    rows = per.withColumn("accesses", F.sum("_n").over(Window.partitionBy(*keys))).filter("distance is not null")
    return rows.select(*keys, (F.col("distance") + 1).alias("capacity"), F.sum("_n").over(w).alias("hits"), "accesses")


def cache_hits(accesses: DataFrame, keys: list[str], slot: Column, order: list[Column], item: Column, capacity: Column, pinned: Column | None = None) -> DataFrame:
    """accesses with ``hit``, of a least-recently-used cache of ``capacity`` entries for each group; keys that name an image give each image its quota.

    Accesses that are ``pinned`` (a property of the item) always hit after the first, and take no part of the capacity.
    """
    if pinned is None:
        rows = reuse_distances(accesses, keys, slot, order, item)
        return rows.withColumn("hit", F.coalesce(F.col("distance") < capacity, F.lit(False))).drop("distance")
    # pinned items are a group of their own, in which any earlier access is a hit
    rows = reuse_distances(accesses.withColumn("_pinned", F.coalesce(pinned, F.lit(False))), [*keys, "_pinned"], slot, order, item)
    hit = F.when(F.col("_pinned"), F.col("distance").isNotNull()).otherwise(F.coalesce(F.col("distance") < capacity, F.lit(False)))
    return rows.withColumn("hit", hit).drop("distance", "_pinned")
