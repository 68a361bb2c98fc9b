"""Running values over long ordered groups, by slots: a group's rows are parted into slots of its order, a slot is one window,
and the slots' totals, one row each, are run over once more. So a group that holds most rows is many tasks, as long as its slots are many.

``slot`` must not fall where the order rises (a time bucket, say). Null keys are keys. Rows that tie in the order run in any order: give a full one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left joined to right by keys of the same names, where null equals null; the right's other columns are added."""
    new = {c: f"_r_{c}" for c in keys}
    right = right.withColumnsRenamed(new)
    on = F.lit(True)
    for c in keys:
        on = on & left[c].eqNullSafe(right[new[c]])
    return left.join(right, on, how).drop(*new.values())


def running_sum(df: DataFrame, keys: list[str], slot: Column, order: list[Column], **columns: Column) -> DataFrame:
    """df with columns of sums over the rows of its group up to itself."""
    own = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    values = {f"_v_{n}": c for n, c in columns.items()}
    rows = df.withColumn("_slot", slot).withColumns(values)
    sums = rows.groupBy(*keys, "_slot").agg(*[F.sum(v).alias(v) for v in values])
    sums = sums.select(*keys, "_slot", *[F.sum(v).over(before).alias(f"_b{v}") for v in values])
    out = join_same(rows.withColumns({v: F.sum(v).over(own) for v in values}), sums, [*keys, "_slot"])
    return out.withColumns({n: F.col(f"_v_{n}") + F.coalesce(f"_b_v_{n}", F.lit(0)) for n in columns}).drop("_slot", *values, *[f"_b{v}" for v in values])


def neighbours(df: DataFrame, keys: list[str], slot: Column, order: list[Column], value: str, before: str, after: str) -> DataFrame:
    """df with ``before`` and ``after``: ``value`` of the rows next to each in its group, null at the ends."""
    w = Window.partitionBy(*keys, "_slot").orderBy(*order)
    rows = df.withColumn("_slot", slot)
    # value follows the order, so a slot's ends are its least and greatest
    ends = rows.groupBy(*keys, "_slot").agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    s = Window.partitionBy(*keys).orderBy("_slot")
    ends = ends.select(*keys, "_slot", F.lag("_high").over(s).alias("_back"), F.lead("_low").over(s).alias("_ahead"))
    rows = join_same(rows.withColumns({before: F.lag(value).over(w), after: F.lead(value).over(w)}), ends, [*keys, "_slot"])
    return rows.withColumns({before: F.coalesce(before, "_back"), after: F.coalesce(after, "_ahead")}).drop("_slot", "_back", "_ahead")


def by_length(df: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """df's rows in groups of up to ``most`` rows, and the rest. The keys of the rest are broadcast: one in ``most`` of all rows at most.

    Both results read df.
    """
    names = {c: f"_l_{c}" for c in keys}
    long_ = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*[F.col(c).alias(n) for c, n in names.items()])
    on = F.lit(True)
    for c, n in names.items():
        on = on & F.col(c).eqNullSafe(F.col(n))
    long_ = F.broadcast(long_)
    return df.join(long_, on, "left_anti"), df.join(long_, on, "left_semi")


def whole_groups(batches: Iterator[pa.RecordBatch], f: Callable[[pa.Table, np.ndarray], pa.Table]) -> Iterator[pa.RecordBatch]:
    """f(rows, starts of the groups in them) of rows in order, in which ``_i`` counts each group's from 1; no group is cut by a batch's end."""
    held: list[pa.RecordBatch] = []

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            yield from f(rows, np.flatnonzero(rows.column("_i").to_numpy() == 1)).combine_chunks().to_batches()

    for batch in batches:
        starts = np.flatnonzero(batch.column("_i").to_numpy(zero_copy_only=False) == 1)
        if len(starts):
            last = int(starts[-1])
            yield from out(pa.Table.from_batches([*held, batch.slice(0, last)], batch.schema))
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield from out(pa.Table.from_batches(held))
