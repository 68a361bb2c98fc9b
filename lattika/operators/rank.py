"""Orders, priorities and budgets."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Loop orders of packets: layer, resolution, component, precinct, slice.
ORDERS = {"LRCPS": "lrcps", "RLCPS": "rlcps", "PCRLS": "pcrls", "SLRCP": "slrcp", "CPRLS": "cprls"}


def within_budget(df: DataFrame, keys: list[str], order: list[Column], size: str, budget: int, most: int | None = None) -> DataFrame:
    """The head of each group's order while the running size stays within the budget: a prefix, so nothing after the first overflow."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("running", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("position", F.row_number().over(w))
    rows = rows.filter(F.col("running") <= budget)
    return rows.filter(F.col("position") <= most) if most else rows


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n of each group; Spark keeps no more than n of a group in any task."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("position") <= n)


def packet_order(spark: SparkSession, order: str, layers: int, resolutions: int, components: int, precincts: list[int], slices: int = 1) -> DataFrame:
    """position and the packet's layer, resolution, component, precinct and slice; precincts are given for each resolution, 1 where missing."""
    if sorted(order.upper()) != sorted("LRCPS") or tuple(order.upper()) not in set(permutations("LRCPS")):
        raise ValueError(f"no order {order}")
    count = F.array(*[F.lit(precincts[r] if r < len(precincts) else 1) for r in range(resolutions)])
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = spark.range(1).select(axis(layers).alias("l")).withColumn("r", axis(resolutions)).withColumn("c", axis(components)).withColumn("s", axis(slices))
    rows = rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.element_at(count, F.col("r") + 1) - 1)))
    at = F.row_number().over(Window.orderBy(*order.lower())) - 1  # a packet table is small: its size is the header's
    return rows.select(at.cast("bigint").alias("position"), *[F.col(a).cast("bigint").alias(b) for a, b in zip("lrcps", ("layer", "resolution", "component", "precinct", "slice"), strict=True)])


def packets(df: DataFrame, keys: list[str], order: Column, layers: Column, resolutions: Column, components: Column, precincts: Column, slices: Column | int = 1) -> DataFrame:
    """keys, position, layer, resolution, component, precinct and slice of every packet of each row of ``df``, in the row's own order (a text of the letters L, R, C, P and S).

    ``precincts`` is an array by resolution, 1 where missing. A row's packets are one window: their number is the header's.
    """
    axis = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n).cast("bigint") - 1))
    rows = df.select(*keys, F.upper(order).alias("_o"), components.alias("_c"), precincts.alias("_p"), resolutions.alias("_r"), axis(layers).alias("layer")).filter("_r > 0 and _c > 0")
    rows = rows.withColumn("resolution", axis(F.col("_r"))).withColumn("component", axis(F.col("_c"))).withColumn("slice", axis(slices))
    rows = rows.withColumn("precinct", axis(F.coalesce(F.get("_p", F.col("resolution").cast("int")), F.lit(1))))
    of = F.create_map(*[x for k, c in zip("LRCPS", ("layer", "resolution", "component", "precinct", "slice"), strict=True) for x in (F.lit(k), F.col(c))])
    rows = rows.withColumn("_by", F.transform(F.split("_o", ""), lambda c: F.try_element_at(of, c)))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("_by")) - 1
    return rows.select(*keys, at.cast("bigint").alias("position"), "layer", "resolution", "component", "precinct", "slice")


def slice_order(z: Column, low: int | Column, high: int | Column, mode: str) -> Column:
    """Sort key of a slice: forward, reverse, or from the centre: mid, mid + 1, mid - 1, ..."""
    if mode == "forward":
        return z
    if mode == "reverse":
        return -z
    mid = F.floor((F.lit(low) + F.lit(high)) / 2)
    return F.when(z > mid, 2 * (z - mid) - 1).otherwise(2 * (mid - z))


def tile_priority(distance: Column, overlaps: Column, level: Column, levels: int) -> Column:
    """Priority by the distance to the view's centre over its diagonal; background without overlap, critical at the two coarsest levels alone."""
    return F.when(~overlaps, "background").when((distance < 0.2) & (level >= levels - 2), "critical").when(distance < 0.4, "high").when(distance < 0.7, "normal").otherwise("low")


def coding_slopes(df: DataFrame, keys: list[str], order: str, size: str, distortion: str) -> DataFrame:
    """df with slope: distortion removed for each byte that a pass adds."""
    w = Window.partitionBy(*keys).orderBy(order)
    gain = F.coalesce(F.lag(distortion).over(w), F.lit(0.0)) - F.col(distortion)
    return df.withColumn("slope", F.coalesce(F.try_divide(gain, size), F.lit(0.0)))
