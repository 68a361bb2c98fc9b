"""Delivery decisions: layers under a budget, quality steps, prefetch, eviction, upserts of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Bandwidths, in bytes a second, and the share of all layers that each affords (numerator, denominator).
STEPS = ((10_000_000, 1, 1), (5_000_000, 3, 4), (2_000_000, 1, 2), (1_000_000, 1, 3), (500_000, 1, 4))


def quality_layers(bandwidth: Column, rtt: Column, layers: int, latency: float = 100.0) -> Column:
    """Layers that the bandwidth affords, one or two fewer for slow round trips, 1 at least."""
    out = None
    for least, a, b in STEPS:
        value = layers * a // b
        out = F.when(bandwidth >= least, value) if out is None else out.when(bandwidth >= least, value)
    out = out.otherwise(1)
    return F.greatest(F.lit(1), F.least(F.lit(layers), out - F.when(rtt > 1.5 * latency, 2).when(rtt > latency, 1).otherwise(0))).cast("bigint")


def smoothed(current: Column, target: Column, layers: int, factor: float) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(layers), F.floor(factor * current + (1 - factor) * target))).cast("bigint")


def form_layers(passes: DataFrame, keys: list[str], budget: float, block: str, number: str, size: str, slope: str) -> DataFrame:
    """Passes of each group that go into its layer: steepest first (ties by block, pass); one that would overflow is skipped unless the layer is empty; from 95 % of the budget on none is taken.

    A fold over one group's sorted passes: groups are images, whose passes are bounded.
    """
    item = F.struct((-F.col(slope)).alias("o"), F.col(block).alias("block"), F.col(number).alias("number"), F.col(size).cast("double").alias("size"))
    rows = passes.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_p"))
    kind = f"array<struct<block:{dict(passes.dtypes)[block]},number:{dict(passes.dtypes)[number]}>>"
    start = F.struct(F.lit(0.0).alias("used"), F.array().cast(kind).alias("taken"))

    def step(a: Column, p: Column) -> Column:
        full = a["used"] >= F.floor(F.lit(budget * 0.95))
        over = (a["used"] + p["size"] > budget) & (F.size(a["taken"]) > 0)
        more = F.struct((a["used"] + p["size"]).alias("used"), F.concat(a["taken"], F.array(F.struct(p["block"].alias("block"), p["number"].alias("number")))).alias("taken"))
        return F.when(((F.size(a["taken"]) > 0) & full) | over, a).otherwise(more)

    return rows.select(*keys, F.aggregate("_p", start, step)["taken"].alias("_t")).select(*keys, F.inline("_t"))


def tiles_of_view(x: Column, y: Column, width: int, height: int, tile: int, across: int, down: int) -> Column:
    """Numbers of the tiles that a view covers."""
    axis = lambda at, size, n: F.sequence(F.greatest(F.lit(0), F.floor(at / tile)), F.least(F.lit(n - 1), F.floor((at + size - 1) / tile)))
    return F.flatten(F.transform(axis(y, height, down), lambda ty: F.transform(axis(x, width, across), lambda tx: ty * across + tx)))


def prefetch(views: DataFrame, keys: list[str], order: list[str], width: int, height: int, tile: int, across: int, down: int, depth: float = 2.0) -> DataFrame:
    """The tiles that the next view will need, for each view from the second on: views move on by the mean of the last four moves times the depth.

    views: keys, order, x, y. Result: keys, order, confidence and tiles, without those of the view itself.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    last = w.rowsBetween(-3, 0)
    moved = views.withColumns({"_dx": F.col("x") - F.lag("x").over(w), "_dy": F.col("y") - F.lag("y").over(w)})
    moved = moved.withColumns({"_mx": F.avg("_dx").over(last), "_my": F.avg("_dy").over(last)}).filter("_mx is not null")
    cx, cy = F.col("x") + width / 2, F.col("y") + height / 2
    at = lambda c, m, size, n: F.least(F.lit(n * tile - 1), F.greatest(F.lit(0), F.floor(c + m * depth) - size // 2))
    now = tiles_of_view(F.col("x"), F.col("y"), width, height, tile, across, down)
    then = tiles_of_view(at(cx, F.col("_mx"), width, across), at(cy, F.col("_my"), height, down), width, height, tile, across, down)
    move = F.sqrt(F.col("_mx") * F.col("_mx") + F.col("_my") * F.col("_my"))
    return moved.select(*keys, *order, F.greatest(F.lit(0.1), 1 - move / float(max(across, down) * tile)).alias("confidence"), F.array_sort(F.array_except(then, now)).alias("tiles"))


def eviction_score(level: Column, age_seconds: Column, hits: Column) -> Column:
    """Worth of a cache entry: coarser, younger and busier entries stay."""
    return 1 / F.greatest(F.lit(1), level + 1) / (1 + age_seconds) * (hits + 1)


def evict(entries: DataFrame, keys: list[str], score: Column, size: str, limit: int, tie: str) -> DataFrame:
    """Entries that stay while the most valuable of each group fit the limit."""
    w = Window.partitionBy(*keys).orderBy(score.desc(), tie).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("_run", F.sum(size).over(w)).filter(F.col("_run") <= limit).drop("_run")


def merge_parts(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert of parts (keys, layers ARRAY, data BINARY, complete): layers united, bytes appended, completeness or-ed."""
    n = new.withColumnsRenamed({"layers": "_l", "data": "_d", "complete": "_c"})
    none = F.array().cast(held.schema["layers"].dataType)
    empty = F.unhex(F.lit(""))
    return held.join(n, keys, "full_outer").select(
        *keys, F.array_sort(F.array_union(F.coalesce("layers", none), F.coalesce("_l", none))).alias("layers"),
        F.concat(F.coalesce("data", empty), F.coalesce("_d", empty)).alias("data"), (F.coalesce("complete", F.lit(False)) | F.coalesce("_c", F.lit(False))).alias("complete"),
    )


def missing_features(required: Column, supported: Column, display: Column) -> tuple[Column, Column]:
    """(features missing, verdict): compatible, partial (all that display needs is there) or incompatible."""
    gone = F.array_sort(F.array_except(required, supported))
    return gone, F.when(F.size(gone) == 0, "compatible").when(F.size(F.array_except(display, supported)) == 0, "partial").otherwise("incompatible")


def frame_table(samples: DataFrame, chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Frames with offset and time from sample sizes, chunk offsets and chunk runs.

    samples: track, idx (from 0), size, duration; chunks: track, chunk (from 0), offset; runs: track, first_chunk (from 1), per_chunk.
    A chunk takes the last run that starts at or before it, 1 sample without one.
    """
    a = chunks.select("track", (F.col("chunk") + 1).alias("c"), "offset", F.lit(None).cast("bigint").alias("per"), F.lit(1).alias("_side"))
    b = runs.select("track", F.col("first_chunk").cast("bigint").alias("c"), F.lit(None).cast("bigint").alias("offset"), F.col("per_chunk").cast("bigint").alias("per"), F.lit(0).alias("_side"))
    w = Window.partitionBy("track").orderBy("c", "_side")
    sized = a.unionByName(b).withColumn("per", F.coalesce(F.last("per", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))).filter("_side = 1")
    before = F.coalesce(F.sum("per").over(Window.partitionBy("track").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = sized.withColumn("_first", before).filter("per > 0").select("track", "c", "offset", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("per") - 1)).alias("idx"))
    rows = samples.join(slots, ["track", "idx"])
    earlier = lambda v, *by: F.coalesce(F.sum(v).over(Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("track", "idx", "size", "duration", (F.col("offset") + earlier("size", "track", "c")).alias("offset"), earlier("duration", "track").alias("ts"))


def layer_shares(df: DataFrame, layers: Column, voxels: Column, bits: Column) -> DataFrame:
    """df with a row for each layer that shares its row's bits equally: index, target_bits (a voxel) and distortion_reduction. No voxels, no layers."""
    rows = df.withColumns({"_n": layers, "_v": voxels, "_b": bits}).filter("_v > 0 and _n > 0").withColumn("index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n").cast("bigint") - 1)))
    f = (F.col("index") + 1) / F.col("_n").cast("double")
    return rows.withColumns({"target_bits": f * (F.col("_b") / F.col("_v").cast("double")), "distortion_reduction": f * f}).drop("_n", "_v", "_b")


def equal_layers(spark: SparkSession, layers: int, total_voxels: int, total_bits: int) -> DataFrame:
    """index, target_bits (a voxel) and distortion_reduction of layers that share the bits equally."""
    f = (F.col("id") + 1) / float(layers)
    return spark.range(layers if total_voxels > 0 else 0).select(F.col("id").alias("index"), (f * (total_bits / max(1, total_voxels))).alias("target_bits"), (f * f).alias("distortion_reduction"))


def proportional_layers(blocks: DataFrame, keys: list[str], block: str, passes: str, size: str, target_bytes: list[float]) -> DataFrame:
    """keys, layer, block and the passes that each layer takes of it: up to 3, 6, 9, ... of each block, in block order, while the layer's bytes so far are under its target."""
    w = Window.partitionBy(*keys, "layer").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("_l", F.explode(F.array(*[F.struct(F.lit(i).alias("layer"), F.lit(float(t)).alias("target")) for i, t in enumerate(target_bytes)])))
    rows = rows.select(*keys, block, size, F.col("_l.layer").alias("layer"), F.col("_l.target").alias("_target"), F.least(F.col(passes), 3 * (F.col("_l.layer") + 1)).alias("taken")).filter("taken > 0")
    return rows.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0))).filter(F.col("_before") < F.col("_target")).select(*keys, "layer", block, "taken")


def region_schedule(lows: list[Column], highs: list[Column], volume: list[int], tile: list[int], tile_bytes: int, bandwidth: Column) -> tuple[Column, Column, Column]:
    """(tiles, bytes, seconds) of a box request, clipped to the volume; a bandwidth of 0 or less means the default of 10 MB a second."""
    count = F.lit(1)
    for lo, hi, n, t in zip(lows, highs, volume, tile, strict=True):
        lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(n))
        count = count * F.when(hi > lo, F.ceil(hi / t) - F.floor(lo / t)).otherwise(0)
    size = count * tile_bytes
    return count, size, size / F.when(bandwidth > 0, bandwidth).otherwise(10_000_000.0)
