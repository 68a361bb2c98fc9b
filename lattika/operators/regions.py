"""Half-open boxes, tiles and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tile_grid(extent: Column, tile: Column) -> Column:
    """Tiles along an axis: the quotient rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.floor((extent + tile - 1) / tile)).cast("bigint")


def tiles(spark: SparkSession, extents: tuple[int, int, int], sizes: tuple[int, int, int], region: tuple[int, int, int, int, int, int] | None = None) -> DataFrame:
    """tx, ty, tz and the clipped box of each tile; with a region (x0, x1, y0, y1, z0, z1) only those it touches, by index arithmetic."""
    axes = []
    for k, (extent, size) in enumerate(zip(extents, sizes, strict=True)):
        n = max(1, -(-extent // size))
        lo, hi = 0, n
        if region:
            a, b = max(0, region[2 * k]), min(extent, region[2 * k + 1])
            lo, hi = (a // size, min(n, -(-b // size))) if a < b else (0, 0)
        axes.append(range(lo, hi))
    grid = spark.range(1)
    for name, axis in zip(("tx", "ty", "tz"), axes, strict=True):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(i).cast("bigint") for i in axis]) if len(axis) else F.array().cast("array<bigint>")))
    box = {}
    for name, t, extent, size in zip("xyz", ("tx", "ty", "tz"), extents, sizes, strict=True):
        box[f"{name}0"] = F.col(t) * size
        box[f"{name}1"] = F.least(F.lit(extent), (F.col(t) + 1) * size).cast("bigint")
    return grid.drop("id").withColumns(box)


def tiles_meeting(df: DataFrame, extents: list[Column], sizes: list[Column], lows: list[Column], highs: list[Column]) -> DataFrame:
    """df with a row for each tile that its half-open box meets: tx, ty, ... and the clipped tile x0, x1, y0, ... by index arithmetic alone. Empty and foreign boxes meet none."""
    rows = df
    for name, extent, size, low, high in zip("xyz", extents, sizes, lows, highs, strict=False):
        a, b = F.greatest(F.lit(0), low), F.least(extent, high)
        axis = F.when(a < b, F.sequence(F.floor(a / size), F.floor((b - 1) / size))).otherwise(F.array().cast("array<bigint>"))
        rows = rows.withColumn(f"t{name}", F.explode(axis))
        rows = rows.withColumns({f"{name}0": (F.col(f"t{name}") * size).cast("bigint"), f"{name}1": F.least(extent, (F.col(f"t{name}") + 1) * size).cast("bigint")})
    return rows


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length of the common part of two half-open ranges, 0 if none."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def contains(value: Column, low: Column, high: Column) -> Column:
    return (value >= low) & (value < high)


def interval_join(points_or_ranges: DataFrame, ranges: DataFrame, bucket: int) -> DataFrame:
    """Pairs of (a_id, a0, a1) and (b_id, b0, b1) rows that overlap.

    Both sides are cut into buckets of ``bucket`` units, joined on the bucket by equality, and kept in the bucket where the overlap
    begins, so that each pair comes once and no nested loop is planned.
    """
    def cut(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.filter(F.col(lo) < F.col(hi)).withColumn("_k", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor((F.col(hi) - 1) / bucket))))

    both = cut(points_or_ranges, "a0", "a1").join(cut(ranges, "b0", "b1"), "_k").filter((F.col("a0") < F.col("b1")) & (F.col("a1") > F.col("b0")))
    return both.filter(F.col("_k") == F.floor(F.greatest("a0", "b0") / bucket)).drop("_k")


def rectangle(x: Column, y: Column, x0: int, y0: int, width: int, height: int) -> Column:
    return (x >= x0) & (x < x0 + width) & (y >= y0) & (y < y0 + height)


def ellipse(x: Column, y: Column, cx: float, cy: float, rx: float, ry: float) -> Column:
    dx, dy = (x - cx) / rx, (y - cy) / ry
    return dx * dx + dy * dy <= 1


def polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule by ray casting."""
    inside = F.lit(False)
    for (xi, yi), (xj, yj) in zip(vertices, [vertices[-1], *vertices[:-1]], strict=True):
        if yi == yj:
            continue
        crosses = ((F.lit(yi) > y) != (F.lit(yj) > y)) & (x < F.lit(float(xj - xi)) * (y - yi) / float(yj - yi) + xi)
        inside = inside != crosses
    return inside


def priority_mask(masks: list[tuple[Column, int]]) -> Column:
    """The highest priority among the masks that hold, 0 for none."""
    return F.greatest(F.lit(0), *[F.when(m, p).otherwise(0) for m, p in masks])


def wavelet_mask(pixels: DataFrame, level: int, mask: str = "mask") -> DataFrame:
    """subband, y, x, mask: a coefficient is in the region if any pixel of its quadrant of the s x s block is, s = 2^(level + 1)."""
    s = 2 ** (level + 1)
    right, low = (F.col("x") % s) >= s // 2, (F.col("y") % s) >= s // 2
    band = F.when(right & low, "HH").when(right, "HL").when(low, "LH").otherwise("LL")
    return pixels.groupBy(band.alias("subband"), F.floor(F.col("y") / s).alias("y"), F.floor(F.col("x") / s).alias("x")).agg(F.bool_or(mask).alias("mask"))


def frustum_meets(center: tuple[Column, Column, Column], half_diagonal: Column, origin: tuple[float, float, float], direction: tuple[float, float, float], near: float, far: float) -> Column:
    """Conservative test of a box by its centre's depth along the view direction."""
    depth = None
    for c, o, d in zip(center, origin, direction, strict=True):
        term = (c - o) * d
        depth = term if depth is None else depth + term
    return (depth + half_diagonal >= near) & (depth - half_diagonal <= far)


def blended_scale(regions_: list[tuple[Column, float, str]]) -> Column:
    """Scale of a sample under (mask, scale, mode) regions, folded in order from 1: modes maximum, minimum, average and replace.

    Averages are pairwise, so they depend on the order.
    """
    out = F.lit(1.0)
    for mask, scale, mode in regions_:
        new = F.lit(float(scale))
        blend = {"maximum": F.greatest(out, new), "minimum": F.least(out, new), "average": (out + new) / 2, "replace": new}[mode]
        out = F.when(mask, blend).otherwise(out)
    return out


def by_parent(df: DataFrame, parent: str, columns: list[str]) -> DataFrame:
    """Regions of each parent, null for the roots, in order of the columns."""
    return df.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("regions"))


def children(regions: DataFrame, keys: list[str], parent: str, index: str) -> DataFrame:
    """keys, parent (null: roots) and the sorted array of the regions below it; keys are images, whose regions are few."""
    return regions.groupBy(*keys, parent).agg(F.array_sort(F.collect_list(index)).alias("children"))
