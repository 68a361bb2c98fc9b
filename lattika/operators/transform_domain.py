"""Regions and tiles in the transform domain, over long grids: coefficients are rows (keys, level, band, y, x, v) as ``lifting.decompose53`` gives them for the axes x, y.

A region is a mask over samples; a coefficient of level l is in it if any sample of its quadrant of the 2^l by 2^l block is. All levels and bands are mapped in one aggregation.
Feathering needs the distance to the nearest masked place: one window along rows, one across them, each no wider than the feather.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lifting import decompose53, recompose53
from .slots import join_same


@dataclass(frozen=True)
class Region:
    """``mask`` over x, y and other columns of samples; how much its coefficients are scaled, over how many places the scale fades out, and how it meets earlier regions.

    Modes: maximum, minimum, average, weighted (by a tenth of the priority) and priority (above 1 the new scale, else the earlier one). ``planes`` are scales of bit-planes of their own.
    """

    mask: Column
    scale: float
    feather: int = 0
    mode: str = "maximum"
    priority: int = 1
    planes: tuple[tuple[int, float], ...] = ()


def band_masks(samples: DataFrame, keys: list[str], levels: int, masks: dict[str, Column]) -> DataFrame:
    """keys, level (from 1), band, y, x and each mask, of samples (keys, y, x): low bands of the last level alone. Quadrants beyond the grid have no row; null masks are false."""
    rows = samples.withColumns({n: F.coalesce(m, F.lit(False)) for n, m in masks.items()}).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    side = F.pow(F.lit(2.0), F.col("level")).cast("bigint")
    half = lambda c: F.when(F.col(c) % side >= side / 2, "H").otherwise("L")
    rows = rows.withColumn("band", F.concat(half("x"), half("y"))).filter((F.col("band") != "LL") | (F.col("level") == levels))
    at = [F.floor(F.col(c) / side).alias(c) for c in ("y", "x")]
    rows = rows.select(*keys, "level", "band", *at, *masks)
    if not masks:
        return rows.distinct()
    return rows.groupBy(*keys, "level", "band", "y", "x").agg(*[F.bool_or(n).alias(n) for n in masks])


def feathered(places: DataFrame, keys: list[str], mask: str, width: int, name: str) -> DataFrame:
    """places (keys, y, x, mask) with ``name``: 1 in the mask, falling to 0 at ``width`` places from it."""
    if width <= 0:
        return places.withColumn(name, F.when(F.col(mask), 1.0).otherwise(0.0))
    row = Window.partitionBy(*keys, "y").orderBy("x")
    here = F.when(F.col(mask), F.col("x"))
    left = F.last(here, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(here, ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing))
    rows = places.withColumn("_dx", F.least(F.col("x") - left, right - F.col("x")))
    across = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-width, width)
    near = F.collect_list(F.when(F.col("_dx") <= width, F.struct("y", "_dx"))).over(across)  # 2 * width + 1 at most
    far = F.array_min(F.transform("_near", lambda p: (p["y"] - F.col("y")) * (p["y"] - F.col("y")) + p["_dx"] * p["_dx"]))
    rows = rows.withColumn("_near", near).withColumn("_far", F.sqrt(far.cast("double")))
    value = F.when(F.col(mask), 1.0).when(F.col("_far") <= width, 1.0 - F.col("_far") / float(width)).otherwise(0.0)
    return rows.withColumn(name, value).drop("_dx", "_near", "_far")


def _blend(now: Column, new: Column, r: Region) -> Column:
    part = r.priority / 10.0
    return {
        "maximum": F.greatest(now, new), "minimum": F.least(now, new), "average": (now + new) / 2.0, "weighted": now * (1.0 - part) + new * part, "priority": new if r.priority > 1 else now,
    }[r.mode]


def scaling_map(samples: DataFrame, keys: list[str], levels: int, regions: list[Region]) -> DataFrame:
    """keys, level, band, y, x and scale of every coefficient of samples' transform; regions are folded in order from 1."""
    rows = band_masks(samples, keys, levels, {f"_m{i}": r.mask for i, r in enumerate(regions)})
    out = F.lit(1.0)
    for i, r in enumerate(regions):
        rows = feathered(rows, [*keys, "level", "band"], f"_m{i}", r.feather, f"_f{i}")
        share = F.col(f"_f{i}")
        out = F.when(share > 0, _blend(out, 1.0 + (r.scale - 1.0) * share, r)).otherwise(out)
    return rows.withColumn("scale", out).select(*keys, "level", "band", "y", "x", "scale")


def scale_coefficients(coefficients: DataFrame, scales: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """coefficients with values times their scale (1 without one), fractions cut off."""
    rows = join_same(coefficients, scales, [*keys, "level", "band", "y", "x"])
    return rows.withColumn(value, (F.col(value).cast("double") * F.coalesce("scale", F.lit(1.0))).cast("bigint")).drop("scale")


def scale_bit_planes(coefficients: DataFrame, samples: DataFrame, keys: list[str], levels: int, regions: list[Region], plane: str, value: str = "v") -> DataFrame:
    """coefficients, which have the column ``plane``, with values times the scale of their plane in the last region that holds them: the plane's own scale, or the region's."""
    masks = band_masks(samples, keys, levels, {f"_m{i}": r.mask for i, r in enumerate(regions)})
    rows, out = join_same(coefficients, masks, [*keys, "level", "band", "y", "x"]), F.lit(1.0)
    for i, r in enumerate(regions):
        own = F.lit(float(r.scale))
        for number, scale in r.planes:
            own = F.when(F.col(plane) == number, float(scale)).otherwise(own)
        out = F.when(F.col(f"_m{i}"), own).otherwise(out)
    return rows.withColumn(value, (F.col(value).cast("double") * out).cast("bigint")).drop(*[f"_m{i}" for i in range(len(regions))])


def split_tiles(samples: DataFrame, width: int, height: int, across: Column) -> DataFrame:
    """samples (y, x) with tile, and y, x within it; ``across`` is the number of tiles in a row of the grid. Tiles at the edges are smaller."""
    tile = F.floor(F.col("y") / height) * across + F.floor(F.col("x") / width)
    return samples.withColumns({"tile": tile.cast("bigint"), "y": F.col("y") % height, "x": F.col("x") % width})


def assemble_tiles(tiles: DataFrame, width: int, height: int, across: Column) -> DataFrame:
    """Undoes split_tiles."""
    return tiles.withColumns({"y": F.floor(F.col("tile") / across) * height + F.col("y"), "x": F.col("tile") % across * width + F.col("x")}).drop("tile")


def decompose_tiles(samples: DataFrame, keys: list[str], value: str, levels: int, width: int, height: int, across: Column) -> DataFrame:
    """keys, tile, level, band, y, x and v: every tile is transformed by itself, with its own borders, so no line is longer than a tile."""
    rows = split_tiles(samples.select(*keys, "y", "x", value), width, height, across)
    return decompose53(rows, [*keys, "tile"], ["x", "y"], value, levels)


def recompose_tiles(bands: DataFrame, keys: list[str], levels: int, width: int, height: int, across: Column) -> DataFrame:
    """The grid (keys, y, x, v) that the bands of decompose_tiles are of."""
    return assemble_tiles(recompose53(bands, [*keys, "tile"], ["x", "y"], levels), width, height, across).select(*keys, "y", "x", "v")


def write_tiles(bands: DataFrame, path: str) -> None:
    """Parquet below path/tile=N, so that a window of tiles is read without the others' files."""
    bands.repartition("tile").write.partitionBy("tile").parquet(path)
