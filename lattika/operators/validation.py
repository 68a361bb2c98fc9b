"""Checks of marker sequences and of sample precision, as aggregations that give a row for each file or group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marker codes.
START, SIZE, STYLE, TILE_PART, DATA, END = 0xFF4F, 0xFF51, 0xFF52, 0xFF90, 0xFF93, 0xFFD9


def marker_order(markers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_markers, issues, warnings and valid for each file of ``markers`` (keys, position, marker).

    The start marker is first and not counted, the size marker follows it at once (there it counts twice), coding style stays before the first tile
    part, and an end marker exists. Without a coding style in the main header there is a warning.
    """
    m, p = F.col("marker"), F.col("position")
    rows = markers.withColumn("_tile", F.min(F.when(m == TILE_PART, p)).over(Window.partitionBy(*keys)))
    late = (m == STYLE) & (p > F.col("_tile"))
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    got = rows.groupBy(*keys).agg(
        has((p == 0) & (m == START)).alias("_start"), has((p == 2) & (m == SIZE)).alias("_second"), has(m == SIZE).alias("_size"), has(m == END).alias("_end"),
        has((m == STYLE) & (F.col("_tile").isNull() | (p < F.col("_tile")))).alias("_style"), F.count_if(late).alias("n_late"), F.count_if(m != START).alias("_n"),
    )
    issue = lambda bad, name: F.when(bad, F.lit(name))
    issues = F.array_compact(F.array(issue(~F.col("_start"), "start_not_first"), issue(F.col("_start") & ~F.col("_second"), "size_not_second"), issue(F.col("n_late") > 0, "style_in_tile_part"), issue(~F.col("_size"), "size_missing"), issue(~F.col("_end"), "end_missing")))
    counted = F.col("_n") + F.when(F.col("_start") & F.col("_second"), 1).otherwise(0)
    return got.select(*keys, counted.cast("bigint").alias("n_markers"), "n_late", issues.alias("issues"), F.array_compact(F.array(issue(~F.col("_style"), "style_missing"))).alias("warnings"), (F.size(issues) == 0).alias("valid"))


def tile_parts(markers: DataFrame, keys: list[str], least_length: int = 10) -> DataFrame:
    """keys, position and error of each tile part of ``markers`` (keys, position, marker, length): ``short`` or ``no_data``, null if sound.

    A tile part needs a data marker before the next tile part or the end. length counts the segment with its length field; null: not read.
    """
    w = Window.partitionBy(*keys).orderBy("position")
    parts = markers.filter(F.col("marker").isin(TILE_PART, DATA, END)).withColumn("_next", F.lead("marker").over(w)).filter(F.col("marker") == TILE_PART)
    return parts.select(*keys, "position", F.when(F.col("length") < least_length, "short").when(F.coalesce(F.col("_next") != DATA, F.lit(True)), "no_data").alias("error"))


def precision(df: DataFrame, keys: list[str], original: Column, rebuilt: Column, bit_depth: int, least_psnr: float) -> DataFrame:
    """is_exact, max_error, mse and passes (PSNR at least ``least_psnr``; a perfect match passes) of paired integer samples of each group."""
    d = rebuilt - original
    rows = df.groupBy(*keys).agg(F.max(F.abs(d)).alias("max_error"), F.avg((d * d).cast("double")).alias("mse"))
    peak = float((1 << bit_depth) - 1)
    return rows.select(*keys, (F.col("max_error") == 0).alias("is_exact"), "max_error", "mse", F.when(F.col("mse") == 0, True).otherwise(10 * F.log10(F.lit(peak * peak) / F.nullif("mse", F.lit(0.0))) >= least_psnr).alias("passes"))
