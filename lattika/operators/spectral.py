"""Band indices, band choice and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized_difference(a: Column, b: Column) -> Column:
    """(b - a) / (a + b), 0 where the sum is 0"""
    return F.coalesce(F.try_divide(b - a, a + b), F.lit(0.0))


def nearest_band(bands: DataFrame, target_nm: float) -> DataFrame:
    """The band nearest to a wavelength, the first of equals: one row."""
    return bands.agg(F.min_by("band", F.struct(F.abs(F.col("wavelength_nm") - target_nm), F.col("band"))).alias("band"))


def classify(mean: Column) -> Column:
    """Land cover by mean reflectance; the first test that holds."""
    return F.when(mean > 0.85, "cloud").when(mean < 0.08, "water").when(mean > 0.35, "vegetation").when(mean > 0.25, "urban").when(mean > 0.15, "bare_soil").otherwise("unclassified")


def array_mean(values: Column) -> Column:
    return F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(values)), F.lit(0.0))
