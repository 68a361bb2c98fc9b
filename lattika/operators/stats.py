"""Statistics, error metrics and reports: all partial-then-final aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def component_statistics(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """n, mean, min, max and population std of each group; zeros where a group has no value."""
    v = value.cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), zero(F.avg(v)).alias("mean"), zero(F.min(v)).alias("min"), zero(F.max(v)).alias("max"), zero(F.stddev_pop(v)).alias("std"))


def remove_offset(df: DataFrame, keys: list[str], value: str, method: str = "mean") -> DataFrame:
    """df with offset (rounded mean, or midrange, of the group) and centred = value - offset. The group table is one row a group."""
    off = F.round(F.avg(value)) if method == "mean" else F.floor((F.min(value) + F.max(value)) / 2)
    return df.join(df.groupBy(*keys).agg(off.cast("bigint").alias("offset")), keys).withColumn("centred", F.col(value) - F.col("offset"))


def error_metrics(df: DataFrame, keys: list[str], a: Column, b: Column, peak: float, tolerance: float) -> DataFrame:
    """mse, psnr (null for a perfect match: no finite value), max_error and within_tolerance of paired samples."""
    d = a - b
    rows = df.groupBy(*keys).agg(F.coalesce(F.avg(d * d), F.lit(0.0)).alias("mse"), F.coalesce(F.max(F.abs(d)), F.lit(0.0)).alias("max_error"), F.coalesce(F.bool_and(F.abs(d) <= tolerance), F.lit(True)).alias("within_tolerance"))
    return rows.withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(F.lit(float(peak) ** 2) / F.col("mse"))))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """i, j, r: Pearson matrix with population moments; stds floored at 1e-12, the diagonal 1. One pass over the data."""
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(n)]
    r = lambda i, j: F.lit(1.0) if i == j else F.covar_pop(columns[i], columns[j]) / (F.greatest(F.stddev_pop(columns[i]), F.lit(1e-12)) * F.greatest(F.stddev_pop(columns[j]), F.lit(1e-12)))
    return df.agg(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), r(i, j).alias("r")) for i, j in pairs]).alias("m")).select(F.inline("m"))


def run_statistics(df: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """n, avg, median, min, max, sample std (0 for one run) and runs a second."""
    return df.groupBy(*keys).agg(F.count(seconds).alias("n"), F.avg(seconds).alias("avg"), F.median(seconds).alias("median"), F.min(seconds).alias("min"), F.max(seconds).alias("max"), F.coalesce(F.stddev_samp(seconds), F.lit(0.0)).alias("std")).withColumn("per_second", F.coalesce(F.try_divide(F.lit(1.0), "avg"), F.lit(0.0)))


def regressions(current: DataFrame, baseline: DataFrame, keys: list[str], value: str, threshold: float = 0.05) -> DataFrame:
    """Keys whose value grew by more than the threshold against the baseline."""
    b = baseline.select(*keys, F.col(value).alias("baseline"))
    rows = current.select(*keys, F.col(value).alias("current")).join(b, keys)
    return rows.withColumn("change", F.try_divide(F.col("current") - F.col("baseline"), F.col("baseline"))).filter(F.col("change") > threshold)


def profile(df: DataFrame, stage: str, seconds: str) -> DataFrame:
    """total and share of each stage, and whether it is the bottleneck (ties: the first by name)."""
    per = df.groupBy(stage).agg(F.sum(seconds).alias("total"))
    all_ = per.agg(F.sum("total").alias("_all"), F.max(F.struct("total", stage))["total"].alias("_top"), F.min_by(stage, F.struct(-F.col("total"), stage)).alias("_worst"))
    return per.crossJoin(F.broadcast(all_)).select(stage, "total", F.coalesce(F.try_divide("total", "_all"), F.lit(0.0)).alias("share"), (F.col(stage) == F.col("_worst")).alias("bottleneck"))


def usage_report(df: DataFrame, image: str, level: str, size: str) -> DataFrame:
    """Entries, bytes and distinct images by image, by level and in all, in one pass of grouping sets."""
    return df.groupingSets([[image], [level], []], image, level).agg(F.count(F.lit(1)).alias("entries"), F.sum(size).alias("bytes"), F.count_distinct(image).alias("images"))
