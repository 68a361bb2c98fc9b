"""Quantisers, step sizes and bit-depth helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _sign(c: Column) -> Column:
    return F.when(c >= 0, 1).otherwise(-1)


def scalar(c: Column, step: Column) -> Column:
    """sign * floor(|c| / step)"""
    return (_sign(c) * F.floor(F.abs(c) / step)).cast("bigint")


def deadzone(c: Column, step: Column, width: float = 1.0) -> Column:
    """0 up to half the dead zone, then bins of one step."""
    edge = step * width * 0.5
    return F.when(F.abs(c) <= edge, 0).otherwise(_sign(c) * (F.floor((F.abs(c) - edge) / step) + 1)).cast("bigint")


def level_rate(q: Column) -> Column:
    """Bits of a level: 1 for zero, else 2 + log2(|q| + 1)."""
    return F.when(q == 0, 1.0).otherwise(2 + F.log2(F.abs(q) + 1.0))


def trellis(c: Column, step: Column, weight: float = 0.5) -> Column:
    """The level of the cheapest trellis path: squared error plus ``weight`` times the bits, the lower level on a tie.

    States differ only in whether they add one to the level, and a move costs the same from every state, so the cheapest path
    takes the cheaper level at each coefficient: no order, and no search, is left.
    """
    low = F.floor(F.abs(c) / step)
    cost = lambda n: F.pow(F.abs(c) - n * step, 2.0) + weight * level_rate(n)
    return (_sign(c) * (low + F.when(cost(low) <= cost(low + 1), 0).otherwise(1))).cast("bigint")


def dequantize_midpoint(q: Column, step: Column) -> Column:
    """0 stays 0; other bins give their middle."""
    return F.when(q == 0, 0.0).otherwise((q + 0.5 * F.signum(q)) * step)


def dequantize_plain(q: Column, step: Column) -> Column:
    """The volume form: q * step, and q itself for steps of 1 or less."""
    return F.when(step <= 1, q.cast("double")).otherwise(q * step)


def slice_quantize(c: Column, step: Column, dead_zone: float = 0.5) -> Column:
    """The slice form: h = step * (1 + dead_zone) / 2; 0 below h, else trunc((|c| - h) / step) with the sign."""
    h = step * (1 + dead_zone) / 2
    return F.when(F.abs(c) < h, 0).otherwise(_sign(c) * F.floor((F.abs(c) - h) / step)).cast("bigint")


def slice_dequantize(q: Column, step: Column) -> Column:
    return F.when(q == 0, 0.0).otherwise(F.signum(q) * (F.abs(q) + 0.5) * step)


def gain(subband: Column, reversible: bool) -> Column:
    """Sub-band gain: for LL, one high-pass side, and HH."""
    one, two = (2.0**0.5, 2.0) if reversible else (2.0, 4.0)
    return F.when(subband == "LL", 1.0).when(subband.isin("LH", "HL"), one).otherwise(two)


def step_size(base: Column, subband: Column, level: Column, reversible: bool) -> Column:
    """base * 2^level / gain; level 0 is the finest."""
    return base * F.pow(F.lit(2.0), level) / gain(subband, reversible)


def step_table(spark: SparkSession, base: float, levels: int, reversible: bool) -> DataFrame:
    """subband, level (from 1) and step of every sub-band of a decomposition."""
    rows = spark.range(1, levels + 1).select(F.explode(F.array(*map(F.lit, ("LH", "HL", "HH")))).alias("subband"), F.col("id").alias("level"))
    rows = rows.unionByName(spark.range(1).select(F.lit("LL").alias("subband"), F.lit(levels).cast("bigint").alias("level")))
    return rows.withColumn("step", step_size(F.lit(base), F.col("subband"), F.col("level") - 1, reversible))


def quantize_bands(coefficients: DataFrame, base: Column, reversible: bool, band: str = "band", level: str = "level", value: str = "v") -> DataFrame:
    """coefficients (level from 1) with the step of their sub-band and the index, by the dead zone: steps follow from level and band, so no table is joined."""
    step = step_size(base, F.col(band), F.col(level) - 1, reversible)
    rows = coefficients.withColumn("step", step)
    return rows.withColumn("index", (F.signum(F.col(value).cast("double")) * F.floor(F.abs(F.col(value)) / F.col("step"))).cast("bigint"))


def encode_step(step: Column) -> tuple[Column, Column]:
    """(exponent biased by 16, 11-bit mantissa), both clamped; (0, 0) for steps of 0 or less."""
    e = F.floor(F.log2(step))
    mantissa = F.greatest(F.lit(0), F.least(F.lit(2047), F.floor((step / F.pow(F.lit(2.0), e) - 1) * 2048)))
    ok = step > 0
    return F.when(ok, F.greatest(F.lit(0), F.least(F.lit(31), e + 16))).otherwise(0).cast("bigint"), F.when(ok, mantissa).otherwise(0).cast("bigint")


def decode_step(exponent: Column, mantissa: Column) -> Column:
    return F.pow(F.lit(2.0), exponent - 16) * (1 + mantissa / 2048.0)


def adjust_step(step: Column, bit_depth: int, reference: int = 8) -> Column:
    return step * float(2 ** (bit_depth - reference))


def volume_step(mode: str, bit_depth: int, levels: int, target: float = 0.0) -> float:
    """One step for a volume: lossless 1; psnr: from the target dB; bitrate: from bits a voxel."""
    if mode == "lossless":
        return 1.0
    if mode == "psnr":
        return max(1.0, (12 * (2**bit_depth - 1) ** 2 / 10 ** (target / 10)) ** 0.5)
    return max(1.0, 2 ** max(0.0, bit_depth - target) / (levels + 1) ** 0.5)


def clamp(c: Column, bit_depth: int, signed: bool = True) -> Column:
    low, high = (-(1 << bit_depth - 1), (1 << bit_depth - 1) - 1) if signed else (0, (1 << bit_depth) - 1)
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def scaled(c: Column, factor: float, bit_depth: int) -> Column:
    """A coefficient times a factor, rounded half away from zero and clamped to the signed range of the depth."""
    return clamp(F.round(c * float(factor)).cast("bigint"), bit_depth)


def shift_bits(bit_depth: Column, guard: int = 2, default: int = 5, low: int = 0, high: int = 37) -> Column:
    """Bits by which a region is shifted: the default, fewer where depth and guard bits are few, within bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.least(bit_depth + (guard - 1), F.lit(default))))


def round_mode(c: Column, mode: str) -> Column:
    """truncate, nearest (half away from zero) or nearest-even"""
    return {"truncate": F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)), "nearest": F.round(c), "nearest-even": F.bround(c)}[mode].cast("double")


def shift_up(c: Column, mask: Column, bits: int) -> Column:
    """Magnitudes of a region of interest shifted up, signs kept."""
    return F.when(mask, F.signum(c.cast("double")).cast("bigint") * F.shiftleft(F.abs(c).cast("bigint"), bits)).otherwise(c.cast("bigint"))


def shift_down(c: Column, bits: int) -> Column:
    """Undoes shift_up where the magnitude tells that it was applied."""
    big = F.abs(c) >= (1 << bits)
    return F.when(big, F.signum(c.cast("double")).cast("bigint") * F.shiftright(F.abs(c).cast("bigint"), bits)).otherwise(c.cast("bigint"))


def guard_bits(bit_depth: Column, levels: Column) -> Column:
    """One for each level and up to two for deep samples, 2 to 15."""
    return F.least(F.lit(15), F.greatest(F.lit(2), levels + F.when(bit_depth > 16, 2).when(bit_depth > 12, 1).otherwise(0)))
