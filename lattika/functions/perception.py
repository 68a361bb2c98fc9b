"""Visual weights, masking and visibility thresholds as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Viewing conditions and strengths.
PEAK, DECAY, DISTANCE_CM, PPI, WEIGHTS = 4.0, 0.4, 60.0, 96.0, (0.1, 4.0)
LUMINANCE, TEXTURE, MOTION, FACTORS = 0.5, 0.7, 0.6, (0.5, 3.0)


def _clamped(c: Column, limits: tuple[float, float]) -> Column:
    return F.least(F.lit(limits[1]), F.greatest(F.lit(limits[0]), c))


def contrast_sensitivity(frequency: Column) -> Column:
    n = F.abs(frequency) / PEAK
    return F.greatest(F.lit(0.01), n * F.exp(1 - n / DECAY))


def visual_weight(subband: Column, level: Column, levels: int, width: int, height: int) -> Column:
    """1 over the sensitivity at the sub-band's centre, relative to the peak's; level 0 first."""
    base = 0.25 / F.pow(F.lit(2.0), levels - level - 1)
    f = base * F.when(subband == "LL", 0.5).when(subband == "HH", 1.414).otherwise(1.0)
    side = math.sqrt(width * height)
    degrees = 2 * math.degrees(math.atan(side / PPI * 2.54 / (2 * DISTANCE_CM)))
    relative = contrast_sensitivity(f * (side / degrees)) / contrast_sensitivity(F.lit(PEAK))
    return _clamped(1 / F.greatest(F.lit(0.1), relative), WEIGHTS)


def luminance_masking(luminance: Column) -> Column:
    d = F.abs(luminance / 255.0 - 0.5)
    return 1 + 2 * d * d


def texture_masking(variance: Column) -> Column:
    return 1 + 1.5 * F.log1p(F.least(variance / 5000.0, F.lit(1.0)) * 10) / math.log1p(10)


def motion_masking(magnitude: Column) -> Column:
    return 1 + F.tanh(F.least(magnitude / 20.0, F.lit(1.0)) * 2)


def masking_factor(luminance: Column, variance: Column, motion: Column | None = None) -> Column:
    """Product of the damped factors, clamped; motion counts only where it is given."""
    out = (1 + LUMINANCE * (luminance_masking(luminance) - 1)) * (1 + TEXTURE * (texture_masking(variance) - 1))
    if motion is not None:
        out = out * (1 + MOTION * (motion_masking(motion) - 1))
    return _clamped(out, FACTORS)


def visibility_threshold(luminance: Column, variance: Column, distance_cm: float = 60.0) -> Column:
    return (2.0 + 0.05 * F.sqrt(F.greatest(F.lit(1.0), luminance))) * (1 + F.sqrt(variance / 100.0)) * math.sqrt(distance_cm / 60.0)


def adjusted_quantization(q: Column, target: Column, achieved: Column) -> Column:
    return _clamped(q * (1 - 0.3 * (target - achieved)), (0.001, 1.0))
