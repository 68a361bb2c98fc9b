"""Point curves on samples of a bit depth: gamma, logarithms, exponentials, perceptual and hybrid-log curves, and tables."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The perceptual quantiser (ST 2084) and hybrid log-gamma (BT.2100) constants.
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073


def limits(bit_depth: int, signed: bool = False) -> tuple[int, int]:
    return (-(1 << bit_depth - 1), (1 << bit_depth - 1) - 1) if signed else (0, (1 << bit_depth) - 1)


def curve(n: Column, kind: str, parameter: float | list[float] | None = None, inverse: bool = False) -> Column:
    """A curve on a sample normalised to 0..1."""
    zero = F.lit(0.0)
    if kind == "identity":
        return n
    if kind == "gamma":
        return F.pow(F.greatest(n, zero), F.lit(1.0 / parameter if inverse else float(parameter)))
    if kind in ("log", "log10"):  # both are scaled to 0..1, so the base drops out
        return F.pow(F.lit(2.0), n) - 1 if inverse else F.log2(n + 1)
    if kind == "exp":
        return F.log1p(n * (math.e - 1)) if inverse else (F.exp(n) - 1) / (math.e - 1)
    if kind == "pq":
        if inverse:
            y = F.pow(F.greatest(n, zero), F.lit(PQ_M1))
            return F.pow((PQ_C1 + PQ_C2 * y) / (1 + PQ_C3 * y), F.lit(PQ_M2))
        e = F.pow(F.greatest(n, zero), F.lit(1 / PQ_M2))
        return F.pow(F.greatest(e - PQ_C1, zero) / (PQ_C2 - PQ_C3 * e), F.lit(1 / PQ_M1))
    if kind == "hlg":
        if inverse:
            return F.when(n <= 1 / 12, F.sqrt(3 * F.greatest(n, zero))).otherwise(HLG_A * F.ln(F.greatest(12 * n - HLG_B, F.lit(1e-300))) + HLG_C)
        return F.when(n <= 0.5, n * n / 3).otherwise((F.exp((n - HLG_C) / HLG_A) + HLG_B) / 12)
    if kind == "table":
        t = F.array(*[F.lit(float(x)) for x in parameter])
        at = n * (len(parameter) - 1)
        low = F.least(F.floor(at), F.lit(max(0, len(parameter) - 2))).cast("int")
        a, b = F.element_at(t, low + 1), F.element_at(t, F.least(low + 2, F.lit(len(parameter))))
        return a + (b - a) * (at - low)
    raise ValueError(f"no curve {kind}")


def apply(v: Column, kind: str, bit_depth: int, parameter=None, signed: bool = False, inverse: bool = False) -> Column:
    """The curve over the bit range, clamped to it and rounded half away from zero."""
    low, high = limits(bit_depth, signed)
    n = (v - low) / float(high - low)
    out = curve(n, kind, parameter, inverse) * float(high - low) + low
    return F.round(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), out))).cast("bigint")
