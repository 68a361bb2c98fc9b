"""Wavelet lifting on array columns; everything stays inside higher-order expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The 9/7 lifting steps and scale.
ALPHA, BETA, GAMMA, DELTA, SCALE = -1.586134342, -0.05298011854, 0.8829110762, 0.4435068522, 1.149604398


def _half(signal: Column, first: int) -> Column:
    return F.filter(signal, lambda _, i: i % 2 == first)


def _at(a: Column, i: Column, boundary: str) -> Column:
    """a[i] with the boundary rule: symmetric repeats the end element, periodic wraps, zero is 0."""
    n = F.size(a)
    if boundary == "periodic":
        return F.get(a, F.pmod(i, n))
    if boundary == "zero":
        return F.when((i >= 0) & (i < n), F.get(a, i)).otherwise(0)
    return F.get(a, F.greatest(F.lit(0), F.least(i, n - 1)))


def _step(to: Column, other: Column, shift: int, f: Callable[[Column, Column, Column], Column], boundary: str) -> Column:
    """to[i] changed by its neighbours other[i + shift - 1] and other[i + shift]."""
    return F.transform(to, lambda x, i: f(x, _at(other, i + (shift - 1), boundary), _at(other, i + shift, boundary)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: a lambda's argument is not evaluated again for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def forward53(signal: Column, boundary: str = "symmetric") -> Column:
    """struct(low, high): high = odd - ((left + right) >> 1), low = even + ((left + right + 2) >> 2). Signals of 2 or more integers."""

    def bands(even: Column, odd: Column) -> Column:
        high = _step(odd, even, 1, lambda x, a, b: x - F.shiftright(a + b, 1), boundary)
        return _let(high, lambda h: F.struct(_step(even, h, 0, lambda x, a, b: x + F.shiftright(a + b + 2, 2), boundary).alias("low"), h.alias("high")))

    return _let(_half(signal, 0), lambda even: _let(_half(signal, 1), lambda odd: bands(even, odd)))


def _interleave(even: Column, odd: Column) -> Column:
    n = F.size(even) + F.size(odd)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 0, F.get(even, F.floor(i / 2).cast("int"))).otherwise(F.get(odd, F.floor(i / 2).cast("int"))))


def inverse53(low: Column, high: Column, boundary: str = "symmetric") -> Column:
    even = _step(low, high, 0, lambda x, a, b: x - F.shiftright(a + b + 2, 2), boundary)
    odd = lambda e: _step(high, e, 1, lambda x, a, b: x + F.shiftright(a + b, 1), boundary)
    return _let(even, lambda e: _let(odd(e), lambda o: _interleave(e, o)))


def _lift(even: Column, odd: Column, steps: list[tuple[str, float]], boundary: str, then: Callable[[Column, Column], Column]) -> Column:
    """Lifting steps in turn, each on the odd or even half by the other; then(even, odd) at the end."""
    if not steps:
        return then(even, odd)
    (half, w), rest = steps[0], steps[1:]
    if half == "odd":
        new = _step(odd, even, 1, lambda x, a, b: x + w * (a + b), boundary)
        return _let(new, lambda o: _lift(even, o, rest, boundary, then))
    new = _step(even, odd, 0, lambda x, a, b: x + w * (a + b), boundary)
    return _let(new, lambda e: _lift(e, odd, rest, boundary, then))


_STEPS = [("odd", ALPHA), ("even", BETA), ("odd", GAMMA), ("even", DELTA)]


def forward_lifting(signal: Column, steps: list[tuple[str, float]], scale: float = 1.0, boundary: str = "symmetric") -> Column:
    """struct(low, high) of any lifting steps, each (half to change, weight); then low times the scale and high divided by it."""
    done = lambda e, o: F.struct(F.transform(e, lambda x: x * scale).alias("low"), F.transform(o, lambda x: x / scale).alias("high"))
    return _let(_half(signal, 0), lambda e: _let(_half(signal, 1), lambda o: _lift(e, o, steps, boundary, done)))


def inverse_lifting(low: Column, high: Column, steps: list[tuple[str, float]], scale: float = 1.0, boundary: str = "symmetric") -> Column:
    """The signal: the steps backwards, with their signs changed."""
    back = [(half, -w) for half, w in reversed(steps)]
    return _let(F.transform(low, lambda x: x / scale), lambda e: _let(F.transform(high, lambda x: x * scale), lambda o: _lift(e, o, back, boundary, _interleave)))


def forward97(signal: Column, boundary: str = "symmetric") -> Column:
    return forward_lifting(signal, _STEPS, SCALE, boundary)


def inverse97(low: Column, high: Column, boundary: str = "symmetric") -> Column:
    return inverse_lifting(low, high, _STEPS, SCALE, boundary)


def fir_analysis(signal: Column, low: tuple[float, ...], high: tuple[float, ...], boundary: str = "symmetric") -> Column:
    """struct(low, high) by two filters, each centred: low at even places, high at odd ones. Symmetric ends repeat the end sample."""

    def value(s: Column, i: Column) -> Column:
        n = F.size(s)
        if boundary == "symmetric":
            return F.get(s, F.when(i < 0, F.least(-i - 1, n - 1)).when(i >= n, F.greatest(2 * n - i - 1, F.lit(0))).otherwise(i))
        return _at(s, i, boundary)

    def band(s: Column, taps: tuple[float, ...], first: int) -> Column:
        def at(i: Column) -> Column:
            out = F.lit(0.0)
            for k, t in enumerate(taps):
                out = out + F.lit(float(t)) * value(s, 2 * i + (first + k - len(taps) // 2))
            return out

        count = F.floor((F.size(s) + 1 - first) / 2).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), at)).otherwise(F.array().cast("array<double>"))

    return _let(signal, lambda s: F.struct(band(s, low, 0).alias("low"), band(s, high, 1).alias("high")))


def transpose(rows: Column) -> Column:
    """Columns of an array of equally long arrays."""
    width = F.size(F.get(rows, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(rows, lambda r: F.get(r, j)))


def forward_2d(image: Column, forward: Callable[[Column], Column] = forward53) -> Column:
    """struct(ll, hl, lh, hh) of an array of rows: rows first, then columns. Each band is an array of rows."""

    def columns(half: Column) -> Column:
        return _let(transpose(half), lambda c: F.transform(c, lambda x: forward(x)))

    def bands(rows: Column) -> Column:
        low, high = columns(F.transform(rows, lambda r: r["low"])), columns(F.transform(rows, lambda r: r["high"]))
        part = lambda c, k: transpose(F.transform(c, lambda x: x[k]))
        return _let(low, lambda a: _let(high, lambda b: F.struct(part(a, "low").alias("ll"), part(b, "low").alias("hl"), part(a, "high").alias("lh"), part(b, "high").alias("hh"))))

    return _let(F.transform(image, lambda r: forward(r)), bands)


def inverse_2d(bands: Column, inverse: Callable[[Column, Column], Column] = inverse53) -> Column:
    """The array of rows of a struct(ll, hl, lh, hh)."""
    pair = lambda a, b: F.transform(F.arrays_zip(transpose(a).alias("a"), transpose(b).alias("b")), lambda p: inverse(p["a"], p["b"]))
    rows = lambda k: _let(pair(k["ll"], k["lh"]), lambda low: _let(pair(k["hl"], k["hh"]), lambda high: pair(low, high)))
    return _let(bands, rows)


def forward53_long(df: DataFrame, keys: list[str], axis: str, value: str) -> DataFrame:
    """One level along one axis of a long grid: keys, axis (halved), low and high.

    For lines too long for an array. Pairs are formed by one aggregation, and neighbours come from one window on the same keys; further axes are further passes. high is null past the end of a line of odd length.
    """
    pick = lambda k: F.max(F.when(F.col(axis) % 2 == k, F.col(value).cast("bigint")))
    pairs = df.groupBy(*keys, F.floor(F.col(axis) / 2).alias(axis)).agg(pick(0).alias("_even"), pick(1).alias("_odd"))
    w = Window.partitionBy(*keys).orderBy(axis)
    pairs = pairs.withColumn("high", F.col("_odd") - F.shiftright(F.col("_even") + F.coalesce(F.lead("_even").over(w), F.col("_even")), 1))
    left, right = F.lag("high").over(w), F.col("high")
    low = F.col("_even") + F.shiftright(F.coalesce(left, right, F.lit(0)) + F.coalesce(right, left, F.lit(0)) + 2, 2)
    return pairs.select(*keys, axis, low.alias("low"), "high")


def inverse53_long(df: DataFrame, keys: list[str], axis: str, low: str = "low", high: str = "high", value: str = "v") -> DataFrame:
    """Undoes forward53_long: keys, axis (doubled) and value."""
    w = Window.partitionBy(*keys).orderBy(axis)
    left, right = F.lag(high).over(w), F.col(high)
    even = F.col(low) - F.shiftright(F.coalesce(left, right, F.lit(0)) + F.coalesce(right, left, F.lit(0)) + 2, 2)
    rows = df.select(*keys, axis, even.alias("_even"), F.col(high).alias("_high"))
    odd = F.col("_high") + F.shiftright(F.col("_even") + F.coalesce(F.lead("_even").over(w), F.col("_even")), 1)
    rows = rows.withColumn("_odd", odd)
    both = F.array(F.struct((F.col(axis) * 2).alias(axis), F.col("_even").alias(value)), F.struct((F.col(axis) * 2 + 1).alias(axis), F.col("_odd").alias(value)))
    return rows.select(*keys, F.inline(both)).filter(F.col(value).isNotNull())


def forward53_grid(df: DataFrame, keys: list[str], axes: list[str], value: str) -> DataFrame:
    """One level over several axes of a long grid, in their order: keys, band (L or H for each axis), axes (halved) and v."""
    rows = df.select(*keys, *axes, F.col(value).alias("v"), F.lit("").alias("band"))
    for axis in axes:
        others = [*keys, "band", *[a for a in axes if a != axis]]
        step = forward53_long(rows, others, axis, "v")
        parts = F.array(F.struct(F.lit("L").alias("_b"), F.col("low").alias("v")), F.struct(F.lit("H").alias("_b"), F.col("high").alias("v")))
        rows = step.select(*others, axis, F.inline(parts)).filter("v is not null").withColumn("band", F.concat("band", "_b")).drop("_b")
    return rows.select(*keys, "band", *axes, "v")


def decompose53(df: DataFrame, keys: list[str], axes: list[str], value: str, levels: int, between: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Levels of forward53_grid, each on the low band of the one before: keys, level (from 1), band, axes and v.

    ``between`` is applied to each level's rows; pass one that checkpoints where levels are many, as each level reads the one before twice.
    """
    low, out, rest = "L" * len(axes), None, df.select(*keys, *axes, F.col(value).alias("v"))
    for level in range(1, levels + 1):
        rows = between(forward53_grid(rest, keys, axes, "v"))
        rest = rows.filter(F.col("band") == low).drop("band")
        kept = rows if level == levels else rows.filter(F.col("band") != low)
        kept = kept.withColumn("level", F.lit(level))
        out = kept if out is None else out.unionByName(kept)
    return out.select(*keys, "level", "band", *axes, "v")


def inverse53_grid(df: DataFrame, keys: list[str], axes: list[str], value: str = "v") -> DataFrame:
    """Undoes forward53_grid: keys, axes (doubled) and v. Axes are undone from the last; each is one aggregation and one inverse along it."""
    rows = df.select(*keys, "band", *axes, F.col(value).alias("v"))
    for axis in reversed(axes):
        others = [*keys, "band", *[a for a in axes if a != axis]]
        side = F.substring("band", -1, 1)
        pairs = rows.withColumn("_side", side).withColumn("band", F.expr("left(band, length(band) - 1)"))
        pairs = pairs.groupBy(*others, axis).agg(F.max(F.when(F.col("_side") == "L", F.col("v"))).alias("low"), F.max(F.when(F.col("_side") == "H", F.col("v"))).alias("high"))
        rows = inverse53_long(pairs, others, axis)
    return rows.select(*keys, *axes, "v")


def recompose53(df: DataFrame, keys: list[str], axes: list[str], levels: int, between: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Undoes decompose53, the coarsest level first: keys, axes and v. ``between`` is as there."""
    low = "L" * len(axes)
    rest = df.filter((F.col("level") == levels) & (F.col("band") == low)).select(*keys, *axes, "v")
    for level in range(levels, 0, -1):
        bands = df.filter((F.col("level") == level) & (F.col("band") != low)).select(*keys, "band", *axes, "v")
        rest = between(inverse53_grid(rest.withColumn("band", F.lit(low)).unionByName(bands), keys, axes))
    return rest
