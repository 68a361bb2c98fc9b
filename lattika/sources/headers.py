"""Header fields of codestreams as columns.

Scans find segments; their fields are expressions over the bodies (BINARY), without marker or length. A body that is too short gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import big_endian
from .containers import marker_bodies

# Marker codes of size, coding style and quantisation, and progression orders by code.
SIZE, CODING, STEPS = 0xFF51, 0xFF52, 0xFF5C
ORDERS = ("LRCP", "RLCP", "RPCL", "PCRL", "CPRL")


def segments(files: DataFrame) -> DataFrame:
    """path, marker, position and body of each main header segment of ``files`` (path, content)."""
    return marker_bodies(files).filter("error is null and body is not null").drop("error")


def image_size(body: Column) -> Column:
    """struct(width, height, tile_width, tile_height, components): bit depth, signedness and subsampling of each component."""
    number = lambda at, n: big_endian(body, at, n)

    def component(k: Column) -> Column:
        depth = big_endian(body, 36 + 3 * k, 1)
        return F.struct((depth.bitwiseAND(F.lit(127)) + 1).alias("bit_depth"), (depth >= 128).alias("signed"), big_endian(body, 37 + 3 * k, 1).alias("dx"), big_endian(body, 38 + 3 * k, 1).alias("dy"))

    parts = F.when(number(34, 2) > 0, F.transform(F.sequence(F.lit(0), (number(34, 2) - 1).cast("int")), component))
    return F.struct(number(2, 4).alias("width"), number(6, 4).alias("height"), number(18, 4).alias("tile_width"), number(22, 4).alias("tile_height"), parts.alias("components"))


def coding_style(body: Column) -> Column:
    """struct(progression, layers, component_transform, levels, block_width, block_height, high_throughput, reversible); unknown orders read as the first."""
    byte = lambda at: big_endian(body, at, 1)
    order = F.coalesce(F.get(F.array(*map(F.lit, ORDERS)), byte(1).cast("int")), F.lit(ORDERS[0]))
    side = lambda at: F.pow(F.lit(2.0), byte(at) + 2).cast("bigint")
    return F.struct(
        order.alias("progression"), big_endian(body, 2, 2).alias("layers"), (byte(4) == 1).alias("component_transform"), byte(5).alias("levels"), side(6).alias("block_width"), side(7).alias("block_height"),
        (byte(8).bitwiseAND(F.lit(64)) > 0).alias("high_throughput"), (byte(9) == 1).alias("reversible"),
    )


def step_sizes(body: Column, levels: Column) -> Column:
    """Map from sub-band (LL_0, HL_1, LH_1, HH_1, ...) to step: powers of two without quantisation, exponent and mantissa with it; empty for derived steps."""
    style = big_endian(body, 0, 1).bitwiseAND(F.lit(31))
    bands = F.concat(F.array(F.lit("LL_0")), F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(levels, F.lit(1)).cast("int")), lambda k: F.when(k <= levels, F.array(*[F.concat(F.lit(f"{b}_"), k.cast("string")) for b in ("HL", "LH", "HH")])).otherwise(F.array().cast("array<string>")))))
    exponent = lambda k: F.pow(F.lit(2.0), F.floor(big_endian(body, 1 + k, 1) / 8))

    def expounded(k: Column) -> Column:
        code = big_endian(body, 1 + 2 * k, 2)
        return F.pow(F.lit(2.0), F.floor(code / 2048) - 11.0) * (1 + (code % 2048) / 2048.0)

    values = lambda f: F.map_from_arrays(bands, F.transform(bands, lambda _, k: f(k)))
    return F.when(style == 0, values(exponent)).when(style == 2, values(expounded)).when(style.isNotNull(), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))


def headers(files: DataFrame) -> DataFrame:
    """path, size, coding and steps of each file of ``files`` (path, content); the first segment of a kind counts."""
    first = lambda code: F.min_by(F.when(F.col("marker") == code, F.col("body")), F.when(F.col("marker") == code, F.col("position")))
    bodies = segments(files).groupBy("path").agg(first(SIZE).alias("_s"), first(CODING).alias("_c"), first(STEPS).alias("_q"))
    out = bodies.select("path", "_q", image_size(F.col("_s")).alias("size"), coding_style(F.col("_c")).alias("coding"))
    return out.select("path", "size", "coding", step_sizes(F.col("_q"), F.coalesce(F.col("coding.levels"), F.lit(0))).alias("steps"))
