"""Rules on features, requests, deliveries and images as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The feature that extended ones need, the features with needs, and the bounds of a shift.
READER, LAYERS, NONE = "needsJPXReader", "multipleCompositionLayers", "noExtensions"
EXTENDED = ("multiComponentTransform", "nonLinearTransform", "arbitraryWavelets", "trellisQuantization", "extendedROI", "extendedPrecision", "dcOffset", "visualMasking", "perceptualEncoding")
LAYERED = ("compositing", "animation")


def dependencies(feature: Column) -> Column:
    """The features that a feature needs."""
    return F.when(feature.isin(*EXTENDED), F.array(F.lit(READER))).when(feature.isin(*LAYERED), F.array(F.lit(LAYERS))).otherwise(F.array().cast("array<string>"))


def feature_issues(features: Column) -> Column:
    """Sorted array of struct(feature, severity, other): contradictions, missing companions and missing dependencies of a set of features."""
    has = lambda f: F.array_contains(features, f)
    issue = lambda f, s, other: F.struct(f.alias("feature"), F.lit(s).alias("severity"), other.alias("other"))
    none = F.array().cast("array<struct<feature:string,severity:string,other:string>>")
    one = lambda test, f, s, other: F.when(test, F.array(issue(F.lit(f), s, F.lit(other)))).otherwise(none)
    missing = F.flatten(F.transform(features, lambda f: F.transform(F.array_except(dependencies(f), features), lambda d: issue(f, "error", d))))
    parts = (
        one(F.exists(features, lambda f: f.isin(*EXTENDED)) & ~has(READER), READER, "warning", "extended features"), one(has(NONE) & (F.size(features) > 1), NONE, "error", "other features"),
        one(has("visualMasking") & ~has("perceptualEncoding"), "visualMasking", "warning", "perceptualEncoding"), missing,
    )
    return F.array_sort(F.concat(*parts))


def delivery_priority(kind: Column, layer: Column, viable: int, background: int) -> Column:
    """Headers are critical; packets fall from high to background with their quality layer."""
    packet = kind == "precinct"
    return F.when(kind.isin("main_header", "tile_header"), "critical").when(packet & (layer <= viable), "high").when(packet & (layer <= viable + 2), "medium").when(packet & (layer <= background), "low").otherwise("background")


def preference_fits(preference: Column, high_throughput: Column, format_: Column) -> Column:
    """Whether an image suits a coding preference: none, htj2k or legacy."""
    return F.when(preference == "htj2k", high_throughput).when(preference == "legacy", ~high_throughput | format_.isin("jp2", "j2k")).otherwise(True)


def query_items(target: Column, pairs: dict[str, tuple[Column, Column]], values: dict[str, Column], lists: dict[str, Column] | None = None) -> Column:
    """A request as a map of strings: target, pairs as "a,b", plain values and comma-separated lists; what is null, or an empty list, is left out."""
    text = {"target": target} | {k: F.concat_ws(",", a.cast("string"), b.cast("string")) for k, (a, b) in pairs.items()} | {k: v.cast("string") for k, v in values.items()}
    shown = {k: (a.isNotNull() & b.isNotNull()) for k, (a, b) in pairs.items()}
    for k, v in (lists or {}).items():
        text[k] = F.array_join(F.transform(v, lambda x: x.cast("string")), ",")
        shown[k] = F.coalesce(F.size(v) > 0, F.lit(False))
    entries = [F.when(shown.get(k, v.isNotNull()), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in text.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def feature_xml(name: Column, description: Column) -> Column:
    """A feature's description as XML."""
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<jpx:Feature xmlns:jpx="http://www.jpeg.org/jpx">\n  <jpx:Name>'
    return F.concat(F.lit(head), name, F.lit("</jpx:Name>\n  <jpx:Description>"), description, F.lit("</jpx:Description>\n</jpx:Feature>"))


def image_error(width: Column, height: Column, bit_depths: Column, tile_width: Column, tile_height: Column) -> Column:
    """What is wrong with an image's description, null if nothing is: dimensions, components, bit_depth or tiles."""
    tiled = (tile_width > 0) | (tile_height > 0)
    return (
        F.when((width <= 0) | (height <= 0), "dimensions").when(F.coalesce(F.size(bit_depths), F.lit(0)) <= 0, "components").when(F.exists(bit_depths, lambda b: (b < 1) | (b > 38)), "bit_depth")
        .when(tiled & ((tile_width <= 0) | (tile_height <= 0)), "tiles")
    )


def hit_rate(hits: Column, misses: Column) -> Column:
    """hits over all, 0 without any."""
    return F.coalesce(F.try_divide(hits.cast("double"), (hits + misses).cast("double")), F.lit(0.0))


def ticks(seconds: Column) -> Column:
    """A duration at 1,000 ticks a second."""
    return F.floor(seconds * 1000).cast("bigint")


def bits_at(data: Column, first: Column, n: int) -> Column:
    """n bits (1 to 32) of a BINARY from a bit offset, the highest first; null past the end."""
    span = 5  # bytes that hold 32 bits at any offset
    start = F.floor(first / 8).cast("int")
    padded = F.rpad(F.hex(F.substring(data, start + 1, F.lit(span))), 2 * span, "0")
    value = F.conv(padded, 16, 10).cast("bigint")
    shift = (8 * span - n - first % 8).cast("int")
    return F.when(first + n <= 8 * F.octet_length(data), F.call_function("shiftright", value, shift).bitwiseAND(F.lit((1 << n) - 1)))


def packed(values: Column, n: int) -> Column:
    """An array of numbers below 2^n as BINARY, n bits each, the highest first; zeros fill the last byte."""
    bits = F.array_join(F.transform(values, lambda v: F.lpad(F.bin(v.cast("bigint")), n, "0")), "")
    whole = F.rpad(bits, (F.ceil(F.length(bits) / 8) * 8).cast("int"), F.lit("0"))
    octets = F.sequence(F.lit(1), F.greatest(F.length(whole) - 7, F.lit(1)), F.lit(8))
    return F.unhex(F.array_join(F.transform(octets, lambda i: F.lpad(F.conv(F.substring(whole, i, F.lit(8)), 2, 16), 2, "0")), ""))
