"""Headers, versions, schemas, rates and big-endian numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known frame rates, with time scale and frame duration.
RATES = ((23.976, 24000, 1001), (24.0, 24000, 1000), (25.0, 25000, 1000), (29.97, 30000, 1001), (30.0, 30000, 1000), (50.0, 50000, 1000), (59.94, 60000, 1001), (60.0, 60000, 1000))
GENERIC_TIMESCALE = 90000


def channel_id(header: Column) -> Column:
    """The value of key cid in comma-separated key=value fields; null if there is none."""
    return F.nullif(F.regexp_extract(header, r"(?:^|,)[ \t]*cid[ \t]*=[ \t]*([^,]*?)[ \t]*(?:,|$)", 1), F.lit(""))


def version(text: Column) -> Column:
    """A version number after the word version, else the first three-part number, else unknown."""
    tries = [F.regexp_extract(text, p, 1) for p in (r"(?i)version\s+(\d+\.\d+\.?\d*)", r"(?i)version:\s*(\d+\.\d+\.?\d*)", r"(\d+\.\d+\.\d+)")]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tries], F.lit("unknown"))


def xml_schema(xml: Column) -> Column:
    has = lambda *parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(xml, p))
    return F.when(has("http://www.opengis.net/gml", "gml:", "<gml"), "gml").when(has("http://www.jpeg.org/jpx", "jpx:", "<jpx"), "jpx").otherwise("generic")


def timescale(rate: Column) -> Column:
    """struct(timescale, duration) of a frame rate: a known one within 0.01, else the generic scale."""
    pair = lambda t, d: F.struct(F.lit(t).cast("bigint").alias("timescale"), d.cast("bigint").alias("duration"))
    out = None
    for r, t, d in RATES:
        test = F.abs(rate - r) < 0.01
        out = F.when(test, pair(t, F.lit(d))) if out is None else out.when(test, pair(t, F.lit(d)))
    return out.otherwise(pair(GENERIC_TIMESCALE, F.floor(GENERIC_TIMESCALE / rate)))


def normalized(values: Column) -> Column:
    """An array scaled to 0..1; 0.5 everywhere if it is constant."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda x: F.coalesce(F.try_divide((x - low).cast("double"), (high - low).cast("double")), F.lit(0.5)))


def big_endian(data: Column, at: Column | int, size: int) -> Column:
    """An unsigned number of 1 to 7 bytes at an offset from 0; null past the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(at + size <= F.octet_length(data), F.conv(F.hex(F.substring(data, at + 1, F.lit(size))), 16, 10).cast("bigint"))


def valid_rate(numerator: Column, denominator: Column) -> Column:
    """Whether a frame rate is positive and within 1/128 to 999."""
    rate = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce((numerator > 0) & (denominator > 0) & rate.between(1 / 128, 999.0), F.lit(False))


def consistent_duration(frames: Column, duration: Column, rate: Column) -> Column:
    """Whether frames over duration is within 1 % of the rate."""
    implied = F.try_divide(frames.cast("double"), duration.cast("double"))
    return F.coalesce((frames > 0) & (duration > 0) & (F.abs(implied - rate) <= 0.01 * rate), F.lit(False))
