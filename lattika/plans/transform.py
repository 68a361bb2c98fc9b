"""Queries of regions and tiles in the transform domain, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quantize
from ..operators import lifting, regions, transform_domain
from ..operators.transform_domain import Region
from .queries import query, r6, table

# images of 40 rows (the last one shorter) by 64 samples from the vectors
_SAMPLES = "(SELECT vec_id // 40 AS img, vec_id % 40 AS y, i AS x, CAST(round(CAST(e AS DOUBLE) * 1000) AS BIGINT) AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS e FROM embeddings))"


def _samples(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return rows.select(F.floor(F.col("vec_id") / 40).alias("img"), (F.col("vec_id") % 40).alias("y"), F.col("x").cast("bigint").alias("x"), F.round(F.col("e").cast("double") * 1000).cast("bigint").alias("v"))


def _axis(source: str, axis: str, keys: str) -> str:
    """One lifting step by neighbours looked up by their place, mirrored at the ends."""
    other = "y" if axis == "x" else "x"
    return f"""(WITH s AS (SELECT *, max({axis}) OVER (PARTITION BY {keys}, band, {other}) AS top FROM {source}),
h AS (SELECT o.*, o.v - ((a.v + coalesce(b.v, a.v)) >> 1) AS h FROM s o JOIN s a USING ({keys}, band, {other}) LEFT JOIN s b ON {" AND ".join(f"b.{k} = o.{k}" for k in (*keys.split(", "), "band", other))} AND b.{axis} = o.{axis} + 1 WHERE o.{axis} % 2 = 1 AND a.{axis} = o.{axis} - 1),
l AS (SELECT e.*, e.v + (CASE WHEN e.top = 0 THEN 0 ELSE (coalesce(p.h, n.h) + coalesce(n.h, p.h) + 2) >> 2 END) AS l FROM s e LEFT JOIN h p ON {" AND ".join(f"p.{k} = e.{k}" for k in (*keys.split(", "), "band", other))} AND p.{axis} = e.{axis} - 1 LEFT JOIN h n ON {" AND ".join(f"n.{k} = e.{k}" for k in (*keys.split(", "), "band", other))} AND n.{axis} = e.{axis} + 1 WHERE e.{axis} % 2 = 0)
SELECT {keys}, band || 'L' AS band, {other}, {axis} // 2 AS {axis}, l AS v FROM l UNION ALL SELECT {keys}, band || 'H', {other}, {axis} // 2, h FROM h)"""


def _bands(source: str, keys: str) -> str:
    """CTEs one, two and bands: two levels over both axes."""
    level = lambda s: _axis(_axis(f"(SELECT {keys}, '' AS band, y, x, v FROM {s})", "x", keys), "y", keys)
    return f"""one AS MATERIALIZED (SELECT * FROM {level(source)}), two AS MATERIALIZED (SELECT * FROM {level("(SELECT * FROM one WHERE band = 'LL')")}),
bands AS (SELECT {keys}, 1 AS level, band, y, x, v FROM one WHERE band <> 'LL' UNION ALL SELECT {keys}, 2, band, y, x, v FROM two)"""


_DISC = "((x - 30.0) / 9 * ((x - 30.0) / 9) + (y - 14.0) / 6 * ((y - 14.0) / 6) <= 1)"
_BOX = "(x >= 3 AND x < 17 AND y >= 8 AND y < 19)"


def _regions() -> list[Region]:
    x, y = F.col("x"), F.col("y")
    disc = Region(regions.ellipse(x, y, 30.0, 14.0, 9.0, 6.0), 3.0, feather=2, planes=((1, 5.0),))
    return [disc, Region(regions.rectangle(x, y, 3, 8, 14, 11), 1.5, feather=3, mode="average"), Region(F.col("v") > 1200, 0.5, mode="weighted", priority=3)]


_QUADRANTS = f"""g AS (SELECT img, y, x, {_DISC} AS m0, {_BOX} AS m1, v > 1200 AS m2 FROM {_SAMPLES}),
c AS (SELECT DISTINCT img, level, y // s AS y, x // s AS x, b AS band, s FROM g, (VALUES (1, 2), (2, 4)) AS l(level, s), (VALUES ('LL', 0, 0), ('HL', 1, 0), ('LH', 0, 1), ('HH', 1, 1)) AS q(b, qx, qy) WHERE b <> 'LL' OR level = 2),
w AS (SELECT c.img, c.level, c.band, c.y, c.x, bool_or(m0) AS m0, bool_or(m1) AS m1, bool_or(m2) AS m2 FROM c JOIN g ON g.img = c.img
  AND g.x >= c.x * s + (CASE WHEN c.band[1] = 'H' THEN s // 2 ELSE 0 END) AND g.x < c.x * s + (CASE WHEN c.band[1] = 'H' THEN s ELSE s // 2 END)
  AND g.y >= c.y * s + (CASE WHEN c.band[2] = 'H' THEN s // 2 ELSE 0 END) AND g.y < c.y * s + (CASE WHEN c.band[2] = 'H' THEN s ELSE s // 2 END) GROUP BY 1, 2, 3, 4, 5)"""


def _near(mask: str, width: int) -> str:
    return f"(SELECT min(sqrt(((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))::DOUBLE)) FROM w b WHERE b.img = a.img AND b.level = a.level AND b.band = a.band AND b.{mask} AND abs(a.x - b.x) <= {width} AND abs(a.y - b.y) <= {width})"


_SCALES = f"""{_QUADRANTS}, n AS (SELECT *, {_near("m0", 2)} AS d0, {_near("m1", 3)} AS d1 FROM w a),
f AS (SELECT *, CASE WHEN d0 <= 2 THEN 1 - d0 / 2 ELSE 0 END AS f0, CASE WHEN d1 <= 3 THEN 1 - d1 / 3 ELSE 0 END AS f1 FROM n),
s0 AS (SELECT *, CASE WHEN f0 > 0 THEN greatest(1, 1 + 2.0::DOUBLE * f0) ELSE 1.0::DOUBLE END AS s FROM f),
s1 AS (SELECT *, CASE WHEN f1 > 0 THEN (s + (1 + 0.5::DOUBLE * f1)) / 2 ELSE s END AS t FROM s0),
scales AS (SELECT img, level, band, y, x, CASE WHEN m2 THEN t * 0.7::DOUBLE + 0.5::DOUBLE * 0.3::DOUBLE ELSE t END AS scale FROM s1)"""


@query(f"WITH {_SCALES} SELECT img, level, band, y, x, round(scale, 6) AS scale FROM scales")
def region_scales(spark, d):
    return transform_domain.scaling_map(_samples(spark, d), ["img"], 2, _regions()).withColumn("scale", r6("scale"))


@query(f"""WITH {_bands(_SAMPLES, "img")}, {_SCALES} SELECT img, level, band, y, x, CAST(trunc(v * coalesce(scale, 1)) AS BIGINT) AS v FROM bands LEFT JOIN scales USING (img, level, band, y, x)""")
def region_coefficients(spark, d):
    rows = _samples(spark, d)
    coefficients = lifting.decompose53(rows, ["img"], ["x", "y"], "v", 2)
    return transform_domain.scale_coefficients(coefficients, transform_domain.scaling_map(rows, ["img"], 2, _regions()), ["img"])


@query(f"""WITH {_bands(_SAMPLES, "img")}, {_QUADRANTS} SELECT img, level, band, y, x, CAST(trunc(v * (CASE WHEN m2 THEN 0.5 WHEN m1 THEN 1.5 WHEN m0 AND (x + y) % 3 = 1 THEN 5 WHEN m0 THEN 3 ELSE 1 END)::DOUBLE) AS BIGINT) AS v FROM bands LEFT JOIN w USING (img, level, band, y, x)""")
def bit_plane_coefficients(spark, d):
    rows = _samples(spark, d)
    coefficients = lifting.decompose53(rows, ["img"], ["x", "y"], "v", 2).withColumn("plane", (F.col("x") + F.col("y")) % 3)
    return transform_domain.scale_bit_planes(coefficients, rows, ["img"], 2, _regions(), "plane").drop("plane")


_TILES = f"(SELECT img, y // 28 * 3 + x // 24 AS tile, y % 28 AS y, x % 24 AS x, v FROM {_SAMPLES})"


@query(f"""WITH {_bands(_TILES, "img, tile")} SELECT img, tile, level, band, y, x, v FROM bands""")
def tiled_transform(spark, d):
    """Tiles of 24 by 28 samples: those at the right have 16 columns, those below 12 rows."""
    return transform_domain.decompose_tiles(_samples(spark, d), ["img"], "v", 2, 24, 28, F.lit(3))


@query(f"SELECT * FROM {_SAMPLES}")
def tiled_round_trip(spark, d):
    bands = transform_domain.decompose_tiles(_samples(spark, d), ["img"], "v", 2, 24, 28, F.lit(3))
    return transform_domain.recompose_tiles(bands, ["img"], 2, 24, 28, F.lit(3))


@query(f"""WITH {_bands(_SAMPLES, "img")}, q AS (SELECT img, level, band, v, 25.0::DOUBLE * pow(2, level - 1) / (CASE band WHEN 'LL' THEN 1 WHEN 'HH' THEN 4 ELSE 2 END) AS step FROM bands)
SELECT img, level, band, step, count(*) AS n, CAST(sum(CAST(trunc(v / step) AS BIGINT)) AS BIGINT) AS total, count(*) FILTER (abs(v) >= step) AS kept FROM q GROUP BY 1, 2, 3, 4""")
def step_sizes(spark, d):
    """Every coefficient by the step of its sub-band."""
    coefficients = lifting.decompose53(_samples(spark, d), ["img"], ["x", "y"], "v", 2)
    rows = quantize.quantize_bands(coefficients, F.lit(25.0), reversible=False)
    return rows.groupBy("img", "level", "band", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("index").alias("total"), F.count(F.when(F.col("index") != 0, 1)).alias("kept"))
