"""Queries of volume streams: orders as small volumes whose lines are slices, nations as streams whose customers are tile parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spatial
from ..operators.staging import folder
from ..sources import volumes
from .queries import query, table


def slices(spark, d) -> DataFrame:
    """A volume of 3 x 2 x 7 samples of two components in tiles of 2 x 2 x 4 for each order; lines that share their number were sent again."""
    rows = table(spark, d, "lineitem")
    value = lambda i: F.when(i == 5, -F.col("l_suppkey")).otherwise(F.col("l_partkey") * (i + 1) % 1000).cast("int")
    sent = F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")
    box = {"width": 3, "height": 2, "depth": 7, "tile_width": 2, "tile_height": 2, "tile_depth": 4, "components": 2}
    samples = F.transform(F.sequence(F.lit(0), F.lit(11)), value)
    return rows.select(F.col("l_orderkey").cast("string").alias("path"), (F.col("l_linenumber") - 1).alias("z"), sent.alias("sent"), samples.alias("samples"), *[F.lit(v).cast("bigint").alias(k) for k, v in box.items()])


@query("""WITH s AS (SELECT l_orderkey AS o, l_linenumber - 1 AS z, arg_max(l_partkey, l_partkey * 1000000 + l_suppkey) AS p, arg_max(l_suppkey, l_partkey * 1000000 + l_suppkey) AS u FROM lineitem GROUP BY ALL),
t AS (SELECT DISTINCT o, z // 4 AS tz, tx FROM s, (VALUES (0), (1)) AS g(tx)),
v AS (SELECT t.o, t.tz, t.tx, c, z.z, y, x, c * 6 + y * 3 + x AS i FROM t, (VALUES (0), (1)) AS c(c), range(0, 7) AS z(z), (VALUES (0), (1)) AS y(y), (VALUES (0), (1), (2)) AS x(x) WHERE z.z // 4 = t.tz AND x // 2 = t.tx),
w AS (SELECT v.*, coalesce(CASE WHEN i = 5 THEN (4294967296 - u) % 4294967296 ELSE p * (i + 1) % 1000 END, 0) AS n FROM v LEFT JOIN s ON s.o = v.o AND s.z = v.z)
SELECT CAST(w.o AS VARCHAR) AS path, CAST(2 * tz + tx AS INTEGER) AS tile, string_agg(format('{:08X}', n), '' ORDER BY c, w.z, y, x) AS samples, any_value(kn) = CASE tz WHEN 0 THEN 4 ELSE 3 END AS complete
FROM w JOIN (SELECT o, z // 4 AS kz, count(*) AS kn FROM s GROUP BY ALL) k ON k.o = w.o AND kz = tz GROUP BY w.o, tz, tx""")
def volume_tiles(spark, d):
    return volumes.slice_tiles(slices(spark, d)).select("path", "tile", F.hex("data").alias("samples"), "complete")


@query("""WITH p AS (SELECT 'n' || c_nationkey AS path, c_nationkey AS k, CAST(c_custkey % 4096 AS INTEGER) AS tile, c_custkey AS part, c_name || '/' || c_mktsegment AS text FROM customer),
q AS (SELECT *, strlen(text) AS n, 2 + 2 + (46 + 3 * (1 + k % 3)) + 16 + (CASE k % 2 WHEN 0 THEN 5 + 3 * (k % 4) + 1 ELSE 5 + 2 * (3 * (k % 4) + 1) END) AS head FROM p)
SELECT path, tile, head + 14 + CAST(coalesce(sum(n + 14) OVER (PARTITION BY path ORDER BY tile, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", n AS length, text,
 CAST(64 + k AS BIGINT) AS width, CAST(32 + k AS BIGINT) AS depth, CAST(1 + k % 3 AS INTEGER) AS components, CAST(8 + k % 8 AS INTEGER) AS bit_depth, CAST(k % 4 AS INTEGER) AS levels_y, k % 2 = 0 AS lossless, '' AS error FROM q""")
def volume_streams(spark, d):
    """Streams written one file a nation and read back by ranges of 16 KB."""
    c, k = table(spark, d, "customer"), F.col("c_nationkey")
    name = F.concat(F.lit("n"), k.cast("string")).alias("path")
    text = F.encode(F.concat_ws("/", "c_name", "c_mktsegment"), "UTF-8").alias("data")
    tiles = c.select(name, (F.col("c_custkey") % 4096).cast("int").alias("tile"), F.col("c_custkey").alias("part"), text)
    sizes = {"width": k + 64, "height": F.lit(48), "depth": k + 32, "tile_width": F.lit(16), "tile_height": F.lit(16), "tile_depth": F.lit(8), "components": 1 + k % 3, "bit_depth": 8 + k % 8, "signed": k % 5 == 0, "levels_x": F.lit(0), "levels_y": k % 4, "levels_z": F.lit(0), "lossless": k % 2 == 0}
    at = f"{folder(spark).rstrip('/')}/volumes-{uuid.uuid4().hex}"
    volumes.write_volumes(tiles, c.select(k).distinct().select(name, *[v.alias(n) for n, v in sizes.items()]), at)
    rows = volumes.read_volumes(spark, at, range_bytes=1 << 14)
    own = [f"header.{n}" for n in ("width", "depth", "components", "bit_depth", "levels_y", "lossless")]
    return rows.select("path", "tile", "offset", "length", F.decode("data", "UTF-8").alias("text"), *own, F.coalesce("error", F.lit("")).alias("error"))


_VIEWS = "(SELECT s_suppkey AS view, s_suppkey * 7919 % 4000 - 500 AS x0, s_suppkey * 104729 % 4000 AS y0, s_suppkey * 31 % 1000 AS z0, 1 + s_suppkey * 13 % 900 AS side FROM supplier)"
_BLOCKS = "(SELECT o_orderkey AS block, o_orderkey * 6151 % 4096 - 512 AS x0, o_custkey * 3079 % 4096 AS y0, o_orderkey * 97 % 1024 AS z0, o_orderkey % 64 + CASE WHEN o_orderkey % 101 = 0 THEN 2000 ELSE 0 END AS side FROM orders)"


@query(f"""SELECT view, block, greatest(v.x0, b.x0) AS x0, least(v.x0 + v.side, b.x0 + b.side) AS x1, greatest(v.y0, b.y0) AS y0, least(v.y0 + 2 * v.side, b.y0 + b.side) AS y1, greatest(v.z0, b.z0) AS z0, least(v.z0 + 100, b.z0 + b.side) AS z1
 FROM {_VIEWS} v JOIN {_BLOCKS} b ON v.x0 < b.x0 + b.side AND b.x0 < v.x0 + v.side AND v.y0 < b.y0 + b.side AND b.y0 < v.y0 + 2 * v.side AND v.z0 < b.z0 + b.side AND b.z0 < v.z0 + 100 AND b.side > 0""")
def views_and_blocks(spark, d):
    """The blocks that each view's box meets, cut to it; every hundredth block is large, some are empty."""
    s, o, k, c = table(spark, d, "supplier"), table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    at = lambda x0, y0, z0, dx, dy, dz: [e.alias(n) for n, e in (("x0", x0), ("x1", x0 + dx), ("y0", y0), ("y1", y0 + dy), ("z0", z0), ("z1", z0 + dz))]
    v = F.col("s_suppkey")
    side, edge = 1 + v * 13 % 900, k % 64 + F.when(k % 101 == 0, 2000).otherwise(0)
    views = s.select(v.alias("view"), *at(v * 7919 % 4000 - 500, v * 104729 % 4000, v * 31 % 1000, side, 2 * side, F.lit(100)))
    blocks = o.select(k.alias("block"), *at(k * 6151 % 4096 - 512, c * 3079 % 4096, k * 97 % 1024, edge, edge, edge))
    return spatial.overlaps(views, blocks).select("left.view", "right.block", "x0", "x1", "y0", "y1", "z0", "z1")
