"""One query for each operator over the test tables, with the SQL that gives the same rows.

Stand-ins: the integer columns of lineitem as colour planes or coefficients, embeddings as 64-wide signals or bands, events as
timed samples, orders as sized items. Floats are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color, nonlinear, quantize, text
from ..operators import composition, delivery, image_quality, lifting, palette, rank, recovery, regions, spectral, stats, timeline, validation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") % 256).alias("g"), F.col("l_quantity").cast("bigint").alias("b"))


_PLANES = "(SELECT l_orderkey, l_linenumber, l_partkey % 256 AS r, l_suppkey % 256 AS g, CAST(l_quantity AS BIGINT) AS b FROM lineitem)"


def _key(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in columns.items()])


# ---- statistics -----------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS min, max(l_quantity) AS max, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY 1""")
def component_stats(spark, d):
    return stats.component_statistics(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity")).withColumns({"mean": r6("mean"), "std": r6("std")})


@query(f"""SELECT l_orderkey, l_linenumber, r % 4 AS grp, CAST(round(avg(b) OVER (PARTITION BY r % 4)) AS BIGINT) AS "offset", b - CAST(round(avg(b) OVER (PARTITION BY r % 4)) AS BIGINT) AS centred FROM {_PLANES}""")
def dc_offset_mean(spark, d):
    rows = stats.remove_offset(planes(spark, d).withColumn("grp", F.col("r") % 4), ["grp"], "b")
    return rows.select("l_orderkey", "l_linenumber", "grp", "offset", "centred")


@query(f"""SELECT l_orderkey, l_linenumber, r % 4 AS grp, CAST(floor((min(b) OVER w + max(b) OVER w) / 2) AS BIGINT) AS "offset", b - CAST(floor((min(b) OVER w + max(b) OVER w) / 2) AS BIGINT) AS centred FROM {_PLANES} WINDOW w AS (PARTITION BY r % 4)""")
def dc_offset_midrange(spark, d):
    rows = stats.remove_offset(planes(spark, d).withColumn("grp", F.col("r") % 4), ["grp"], "b", "midrange")
    return rows.select("l_orderkey", "l_linenumber", "grp", "offset", "centred")


@query("""SELECT i, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n FROM (SELECT unnest(range(1, 65)) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY i""")
def band_statistics(spark, d):
    rows = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "v")).withColumn("i", F.col("i").cast("bigint"))
    out = stats.component_statistics(rows, ["i"], F.col("v"))
    return out.select("i", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")], "n")


_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round({'CAST(min(1) AS DOUBLE)' if i == j else f'covar_pop({a}, {b}) / (greatest(stddev_pop({a}), 1e-12) * greatest(stddev_pop({b}), 1e-12))'}, 6) AS r FROM lineitem" for i, a in enumerate(_NUMS) for j, b in enumerate(_NUMS)))
def correlation_matrix(spark, d):
    return stats.correlation_matrix(table(spark, d, "lineitem"), _NUMS).withColumn("r", r6("r"))


@query("""WITH s AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), q AS (SELECT label, v, CASE WHEN floor(abs(v) / 0.05) = 0 THEN 0 ELSE (CASE WHEN v >= 0 THEN 1 ELSE -1 END) * (floor(abs(v) / 0.05) + 0.5) * 0.05 END AS w FROM s),
m AS (SELECT label, avg((v - w) * (v - w)) AS mse, max(abs(v - w)) AS e, bool_and(abs(v - w) <= 0.04) AS t FROM q GROUP BY label)
SELECT label, round(mse, 6) AS mse, round(10 * log10(1.0 / mse), 6) AS psnr, round(e, 6) AS max_error, t AS within_tolerance FROM m""")
def error_metrics(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    step = F.lit(0.05)
    rows = rows.withColumn("w", quantize.dequantize_midpoint(quantize.scalar(F.col("v"), step), step))
    out = stats.error_metrics(rows, ["label"], F.col("v"), F.col("w"), 1.0, 0.04)
    return out.select("label", r6("mse").alias("mse"), r6("psnr").alias("psnr"), r6("max_error").alias("max_error"), "within_tolerance")


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS avg, round(median(value), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, round(coalesce(stddev_samp(value), 0), 6) AS std, round(1 / avg(value), 6) AS per_second FROM events GROUP BY 1""")
def run_statistics(spark, d):
    out = stats.run_statistics(table(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", "n", *[r6(c).alias(c) for c in ("avg", "median", "min", "max", "std", "per_second")])


@query("""WITH h AS (SELECT user_id, event_type, avg(value) FILTER (WHERE event_id % 2 = 1) AS cur, avg(value) FILTER (WHERE event_id % 2 = 0) AS base FROM events GROUP BY 1, 2)
SELECT user_id, event_type, round(cur, 6) AS "current", round(base, 6) AS baseline, round((cur - base) / base, 6) AS change FROM h WHERE cur IS NOT NULL AND base IS NOT NULL AND base <> 0 AND (cur - base) / base > 0.05""")
def regressions(spark, d):
    e = table(spark, d, "events")
    half = lambda k: e.filter(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    out = stats.regressions(half(1), half(0), ["user_id", "event_type"], "v")
    return out.select("user_id", "event_type", r6("current").alias("current"), r6("baseline").alias("baseline"), r6("change").alias("change"))


@query("""WITH t AS (SELECT event_type, sum(value) AS total FROM events GROUP BY 1) SELECT event_type, round(total, 4) AS total, round(total / sum(total) OVER (), 6) AS share, event_type = (SELECT event_type FROM t ORDER BY total DESC, event_type LIMIT 1) AS bottleneck FROM t""")
def stage_profile(spark, d):
    out = stats.profile(table(spark, d, "events"), "event_type", "value")
    return out.select("event_type", F.round("total", 4).alias("total"), r6("share").alias("share"), "bottleneck")


@query("""SELECT image, level, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT image) AS images FROM (SELECT user_id AS image, event_type AS level, length(props) AS size FROM events) GROUP BY GROUPING SETS ((image), (level), ())""")
def cache_usage_report(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("image"), F.col("event_type").alias("level"), F.length("props").alias("size"))
    return stats.usage_report(e, "image", "level", "size")


# ---- colour, quantisers, curves -------------------------------------------------------------------------------------


@query(f"SELECT l_orderkey, l_linenumber, (r + 2 * g + b) >> 2 AS y, b - g AS cb, r - g AS cr FROM {_PLANES}")
def rct_forward(spark, d):
    y, cb, cr = color.rct_forward(F.col("r"), F.col("g"), F.col("b"))
    return _key(planes(spark, d), y=y, cb=cb, cr=cr)


@query(f"SELECT l_orderkey, l_linenumber, r, g, b FROM {_PLANES}")
def rct_round_trip(spark, d):
    y, cb, cr = color.rct_forward(F.col("r"), F.col("g"), F.col("b"))
    r, g, b = color.rct_inverse(F.col("y"), F.col("cb"), F.col("cr"))
    return _key(_key(planes(spark, d), y=y, cb=cb, cr=cr), r=r, g=g, b=b)


@query(f"SELECT l_orderkey, l_linenumber, round(0.299 * r + 0.587 * g + 0.114 * b, 6)::DOUBLE AS y, round(-0.168736 * r - 0.331264 * g + 0.5 * b, 6)::DOUBLE AS cb, round(0.5 * r - 0.418688 * g - 0.081312 * b, 6)::DOUBLE AS cr FROM {_PLANES}")
def ict_forward(spark, d):
    y, cb, cr = color.ict_forward(F.col("r"), F.col("g"), F.col("b"))
    return _key(planes(spark, d), y=r6(y), cb=r6(cb), cr=r6(cr))


@query(f"SELECT l_orderkey, l_linenumber, round(r + 1.402 * (b - 128), 6)::DOUBLE AS r, round(r - 0.344136 * (g - 128) - 0.714136 * (b - 128), 6)::DOUBLE AS g, round(r + 1.772 * (g - 128), 6)::DOUBLE AS b FROM {_PLANES}")
def ict_inverse(spark, d):
    r, g, b = color.ict_inverse(F.col("r"), F.col("g") - 128, F.col("b") - 128)
    return _key(planes(spark, d), r=r6(r), g=r6(g), b=r6(b))


@query(f"SELECT l_orderkey, l_linenumber, (306 * r + 601 * g + 117 * b + 512) >> 10 AS grey FROM {_PLANES}")
def grayscale(spark, d):
    return _key(planes(spark, d), grey=color.grayscale(F.col("r"), F.col("g"), F.col("b")))


_M = ((0.5, 0.25, 0.25), (1.0, -1.0, 0.0), (0.0, 0.5, -0.5))


@query(f"SELECT l_orderkey, l_linenumber, round(CAST(0.5 AS DOUBLE) * r + 0.25 * g + 0.25 * b, 6) AS o0, CAST(r - g AS DOUBLE) AS o1, round(CAST(0.5 AS DOUBLE) * g - 0.5 * b, 6) AS o2, CAST(round(CAST(0.5 AS DOUBLE) * r + 0.25 * g + 0.25 * b) AS BIGINT) AS i0 FROM {_PLANES}")
def component_matrix(spark, d):
    c = [F.col("r"), F.col("g"), F.col("b")]
    o = color.matrix_transform(c, _M)
    return _key(planes(spark, d), o0=r6(o[0]), o1=r6(o[1]), o2=r6(o[2]), i0=color.matrix_transform_integer(c, _M)[0])


@query(f"SELECT l_orderkey, l_linenumber, CAST(r AS DOUBLE) AS o0, g - CAST(0.5 AS DOUBLE) * r AS o1, b - CAST(0.25 AS DOUBLE) * (g - CAST(0.5 AS DOUBLE) * r) AS o2 FROM {_PLANES}")
def component_dependencies(spark, d):
    o = color.dependency_transform([F.col(c).cast("double") for c in "rgb"], [(1, {0: 0.5}), (2, {1: 0.25})])
    return _key(planes(spark, d), o0=o[0], o1=o[1], o2=o[2])


@query("""SELECT l_orderkey, l_linenumber, CAST((CASE WHEN c >= 0 THEN 1 ELSE -1 END) * floor(abs(c) / 7.5) AS BIGINT) AS q, CAST(CASE WHEN abs(c) <= 3.75 THEN 0 ELSE (CASE WHEN c >= 0 THEN 1 ELSE -1 END) * (floor((abs(c) - 3.75) / 7.5) + 1) END AS BIGINT) AS dz,
 CAST(CASE WHEN abs(c) < 5.625 THEN 0 ELSE (CASE WHEN c >= 0 THEN 1 ELSE -1 END) * floor((abs(c) - 5.625) / 7.5) END AS BIGINT) AS sl FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity - 25 AS DOUBLE) * 3 AS c FROM lineitem)""")
def quantize_modes(spark, d):
    c, step = (F.col("l_quantity") - 25) * 3, F.lit(7.5)
    return _key(table(spark, d, "lineitem"), q=quantize.scalar(c, step), dz=quantize.deadzone(c, step), sl=quantize.slice_quantize(c, step))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN q = 0 THEN 0.0 ELSE (q + 0.5 * sign(q)) * 7.5 END::DOUBLE AS mid, CASE WHEN q = 0 THEN 0.0 ELSE sign(q) * (abs(q) + 0.5) * 7.5 END::DOUBLE AS sl, CAST(q * 7.5 AS DOUBLE) AS plain FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) - 25 AS q FROM lineitem)""")
def dequantize_modes(spark, d):
    q, step = F.col("l_quantity").cast("bigint") - 25, F.lit(7.5)
    return _key(table(spark, d, "lineitem"), mid=quantize.dequantize_midpoint(q, step), sl=quantize.slice_dequantize(q, step), plain=quantize.dequantize_plain(q, step))


@query("""SELECT o_orderkey, CAST(greatest(0, least(31, floor(log2(s)) + 16)) AS BIGINT) AS exponent, CAST(greatest(0, least(2047, floor((s / pow(2, floor(log2(s))) - 1) * 2048))) AS BIGINT) AS mantissa,
 round(pow(2, greatest(0, least(31, floor(log2(s)) + 16)) - 16) * (1 + greatest(0, least(2047, floor((s / pow(2, floor(log2(s))) - 1) * 2048))) / 2048), 6) AS decoded FROM (SELECT o_orderkey, o_totalprice / 1000 AS s FROM orders WHERE o_totalprice > 0)""")
def step_codes(spark, d):
    rows = table(spark, d, "orders").filter("o_totalprice > 0")
    e, m = quantize.encode_step(F.col("o_totalprice") / 1000)
    return rows.select("o_orderkey", e.alias("exponent"), m.alias("mantissa")).withColumn("decoded", r6(quantize.decode_step(F.col("exponent"), F.col("mantissa"))))


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN g > 128 THEN r * 16 ELSE r END AS up, CASE WHEN abs(CASE WHEN g > 128 THEN r * 16 ELSE r END) >= 16 THEN (CASE WHEN g > 128 THEN r * 16 ELSE r END) >> 4 ELSE (CASE WHEN g > 128 THEN r * 16 ELSE r END) END AS down, greatest(-128, least(127, r)) AS clamped FROM {_PLANES}""")
def roi_shift(spark, d):
    up = quantize.shift_up(F.col("r"), F.col("g") > 128, 4)
    return _key(planes(spark, d), up=up, down=quantize.shift_down(up, 4), clamped=quantize.clamp(F.col("r"), 8))


def _curve_sql(x: str) -> str:
    return f"CAST(round(greatest(0.0, least(255.0, ({x}) * 255))) AS BIGINT)"


@query(f"""SELECT l_orderkey, l_linenumber, {_curve_sql('pow(n, 2.2)')} AS gamma, {_curve_sql('pow(n, 1 / 2.2)')} AS ungamma, {_curve_sql('log2(n + 1)')} AS log, {_curve_sql('(exp(n) - 1) / (exp(1) - 1)')} AS exp,
 {_curve_sql('pow(greatest(pow(n, 1 / 78.84375) - 0.8359375, 0) / (18.8515625 - 18.6875 * pow(n, 1 / 78.84375)), 1 / 0.1593017578125)')} AS pq, {_curve_sql('pow((0.8359375 + 18.8515625 * pow(n, 0.1593017578125)) / (1 + 18.6875 * pow(n, 0.1593017578125)), 78.84375)')} AS unpq,
 {_curve_sql('CASE WHEN n <= 0.5 THEN n * n / 3 ELSE (exp((n - 0.55991073) / 0.17883277) + 0.28466892) / 12 END')} AS hlg, {_curve_sql('CASE WHEN n <= 1.0 / 12 THEN sqrt(3 * n) ELSE 0.17883277 * ln(greatest(12 * n - 0.28466892, 1e-300)) + 0.55991073 END')} AS unhlg
 FROM (SELECT l_orderkey, l_linenumber, CAST(r AS DOUBLE) / 255 AS n FROM {_PLANES})""")
def point_curves(spark, d):
    f = lambda kind, p=None, inverse=False: nonlinear.apply(F.col("r"), kind, 8, p, inverse=inverse)
    return _key(planes(spark, d), gamma=f("gamma", 2.2), ungamma=f("gamma", 2.2, True), log=f("log"), exp=f("exp"), pq=f("pq"), unpq=f("pq", None, True), hlg=f("hlg"), unhlg=f("hlg", None, True))


# ---- bands, palettes ------------------------------------------------------------------------------------------------


@query(f"SELECT l_orderkey, l_linenumber, round(CASE WHEN r + g = 0 THEN 0 ELSE (g - r) / CAST(r + g AS DOUBLE) END, 6) AS nd FROM {_PLANES}")
def normalized_difference(spark, d):
    return _key(planes(spark, d), nd=r6(spectral.normalized_difference(F.col("r"), F.col("g"))))


@query("""SELECT vec_id, CASE WHEN m > 0.85 THEN 'cloud' WHEN m < 0.08 THEN 'water' WHEN m > 0.35 THEN 'vegetation' WHEN m > 0.25 THEN 'urban' WHEN m > 0.15 THEN 'bare_soil' ELSE 'unclassified' END AS cover FROM (SELECT vec_id, list_avg(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS m FROM embeddings)""")
def land_cover(spark, d):
    m = spectral.array_mean(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    return table(spark, d, "embeddings").select("vec_id", spectral.classify(m).alias("cover"))


_PALETTE = "(SELECT row_number() OVER (ORDER BY n DESC, r, g, b) - 1 AS idx, r, g, b FROM (SELECT p_size AS r, CAST(floor(p_retailprice / 100) AS BIGINT) AS g, p_partkey % 5 AS b, count(*) AS n FROM part GROUP BY 1, 2, 3) ORDER BY n DESC, r, g, b LIMIT 64)"


def _colours(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_size").alias("r"), F.floor(F.col("p_retailprice") / 100).alias("g"), (F.col("p_partkey") % 5).alias("b"))


@query(f"SELECT idx, r, g, b FROM {_PALETTE}")
def palette_top(spark, d):
    return palette.create_palette(_colours(spark, d), "r", "g", "b", 64)


@query(f"""WITH pal AS {_PALETTE}, c AS (SELECT p_partkey, p_size AS r, CAST(floor(p_retailprice / 100) AS BIGINT) AS g, p_partkey % 5 AS b FROM part)
SELECT p_partkey, (SELECT arg_min(idx, ((pal.r - c.r) * (pal.r - c.r) + (pal.g - c.g) * (pal.g - c.g) + (pal.b - c.b) * (pal.b - c.b)) * 1000 + idx) FROM pal) AS idx FROM c""")
def palette_assign(spark, d):
    c = _colours(spark, d)
    return palette.assign(c, palette.create_palette(c, "r", "g", "b", 64), "r", "g", "b").select("p_partkey", "idx")


@query(f"WITH pal AS {_PALETTE} SELECT l_orderkey, l_linenumber, r, g, b FROM lineitem JOIN pal ON l_partkey % 64 = idx")
def palette_expand(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 64).alias("i"))
    return palette.expand(rows, palette.create_palette(_colours(spark, d), "r", "g", "b", 64), "i").select("l_orderkey", "l_linenumber", "r", "g", "b")


# ---- boxes, masks ---------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT o_orderkey, o_custkey % 130 - 10 AS x0, o_custkey % 130 + o_orderkey % 40 - 10 AS x1, o_orderkey % 90 - 10 AS y0, o_orderkey % 90 + 5 AS y1, 32 + o_orderkey % 3 AS s FROM orders),
t AS (SELECT o_orderkey, i AS tx, j AS ty, i * s AS tx0, least(100, (i + 1) * s) AS tx1, j * 32 AS ty0, least(70, (j + 1) * 32) AS ty1, x0, x1, y0, y1 FROM b, range(0, 4) AS u(i), range(0, 3) AS w(j) WHERE i * s < 100)
SELECT o_orderkey, tx, ty, tx0 AS x0, tx1 AS x1, ty0 AS y0, ty1 AS y1 FROM t WHERE x1 > x0 AND tx1 > x0 AND tx0 < x1 AND ty1 > y0 AND ty0 < y1""")
def tiles_of_region(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lows, highs = [c % 130 - 10, k % 90 - 10], [c % 130 + k % 40 - 10, k % 90 + 5]
    rows = regions.tiles_meeting(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [F.lit(100), F.lit(70)], [32 + k % 3, F.lit(32)], lows, highs)
    return rows.drop("o_custkey")


@query("""SELECT event_id, CAST(greatest(1, (h + 7) // 8) AS BIGINT) AS tiles, greatest(0, least(h + 4, 12) - greatest(h, 6)) AS shared, h >= 6 AND h < 12 AS inside FROM (SELECT event_id, CAST(extract(hour FROM ts) AS BIGINT) AS h FROM events)""")
def box_overlap(spark, d):
    e = table(spark, d, "events").select("event_id", F.hour("ts").cast("bigint").alias("h"))
    lit = lambda x: F.lit(x).cast("bigint")
    return e.select("event_id", regions.tile_grid(F.col("h"), F.lit(8)).alias("tiles"), regions.overlap(F.col("h"), F.col("h") + 4, lit(6), lit(12)).cast("bigint").alias("shared"), regions.contains(F.col("h"), lit(6), lit(12)).alias("inside"))


@query("""WITH a AS (SELECT event_id AS a_id, epoch_us(ts) // 1000000 AS a0, epoch_us(ts) // 1000000 + 60 AS a1 FROM events WHERE event_type = 'click'), b AS (SELECT event_id AS b_id, epoch_us(ts) // 1000000 AS b0, epoch_us(ts) // 1000000 + 300 AS b1 FROM events WHERE event_type = 'purchase')
SELECT a_id, b_id FROM a JOIN b ON a0 < b1 AND a1 > b0""")
def interval_overlap_join(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    a = e.filter("event_type = 'click'").select(F.col("event_id").alias("a_id"), F.col("t").alias("a0"), (F.col("t") + 60).alias("a1"))
    b = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("b_id"), F.col("t").alias("b0"), (F.col("t") + 300).alias("b1"))
    return regions.interval_join(a, b, 300).select("a_id", "b_id")


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, r >= 20 AND r < 120 AND g >= 30 AND g < 130 AS rect, ((r - 100) / 60.0) * ((r - 100) / 60.0) + ((g - 100) / 40.0) * ((g - 100) / 40.0) <= 1 AS ell,
 r >= 10 AND r < 110 AND g < r AND g >= 10 AND NOT (g >= 110) AS tri FROM {_PLANES})
SELECT l_orderkey, l_linenumber, rect, ell, greatest(0, CASE WHEN rect THEN 1 ELSE 0 END, CASE WHEN ell THEN 2 ELSE 0 END)::BIGINT AS priority, rect OR ell AS any_mask FROM m""")
def region_masks(spark, d):
    x, y = F.col("r"), F.col("g")
    rect, ell = regions.rectangle(x, y, 20, 30, 100, 100), regions.ellipse(x, y, 100, 100, 60, 40)
    return _key(planes(spark, d), rect=rect, ell=ell, priority=regions.priority_mask([(rect, 1), (ell, 2)]).cast("bigint"), any_mask=rect | ell)


# ---- timelines and streams in batch ---------------------------------------------------------------------------------

_FRAMES = "(SELECT event_id AS idx, user_id AS track, length(props) AS size, 40 + event_id % 7 AS duration FROM events)"


def frames(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("idx"), F.col("user_id").alias("track"), F.length("props").cast("bigint").alias("size"), (40 + F.col("event_id") % 7).alias("duration"))


_TIMED = f"(SELECT idx, track, size, duration, coalesce(sum(size) OVER w, 0)::BIGINT AS pos, coalesce(sum(duration) OVER w, 0)::BIGINT AS ts FROM {_FRAMES} WINDOW w AS (PARTITION BY track ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


def timed(spark, d) -> DataFrame:
    return frames(spark, d).withColumns({"pos": timeline.running_before(F.col("size"), ["track"], ["idx"]), "ts": timeline.running_before(F.col("duration"), ["track"], ["idx"])})


@query(f"SELECT idx, track, pos, ts FROM {_TIMED}")
def frame_timeline(spark, d):
    return timed(spark, d).select("idx", "track", "pos", "ts")


@query(f"SELECT idx, track FROM {_TIMED} WHERE ts < 500 AND ts + duration > 200")
def frames_in_range(spark, d):
    return timed(spark, d).filter(timeline.overlapping(F.col("ts"), F.col("duration"), 200, 500)).select("idx", "track")


@query(f"SELECT idx, track FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY idx) - 1 AS k FROM {_FRAMES}) WHERE k % 5 = 0")
def every_nth_frame(spark, d):
    k = F.row_number().over(Window.partitionBy("track").orderBy("idx")) - 1
    return frames(spark, d).withColumn("k", k).filter("k % 5 = 0").select("idx", "track")


@query(f"SELECT track, arg_min(idx, abs(ts - 333) * 100000000 + idx) AS idx FROM {_TIMED} GROUP BY track")
def seek_nearest(spark, d):
    return timeline.nearest(timed(spark, d), ["track"], F.col("ts"), F.lit(333), "idx")


@query("""WITH r AS (SELECT user_id, ts, max(event_id) AS last_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT l.event_id, l.user_id, (SELECT last_id FROM r WHERE r.user_id = l.user_id AND r.ts <= l.ts ORDER BY r.ts DESC LIMIT 1) AS last_id FROM events l WHERE l.event_type = 'click'""")
def as_of_join(spark, d):
    e = table(spark, d, "events")
    right = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_id"))
    left = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return timeline.as_of(left, right, ["user_id"], "ts", "last_id").select("event_id", "user_id", "last_id")


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT user_id, k, n, 0.3 * value + 0.7 * 100.0::DOUBLE AS e FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.n, 0.3 * o.value + 0.7 * f.e FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, n, round(e, 4) AS estimate FROM f WHERE k = n""")
def bandwidth_average(spark, d):
    out = timeline.exponential_average(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 0.7, 100.0)
    return out.select("user_id", "n", F.round("estimate", 4).alias("estimate"))


@query("""SELECT event_id, round(CASE WHEN count(value) OVER w < 2 THEN 0 ELSE greatest(-1, least(1, coalesce((value - first_value(value) OVER w) / nullif(first_value(value) OVER w, 0), 0))) END, 6) AS trend,
 round(CASE WHEN count(value) OVER w < 3 THEN (count(value) OVER w) / 3.0::DOUBLE ELSE greatest(0, least(1, 1 - coalesce(stddev_pop(value) OVER w / nullif(avg(value) OVER w, 0), 0.5))) END, 6) AS confidence,
 coalesce(value / nullif(min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) > 1.5, false) AS congested
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def bandwidth_state(spark, d):
    k, o = ["user_id"], ["ts", "event_id"]
    return table(spark, d, "events").select("event_id", r6(timeline.trend("value", k, o)).alias("trend"), r6(timeline.confidence("value", k, o)).alias("confidence"), timeline.congested("value", k, o).alias("congested"))


@query("""SELECT event_id, user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 21600000000 THEN 1 ELSE 0 END AS new FROM events)""")
def gap_sessions(spark, d):
    return timeline.sessions(table(spark, d, "events"), ["user_id"], "ts", 21600).select("event_id", "user_id", "session")


# ---- ranking and delivery -------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE run <= 500000 AND k <= 4""")
def delivery_batch(spark, d):
    o = [F.col("o_orderdate"), F.col("o_orderkey")]
    return rank.within_budget(table(spark, d, "orders"), ["o_custkey"], o, "o_totalprice", 500000, 4).select("o_orderkey", "o_custkey")


@query("""SELECT user_id, event_id, k AS position FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 3""")
def push_queue_top(spark, d):
    return rank.top(table(spark, d, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id", F.col("position").cast("bigint").alias("position"))


_ORDERS = ("LRCPS", "RLCPS", "RPCLS", "PCRLS", "CPRLS")


@query("""WITH h AS (SELECT c_custkey, c_custkey % 5 AS o, 1 + c_custkey % 3 AS ls, 1 + c_nationkey % 3 AS rs, 1 + c_custkey % 2 AS cs FROM customer),
t AS (SELECT * FROM h, range(0, 3) AS a(l), range(0, 3) AS b(r), range(0, 2) AS e(c), range(0, 4) AS g(p) WHERE l < ls AND r < rs AND c < cs AND p < CASE r WHEN 1 THEN 4 ELSE 1 END)
SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE o WHEN 0 THEN l WHEN 1 THEN r WHEN 2 THEN r WHEN 3 THEN p ELSE c END, CASE o WHEN 0 THEN r WHEN 1 THEN l WHEN 2 THEN p WHEN 3 THEN c ELSE p END,
  CASE o WHEN 0 THEN c WHEN 1 THEN c WHEN 2 THEN c WHEN 3 THEN r ELSE r END, CASE o WHEN 0 THEN p WHEN 1 THEN p ELSE l END) - 1 AS position, l AS layer, r AS resolution, c AS component, p AS precinct, 0::BIGINT AS slice FROM t""")
def packet_order(spark, d):
    """Every image in an order of its own."""
    k = F.col("c_custkey")
    order = F.get(F.array(*map(F.lit, _ORDERS)), (k % 5).cast("int"))
    return rank.packets(table(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_custkey"], order, 1 + k % 3, 1 + F.col("c_nationkey") % 3, 1 + k % 2, F.array(F.lit(1), F.lit(4)))


@query("""WITH z AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS z, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(2 * (z - n // 2)) + (CASE WHEN z > n // 2 THEN -1 ELSE 0 END)) - 1 AS position FROM z""")
def slice_order(spark, d):
    """Suppliers as the slices of their nation's volume, from the centre."""
    w = Window.partitionBy("s_nationkey")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.row_number().over(w.orderBy("s_suppkey")) - 1).alias("z"), F.count(F.lit(1)).over(w).alias("n"))
    at = F.row_number().over(w.orderBy(rank.slice_order(F.col("z"), 0, F.col("n"), "centre"))) - 1
    return rows.select("s_suppkey", "s_nationkey", at.cast("bigint").alias("position"))


@query("""SELECT user_id, event_type, count(*) AS n FROM events e WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id % 2 = 1 AND s.user_id = e.user_id AND s.event_type = e.event_type) GROUP BY 1, 2""")
def delta_delivery(spark, d):
    e = table(spark, d, "events")
    sent = e.filter("event_id % 2 = 1").select("user_id", "event_type").distinct()
    return e.filter("event_id % 2 = 0").join(sent, ["user_id", "event_type"], "left_anti").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, count(*) AS hits FROM events e WHERE event_id % 2 = 0 AND EXISTS (SELECT 1 FROM events s WHERE s.event_id % 2 = 1 AND s.user_id = e.user_id AND s.event_type = e.event_type) GROUP BY 1""")
def cache_hits(spark, d):
    e = table(spark, d, "events")
    sent = e.filter("event_id % 2 = 1").select("user_id", "event_type").distinct()
    return e.filter("event_id % 2 = 0").join(sent, ["user_id", "event_type"], "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"))


@query("""SELECT user_id, list_sort(list_distinct(list(event_type)))::VARCHAR AS layers, count(*) AS n, bool_or(event_type = 'purchase') AS complete FROM events GROUP BY user_id""")
def merge_layers(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("l"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("event_type") == "purchase").alias("complete"))
    return rows.select("user_id", F.concat(F.lit("["), F.array_join("l", ", "), F.lit("]")).alias("layers"), "n", "complete")


# ---- transforms -----------------------------------------------------------------------------------------------------

_SIGNAL = "(SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS s FROM embeddings)"


def signals(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000)).alias("s"), F.transform("embedding", lambda x: x.cast("double")).alias("f"))


@query(f"""WITH h AS (SELECT vec_id, s, list_transform(range(0, 32), lambda i: s[2 * i + 2] - ((s[2 * i + 1] + s[least(2 * i + 3, 63)]) >> 1)) AS high FROM {_SIGNAL}),
l AS (SELECT vec_id, high, list_transform(range(0, 32), lambda i: s[2 * i + 1] + ((high[greatest(i, 1)] + high[i + 1] + 2) >> 2)) AS low FROM h)
SELECT vec_id, i - 1 AS i, low[i] AS low, high[i] AS high FROM l, (SELECT unnest(range(1, 33)) AS i)""")
def lifting_53(spark, d):
    rows = signals(spark, d).select("vec_id", lifting.forward53(F.col("s")).alias("b"))
    return rows.select("vec_id", F.posexplode(F.arrays_zip(F.col("b.low").alias("l"), F.col("b.high").alias("h"))).alias("i", "c")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.col("c.l").alias("low"), F.col("c.h").alias("high"))


@query(f"SELECT vec_id, i - 1 AS i, s[i] AS v FROM {_SIGNAL}, (SELECT unnest(range(1, 65)) AS i)")
def lifting_53_round_trip(spark, d):
    rows = signals(spark, d).select("vec_id", lifting.forward53(F.col("s")).alias("b")).select("vec_id", lifting.inverse53(F.col("b.low"), F.col("b.high")).alias("s"))
    return rows.select("vec_id", F.posexplode("s").alias("i", "v")).withColumn("i", F.col("i").cast("bigint"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings),
a AS (SELECT vec_id, list_transform(range(0, 32), lambda i: s[2 * i + 1]) AS e, list_transform(range(0, 32), lambda i: s[2 * i + 2]) AS o FROM s),
b AS (SELECT vec_id, e, list_transform(range(0, 32), lambda i: o[i + 1] + -1.586134342::DOUBLE * (e[i + 1] + e[least(i + 2, 32)])) AS o FROM a),
c AS (SELECT vec_id, o, list_transform(range(0, 32), lambda i: e[i + 1] + -0.05298011854::DOUBLE * (o[greatest(i, 1)] + o[i + 1])) AS e FROM b),
f AS (SELECT vec_id, e, list_transform(range(0, 32), lambda i: o[i + 1] + 0.8829110762::DOUBLE * (e[i + 1] + e[least(i + 2, 32)])) AS o FROM c),
g AS (SELECT vec_id, o, list_transform(range(0, 32), lambda i: e[i + 1] + 0.4435068522::DOUBLE * (o[greatest(i, 1)] + o[i + 1])) AS e FROM f)
SELECT vec_id, i - 1 AS i, round(e[i] * 1.149604398::DOUBLE, 6) AS low, round(o[i] / 1.149604398::DOUBLE, 6) AS high FROM g, (SELECT unnest(range(1, 33)) AS i)""")
def lifting_97(spark, d):
    rows = signals(spark, d).select("vec_id", lifting.forward97(F.col("f")).alias("b"))
    return rows.select("vec_id", F.posexplode(F.arrays_zip(F.col("b.low").alias("l"), F.col("b.high").alias("h"))).alias("i", "c")).select("vec_id", F.col("i").cast("bigint").alias("i"), r6("c.l").alias("low"), r6("c.h").alias("high"))


@query(f"""WITH s AS (SELECT vec_id, s FROM {_SIGNAL}), g AS (SELECT vec_id, list_transform(range(0, 8), lambda y: s[8 * y + 1:8 * y + 8]) AS m FROM s),
rh AS (SELECT vec_id, m, list_transform(m, lambda r: list_transform(range(0, 4), lambda i: r[2 * i + 2] - ((r[2 * i + 1] + r[least(2 * i + 3, 7)]) >> 1))) AS h FROM g),
rl AS (SELECT vec_id, list_transform(range(1, 9), lambda k: list_transform(range(0, 4), lambda i: m[k][2 * i + 1] + ((h[k][greatest(i, 1)] + h[k][i + 1] + 2) >> 2))) AS l FROM rh),
ch AS (SELECT vec_id, l, list_transform(range(1, 5), lambda x: list_transform(range(0, 4), lambda i: l[2 * i + 2][x] - ((l[2 * i + 1][x] + l[least(2 * i + 3, 7)][x]) >> 1))) AS h FROM rl)
SELECT vec_id, y, x, l[2 * y + 1][x + 1] + ((h[x + 1][greatest(y, 1)] + h[x + 1][y + 1] + 2) >> 2) AS ll FROM ch, (SELECT unnest(range(0, 4)) AS y), (SELECT unnest(range(0, 4)) AS x)""")
def transform_2d(spark, d):
    image = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("s", y * 8 + 1, F.lit(8)))
    rows = signals(spark, d).select("vec_id", image.alias("m")).select("vec_id", lifting.forward_2d(F.col("m"))["ll"].alias("ll"))
    rows = rows.select("vec_id", F.posexplode("ll").alias("y", "r")).select("vec_id", F.col("y").cast("bigint").alias("y"), F.posexplode("r").alias("x", "ll"))
    return rows.withColumn("x", F.col("x").cast("bigint"))


@query(f"SELECT vec_id, i - 1 AS i, s[i] AS v FROM {_SIGNAL}, (SELECT unnest(range(1, 65)) AS i)")
def transform_2d_round_trip(spark, d):
    image = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("s", y * 8 + 1, F.lit(8)))
    rows = signals(spark, d).select("vec_id", image.alias("m")).select("vec_id", lifting.forward_2d(F.col("m")).alias("b")).select("vec_id", F.flatten(lifting.inverse_2d(F.col("b"))).alias("s"))
    return rows.select("vec_id", F.posexplode("s").alias("i", "v")).withColumn("i", F.col("i").cast("bigint"))


_GRID = """(SELECT y, x, coalesce(a, 0) AS a, coalesce(floor(a / 8) * 8 + 4, 4) AS b FROM (SELECT unnest(range(0, 32)) AS y) CROSS JOIN (SELECT unnest(range(0, 32)) AS x) LEFT JOIN (SELECT l_partkey % 32 AS y, l_suppkey % 32 AS x, max(l_quantity) AS a FROM lineitem GROUP BY 1, 2) USING (y, x))"""


def grid(spark, d) -> DataFrame:
    cells = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 32).alias("y"), (F.col("l_suppkey") % 32).alias("x")).agg(F.max("l_quantity").alias("a"))
    full = spark.range(32).withColumnRenamed("id", "y").crossJoin(spark.range(32).withColumnRenamed("id", "x"))
    rows = full.join(cells, ["y", "x"], "left")
    return rows.select(F.lit(0).alias("c"), "y", "x", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce(F.floor(F.col("a") / 8) * 8 + 4, F.lit(4)).cast("double").alias("b"))


@query(f"""WITH w AS (SELECT wy, wx, avg(a) AS ma, avg(b) AS mb, avg(a * a) AS aa, avg(b * b) AS bb, avg(a * b) AS ab FROM {_GRID}, (SELECT unnest(range(0, 24, 4)) AS wy), (SELECT unnest(range(0, 24, 4)) AS wx) WHERE y >= wy AND y < wy + 8 AND x >= wx AND x < wx + 8 GROUP BY 1, 2)
SELECT 0 AS c, round(avg(((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (greatest(0, aa - ma * ma) + greatest(0, bb - mb * mb) + 58.5225))), 6) AS ssim FROM w""")
def ssim(spark, d):
    return image_quality.ssim(grid(spark, d), ["c"], 32, 32, 255.0).withColumn("ssim", r6("ssim"))


@query(f"""WITH g AS {_GRID}, p AS (SELECT g.y, g.x, sum(n.a * (n.x - g.x) * (2 - abs(n.y - g.y))) AS gx, sum(n.a * (n.y - g.y) * (2 - abs(n.x - g.x))) AS gy FROM g JOIN g n ON abs(n.y - g.y) <= 1 AND abs(n.x - g.x) <= 1 WHERE g.y BETWEEN 1 AND 30 AND g.x BETWEEN 1 AND 30 GROUP BY 1, 2)
SELECT 0 AS c, round(least(1, avg(sqrt(gx * gx + gy * gy)) / 500), 6) AS edge_density FROM p""")
def edge_density(spark, d):
    return image_quality.edge_density(grid(spark, d), ["c"], "a").withColumn("edge_density", r6("edge_density"))


@query(f"""WITH q AS (SELECT y // 2 AS y, x // 2 AS x, sum(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN a ELSE 0 END) AS a, sum(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN a ELSE 0 END) AS b, sum(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN a ELSE 0 END) AS c, sum(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN a ELSE 0 END) AS d FROM {_GRID} GROUP BY 1, 2),
e AS (SELECT sum(pow((a + b + c + d) / 4, 2)) AS low, sum(pow((a + b - c - d) / 4, 2) + pow((a - b + c - d) / 4, 2) + pow((a - b - c + d) / 4, 2)) AS high FROM q) SELECT 0 AS c, round(high / (low + high), 6) AS frequency_content FROM e""")
def frequency_content(spark, d):
    return image_quality.frequency_content(grid(spark, d), ["c"], "a").withColumn("frequency_content", r6("frequency_content"))


# ---- text -----------------------------------------------------------------------------------------------------------


@query("""SELECT vec_id, i - 1 AS i, round((CAST(embedding[i] AS DOUBLE) - lo) / (hi - lo), 6) AS v FROM (SELECT vec_id, embedding, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi FROM embeddings), (SELECT unnest(range(1, 65)) AS i)""")
def array_normalized(spark, d):
    rows = signals(spark, d).select("vec_id", F.posexplode(text.normalized(F.col("f"))).alias("i", "v"))
    return rows.select("vec_id", F.col("i").cast("bigint").alias("i"), r6("v").alias("v"))


@query("""SELECT p_partkey, CASE WHEN abs(f - 24) < 0.01 THEN 24000 WHEN abs(f - 25) < 0.01 THEN 25000 WHEN abs(f - 30) < 0.01 THEN 30000 WHEN abs(f - 50) < 0.01 THEN 50000 ELSE 90000 END::BIGINT AS timescale, CASE WHEN f IN (24, 25, 30, 50) THEN 1000 ELSE floor(90000 / f) END::BIGINT AS duration FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS f FROM part)""")
def frame_rates(spark, d):
    return table(spark, d, "part").select("p_partkey", text.timescale(F.col("p_size").cast("double")).alias("t")).select("p_partkey", "t.timescale", "t.duration")


# ---- perception and delivery ----------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT 512 / (2 * degrees(atan(512 / 96.0::DOUBLE * 2.54 / 120))) AS ppd),
f AS (SELECT o_orderkey, ['LL', 'LH', 'HL', 'HH'][o_orderkey % 4 + 1] AS subband, o_custkey % 5 AS level FROM orders),
n AS (SELECT *, 0.25 / pow(2, 4 - level) * (CASE subband WHEN 'LL' THEN 0.5 WHEN 'HH' THEN 1.414 ELSE 1 END) * ppd / 4 AS n FROM f, d)
SELECT o_orderkey, subband, level, round(least(4.0, greatest(0.1, 1 / greatest(0.1, greatest(0.01, n * exp(1 - n / 0.4)) / greatest(0.01, exp(1 - 1 / 0.4))))), 6) AS weight FROM n""")
def visual_weights(spark, d):
    from ..functions import perception

    rows = table(spark, d, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, ("LL", "LH", "HL", "HH"))), (F.col("o_orderkey") % 4).cast("int")).alias("subband"), (F.col("o_custkey") % 5).alias("level"))
    return rows.select("o_orderkey", "subband", "level", r6(perception.visual_weight(F.col("subband"), F.col("level"), 5, 512, 512)).alias("weight"))


@query(f"""SELECT l_orderkey, l_linenumber, round(least(3.0, greatest(0.5, (1 + 0.5 * 2 * pow(abs(r / 255.0::DOUBLE - 0.5), 2)) * (1 + 0.7 * 1.5 * ln(1 + least(g * 20 / 5000.0::DOUBLE, 1) * 10) / ln(11)) * (1 + 0.6 * tanh(least(b / 20.0::DOUBLE, 1) * 2)))), 6) AS masking,
 round((2 + 0.05 * sqrt(greatest(1, r))) * (1 + sqrt(g * 20 / 100.0::DOUBLE)), 6) AS threshold FROM {_PLANES}""")
def visual_masking(spark, d):
    from ..functions import perception

    r, g, b = (F.col(c).cast("double") for c in "rgb")
    return _key(planes(spark, d), masking=r6(perception.masking_factor(r, g * 20, b)), threshold=r6(perception.visibility_threshold(r, g * 20)))


@query("""SELECT event_id, greatest(1, least(12, CASE WHEN w >= 10000000 THEN 12 WHEN w >= 5000000 THEN 9 WHEN w >= 2000000 THEN 6 WHEN w >= 1000000 THEN 4 WHEN w >= 500000 THEN 3 ELSE 1 END - CASE WHEN t > 150 THEN 2 WHEN t > 100 THEN 1 ELSE 0 END))::BIGINT AS layers FROM (SELECT event_id, value * 100000 AS w, user_id % 200 AS t FROM events)""")
def adaptive_quality(spark, d):
    from ..operators import delivery

    return table(spark, d, "events").select("event_id", delivery.quality_layers(F.col("value") * 100000, F.col("user_id") % 200, 12).alias("layers"))


@query("""WITH RECURSIVE p AS (SELECT o_custkey, o_orderkey, o_totalprice AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY -(o_totalprice % 1000), o_orderkey) AS k FROM orders),
f AS (SELECT o_custkey, o_orderkey, k, size AS used, 1 AS n, true AS taken FROM p WHERE k = 1
 UNION ALL SELECT p.o_custkey, p.o_orderkey, p.k, CASE WHEN f.used < 380000 AND f.used + p.size <= 400000 THEN f.used + p.size ELSE f.used END, 1, f.used < 380000 AND f.used + p.size <= 400000 FROM f JOIN p ON p.o_custkey = f.o_custkey AND p.k = f.k + 1)
SELECT o_custkey, o_orderkey AS block FROM f WHERE taken""")
def layer_passes(spark, d):
    from ..operators import delivery

    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lit(0).alias("number"), F.col("o_totalprice").alias("size"), (F.col("o_totalprice") % 1000).alias("slope"))
    return delivery.form_layers(rows, ["o_custkey"], 400000.0, "o_orderkey", "number", "size", "slope").select("o_custkey", "block")


_VIEWS = "(SELECT user_id, event_id, event_id * 37 % 700 AS x, event_id * 53 % 700 AS y FROM events)"


@query(f"""WITH m AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM {_VIEWS} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
a AS (SELECT *, avg(dx) OVER w AS mx, avg(dy) OVER w AS my FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
t AS (SELECT *, least(1023, greatest(0, floor(x + 128 + mx * 2) - 128)) AS px, least(1023, greatest(0, floor(y + 128 + my * 2) - 128)) AS py FROM a WHERE mx IS NOT NULL)
SELECT user_id, event_id, round(greatest(0.1, 1 - sqrt(mx * mx + my * my) / 1024), 6) AS confidence, (SELECT coalesce(string_agg(CAST(ty * 8 + tx AS VARCHAR), ',' ORDER BY ty * 8 + tx), '') FROM (SELECT unnest(range(0, 8)) AS ty) JOIN (SELECT unnest(range(0, 8)) AS tx) ON true
 WHERE ty BETWEEN floor(py / 128) AND floor((py + 255) / 128) AND tx BETWEEN floor(px / 128) AND floor((px + 255) / 128) AND NOT (ty BETWEEN floor(y / 128) AND floor((y + 255) / 128) AND tx BETWEEN floor(x / 128) AND floor((x + 255) / 128))) AS tiles FROM t""")
def prefetch_tiles(spark, d):
    from ..operators import delivery

    views = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 37 % 700).alias("x"), (F.col("event_id") * 53 % 700).alias("y"))
    out = delivery.prefetch(views, ["user_id"], ["event_id"], 256, 256, 128, 8, 8)
    return out.select("user_id", "event_id", r6("confidence").alias("confidence"), F.array_join(F.transform("tiles", lambda t: t.cast("string")), ",").alias("tiles"))


@query("""SELECT event_id, user_id FROM (SELECT *, sum(length(props)) OVER (PARTITION BY user_id ORDER BY 1.0::DOUBLE / greatest(1, event_id % 5 + 1) / (1 + event_id % 97) * (event_id % 7 + 1) DESC, event_id) AS run FROM events) WHERE run <= 400""")
def cache_eviction(spark, d):
    from ..operators import delivery

    e = table(spark, d, "events").withColumn("size", F.length("props"))
    score = delivery.eviction_score(F.col("event_id") % 5, F.col("event_id") % 97, F.col("event_id") % 7)
    return delivery.evict(e, ["user_id"], score, "size", 400, "event_id").select("event_id", "user_id")


@query("""WITH h AS (SELECT user_id, event_type, max(event_id) AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), n AS (SELECT user_id, event_type, max(event_id) AS b FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(h.user_id, n.user_id) AS user_id, coalesce(h.event_type, n.event_type) AS event_type, concat_ws(',', CAST(list_min([a, b]) AS VARCHAR), CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN CAST(list_max([a, b]) AS VARCHAR) END) AS layers, CAST(coalesce(length(CAST(a AS VARCHAR)), 0) + coalesce(length(CAST(b AS VARCHAR)), 0) AS BIGINT) AS n_bytes, coalesce(a % 3 = 0, false) OR coalesce(b % 3 = 0, false) AS complete FROM h FULL JOIN n ON h.user_id = n.user_id AND h.event_type = n.event_type""")
def merge_parts(spark, d):
    from ..operators import delivery

    def part(k: int) -> DataFrame:
        m = table(spark, d, "events").filter(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.max("event_id").alias("m"))
        return m.select("user_id", "event_type", F.array("m").alias("layers"), F.encode(F.col("m").cast("string"), "UTF-8").alias("data"), (F.col("m") % 3 == 0).alias("complete"))

    out = delivery.merge_parts(part(0), part(1), ["user_id", "event_type"])
    return out.select("user_id", "event_type", F.array_join(F.transform("layers", lambda x: x.cast("string")), ",").alias("layers"), F.octet_length("data").cast("bigint").alias("n_bytes"), "complete")


@query("""WITH u AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS s FROM events GROUP BY 1) SELECT user_id, CASE WHEN NOT list_contains(s, 'click') AND NOT list_contains(s, 'purchase') THEN 'click,purchase' WHEN NOT list_contains(s, 'click') THEN 'click' WHEN NOT list_contains(s, 'purchase') THEN 'purchase' ELSE '' END AS missing,
 CASE WHEN list_contains(s, 'click') AND list_contains(s, 'purchase') THEN 'compatible' WHEN list_contains(s, 'click') THEN 'partial' ELSE 'incompatible' END AS verdict FROM u""")
def feature_support(spark, d):
    from ..operators import delivery

    u = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    gone, verdict = delivery.missing_features(F.array(F.lit("click"), F.lit("purchase")), F.col("s"), F.array(F.lit("click")))
    return u.select("user_id", F.array_join(gone, ",").alias("missing"), verdict.alias("verdict"))


@query("""WITH s AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, length(props) AS size, 40 + event_id % 7 AS duration FROM events),
c AS (SELECT track, idx, size, duration, CASE WHEN idx < 6 THEN idx // 3 ELSE 2 + (idx - 6) // 2 END AS chunk FROM s)
SELECT track, idx, chunk * 10000 + CAST(coalesce(sum(size) OVER (PARTITION BY track, chunk ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", CAST(coalesce(sum(duration) OVER (PARTITION BY track ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ts FROM c WHERE chunk < 20""")
def frame_table(spark, d):
    from ..operators import delivery

    e = table(spark, d, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    samples = e.select(F.col("user_id").alias("track"), idx.cast("bigint").alias("idx"), F.length("props").cast("bigint").alias("size"), (40 + F.col("event_id") % 7).alias("duration"))
    tracks = e.select(F.col("user_id").alias("track")).distinct()
    chunks = tracks.select("track", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint"))).alias("chunk")).withColumn("offset", F.col("chunk") * 10000)
    runs = tracks.select("track", F.inline(F.array(F.struct(F.lit(1).alias("first_chunk"), F.lit(3).alias("per_chunk")), F.struct(F.lit(3).alias("first_chunk"), F.lit(2).alias("per_chunk")))))
    return delivery.frame_table(samples, chunks, runs).select("track", "idx", "offset", "ts")


# ---- more grids -----------------------------------------------------------------------------------------------------


def _ssim_sql(grid_sql: str, n: int) -> str:
    return f"""(WITH w AS (SELECT wy, wx, avg(a) AS ma, avg(b) AS mb, avg(a * a) AS aa, avg(b * b) AS bb, avg(a * b) AS ab FROM {grid_sql}, (SELECT unnest(range(0, {n - 8}, 4)) AS wy), (SELECT unnest(range(0, {n - 8}, 4)) AS wx) WHERE y >= wy AND y < wy + 8 AND x >= wx AND x < wx + 8 GROUP BY 1, 2)
SELECT avg(((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (greatest(0, aa - ma * ma) + greatest(0, bb - mb * mb) + 58.5225))) FROM w)"""


_HALF_GRID = f"(SELECT y // 2 AS y, x // 2 AS x, floor(avg(a)) AS a, floor(avg(b)) AS b FROM {_GRID} GROUP BY 1, 2)"


@query(f"SELECT 0 AS c, round(pow({_ssim_sql(_GRID, 32)}, 0.0448) * pow({_ssim_sql(_HALF_GRID, 16)}, 0.2856), 6) AS ssim")
def multiscale_ssim(spark, d):
    return image_quality.multiscale_ssim(grid(spark, d), ["c"], 32, 32, 255.0, 2).withColumn("ssim", r6("ssim"))


@query(f"""WITH m AS (SELECT k, avg(pow(v - q, 2)) AS m FROM (SELECT unnest([0, 1, 2]) AS k, unnest([r, g, b]) AS v, unnest([r // 8 * 8 + 4, g // 8 * 8 + 4, b // 8 * 8 + 4]) AS q FROM {_PLANES}) GROUP BY 1) SELECT 0 AS image, round(avg(m), 6) AS mse, round(10 * log10(65025 / avg(m)), 6) AS psnr FROM m""")
def image_psnr(spark, d):
    v = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in enumerate("rgb")]))
    rows = planes(spark, d).select(F.lit(0).alias("image"), v.alias("s")).select("image", "s.k", "s.v", (F.floor(F.col("s.v") / 8) * 8 + 4).alias("q"))
    out = image_quality.image_psnr(rows, ["image"], "k", "v", "q", 255)
    return out.select("image", r6("mse").alias("mse"), r6("psnr").alias("psnr"))


@query(f"""WITH g AS {_GRID}, e AS (SELECT g.y, g.x, sqrt(pow(r.a - l.a, 2) + pow(d.a - u.a, 2)) AS e FROM g JOIN g l ON l.y = g.y AND l.x = g.x - 1 JOIN g r ON r.y = g.y AND r.x = g.x + 1 JOIN g u ON u.x = g.x AND u.y = g.y - 1 JOIN g d ON d.x = g.x AND d.y = g.y + 1)
SELECT 0 AS c, x, y, 8 AS width, 8 AS height, round(1 + n, 6) AS scale, CAST(floor(n * 10) AS BIGINT) AS priority FROM (SELECT x // 8 * 8 AS x, y // 8 * 8 AS y, sum(e) / 64 / 255 AS n FROM e GROUP BY 1, 2) WHERE n > 0.004""")
def busy_blocks(spark, d):
    out = image_quality.busy_blocks(grid(spark, d), ["c"], "a", 32, 32, 8, 0.004, 10)
    return out.withColumns({"scale": r6("scale"), "width": F.col("width").cast("int"), "height": F.col("height").cast("int")})


@query(f"""WITH g AS {_GRID} SELECT 0 AS c, g.y, g.x, round(avg(n.a), 6) AS mean, round(greatest(0, avg(n.a * n.a) - avg(n.a) * avg(n.a)), 4) AS variance FROM g JOIN g n ON abs(n.y - g.y) <= 4 AND abs(n.x - g.x) <= 4 GROUP BY g.y, g.x""")
def local_moments(spark, d):
    out = image_quality.local_moments(grid(spark, d), ["c"], "a", 4)
    return out.withColumns({"mean": r6("mean"), "variance": F.round("variance", 4)})


@query(f"""WITH g AS (SELECT y, x, CAST(a AS BIGINT) AS a FROM {_GRID}), p AS (SELECT y, x // 2 AS x, max(CASE WHEN x % 2 = 0 THEN a END) AS e, max(CASE WHEN x % 2 = 1 THEN a END) AS o FROM g GROUP BY 1, 2),
h AS (SELECT y, x, e, o - ((e + coalesce(lead(e) OVER (PARTITION BY y ORDER BY x), e)) >> 1) AS high FROM p) SELECT y, x, e + ((coalesce(lag(high) OVER (PARTITION BY y ORDER BY x), high) + high + 2) >> 2) AS low, high FROM h""")
def lifting_53_long(spark, d):
    return lifting.forward53_long(grid(spark, d), ["y"], "x", "a")


@query(f"""SELECT y // 2 AS y, x // 2 AS x, CASE WHEN x % 2 = 1 AND y % 2 = 1 THEN 'HH' WHEN x % 2 = 1 THEN 'HL' WHEN y % 2 = 1 THEN 'LH' ELSE 'LL' END AS subband, bool_or(a > 45) AS mask FROM {_GRID} GROUP BY 1, 2, 3""")
def wavelet_mask(spark, d):
    return regions.wavelet_mask(grid(spark, d).withColumn("mask", F.col("a") > 45), 0)


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN b > 40 THEN (CASE WHEN g >= 50 THEN greatest(CASE WHEN r < 100 THEN 2.0 ELSE 1.0 END, 1.5) ELSE CASE WHEN r < 100 THEN 2.0 ELSE 1.0 END END + 3.0) / 2 ELSE CASE WHEN g >= 50 THEN greatest(CASE WHEN r < 100 THEN 2.0 ELSE 1.0 END, 1.5) ELSE CASE WHEN r < 100 THEN 2.0 ELSE 1.0 END END END::DOUBLE AS scale FROM {_PLANES}""")
def blended_scale(spark, d):
    return _key(planes(spark, d), scale=regions.blended_scale([(F.col("r") < 100, 2.0, "replace"), (F.col("g") >= 50, 1.5, "maximum"), (F.col("b") > 40, 3.0, "average")]))


@query(f"""SELECT l_orderkey, l_linenumber, (r - 128) * 0.6::DOUBLE + (g - 128) * 0.8::DOUBLE + 20 >= 10 AND (r - 128) * 0.6::DOUBLE + (g - 128) * 0.8::DOUBLE - 20 <= 90 AS meets FROM {_PLANES}""")
def frustum_filter(spark, d):
    meets = regions.frustum_meets((F.col("r"), F.col("g"), F.lit(0)), F.lit(20), (128, 128, 0), (0.6, 0.8, 0.0), 10, 90)
    return _key(planes(spark, d), meets=meets)


@query("""SELECT p_partkey, p_size > 0 AND p_partkey % 7 > 0 AND p_size / (p_partkey % 7)::DOUBLE BETWEEN 1 / 128.0 AND 999 AS rate_ok, p_size > 0 AND abs(p_size / 2.0::DOUBLE - 25) <= 0.25 AS duration_ok, least(15, greatest(2, p_size % 12 + CASE WHEN p_size > 16 THEN 2 WHEN p_size > 12 THEN 1 ELSE 0 END))::BIGINT AS guard FROM part""")
def rate_checks(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.valid_rate(F.col("p_size"), F.col("p_partkey") % 7).alias("rate_ok"), text.consistent_duration(F.col("p_size"), F.lit(2.0), F.lit(25.0)).alias("duration_ok"), quantize.guard_bits(F.col("p_size"), F.col("p_size") % 12).cast("bigint").alias("guard"))


@query("""WITH l AS (SELECT unnest([0, 1, 2]) AS layer, unnest([300000.0, 600000.0, 900000.0]::DOUBLE[]) AS target), r AS (SELECT o_custkey, layer, o_orderkey, target, least(o_orderkey % 11, 3 * (layer + 1)) AS taken, o_totalprice FROM orders, l WHERE least(o_orderkey % 11, 3 * (layer + 1)) > 0),
s AS (SELECT *, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey, layer ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM r) SELECT o_custkey, layer, o_orderkey, taken FROM s WHERE b < target""")
def proportional_layers(spark, d):
    from ..operators import delivery

    o = table(spark, d, "orders").withColumn("passes", F.col("o_orderkey") % 11)
    return delivery.proportional_layers(o, ["o_custkey"], "o_orderkey", "passes", "o_totalprice", [300000.0, 600000.0, 900000.0])


@query("""SELECT o_orderkey, o_orderkey || ',' || o_orderpriority || ',' || o_orderstatus AS csv FROM orders""")
def csv_report(spark, d):
    from ..sources import reports

    return table(spark, d, "orders").select("o_orderkey", reports.csv_line(["o_orderkey", "o_orderpriority", "o_orderstatus"]).alias("csv"))


@query("""SELECT o_orderkey, to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus})::VARCHAR AS "json" FROM orders""")
def json_report(spark, d):
    from ..sources import reports

    return table(spark, d, "orders").select("o_orderkey", reports.json_line(["o_orderkey", "o_orderstatus"]).alias("json"))


@query("""SELECT user_id, event_type, session, count(*) AS n FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 86400000000 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY ALL""")
def session_activity(spark, d):
    s = timeline.sessions(table(spark, d, "events"), ["user_id"], "ts", 86400)
    return s.groupBy("user_id", "event_type", "session").agg(F.count(F.lit(1)).alias("n"))


def _axis_sql(source: str, axis: str, others: list[str]) -> str:
    o = ", ".join(others)
    return f"""(WITH p AS (SELECT {o}, {axis} // 2 AS {axis}, max(CASE WHEN {axis} % 2 = 0 THEN v END) AS e, max(CASE WHEN {axis} % 2 = 1 THEN v END) AS o FROM {source} GROUP BY {o}, {axis} // 2),
h AS (SELECT {o}, {axis}, e, o - ((e + coalesce(lead(e) OVER w, e)) >> 1) AS h FROM p WINDOW w AS (PARTITION BY {o} ORDER BY {axis})), l AS (SELECT {o}, {axis}, h, e + ((coalesce(lag(h) OVER w, h) + h + 2) >> 2) AS l FROM h WINDOW w AS (PARTITION BY {o} ORDER BY {axis}))
SELECT {", ".join(x if x != "band" else "band || 'L' AS band" for x in others)}, {axis}, l AS v FROM l UNION ALL SELECT {", ".join(x if x != "band" else "band || 'H' AS band" for x in others)}, {axis}, h AS v FROM l)"""


_VOLUME = "(SELECT '' AS band, z, y, x, coalesce(v, 0)::BIGINT AS v FROM (SELECT unnest(range(0, 8)) AS z) CROSS JOIN (SELECT unnest(range(0, 8)) AS y) CROSS JOIN (SELECT unnest(range(0, 8)) AS x) LEFT JOIN (SELECT l_orderkey % 8 AS z, l_partkey % 8 AS y, l_suppkey % 8 AS x, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2, 3) USING (z, y, x))"


def volume(spark, d) -> DataFrame:
    cells = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 8).alias("z"), (F.col("l_partkey") % 8).alias("y"), (F.col("l_suppkey") % 8).alias("x")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("v"))
    axis = lambda n: spark.range(8).withColumnRenamed("id", n)
    return axis("z").crossJoin(axis("y")).crossJoin(axis("x")).join(cells, ["z", "y", "x"], "left").na.fill(0, ["v"])


@query(f"SELECT band, z, y, x, v FROM {_axis_sql(_axis_sql(_axis_sql(_VOLUME, 'x', ['band', 'z', 'y']), 'y', ['band', 'z', 'x']), 'z', ['band', 'y', 'x'])}")
def transform_3d(spark, d):
    return lifting.forward53_grid(volume(spark, d), [], ["x", "y", "z"], "v")


# ---- composition, validation and recovery ---------------------------------------------------------------------------


_FRAMES = "(SELECT user_id, event_id, ts, event_id % 3 * 100 AS width, event_id % 5 * 50 AS height, CAST(round(value) AS BIGINT) AS duration FROM events)"


@query(f"""SELECT user_id, event_id, CASE WHEN width > 0 THEN width ELSE 640 END AS width, CASE WHEN height > 0 THEN height ELSE 480 END AS height, duration, row_number() OVER w - 1 AS step,
CAST(coalesce(sum(duration) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts_at, CAST(sum(duration) OVER (PARTITION BY user_id) AS BIGINT) AS total, CASE WHEN event_id * 50 <= 65535 THEN event_id * 50 ELSE 0 END AS loops FROM {_FRAMES} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def composition_instructions(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 3 * 100).alias("width"), (F.col("event_id") % 5 * 50).alias("height"), F.round("value").cast("bigint").alias("duration"))
    return composition.instructions(e, ["user_id"], ["ts", "event_id"], (640, 480)).withColumn("loops", composition.loop_field(F.col("event_id") * 50)).drop("ts")


@query("""WITH s AS (SELECT p_partkey, p_partkey % p_size AS i, p_size AS n, p_partkey % 2 = 1 AS b, ['none', 'loop', 'ping_pong'][p_partkey % 3 + 1] AS l, p_partkey % 5 = 0 AS st FROM part), t AS (SELECT *, CASE WHEN b THEN i > 0 ELSE i < n - 1 END AS inside FROM s)
SELECT p_partkey, CAST(CASE WHEN inside AND b THEN i - 1 WHEN inside THEN i + 1 WHEN l = 'loop' THEN CASE WHEN b THEN n - 1 ELSE 0 END WHEN l = 'ping_pong' AND NOT st THEN CASE WHEN b THEN 0 ELSE n - 1 END ELSE i END AS BIGINT) AS frame, CASE WHEN NOT inside AND l = 'ping_pong' THEN NOT b ELSE b END AS backward, inside OR l <> 'none' AS moved FROM t""")
def player_step(spark, d):
    k = F.col("p_partkey")
    loop = F.element_at(F.array(F.lit("none"), F.lit("loop"), F.lit("ping_pong")), (k % 3 + 1).cast("int"))
    at, backward, moved = composition.next_frame(k % F.col("p_size"), F.col("p_size"), k % 2 == 1, loop, k % 5 == 0)
    return table(spark, d, "part").select("p_partkey", at.cast("bigint").alias("frame"), backward.alias("backward"), moved.alias("moved"))


_CODES = [0xFF4F, 0xFF51, 0xFF52, 0xFF90, 0xFF93, 0xFFD9]
_MARKERS = f"(SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 2 AS position, {_CODES}[CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= o_custkey % 4 THEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) ELSE o_orderkey % 6 + 1 END] AS marker, o_orderkey % 13 + 4 AS length FROM orders)"


def marker_rows(spark, d) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    code = F.element_at(F.array(*map(F.lit, _CODES)), F.when(F.col("_n") <= F.col("o_custkey") % 4, F.col("_n")).otherwise(F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").withColumn("_n", n).select("o_custkey", ((F.col("_n") - 1) * 2).cast("bigint").alias("position"), code.alias("marker"), (F.col("o_orderkey") % 13 + 4).alias("length"))


@query(f"""WITH m AS (SELECT *, min(CASE WHEN marker = 65424 THEN position END) OVER (PARTITION BY o_custkey) AS tile FROM {_MARKERS}),
a AS (SELECT o_custkey, bool_or(position = 0 AND marker = 65359) AS st, bool_or(position = 2 AND marker = 65361) AS se, bool_or(marker = 65361) AS si, bool_or(marker = 65497) AS en, bool_or(marker = 65362 AND (tile IS NULL OR position < tile)) AS sty, count(*) FILTER (WHERE marker = 65362 AND position > tile) AS n_late, count(*) FILTER (WHERE marker <> 65359) AS n FROM m GROUP BY 1)
SELECT o_custkey, n + CASE WHEN st AND se THEN 1 ELSE 0 END AS n_markers, n_late, concat_ws(',', CASE WHEN NOT st THEN 'start_not_first' END, CASE WHEN st AND NOT se THEN 'size_not_second' END, CASE WHEN n_late > 0 THEN 'style_in_tile_part' END, CASE WHEN NOT si THEN 'size_missing' END, CASE WHEN NOT en THEN 'end_missing' END) AS issues,
CASE WHEN sty THEN '' ELSE 'style_missing' END AS warnings, st AND se AND n_late = 0 AND si AND en AS valid FROM a""")
def marker_order(spark, d):
    rows = validation.marker_order(marker_rows(spark, d), ["o_custkey"])
    return rows.withColumns({"issues": F.array_join("issues", ","), "warnings": F.array_join("warnings", ",")})


@query(f"""SELECT o_custkey, position, CASE WHEN length < 10 THEN 'short' WHEN nxt IS NULL OR nxt <> 65427 THEN 'no_data' END AS error FROM (SELECT *, lead(marker) OVER (PARTITION BY o_custkey ORDER BY position) AS nxt FROM {_MARKERS} WHERE marker IN (65424, 65427, 65497)) WHERE marker = 65424""")
def tile_parts(spark, d):
    return validation.tile_parts(marker_rows(spark, d), ["o_custkey"])


@query(f"""SELECT b, max(abs(e)) = 0 AS is_exact, max(abs(e)) AS max_error, round(avg(e * e), 6) AS mse, avg(e * e) = 0 OR 10 * log10(65025 / nullif(avg(e * e), 0)) >= 45 AS passes FROM (SELECT b, (g % 5 - 2) * (b % 3) AS e FROM {_PLANES}) GROUP BY b""")
def precision_check(spark, d):
    e = (F.col("g") % 5 - 2) * (F.col("b") % 3)
    return validation.precision(planes(spark, d), ["b"], F.col("r"), F.col("r") + e, 8, 45.0).withColumn("mse", r6("mse"))


@query("""WITH s AS (SELECT user_id, max(ts) AS seen, CASE WHEN user_id % 7 = 0 THEN 'v1' ELSE 'v2' END AS version, count(*) AS b, count(*) FILTER (WHERE event_type = 'view') AS p FROM events GROUP BY user_id),
r AS (SELECT c_custkey, seen, b, p, CASE WHEN seen IS NULL THEN 'no snapshot' WHEN epoch(TIMESTAMP '2024-02-01') - floor(epoch(seen)) > 864000 THEN 'too old' WHEN version <> 'v2' THEN 'other version' END AS why FROM customer LEFT JOIN s ON c_custkey = user_id)
SELECT c_custkey, CASE WHEN why IS NOT NULL THEN 'failed' WHEN b <= 50 AND p <= 8 THEN 'full' ELSE 'partial' END AS status, coalesce(why, CASE WHEN b > 50 OR p > 8 THEN 'restored ' || least(b, 50) || '/' || b || ' bins, ' || least(p, 8) || '/' || p || ' precincts' END) AS reason,
CASE WHEN why IS NOT NULL THEN 0 ELSE least(b, 50) END AS bins_restored, CASE WHEN why IS NOT NULL THEN 0 ELSE least(p, 8) END AS precincts_restored FROM r""")
def session_recovery(spark, d):
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").cast("timestamp").alias("at"), F.count(F.lit(1)).alias("n_bins"), F.count_if(F.col("event_type") == "view").alias("n_precincts"))
    s = s.withColumn("version", F.when(F.col("c_custkey") % 7 == 0, "v1").otherwise("v2"))
    return recovery.recover(table(spark, d, "customer").select("c_custkey"), s, "c_custkey", F.lit("2024-02-01 00:00:00").cast("timestamp"), 864000, "v2", 50, 8)


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 5""")
def restored_bins(spark, d):
    return recovery.restored(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), "event_id"], 5).select("user_id", "event_id")


@query("""WITH a AS (SELECT user_id, event_id, event_type = 'signup' AS ok, row_number() OVER w AS pos, coalesce(sum((event_type = 'signup')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY pos) AS k FROM a), c AS (SELECT *, min(CASE WHEN k > 6 THEN pos END) OVER (PARTITION BY user_id) AS stop FROM b)
SELECT user_id, event_id, CASE WHEN pos >= stop THEN 7 + pos - stop ELSE k END AS attempt, coalesce(pos >= stop, false) AS refused, NOT coalesce(pos >= stop, false) AND ok AS recovered FROM c""")
def recovery_attempts(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return recovery.attempts(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", 6).drop("ts", "event_type")


@query("""WITH r AS (SELECT p_partkey, greatest(p_size - 10, 0) AS x0, least(p_size + p_partkey % 40 - 10, 48) AS x1, greatest(p_partkey % 17, 0) AS y0, least(p_partkey % 61, 32) AS y1, p_partkey % 3 AS bw FROM part),
n AS (SELECT p_partkey, bw, (CASE WHEN x1 > x0 THEN ceil(x1 / 8) - floor(x0 / 8) ELSE 0 END * CASE WHEN y1 > y0 THEN ceil(y1 / 8) - floor(y0 / 8) ELSE 0 END)::BIGINT AS tiles FROM r)
SELECT p_partkey, tiles, tiles * 64 AS bytes, round(tiles * 64 / CASE WHEN bw > 0 THEN bw * 1000.0::DOUBLE ELSE 10000000 END, 6) AS seconds FROM n""")
def region_schedule(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    tiles, size, seconds = delivery.region_schedule([s - 10, k % 17], [s + k % 40 - 10, k % 61], [48, 32], [8, 8], 64, k % 3 * 1000.0)
    return table(spark, d, "part").select("p_partkey", tiles.cast("bigint").alias("tiles"), size.cast("bigint").alias("bytes"), r6(seconds).alias("seconds"))


@query("""SELECT p_size, CASE WHEN p_partkey % 10 > 0 THEN p_partkey // 10 END AS parent, string_agg(p_partkey, ',' ORDER BY p_partkey) AS children FROM part GROUP BY 1, 2""")
def region_children(spark, d):
    p = table(spark, d, "part").withColumn("parent", F.when(F.col("p_partkey") % 10 > 0, F.floor(F.col("p_partkey") / 10)))
    return regions.children(p, ["p_size"], "parent", "p_partkey").withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


_COST = "pow(abs(c) - {0} * 2.5, 2) + 0.5 * CASE WHEN {0} = 0 THEN 1 ELSE 2 + log2({0} + 1) END"


@query(f"""SELECT l_orderkey, l_linenumber, q, round(pow(c - q * 2.5, 2), 6) AS distortion, round(CASE WHEN q = 0 THEN 1 ELSE 2 + log2(abs(q) + 1) END, 6) AS bits FROM (SELECT *, CAST((CASE WHEN c >= 0 THEN 1 ELSE -1 END) * CASE WHEN {_COST.format("n")} <= {_COST.format("(n + 1)")} THEN n ELSE n + 1 END AS BIGINT) AS q
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity - 25 AS DOUBLE) * 0.7::DOUBLE AS c, floor(abs(CAST(l_quantity - 25 AS DOUBLE) * 0.7::DOUBLE) / 2.5) AS n FROM lineitem))""")
def trellis_quantize(spark, d):
    c, step = (F.col("l_quantity") - 25) * 0.7, F.lit(2.5)
    rows = _key(table(spark, d, "lineitem"), q=quantize.trellis(c, step), _c=c)
    return rows.select("l_orderkey", "l_linenumber", "q", r6(F.pow(F.col("_c") - F.col("q") * step, 2.0)).alias("distortion"), r6(quantize.level_rate(F.col("q"))).alias("bits"))


_STAGES = [[(1, {0: 0.5}), (2, {1: 0.25})], [(0, {2: 0.125, 1: -0.5})]]


@query(f"""SELECT l_orderkey, l_linenumber, r - (0.125::DOUBLE * o2 - 0.5::DOUBLE * o1) AS o0, o1, o2, CAST(r AS DOUBLE) AS b0, CAST(g AS DOUBLE) AS b1, CAST(b AS DOUBLE) AS b2 FROM (SELECT *, g - 0.5::DOUBLE * r AS o1, b - 0.25::DOUBLE * (g - 0.5::DOUBLE * r) AS o2 FROM {_PLANES})""")
def staged_components(spark, d):
    rows = _key(planes(spark, d), **{f"o{i}": c for i, c in enumerate(color.staged_transform([F.col(c).cast("double") for c in "rgb"], _STAGES))})
    back = color.staged_transform([F.col(f"o{i}") for i in range(3)], _STAGES, inverse=True)
    return rows.select("*", *[c.alias(f"b{i}") for i, c in enumerate(back)])


from . import flow, rules, scans, transform, volumes  # noqa: E402,F401  they register further queries
