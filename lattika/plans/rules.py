"""Queries of rules, caches, masks and further transforms, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color, nonlinear, perception, quantize, rules, text
from ..operators import caches, delivery, image_quality, lifting, rank, regions, spectral, timeline
from .queries import _PLANES, _key, planes, query, r6, table

_FEATURES = ("compositing", "dcOffset", "multipleCompositionLayers", "needsJPXReader", "noExtensions", "visualMasking", "perceptualEncoding")
_SET = "list_filter([" + ", ".join(f"CASE WHEN (event_id >> {i}) & 1 = 1 THEN '{f}' END" for i, f in enumerate(_FEATURES)) + "], lambda x: x IS NOT NULL)"
_has = lambda f: f"list_contains(s, '{f}')"


@query(f"""WITH e AS (SELECT event_id, {_SET} AS s FROM events),
i AS (SELECT event_id, 'needsJPXReader:warning:extended features' AS x FROM e WHERE len(list_intersect(s, ['dcOffset', 'visualMasking', 'perceptualEncoding'])) > 0 AND NOT {_has("needsJPXReader")}
UNION ALL SELECT event_id, 'noExtensions:error:other features' FROM e WHERE {_has("noExtensions")} AND len(s) > 1 UNION ALL SELECT event_id, 'visualMasking:warning:perceptualEncoding' FROM e WHERE {_has("visualMasking")} AND NOT {_has("perceptualEncoding")}
UNION ALL SELECT event_id, f || ':error:needsJPXReader' FROM (SELECT event_id, s, unnest(list_intersect(s, ['dcOffset', 'visualMasking', 'perceptualEncoding'])) AS f FROM e) WHERE NOT {_has("needsJPXReader")} UNION ALL SELECT event_id, 'compositing:error:multipleCompositionLayers' FROM e WHERE {_has("compositing")} AND NOT {_has("multipleCompositionLayers")})
SELECT event_id, coalesce(string_agg(x, ',' ORDER BY x), '') AS issues FROM e LEFT JOIN i USING (event_id) GROUP BY event_id""")
def feature_rules(spark, d):
    features = F.filter(F.array(*[F.when(F.call_function("shiftright", "event_id", F.lit(i)).bitwiseAND(F.lit(1)) == 1, f) for i, f in enumerate(_FEATURES)]), lambda x: x.isNotNull())
    rows = table(spark, d, "events").select("event_id", rules.feature_issues(features).alias("i"))
    return rows.select("event_id", F.array_join(F.array_sort(F.transform("i", lambda x: F.concat_ws(":", x["feature"], x["severity"], x["other"]))), ",").alias("issues"))


_KIND = "CASE event_id % 4 WHEN 0 THEN 'main_header' WHEN 1 THEN 'tile_header' ELSE 'precinct' END"


@query(f"""SELECT event_id, CASE WHEN {_KIND} <> 'precinct' THEN 'critical' WHEN event_id % 13 <= 2 THEN 'high' WHEN event_id % 13 <= 4 THEN 'medium' WHEN event_id % 13 <= 8 THEN 'low' ELSE 'background' END AS priority,
 CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN event_id % 2 = 0 ELSE event_id % 2 = 1 OR event_id % 5 < 2 END AS fits FROM events""")
def delivery_rules(spark, d):
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, "main_header").when(e % 4 == 1, "tile_header").otherwise("precinct")
    preference = F.when(e % 3 == 0, "none").when(e % 3 == 1, "htj2k").otherwise("legacy")
    format_ = F.when(e % 5 == 0, "jp2").when(e % 5 == 1, "j2k").otherwise("jpx")
    return table(spark, d, "events").select("event_id", rules.delivery_priority(kind, e % 13, 2, 8).alias("priority"), rules.preference_fits(preference, e % 2 == 0, format_).alias("fits"))


@query("""SELECT event_id, concat_ws('&', CASE WHEN event_id % 5 > 0 THEN 'comps=' || array_to_string(range(0, event_id % 5), ',') END, CASE WHEN event_id % 2 = 0 THEN 'fsiz=' || event_id || ',' || user_id END, CASE WHEN event_id % 3 = 0 THEN 'layers=' || event_id % 7 END, 'target=' || event_type) AS q,
 '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<jpx:Feature xmlns:jpx="http://www.jpeg.org/jpx">' || chr(10) || '  <jpx:Name>' || event_type || '</jpx:Name>' || chr(10) || '  <jpx:Description>' || props || '</jpx:Description>' || chr(10) || '</jpx:Feature>' AS xml, 'jpx' AS schema FROM events""")
def request_texts(spark, d):
    e = F.col("event_id")
    numbers = F.when(e % 5 > 0, F.sequence(F.lit(0).cast("bigint"), e % 5 - 1)).otherwise(F.array().cast("array<bigint>"))
    items = rules.query_items(F.col("event_type"), {"fsiz": (F.when(e % 2 == 0, e), F.col("user_id"))}, {"layers": F.when(e % 3 == 0, e % 7)}, {"comps": numbers})
    line = F.array_join(F.array_sort(F.transform(F.map_entries(items), lambda x: F.concat_ws("=", x["key"], x["value"]))), "&")
    xml = rules.feature_xml(F.col("event_type"), F.col("props"))
    return table(spark, d, "events").select("event_id", line.alias("q"), xml.alias("xml"), text.xml_schema(xml).alias("schema"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'c' || event_id END AS cid, CASE event_id % 4 WHEN 0 THEN '2.5.' || user_id WHEN 1 THEN '1.2' WHEN 2 THEN '7.' || user_id || '.9' ELSE 'unknown' END AS version, CASE event_id % 3 WHEN 0 THEN 'gml' WHEN 1 THEN 'jpx' ELSE 'generic' END AS schema FROM events""")
def text_fields(spark, d):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    header = F.concat(F.lit("path=a, "), F.when(e % 2 == 0, F.concat(F.lit("cid = c"), e.cast("string"))).otherwise(F.lit("xcid=1")), F.lit(" ,transport=http"))
    banner = F.when(e % 4 == 0, F.concat(F.lit("Tool Version 2.5."), u)).when(e % 4 == 1, "lib version: 1.2 beta").when(e % 4 == 2, F.concat(F.lit("tool-7."), u, F.lit(".9 (x)"))).otherwise("no number")
    xml = F.when(e % 3 == 0, "<gml:Point/>").when(e % 3 == 1, '<a xmlns="http://www.jpeg.org/jpx"/>').otherwise("<b/>")
    return table(spark, d, "events").select("event_id", text.channel_id(header).alias("cid"), text.version(banner).alias("version"), text.xml_schema(xml).alias("schema"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'dimensions' WHEN o_orderkey % 5 = 0 THEN 'components' WHEN o_orderkey % 50 NOT BETWEEN 1 AND 38 THEN 'bit_depth' WHEN o_orderkey % 3 = 0 THEN 'tiles' END AS error, o_orderkey * 125 AS ticks FROM orders""")
def image_checks(spark, d):
    k = F.col("o_orderkey")
    depths = F.when(k % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(8).cast("bigint"), k % 50))
    error = rules.image_error(k % 7, F.lit(4), depths, F.lit(16), F.when(k % 3 == 0, 0).otherwise(16))
    return table(spark, d, "orders").select("o_orderkey", error.alias("error"), rules.ticks(k / 8.0).alias("ticks"))


# ---- caches ---------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY (event_id % 100 - 50) * (event_id % 100 - 50) + (event_id % 70 - 20) * (event_id % 70 - 20) DESC, event_id) AS f, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT 'recent' AS kept, event_id FROM e WHERE k > greatest(1, floor(n * 0.25)) UNION ALL SELECT 'near', event_id FROM e WHERE f > greatest(1, floor(n * 0.25)) UNION ALL SELECT 'level', event_id FROM e WHERE event_id % 6 > 2 UNION ALL SELECT 'region', event_id FROM e WHERE NOT (event_id % 100 < 60 AND event_id % 100 + 8 > 40 AND event_id % 70 < 30 AND event_id % 70 + 8 > 10)
UNION ALL SELECT 'young', event_id FROM e WHERE event_id % 97 >= 40 OR event_id % 11 = 0 UNION ALL SELECT 'class', event_id FROM e WHERE event_type NOT IN ('click', 'error')""")
def evictions(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    x, y = i % 100, i % 70
    parts = {
        "recent": caches.evict_share(e, ["user_id"], [F.col("ts"), i]), "near": caches.evict_share(e, ["user_id"], [caches.squared_distance([x, y], (50.0, 20.0)).desc(), i]), "level": caches.evict_levels(e, i % 6, 2),
        "region": caches.evict_region(e, [x, y], [x + 8, y + 8], [(40, 60), (10, 30)]), "young": caches.evict_older(e, i % 97, F.lit(40), i % 11 == 0), "class": caches.invalidate(e, F.col("event_type"), ["click", "error"]),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("kept"), "event_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events) SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM r WHERE b <= 20 GROUP BY user_id""")
def quality_of_experience(spark, d):
    out = caches.experience(table(spark, d, "events"), ["user_id"], ["event_id"], "value", 20)
    return out.select("user_id", "n", r6("mean").alias("mean"), r6("deviation").alias("deviation"))


@query("""SELECT user_id, round(count(*) FILTER (WHERE event_type = 'click') / CAST(greatest(1, count(*) FILTER (WHERE event_type IN ('click', 'view'))) AS DOUBLE), 6) AS rate, array_to_string(list_sort(list_distinct(list(event_id % 6))), ',') AS levels FROM events GROUP BY user_id""")
def cache_rates(spark, d):
    e = table(spark, d, "events")
    count = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    held = caches.levels_held(e.withColumn("level", F.col("event_id") % 6), ["user_id"], "level")
    rates = e.groupBy("user_id").agg(r6(rules.hit_rate(count("click"), count("view"))).alias("rate"))
    return rates.join(held, "user_id").select("user_id", "rate", F.array_join(F.transform("levels", lambda x: x.cast("string")), ",").alias("levels"))


@query("""WITH p AS (SELECT event_id, list_filter(range(0, 16), lambda i: (event_id * 37 + i * 11) % 5 < 2) AS p, list_filter(range(0, 16), lambda i: (event_id * 53 + i * 7) % 3 = 0) AS a FROM events) SELECT event_id, len(list_intersect(p, a)) AS hits, round(len(list_intersect(p, a)) / CAST(len(p) AS DOUBLE), 6) AS precision FROM p""")
def prediction_checks(spark, d):
    e, tiles = F.col("event_id"), F.sequence(F.lit(0), F.lit(15))
    hits, share = caches.prediction_quality(F.filter(tiles, lambda i: (e * 37 + i * 11) % 5 < 2), F.filter(tiles, lambda i: (e * 53 + i * 7) % 3 == 0))
    return table(spark, d, "events").select("event_id", hits.cast("bigint").alias("hits"), r6(share).alias("precision"))


@query(f"""SELECT l_linenumber % 3 AS grp, count(*) AS pixels, count(*) FILTER (WHERE s > 0) AS covered, round(100.0::DOUBLE * count(*) FILTER (WHERE s > 0) / count(*), 6) AS percentage, round(coalesce(avg(s) FILTER (WHERE s > 0), 1), 6) AS mean_scale, round(coalesce(max(s) FILTER (WHERE s > 0), 0), 6) AS max_scale
 FROM (SELECT l_linenumber, CASE WHEN r > 128 THEN g / 64.0::DOUBLE ELSE 0 END AS s FROM {_PLANES}) GROUP BY 1""")
def region_coverage(spark, d):
    rows = planes(spark, d).withColumn("grp", F.col("l_linenumber") % 3)
    out = caches.coverage(rows, ["grp"], F.when(F.col("r") > 128, F.col("g") / 64.0).otherwise(0.0))
    return out.select("grp", "pixels", "covered", *[r6(c).alias(c) for c in ("percentage", "mean_scale", "max_scale")])


# ---- quantities -----------------------------------------------------------------------------------------------------


@query(f"""SELECT l_orderkey, l_linenumber, g AS red, g AS blue, greatest(-128, least(127, CAST(round(r * 1.5::DOUBLE) AS BIGINT))) AS scaled, trunc(x) + 0.0::DOUBLE AS cut, round(x) + 0.0::DOUBLE AS near, round_even(x, 0) + 0.0::DOUBLE AS even, round(b * 16.0::DOUBLE, 6) AS adjusted,
 CASE WHEN r % 5 = 1 THEN 'grayscale' WHEN r % 5 IN (3, 4) THEN 'sRGB' ELSE 'unknown' END AS space FROM (SELECT *, CAST((r - 128) / 4.0::DOUBLE AS DOUBLE) AS x FROM {_PLANES})""")
def sample_arithmetic(spark, d):
    x = (F.col("r") - 128) / 4.0
    red, _, blue = color.grey_to_colours(F.col("g"))
    return _key(planes(spark, d), red=red, blue=blue, scaled=quantize.scaled(F.col("r"), 1.5, 8), cut=quantize.round_mode(x, "truncate") + 0.0, near=quantize.round_mode(x, "nearest") + 0.0, even=quantize.round_mode(x, "nearest-even") + 0.0, adjusted=r6(quantize.adjust_step(F.col("b").cast("double"), 12)), space=color.color_space(F.col("r") % 5))


@query(f"""SELECT l_orderkey, l_linenumber, CAST(round(CASE WHEN r / 255.0 * 4 < 1 THEN r / 255.0 * 4 * 0.1 WHEN r / 255.0 * 4 < 2 THEN 0.1 + (r / 255.0 * 4 - 1) * 0.3 WHEN r / 255.0 * 4 < 3 THEN 0.4 + (r / 255.0 * 4 - 2) * 0.5 ELSE 0.9 + (r / 255.0 * 4 - 3) * 0.1 END * 255) AS BIGINT) AS curved FROM (SELECT l_orderkey, l_linenumber, CAST(r AS DOUBLE) AS r FROM {_PLANES})""")
def table_curve(spark, d):
    return _key(planes(spark, d), curved=nonlinear.apply(F.col("r"), "table", 8, [0.0, 0.1, 0.4, 0.9, 1.0]))


@query(f"""SELECT l_orderkey, l_linenumber, g >= 10 AND g < 110 AND r < 150 AND r >= CAST(g AS DOUBLE) AS tri, round(b * 0.0625::DOUBLE, 6) AS q FROM {_PLANES}""")
def polygon_masks(spark, d):
    return _key(planes(spark, d), tri=regions.polygon(F.col("r"), F.col("g"), [(10.0, 10.0), (150.0, 10.0), (150.0, 110.0), (110.0, 110.0)]), q=r6(quantize.adjust_step(F.col("b").cast("double"), 4)))


@query("""SELECT p_partkey, CAST(greatest(0, least(37, least(1 + p_size % 16 + 2 - 1, 5))) AS BIGINT) AS shift FROM part""")
def region_shift_bits(spark, d):
    return table(spark, d, "part").select("p_partkey", quantize.shift_bits(1 + F.col("p_size") % 16).cast("bigint").alias("shift"))


@query("""SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 'background' WHEN d < 0.2 AND event_id % 5 >= 3 THEN 'critical' WHEN d < 0.4 THEN 'high' WHEN d < 0.7 THEN 'normal' ELSE 'low' END AS priority, CASE WHEN 0.4 * d + 0.6 * (event_id % 17 / 16.0::DOUBLE) > 0.7 THEN 'fine' ELSE 'plain' END AS kind FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS d FROM events)""")
def tile_priorities(spark, d):
    e = F.col("event_id")
    distance = (e % 101) / 100.0
    kind = F.when(image_quality.texture(distance, (e % 17) / 16.0) > 0.7, "fine").otherwise("plain")
    return table(spark, d, "events").select("event_id", rank.tile_priority(distance, e % 10 != 9, e % 5, 5).alias("priority"), kind.alias("kind"))


@query("""SELECT event_id, round((coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) - value) / length(props), 6) AS slope FROM events WHERE value IS NOT NULL""")
def pass_slopes(spark, d):
    e = table(spark, d, "events").filter("value is not null").withColumn("size", F.length("props"))
    return rank.coding_slopes(e, ["user_id"], "event_id", "size", "value").select("event_id", r6("slope").alias("slope"))


@query("""WITH i AS (SELECT p_partkey, 1 + p_size % 8 AS n, p_size * 100 - 300 AS voxels, CAST(floor(p_retailprice * 50) AS BIGINT) AS bits FROM part)
SELECT p_partkey, k AS index, round((k + 1) / n::DOUBLE * (bits / voxels::DOUBLE), 12) AS target_bits, round((k + 1) / n::DOUBLE * ((k + 1) / n::DOUBLE), 6) AS distortion_reduction FROM i, range(0, 8) AS r(k) WHERE k < n AND voxels > 0""")
def even_layers(spark, d):
    size = F.col("p_size")
    out = delivery.layer_shares(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), 1 + size % 8, size * 100 - 300, F.floor(F.col("p_retailprice") * 50))
    return out.select("p_partkey", "index", F.round("target_bits", 12).alias("target_bits"), r6("distortion_reduction").alias("distortion_reduction"))


@query("""SELECT event_id, CAST(greatest(100000, floor(v * (CASE WHEN t >= 0 THEN 1 + 0.2 * t ELSE 1 + 0.3 * t END) * (CASE WHEN event_id % 3 = 0 THEN 0.7 ELSE 1.0 END))) AS BIGINT) AS next, round(greatest(0.001, least(1.0, q * (1 - 0.3 * (40 - (event_id % 7 + 37.0::DOUBLE))))), 6) AS q FROM (SELECT event_id, CAST(event_id % 1000 * 1024 AS DOUBLE) AS v, (event_id % 16 - 8) / 8.0::DOUBLE AS t, (event_id % 9) / 16.0::DOUBLE AS q FROM events)""")
def bandwidth_predictions(spark, d):
    e = F.col("event_id")
    next_ = timeline.predict_bandwidth((e % 1000 * 1024).cast("double"), (e % 16 - 8) / 8.0, e % 3 == 0)
    q = perception.adjusted_quantization((e % 9) / 16.0, F.lit(40.0), (e % 7 + 37).cast("double"))
    return table(spark, d, "events").select("event_id", next_.cast("bigint").alias("next"), r6(q).alias("q"))


@query("""SELECT (SELECT p_partkey FROM part ORDER BY abs(p_retailprice - 1000.3), p_partkey LIMIT 1) AS red, (SELECT p_partkey FROM part ORDER BY abs(p_retailprice - 950.7), p_partkey LIMIT 1) AS infrared""")
def nearest_bands(spark, d):
    bands = table(spark, d, "part").select(F.col("p_partkey").alias("band"), F.col("p_retailprice").alias("wavelength_nm"))
    one = lambda nm, name: spectral.nearest_band(bands, nm).withColumnRenamed("band", name)
    return one(1000.3, "red").join(F.broadcast(one(950.7, "infrared")))  # one row each


# ---- wavelets -------------------------------------------------------------------------------------------------------


_FIR_LOW, _FIR_HIGH = (0.25, 0.5, 0.25), (-0.5, 1.0, -0.5)


def _fir_sql(taps: tuple[float, ...], first: int) -> str:
    at = lambda k: f"2 * i + {first + k - len(taps) // 2}"
    value = lambda k: f"e[1 + CASE WHEN {at(k)} < 0 THEN -({at(k)}) - 1 WHEN {at(k)} > 63 THEN 127 - ({at(k)}) ELSE {at(k)} END]"
    return " + ".join(f"{t}::DOUBLE * {value(k)}" for k, t in enumerate(taps))


@query(f"""SELECT vec_id, CAST(i AS INTEGER) AS i, round({_fir_sql(_FIR_LOW, 0)}, 6) AS low, round({_fir_sql(_FIR_HIGH, 1)}, 6) AS high FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, unnest(range(0, 32)) AS i FROM embeddings)""")
def fir_bands(spark, d):
    signal = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", lifting.fir_analysis(signal, _FIR_LOW, _FIR_HIGH).alias("b"))
    return rows.select("vec_id", F.posexplode(F.arrays_zip(F.col("b.low").alias("low"), F.col("b.high").alias("high"))).alias("i", "p")).select("vec_id", "i", r6("p.low").alias("low"), r6("p.high").alias("high"))


@query("""SELECT vec_id, CAST(i AS INTEGER) AS i, round(CAST(e AS DOUBLE), 4) + 0.0 AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS e FROM embeddings)""")
def lifting_97_round_trip(spark, d):
    bands = table(spark, d, "embeddings").select("vec_id", lifting.forward97(F.transform("embedding", lambda x: x.cast("double"))).alias("b"))
    return bands.select("vec_id", F.posexplode(lifting.inverse97(F.col("b.low"), F.col("b.high"))).alias("i", "v")).withColumn("v", F.round("v", 4) + 0.0)


@query("""SELECT vec_id, CAST(i // 8 AS BIGINT) AS y, CAST(i % 8 AS BIGINT) AS x, CAST(round(CAST(e AS DOUBLE) * 1000) AS BIGINT) AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS e FROM embeddings)""")
def decomposition_round_trip(spark, d):
    cells = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    grid = cells.select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("bigint").alias("x"), F.round(F.col("e").cast("double") * 1000).cast("bigint").alias("v"))
    return lifting.recompose53(lifting.decompose53(grid, ["vec_id"], ["x", "y"], "v", 2), ["vec_id"], ["x", "y"], 2)


@query("""SELECT vec_id, CAST(i // 16 AS BIGINT) AS z, CAST(i // 4 % 4 AS BIGINT) AS y, CAST(i % 4 AS BIGINT) AS x, CAST(round(CAST(e AS DOUBLE) * 1000) AS BIGINT) AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS e FROM embeddings)""")
def volume_round_trip(spark, d):
    cells = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    i = F.col("i").cast("bigint")
    grid = cells.select("vec_id", F.floor(i / 16).alias("z"), (F.floor(i / 4) % 4).alias("y"), (i % 4).alias("x"), F.round(F.col("e").cast("double") * 1000).cast("bigint").alias("v"))
    return lifting.inverse53_grid(lifting.forward53_grid(grid, ["vec_id"], ["x", "y", "z"], "v"), ["vec_id"], ["x", "y", "z"])
